"""Vocabulary, merging, snapshots, matching, search and the overlay, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facets, guards, match, normalize, search, snapshot, vocab
from tidemark.schema import PERSONAL, PROBLEM


# vocabulary -------------------------------------------------------------------------------


def vocabulary(spark, *names):
    rows = [(n, i, a) for i, (n, a) in enumerate(names)]
    return vocab.vocabulary(spark.createDataFrame(rows, "name string, ord int, authoritative boolean"))


def test_split(spark):
    v = vocabulary(spark, ("Zomato / Eternal", True), ("Zomato", False), ("Amazon", False), ("infosys", False), ("Infosys", False))
    cells = ["Zomato / Eternal / Amazon", "Amazon / Newco", "Unattributed", "Amazon / unknown company", "", "AMAZON", "INFOSYS / zomato", "a/b", None]
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, company_cell string")
    got = {r["i"]: (r["companies"], r["unknown"]) for r in vocab.split_cells(rows, v).collect()}
    want = [(["Zomato / Eternal", "Amazon"], []), (["Amazon", "Newco"], ["Newco"]), ([], []), (["Amazon"], []), ([], []), (["Amazon"], []), (["Infosys", "Zomato"], []), (["a/b"], ["a/b"])]
    assert [got[i] for i in range(8)] == want


def test_vocabulary_spellings(spark):
    v = {r["norm"]: r["display"] for r in vocabulary(spark, ("mathworks", True), ("MathWorks", False), ("Mathworks", True), ("b", True), ("a  b", False), ("A b", False), ("", False)).collect()}
    assert v == {"mathworks": "MathWorks", "b": "b", "a b": "A b"}


def test_listed_names(spark):
    text = "x\nFull company list\n\nshort, list\n" + ", ".join(f"N{i}" for i in range(12)) + ".\n" + ", ".join("m" * 12)
    lines = spark.createDataFrame([("s", i, line) for i, line in enumerate(text.split("\n"))], "source string, line_no int, line string")
    assert [r["name"] for r in vocab.listed_names(lines).orderBy("ord").collect()] == [f"N{i}" for i in range(12)]
    docs = spark.createDataFrame([('{"A": "a", "B / C": "b"}',), ("broken {",)], "text string")
    assert sorted(r["name"] for r in vocab.json_names(docs).collect()) == ["A", "B / C"]


# merging ----------------------------------------------------------------------------------


def fold(rows):
    """Left fold in arrival order: a strictly newer row takes over, lists are united, format filled in."""
    rec, merged = None, 0
    for r in rows:
        new = {**r, "companies": list(r["companies"]), "sources": [r["source"]]}
        if rec is None:
            rec = new
            continue
        merged += 1
        a, b = (new, rec) if (new["updated"] or "") > (rec["updated"] or "") else (rec, new)
        for k in ("companies", "sources"):
            a[k] += [x for x in b[k] if x not in a[k]]
        a["format"] = a["format"] or b["format"]
        rec = a
    return rec["title"], rec["url"], rec["companies"], rec["format"], rec["updated"], rec["sources"], merged


def test_merge_is_the_fold(spark):
    rng = random.Random(3)
    groups, rows = {}, []
    for g in range(150):
        own = []
        for i in range(rng.randint(1, 7)):
            own.append({"id": f"g{g}", "key": f"g{g}", "title": f"t{rng.randint(0, 2)}", "url": f"u{i}", "companies": rng.sample(["a", "b", "c"], rng.randint(0, 3)), "format": rng.choice([None, "SQL", "Coding"]), "updated": rng.choice([None, "2024-01-01", "2024-01-02", "2024-01-03"]), "source": f"s{rng.randint(0, 1)}", "source_ord": i // 3, "line_no": i})
        groups[f"g{g}"] = fold(own)
        rows += own
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id string, key string, title string, url string, companies array<string>, format string, updated string, source string, source_ord int, line_no int")
    got = {r["id"]: (r["title"], r["url"], r["companies"], r["format"], r["upstream_updated"], r["sources"], r["merged_rows"]) for r in normalize.merged(df, "2024-06-01").collect()}
    assert got == groups


def test_a_hot_id_leaves_as_many_values_as_it_has(spark):
    """A third of all rows share an id: the merge is the fold, and no list of rows is in its plan."""
    rng = random.Random(8)
    rows = [{"id": "hot" if i % 3 == 0 else f"g{i}", "key": "k", "title": f"t{i}", "url": f"u{i}", "companies": rng.sample(["a", "b", "c", "d"], rng.randint(0, 3)), "format": rng.choice([None, "", "SQL"]), "updated": rng.choice([None, *(f"2024-01-{d:02}" for d in range(1, 25))]), "source": f"s{i % 4}", "source_ord": i % 4, "line_no": i} for i in range(3000)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id string, key string, title string, url string, companies array<string>, format string, updated string, source string, source_ord int, line_no int")
    got = normalize.merged(df, "2024-06-01").filter("id = 'hot'").first()
    want = fold(sorted((r for r in rows if r["id"] == "hot"), key=lambda r: (r["source_ord"], r["line_no"])))
    assert (got["title"], got["url"], got["companies"], got["format"] or None, got["upstream_updated"], got["sources"], got["merged_rows"]) == (*want[:3], want[3] or None, *want[4:])
    values = normalize._ranked_values(df).filter("id = 'hot'").count()
    assert values <= 4 + 4 + 1  # companies, sources, formats


def test_a_vocabulary_of_a_million_names(spark):
    names = spark.range(1_000_000).select(F.concat(F.lit("Name "), F.col("id").cast("string")).alias("name"), F.col("id").cast("int").alias("ord"), F.lit(False).alias("authoritative"))
    rows = spark.range(0, 1_000_000, 50_000).select("id", F.concat(F.lit("name "), F.col("id").cast("string"), F.lit(" / Nobody")).alias("company_cell"))
    got = vocab.split_cells(rows, vocab.vocabulary(names)).collect()
    assert len(got) == 20 and all(r["companies"] == [f"Name {r['id']}", "Nobody"] and r["unknown"] == ["Nobody"] for r in got)


@pytest.mark.parametrize("sort", ["updated", "first_seen", "title", "company"])
def test_pages_by_place_are_those_by_number(spark, sort):
    rng = random.Random(sort)
    rows = snap(spark, *({"id": f"i{i}", "key": f"k{rng.randint(0, 9)}", "title": rng.choice(["Äpfel", "apfel", "Apfel", "zebra", "a b", ""]), "companies": rng.choice([[], ["Zeta", "b"], ["alpha"], ["Ålpha"]]), "upstream_updated": rng.choice([None, "2024-01-01", "2024-02-01"]), "first_seen": rng.choice([None, "2024-01-01", "2023-01-01"])} for i in range(60)))
    whole, place, seen = [r["id"] for r in rows.orderBy(*facets.sort_keys(sort)).collect()], None, []
    while page := facets.page_after(rows, sort, place, 7).collect():
        seen += [r["id"] for r in page]
        place = facets.place_of(page[-1], sort)
    assert seen == whole and len(seen) == 60


def test_conflicts(spark):
    rows = [("k", "A", "SQL", "2024-01-01", 0), ("k", "B", "SQL", "2024-01-02", 1), ("k", "B", "Coding", None, 2), ("k", "A", None, None, 3), ("k", "A", None, None, 4)]
    df = spark.createDataFrame([(k, k, t, f, u, n, 0) for k, t, f, u, n in rows], "id string, key string, title string, format string, updated string, line_no int, source_ord int")
    got = sorted((r["kind"], r["kept"], r["other"], r["arrival"]) for r in normalize.conflicts(df).collect())
    assert got == [("format", "SQL", "Coding", 3), ("title", "A", "B", 2), ("title", "B", "A", 4)]


# snapshots --------------------------------------------------------------------------------


def snap(spark, *rows):
    """rows: dicts with at least id; the other fields get defaults."""
    base = {"url": None, "companies": ["A"], "format": "SQL", "first_seen": "2024-01-01", "last_seen": "2024-01-01", "state": "active", "removed_on": None, "aliases": [], "sources": []}
    full = [{**base, "key": r["id"], "title": r["id"], "upstream_updated": None, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f] for f in PROBLEM.fieldNames()) for r in full], PROBLEM)


def test_one_of_each_kind(spark):
    before = snap(spark, {"id": "same"}, {"id": "gone"}, {"id": "old", "title": "T", "companies": ["x", "y"]}, {"id": "name", "title": "n1"}, {"id": "who", "companies": ["a", "b"]}, {"id": "tomb", "state": "removed", "removed_on": "2023-01-01"}, {"id": "back", "state": "removed", "removed_on": "2023-01-01", "aliases": ["z"]})
    after = snap(spark, {"id": "same", "format": "Coding"}, {"id": "new", "title": "T", "companies": ["y", "x"]}, {"id": "name", "title": "n2"}, {"id": "who", "companies": ["b", "a", "c"]}, {"id": "fresh"}, {"id": "back"})
    d = snapshot.diff(before, after, "2024-02-02")
    assert sorted((c["kind"], c["id"]) for c in d.changes.collect()) == [("added", "back"), ("added", "fresh"), ("recompanied", "who"), ("relinked", "new"), ("removed", "gone"), ("retitled", "name")]
    s = {r["id"]: r for r in d.snapshot.collect()}
    assert set(s) == {"same", "gone", "new", "name", "who", "tomb", "back", "fresh"}
    assert s["new"]["aliases"] == ["old"] and s["new"]["first_seen"] == "2024-01-01" and s["fresh"]["first_seen"] == "2024-02-02"
    assert (s["gone"]["state"], s["gone"]["removed_on"], s["gone"]["last_seen"]) == ("removed", "2024-02-02", "2024-01-01")
    assert s["back"]["state"] == "active" and s["back"]["aliases"] == ["z"] and s["back"]["removed_on"] is None and s["same"]["format"] == "Coding"
    assert s["tomb"]["removed_on"] == "2023-01-01"
    assert {r["id"]: r["aliases"] for r in d.archived.collect()} == {"gone": [], "old": ["new"]}
    assert {r["kind"]: r["n"] for r in d.counts().collect()} == {"added": 2, "removed": 1, "retitled": 1, "relinked": 1, "recompanied": 1}
    lines = {r["id"]: r["line"] for r in snapshot.described(d.changes, d.snapshot).collect()}
    assert lines["name"] == "n1 → n2" and lines["who"] == "who — a, b → b, a, c" and lines["new"] == "T — old → new" and lines["gone"] == "gone — removed upstream" and lines["fresh"] == "fresh — A · SQL"


def test_nothing_moved(spark):
    s = snap(spark, {"id": "a"}, {"id": "b", "state": "removed", "removed_on": "2024-01-01"})
    d = snapshot.diff(s, s.filter("id = 'a'"), "2024-02-02")
    assert d.changes.count() == 0 and d.ambiguous.count() == 0 and d.archived.count() == 0 and d.snapshot.count() == 2


def test_ambiguous_relinks_stay_apart(spark):
    d = snapshot.diff(snap(spark, {"id": "a", "title": "T"}, {"id": "b", "title": "T"}), snap(spark, {"id": "c", "title": "T"}), "2024-02-02")
    assert [(r["added_ids"], r["removed_ids"]) for r in snapshot.ambiguous_lists(d.ambiguous).collect()] == [(["c"], ["a", "b"])]
    assert sorted((r["side"], r["id"], r["n_added"], r["n_removed"]) for r in d.ambiguous.collect()) == [("added", "c", 1, 2), ("removed", "a", 1, 2), ("removed", "b", 1, 2)]
    assert [r["reason"][:30] for r in snapshot.ambiguous_groups(d.ambiguous).collect()] == ["1 added and 2 removed rows sha"]
    assert snapshot.ambiguous_lists(d.ambiguous, 1).count() == 0
    assert sorted((c["kind"], c["id"]) for c in d.changes.collect()) == [("added", "c"), ("removed", "a"), ("removed", "b")]


def test_one_signature_of_all_rows(spark):
    """Every row moves under one title: the group is counted, and its rows come out one by one."""
    n = 3000
    before, after = (spark.range(n).selectExpr(f"concat('{side}', id) AS id") for side in "ab")
    full = lambda df: df.select(*((F.col("id") if f.name in ("id", "key") else F.lit("same") if f.name == "title" else F.lit("active") if f.name == "state" else F.array().cast("array<string>") if f.dataType.simpleString().startswith("array") else F.lit(None)).cast(f.dataType).alias(f.name) for f in PROBLEM))
    d = snapshot.diff(full(before), full(after), "2024-02-01")
    assert d.ambiguous.count() == 2 * n and [(r["n_added"], r["n_removed"]) for r in snapshot.ambiguous_groups(d.ambiguous).collect()] == [(n, n)]
    assert {r["kind"]: r["n"] for r in d.counts().collect()} == {"added": n, "removed": n, "retitled": 0, "relinked": 0, "recompanied": 0}


def test_null_format_relinks_with_null_only(spark):
    d = snapshot.diff(snap(spark, {"id": "a", "title": "T", "format": None}), snap(spark, {"id": "b", "title": "T", "format": None}), "2024-02-02")
    assert [c["kind"] for c in d.changes.collect()] == ["relinked"]
    d = snapshot.diff(snap(spark, {"id": "a", "title": "T", "format": None}), snap(spark, {"id": "b", "title": "T", "format": ""}), "2024-02-02")
    assert sorted(c["kind"] for c in d.changes.collect()) == ["added", "removed"]


def test_prune_and_archive(spark):
    s = snap(spark, {"id": "live"}, *({"id": i, "state": "removed", "removed_on": day} for i, day in (("old", "2023-01-01"), ("used", "2023-01-01"), ("young", "2024-01-05"), ("edge", "2024-01-03"), ("none", None))))
    kept, dropped = snapshot.prune(s, "2024-07-01", spark.createDataFrame([("used",)], "id string"))
    assert sorted(r["id"] for r in dropped.collect()) == ["none", "old"] and kept.count() == 4
    assert snapshot.prune(s, "2024-07-01", None)[1].count() == 0
    again = snapshot.archive(s.filter("id = 'old'"), s.filter("id IN ('old', 'none')").union(s.filter("id = 'none'")))
    assert sorted(r["id"] for r in again.collect()) == ["none", "old"]


def test_guards(spark):
    assert guards.check_row_count(0, 1) == guards.check_row_count(100, 90) == guards.check_row_count(10, 50) == []
    for bad in ((0, 0), (100, 89)):
        with pytest.raises(guards.Abort):
            guards.check_row_count(*bad)
    assert guards.check_divergence(0, 0, 5, 5) == [] and len(guards.check_divergence(20, 5, 100, 100)) == 1 and len(guards.check_divergence(50, 0, 5000, 5000)) == 1
    for bad in ((20, 6, 100, 100), (51, 0, 5000, 5000)):
        with pytest.raises(guards.Abort):
            guards.check_divergence(*bad)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    s = snap(spark, {"id": "a"}, {"id": "b"})
    assert guards.check(s, s, ids("a", "b"), ids("a", "b")) == []
    with pytest.raises(guards.Abort, match="no format"):
        guards.check(s, snap(spark, {"id": "a", "format": None}, {"id": "b"}), ids("a"), ids("a"))


# matching, search, overlay ----------------------------------------------------------------


def test_match_tiers(spark):
    titles = ["Two Sum", "Two Sum II - Input", "Reverse Integer", "Number of Good Pairs", "Happy Number", "Twin", "twin", "Maximum AND Sum of Array", "the of"]
    e = spark.createDataFrame([(f"s{i}", t, False, None, "u") for i, t in enumerate(titles)], "slug string, title string, paid boolean, difficulty string, url string")
    asked = {"a": "two sum", "b": "Reverse An Integer", "c": "Num of Good Pair", "d": "Is Happy Numbers", "e": "Twin", "f": "Maximum Sum of Array", "g": "an of", "h": "Two Sum Three"}
    got = {r["id"]: (r["tier"], r["entry"]["slug"]) for r in match.matched(spark.createDataFrame(list(asked.items()), "id string, title string"), e).collect()}
    assert got == {"a": (1, "s0"), "b": (2, "s2"), "c": (3, "s3"), "d": (4, "s4")}
    assert match.catalogue_size(e).first()[0] == 9
    rows = snap(spark, {"id": "x", "title": "Two Sum", "format": "System design"}, {"id": "y", "title": "Two Sum", "state": "removed"})
    assert [r["id"] for r in match.origins(rows, e).collect()] == ["y"]


def test_search(spark):
    texts = {1: "red apple pie", 2: "red app", 3: "green apples", 4: "ap red", 5: "constructor"}
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    posted = search.postings(rows, F.col("text"))
    find = lambda q: sorted(r["id"] for r in search.search(posted, q).collect())
    assert find("red app") == [1, 2] and find("apple") == [1, 3] and find("RED red") == [1, 2, 4]
    assert find("red ap") == [4] and find("gr") == [3] and find("zz") == [] and find("toString") == [] and find("apple red") == [1]
    assert search.search(posted, " ,") is None
    assert {r["prefix"]: r["tokens"] for r in search.prefix_index(posted).collect()}["app"] == ["apple", "apples"]


def overlay(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f) for f in PERSONAL.fieldNames()) for r in rows], PERSONAL)


def test_facets(spark):
    rows = snap(spark, {"id": "a", "companies": ["X", "Y"]}, {"id": "b", "format": None}, {"id": "c", "state": "removed"}, {"id": "d", "state": "removed"}, {"id": "e", "first_seen": "2024-05-30", "companies": []})
    mine = overlay(spark, {"id": "a", "status": "solved", "tags": ["t"]}, {"id": "c", "notes": "n"}, {"id": "b", "difficulty": 0, "tags": []})
    find = lambda **f: sorted(r["id"] for r in facets.select(rows, mine, facets.FacetQuery(**f), "2024-06-01").collect())
    assert find() == ["a", "b", "c", "e"] and find(show_removed=True) == ["a", "b", "c", "d", "e"]
    assert find(companies=["Y", "Q"]) == ["a"] and find(formats=["SQL"]) == ["a", "c", "e"] and find(statuses=["solved"]) == ["a"] and find(tags=["t", "u"]) == ["a"]
    assert find(untouched_only=True) == ["b", "e"] and find(age=3) == ["e"] and find(formats=["SQL"], companies=["X"]) == ["a"]
    assert {r["company"]: r["n"] for r in facets.company_counts(rows).collect()} == {"X": 1, "Y": 1, "A": 1}
    assert facets.progress(rows, mine).first().asDict() == {"total": 5, "live": 3, "removed": 2, "touched": 2, "solved": 1, "solved_percent": 20}
    assert [(r["company"], r["n"], r["bar"]) for r in facets.solved_by_company(rows, mine).collect()] == [("X", 1, 1.0), ("Y", 1, 1.0)]
    assert [r["id"] for r in facets.page(rows, "company", 0, 9).collect()] == ["e", "b", "c", "d", "a"]


def test_overlay_moves(spark):
    rows = snap(spark, {"id": "n1", "aliases": ["gone", "o1", "o2"]}, {"id": "n2", "aliases": ["o3"]}, {"id": "n3", "aliases": []})
    mine = overlay(spark, {"id": "o1", "status": "todo"}, {"id": "o2", "status": "solved"}, {"id": "o3", "notes": "x"}, {"id": "n2", "notes": "own"})
    got = {r["id"]: (r["status"], r["notes"], r["migrated_from"]) for r in facets.migrate(rows, mine).collect()}
    assert got == {"n1": ("todo", None, "o1"), "o2": ("solved", None, None), "o3": (None, "x", None), "n2": (None, "own", None)}
    patch = spark.createDataFrame([("o1", None, ""), ("o3", "solved", "y"), ("new", "todo", None)], "id string, status string, notes string")
    got = {r["id"]: (r["status"], r["notes"]) for r in facets.upsert(mine, patch).collect()}
    assert got == {"o1": ("todo", ""), "o2": ("solved", None), "o3": ("solved", "y"), "n2": (None, "own"), "new": ("todo", None)}
    assert {r["id"]: r["status"] for r in facets.imported(mine, overlay(spark, {"id": "o1", "status": "revisit"})).collect()}["o1"] == "revisit"
