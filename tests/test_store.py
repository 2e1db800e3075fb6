"""Tables in buckets: what is written, what is left alone, and the archive's days."""

import os
import random

import pytest

from test_catalog import snap
from test_sync import index_is_rebuilt
from tidemark.operators import search, snapshot
from tidemark.schema import POSTING, PROBLEM
from tidemark.sources import dataset, files, store


def state(root):
    return {os.path.join(d, f): (os.path.getmtime(os.path.join(d, f)), os.path.getsize(os.path.join(d, f))) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def many(spark, n=400, **changed):
    return snap(spark, *({"id": f"i{i:04}", "key": f"k{i:04}", "title": f"title {i % 7} word{i}"} | changed.get(f"i{i:04}", {}) for i in range(n)))


def test_one_changed_row_rewrites_one_bucket(spark, tmp_path):
    root = str(tmp_path / "data")
    first = many(spark)
    assert dataset.compare_problems(first, root, 20).write(seen="2024-01-01").committed
    m = store.manifest(spark, f"{root}/problems")
    assert m.number == 1 and m.spread == 20 and len(m.buckets) > 10 and sum(b[1] for b in m.buckets.values()) == 400
    before = state(root)
    assert not dataset.compare_problems(first.withColumn("last_seen", first["first_seen"]), root, 20)  # last_seen doesn't count
    w = dataset.compare_problems(many(spark, i0007={"title": "another"}), root, 20).write(seen="2024-01-02")
    assert len(w.replaced) == 1 and not w.dropped and len(state(root)) == len(before) + 1
    assert {k: v for k, v in state(root).items() if k in before} == before  # old files are untouched
    got = {r["id"]: r for r in dataset.problems(spark, root).collect()}
    assert len(got) == 400 and got["i0007"]["title"] == "another" and {r["last_seen"] for r in got.values()} == {"2024-01-02"}
    # the folder that nobody refers to goes with the commit after the next; here the first one still serves other buckets
    dataset.compare_problems(many(spark, i0007={"title": "third"}), root, 20).write(seen="2024-01-03")
    gone = store.manifest(spark, f"{root}/problems").gone
    assert len(gone) == 1 and os.path.isdir(f"{root}/problems/{gone[0]}")
    dataset.compare_problems(many(spark, i0007={"title": "fourth"}), root, 20).write(seen="2024-01-04")
    assert not os.path.exists(f"{root}/problems/{gone[0]}")


def test_buckets_come_go_and_are_dealt_anew(spark, tmp_path):
    root = str(tmp_path / "data")
    assert store.load(spark, f"{root}/problems", PROBLEM).count() == 0
    assert dataset.compare_problems(snap(spark), root, 20).write(seen="d").committed and dataset.problems(spark, root).count() == 0
    assert not dataset.compare_problems(snap(spark), root, 20)
    dataset.compare_problems(many(spark, 60), root, 20).write(seen="d")
    assert store.manifest(spark, f"{root}/problems").spread == 1
    dataset.compare_problems(many(spark, 100), root, 20).write(seen="d")  # above four times a bucket's rows
    assert store.manifest(spark, f"{root}/problems").spread == 5 and rows_of(dataset.problems(spark, root).select("id")) == rows_of(many(spark, 100).select("id"))
    w = dataset.compare_problems(many(spark, 1), root, 20).write(seen="d")
    assert len(w.dropped) == 4 and dataset.problems(spark, root).count() == 1
    files.write_text(spark, f"{root}/problems/manifest.json", "{")
    with pytest.raises(files.SourceError):
        dataset.problems(spark, root)


def test_marks_see_every_difference(spark):
    base = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, None), ("b", 2, None)], "id string, v int, c array<string>")
    mark = lambda df: store.marks(df.withColumn("bucket", store.dealt("id", 1))).collect()
    other = lambda *rows: mark(spark.createDataFrame(list(rows), base.schema))
    assert mark(base) == mark(base.repartition(3)) and len(mark(base)) == 1
    for rows in ([("a", 1, ["x"]), ("b", 2, None)], [("a", 1, ["x"]), ("c", 2, None), ("c", 2, None)], [("a", 1, ["x", None]), ("b", 2, None), ("b", 2, None)], [("a", 1, None), ("b", 2, ["x"]), ("b", 2, None)]):
        assert other(*rows) != mark(base)


def test_index_after_deltas_equals_a_rebuild(spark, tmp_path):
    """Random days: rows come, go, come back and get other titles; only touched words' files are written."""
    rng, root, rows = random.Random(2), str(tmp_path / "data"), {}
    for day in range(1, 6):
        for _ in range(40 if day == 1 else 4):
            i = f"i{rng.randint(0, 60):03}"
            rows[i] = {"id": i, "key": i, "title": " ".join(rng.choice(["alpha", "beta", "gam", "delta9", "x", "ab", "zeta"]) + rng.choice(["", "", "s"]) for _ in range(rng.randint(0, 4))), "companies": [rng.choice(["Acme", "Beta Inc"])]}
        if day > 2:
            rows.pop(rng.choice(sorted(rows)))
        previous, sync = dataset.problems(spark, root), dataset.number(spark, root) + 1
        d = snapshot.diff(previous, snap(spark, *rows.values()), f"2024-01-0{day}")
        plan, before = dataset.compare_problems(files.kept(d.snapshot, "snap"), root, 20), state(f"{root}/postings")
        posted, _ = dataset.update_index(spark, root, previous, plan.df, d.changes, sync, 20)
        assert {k: v for k, v in state(f"{root}/postings").items() if k in before}.items() <= before.items()
        if day > 1:
            assert 0 < len(posted.replaced) < len(store.manifest(spark, f"{root}/postings").buckets)
        plan.write(seen=f"2024-01-0{day}")
        assert index_is_rebuilt(spark, root), day
        again = dataset.update_index(spark, root, previous, plan.df, d.changes, sync, 20)
        assert not again[0].replaced and not again[1].replaced  # the same delta once more changes nothing


def test_a_query_opens_the_files_of_its_words(spark, tmp_path):
    root = str(tmp_path / "data")
    words = ["tree", "trie", "two", "array", "apple", "graph", "heap", "x", "ab", "a"]
    rows = snap(spark, *({"id": f"i{i}", "key": f"k{i}", "title": f"{words[i % 10]} {words[(i + 3) % 10]}"} for i in range(30)))
    dataset.compare_problems(rows, root).write(seen="d")
    dataset.update_index(spark, root, snap(spark), rows, spark.createDataFrame([], "id string, previous_id string"), 1)
    whole = dataset.postings(spark, root)
    for query in ("tre", "graph tr", "two a", "x", "a", "heap ab", "nowhere", "array x heap", ""):
        some = dataset.postings_for(spark, root, query)
        want, got = search.search(whole, query), search.search(some, query)
        assert (want is None) == (got is None) and (want is None or rows_of(want) == rows_of(got)), query
        starts = {f.split("bucket=")[1].split("-")[0] for f in some.inputFiles()}
        asked = search.terms(query)
        assert len(starts) < 9 and all(any(s.startswith(t[:2]) for t in asked) for s in starts), query
    assert {f.split("bucket=")[1].split("-")[0] for f in dataset.postings_for(spark, root, "graph tr").inputFiles()} == {"gr", "tr"}
    assert {r["token"] for r in dataset.prefixes(spark, root, "tri").filter("prefix = 'tri'").collect()} == {"trie"}


def test_archive_days_are_only_added(spark, tmp_path):
    root = str(tmp_path / "data")
    gone = lambda day, *ids: snap(spark, *({"id": i, "key": f"k{i}", "state": "removed", "removed_on": day} for i in ids))
    held = lambda: [(r["removed_on"], r["id"]) for r in dataset.archive(spark, root, 99).orderBy("removed_on", "id").collect()]
    assert held() == [] and not dataset.append_archive(gone("2024-01-01"), root, "2024-01-01", 1)
    assert dataset.append_archive(gone("2024-01-01", "b", "a", "a"), root, "2024-01-01", 1)
    first = state(f"{root}/archive")
    assert dataset.append_archive(gone("2024-01-02", "a", "c"), root, "2024-01-02", 2)  # a came back and went again
    assert held() == [("2024-01-01", "a"), ("2024-01-01", "b"), ("2024-01-02", "a"), ("2024-01-02", "c")]
    assert {k: v for k, v in state(f"{root}/archive").items() if k in first} == first
    assert not dataset.append_archive(gone("2024-01-02", "c"), root, "2024-01-02", 3)  # the day has it already
    assert dataset.append_archive(gone("2024-01-02", "c", "d"), root, "2024-01-02", 3) and len(held()) == 5
    # a sync of number 4 stopped before its snapshot; the next one has its rows on another day
    dataset.append_archive(gone("2024-01-03", "e"), root, "2024-01-03", 4)
    dataset.append_archive(gone("2024-01-04", "e", "f"), root, "2024-01-04", 4)
    assert held()[5:] == [("2024-01-04", "e"), ("2024-01-04", "f")]
    plan = dataset.archive(spark, root, 99).filter("removed_on = '2024-01-02'").inputFiles()
    assert plan and all("removed_on=" in f for f in plan)


def test_merging_twice_is_merging_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(list(rows), "id string, token string")
    with pytest.raises(files.SourceError):
        store.merge(path, df(), df(), POSTING, store.by_start("token", "id"))
    store.compare(df(("1", "aa"), ("2", "ab"), ("3", "b")), path, store.by_start("token", "id")).write()
    for _ in range(2):
        store.merge(path, df(("1", "aa"), ("9", "none")), df(("4", "b"), ("4", "b"), ("2", "ab")), POSTING, store.by_start("token", "id"))
        assert rows_of(store.load(spark, path, POSTING)) == [("2", "ab"), ("3", "b"), ("4", "b")]
    assert set(store.manifest(spark, path).buckets) == {"ab-0", "b-0"} and store.manifest(spark, path).number == 2
    assert store.merge(path, df(), df(), POSTING, store.by_start("token", "id"), of=5).committed and store.manifest(spark, path).notes == {"of": 5}
