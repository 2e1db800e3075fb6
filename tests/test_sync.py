"""The whole sync over small documents of our own, its no-ops, aborts and sinks."""

import json
import os

import pytest

from tidemark.operators.guards import Abort
from tidemark.operators.match import OriginError
from tidemark.plans.sync import UnknownSchema, resolve_origins, sync
from tidemark.sources import dataset, files, sinks, store

NOW = "| Company | OA / Interview Question | Format | Practice | Updated |\n|---|---|---|---|---|\n"
PAGE = "| Company | OA / Interview Question | Practice | Updated |\n|---|---|---|---|\n"
FORMATS = {"coding": "Coding", "system-design": "System design", "sql": "SQL", "low-level-design": "Low-level design", "ai-coding": "AI coding"}


def write(folder, rows, extra=None):
    """rows: (company, title, slug, format); the pages repeat the rows of their format."""
    os.makedirs(folder, exist_ok=True)
    names = "Full company list\n\n" + ", ".join(f"Name{i}" for i in range(12)) + ".\n\n"
    docs = {"README.md": "# List\n" + names + NOW + "".join(f"| **{c}** | [{t}](https://h.example/{s}) | {f} | [![P][p]](https://h.example/{s}) | Jan 2, 2024 |\n" for c, t, s, f in rows)}
    for page, label in FORMATS.items():
        docs[f"{page}.md"] = PAGE + "".join(f"| {c} | [{t}](https://h.example/{s}) | | Jan 2, 2024 |\n" for c, t, s, f in rows if f == label)
    docs["company-domains.json"] = json.dumps({"Acme": "a", "Zomato / Eternal": "z"})
    for name, text in (docs | (extra or {})).items():
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)


ROWS = [("Acme", "Two Sum", "problems/two-sum", "Coding"), ("Acme / Zomato / Eternal", "Join", "problems/join", "SQL"), ("Unattributed", "Cache", "system-design/cache", "System design")] + [(f"Name{i}", f"T{i}", f"problems/t{i}", "Coding") for i in range(9)] + [("Acme", "Low", "low-level-design/low", "Low-level design"), ("Acme", "Ai", "project-coding/ai", "AI coding")]


def contents(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if not f.startswith(".")}


def test_days(spark, tmp_path):
    root, docs = str(tmp_path / "data"), str(tmp_path / "docs")
    write(docs, ROWS)
    out = sync(spark, root, docs, "2024-02-01", "version-1")
    assert out.counts["added"] == len(ROWS) and out.changed and not [w for w in out.warnings if "vocabulary" not in w and "expected" not in w]
    got = {r["key"]: r for r in dataset.problems(spark, root).collect()}
    assert got["problems/join"]["companies"] == ["Acme", "Zomato / Eternal"] and got["system-design/cache"]["companies"] == [] and got["problems/join"]["format"] == "SQL"
    assert got["problems/join"]["sources"] == ["README.md", "formats/sql.md"]
    log = open(f"{root}/CHANGELOG.md", encoding="utf-8").read()
    assert log.startswith("# Changelog\n\n## 2024-02-01\n\n### Added (14)\n\n- ")

    assert sync(spark, root, docs, "2024-02-01", "version-1").skipped
    before = contents(root)
    again = sync(spark, root, docs, "2024-02-02", "version-2")
    assert not again.changed and again.written == ["meta.json"] and {k for k, v in contents(root).items() if before.get(k) != v} <= {f"{root}/meta.json"}

    moved = [("Acme", "Two Sum II", "problems/two-sum", "Coding"), ("Acme / Zomato / Eternal", "Join", "problems/joined", "SQL"), *ROWS[2:-1], ("Acme", "New", "project-coding/new", "AI coding")]
    write(docs, moved)
    out = sync(spark, root, docs, "2024-02-03", "version-3")
    assert out.counts == {"added": 1, "removed": 1, "retitled": 1, "relinked": 1, "recompanied": 0}
    assert dataset.archive(spark, root).count() == 2 and dataset.problems(spark, root).count() == 15
    order = lambda name, *by: [tuple(r[c] or "" for c in by) for r in (dataset.problems(spark, root) if name == "problems" else dataset.archive(spark, root) if name == "archive" else spark.read.parquet(f"{root}/{name}")).collect()]
    assert {r["last_seen"] for r in dataset.problems(spark, root).filter("state <> 'removed'").collect()} == {"2024-02-03"}
    assert [k for k, *_ in order("changes/date=2024-02-03", "kind", "key", "id")] == ["added", "removed", "retitled", "relinked"] == [k for k, in order("changes/latest", "kind")]
    assert order("archive", "removed_on", "key") == sorted(order("archive", "removed_on", "key")) and order("problems", "key", "id") == sorted(order("problems", "key", "id"))
    assert not [x for x in os.listdir(root) if x.endswith((".old", ".tmp")) or "staged" in x]
    log = open(f"{root}/CHANGELOG.md", encoding="utf-8").read()
    assert log.index("## 2024-02-03") < log.index("## 2024-02-01") and "- Two Sum → Two Sum II" in log and "- Join — problems/join → problems/joined" in log

    catalogue = {"stat_status_pairs": [{"stat": {"question__title": "Two Sum II", "question__title_slug": "two-sum-ii"}, "difficulty": {"level": 2}, "paid_only": True, "x": 1}]}
    with open(f"{docs}/catalogue.json", "w") as f:
        json.dump(catalogue, f)
    assert resolve_origins(spark, root, f"{docs}/catalogue.json") == (1, 1, True) and resolve_origins(spark, root, f"{docs}/catalogue.json") == (1, 1, False)
    row = spark.read.parquet(f"{root}/origins").first()
    assert (row["url"], row["difficulty"], row["paid"]) == ("https://leetcode.com/problems/two-sum-ii/", "Medium", True)
    with pytest.raises(OriginError):
        resolve_origins(spark, str(tmp_path / "none"), f"{docs}/catalogue.json")


@pytest.mark.parametrize(
    "change, error",
    [
        (lambda d: write(d, ROWS[:10]), Abort),
        (lambda d: write(d, ROWS, {"README.md": "# gone\n"}), UnknownSchema),
        (lambda d: write(d, ROWS, {"sql.md": PAGE.replace("Company", "Firm") + "| a | b | c | d |\n"}), UnknownSchema),
        (lambda d: write(d, [*ROWS[:-1], ("Acme", "Ai", "odd/ai", "")]), Abort),
        (lambda d: os.remove(f"{d}/sql.md"), files.SourceError),
        (lambda d: write(d, ROWS, {"sql.md": " \n"}), files.SourceError),
    ],
)
def test_aborts_write_nothing(spark, tmp_path_factory, change, error):
    if not hasattr(test_aborts_write_nothing, "base"):
        base = str(tmp_path_factory.mktemp("aborts"))
        write(f"{base}/docs", ROWS)
        sync(spark, f"{base}/data", f"{base}/docs", "2024-02-01", "version-1")
        test_aborts_write_nothing.base = base
    base = test_aborts_write_nothing.base
    write(f"{base}/docs", ROWS)
    before = contents(f"{base}/data")
    change(f"{base}/docs")
    with pytest.raises(error):
        sync(spark, f"{base}/data", f"{base}/docs", "2024-02-02", "version-2")
    assert contents(f"{base}/data") == before


@pytest.mark.parametrize("stop, day", [("problems/manifest.json", "2024-02-04"), ("prefixes/manifest.json", "2024-02-03")])
def test_a_sync_that_stops_is_made_up_for(spark, tmp_path, monkeypatch, stop, day):
    """The driver dies within a swap; cached blocks are lost between writes. The next sync, of that day or the next, ends in the same state."""
    root, docs = str(tmp_path / "data"), str(tmp_path / "docs")
    write(docs, ROWS)
    sync(spark, root, docs, "2024-02-01", "version-1")
    write(docs, [("Acme", "Two Sum II", "problems/two-sum", "Coding"), *ROWS[1:-1], ("Acme", "Gone Again", "project-coding/again", "AI coding")])
    swap = files.swap

    def torn(spark, staged, target):
        spark.catalog.clearCache()
        for df in list(spark.sparkContext._jsc.getPersistentRDDs().values()):
            df.unpersist(True)
        if not target.endswith(stop):
            return swap(spark, staged, target)
        if os.path.exists(target):
            os.rename(target, target + ".old")
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(files, "swap", torn)
    with pytest.raises(RuntimeError):
        sync(spark, root, docs, "2024-02-03", "version-2")
    monkeypatch.setattr(files, "swap", swap)
    assert dataset.archive(spark, root).count() == 0  # what the stopped sync archived isn't there yet
    write(docs, [("Acme", "Two Sum II", "problems/two-sum", "Coding"), *ROWS[1:-1], ("Acme", "New", "project-coding/new", "AI coding")])
    out = sync(spark, root, docs, day, "version-3")
    assert out.counts == {"added": 1, "removed": 1, "retitled": 1, "relinked": 0, "recompanied": 0}
    assert [(r["key"], r["removed_on"]) for r in dataset.archive(spark, root).collect()] == [("project-coding/ai", day)]
    assert spark.read.parquet(f"{root}/changes/date={day}").count() == 3 == spark.read.parquet(f"{root}/changes/latest").count()
    assert dataset.problems(spark, root).count() == len(ROWS) + 1
    log = open(f"{root}/CHANGELOG.md", encoding="utf-8").read()
    assert "## 2024-02-01" in log and log.count(f"## {day}") == 1
    assert index_is_rebuilt(spark, root)


def index_is_rebuilt(spark, root):
    """Whether the stored index is the one that the whole snapshot would make."""
    from tidemark.operators import search

    posted = search.postings(dataset.problems(spark, root))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    return same(dataset.postings(spark, root), posted) and same(dataset.prefixes(spark, root), search.prefixes(posted))


def test_bundle(spark, tmp_path):
    root, docs = str(tmp_path / "data"), str(tmp_path / "docs")
    with pytest.raises(files.SourceError):
        dataset.bundle(spark, root)
    write(docs, ROWS)
    sync(spark, root, docs, "2024-02-01", "version-1")
    b = dataset.bundle(spark, root)
    assert b.rows.count() == len(ROWS) == b.latest.count() and b.origins.count() == 0 and b.meta["version"] == "version-1" and b.postings.count() > 0
    assert store.manifest(spark, f"{root}/problems").number == 1 == store.manifest(spark, f"{root}/postings").notes["of"]
    files.write_text(spark, f"{root}/meta.json", "{")
    os.rename(f"{root}/changes", f"{root}/gone")
    b = dataset.bundle(spark, root)
    assert b.meta is None and b.latest.count() == 0


def test_warnings_are_counted(spark, monkeypatch):
    from tidemark.plans import sync as plan

    monkeypatch.setattr(plan, "MOST_WARNINGS", 2)
    issues = spark.createDataFrame([("s", i, f"m{i}") for i in range(5)], "source string, line_no int, message string")
    conflicts = spark.createDataFrame([("k", "title", "a", "b", 1)], "key string, kind string, kept string, other string, arrival int")
    assert plan._warnings(issues, conflicts) == ["m0", "m1", "and 3 more", "k: title 'a' / 'b'"]


def test_ci_flags(tmp_path, monkeypatch):
    from tidemark.cli import _tell_ci

    monkeypatch.setenv("GITHUB_OUTPUT", str(tmp_path / "out"))
    _tell_ci(dataset_changed=True, upstream_sha="abc")
    assert open(tmp_path / "out").read() == "dataset_changed=true\nupstream_sha=abc\n"
    assert sinks.indented({"a": [1]}) == '{\n  "a": [\n    1\n  ]\n}\n'


def test_files(spark, tmp_path):
    p = str(tmp_path / "a" / "x.txt")
    assert files.read_text(spark, p) is None and files.write_text(spark, p, "é\nx") and files.read_text(spark, p) == "é\nx" and not files.write_text(spark, p, "é\nx")
    os.makedirs(tmp_path / "v" / "abcdefg1")
    assert files.head(spark, str(tmp_path / "v")) == "abcdefg1"
    with pytest.raises(files.SourceError):
        files.head(spark, str(tmp_path / "a"))
    assert files.read_meta(spark, p) is None and files.read_meta(spark, p + "no") is None
    from tidemark.schema import PROBLEM

    with pytest.raises(files.SourceError):
        files.read_document(spark, p, "problems", PROBLEM)
    doc = str(tmp_path / "d.json")
    rows = spark.createDataFrame([("i", "k"), ("j", None)], "id string, key string")
    files.write_text(spark, doc, sinks.render({"n": 2}, "problems", rows.orderBy("id")))
    assert [(r["id"], r["key"]) for r in files.read_document(spark, doc, "problems", PROBLEM).collect()] == [("i", "k"), ("j", None)]
    assert open(doc).read() == '{\n"n":2,\n"problems":[\n{"id":"i","key":"k"},\n{"id":"j","key":null}\n]}\n'


def test_overlay_files(spark):
    from tidemark.schema import PERSONAL

    df = spark.createDataFrame([("a", "todo", 1, None, None, ["x"], None, None)], PERSONAL)
    text = sinks.export_personal(df, "2024-01-01")
    assert sinks.import_personal(spark, text).collect() == df.collect()
    with pytest.raises(ValueError):
        sinks.import_personal(spark, "[1]")


def test_stream(spark, tmp_path):
    from test_catalog import snap
    from tidemark.schema import PROBLEM
    from tidemark.streaming import snapshots

    def arrive(n, rows, checkpoint):
        src = str(tmp_path / f"in-{checkpoint}")
        snap(spark, *rows).coalesce(1).write.mode("append").parquet(src)
        snapshots.follow(spark.readStream.schema(PROBLEM).parquet(src), root, str(tmp_path / checkpoint), lambda _: f"2024-01-0{n}").awaitTermination(120)

    root = str(tmp_path / "out")
    changes = lambda: sorted((r["batch"], r["kind"], r["id"]) for r in spark.read.parquet(f"{root}/changes").collect())
    arrive(1, [{"id": "a"}, {"id": "b"}], "ck")
    arrive(2, [{"id": "a", "title": "z"}], "ck")
    assert changes() == [(0, "added", "a"), (0, "added", "b"), (1, "removed", "b"), (1, "retitled", "a")]
    # the last batch is replayed: its offset was never committed
    commits = sorted(os.listdir(tmp_path / "ck" / "commits"))
    for name in commits:
        if name.strip(".").startswith("1"):
            os.remove(tmp_path / "ck" / "commits" / name)
    snapshots.follow(spark.readStream.schema(PROBLEM).parquet(str(tmp_path / "in-ck")), root, str(tmp_path / "ck"), lambda _: "2024-01-02").awaitTermination(120)
    assert changes() == [(0, "added", "a"), (0, "added", "b"), (1, "removed", "b"), (1, "retitled", "a")]
    # a new checkpoint on the old root goes on from the newest state
    arrive(3, [{"id": "a", "title": "z"}, {"id": "c"}], "ck2")
    assert changes() == [(0, "added", "a"), (0, "added", "b"), (0, "added", "c"), (1, "removed", "b"), (1, "retitled", "a")]
    newest = snapshots._states(spark, root)[-1]
    assert newest["number"] == 3 and sorted((r["id"], r["state"]) for r in spark.read.parquet(f"{root}/state-{newest['slot']}").collect()) == [("a", "active"), ("b", "removed"), ("c", "active")]
