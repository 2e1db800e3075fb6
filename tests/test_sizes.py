"""What must not pass through the driver or one task whole, on small tables."""

import hashlib
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from test_catalog import snap
from test_sync import ROWS, write
from tidemark.operators import facets
from tidemark.operators import tables as T
from tidemark.plans import queries as Q
from tidemark.plans.sync import resolve_origins, sync
from tidemark.sources import dataset, files, sinks

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("sort", ["updated", "first_seen", "title", "company"])
def test_deep_pages_are_found_by_their_place(spark, monkeypatch, sort):
    """Ties, missing values and either direction; no task keeps the rows before the page, as a limit of offset and page would."""
    monkeypatch.setattr(facets, "SHALLOW", 20, raising=False)
    rows = snap(spark, *({"id": f"i{i * 37 % 100:02}", "key": f"k{i % 50}", "title": f"t{i % 9}", "companies": [f"C{i % 4}", "x"] if i % 5 else [], "first_seen": f"2024-01-{i % 7 + 10}", "upstream_updated": f"2024-02-{i % 6 + 10}" if i % 8 else None} for i in range(100)))
    rows = rows.repartition(5).withColumn("title", F.when(F.col("title") != "t3", F.col("title")))
    order = [r["id"] for r in rows.orderBy(*facets.sort_keys(sort)).collect()]
    assert len(set(order)) == 100
    for offset in (0, 21, 60, 95, 99, 100, 150):
        got = facets.page(rows, sort, offset, 7)
        assert [r["id"] for r in got.collect()] == order[offset : offset + 7]
        assert f"limit={offset + 7}" not in (plan := got._jdf.queryExecution().executedPlan().toString()) or offset <= 20, plan
    assert facets.place_at(rows, sort, 0) is None is facets.place_at(rows, sort, 101)
    assert facets.place_at(rows, sort, 42).id == order[41]


def tables_of(text):
    """(run, header, divider, numbers of rows) of a text's tables, line by line."""
    out, run = [], []
    for i, line in enumerate([*text.split("\n"), ""]):
        if line.startswith("|"):
            run.append((i, line))
            continue
        at = next((j for j, (_, x) in enumerate(run) if j and re.fullmatch(r"\|[\s:\-|]+\|", x.strip())), None)
        if at is not None:
            out.append((run[0][0], run[at - 1][1].strip(), run[at][0], [n + 1 for n, _ in run[at + 1 :]]))
        run = []
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_tables_are_found_across_chunks(spark, monkeypatch, chunk):
    """A run of lines over many chunks, or that ends with one, is the run that one scan finds."""
    monkeypatch.setattr(T, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = {f"d{i}": "\n".join(rng.choice(["| a | b |", "|---|---|", "x", "| h |", " | no", "|", ""]) for _ in range(rng.randrange(1, 40))) for i in range(40)}
    lines = T.text_lines(spark.createDataFrame(list(texts.items()), "source string, text string")).repartition(7)
    found, rows = T.tables_in(lines)
    numbers = {}
    for r in rows.collect():
        numbers.setdefault((r["source"], r["run"]), []).append(r["line_no"])
    got = sorted((r["source"], r["run"], r["header"], r["header_line_no"], sorted(numbers.get((r["source"], r["run"]), []))) for r in found.collect())
    assert got == sorted((s, *t) for s, text in texts.items() for t in tables_of(text)) and all(r["n_rows"] == len(numbers.get((r["source"], r["run"]), [])) for r in found.collect())


def test_documents_are_read_by_lines_in_blocks(spark, tmp_path):
    """Files and folders of part files, in blocks of few bytes: numbers, marks, digests and missing ends of lines."""
    texts = {"a.md": "\ufeff| x\r\né\n\n" + "".join(f"line {i} {'y' * (i % 50)}\n" for i in range(200)), "b c+%.md": "one\ntwo", "d.md": "p0\np1\np2\n\n"}
    for name in ("a.md", "b c+%.md"):
        (tmp_path / name).write_bytes(texts[name].encode())
    (tmp_path / "d.md").mkdir()
    for name, part in (("part-00001-x.txt", "p1\np2\n\n"), ("part-00000-x.txt", "p0\n"), ("_SUCCESS", "")):
        (tmp_path / "d.md" / name).write_text(part)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        paths = {name: str(tmp_path / name) for name in texts}
        got = {}
        for r in files.numbered_lines(spark, paths).collect():
            got.setdefault(r["source"], {})[r["pos"]] = r["line"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {s: [x[i] for i in range(len(x))] for s, x in got.items()} == {s: t.removesuffix("\n").split("\n") for s, t in texts.items()}
    assert {s: files.digest(spark, p) for s, p in paths.items()} == {s: hashlib.sha256(t.encode()).hexdigest() for s, t in texts.items()}


@needs_tables
def test_documents_of_both_versions_are_made_by_lines(spark):
    """No row, and so no task, holds a whole document."""
    made = Q._versions(spark, SF)
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert made.columns[-1] != "text" and made.filter("doc <> 'assets/company-domains.json'").agg(F.max(F.length(made.columns[-1]))).first()[0] < 400 and made.count() > 3 * n
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_days_document_holds_all_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "DOCUMENT_MOST", 1, raising=False)
    root, docs = str(tmp_path / "data"), str(tmp_path / "docs")
    write(docs, ROWS)
    out = sync(spark, root, docs, "2024-02-01", "version-1")
    doc = json.loads((tmp_path / "data/changes/2024-02-01.json").read_text(encoding="utf-8"))
    assert len(doc["changes"]) == len(ROWS) == doc["counts"]["added"] and [x["key"] for x in doc["changes"]] == sorted(x["key"] for x in doc["changes"]) and doc["ambiguous_relinks"] == []
    assert "changes/latest.json" in out.written and (tmp_path / "data/changes/latest.json").read_text() == (tmp_path / "data/changes/2024-02-01.json").read_text()
    meta = json.loads((tmp_path / "data/meta.json").read_text())
    assert meta["sources"] == {s: hashlib.sha256((tmp_path / "docs" / s.rsplit("/", 1)[-1]).read_bytes()).hexdigest() for s in sorted([*(x.path for x in files.SOURCES), files.VOCABULARY])}


@needs_tables
def test_origins_come_from_a_catalogue_in_files(spark, tmp_path, monkeypatch):
    """A catalogue of many files counts as one; the query's is such a one, and the driver serves none."""
    root, folder = str(tmp_path / "data"), tmp_path / "catalogue"
    dataset.compare_problems(snap(spark, *({"id": f"i{i}", "key": f"k{i}", "title": f"Title {x}", "format": "SQL"} for i, x in enumerate(["One", "Two", "Three"]))), root).write(seen="2024-01-01")
    folder.mkdir()
    for i, x in enumerate(["One", "Two"]):
        entry = {"stat": {"question__title": f"Title {x}", "question__title_slug": x.lower()}, "difficulty": {"level": 1}, "paid_only": i == 0}
        (folder / f"{i}.json").write_text(json.dumps({"stat_status_pairs": [entry]}))
    assert resolve_origins(spark, root, str(folder)) == (2, 1, True)
    monkeypatch.setattr(Q.remote, "served", None)
    monkeypatch.setitem(Q._synced, (spark.sparkContext.applicationId, SF), root)
    assert Q.sync_origins(spark, SF).count() == 0


def test_a_remote_source_and_a_folder_make_the_same(spark, tmp_path):
    """Whole texts, as a remote source gives them, and lines of a folder; no server is needed to tell."""
    docs = str(tmp_path / "docs")
    write(docs, ROWS)

    class Texts(Q.remote.Remote):
        def documents(self, spark, version, *_, **__):
            return spark.createDataFrame([(s, open(p, encoding="utf-8").read()) for s, p in files.documents_at(spark, docs).items()], "source string, text string")

    outs = [sync(spark, str(tmp_path / name), source, "2024-02-01", "version-1") for name, source in (("a", docs), ("b", Texts("")))]
    metas = [files.read_meta(spark, str(tmp_path / name / "meta.json")) for name in "ab"]
    rows = [sorted(map(str, dataset.problems(spark, str(tmp_path / name)).collect())) for name in "ab"]
    assert outs[0] == outs[1] and metas[0]["sources"] == metas[1]["sources"] and len(metas[0]["sources"]) == 7 and rows[0] == rows[1]


def test_small_buckets_share_a_task(spark, tmp_path):
    """Tasks of a write go by its rows, not by its buckets; each bucket still has one file."""
    rows = snap(spark, *({"id": f"i{i}", "key": f"k{i}"} for i in range(60)))
    assert dataset.compare_problems(rows, str(tmp_path), 5).write(seen="2024-01-01").committed
    files_of = {d: [f for f in fs if f.endswith(".parquet")] for d, _, fs in os.walk(tmp_path) if "bucket=" in d}
    assert len(files_of) > 5 and all(len(fs) == 1 for fs in files_of.values()) and len({fs[0].split("-")[1] for fs in files_of.values()}) == 1
    assert dataset.problems(spark, str(tmp_path)).count() == 60
