"""The daily sync: documents -> snapshot -> diff -> artifacts, with one barrier before the first write.

Parse and merge are lazy up to the guards' counts. Inputs that must be right (previous snapshot,
archive) are checked before it too. What is derived from the previous snapshot is written to the
shared folder before anything of the dataset changes, and the snapshot itself is replaced after
all that follows from it: a sync that stops on the way, for a lost executor or driver, is made
up for by the next one.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import source_digest
from ..operators import guards, match, normalize, snapshot, tables, vocab
from ..sources import dataset, files, remote, sinks

#: Warnings of a kind that the metadata lists.
MOST_WARNINGS = 1000


class UnknownSchema(Exception):
    """A document has no table with a known header."""


@dataclass
class Outcome:
    version: str
    skipped: bool = False
    changed: bool = False
    written: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)


@dataclass
class Dataset:
    current: DataFrame
    rows: DataFrame
    issues: DataFrame
    conflicts: DataFrame
    left: DataFrame
    right: DataFrame


def build(spark: SparkSession, lines: DataFrame, today: str, keep=DataFrame.persist, sources=files.SOURCES) -> Dataset:
    """Records of the day and what was odd about them, from the documents' lines(source, pos, line)."""
    meta = files.registry(spark, sources)
    found, rows = tables.tables_in(lines.join(F.broadcast(meta.select("source")), "source"))
    found, headers = keep(found), tables.registry(spark)
    unread = tables.unread_sources(meta, found, headers).collect()  # a row a bad source
    if unread:
        raise UnknownSchema("; ".join(f"{r['source']}: no recognised table header, saw {r['headers']}" for r in unread))
    chosen = tables.question_tables(found, headers)
    raw = keep(tables.raw_rows(rows, chosen, meta))
    main = lines.filter(F.col("source") == sources[0].path).select("source", F.col("pos").alias("line_no"), "line")
    own = lines.filter(F.col("source") == files.VOCABULARY).groupBy("source")  # one JSON text
    own = own.agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"], "\n").alias("text"))
    names = vocab.json_names(own).withColumn("authoritative", F.lit(True))
    names = names.unionByName(vocab.listed_names(main).select("name", "ord", F.lit(False).alias("authoritative")), allowMissingColumns=True)
    good = vocab.split_cells(raw.filter("problem IS NULL"), vocab.vocabulary(names))
    ids = keep(normalize.with_ids(good))
    group = ids.join(F.broadcast(meta.select("source", "group")), "source")
    odd = tables.issues(raw, chosen, meta)
    unknown = ids.select("source", "line_no", F.explode("unknown").alias("name")).groupBy("name").agg(F.min_by("source", "line_no").alias("source"), F.min("line_no").alias("line_no"))
    odd = odd.unionByName(unknown.select("source", "line_no", F.lit("warning").alias("kind"), F.concat(F.lit("company not in vocabulary: '"), "name", F.lit("'")).alias("message")))
    side = lambda g: group.filter(F.col("group") == g).select("id").distinct()
    return Dataset(normalize.merged(ids, today), ids, odd, normalize.conflicts(ids), side("readme"), side("formats"))


def sync(spark: SparkSession, root: str, source: str | remote.Remote, today: str | None = None, version: str | None = None, force: bool = False, changelog: str | None = None, dry_run: bool = False) -> Outcome:
    """Update the dataset under root from a folder of documents or a remote source, pinned to one version.

    Without a version a remote source's newest one is taken; where the dataset has it already, nothing is read.
    """
    version = version or (source.version() if isinstance(source, remote.Remote) else "offline")
    today = today or datetime.datetime.now(datetime.UTC).date().isoformat()
    meta = files.read_meta(spark, f"{root}/meta.json")
    if not force and meta and meta.get("version") == version:
        return Outcome(version, skipped=True)
    made: list[str] = []
    try:
        return _sync(spark, root, source, today, version, changelog, dry_run, made)
    finally:  # after an abort too
        for path in made:
            files.delete(spark, path)


def _warnings(issues: DataFrame, conflicts: DataFrame) -> list[str]:
    """Up to MOST_WARNINGS of each, in order, and how many more there are."""
    out = []
    said = F.concat_ws("", "key", F.lit(": "), "kind", F.lit(" '"), "kept", F.lit("' / '"), "other", F.lit("'"))
    for df, by, what in ((issues, ("source", "line_no"), F.col("message")), (conflicts, ("key", "arrival"), said)):
        found = [r[0] for r in df.orderBy(*by).select(what).limit(MOST_WARNINGS + 1).collect()]
        out += found[:MOST_WARNINGS]
        if len(found) > MOST_WARNINGS:
            out.append(f"and {df.count() - MOST_WARNINGS} more")
    return out


def _sync(spark, root: str, source, today: str, version: str, changelog: str | None, dry_run: bool, made: list[str]) -> Outcome:
    # what several steps read is a table of the shared folder: it's read once, and no lost executor makes it another
    docs = source.documents(spark, version, made=made) if isinstance(source, remote.Remote) else None
    lines = files.read_documents(spark, source, made=made) if docs is None else tables.text_lines(docs)
    digests = {s: files.digest(spark, p) for s, p in sorted(files.documents_at(spark, source).items())} if docs is None else {r["source"]: r["d"] for r in docs.select("source", source_digest(F.col("text")).alias("d")).orderBy("source").collect()}
    data = build(spark, lines, today, lambda df: files.kept(df, "rows", made))
    seen = guards.counts()
    current = files.kept(data.current, "current", made, seen)
    previous, next_ = dataset.problems(spark, root), dataset.number(spark, root) + 1
    warnings = guards.decide(dataset.live(spark, root), seen, current, data.left, data.right)
    warnings += _warnings(data.issues, data.conflicts)

    # the previous snapshot is about to be replaced: what is derived from it is written first
    d = snapshot.diff(previous, current, today)
    sizes = {"live": F.count_if(F.col("state") != "removed"), "total": F.count("*")}
    d = snapshot.Diff(files.kept(d.snapshot, "diff", made, sizes), *(files.kept(df, "diff", made) for df in (d.changes, d.ambiguous, d.archived)))
    live, total = sizes["live"], sizes["total"]
    out = Outcome(version, warnings=warnings, counts={r["kind"]: r["n"] for r in d.counts().collect()})
    if dry_run:
        return out

    def record(name: str, written: bool, counts: bool = True) -> None:
        if written:
            out.written.append(name)
            out.changed |= counts

    plan = dataset.compare_problems(d.snapshot, root)
    record("archive", dataset.append_archive(d.archived, root, today, next_))
    if any(out.counts.values()) or not d.ambiguous.isEmpty():
        record(f"changes/date={today}", sinks.write_table(d.changes, f"{root}/changes/date={today}", sort=snapshot.change_order()))
        record("changes/latest", sinks.write_table(d.changes, f"{root}/changes/latest", sort=snapshot.change_order()))
        record(f"ambiguous/date={today}", sinks.write_table(d.ambiguous, f"{root}/ambiguous/date={today}", sort=[F.col("title"), F.col("group"), F.col("side"), F.col("id")]))
        text = files.kept(sinks.change_document(d.changes, d.ambiguous, today, out.counts, made), "document", made)
        for name in (today, "latest"):
            record(f"changes/{name}.json", sinks.write_document(text, f"{root}/changes/{name}.json"))
        log = sinks.changelog_lines(d.changes, d.ambiguous, d.snapshot, today)
        record("changelog", sinks.update_changelog(spark, changelog or f"{root}/CHANGELOG.md", today, log))
    # the index names the snapshot that it's of: the next one, if there is to be one
    posted, prefixed = dataset.update_index(spark, root, previous, d.snapshot, d.changes, next_ if plan else next_ - 1)
    record("postings", bool(posted.replaced or posted.dropped))
    record("prefixes", bool(prefixed.replaced or prefixed.dropped))
    record("problems", bool(plan) and bool(plan.write(seen=today, live=live)))
    now = datetime.datetime.now(datetime.UTC).replace(microsecond=0).isoformat()
    doc = {"version": version, "synced_at": now, "sources": digests, "counts": {"live": live, "tombstoned": total - live, "total": total, **out.counts}, "warnings": warnings}
    record("meta.json", files.write_text(spark, f"{root}/meta.json", sinks.compact(doc)), counts=False)
    return out


def resolve_origins(spark: SparkSession, root: str, catalogue: str) -> tuple[int, int, bool]:
    """Match the stored snapshot against a catalogue; how many rows have an origin, how many of these are paid, and if that's new."""
    rows = dataset.problems(spark, root)
    if rows.isEmpty():
        raise match.OriginError(f"{root} holds no snapshot")
    made: list[str] = []
    try:
        found = files.kept(match.origins(rows, match.entries(files.read_catalogue(spark, catalogue))), "origins", made)
        n, paid = match.totals(found).first()
        return n, paid, sinks.write_table(found, f"{root}/origins", sort=[F.col("id")])
    finally:
        for path in made:
            files.delete(spark, path)
