"""The stored dataset: snapshot, archive and search index of one root, kept up by what moved.

The snapshot's manifest counts its commits, and that number orders everything else: an archive
folder or an index state names the snapshot that it belongs to. What was written for a snapshot that
never came, because its sync stopped, is told by its number: such an archive folder isn't
read and is deleted by the next sync, such an index is compared with the snapshot as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import search
from ..schema import POSTING, PREFIX, PROBLEM
from . import files, store

#: Columns that don't make a row differ.
VOLATILE = ("last_seen",)
_ORDER = ("key", "id")
_POSTINGS, _PREFIXES = store.by_start("token", "id"), store.by_start("prefix", "token")
_DAY = T.StructType([*(f for f in PROBLEM if f.name != "removed_on"), T.StructField("removed_on", T.StringType()), T.StructField("sync", T.IntegerType())])


def number(spark: SparkSession, root: str) -> int:
    """How often the snapshot was committed."""
    m = store.manifest(spark, f"{root}/problems")
    return m.number if m else 0


def problems(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot. All live rows were last seen by the sync that committed it: the manifest has its day, once for all of them."""
    m = store.manifest(spark, f"{root}/problems")
    rows = store.load(spark, f"{root}/problems", PROBLEM)
    seen = (m.notes if m else {}).get("seen")
    return rows if seen is None else rows.withColumn("last_seen", F.when(F.col("state") == "removed", F.col("last_seen")).otherwise(F.lit(seen)))


def live(spark: SparkSession, root: str) -> int:
    """How many live rows the snapshot has, as its commit noted."""
    m = store.manifest(spark, f"{root}/problems")
    return m.notes.get("live", 0) if m else 0


def changes(spark: SparkSession, root: str) -> DataFrame:
    """The changes of all days, with their date as text."""
    from ..schema import CHANGE

    days = [d for d in files.versions(spark, f"{root}/changes") if d.startswith("date=")]
    kind = T.StructType([*CHANGE.fields, T.StructField("date", T.StringType())])
    if not days:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("basePath", f"{root}/changes").parquet(*(f"{root}/changes/{d}" for d in days))


def compare_problems(rows: DataFrame, root: str, size: int = store.ROWS) -> store.Plan:
    return store.compare(rows, f"{root}/problems", store.by_key("id"), VOLATILE, _ORDER, size)


# archive ----------------------------------------------------------------------------------


def _days(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """removed_on and sync of each folder of the archive."""
    value = lambda name: name.split("=", 1)[1]
    days = [d for d in files.versions(spark, f"{root}/archive") if d.startswith("removed_on=")]
    return [(value(d), int(value(s))) for d in days for s in files.versions(spark, f"{root}/archive/{d}") if s.startswith("sync=") and "." not in s]


def archive(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """Removed rows of all days, those of syncs up to the snapshot's number."""
    if not _days(spark, root):
        return spark.createDataFrame([], PROBLEM)
    rows = spark.read.schema(_DAY).option("basePath", f"{root}/archive").parquet(f"{root}/archive")
    return rows.filter(F.col("sync") <= (number(spark, root) if upto is None else upto)).select(*PROBLEM.fieldNames())


def append_archive(additions: DataFrame, root: str, today: str, sync: int) -> bool:
    """Add the rows removed today, unless this day has their ids already; older days' files are neither read nor touched.

    sync is the number of the snapshot that follows. Folders of this number or a higher one are
    leftovers of a sync that stopped before its snapshot; their rows come again, on whatever day.
    """
    spark = additions.sparkSession
    for day, n in _days(spark, root):
        if n >= sync:
            files.delete(spark, f"{root}/archive/removed_on={day}/sync={n}")
    there = archive(spark, root, sync - 1).filter(F.col("removed_on") == today).select("id")
    new = additions.filter(F.col("removed_on") == today).dropDuplicates(["id"]).join(there, "id", "left_anti")
    staged = f"{root}/archive.staged-{uuid.uuid4().hex}"
    new.drop("removed_on").orderBy(*_ORDER).write.parquet(staged)
    if spark.read.schema(_DAY).parquet(staged).isEmpty():
        files.delete(spark, staged)
        return False
    files.swap(spark, staged, f"{root}/archive/removed_on={today}/sync={sync}")
    return True


# index ------------------------------------------------------------------------------------


def _starting(tokens: list[str], last: str | None = None) -> Callable[[str], bool]:
    """Which buckets of a by_start table can hold the tokens, or words that start with last."""
    starts = {t[:2] for t in tokens}

    def only(bucket: str) -> bool:
        start = bucket.rsplit("-", 1)[0]
        return start in starts or last is not None and start.startswith(last[:2])

    return only


def postings(spark: SparkSession, root: str) -> DataFrame:
    return store.load(spark, f"{root}/postings", POSTING)


def postings_for(spark: SparkSession, root: str, query: str) -> DataFrame:
    """The postings that a query can need: only the files of words that start as its terms do are opened."""
    asked = search.terms(query)
    return store.load(spark, f"{root}/postings", POSTING, _starting(asked[:-1], asked[-1]) if asked else (lambda _: False))


def prefixes(spark: SparkSession, root: str, start: str | None = None) -> DataFrame:
    return store.load(spark, f"{root}/prefixes", PREFIX, None if start is None else _starting([start]))


def update_index(spark: SparkSession, root: str, previous: DataFrame, snapshot: DataFrame, changes: DataFrame, sync: int, size: int = store.ROWS) -> tuple[store.Written, store.Written]:
    """Bring postings and prefixes from the previous snapshot to the next one, by the rows that changed.

    Postings that changed rows had and have not, or have and had not, are merged into the buckets
    of their words; of prefixes, those of words that came or went. An index of another snapshot than
    the previous one is compared as a whole instead, and what differs is written.
    """
    paths = f"{root}/postings", f"{root}/prefixes"
    held = [store.manifest(spark, p) for p in paths]
    if not all(m and m.notes.get("of") == number(spark, root) for m in held):
        posted = search.postings(snapshot)
        a = store.compare(posted, paths[0], _POSTINGS, sort=("token", "id"), rows=size).write(of=sync)
        return a, store.compare(search.prefixes(posted), paths[1], _PREFIXES, sort=("prefix", "token"), rows=size).write(of=sync)
    ids = changes.select("id").unionByName(changes.select(F.col("previous_id").alias("id"))).filter("id IS NOT NULL").distinct()
    had, has = (search.postings(rows.join(ids, "id", "left_semi")) for rows in (previous, snapshot))
    gone, come = files.kept(had.exceptAll(has), "index-gone"), files.kept(has.exceptAll(had), "index-come")
    a = store.merge(paths[0], gone, come, POSTING, _POSTINGS, ("token", "id"), of=sync)
    words = gone.select("token").union(come.select("token")).distinct()
    starts = [r[0] for r in words.select(F.left("token", F.lit(2))).distinct().collect()]  # of two letters
    there = store.load(spark, paths[0], POSTING, _starting(starts)).select("token").distinct()
    lost, found = words.join(there, "token", "left_anti"), words.join(there, "token", "left_semi")
    b = store.merge(paths[1], search.prefixes(lost), search.prefixes(found), PREFIX, _PREFIXES, ("prefix", "token"), of=sync)
    return a, b


# bundle -----------------------------------------------------------------------------------


def bundle(spark: SparkSession, root: str) -> files.Bundle:
    """What a reader starts from: snapshot and postings must be there, the rest degrades to empty."""
    from ..schema import CHANGE, ORIGIN

    for name in ("problems", "postings"):
        if store.manifest(spark, f"{root}/{name}") is None:
            raise files.SourceError(f"{root} holds no {name}")

    def optional(name: str, schema: T.StructType) -> DataFrame:
        try:
            return files.table_or_empty(spark, f"{root}/{name}", schema)
        except Exception:  # whatever ails an optional artifact, the rest is of use without it
            return spark.createDataFrame([], schema)

    return files.Bundle(problems(spark, root), postings(spark, root), optional("changes/latest", CHANGE), optional("origins", ORIGIN), files.read_meta(spark, f"{root}/meta.json"))
