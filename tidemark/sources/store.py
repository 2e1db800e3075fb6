"""Tables in buckets, of which only those are written that differ.

A table is a folder of data folders and one small document, ``manifest.json``: for each bucket the
folder that holds its rows, how many they are, and what marks them (two xors and a sum of row
hashes). A write compares marks, not rows: the stored rows aren't read, buckets with equal marks stay
as they are, byte for byte. The new manifest takes the old one's place in one move, and that commits
the write; a write that stops before it leaves folders that nobody refers to. What a manifest no
longer refers to is deleted by the commit after the next, so readers of the old state finish.

A bucket's rows go to one task, with those of other small buckets, and one file, sorted; ``spread`` says in how many parts keys are
dealt, so that a bucket holds some ``rows`` rows, and is raised (and all is written anew) when
the table has grown to four times that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

ROWS = 1_000_000


def dealt(key: str, spread: int) -> Column:
    """The part, from 0, of spread ones that a key goes to."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(spread)).cast("string")


def by_key(key: str) -> Callable[[int], Column]:
    return lambda spread: dealt(key, spread)


def by_start(word: str, key: str, letters: int = 2) -> Callable[[int], Column]:
    """Buckets by a word's first letters, each dealt by key: what starts alike is in few files."""
    return lambda spread: F.concat(F.left(F.col(word), F.lit(letters)), F.lit("-"), dealt(key, spread))


def marks(rows: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """bucket, n, x1, x2, total of rows(bucket, ...), whatever their order; columns in ``but`` don't count."""
    columns = [c for c in rows.columns if c not in but and c != "bucket"]
    h = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))
    part = lambda i: F.conv(F.substring(h, i, 15), 16, 10).cast("long")
    x = rows.select("bucket", part(1).alias("h1"), part(17).alias("h2"))
    return x.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum(F.pmod("h1", F.lit(1 << 31))).alias("total"))


@dataclass
class Manifest:
    """number counts the commits; columns are the table's, notes the writer's; buckets: name -> [folder, n, x1, x2, total]; gone: folders that the last commit replaced."""

    number: int = 0
    spread: int = 1
    columns: list[str] = field(default_factory=list)
    notes: dict = field(default_factory=dict)
    buckets: dict[str, list] = field(default_factory=dict)
    gone: list[str] = field(default_factory=list)


@dataclass
class Written:
    """Names of the buckets that a write replaced and dropped; false if nothing was committed."""

    replaced: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    committed: bool = False

    def __bool__(self) -> bool:
        return self.committed


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    text = files.read_text(spark, f"{path}/manifest.json")
    if text is None:
        return None
    try:
        return Manifest(**json.loads(text))
    except (ValueError, TypeError) as e:
        raise files.SourceError(f"{path}/manifest.json can't be read ({e})") from None


def load(spark: SparkSession, path: str, schema: T.StructType, only: Callable[[str], bool] | None = None) -> DataFrame:
    """The table by its schema, empty if there is none; only: which buckets, by name, are opened at all."""
    m = manifest(spark, path)
    folders = [f"{path}/{b[0]}/bucket={name}" for name, b in m.buckets.items() if only is None or only(name)] if m else []
    if not folders:
        return spark.createDataFrame([], schema)
    lacking = [f.name for f in schema if f.name not in m.columns]
    if lacking:
        raise files.SourceError(f"{path} is no such table: it lacks {', '.join(lacking)}")
    return spark.read.schema(schema).parquet(*folders)


#: Rows of small buckets that a task writes.
EACH = 100_000


def _staged(rows: DataFrame, path: str, number: int, buckets: int, n: int, sort: tuple[str, ...]) -> str:
    """n rows(bucket, ...) or so in a new data folder, a file a bucket; a task writes the files of many small buckets, so that tasks go by rows."""
    folder = f"data/{number}-{uuid.uuid4().hex[:8]}"
    rows.repartition(max(1, min(buckets, -(-n // EACH))), "bucket").sortWithinPartitions("bucket", *sort).write.partitionBy("bucket").parquet(f"{path}/{folder}")
    return folder


def _commit(spark: SparkSession, path: str, old: Manifest | None, new: Manifest) -> None:
    kept = {b[0] for b in new.buckets.values()}
    for folder in old.gone if old else ():
        files.delete(spark, f"{path}/{folder}")
    new.gone = sorted({b[0] for b in old.buckets.values()} - kept) if old else []
    files.write_text(spark, f"{path}/manifest.json", json.dumps(asdict(new)))


@dataclass
class Plan:
    """What :func:`compare` found; false if the table is as it should be. Nothing is written before :meth:`write`."""

    df: DataFrame
    path: str
    bucket: Callable[[int], Column]
    sort: tuple[str, ...]
    old: Manifest | None
    spread: int
    new: dict[str, list]
    differ: list[str]
    dropped: list[str]

    def __bool__(self) -> bool:
        return not self.old or bool(self.differ or self.dropped)

    def write(self, **notes) -> Written:
        if not self and (not notes or self.old.notes | notes == self.old.notes):
            return Written()
        spark, old = self.df.sparkSession, self.old or Manifest()
        out = Manifest(old.number + 1, self.spread, self.df.columns, old.notes | notes, {k: b for k, b in old.buckets.items() if k in self.new})
        if self.differ:
            rows = self.df.withColumn("bucket", self.bucket(self.spread))
            if len(self.differ) < len(self.new):
                rows = rows.filter(F.col("bucket").isin(self.differ))
            folder = _staged(rows, self.path, out.number, len(self.differ), sum(self.new[k][0] for k in self.differ), self.sort)
            out.buckets |= {k: [folder, *self.new[k]] for k in self.differ}
        _commit(spark, self.path, self.old, out)
        return Written(self.differ, self.dropped, True)


def compare(df: DataFrame, path: str, bucket: Callable[[int], Column], but: tuple[str, ...] = (), sort: tuple[str, ...] = (), rows: int = ROWS) -> Plan:
    """How the table at path differs from df, by marks; df is read here and for the write, so it should be a stored one."""
    m = manifest(df.sparkSession, path)
    found = lambda s: {r["bucket"]: [r["n"], r["x1"], r["x2"], r["total"]] for r in marks(df.withColumn("bucket", bucket(s)), but).collect()}  # noqa: E731 (a row a bucket)
    spread = m.spread if m else max(1, -(-df.count() // rows))
    new = found(spread)
    if (n := sum(x[0] for x in new.values())) > 4 * rows * spread:
        spread = -(-n // rows)
        new = found(spread)
    held = {k: b[1:] for k, b in m.buckets.items()} if m and m.spread == spread else {}
    return Plan(df, path, bucket, sort, m, spread, new, sorted(k for k in new if held.get(k) != new[k]), sorted(set(m.buckets if m else ()) - set(new)))


def merge(path: str, gone: DataFrame, come: DataFrame, schema: T.StructType, bucket: Callable[[int], Column], sort: tuple[str, ...] = (), **notes) -> Written:
    """Take the rows of gone out of the table and put those of come in, each once; only their buckets are read and written.

    Doing it again changes nothing. Rows are compared whole, without nulls; the table's rows are distinct.
    """
    spark, names = gone.sparkSession, schema.fieldNames()
    m = manifest(spark, path)
    if m is None:
        raise files.SourceError(f"{path} has no manifest to merge into")
    gone, come = (x.select(*names).distinct().withColumn("bucket", bucket(m.spread)) for x in (gone, come))
    touched = sorted(r[0] for r in gone.select("bucket").union(come.select("bucket")).distinct().collect())  # names of buckets
    out = Manifest(m.number + 1, m.spread, m.columns, m.notes | notes, dict(m.buckets))
    differ = dropped = []
    if touched:
        old = load(spark, path, schema, set(touched).__contains__).withColumn("bucket", bucket(m.spread))
        rows = old.join(gone.select(*names), names, "left_anti").unionByName(come.join(old.select(*names), names, "left_anti"))
        held = sum(m.buckets[k][1] for k in touched if k in m.buckets)
        folder = _staged(rows, path, out.number, len(touched), max(held, come.count()), sort)
        kinds = T.StructType([*schema.fields, T.StructField("bucket", T.StringType())])
        new = {r["bucket"]: [r["n"], r["x1"], r["x2"], r["total"]] for r in marks(spark.read.schema(kinds).parquet(f"{path}/{folder}")).collect()}
        differ = sorted(k for k in new if m.buckets.get(k, [None])[1:] != new[k])
        dropped = sorted(k for k in touched if k in m.buckets and k not in new)
        out.buckets = {k: b for k, b in m.buckets.items() if k not in dropped} | {k: [folder, *new[k]] for k in differ}
        if not differ:
            files.delete(spark, f"{path}/{folder}")
    if not differ and not dropped and out.notes == m.notes:
        return Written()
    _commit(spark, path, m, out)
    return Written(differ, dropped, True)
