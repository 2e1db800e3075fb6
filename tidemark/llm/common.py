"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* an operator first selects the columns it needs under internal names, so extra
  columns of the input, whatever they are called, can't clash with its own;
* a null text is an empty text; empty tables give empty results of the same schema;
* nothing is cached on one machine: lineage is cut by Parquet tables in the shared
  folder that ``spark.checkpoint.dir`` names (:func:`materialise`), and are deleted when the
  application ends, or before, at the end of a :func:`scratch` block.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one is set only where none is configured (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found


_scratch: list[list[str]] = []


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table of the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: any executor may be lost."""
    out, path = written(df, name)
    if _scratch:
        _scratch[-1].append(path)
    return out


def at_exit(spark: SparkSession, path: str) -> None:
    """The table is deleted when the application ends, if nothing did before."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside are deleted at the end, when their result has been written."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop(spark, path)


def prefixed(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Select columns under internal names; a column that's missing is null of its type.

    wanted maps an internal name to ``"column type"``.
    """
    have = set(df.columns)
    out = []
    for alias, spec in wanted.items():
        name, kind = spec.split(" ")
        out.append((F.col(f"`{name}`") if name in have else F.lit(None)).cast(kind).alias(alias))
    return df.select(*out)
