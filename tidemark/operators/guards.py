"""Plausibility guards: one job counts, then plain Python decides, before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DIVERGENCE_FLOOR, DIVERGENCE_FRACTION, ROW_DROP_LIMIT


class Abort(Exception):
    """Today's snapshot is too implausible to be written."""


def check_row_count(previous: int, current: int) -> list[str]:
    if current == 0:
        raise Abort("parsed 0 rows; an empty catalog is a failure, never a result")
    drop = previous - current
    if previous and drop > 0 and drop / previous > ROW_DROP_LIMIT:
        raise Abort(f"rows fell from {previous} to {current} ({drop / previous:.1%}), above the limit of {ROW_DROP_LIMIT:.0%}")
    return []


def check_divergence(only_left: int, only_right: int, left: int, right: int) -> list[str]:
    n = only_left + only_right
    if not n:
        return []
    limit = max(DIVERGENCE_FLOOR, int(max(left, right) * DIVERGENCE_FRACTION))
    said = f"{n} rows diverge ({only_left} in the first group only, {only_right} in the second only)"
    if n > limit:
        raise Abort(f"{said}, above the limit of {limit}")
    return [f"{said}; below the limit of {limit}"]


def check_unclassified(count: int, sample: list[str]) -> list[str]:
    if count:
        raise Abort(f"{count} live rows have no format (e.g. {', '.join(sample)})")
    return []


def divergence(left: DataFrame, right: DataFrame) -> DataFrame:
    """n_left, n_right, only_left, only_right over two frames of ids, in one pass."""
    both = left.select("id", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("id", F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return both.agg(*(F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in (("n_left", F.col("l")), ("n_right", F.col("r")), ("only_left", F.col("l") * (1 - F.col("r"))), ("only_right", F.col("r") * (1 - F.col("l"))))))


def metrics(previous: DataFrame, current: DataFrame) -> DataFrame:
    """previous_live, current_rows, unclassified and up to five unclassified ids, as one row."""
    empty = is_unclassified()
    ids = F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.col("id"))))
    bad = current.filter(empty).select("id").orderBy("id").limit(5).withColumn("place", F.lit(1)).agg(ids.alias("sample"))
    counts = previous.select(F.lit("p").alias("side"), "state", "format").unionByName(current.select(F.lit("c").alias("side"), "state", "format")).agg(
        F.count_if((F.col("side") == "p") & (F.col("state") != "removed")).alias("previous_live"), F.count_if(F.col("side") == "c").alias("current_rows"), F.count_if((F.col("side") == "c") & empty).alias("unclassified")
    )
    return counts.crossJoin(bad)  # one row by one row


def is_unclassified() -> Column:
    """Whether a live row has no format."""
    return (F.col("state") != "removed") & (F.coalesce("format", F.lit("")) == "")


def counts() -> dict[str, Column]:
    """What is to be observed while the current snapshot is written: rows, unclassified."""
    return {"rows": F.count("*"), "unclassified": F.count_if(is_unclassified())}


def decide(previous_live: int, seen: dict[str, int], current: DataFrame, left: DataFrame, right: DataFrame) -> list[str]:
    """As :func:`check`, from counts that were observed; current is read only if it's to be refused for its rows."""
    d = divergence(left, right).first()
    out = check_row_count(previous_live, seen["rows"])
    out += check_divergence(d["only_left"], d["only_right"], d["n_left"], d["n_right"])
    sample = [r["id"] for r in current.filter(is_unclassified()).select("id").orderBy("id").limit(5).collect()] if seen["unclassified"] else []
    return out + check_unclassified(seen["unclassified"], sample)


def check(previous: DataFrame, current: DataFrame, left: DataFrame, right: DataFrame) -> list[str]:
    """Raise Abort or return warnings; left and right are the ids of the two source groups."""
    m, d = metrics(previous, current).first(), divergence(left, right).first()
    out = check_row_count(m["previous_live"], m["current_rows"])
    out += check_divergence(d["only_left"], d["only_right"], d["n_left"], d["n_right"])
    return out + check_unclassified(m["unclassified"], m["sample"])
