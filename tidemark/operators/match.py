"""Titles resolved against a reference catalogue: four widening tiers, unique hits only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import titles as X
from ..schema import ELIGIBLE


class OriginError(Exception):
    """The catalogue can't be read; never a reason to write an empty result."""


def entries(catalogue: DataFrame, template: str = "https://leetcode.com/problems/%s/") -> DataFrame:
    """slug, title, paid, difficulty, url of a nested catalogue; rows without slug or title go."""
    pair = catalogue.select(F.explode("stat_status_pairs").alias("x"))
    e = pair.select(F.col("x.stat.question__title_slug").alias("slug"), F.col("x.stat.question__title").alias("title"), F.coalesce("x.paid_only", F.lit(False)).alias("paid"), X.difficulty(F.col("x.difficulty.level")).alias("difficulty"))
    return e.filter("coalesce(slug, '') <> '' AND coalesce(title, '') <> ''").withColumn("url", X.origin_url(F.col("slug"), template))


def catalogue_size(entries_: DataFrame) -> DataFrame:
    return entries_.agg(F.count_if(X.normalize(F.col("title")) != "").alias("size"))


def keys(entries_: DataFrame) -> DataFrame:
    """index, key and entry for keys that one entry alone has; empty keys index nothing."""
    t = F.col("title")
    pairs = F.array(*(F.struct(F.lit(i).alias("index"), k.alias("key")) for i, k in (("title", X.normalize(t)), ("signature", X.signature(t)), ("reduced", X.reduced(t)))))
    rows = entries_.select(F.struct(*entries_.columns).alias("entry"), F.explode(pairs).alias("k")).select("k.*", "entry").filter("key <> ''")
    return rows.groupBy("index", "key").agg(F.count("*").alias("n"), F.first("entry").alias("entry")).filter("n = 1").drop("n")


def matched(titles: DataFrame, entries_: DataFrame, id_: str = "id", title: str = "title") -> DataFrame:
    """id, tier (1 to 4) and entry of titles(id, title) that the first tier with a hit resolves.

    The catalogue's keys are joined as Spark sees fit: broadcast while they are small.
    """
    t = F.col(title)
    probes = F.array(*(F.struct(F.lit(n).alias("tier"), F.lit(i).alias("index"), k.alias("key")) for n, i, k in ((1, "title", X.normalize(t)), (2, "signature", X.signature(t)), (3, "reduced", X.reduced(t)), (4, "reduced", X.reduced(t, True)))))
    asked = titles.select(F.col(id_).alias("id"), F.explode(probes).alias("p")).select("id", "p.*").filter("key <> ''")
    first = Window.partitionBy("id").orderBy("tier")
    return asked.join(keys(entries_), ["index", "key"]).withColumn("place", F.row_number().over(first)).filter("place = 1").select("id", "tier", "entry")


def totals(origins_: DataFrame) -> DataFrame:
    """resolved and paid, as one row."""
    return origins_.agg(F.count("*").alias("resolved"), F.count_if(F.coalesce("paid", F.lit(False))).alias("paid"))


def origins(snapshot: DataFrame, entries_: DataFrame, site: str = "leetcode") -> DataFrame:
    """Origin records of eligible rows, tombstones included."""
    found = matched(snapshot.filter(F.col("format").isin(*ELIGIBLE)), entries_)
    return found.select("id", F.lit(site).alias("site"), "entry.url", "entry.title", "entry.difficulty", "entry.paid")
