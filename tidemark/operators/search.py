"""Inverted and prefix indexes over titles and companies, and AND queries on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import MIN_PREFIX

#: Ids in a list of a token's part.
LIST = 100_000


def postings(rows: DataFrame, *texts: Column) -> DataFrame:
    """token, id: each once, of rows with an id each. texts default to title and companies."""
    parts = texts or (F.col("title"), F.array_join("companies", " "))
    return rows.select("id", F.explode(F.array_distinct(X.tokenize(F.concat_ws(" ", *parts)))).alias("token"))


def token_index(posted: DataFrame) -> DataFrame:
    """token -> sorted ids, the shape that small catalogs are handed out in; queries read postings, larger ones take the parts."""
    return posted.groupBy("token").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def token_index_parts(posted: DataFrame, most: int = LIST) -> DataFrame:
    """token, part -> sorted ids, in lists of about ``most`` ids.

    A token's ids are dealt by their hash over a power of two parts, so that two tokens' lists are
    intersected part by part: the parts of the shorter list are unions of the longer one's.
    """
    sizes = posted.groupBy("token").agg(F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / most)))).cast("long").alias("parts"))
    part = F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.col("parts"))
    return posted.join(sizes, "token").groupBy("token", part.alias("part")).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def prefixes(posted: DataFrame, shortest: int = MIN_PREFIX) -> DataFrame:
    """prefix, token for the proper prefixes of at least ``shortest`` letters."""
    tokens = posted.select("token").distinct().filter(F.length("token") > shortest)
    return tokens.select(F.explode(F.transform(F.sequence(F.lit(shortest), F.length("token") - 1), lambda n: F.left(F.col("token"), n))).alias("prefix"), "token")


def prefix_index(posted: DataFrame, shortest: int = MIN_PREFIX) -> DataFrame:
    return prefixes(posted, shortest).groupBy("prefix").agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def terms(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def search(posted: DataFrame, query: str) -> DataFrame | None:
    """id of rows that have all terms; None for a query without terms, which asks for nothing.

    The last term is a live prefix; one of less than MIN_PREFIX letters that is a token itself
    stands for that token only. Filters reach the scan of postings; one shuffle counts terms.
    """
    asked = terms(query)
    if not asked:
        return None
    *whole, last = asked
    whole = sorted(set(whole))
    token = F.col("token")
    is_last = token.startswith(last)
    if len(last) < MIN_PREFIX and not posted.filter(token == last).limit(1).isEmpty():
        is_last = token == last
    hit = F.array_compact(F.array(*(F.when(token == t, F.lit(i)) for i, t in enumerate(whole)), F.when(is_last, F.lit(len(whole)))))
    want = token.isin(*whole) | is_last if whole else is_last
    found = posted.filter(want).select("id", F.explode(hit).alias("term")).groupBy("id").agg(F.countDistinct("term").alias("n"))
    return found.filter(F.col("n") == len(whole) + 1).select("id")
