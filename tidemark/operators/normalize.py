"""Raw rows -> one record for each id, by a grouped form of the newest-wins merge.

Arrival order is (source_ord, line_no). A row that is strictly newer than all before it takes
over the record's fields; otherwise the first stays. So with the strict prefix maxima latest
first and the other rows in order behind them, fields come from the first row, the format from
the first that has one, companies and sources in order of appearance.

Nothing of that needs an id's rows together. The first row is that of the greatest date, the
earliest of them. A row leads if it's the first of its date and no greater date came before it, so
the dates' first arrivals tell all leaders; of a company, source or format only the first arrival
on each date counts. Rows are reduced to these before any shuffle by id, and an id that a third of
all rows share leaves as many values as it has, not as many as it has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def with_ids(rows: DataFrame) -> DataFrame:
    """rows(title, url, companies) with key and id."""
    key = F.coalesce(F.nullif(X.derive_key(F.col("url")), F.lit("")), X.fallback_key(F.coalesce("title", F.lit("")), F.col("companies")))
    return rows.withColumn("key", key).withColumn("id", X.derive_id(F.col("key")))


def _placed(rows: DataFrame) -> DataFrame:
    before = Window.partitionBy("id").orderBy("source_ord", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("id").orderBy("source_ord", "line_no")
    date = F.coalesce("updated", F.lit(""))
    seen = F.max(date).over(before)
    return rows.withColumns({"arrival": F.row_number().over(order), "leads": seen.isNull() | (date > seen)})


def _ranked_values(rows: DataFrame) -> DataFrame:
    """id, kind ("company", "source" or "format"), value, rank: the least place of each value in the order that values are taken in."""
    arrival = F.struct(F.col("source_ord").cast("long").alias("s"), F.col("line_no").cast("long").alias("l"))
    value = lambda kind, v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.cast("int").alias("i"))
    own = F.concat(
        F.array(value("source", F.col("source"), F.lit(0))),
        F.filter(F.array(value("format", F.col("format"), F.lit(0))), lambda x: F.coalesce(x["value"], F.lit("")) != ""),
        F.coalesce(F.transform("companies", lambda c, i: value("company", c, i)), F.array().cast("array<struct<kind:string,value:string,i:int>>")),
    )
    each = rows.select("id", F.coalesce("updated", F.lit("")).alias("date"), arrival.alias("at"), F.explode(own).alias("v"))
    firsts = each.groupBy("id", "date", "v.kind", "v.value").agg(F.min(F.struct("at", "v.i")).alias("first"))
    # every row has a source, so sources tell a date's first arrival
    of_date = F.min(F.when(F.col("kind") == "source", F.col("first.at"))).over(Window.partitionBy("id", "date"))
    ahead = F.min("came").over(Window.partitionBy("id").orderBy(F.desc("date")))  # of this date and later ones
    firsts = firsts.withColumn("came", of_date).withColumn("leads", (F.col("came") == ahead) & (F.col("first.at") == F.col("came")))
    sign = F.when(F.col("leads"), -1).otherwise(1)
    rank = F.struct((~F.col("leads")).alias("late"), (sign * F.col("first.at.s")).alias("s"), (sign * F.col("first.at.l")).alias("l"), F.col("first.i").alias("i"))
    return firsts.groupBy("id", "kind", "value").agg(F.min(rank).alias("rank"))


def merged(rows: DataFrame, today: str) -> DataFrame:
    """Records of rows(id, key, title, url, companies, format, updated, source, source_ord, line_no)."""
    fields = F.struct("key", F.coalesce("title", F.lit("")).alias("title"), "url", F.col("updated").alias("upstream_updated"))
    newest = F.struct(F.coalesce("updated", F.lit("")), -F.col("source_ord").cast("long"), -F.col("line_no").cast("long"))
    heads = rows.groupBy("id").agg(F.max_by(fields, newest).alias("f"), (F.count("*") - 1).cast("int").alias("merged_rows"))
    of = lambda kind: F.when(F.col("kind") == kind, F.struct("rank", "value"))
    in_order = lambda kind: F.array_sort(F.collect_list(of(kind)))["value"]  # noqa: E731 (distinct values)
    lists = _ranked_values(rows).groupBy("id").agg(in_order("company").alias("companies"), F.min(of("format"))["value"].alias("format"), in_order("source").alias("sources"))
    return heads.join(lists, "id").select(
        "id", "f.key", "f.title", "f.url", "companies", "format", "f.upstream_updated",
        F.lit(today).alias("first_seen"), F.lit(today).alias("last_seen"), F.lit("active").alias("state"),
        F.lit(None).cast("string").alias("removed_on"), F.array().cast("array<string>").alias("aliases"), "sources", "merged_rows",
    )


def merged_rows(rows: DataFrame) -> DataFrame:
    """source, merged_rows: how many of a source's rows came after another of their id."""
    return _placed(rows).groupBy("source").agg(F.count_if(F.col("arrival") > 1).alias("merged_rows"))


def conflicts(rows: DataFrame) -> DataFrame:
    """key, kind, kept, other, arrival: rows at odds with the record as it was when they came.

    A message is reported once, at its first place.
    """
    before = Window.partitionBy("id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    p = _placed(rows)
    lead = F.last(F.when(F.col("leads"), F.struct("title", "format")), ignorenulls=True).over(before)
    first_format = F.first(F.when(F.coalesce("format", F.lit("")) != "", F.col("format")), ignorenulls=True).over(before)
    lead_format = F.last(F.when(F.col("leads") & (F.coalesce("format", F.lit("")) != ""), F.col("format")), ignorenulls=True).over(before)
    p = p.withColumns({"kept": lead, "filled": F.coalesce(lead_format, first_format)}).filter("arrival > 1")
    kept_format = F.col("filled")
    titles = p.filter("kept.title <> title").select("key", F.lit("title").alias("kind"), F.col("kept.title").alias("kept"), F.col("title").alias("other"), "arrival")
    formats = p.filter((F.col("kept.title") == F.col("title")) & (F.coalesce("format", F.lit("")) != "") & (kept_format != F.col("format")))
    formats = formats.select("key", F.lit("format").alias("kind"), kept_format.alias("kept"), F.col("format").alias("other"), "arrival")
    return titles.unionByName(formats).groupBy("key", "kind", "kept", "other").agg(F.min("arrival").alias("arrival"))
