"""Names of companies: one spelling of each, and cells split by the longest known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import SENTINELS

SEPARATOR = r"(?U)\s+/\s+"
MARKER = "(?i)Full company list"


def listed_names(lines: DataFrame) -> DataFrame:
    """name, ord of the first comma list within seven lines after a marker, per source.

    lines(source, line_no, line); a marker without such a list is passed over.
    """
    marks = lines.filter(F.rlike("line", F.lit(MARKER))).select("source", F.col("line_no").alias("mark"))
    many = lines.withColumn("line", X.trimmed(F.col("line"))).filter(F.regexp_count("line", F.lit(",")) >= 10)
    first = Window.partitionBy("source").orderBy("mark", "line_no")
    pairs = marks.join(many, "source").filter("line_no BETWEEN mark + 1 AND mark + 7").withColumn("place", F.row_number().over(first)).filter("place = 1")
    names = pairs.select("source", F.posexplode(F.split(F.regexp_replace("line", r"\.+$", ""), ",")).alias("ord", "name"))
    return names.withColumn("name", X.trimmed(F.col("name"))).filter("name <> ''")


def json_names(documents: DataFrame) -> DataFrame:
    """name, ord of the keys of each JSON text, none where the text is no JSON object."""
    return documents.select(F.posexplode(F.json_object_keys("text")).alias("ord", "name"))


def vocabulary(names: DataFrame) -> DataFrame:
    """norm, display, n_parts of names(name, ord, authoritative).

    Of the last authoritative spelling and all others, that with most upper-case letters, then
    the smallest, is shown.
    """
    n = names.withColumn("name", X.collapsed(F.col("name"))).filter("name <> ''").withColumn("norm", X.normed(F.col("name")))
    best = F.struct((-F.length(F.regexp_replace("name", r"[^\p{Lu}]", ""))).alias("upper"), F.col("name").alias("name"))
    agg = n.groupBy("norm").agg(
        F.min(F.when(~F.col("authoritative"), best)).alias("other"),
        F.max_by(F.when(F.col("authoritative"), best), F.when(F.col("authoritative"), F.col("ord"))).alias("own"),
        F.max(F.size(F.split("name", SEPARATOR))).alias("n_parts"),
    )
    return agg.select("norm", F.least("own", "other")["name"].alias("display"), "n_parts")


def split_with(cell: Column, known: Column, longest: Column) -> Column:
    """struct(companies, unknown) of a cell, by a map known(norm -> display).

    A left fold over the parts: at each place that no longer name has taken, the longest run of
    up to ``longest`` parts that is known, else the part itself, unless it stands for no company.
    """
    parts = F.split(X.collapsed(cell), SEPARATOR)
    n = F.size(parts)
    none = F.array().cast("array<string>")
    run = lambda i, k: F.array_join(F.slice(parts, i + 1, k), " / ")

    def step(acc: Column, i: Column) -> Column:
        lengths = F.sequence(F.least(longest, n - i), F.lit(1), F.lit(-1))
        hit = F.get(F.filter(lengths, lambda k: F.map_contains_key(known, X.normed(run(i, k)))), F.lit(0))
        part = F.get(parts, i)
        taken = F.struct((i + hit).alias("i"), F.array_append(acc["out"], F.element_at(known, X.normed(run(i, hit)))).alias("out"), acc["unknown"].alias("unknown"))
        skipped = F.struct((i + 1).alias("i"), acc["out"].alias("out"), acc["unknown"].alias("unknown"))
        kept = F.struct((i + 1).alias("i"), F.array_append(acc["out"], part).alias("out"), F.array_append(acc["unknown"], part).alias("unknown"))
        return F.when(i < acc["i"], acc).when(hit.isNotNull(), taken).when(X.normed(part).isin(*SENTINELS), skipped).otherwise(kept)

    start = F.struct(F.lit(0).alias("i"), none.alias("out"), none.alias("unknown"))
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda a: F.struct(a["out"].alias("companies"), a["unknown"].alias("unknown")))
    empty = X.normed(cell).isin("", *SENTINELS)
    return F.when(empty, F.struct(none.alias("companies"), none.alias("unknown"))).otherwise(folded)


def split_cells(rows: DataFrame, vocab: DataFrame, cell: str = "company_cell") -> DataFrame:
    """rows with companies and unknown.

    Each distinct cell is split once, by the names that its own runs of parts match: these come by a
    join on the name's hash, so a vocabulary of any size costs a lookup a run. Spark looks a key of a
    map up from one end to the other, so a cell's map holds its own matches only.
    """
    longest = vocab.agg(F.coalesce(F.max("n_parts"), F.lit(1))).first()[0]
    cells = rows.select(cell).filter(F.col(cell).isNotNull()).distinct()
    parts = F.split(X.collapsed(F.col(cell)), SEPARATOR)
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(parts) - i)), lambda k: X.normed(F.array_join(F.slice(parts, i + 1, k), " / ")))))
    found = cells.select(cell, F.explode(F.array_distinct(runs)).alias("norm")).join(vocab.select("norm", "display"), "norm")
    known = found.groupBy(cell).agg(F.map_from_entries(F.collect_list(F.struct("norm", "display"))).alias("_known"))  # as many as a cell has runs
    empty = F.create_map().cast("map<string,string>")
    split = cells.join(known, cell, "left").withColumn("_split", split_with(F.col(cell), F.coalesce("_known", empty), F.lit(longest)))
    none = F.array().cast("array<string>")
    return rows.join(split.select(cell, "_split"), cell, "left").withColumns({"companies": F.coalesce("_split.companies", none), "unknown": F.coalesce("_split.unknown", none)}).drop("_split")
