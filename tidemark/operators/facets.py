"""Faceted filters, sorts, counts and the personal overlay."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import PERSONAL, STATUSES
from ..sources import files
from . import search as S

OVERLAY = ("status", "difficulty", "notes", "solution_url", "tags")


@dataclass
class FacetQuery:
    query: str = ""
    formats: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    age: int | None = None
    untouched_only: bool = False
    show_removed: bool = False
    solvable_only: bool = False
    sort: str = "updated"


def with_overlay(rows: DataFrame, personal: DataFrame) -> DataFrame:
    """rows with the entry of each id; personal's columns are null where there is none."""
    return rows.join(personal.select("id", *OVERLAY), "id", "left")


def is_touched() -> Column:
    return X.touched(*(F.col(c) for c in OVERLAY))


def predicate(f: FacetQuery, today: str) -> Column:
    """The row conditions on columns of with_overlay; OR within a facet, AND between them."""
    out = (F.col("state") != "removed") | F.lit(f.show_removed) | is_touched()
    if f.formats:
        out &= F.coalesce(F.col("format").isin(*f.formats), F.lit(False))
    if f.companies:
        out &= F.arrays_overlap("companies", F.array(*map(F.lit, f.companies)))
    if f.statuses:
        out &= F.coalesce(F.col("status").isin(*f.statuses), F.lit(False))
    if f.tags:
        out &= F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, f.tags))), F.lit(False))
    if f.untouched_only:
        out &= ~is_touched()
    if f.age is not None:
        out &= X.days_since(F.col("first_seen"), F.lit(today).cast("date")) < f.age
    return out


def select(rows: DataFrame, personal: DataFrame, f: FacetQuery, today: str, posted: DataFrame | None = None, origins: DataFrame | None = None) -> DataFrame:
    hits = S.search(posted, f.query) if posted is not None else None
    if hits is not None:
        rows = rows.join(hits, "id", "left_semi")
    if f.solvable_only and origins is not None:
        rows = rows.join(origins.select("id"), "id", "left_semi")
    return with_overlay(rows, personal).filter(predicate(f, today))


def _plain_value(sort: str) -> Column:
    return {"updated": F.coalesce("upstream_updated", F.lit("")), "first_seen": F.coalesce("first_seen", F.lit("")), "title": F.col("title"), "company": F.coalesce(F.get("companies", F.lit(0)), F.lit("~"))}[sort]


def _sort_value(sort: str, value: Column | None = None) -> tuple[Column, bool]:
    """What rows are sorted by before (key, id), and whether descending."""
    value, falling = _plain_value(sort) if value is None else value, sort in ("updated", "first_seen")
    return value if falling else F.collate(value, "UNICODE"), falling


def sort_keys(sort: str, value: Column | None = None) -> list[Column]:
    """Orders of the list; ties stay in dataset order, (key, id)."""
    value, falling = _sort_value(sort, value)
    return [value.desc() if falling else value.asc(), F.asc("key"), F.asc("id")]


#: Rows before a page that a task may hold and send.
SHALLOW = 1_000


def page(rows: DataFrame, sort: str, offset: int, limit: int) -> DataFrame:
    """A page by its number of rows before it; a deep one is that behind the place of the last of these."""
    if offset <= SHALLOW:
        return rows.orderBy(*sort_keys(sort)).offset(offset).limit(limit)
    place = place_at(rows, sort, offset)
    return rows.limit(0) if place is None else page_after(rows, sort, place, limit)


@dataclass(frozen=True)
class Place:
    """Where a row stands in a sort order: what a page ends with, and the next one begins after."""

    value: str | None
    key: str
    id: str


def place_of(row, sort: str) -> Place:
    """The place of a row of a page, as collected."""
    value = {"updated": lambda: row["upstream_updated"] or "", "first_seen": lambda: row["first_seen"] or "", "title": lambda: row["title"], "company": lambda: next(iter(row["companies"] or ()), None) or "~"}[sort]()
    return Place(value, row["key"], row["id"])


def place_at(rows: DataFrame, sort: str, number: int) -> Place | None:
    """The place of the row of a number, from 1, or None; rows hold an id once.

    What rows are sorted by is sorted by ranges and counted, whatever the number: one row comes to the driver.
    """
    made: list[str] = []
    try:
        values = rows.select(_plain_value(sort).alias("value"), "key", "id")
        found = files.numbered(values, sort_keys(sort, F.col("value")), "places", made).filter(F.col("place") == number).first()
    finally:
        for path in made:
            files.delete(rows.sparkSession, path)
    return Place(found["value"], found["key"], found["id"]) if found else None


def page_after(rows: DataFrame, sort: str, place: Place | None, limit: int) -> DataFrame:
    """The ``limit`` rows behind a place, the first ones without one.

    Rows at or before the place are filtered where they're read; of the rest each task keeps its
    first ``limit``, however deep the page is.
    """
    if place is not None:
        value, falling = _sort_value(sort)
        at = F.lit(place.value) if falling else F.collate(F.lit(place.value), "UNICODE")
        behind, same = (value.isNotNull(), value.isNull()) if place.value is None else (value < at if falling else value > at, value == at)  # nulls come first
        rows = rows.filter(behind | same & ((F.col("key") > place.key) | (F.col("key") == place.key) & (F.col("id") > place.id)))
    return rows.orderBy(*sort_keys(sort)).limit(limit)


def company_counts(rows: DataFrame) -> DataFrame:
    return rows.filter("state <> 'removed'").select(F.explode("companies").alias("company")).groupBy("company").agg(F.count("*").alias("n"))


def format_counts(rows: DataFrame) -> DataFrame:
    return rows.filter("state <> 'removed' AND coalesce(format, '') <> ''").groupBy("format").agg(F.count("*").alias("n"))


def tag_counts(personal: DataFrame) -> DataFrame:
    return personal.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def shown_companies(counts: DataFrame, needle: str = "", most: int = 40) -> DataFrame:
    """Names that hold the needle, whatever the case; without one the ``most`` frequent."""
    ordered = counts.orderBy(F.desc("n"), "company")
    return ordered.filter(F.contains(F.lower("company"), F.lit(needle.lower()))) if needle.strip() else ordered.limit(most)


def status_counts(personal: DataFrame) -> DataFrame:
    kinds = personal.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return kinds.join(personal.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def progress(rows: DataFrame, personal: DataFrame) -> DataFrame:
    """total, live, removed, touched, solved and the solved share of all rows in whole percent."""
    r = rows.agg(F.count("*").alias("total"), F.count_if(F.col("state") != "removed").alias("live"), F.count_if(F.col("state") == "removed").alias("removed"))
    p = personal.agg(F.count_if(is_touched()).alias("touched"), F.count_if(F.coalesce(F.col("status") == "solved", F.lit(False))).alias("solved"))
    share = F.when(F.col("total") > 0, F.floor(100 * F.col("solved") / F.col("total") + 0.5)).otherwise(0).cast("int")
    return r.crossJoin(p).withColumn("solved_percent", share)  # one row by one row


def solvable_count(rows: DataFrame, origins: DataFrame) -> DataFrame:
    return rows.filter("state <> 'removed'").join(origins.select("id"), "id", "left_semi").agg(F.count("*").alias("n"))


def solved_by_company(rows: DataFrame, personal: DataFrame, most: int = 12) -> DataFrame:
    """The companies with most solved rows, and each one's share of the largest."""
    solved = rows.join(personal.filter("status = 'solved'").select("id"), "id", "left_semi")
    top = solved.select(F.explode("companies").alias("company")).groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(most)
    return top.withColumn("bar", F.col("n") / F.max("n").over(Window.partitionBy()))


def migrate(rows: DataFrame, personal: DataFrame) -> DataFrame:
    """The overlay after relinks: a row without an entry takes that of its first alias with one.

    An entry goes to the first row, in dataset order, that wants it; a row that loses it wants its
    next alias. A round takes from every row what it wants and loses; rounds go on while rows lose.
    """
    by_row, by_old = Window.partitionBy("id").orderBy("place"), Window.partitionBy("old").orderBy("key", "id")
    empty = rows.join(personal.select("id"), "id", "left_anti").select("id", "key", F.posexplode("aliases").alias("place", "old"))
    pairs = empty.join(personal.select(F.col("id").alias("old")), "old")
    made: list[str] = []
    while True:
        wanted = pairs.withColumn("n", F.row_number().over(by_row)).filter("n = 1").drop("n")
        wanted = files.kept(wanted.withColumn("n", F.row_number().over(by_old)), "claims", made)
        lost = wanted.filter("n > 1").select("id", "place")
        if lost.isEmpty():
            break
        pairs = files.kept(pairs.join(lost, ["id", "place"], "left_anti"), "pairs", made)
    claims = wanted.filter("n = 1").select("id", "old")
    have = personal.select(*PERSONAL.fieldNames())
    moved = have.withColumnRenamed("id", "old").join(claims, "old").withColumn("migrated_from", F.col("old")).select(*PERSONAL.fieldNames())
    return have.join(claims.select(F.col("old").alias("id")), "id", "left_anti").unionByName(moved)


def upsert(personal: DataFrame, patches: DataFrame) -> DataFrame:
    """Entries with patches(id and any overlay columns) laid over them; untouched ones go."""
    fields = [c for c in PERSONAL.fieldNames() if c != "id"]
    p = patches.select("id", *(F.col(c).alias(f"_{c}") for c in fields if c in patches.columns), F.lit(True).alias("_patch"))
    merged = personal.join(p, "id", "full_outer")
    out = merged.select("id", *(F.coalesce(f"_{c}", c).alias(c) if c in patches.columns else F.col(c) for c in fields))
    return out.filter(is_touched())


def imported(personal: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both overlays; where both have an id, the incoming entry."""
    return personal.join(incoming.select("id"), "id", "left_anti").select(*personal.columns).unionByName(incoming.select(*personal.columns))


def shown(rows: DataFrame, most: int = 3) -> DataFrame:
    """rows with ``companies`` cut to the few that a list shows."""
    return rows.withColumn("companies", F.slice("companies", 1, most))


def lookup(rows: DataFrame, id_: str) -> DataFrame:
    """The one row of an id, or none, of the rows that a selection shows."""
    return rows.filter(F.col("id") == id_).limit(1)


def with_origin(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """rows with the struct ``origin``, null where there is none."""
    return rows.join(origins.select("id", F.struct(*(c for c in origins.columns if c != "id")).alias("origin")), "id", "left")


def retitled_origins(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows whose origin goes by another title, to be looked at."""
    o = origins.select("id", F.col("title").alias("origin_title"))
    return rows.join(o, "id").filter(F.col("origin_title") != F.col("title"))


def noted_removals(changes: DataFrame, personal: DataFrame) -> DataFrame:
    """Removed rows, and whether the overlay holds anything on them."""
    return with_overlay(changes.filter("kind = 'removed'"), personal).withColumn("noted", is_touched()).drop(*OVERLAY)
