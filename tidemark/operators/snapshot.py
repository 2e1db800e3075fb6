"""What moved between two snapshots of a keyed catalog, and the next snapshot.

Snapshots hold one row an id (schema PROBLEM), removed rows as tombstones. One full outer join
by id finds what came, went and stayed; rows that came and went pair up as relinks where exactly
one of each shares title, company set and format. The pairs, few rows, are joined to it by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KINDS, PROBLEM, RETENTION_DAYS

FIELDS = PROBLEM.fieldNames()


@dataclass
class Diff:
    """Frames of one lineage; persist the inputs where several of them are used.

    ambiguous is in long form, a row an id: see :func:`ambiguous_groups` and :func:`ambiguous_lists`.
    """

    snapshot: DataFrame
    changes: DataFrame
    ambiguous: DataFrame
    archived: DataFrame

    def counts(self) -> DataFrame:
        return change_counts(self.changes)

    def of_kind(self, kind: str) -> DataFrame:
        return self.changes.filter(F.col("kind") == kind)


def company_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def live(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter("state <> 'removed'")


def _signature(row: str) -> Column:
    return F.struct(F.col(f"{row}.title").alias("title"), company_set(F.col(f"{row}.companies")).alias("who"), F.coalesce(F.concat(F.lit("="), f"{row}.format"), F.lit("")).alias("fmt"))


def _pairs(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links of rows that moved, groups of more than one on either side) of previous and current, joined.

    Links are id, o (the row it was, of one that came) and to_id (what it's now, of one that
    went). Signatures are counted with what one row of each side holds, however many share them.
    """
    came = F.col("c").isNotNull() & (F.col("p").isNull() | (F.col("p.state") == "removed"))
    went = F.col("c").isNull() & (F.col("p.state") != "removed")
    moved = joined.filter(came | went).select("id", "p", came.alias("came"), F.when(came, _signature("c")).otherwise(_signature("p")).alias("sig"))
    found = moved.groupBy("sig").agg(
        F.count_if("came").alias("n_new"), F.count_if(~F.col("came")).alias("n_old"), F.max(F.when(F.col("came"), F.col("id"))).alias("new_id"), F.max(F.when(~F.col("came"), F.col("p"))).alias("o")
    )
    single = found.filter("n_new = 1 AND n_old = 1")
    no_row = F.lit(None).cast(found.schema["o"].dataType)
    ends = F.array(F.struct(F.col("new_id").alias("id"), "o", F.lit(None).cast("string").alias("to_id")), F.struct(F.col("o.id").alias("id"), no_row.alias("o"), F.col("new_id").alias("to_id")))
    links = single.select(F.explode(ends).alias("e")).select("e.*")
    many = found.filter("n_new > 0 AND n_old > 0 AND n_new + n_old > 2").select("sig", "n_new", "n_old")
    side = F.when(F.col("came"), "added").otherwise("removed")
    # few of the moved rows share a signature: a hot one is the join's large side, which Spark can split
    rows = moved.join(many, "sig").select(F.sha2(F.to_json("sig").cast("binary"), 256).alias("group"), side.alias("side"), "id", F.col("sig.title").alias("title"), F.col("n_new").alias("n_added"), F.col("n_old").alias("n_removed"))
    return links, rows


#: Ids of a side that a list of the hand-out holds; beyond, the long form has them.
LISTED = 100_000


def ambiguous_groups(ambiguous: DataFrame) -> DataFrame:
    """group, title, n_added, n_removed, reason: one row a group, counted and not collected."""
    reason = F.format_string("%d added and %d removed rows share one (title, companies, format) signature", F.col("n_added"), F.col("n_removed"))
    return ambiguous.groupBy("group").agg(*(F.first(c).alias(c) for c in ("title", "n_added", "n_removed"))).withColumn("reason", reason)


def ambiguous_lists(ambiguous: DataFrame, most: int = LISTED) -> DataFrame:
    """added_ids, removed_ids, title, reason: the hand-out of groups of up to ``most`` ids a side, ids in order."""
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("id"))))
    small = ambiguous.filter((F.col("n_added") <= most) & (F.col("n_removed") <= most))
    lists = small.groupBy("group").agg(ids("added").alias("added_ids"), ids("removed").alias("removed_ids"))
    return lists.join(ambiguous_groups(small), "group").select("added_ids", "removed_ids", "title", "reason")


def _state(**members: Column) -> Column:
    """A before or after value: the members given, the others null."""
    kinds = {"title": "string", "companies": "array<string>", "url": "string", "key": "string"}
    return F.struct(*((members[k] if k in members else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def diff(previous: DataFrame, current: DataFrame, today: str) -> Diff:
    p = previous.select("id", F.struct(*FIELDS).alias("p"))
    c = current.select("id", F.struct(*FIELDS).alias("c"))
    j = p.join(c, "id", "full_outer")
    links, ambiguous = _pairs(j)
    j = j.join(links, "id", "left")
    here, was, alive = F.col("c").isNotNull(), F.col("p").isNotNull(), F.col("p.state") != "removed"
    relinked, tomb = F.col("o").isNotNull(), was & ~alive
    kept = here & was & alive & ~relinked
    j = j.withColumn("case", F.when(here & relinked, "relinked").when(here & (~was | ~alive), "added").when(kept, "kept").when(was & alive & F.col("to_id").isNotNull(), "left").when(was & alive, "removed").otherwise("tombstone"))

    def row(base: str, **new: Column) -> Column:
        return F.struct(*((new[f] if f in new else F.col(f"{base}.{f}")).cast(PROBLEM[f].dataType).alias(f) for f in FIELDS))

    none = F.array().cast("array<string>")
    now = F.lit(today)
    gone = F.lit(None)
    after = (
        F.when(F.col("case") == "relinked", row("c", first_seen=F.col("o.first_seen"), last_seen=now, state=F.lit("active"), removed_on=gone, aliases=F.array_distinct(F.concat("o.aliases", F.array("o.id")))))
        .when((F.col("case") == "added") & tomb, row("c", first_seen=F.col("p.first_seen"), last_seen=now, state=F.lit("active"), removed_on=gone, aliases=F.col("p.aliases")))
        .when(F.col("case") == "added", row("c", first_seen=now, last_seen=now, state=F.lit("active"), removed_on=gone, aliases=none))
        .when(F.col("case") == "kept", row("c", first_seen=F.col("p.first_seen"), last_seen=now, state=F.lit("active"), removed_on=gone, aliases=F.col("p.aliases")))
        .when(F.col("case") == "removed", row("p", state=F.lit("removed"), removed_on=now))
        .when(F.col("case") == "tombstone", F.col("p"))
    )
    j = j.withColumn("after", after)
    snapshot = j.filter("case <> 'left'").select("after.*")
    archived = j.filter("case IN ('removed', 'left')").select(
        F.when(F.col("case") == "removed", F.col("after")).otherwise(row("p", state=F.lit("removed"), removed_on=now, aliases=F.array_distinct(F.concat("p.aliases", F.array("to_id"))))).alias("a")
    ).select("a.*")

    def change(kind: str, base: str, before: Column | None = None, after: Column | None = None, previous: str = "") -> Column:
        empty = F.lit(None).cast("struct<title:string,companies:array<string>,url:string,key:string>")
        link = lambda f: (F.col(f"{previous}.{f}") if previous else F.lit(None)).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), F.col(f"{base}.id").alias("id"), F.col(f"{base}.key").alias("key"), F.col(f"{base}.title").alias("title"),
            (empty if before is None else before).alias("before"), (empty if after is None else after).alias("after"), link("id").alias("previous_id"), link("key").alias("previous_key"),
        )

    case = F.col("case")
    made = F.array(
        F.when(case == "relinked", change("relinked", "c", _state(url=F.col("o.url"), key=F.col("o.key")), _state(url=F.col("c.url"), key=F.col("c.key")), "o")),
        F.when(case == "added", change("added", "c")),
        F.when(case == "removed", change("removed", "p")),
        F.when((case == "kept") & (F.col("p.title") != F.col("c.title")), change("retitled", "c", _state(title=F.col("p.title")), _state(title=F.col("c.title")))),
        F.when((case == "kept") & (company_set(F.col("p.companies")) != company_set(F.col("c.companies"))), change("recompanied", "c", _state(companies=F.col("p.companies")), _state(companies=F.col("c.companies")))),
    )
    changes = j.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("x.*")
    return Diff(snapshot, changes, ambiguous, archived)


def change_counts(changes: DataFrame) -> DataFrame:
    """kind, n over all five kinds, zeros included."""
    kinds = changes.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return kinds.join(changes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def change_order() -> list[Column]:
    return [F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.col("key"), F.col("id")]


def is_bootstrap(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """bootstrap: whether a load added at least as many rows as there are: it's the first, and nothing is news."""
    added = counts.agg(F.coalesce(F.sum(F.when(F.col("kind") == "added", F.col("n"))), F.lit(0)).alias("added"))
    return added.crossJoin(rows.agg(F.count("*").alias("rows"))).select((F.col("added") >= F.col("rows")).alias("bootstrap"))  # one row by one row


def prune(snapshot: DataFrame, today: str, referenced: DataFrame | None, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): tombstones of more than ``days`` that referenced(id) doesn't name go.

    Without a list of references nothing goes.
    """
    old = (F.col("state") == "removed") & F.coalesce(F.col("removed_on") < F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"), F.lit(True))
    if referenced is None:
        return snapshot, snapshot.limit(0)
    dropped = snapshot.filter(old).join(referenced.select("id"), "id", "left_anti")
    return snapshot.join(dropped.select("id"), "id", "left_anti"), dropped


def archive_order() -> list[Column]:
    """Order of the stored archive, missing values first."""
    return [F.coalesce("removed_on", F.lit("")), F.coalesce("key", F.lit(""))]


def archive(existing: DataFrame, additions: DataFrame) -> DataFrame:
    """existing and what of additions it lacks, by (id, removed_on)."""
    by = ["id", "removed_on"]
    same = (F.col("n.id") == F.col("e.id")) & F.col("n.removed_on").eqNullSafe(F.col("e.removed_on"))
    new = additions.dropDuplicates(by).alias("n").join(existing.select(*by).alias("e"), same, "left_anti")
    return existing.unionByName(new.select(*existing.columns))




def described(changes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """changes with ``line``, what the changelog says of each."""
    who = lambda c, none: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(none))
    rows = snapshot.select("id", F.col("companies").alias("_who"), F.col("format").alias("_format"), F.lit(True).alias("_there"))
    line = (
        F.when(F.col("kind") == "retitled", F.concat_ws(" → ", "before.title", "after.title"))
        .when(F.col("kind") == "relinked", F.concat("title", F.lit(" — "), "before.key", F.lit(" → "), "after.key"))
        .when(F.col("kind") == "recompanied", F.concat("title", F.lit(" — "), who(F.col("before.companies"), "none"), F.lit(" → "), who(F.col("after.companies"), "none")))
        .when(F.col("kind") == "removed", F.concat("title", F.lit(" — removed upstream")))
        .when(F.col("_there").isNull(), F.col("title"))
        .otherwise(F.concat("title", F.lit(" — "), who(F.col("_who"), "Unattributed"), F.lit(" · "), F.coalesce(F.nullif(F.col("_format"), F.lit("")), F.lit("unclassified"))))
    )
    return changes.join(rows, "id", "left").withColumn("line", line).drop("_who", "_format", "_there")


def capped(changes: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each kind by (key, id), with place and of, the kind's count."""
    from pyspark.sql import Window

    by = Window.partitionBy("kind").orderBy("key", "id")
    total = changes.groupBy("kind").agg(F.count("*").alias("of"))
    return changes.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most).join(F.broadcast(total), "kind")  # five rows
