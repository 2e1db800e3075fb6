"""Deterministic artifacts, written only where they differ."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KINDS
from . import files

CHANGELOG_TITLE = "# Changelog"
CHANGELOG_MOST = 50
#: Ambiguous relinks that the changelog lists; all are in their table.
AMBIGUOUS_MOST = 1000
# Headings of the changelog, whose lines are a fixed output format too.
HEADINGS = {"added": "Added", "removed": "Removed", "retitled": "Retitled", "relinked": "Relinked", "recompanied": "Company changed"}


def same_rows(a: DataFrame, b: DataFrame, but: tuple[str, ...] = ()) -> bool:
    """Whether two frames hold the same rows apart from some columns; one aggregate each."""
    columns = [c for c in a.columns if c not in but]

    def mark(df: DataFrame):
        h = [F.xxhash64(F.lit(seed), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})) for seed in (1, 2)]
        return tuple(df.agg(F.count("*"), *(F.bit_xor(x) for x in h), F.sum(F.pmod(h[0], F.lit(1 << 31)))).first())

    return set(columns) <= set(b.columns) and mark(a) == mark(b)


def write_table(df: DataFrame, path: str, but: tuple[str, ...] = (), sort: list[Column] | None = None) -> bool:
    """Write a table through a staging folder unless the one there holds the same rows."""
    spark = df.sparkSession
    if files.exists(spark, path) and same_rows(df, spark.read.parquet(path), but):
        return False
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    (df.orderBy(*sort) if sort else df).write.parquet(staged)
    files.swap(spark, staged, path)
    return True


def json_rows(df: DataFrame, nulls: bool = True) -> DataFrame:
    """One JSON text a row; nulls kept as in records, or dropped as in changes."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false" if nulls else "true"}).alias("value"))


def render(head: dict, key: str, rows: DataFrame) -> str:
    """A document of one record a line, for catalogs small enough to be one file."""
    lines = [r[0] for r in json_rows(rows).toLocalIterator()]
    out = ["{", *(f"{json.dumps(k, ensure_ascii=False)}:{json.dumps(v, ensure_ascii=False)}," for k, v in head.items()), f"{json.dumps(key)}:["]
    return "\n".join([*out, *(line + "," * (i + 1 < len(lines)) for i, line in enumerate(lines)), "]}"]) + "\n"


def document_lines(head: dict, **lists: DataFrame) -> DataFrame:
    """place, value: the lines of a JSON document, one record a line; lists are frames of (place, value) with a JSON text a row."""
    names = list(lists)
    spark = lists[names[0]].sparkSession
    said = [(0, 0, "{" + "".join(f"{json.dumps(k, ensure_ascii=False)}:{json.dumps(v, ensure_ascii=False)}," for k, v in head.items()))]
    out = None
    for i, name in enumerate(names):
        said += [(2 * i + 1, 0, f"{json.dumps(name)}:["), (2 * i + 2, 0, "]," if i + 1 < len(names) else "]}")]
        rows = lists[name].select(F.lit(2 * i + 1).alias("part"), F.col("place").cast("int").alias("place"), F.concat(F.when(F.col("place") > 1, ",").otherwise(""), "value").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame(said, "part int, place int, value string").unionByName(out)


def write_document(lines: DataFrame, path: str) -> bool:
    """The lines of document_lines as one file, if the one there holds others: a task sorts and writes them, on disk beyond its memory."""
    spark = lines.sparkSession
    if files.exists(spark, path) and same_rows(lines.select("value"), spark.read.text(path)):
        return False
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    lines.repartition(1).sortWithinPartitions("part", "place").select("value").write.text(staged)
    files.swap(spark, files.only_part(spark, staged), path)
    files.delete(spark, staged)
    return True


def change_document(changes: DataFrame, ambiguous: DataFrame, date: str, counts: dict[str, int], made: list[str] | None = None) -> DataFrame:
    """The lines of a day's change document: counts, changes in order without null members, ambiguous relinks."""
    from ..operators.snapshot import ambiguous_lists, change_order

    numbered = lambda df, *by: files.numbered(df, list(by), "numbered", made).select("place", F.to_json(F.struct(*df.columns)).alias("value"))
    return document_lines({"date": date, "counts": counts}, changes=numbered(changes, *change_order()), ambiguous_relinks=numbered(ambiguous_lists(ambiguous), "title", "added_ids"))


def compact(doc: dict) -> str:
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":")) + "\n"


def indented(doc: dict) -> str:
    return json.dumps(doc, ensure_ascii=False, indent=2) + "\n"


def changelog_lines(changes: DataFrame, ambiguous: DataFrame, snapshot: DataFrame, date: str, most: int = CHANGELOG_MOST) -> DataFrame:
    """date, section, place, line of one day's entry."""
    from ..operators.snapshot import ambiguous_groups, capped, described

    first = described(capped(changes, most), snapshot)
    section = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    heading = F.element_at(F.create_map(*(F.lit(x) for p in HEADINGS.items() for x in p)), F.col("kind"))
    counts = changes.groupBy("kind").agg(F.count("*").alias("of"))
    heads = counts.select(section.alias("section"), F.lit(0).alias("place"), F.format_string("### %s (%d)", heading, "of").alias("line"))
    body = first.select(section.alias("section"), F.col("place"), F.concat(F.lit("- "), "line").alias("line"))
    rest = counts.filter(F.col("of") > most).select(section.alias("section"), F.lit(most + 1).alias("place"), F.format_string(f"- …and %d more (see `data/changes/{date}.json`)", F.col("of") - most).alias("line"))
    n = len(KINDS) + 1
    groups = ambiguous_groups(ambiguous)
    many = groups.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(n).alias("section"), F.lit(0).alias("place"), F.format_string("### Needs confirmation (%d)", "n").alias("line"))
    # a group's first added id stands for it: ids are in one group only
    firsts = ambiguous.filter("side = 'added'").groupBy("group").agg(F.min("id").alias("first"))
    said = F.format_string("- %s — %d added / %d removed share one signature; not merged", "title", "n_added", "n_removed")
    listed = groups.join(firsts, "group").orderBy("title", "first").limit(AMBIGUOUS_MOST)
    unsure = listed.select(F.lit(n).alias("section"), F.row_number().over(_by("title", "first")).alias("place"), said.alias("line"))
    more = groups.agg(F.count("*").alias("n")).filter(F.col("n") > AMBIGUOUS_MOST)
    more = more.select(F.lit(n).alias("section"), F.lit(AMBIGUOUS_MOST + 1).alias("place"), F.format_string(f"- …and %d more (see the table `ambiguous/date={date}`)", F.col("n") - AMBIGUOUS_MOST).alias("line"))
    unsure = unsure.unionByName(more)
    out = heads.unionByName(body).unionByName(rest).unionByName(many).unionByName(unsure)
    return out.select(F.lit(date).alias("date"), "section", "place", "line")


def _by(*columns):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def update_changelog(spark: SparkSession, path: str, date: str, lines: DataFrame) -> bool:
    """Put one day's section into the changelog, newest first, in the place of an older one."""
    import re

    text = files.read_text(spark, path) or ""
    sections = dict(re.findall(r"(?ms)^## (\d{4}-\d{2}-\d{2})\n(.*?)(?=^## |\Z)", text))
    parts: dict[int, list[str]] = {}
    for r in lines.orderBy("section", "place").collect():  # 50 lines a kind and AMBIGUOUS_MOST at most
        parts.setdefault(r["section"], []).append(r["line"])
    sections[date] = "\n" + "\n\n".join("\n".join([p[0], "", *p[1:]]) for _, p in sorted(parts.items()))
    body = [f"## {d}\n{s.rstrip()}" for d, s in sorted(sections.items(), reverse=True)]
    return files.write_text(spark, path, CHANGELOG_TITLE + "\n\n" + "\n\n".join(body) + "\n")


def export_personal(personal: DataFrame, exported: str) -> str:
    entries = {r["id"]: {k: v for k, v in r.asDict().items() if k != "id"} for r in personal.orderBy("id").toLocalIterator()}
    return json.dumps({"schema": "personal.v1", "exported": exported, "entries": entries}, ensure_ascii=False, indent=2)


def import_personal(spark: SparkSession, text: str) -> DataFrame:
    from ..schema import PERSONAL

    doc = json.loads(text)
    entries = doc.get("entries") or doc if isinstance(doc, dict) else None
    if not isinstance(entries, dict):
        raise ValueError("not an export")
    names = PERSONAL.fieldNames()
    return spark.createDataFrame([tuple(k if n == "id" else v.get(n) for n in names) for k, v in entries.items() if isinstance(v, dict)], PERSONAL)
