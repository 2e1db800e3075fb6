"""Product codes of vectors by integer Lloyd rounds; segment-mean bounds spare most distances.

A vector's components become integers, floor(4096 x), and are cut into equal parts. Each part
position has a codebook of a few entries; a round assigns every part to its nearest entry and
moves each entry to the floor of its parts' mean. All is integer arithmetic, ties go to the lower
index, so every run gives the same codes.

Assigning filters before it measures. A part and an entry are seen as one block, then as two, four
and so on. Of each block only the mean and the norm of what the mean leaves over are known, and

    |x - c|^2 >= sum over blocks of  size (mean x - mean c)^2 + (rest x - rest c)^2

as the block's mean and its rest are at right angles and the rests differ by at least the
difference of their norms. The entry of the least coarse bound is measured first; another one lives
on only while its bound, less a margin that covers every rounding, doesn't exceed the measured
distance, and what survives the finest level gets its exact integer distance. The filter drops
nothing that could win or tie.

On the cluster: a round is one pass over the vectors, and a task returns one row of sums for each
entry it used; the codebooks (parts x entries x part length integers) are all that the driver
holds. Nothing is shuffled but these rows. Sums are added as decimals and can't overflow.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
those whose length isn't that of the smallest kept vec_id's (or isn't a positive multiple of the
parts). Rows without vec_id take part after all others; a vec_id with several vectors starts the
codebooks with its smallest one; repeated rows count as often as they're there; fewer vec_ids than
entries make smaller codebooks; no kept rows give no rows. Integers of ``LARGEST`` or more in size
raise an error, as their distances can leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bound on the size of an integer component.
LARGEST = 1 << 25
#: Share of the largest possible distance that stands for all rounding in a bound.
MARGIN = 1e-12


def kept(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and vector of the rows that take part."""
    have = set(vectors.columns)
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label") if label in have else F.lit(None).cast("int").alias("label"), v.alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.filter(F.col("vector").isNotNull() & F.coalesce(F.forall("vector", fine), F.lit(False)))


def _ints(vectors: pd.Series) -> np.ndarray:
    x = np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component's integer is {LARGEST} or more in size")
    return x.astype(np.int64)


def _levels(length: int) -> list[np.ndarray]:
    """Starts of the blocks of each level, coarse to fine: 1, 2, 4 ... blocks of nearly equal size, of two components at least."""
    out, n = [], 1
    while n == 1 or length // n >= 2:
        out.append(np.arange(n) * length // n)
        n *= 2
    return out


def _segments(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and residual norms of the blocks of the last axis."""
    sizes = np.diff([*starts, x.shape[-1]])
    means = np.add.reduceat(x, starts, axis=-1) / sizes
    rest = x - np.repeat(means, sizes, axis=-1)
    return means, np.sqrt(np.add.reduceat(rest * rest, starts, axis=-1))


def nearest(x: np.ndarray, book: np.ndarray, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry of book, ties to the lower one, and the squared distance; both exact.

    counts gets how many pairs were measured, of how many.
    """
    n, k = len(x), len(book)
    rows = np.arange(n)
    most = x.shape[1] * (np.abs(x).max(axis=1, initial=0) + np.abs(book).max(initial=0)).astype(np.float64) ** 2
    slack = MARGIN * most
    exact = lambda r, e: ((x[r] - book[e]) ** 2).sum(axis=1)
    best = at = pairs = None
    for starts in _levels(x.shape[1]):
        sizes = np.diff([*starts, x.shape[1]])
        (mx, rx), (mc, rc) = _segments(x, starts), _segments(book, starts)
        if pairs is None:
            bound = sizes[0] * (mx - mc.T) ** 2 + (rx - rc.T) ** 2  # one block: rows by entries
            at = bound.argmin(axis=1)
            best = exact(rows, at)
            alive = bound - slack[:, None] <= best[:, None]
            alive[rows, at] = False
            pairs = np.nonzero(alive)
        else:
            r, e = pairs
            bound = (sizes * (mx[r] - mc[e]) ** 2 + (rx[r] - rc[e]) ** 2).sum(axis=1)
            alive = bound - slack[r] <= best[r]
            pairs = r[alive], e[alive]
    r, e = pairs
    if counts is not None:
        counts["measured"], counts["all"] = counts.get("measured", 0) + n + len(r), counts.get("all", 0) + n * k
    # the least (distance, index) of each row: exact in one 64-bit integer only if it fits, so two steps
    d = exact(r, e)
    least = best.copy()
    np.minimum.at(least, r, d)
    index = np.where(best == least, at, k)
    tied = d == least[r]
    np.minimum.at(index, r[tied], e[tied])
    return index, least


def _assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows by parts) and errors of whole vectors."""
    parts = np.split(x, len(books), axis=1)
    found = [nearest(p, b) for p, b in zip(parts, books, strict=True)]
    return np.stack([i for i, _ in found], 1), np.sum([d for _, d in found], axis=0)


def _first(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The vectors of the smallest vec_ids, one of each; each task passes on its own smallest."""

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf[[len(v) > 0 and len(v) % parts == 0 for v in pdf["vector"]]]
            pdf = pdf.assign(absent=pdf["vec_id"].isna(), order=[tuple(v) for v in pdf["vector"]])
            held = pdf if held is None else pd.concat([held, pdf])
            held = held.sort_values(["absent", "vec_id", "order"]).drop_duplicates(["absent", "vec_id"]).head(entries)
        if held is not None:
            yield held[["vec_id", "vector"]]

    few = rows.select("vec_id", "vector").mapInPandas(smallest, "vec_id long, vector array<double>")
    found = few.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    if not found:
        return np.zeros((0, 0), np.int64)
    dim = len(found[0]["vector"])
    same = [r["vector"] for r in found if len(r["vector"]) == dim]
    if len(same) < len(found):  # of several lengths: those of the first one's only
        return _first(rows.filter(F.size("vector") == dim), parts, entries)
    return _ints(pd.Series(same))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position, learned from all of kept()'s rows."""
    first = _first(rows, parts, entries)
    if not len(first):
        return []
    books = np.split(first, parts, axis=1)
    dim, length = first.shape[1], books[0].shape[1]
    same = rows.filter(F.size("vector") == dim).select("vector")
    sums = [f"s{i}" for i in range(length)]
    schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in sums)
    for _ in range(rounds):

        def moved(batches: Iterator[pd.DataFrame], books=books) -> Iterator[pd.DataFrame]:
            total = np.zeros((parts, entries, 1 + length), np.int64)
            for pdf in batches:
                if len(pdf):
                    x = _ints(pdf["vector"])
                    codes, _ = _assigned(x, books)
                    for p, own in enumerate(np.split(x, parts, axis=1)):
                        np.add.at(total[p], codes[:, p], np.concatenate([np.ones((len(x), 1), np.int64), own], axis=1))
            p, e = np.nonzero(total[:, :, 0])
            yield pd.DataFrame(np.concatenate([np.stack([p, e], 1), total[p, e]], axis=1), columns=["part", "entry", "n", *sums])

        added = same.mapInPandas(moved, schema).groupBy("part", "entry").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *sums]))
        books = [b.copy() for b in books]
        for r in added.collect():  # parts x entries rows
            books[r["part"]][r["entry"]] = [int(r[s]) // int(r["n"]) for s in sums]
    return books


def sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (array of entries by part) and error of kept()'s rows of the codebooks' length."""
    dim = sum(b.shape[1] for b in books)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, errors = _assigned(_ints(pdf["vector"]), books) if len(pdf) else ([], [])
            yield pdf.drop(columns="vector").assign(code=list(codes), error=errors)

    kind = rows.schema["label"].dataType.simpleString()
    return rows.filter(F.size("vector") == dim).mapInPandas(coded, f"vec_id long, label {kind}, code array<int>, error long")


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256."""
    rows = kept(vectors)
    books = train(rows)
    if not books:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialise(encode(rows, books), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    text = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", text.alias("code"), "error", "label_error", F.lit(sha256(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """DuckDB's SQL of the digest over the table embeddings, for vectors of one length."""
    part = "list_slice(v, {p} * len(v) // 8 + 1, ({p} + 1) * len(v) // 8)"
    all_parts = " UNION ALL ".join(f"SELECT r, vec_id, label, {p} AS part, {part.format(p=p)} AS x FROM ints" for p in range(PARTS))
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
    near{i} AS MATERIALIZED (SELECT r, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS best FROM (
        SELECT r, p.part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts p JOIN book{i} b ON p.part = b.part) GROUP BY r, part)""")
        if i < ROUNDS:
            steps.append(f"""
    moved{i} AS MATERIALIZED (SELECT part, entry, list(CAST(floor(s::DOUBLE / n) AS BIGINT) ORDER BY j) AS c FROM (
        SELECT part, best.entry AS entry, j, sum(x[j]) AS s, count(*) AS n FROM near{i}, range(1, len(x) + 1) t(j) GROUP BY ALL) GROUP BY part, entry),
    book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN moved{i} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""WITH good AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    ints AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(e, lambda x: CAST(floor(4096 * x) AS BIGINT)) AS v FROM good),
    parts AS MATERIALIZED ({all_parts}),
    book0 AS MATERIALIZED (SELECT part, dense_rank() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM parts QUALIFY entry < 16),{",".join(steps)},
    ends AS (SELECT r, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
    sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM ends JOIN ints USING (r), sha"""
