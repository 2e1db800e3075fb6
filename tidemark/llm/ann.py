"""Approximate nearest neighbours by multiprobe p-stable hashing.

Index. Vectors are scaled to length 1, so the nearest by cosine are the nearest by distance.
Each of ``TABLES`` tables projects them on ``FUNCTIONS`` random orthogonal directions with
Gaussian-like (2-stable) projections and cuts these into slots of ``SLOT``; the slots' numbers
are the bucket. Every row is indexed, in every table.

Search. If a neighbour has cosine c with the query, its projection is normal around c times the
query's with variance 1 - c^2, so the chance that it lies in a given bucket is known. A query
visits the buckets next to its own (perturbed slots) in falling order of that chance, until the
tables together hold a neighbour as near as c with chance ``SUCCESS``. c is the query's k-th best
cosine in a sample of at most ``SAMPLE`` vec_ids, a vector each: the true k-th neighbour is at least as near, so
the chance is a lower estimate. What the buckets hold is compared exactly, tables are merged.

Scale. Buckets are dealt over cells of about ``CELL`` index rows; a query goes once to each cell
where it visits buckets, and a cell answers with its best vec_ids. A bucket above ``CELL`` rows is split
over several cells, whatever share of the rows it has, and more than ``ASKED`` queries of one cell
are dealt over several tasks that hold its rows each. Only the sample is broadcast.

Copies. Rows of one vector tie, and ties go to the smaller vec_id, so of these only the k + 1
smallest vec_ids can be among the k nearest of a query (one may be its own): the index holds each
vector with these, the rest by them. Queries of one vector have the same nearest but for their own
vec_id: one asks for k + 1, and each takes the first k others. A vector that a third of all rows
share is thus compared a few times, with the same result as if each of its rows were.

A query that finds fewer than k of the other vec_ids is run again over all cells, exactly.

Defined results: vectors that are null, zero or hold null or non-finite components take no part;
vectors of other lengths than the query's aren't compared with it, and each length has an index of
its own; rows of one vec_id and vector are one; a vec_id with several vectors is as near as its
nearest, and asks with its least (in the order of arrays); ties go to the smaller vec_id; fewer
than k other vec_ids of that length: all of them.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K = 5
TABLES, FUNCTIONS, SLOT = 4, 8, 2.0
SAMPLE = 4096
SUCCESS = 0.95
CELL = 8192
ASKED = 1 << 14
SEED = 11
SALTS = 16
#: Farther slots than this, from the middle, share the outermost number.
REACH = 60


def valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


@functools.lru_cache(8)
def directions(dim: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = np.random.default_rng(SEED)
    n = min(FUNCTIONS, dim)
    axes = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :n] * math.sqrt(dim) for _ in range(TABLES)]
    return axes, [rng.uniform(0, SLOT, n) for _ in range(TABLES)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def slots(x: np.ndarray, axes: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((x @ axes + shift) / SLOT), -REACH, REACH).astype(np.int64)


def code(s: np.ndarray) -> np.ndarray:
    out = np.zeros(s.shape[:-1], np.int64)
    for i in range(s.shape[-1]):
        out = out * 128 + (s[..., i] + 64)
    return out


_erf = np.vectorize(math.erf)


def probes(projection: np.ndarray, shift: np.ndarray, cosine: float, success: float) -> list[tuple[int, ...]]:
    """Buckets in falling order of the chance to hold a neighbour of that cosine, up to success."""
    spread = math.sqrt(max(1e-9, 1 - cosine * cosine))
    each = []
    for p, b in zip(projection, shift, strict=True):
        mid = (cosine * p + b) / SLOT
        width = math.ceil(4 * spread / SLOT) + 1
        s = np.arange(math.floor(mid) - width, math.floor(mid) + width + 1)
        edge = (np.append(s, s[-1] + 1) * SLOT - b - cosine * p) / (spread * math.sqrt(2))
        chance = np.diff(_erf(edge)) / 2
        order = np.argsort(-chance)
        order = order[chance[order] > 1e-7]
        each.append((np.clip(s[order], -REACH, REACH).tolist(), np.log(chance[order]).tolist()))
    first = tuple(0 for _ in each)
    heap, out, total = [(-sum(c[0] for _, c in each), first, 0)], [], 0.0
    while heap and total < success:
        cost, at, last = heapq.heappop(heap)
        out.append(tuple(s[i] for i, (s, _) in zip(at, each, strict=True)))
        total += math.exp(-cost)
        for j in range(last, len(each)):  # each combination is reached one way
            if at[j] + 1 < len(each[j][0]):
                heapq.heappush(heap, (cost + each[j][1][at[j]] - each[j][1][at[j] + 1], (*at[:j], at[j] + 1, *at[j + 1 :]), j))
    return out


def _stack(col) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col])


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines in double precision, alike for alike vectors wherever they stand."""
    q, v = q / np.abs(q).max(axis=1, keepdims=True), v / np.abs(v).max(axis=1, keepdims=True)
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def _of_ids(cos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best cosine of each vec_id, and its place; ids ascend along the columns of cos."""
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    at = np.broadcast_to(np.arange(len(ids)), cos.shape)
    if len(first) == len(ids):
        return cos, at
    best = np.maximum.reduceat(cos, first, axis=1)
    hit = cos == np.repeat(best, np.diff(np.append(first, len(ids))), axis=1)
    return best, np.minimum.reduceat(np.where(hit, at, len(ids)), first, axis=1)


def _best(k: int):
    def run(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(rows) or not len(asked):
            return empty
        rows = rows.sort_values(["code", "vec_id"], kind="stable")
        raw, ids, codes = _stack(rows["v"]), rows["vec_id"].to_numpy(), rows["code"].to_numpy()
        v, qraw, qid = unit(raw), _stack(asked["v"]), asked["query_id"].to_numpy()
        q = unit(qraw)
        visits: dict[int, list[int]] = {}
        for i, c in enumerate(asked["codes"]):
            for one in c:
                visits.setdefault(int(one), []).append(i)
        everywhere = visits.pop(-1, [])
        found = []
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        for a, b in zip(starts, [*starts[1:], len(codes)], strict=True):
            who = visits.get(int(codes[a]), []) + everywhere
            if not who:
                continue
            for w in range(0, len(who), 512):
                i = np.array(who[w : w + 512])
                cos, at = _of_ids(np.round(q[i] @ v[a:b].T, 12), ids[a:b])
                top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                found.append(np.stack([np.repeat(i, top.shape[1]), np.take_along_axis(at, top, 1).ravel() + a, np.take_along_axis(cos, top, 1).ravel()]))
        if not found:
            return empty
        qi, vi, cos = np.concatenate(found, axis=1)
        qi, vi = qi.astype(int), vi.astype(int)
        # a vec_id with vectors in several buckets counts once, by its nearest
        order = np.lexsort((-cos, ids[vi], qi))
        qi, vi, cos = qi[order], vi[order], cos[order]
        new = np.append(True, (qi[1:] != qi[:-1]) | (ids[vi[1:]] != ids[vi[:-1]]))[: len(qi)]
        qi, vi, cos = qi[new], vi[new], cos[new]
        order = np.lexsort((ids[vi], -cos, qi))
        qi, vi = qi[order], vi[order]
        place = np.arange(len(qi)) - np.maximum.accumulate(np.where(np.append(True, qi[1:] != qi[:-1]), np.arange(len(qi)), 0)) if len(qi) else qi
        qi, vi = qi[place < k], vi[place < k]
        return pd.DataFrame({"query_id": qid[qi], "vec_id": ids[vi], "score": _exact(qraw[qi], raw[vi])})

    return run


def _index(clean: DataFrame, k: int) -> DataFrame:
    """Each vector of clean(vec_id, v, h, dim) with its k + 1 smallest vec_ids."""
    crowd = clean.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1).select("h", F.lit(True).alias("crowd"))
    crowd = materialise(crowd, "ann-copies")
    if crowd.isEmpty():
        return clean
    told = clean.join(crowd, "h", "left")
    order = Window.partitionBy("v").orderBy("vec_id")
    least = told.filter("crowd").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    return materialise(told.filter("crowd IS NULL").select(*clean.columns).unionByName(least.select(*clean.columns)), "ann-index")


def _dealt(rows: DataFrame, asked: DataFrame, by: list[str], leads: int) -> tuple[DataFrame, DataFrame]:
    """rows and asked with a column ``block``: groups of more than ASKED queries in several, the rows in each."""
    if leads <= ASKED:
        return rows.withColumn("block", F.lit(0)), asked.withColumn("block", F.lit(0))
    asked = materialise(asked, "ann-asked")
    crowded = asked.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > ASKED)
    crowded = materialise(crowded.select(*by, F.ceil(F.col("n") / ASKED).cast("int").alias("blocks")), "ann-crowded")
    own = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(7), "query_id"), F.col("blocks"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    return rows.join(crowded, by, "left").withColumn("block", every).drop("blocks"), asked.join(crowded, by, "left").withColumn("block", own).drop("blocks")


def search(vectors: DataFrame, is_query: Column, k: int = K, success: float = SUCCESS, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: k nearest of each query among all rows of vectors.

    is_query is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).filter(valid(F.col("v")) & F.col("vec_id").isNotNull())
    clean = materialise(clean.distinct().withColumns({"h": F.xxhash64("v"), "dim": F.size("v")}), "ann-vectors")
    drawn = clean.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = clean.join(F.broadcast(drawn), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], empty)
    held: dict[int, list] = {}
    for r in sample:
        held.setdefault(len(r["v"]), []).append((r["vec_id"], np.array(r["v"])))
    shared = spark.sparkContext.broadcast({d: (np.array([i for i, _ in rs]), unit(np.stack([v for _, v in rs]))) for d, rs in held.items()})
    kept = _index(clean, k)
    n = kept.count()
    cells = max(1, -(-n // CELL))
    each = 1 - (1 - success) ** (1 / TABLES)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                x, (axes, shifts) = unit(_stack(own["v"])), directions(int(dim))
                yield pd.concat([own.assign(tab=t, code=code(slots(x, axes[t], shifts[t]))) for t in range(TABLES)])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [np.zeros((0, 4), np.int64)]
            for query, alone, v in zip(pdf["query_id"], pdf["alone"], pdf["v"], strict=True):
                u = unit(np.asarray(v, np.float64)[None])[0]
                ids, x = shared.value.get(len(u), (np.zeros(0), np.zeros((0, len(u)))))
                near = np.sort((x @ u)[ids != query] if alone else x @ u)[::-1]
                nth = k - 1 if alone else k  # another query of this vector may be in the sample itself
                if len(near) <= nth:
                    continue  # too few to tell: the exact run takes this query
                axes, shifts = directions(len(u))
                for t in range(TABLES):
                    codes = np.unique(code(np.array(probes(u @ axes[t], shifts[t], float(near[nth]), each))))
                    out.append(np.stack([np.full(len(codes), query), np.full(len(codes), len(u)), np.full(len(codes), t), codes], 1))
            yield pd.DataFrame(np.concatenate(out), columns=["query_id", "dim", "tab", "code"])

    rows = kept.select("vec_id", "v", "dim").mapInPandas(index, "vec_id long, v array<double>, dim int, tab int, code long")
    queries = materialise(clean.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    # one query of each vector asks for all of them
    leads = materialise(queries.groupBy("v").agg(F.min("vec_id").alias("query_id"), (F.count("*") == 1).alias("alone")).withColumn("dim", F.size("v")), "ann-leads")
    members = queries.join(leads.select("v", "dim", F.col("query_id").alias("lead")), "v").select("vec_id", "lead", "dim")
    members, n_leads = materialise(members, "ann-members"), leads.count()
    # buckets larger than a cell are dealt over several
    hot = rows.groupBy("dim", "tab", "code").agg(F.count("*").alias("n")).filter(F.col("n") > CELL)
    parts = materialise(hot.select("dim", "tab", "code", F.ceil(F.col("n") / CELL).cast("int").alias("parts")), "ann-hot") if n > CELL else None
    hot = parts is not None and not parts.isEmpty()
    cell = F.pmod(F.xxhash64("dim", "tab", "code"), F.lit(cells)).cast("int")

    if hot:
        salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.lit(SALTS)).cast("int")).join(salted, ["dim", "tab", "code", "salt"], "left")
        rows = rows.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.lit(5), "vec_id", "v"), F.col("parts")).cast("int")))
        rows = rows.select("dim", "tab", cell.alias("cell"), "part", "vec_id", "v", "code")
    else:
        rows = rows.select("dim", "tab", cell.alias("cell"), F.lit(0).alias("part"), "vec_id", "v", "code")

    asked = leads.select("query_id", "alone", "v").repartition(max(8, cells)).mapInPandas(ask, "query_id long, dim int, tab int, code long")
    if hot:
        asked = asked.join(parts, ["dim", "tab", "code"], "left").withColumn("part", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("parts")))))
    else:
        asked = asked.withColumn("part", F.lit(0))
    asked = asked.groupBy("query_id", "dim", "tab", cell.alias("cell"), "part").agg(F.collect_list("code").alias("codes"))
    by = ["dim", "tab", "cell", "part"]
    rows, asked = _dealt(rows, asked, by, n_leads)
    asked, by = asked.join(leads.select("query_id", "v"), "query_id"), [*by, "block"]

    schema = "query_id long, vec_id long, score double"
    found = rows.groupBy(*by).cogroup(asked.select(*by, "query_id", "v", "codes").groupBy(*by)).applyInPandas(_best(k + 1), schema)
    best = materialise(_merged(found, members, k), "ann")
    others = clean.groupBy("dim").agg((F.countDistinct("vec_id") - 1).alias("others"))
    got = best.groupBy("query_id").agg(F.count("*").alias("n")).withColumnRenamed("query_id", "vec_id")
    wanting = F.coalesce("n", F.lit(0)) < F.least(F.lit(k), "others")
    short = materialise(members.join(got, "vec_id", "left").join(others, "dim").filter(wanting).select("vec_id", "lead"), "ann-short")
    if not short.isEmpty():
        whole = kept.select("dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(cells)).cast("int").alias("cell"), "vec_id", "v", F.lit(0).cast("long").alias("code"))
        again = leads.join(short.select(F.col("lead").alias("query_id")).distinct(), "query_id", "left_semi").select("query_id", "dim")
        again = again.select("*", F.array(F.lit(-1).cast("long")).alias("codes"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
        whole, again = _dealt(whole, again, ["dim", "cell"], n_leads)
        again, by = again.join(leads.select("query_id", "v"), "query_id"), ["dim", "cell", "block"]
        exact = whole.groupBy(*by).cogroup(again.select(*by, "query_id", "v", "codes").groupBy(*by)).applyInPandas(_best(k + 1), schema)
        best = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(_merged(exact, short, k))
    return best


def _merged(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k nearest others of each of members(vec_id, lead) by what their leads found."""
    lead = Window.partitionBy("lead").orderBy(F.desc("score"), "vec_id")
    each = found.groupBy(F.col("query_id").alias("lead"), "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(lead)).filter(F.col("place") <= k + 1)
    each = members.select(F.col("vec_id").alias("query_id"), "lead").join(each, "lead").filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("place")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 50 == 0)
