"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in words. Every source's target is met with whole
documents: all of them ``target // source_size`` times, and once more a subset whose lengths
sum to what is left of the budget. That subset is fitted per source over the histogram of
lengths (never over documents): an even share of each length, then the longest that fit, then
an exact bounded-knapsack dynamic program over the last ``KNAPSACK`` words. Where that misses
(long documents, few lengths) the program is run over up to all of the budget, or over its last
``REACH`` words: a budget of up to ``REACH`` words is fitted exactly, whatever the lengths. Which documents of
a length are taken is decided by a seeded hash of doc_id.

Scale: texts are read twice, once for lengths and hashes and once for the result, and whole rows
are shuffled once. The histogram is pre-aggregated before its shuffle and has a row per source,
length and hash bucket. Ranking by hash needs only the one bucket in which a length's quota ends,
so a length or source with a third of all rows is never sorted in one task, and gives the hash up
to which documents are taken; the join of documents with quotas is salted. Where rows of one
doc_id and length share that last hash and only some are taken, these alone are numbered. Sources
and their targets are a table, of any number.

Defined results: null text has size 0; null source is a source of its own, last in order; words
of a source of size 0 are 0; repeated rows count and are taken each for itself (rows of equal
doc_id and length tie: either may be taken, with the same result); an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
KNAPSACK = 1 << 14
#: Words that the dynamic program gets at most where KNAPSACK doesn't do.
REACH = 1 << 23
#: Combinations of half of the lengths that are tried one and all where the dynamic program can't reach.
FEW = 1 << 20
SALTS = 8
SEED = 20240101


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """skey, source_size and target of sources(skey, words): shares of all words by weight, none above cap times its source.

    Weights go by place in the order of names. Sources are numbered by ranges of names, and the words
    that a weight of 1 gets are found by sums over them: a source whose share would exceed cap times
    its words has just these, which raises what the others get and may make more of them full; the
    sums repeat until none is added. The driver gets two numbers a round.
    """
    order = [F.col("skey") == "0", F.col("skey")]
    ranged = materialise(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    # before has a row a partition
    placed = materialise(ranged.join(F.broadcast(before), "range").select("skey", "words", weight.alias("weight")), "mix-sources")

    total = placed.agg(F.sum("words")).first()[0] or 0
    unit, full = None, F.lit(False)
    while True:
        got = placed.agg(F.sum(F.when(full, cap * F.col("words"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        more = (total - (got["taken"] or 0)) / got["open"] if got["open"] else unit or 0.0
        if more == unit:
            break
        unit = more
        full = F.lit(unit) * F.col("weight") > cap * F.col("words")
    target = F.when(full, (cap * F.col("words")).cast("double")).otherwise(F.lit(unit) * F.col("weight"))
    return placed.select("skey", F.col("words").alias("source_size"), target.alias("target"))


def _places(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8)
    at = np.flatnonzero(raw)
    byte, bit = np.nonzero(np.unpackbits(raw[at, None], axis=1, bitorder="little"))
    return at[byte] * 8 + bit


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length give the largest sum within budget (bounded subset sum, exact).

    It holds 4 bytes for each sum up to budget, in units of the lengths' common divisor.
    """
    unit = math.gcd(*lengths) or 1
    sizes, budget = [x // unit for x in lengths], budget // unit
    reach, mask, steps = 1, (1 << (budget + 1)) - 1, []
    first = np.zeros(budget + 1, np.int32)  # the step that reached a sum first
    for i, (size, n) in enumerate(zip(sizes, counts, strict=True)):
        n = min(n, budget // size)
        take = 1
        while n > 0 and not reach >> budget & 1:
            take = min(take, n)
            more = (reach << (take * size)) & mask
            more ^= more & reach
            if more:
                first[_places(more)] = len(steps)
                steps.append((i, take))
                reach |= more
            n -= take
            take *= 2
    at, out = reach.bit_length() - 1, [0] * len(lengths)
    while at:
        i, take = steps[first[at]]
        at -= take * sizes[i]
        out[i] += take
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length make up budget; lengths distinct, budget <= their sum.

    Where the last ``KNAPSACK`` words don't come out even, the dynamic program gets more room: all
    of the budget, or its last ``REACH`` words. Beyond that lie budgets of many words in long
    documents: of few lengths, all combinations are tried, one half's against the other's.
    """
    there = [int(x) for x, n in zip(lengths, counts, strict=True) if n and x]
    goal = budget - budget % (math.gcd(*there) or 1)
    best, room = _fit(lengths, counts, budget, budget, KNAPSACK), KNAPSACK
    while (best * lengths).sum() < goal and room < min(budget, REACH):
        room = min(8 * room, REACH)
        out = _fit(lengths, counts, budget, max(0, budget - room), room)
        if (out * lengths).sum() > (best * lengths).sum():
            best = out
    if (best * lengths).sum() < goal and budget > REACH:
        out = _few(lengths, counts, budget)
        best = best if out is None else out
    return best


def _few(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = FEW) -> np.ndarray | None:
    """The best counts of all, if each half of the lengths has up to ``most`` combinations."""
    kinds = sorted(((min(int(n), budget // int(x)), int(x), i) for i, (x, n) in enumerate(zip(lengths, counts, strict=True)) if 0 < x <= budget and n), reverse=True)
    halves: list[list] = [[], []]
    sizes = [1, 1]
    for kind in kinds:
        h = sizes[1] < sizes[0]
        halves[h].append(kind)
        sizes[h] *= kind[0] + 1
    if max(sizes) > most:
        return None
    sums = []
    for half in halves:
        total = np.zeros(1, np.int64)
        for n, x, _ in half:
            total = (total[:, None] + np.arange(n + 1, dtype=np.int64) * x).ravel()
        sums.append(total)
    order = np.argsort(sums[1], kind="stable")
    fits = np.flatnonzero(sums[0] <= budget)
    other = order[np.searchsorted(sums[1][order], budget - sums[0][fits], side="right") - 1]
    at = int(np.argmax(sums[0][fits] + sums[1][other]))
    out = np.zeros(len(lengths), dtype=np.int64)
    for half, rest in zip(halves, (int(fits[at]), int(other[at])), strict=True):
        for n, _, i in reversed(half):
            rest, out[i] = divmod(rest, n + 1)
    return out


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, even: int, room: int) -> np.ndarray:
    """An even share of ``even`` words, the longest that fit, the dynamic program over about room words."""
    out = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return out
    out[:] = [int(c) * even // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
    left = budget - int((out * lengths).sum())
    longest = np.argsort(-lengths, kind="stable")
    for i in longest:
        if left <= room:
            break
        if lengths[i]:
            more = int(min(counts[i] - out[i], (left - room // 2) // lengths[i]))
            if more > 0:
                out[i] += more
                left -= more * int(lengths[i])
    fits = [i for i in longest if 0 < lengths[i] <= left and counts[i] > out[i]]
    if left <= 2 * room:
        got = knapsack([int(lengths[i]) for i in fits], [int(counts[i] - out[i]) for i in fits], left)
    else:  # what fits is longer than left - room / 2 here: one document, the longest
        got = [int(k == 0) for k in range(len(fits))]
    for i, n in zip(fits, got, strict=True):
        out[i] += n
    return out


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, cap: int = MAX_REPEATS, key: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Every row of docs with size, source_size, target and times (0 to cap).

    The struct ``row`` holds the columns named in carry, or all: these are what is shuffled.
    """
    src = F.col(f"`{source}`").cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in (docs.columns if carry is None else carry))).alias("row"),
        F.when(src.isNull(), "0").otherwise(F.concat(F.lit("1"), src)).alias("skey"),
        n_words(F.col(f"`{text}`").cast("string")).alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string")).alias("h"),
    ).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))

    thin = materialise(rows.select("skey", "size", "h", "bucket"), "mix-thin")
    hist = materialise(thin.groupBy("skey", "size", "bucket").agg(F.count("*").alias("n")), "mix-hist")
    goals = targets(hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("words")), weights, cap)

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        words, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(cap, int(target // words)) if words else 0
        budget = min(words, round(target) - base * words) if base < cap else 0
        pdf = pdf.sort_values("size")
        pdf["k"] = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget)
        return pdf.assign(base=base)[["skey", "size", "k", "base", "source_size", "target"]]

    quota = hist.groupBy("skey", "size").agg(F.sum("n").alias("n")).join(goals, "skey").groupBy("skey").applyInPandas(
        quotas, "skey string, size long, k long, base int, source_size long, target double"
    )
    # the bucket in which a quota ends, and how many documents of that bucket it takes
    before = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = hist.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = (
        ends.join(quota, ["skey", "size"])
        .groupBy("skey", "size", "k", "base", "source_size", "target")
        .agg(F.max(F.when(F.col("before") < F.col("k"), F.struct("bucket", "before"))).alias("last"))
        .select("skey", "size", "base", "source_size", "target", F.coalesce("last.bucket", F.lit(-1)).alias("cut"), (F.col("k") - F.col("last.before")).alias("within"))
    )
    cut = materialise(cut, "mix-cut")
    # the hash at which it ends there, how many rows have it, and how many of these are taken
    there = thin.join(cut.filter("within IS NOT NULL").select("skey", "size", F.col("cut").alias("bucket"), "within"), ["skey", "size", "bucket"])
    there = there.groupBy("skey", "size", "bucket", "within", "h").agg(F.count("*").alias("n"))
    lower = Window.partitionBy("skey", "size", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    there = there.withColumn("most", F.col("within") - F.coalesce(F.sum("n").over(lower), F.lit(0))).filter("most BETWEEN 1 AND n")
    cut = materialise(cut.drop("within").join(there.select("skey", "size", F.col("h").alias("end"), "n", "most"), ["skey", "size"], "left"), "mix-ends")

    salted = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["skey", "size", "salt"])
    ended = (F.col("bucket") == F.col("cut")) & (F.col("h") <= F.col("end"))  # hashes of a bucket are of one sign
    dealt = dealt.withColumn("extra", ((F.col("bucket") < F.col("cut")) | F.coalesce(ended, F.lit(False))).cast("int"))
    if not cut.filter("most < n").isEmpty():
        tied = F.coalesce((F.col("h") == F.col("end")) & (F.col("most") < F.col("n")), F.lit(False))
        place = F.row_number().over(Window.partitionBy("skey", "size").orderBy("h"))
        some = dealt.filter(tied).withColumn("place", place).withColumn("extra", (F.col("place") <= F.col("most")).cast("int")).drop("place")
        dealt = dealt.filter(~tied).unionByName(some)
    return dealt.select("row", "size", "source_size", "target", (F.col("base") + F.col("extra")).alias("times"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a document taken twice is there twice, one not taken isn't."""
    out = mix(docs, **options).filter("times > 0")
    return out.select(F.explode(F.sequence(F.lit(1), F.col("times"))), "row").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs, carry=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times"
    )
