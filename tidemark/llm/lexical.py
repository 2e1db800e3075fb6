"""Ranked lexical search: shards of postings in variable blocks, searched with block-max skipping.

The index. Tasks cut their documents into shards of up to ``SHARD`` postings and write, for each
term of a shard, the documents that hold it and how often. Nothing is shuffled. A shard's documents
are numbered by ascending doc_id, so ties in score go to the smaller number.

The search. Document counts, lengths and document frequencies are sums over the index. Postings of
the queries' terms are brought together by shard; each shard is searched alone:

1. A posting's score is exact integer arithmetic, so a block's bound is the largest one in it.
   Dynamic programming (:func:`boundaries`) cuts every list into blocks of varying length, up to
   ``LONGEST`` postings, such that the bounds' excess over the scores, plus a price a block, is least.
2. For a query the block bounds of its terms are added up between all their boundaries: between
   two neighbouring ones the sum bounds every document's score. That is WAND's pivot test, made for
   whole runs of documents. The threshold starts at the best term's k-th score; runs whose bound is
   below it are skipped, the others are scored in groups of falling bound, and the threshold rises to
   the k-th score found. A run is scored from the blocks that reach into it; no others are read.

A run is skipped only if its bound is below the threshold, so the k best of a shard are exact, and
so are the k best of all shards, ties included.

What is bounded: a shard by its postings (or one document); queries go through in blocks of about
``BLOCK`` bytes of terms, each of which is sent to the tasks; a shard returns k rows a query, and
these are ranked in two steps, so that no task gets all shards' rows of one query at once.

Defined results: a null text, or one without a term, isn't a document; rows are documents of their
own, whatever their ids, those without doc_id come last among equals; rows of one item_id are one
item with all their terms, null ids too; items without a term, or an empty table, have no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A shard's postings (a document more, at most), and documents.
SHARD, SHARD_DOCS = 4_000_000, 1 << 17
#: Postings of the longest block, and a block's price in mean scores of its list.
LONGEST, PRICE = 64, 4
#: Bytes of the terms of queries that go through together.
BLOCK = 8 << 20
#: Documents that are scored before the threshold is looked at again: at first, and the growth.
GROUP, GROWTH = 512, 4
SALTS = 64

_SPLIT = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
_INDEX = "shard long, term string, n int, docs array<int>, tfs array<int>, ids array<long>, words long"


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other characters' bytes, A-Z in lower case."""
    return (text or b"").translate(_SPLIT).split()


def _shard(number: int, vocabulary: dict[bytes, int], docs: list[tuple[int | None, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of docs(doc_id, words, numbers of its terms in vocabulary, how often each)."""
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    held, tfs = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d[2]) for d in docs])
    order = np.argsort(held, kind="stable")
    ends = np.cumsum(np.bincount(held, minlength=len(vocabulary)))
    offsets = pa.array([0, *ends, len(held) + len(docs)], pa.int32())  # the last row is the shard's own: numbers, words and ids of its documents
    lists = lambda x, own: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[order], own]), pa.int32()))
    rows, lengths = len(vocabulary) + 1, np.array([d[1] for d in docs], np.int64)
    names = pa.array([*vocabulary, None], pa.binary()).cast(pa.string())
    ids = pa.array([*[None] * len(vocabulary), [d[0] for d in docs]], pa.list_(pa.int64()))
    n = pa.array(np.diff([0, *ends, ends[-1] + len(docs)]), pa.int32())
    words = pa.array([*[None] * len(vocabulary), int(lengths.sum())], pa.int64())
    columns = [pa.array(np.full(rows, number), pa.int64()), names, n, lists(owner, np.arange(len(docs))), lists(tfs, lengths), ids, words]
    return pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in _INDEX.split(", ")])


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """The index, a table in the shared folder: a row for each shard and term, and one (without term) for each shard."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, vocabulary, held, postings = TaskContext.get().partitionId() << 32, {}, [], 0
        for b in batches:
            for doc_id, raw in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                found = Counter(terms(raw.as_py()))
                if found:
                    own = np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in found), np.int32, len(found))
                    tfs = np.fromiter(found.values(), np.int32, len(found))
                    held.append((doc_id, int(tfs.sum()), own, tfs))
                    postings += len(own)
                if postings >= shard or len(held) >= SHARD_DOCS:
                    yield _shard(number, vocabulary, held)
                    number, vocabulary, held, postings = number + 1, {}, [], 0
        if held:
            yield _shard(number, vocabulary, held)

    return materialise(rows.mapInArrow(run, _INDEX), "lexical-index")


def boundaries(scores: np.ndarray, lengths: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> np.ndarray:
    """Starts of the blocks of lists that stand one after the other, by dynamic programming over all lists at once.

    The least sum, over a list's blocks, of price x the list's mean score + the excess of the block's
    largest score over each of its scores, among all cuts into blocks of up to longest scores.
    """
    order = np.argsort(-lengths, kind="stable")
    first = np.cumsum(lengths) - lengths
    long_, starts = lengths[order], first[order]
    n, s = len(lengths), scores.astype(np.float64)
    cost = price * (np.add.reduceat(s, first) / lengths)[order]
    least, total = np.zeros(n), np.zeros(n)  # of what stands before the current score
    before, sums, tops = np.full((n, longest), np.inf), np.zeros((n, longest)), np.zeros((n, longest))
    taken = np.zeros(len(s), np.int32)
    active = np.searchsorted(-long_, -np.arange(long_[0] if n else 0), side="left")  # lists longer than j
    slots = np.arange(longest)
    for j, a in enumerate(active.tolist()):
        x, slot = s[starts[:a] + j], j % longest
        before[:a, slot], sums[:a, slot], tops[:a, slot] = least[:a], total[:a], 0
        np.maximum(tops[:a], x[:, None], out=tops[:a])
        total[:a] += x
        size = (j - slots) % longest + 1  # of the block that starts at each slot
        whole = before[:a] + size * tops[:a] - total[:a, None] + sums[:a]
        at = whole.argmin(axis=1)
        taken[starts[:a] + j] = size[at]
        least[:a] = whole[np.arange(a), at] + cost[:a]
    out, at = [], starts + long_ - 1  # back from the lists' ends
    while len(at):
        first = at - taken[at] + 1
        out.append(first)
        more = first > starts
        at, starts = first[more] - 1, starts[more]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def posting_scores(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    tf, m = tf.astype(np.int64), 50 + 50 * length.astype(np.int64) * n // max(total, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Shard:
    """Postings of a shard's terms, in blocks, ready for queries."""

    def __init__(self, names: list[str], docs: list[np.ndarray], tfs: list[np.ndarray], weights: list[int], lengths: np.ndarray, n: int, total: int):
        self.n_docs = len(lengths)
        self.docs, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        self.scores = posting_scores(np.repeat(np.array(weights, np.int64), sizes), np.concatenate(tfs), lengths[self.docs], n, total)
        self.starts = boundaries(self.scores, sizes)
        self.ends = np.append(self.starts[1:], len(self.docs))
        self.first, self.last = self.docs[self.starts], self.docs[self.ends - 1]
        self.bounds = np.maximum.reduceat(self.scores, self.starts)
        at = np.cumsum(sizes) - sizes
        cut = np.searchsorted(self.starts, np.append(at, len(self.docs)))
        self.blocks = {t: (cut[i], cut[i + 1]) for i, t in enumerate(names)}
        self.lists = {t: (at[i], at[i] + sizes[i]) for i, t in enumerate(names)}
        self.read = self.whole = 0  # postings scored, postings that all queries hold
        self._kth: dict[tuple[str, int], int] = {}

    def kth(self, term: str, k: int) -> int:
        """The k-th largest score of a term's postings, 0 if there are fewer."""
        if (term, k) not in self._kth:
            a, b = self.lists[term]
            self._kth[term, k] = int(np.partition(self.scores[a:b], b - a - k)[b - a - k]) if b - a >= k else 0
        return self._kth[term, k]

    def search(self, names: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents, best first."""
        own = [t for t in names if t in self.blocks]
        if not own:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = np.concatenate([np.arange(*self.blocks[t]) for t in own])
        self.whole += sum(b - a for a, b in (self.lists[t] for t in own))
        first, last, bounds = self.first[blocks], self.last[blocks], self.bounds[blocks]
        jumps = np.zeros(self.n_docs + 1, np.int64)
        np.add.at(jumps, first, bounds)
        np.add.at(jumps, last + 1, -bounds)
        edges = np.unique(np.concatenate([first, last + 1]))
        runs, bound = edges[:-1], np.cumsum(jumps)[edges[:-1]]
        sizes = np.diff(edges)
        least = max(1, max(self.kth(t, k) for t in own))
        order = np.argsort(-bound, kind="stable")
        docs, scores, at, group = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, GROUP
        reach = np.cumsum(sizes[order])
        while at < len(order) and bound[order[at]] >= least:
            alive = int(np.searchsorted(-bound[order], -least, side="right"))
            to = min(alive, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + group)) + 1)
            live = np.zeros(self.n_docs + 1, np.int64)
            chosen = order[at:to]
            np.add.at(live, runs[chosen], 1)
            np.add.at(live, runs[chosen] + sizes[chosen], -1)
            inside = np.cumsum(live) > 0
            seen = np.concatenate([[0], np.cumsum(inside)])
            hit = blocks[seen[last + 1] > seen[first]]
            if len(hit):
                width = self.ends[hit] - self.starts[hit]
                p = np.repeat(self.starts[hit] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                p = p[inside[self.docs[p]]]
                self.read += len(p)
                d, back = np.unique(self.docs[p], return_inverse=True)
                docs = np.concatenate([docs, d])
                scores = np.concatenate([scores, np.bincount(back, weights=self.scores[p], minlength=len(d)).astype(np.int64)])  # sums stay below 2 ** 53
                best = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[best], scores[best]
                if len(scores) == k:
                    least = max(least, int(scores[-1]))
            at, group = to, group * GROWTH
        keep = scores > 0
        return docs[keep], scores[keep]


def _weights(df: dict[str, int], n: int) -> dict[str, int]:
    return {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}


def search(index: DataFrame, items: DataFrame, k: int = 50, key: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """item, rank, doc_id, score: the k best documents of build()'s index for every item."""
    spark, kind = index.sparkSession, items.schema[key].dataType.simpleString()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [list(dict.fromkeys(terms(x.as_py()))) for x in b["text"]]
            rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
            names = pa.array([t for x in own for t in x], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b["item"].take(pa.array(rows, pa.int64())), names], names=["item", "term"])

    raw = items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    pairs = materialise(raw.mapInArrow(asked, f"item {kind}, term string").distinct(), "lexical-queries")
    n, total = index.filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    size = pairs.agg(F.sum(F.octet_length("term") + 40)).first()[0]
    result = None
    if n and size:
        blocks = -(-size // block)
        pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        for b in range(blocks):
            found = _search_block(index, pairs.filter(F.col("block") == b).select("item", "term"), n, total, k, kind)
            result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], f"item {kind}, rank int, doc_id long, score long")
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for by in (["item", "salt"], ["item"]):
        result = result.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("rank") <= k)
    return result.select("item", "rank", "doc_id", "score")


def _search_block(index: DataFrame, pairs: DataFrame, n: int, total: int, k: int, kind: str) -> DataFrame:
    """The k best of every shard; pairs are about BLOCK bytes."""
    wanted = pairs.select("term").distinct()
    postings = index.join(wanted, "term", "left_semi")
    weights = _weights({r["term"]: r["df"] for r in postings.groupBy("term").agg(F.sum("n").alias("df")).collect()}, n)
    queries: dict = {}
    for item, term in pairs.collect():
        queries.setdefault(item, []).append(term)
    shared = index.sparkSession.sparkContext.broadcast((weights, sorted(queries.items(), key=str)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        weights, queries = shared.value
        head, rows = pdf[pdf["term"].isna()].iloc[0], pdf[pdf["term"].notna()]
        found = []
        if len(rows):
            names = rows["term"].tolist()
            shard = Shard(names, rows["docs"].tolist(), rows["tfs"].tolist(), [weights[t] for t in names], head["tfs"], n, total)
            for item, own in queries:
                found += [(item, head["ids"][d], s) for d, s in zip(*(x.tolist() for x in shard.search(own, k)), strict=True)]
        return pd.DataFrame(found, columns=["item", "doc_id", "score"], dtype=object).assign(salt=int(head["shard"]) % SALTS)

    whole = postings.select(index.columns).unionByName(index.filter("term IS NULL"))
    return whole.select("shard", "term", "docs", "tfs", "ids").groupBy("shard").applyInPandas(run, f"item {kind}, doc_id long, score long, salt long")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build(docs), items).withColumnRenamed("item", "item_id")


def oracle() -> str:
    """DuckDB's SQL of the digest over documents and benchmark."""
    split = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {split} AS t FROM documents),
    counted AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM docs WHERE len(t) > 0),
    queries AS MATERIALIZED (SELECT DISTINCT item_id, unnest({split}) AS term FROM benchmark),
    tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM queries) GROUP BY r, term),
    weights AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), counted),
    posting AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * n) // l))) AS s FROM tf JOIN docs USING (r) JOIN weights USING (term), counted),
    scored AS (SELECT item_id, r, sum(s)::BIGINT AS score FROM queries JOIN posting USING (term) GROUP BY item_id, r)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
      SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN docs USING (r) WHERE score > 0) WHERE rank <= 50"""
