"""Language-model scoring from a log-frequency Bloom filter.

Model. Counts of words and word pairs over all training texts are quantised on a logarithmic
scale (level 1 + floor(log_BASE count)); an n-gram of level q is put into a Bloom filter q
times, as (n-gram, 1) to (n-gram, q). A probe asks for (n-gram, 1), (n-gram, 2), ... until one is
missing and so finds the level, never a lower one. Probabilities are smoothed:

    P(w | v) = (C(v w) + MU * P(w)) / (C(v) + MU),   P(w) = (C(w) + 1) / (N + V + 1)

with C what probes find, N training tokens and V distinct ones. A text's score sums log10 P.

Scale. The filter grows with the corpus: BITS bits for each level of each n-gram, in segments by
the n-gram's hash, sized so that each is made in one task from counts that were added up before
the shuffle. There are at most ``MOST_TASKS`` such tasks, whatever the corpus: counts come sorted by
segment, and a task holds those of one segment at a time. Exact counts of words, for the unsmoothed base score, stand beside the words'
segments. If all of it takes at most ``MAX_BROADCAST`` bytes, which is read before anything is
sent, it comes to the driver in slices of ``SLICE`` bytes, is broadcast, and the broadcast is
destroyed when the scores are written. Otherwise it stays in its table and the probes travel: the
distinct n-grams of every ``FLUSH`` tokens of text go to their segments, once, and the counts
found there come back to the texts. N-grams that nearly every batch holds would all ask the one
segment that has them, so those of at least one occurrence in ``size / HOT`` bytes of training text,
of which there are at most ``HOT`` words and as many pairs, are answered by a broadcast of their counts
instead. Both ways ask the same filter and give the same scores.

Defined results: null and wordless texts are the end token alone; without training texts N and
V are 0; repeated rows count, and are scored, each for itself; null doc_ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise
from .hashing import mixed, word_hashes

BASE = 1.5
BITS, PROBES = 10, 6
MU = 50.0
SEGMENT_TEXT = 8 << 20
MAX_BROADCAST = 192 << 20
SLICE = 12 << 20
FLUSH = 2_000_000
MOST_TASKS = 10_000
#: Words, and pairs, that are answered by broadcast where the filter is too large for one; 24 bytes each.
HOT = 1 << 19
HOT_ENTRY = np.dtype([("key", "<u8"), ("found", "<f8"), ("exact", "<i8")])
END = np.uint64(0x656E64206F662074)
MAX_LEVEL = 110  # BASE ** MAX_LEVEL > 2 ** 63


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def _values() -> np.ndarray:
    """The count that a level stands for: the geometric mean of its first and last counts."""
    out = [0.0]
    for q in range(1, MAX_LEVEL + 1):
        low, high = np.ceil(BASE ** (q - 1) - 1e-9), np.ceil(BASE**q - 1e-9) - 1
        out.append(float(np.sqrt(low * max(low, high))))
    return np.array(out)


VALUES = _values()


def tokens(texts) -> Iterator[np.ndarray]:
    """Hashes of each text's words and the end, in order; texts is a column or a list."""
    for h in word_hashes(t if t is None or isinstance(t, str) else t.as_py() for t in texts):
        yield np.append(h, END)


def pair_hashes(t: np.ndarray) -> np.ndarray:
    return mixed(t[:-1] * np.uint64(0x9E3779B97F4A7C15) + t[1:])


def _hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    a = mixed(keys + np.uint64((level * 0xD1B54A32D192ED03) % 2**64))
    return a, mixed(a ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


class Filter:
    """Bloom filter segments, one after the other in raw, chosen by n-gram hash."""

    def __init__(self, sizes: dict[int, int], of: int):
        """Room for segments of so many bytes."""
        self.of = of
        self.offset, self.bits = np.zeros(of, np.uint64), np.zeros(of, np.uint64)
        at = 0
        for s, n in sorted(sizes.items()):
            self.offset[s], self.bits[s] = at * 8, n * 8
            at += n
        self.raw = np.zeros(at, np.uint8)

    def put(self, seg: int, raw: bytes) -> None:
        at = int(self.offset[seg]) // 8
        self.raw[at : at + len(raw)] = np.frombuffer(raw, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.bits[(keys % np.uint64(self.of)).astype(np.int64)] > 0

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """What the filter knows of each key's count; 0 where its segment is empty."""
        level = np.zeros(len(keys), np.int64)
        open_ = np.flatnonzero(self.has(keys))
        for q in range(1, MAX_LEVEL + 1):
            open_ = self._set(open_, keys, q)
            if not len(open_):
                break
            level[open_] = q
        return VALUES[level]

    def _set(self, open_: np.ndarray, keys: np.ndarray, q: int) -> np.ndarray:
        """Of open_, the places of keys whose bits of level q are all set; each probe asks for what is left."""
        k = keys[open_]
        seg = (k % np.uint64(self.of)).astype(np.int64)
        a, b = _hashes(k, q)
        bits, offset = self.bits[seg], self.offset[seg]
        for i in range(PROBES):
            at = (a + np.uint64(i) * b) % bits + offset
            hit = (self.raw[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            open_, a, b, bits, offset = (x[hit] for x in (open_, a, b, bits, offset))
        return open_


def make_filter(keys: np.ndarray, counts: np.ndarray) -> bytes:
    level = levels_of(counts)
    n_bytes = max(8, int(level.sum()) * BITS // 8 + 1)
    raw = np.zeros(n_bytes * 8, np.uint8)
    bits = np.uint64(n_bytes * 8)
    for q in range(1, int(level.max()) + 1 if len(level) else 1):
        a, b = _hashes(keys[level >= q], q)
        for i in range(PROBES):
            raw[((a + np.uint64(i) * b) % bits).astype(np.int64)] = 1
    return np.packbits(raw, bitorder="little").tobytes()


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


SEGMENT = "kind int, seg int, of int, n long, total long, filter binary, keys binary, counts binary, hot binary"


def train(texts: DataFrame, most_tasks: int = MOST_TASKS, hot: int = HOT) -> DataFrame:
    """Segments of texts(text): kind (1: words, 2: pairs), seg, of, n, filter; words' keys and counts; frequent n-grams."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    of = max(4, -(-size // SEGMENT_TEXT))
    often = max(2, -(-size // hot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            words = np.concatenate(held)
            pairs = np.concatenate([pair_hashes(t) for t in held])
            held.clear()
            for kind, keys in ((1, words), (2, pairs)):
                keys, c = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), kind, np.int32)), pa.array((keys % np.uint64(of)).astype(np.int32)), pa.array(keys.astype(np.int64)), pa.array(c.astype(np.int64))], names=["kind", "seg", "key", "c"]
                )

        for b in batches:
            for t in tokens(b.column(0)):
                held.append(t)
                n += len(held[-1])
                if n > FLUSH:
                    yield from flush()
                    n = 0
        yield from flush()

    def segment(kind: int, seg: int, parts: list) -> pa.RecordBatch:
        keys, c = _added(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
        raw = make_filter(keys, c)
        exact = (keys.tobytes(), c.tobytes()) if kind == 1 else (b"", b"")
        row = [kind, seg, of, len(keys), int(c.sum()), raw, *exact, _frequent(keys, c, raw, often)]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["kind", "seg", "of", "n", "total", "filter", "keys", "counts", "hot"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []
        for b in batches:
            kind, seg, key, c = (np.asarray(x) for x in b.columns)
            cuts = [0, *(np.flatnonzero((kind[1:] != kind[:-1]) | (seg[1:] != seg[:-1])) + 1).tolist(), len(kind)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                here = int(kind[at]), int(seg[at])
                if here != own:
                    if parts:
                        yield segment(*own, parts)
                    own, parts = here, []
                parts.append((key[at:end].astype(np.uint64), c[at:end].copy()))
        if parts:
            yield segment(*own, parts)

    counted = texts.select("text").mapInArrow(count, "kind int, seg int, key long, c long")
    dealt = counted.repartition(min(2 * of, most_tasks), "kind", "seg").sortWithinPartitions("kind", "seg")
    return materialise(dealt.mapInArrow(build, SEGMENT), "lm")


def _frequent(keys: np.ndarray, counts: np.ndarray, raw: bytes, often: int) -> bytes:
    """HOT_ENTRY of each key of at least so many occurrences; found is what the segment's filter answers."""
    own = counts >= often
    out = np.zeros(int(own.sum()), HOT_ENTRY)
    out["key"], out["exact"], out["found"] = keys[own], counts[own], _alone(raw).counts(keys[own])
    return out.tobytes()


def _alone(raw: bytes) -> Filter:
    """A filter of one segment, for keys that are known to be its."""
    f = Filter({0: len(raw)}, 1)
    f.put(0, raw)
    return f


class Sorted:
    """Counts by key."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], counts[order]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), self.values.dtype)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0)


def _fetched(segments: DataFrame, of: int) -> tuple[Filter, Filter, Sorted]:
    """The words' and pairs' filters and the words' counts, fetched in slices."""
    sizes = sorted((r["kind"], r["seg"], r["bytes"], r["n"]) for r in segments.select("kind", "seg", F.octet_length("filter").alias("bytes"), "n").collect())
    words, pairs = (Filter({s: b for k, s, b, _ in sizes if k == kind}, of) for kind in (1, 2))
    v = sum(n for k, _, _, n in sizes if k == 1)
    keys, counts, at = np.zeros(v, np.uint64), np.zeros(v, np.int64), 0
    slices: list[list[tuple]] = []
    held = SLICE
    for kind, seg, n_bytes, n in sizes:
        n_bytes += 16 * n * (kind == 1)
        if held + n_bytes > SLICE or slices[-1][0][0] != kind:
            slices.append([])
            held = 0
        slices[-1].append((kind, seg))
        held += n_bytes
    for part in slices:
        kind, low, high = part[0][0], part[0][1], part[-1][1]
        for r in segments.filter((F.col("kind") == kind) & F.col("seg").between(low, high)).select("seg", "filter", "keys", "counts").collect():
            (words if kind == 1 else pairs).put(r["seg"], r["filter"])
            if kind == 1:
                n = len(r["keys"]) // 8
                keys[at : at + n], counts[at : at + n] = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)
                at += n
    return words, pairs, Sorted(keys, counts)


OUT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _by_broadcast(rows: DataFrame, segments: DataFrame, of: int, n: int, v: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(_fetched(segments, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, exact = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                got = _scores(list(tokens(part.column(1))), words.counts, pairs.counts, exact.counts, n, v)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, got)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = materialise(rows.mapInArrow(run, OUT), "lm-scores")
    shared.destroy()
    return out


def _by_probes(rows: DataFrame, segments: DataFrame, of: int, n: int, v: int) -> DataFrame:
    often: dict[int, list[np.ndarray]] = {1: [], 2: []}
    for r in segments.filter(F.octet_length("hot") > 0).select("kind", "hot").toLocalIterator():
        often[r["kind"]].append(np.frombuffer(r["hot"], HOT_ENTRY))
    hot = rows.sparkSession.sparkContext.broadcast({k: np.sort(np.concatenate([np.zeros(0, HOT_ENTRY), *x]), order="key") for k, x in often.items()})

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            numbers = []
            for size in b.column(1).cast(pa.binary()).to_pylist():
                held += len(size or b"") // 4 + 1
                numbers.append(number)
                if held > FLUSH:
                    number, held = number + 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=["doc_id", "text", "batch"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                toks = list(tokens(b.column(1).slice(at, end - at)))
                for kind, keys in ((1, np.unique(np.concatenate(toks))), (2, np.unique(np.concatenate([pair_hashes(t) for t in toks])))):
                    keys = keys[~np.isin(keys, hot.value[kind]["key"])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), kind, np.int32)), pa.array((keys % np.uint64(of)).astype(np.int32)), pa.array(keys.astype(np.int64)), pa.array(np.full(len(keys), numbers[at]))], names=["kind", "seg", "key", "batch"]
                    )

    def answer(key, asked: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        keys = asked["key"].to_numpy().astype(np.uint64)
        found, exact = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        for raw, k, c in zip(segment["filter"], segment["keys"], segment["counts"], strict=True):
            found = _alone(raw).counts(keys)
            if key[0] == 1:
                exact = Sorted(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)).counts(keys)
        return pd.DataFrame({"batch": asked["batch"], "kind": np.int32(key[0]), "key": asked["key"], "found": found, "exact": exact})

    def scored(key, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({c: [] for c in ("doc_id", "n_tokens", "n_known", "base_score", "score")})
        answers = answers.drop_duplicates(["kind", "key"])
        of_kind = {k: answers[answers["kind"] == k] for k in (1, 2)}

        def lookup(kind: int, c: str):
            asked = Sorted(of_kind[kind]["key"].to_numpy().astype(np.uint64), of_kind[kind][c].to_numpy())
            frequent = Sorted(hot.value[kind]["key"], hot.value[kind][c])
            return lambda keys: asked.counts(keys) + frequent.counts(keys)  # no key is in both

        got = _scores(list(tokens(texts["text"])), lookup(1, "found"), lookup(2, "found"), lookup(1, "exact"), n, v)
        return pd.DataFrame(dict(zip(("doc_id", "n_tokens", "n_known", "base_score", "score"), (texts["doc_id"].astype("Int64"), *got), strict=True)))

    texts = materialise(rows.mapInArrow(batched, "doc_id long, text string, batch long"), "lm-texts")
    asked = texts.mapInArrow(probes, "kind int, seg int, key long, batch long")
    held = segments.select("kind", "seg", "filter", "keys", "counts")
    answers = asked.groupBy("kind", "seg").cogroup(held.groupBy("kind", "seg")).applyInPandas(answer, "batch long, kind int, key long, found double, exact long")
    out = materialise(texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(scored, OUT), "lm-scores")
    hot.destroy()
    return out


def score(docs: DataFrame, segments: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    word = F.col("kind") == 1
    size = segments.agg(
        F.sum(F.when(word, F.col("total"))).alias("n"), F.sum(F.when(word, F.col("n"))).alias("v"), F.max("of").alias("of"), F.sum(F.octet_length("filter") + F.octet_length("keys") + F.octet_length("counts")).alias("bytes")
    ).first()
    n, v, of = size["n"] or 0, size["v"] or 0, size["of"] or 1
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    out = (_by_broadcast if (size["bytes"] or 0) <= max_broadcast else _by_probes)(rows, segments, of, n, v)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _scores(toks: list[np.ndarray], words, pairs, exact, n: int, v: int) -> list[np.ndarray]:
    """Tokens, known ones, base score and score of each text; words, pairs and exact give counts of keys."""
    lengths = np.array([len(t) for t in toks])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    t = np.concatenate(toks)
    uniq, back = np.unique(t, return_inverse=True)
    c, known = words(uniq)[back], exact(uniq)[back]
    unigram = (c + 1) / (n + v + 1)
    p = np.log10(unigram)
    inner = np.ones(len(t), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    keys, again = np.unique(pair_hashes(t)[at - 1], return_inverse=True)
    history = c[at - 1]
    both = np.minimum(pairs(keys)[again], history)
    p[at] = np.log10((both + MU * unigram[at]) / (history + MU))
    add = lambda x: np.add.reduceat(x, start)
    return [lengths, add((known > 0).astype(np.int64)), add(np.log10((known + 1) / (n + v + 1))), add(p)]


def held_out(key: Column) -> Column:
    return fold(key, 7) == 2


def digest(docs: DataFrame) -> DataFrame:
    segments = train(docs.filter(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text")))
    out = score(docs, segments)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
