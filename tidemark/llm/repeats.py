"""Exact removal of repeated byte strings: positions ranked at growing lengths until unique or at the threshold.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too. Suffix-array
doubling ranks every position by its first h bytes, then by pairs of ranks at growing offsets, and
leaves out what has become unique. Here positions ride in blocks, so that Spark ranks a few rows in
a thousand bytes instead of one a byte:

* The anchor of a position is the first smallest hash among the ``GRAM``-byte grams inside its
  string. Equal strings have their anchor at the same offset, so only positions of one offset
  d to anchors of equal grams can be equal. Offsets are 0 to 255.
* A block is a range of offsets to one anchor. Two strings tell about it: the shared one, which all
  strings of the block contain, and the whole one, which they make up together. A block whose shared
  string is unique has no repeat: it's left out. Blocks with equal whole strings are repeats at
  every offset: they are done. What's left is split in 16 and ranked again by its longer shared
  strings: 145 bytes, 385, and in the end the 400 bytes of one position, where both strings are one.
* Of the blocks that are done, one of each kind stays as a partner for what is left, so no repeat is
  lost and copies cost nothing.

Each round is a count by the pair (shared, whole), with map-side combination, and joins by it: no group
is collected anywhere, however many rows share a passage. Rows hold hashes; the bytes around the
anchors left after the first round, the edges of repeated passages, are written once. Hashes of whole
strings are 64 bits of BLAKE2 beside 64 of the shared string. A text is read in steps of ``STEP`` bytes.

Defined results: a null text is empty; texts below the threshold lose nothing; repeated rows repeat
each other and lose all bytes if they're long enough; rows without doc_id are like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .hashing import mixed

LENGTH = 400
#: Offsets of a block in each round; the first one's are all that a gram of LENGTH + 1 - WIDTHS[0] bytes leaves.
WIDTHS = (256, 16, 1)
#: Bytes of a text whose positions are looked at together.
STEP = 1 << 18
#: Rows with bytes that a task hands on at once.
ROWS = 1024

_VALUES = np.random.default_rng(20260117).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0xD1342543DE82EF95
_powers: list[tuple[np.ndarray, np.ndarray]] = []
_NONE = -(1 << 63)


def _grams(raw: bytes, size: int) -> np.ndarray:
    """Hashes of all grams of raw, whatever stands around them."""
    if not _powers or len(_powers[0][0]) < len(raw):
        both = []
        for f in (_FACTOR, pow(_FACTOR, -1, 2**64)):
            p = np.full(max(len(raw), STEP + 2 * LENGTH), f, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = [(both[0], both[1])]
    up, down = _powers[0]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[np.frombuffer(raw, np.uint8)] * up[: len(raw)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[: len(raw) - size + 1])


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest of each width neighbours; compared are the hashes' upper 44 bits."""
    n = len(h) - width + 1
    packed = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
    packed[: len(h)] = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
    rows = packed.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)


def _hash(raw: bytes, mark: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=mark.to_bytes(8, "little")).digest(), "little", signed=True)


def anchors(raw: bytes, length: int = LENGTH, width: int = WIDTHS[0]) -> list[tuple[int, int, int, int, int]]:
    """Of each anchor: place, least and largest offset of its positions, hashes of its shared and whole string."""
    out: list[list[int]] = []
    gram = length + 1 - width
    last = len(raw) - length  # the last position
    for c in range(0, last + 1, STEP):
        to = min(c + STEP, last + 1)
        h = _grams(raw[c : to - 1 + length], gram)
        at = _smallest(h, width)
        cut = np.flatnonzero(np.diff(at)) + 1
        firsts, lasts = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        for u, p, q, i in zip((at[firsts] + c).tolist(), (firsts + c).tolist(), (lasts + c).tolist(), h[at[firsts]].view(np.int64).tolist(), strict=True):
            if out and out[-1][0] == u:  # goes on in this step
                out[-1][1] = u - q
            else:
                out.append([u, u - q, u - p, i])
    return [(u, lo, hi, i, _whole(raw, u, 0, width - 1, length)) for u, lo, hi, i in out]


def _whole(raw: bytes, u: int, a: int, b: int, length: int) -> int:
    """Hash of the string of offsets a to b of the anchor u, as far as the text goes, and of where it ends before that."""
    start, end = max(0, u - b), min(len(raw), u - a + length)
    return _hash(raw[start:end], (u - start) << 32 | (end - u))


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


def _ranked(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of rows(doc, th, at, lo, hi, known, i, u): those not known that are repeated as a whole, and one of each kind that's left to split.

    i and u are the hashes of the shared and the whole string; a known row is a partner only. What is
    counted by a hash is written before rows are joined with it: beside its count, a join on a hash
    that many rows have can't be split.
    """
    again = materialise(rows.groupBy("i").agg(F.count("*").alias("n")).filter("n > 1").select("i"), f"repeats-{name}-again")
    rows = materialise(rows.join(again, "i", "left_semi"), f"repeats-{name}")
    kinds = rows.groupBy("i", "u").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "at", "lo", "hi", "known")).alias("one"))
    kinds = materialise(kinds, f"repeats-{name}-kinds")
    done = rows.filter(~F.col("known")).join(kinds.filter("n > 1").select("i", "u"), ["i", "u"], "left_semi")
    some = kinds.groupBy("i").agg(F.count("*").alias("m"), F.count_if((F.col("n") == 1) & ~F.col("one.known")).alias("unknown"))
    some = materialise(some.filter("m > 1 AND unknown > 0").select("i"), f"repeats-{name}-open")
    rest = kinds.join(some, "i", "left_semi")
    return done, rest.select("one.*", (F.col("n") > 1).alias("many")).withColumn("known", F.col("known") | F.col("many")).drop("many")


def _split(rows: Iterable[tuple], width: int, length: int) -> Iterator[tuple]:
    """Blocks of (doc, th, at, lo, hi, known, window, left) with the hashes of their strings; left is the anchor's place in the window."""
    for doc, th, at, lo, hi, known, window, left in rows:
        for a in range(lo // width * width, hi + 1, width):
            b = a + width - 1
            shared = _hash(window[left - a : left - b + length])
            yield doc, th, at, max(lo, a), min(hi, b), known, shared, _whole(window, left, a, b, length)


_IDS = [("doc", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("known", pa.bool_())]
_BLOCK = pa.schema([*_IDS, ("i", pa.int64()), ("u", pa.int64())])
_WINDOW = pa.schema([*_IDS, ("window", pa.binary()), ("left", pa.int32())])
_SQL = "doc long, th long, at long, lo int, hi int, known boolean"


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc, th, start, end: ranges of repeated bytes, which may overlap; doc and th stand for doc_id and text as in keyed()."""
    texts = keyed(docs, key, text).filter(F.octet_length("raw") >= length)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = zip(b["doc"].to_pylist(), b["th"].to_pylist(), b["raw"], strict=True)
            yield from _batches(((d, t, u, lo, hi, False, i, whole) for d, t, raw in of for u, lo, hi, i, whole in anchors(raw.as_py(), length)), _BLOCK)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(b: pa.RecordBatch) -> Iterator[tuple]:
            for d, t, raw, own in zip(b["doc"].to_pylist(), b["th"].to_pylist(), b["raw"], b["own"], strict=True):
                raw = raw.as_py()
                for x in own.as_py():
                    start = max(0, x["at"] - WIDTHS[0] + 1)
                    yield d, t, x["at"], x["lo"], x["hi"], x["known"], raw[start : x["at"] + length], x["at"] - start

        for b in batches:
            yield from _batches(each(b), _WINDOW)

    def blocks(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _batches(_split(zip(*(b[c].to_pylist() for c in _WINDOW.names), strict=True), width, length), _BLOCK)

        return run

    first = materialise(texts.select("doc", "th", "raw").mapInArrow(found, _SQL + ", i long, u long"), "repeats-anchors")
    done, rest = _ranked(first, "first")
    out = [done.withColumn("width", F.lit(WIDTHS[0]))]
    own = rest.groupBy("doc", "th").agg(F.collect_list(F.struct("at", "lo", "hi", "known")).alias("own"))
    held = materialise(texts.join(own, ["doc", "th"]).select("doc", "th", "raw", "own").mapInArrow(windows, _SQL + ", window binary, left int"), "repeats-windows")
    for width in WIDTHS[1:]:
        if width == WIDTHS[1]:
            parts = held
        else:
            parts = rest.join(held.select("doc", "th", "at", "window", "left"), ["doc", "th", "at"]).select(*_WINDOW.names)
        split = materialise(parts.mapInArrow(blocks(width), _SQL + ", i long, u long"), f"repeats-blocks-{width}")
        done, rest = _ranked(split, str(width))
        out.append(done.withColumn("width", F.lit(width)))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    a = F.floor(F.col("lo") / F.col("width")) * F.col("width")
    return every.select("doc", "th", (F.col("at") - a - F.col("width") + 1).alias("start"), (F.col("at") - a + length).alias("end"))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, raw, doc and th: equal (doc, th) are equal rows."""
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    doc_id = F.col(f"`{key}`").cast("long")
    return docs.select(doc_id.alias("doc_id"), raw.cast("binary").alias("raw"), F.coalesce(doc_id, F.lit(_NONE)).alias("doc"), F.xxhash64(raw).alias("th"))


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end, maximal and in order) and kept (the other bytes) of every document."""
    own = spans(docs, key, text, length).groupBy("doc", "th").agg(F.collect_set(F.struct("start", "end")).alias("own"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, every, kept = [], [], []
            for raw, found in zip(b["raw"], b["own"], strict=True):
                raw, merged = raw.as_py(), []
                for s, e in sorted((max(0, x["start"]), min(len(raw), x["end"])) for x in found.as_py() or []):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                lengths.append(len(raw))
                every.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            columns = [b["doc_id"], pa.array(lengths, pa.int64()), pa.array(every, pa.list_(span)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])

    both = keyed(docs, key, text).join(own, ["doc", "th"], "left").select("doc_id", "raw", "own")
    return both.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    rows = cut(docs).withColumn("n_removed", F.col("n_bytes") - F.octet_length("kept"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
