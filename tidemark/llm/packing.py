"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

1. Tokenise: text -> ids, then id 0; documents above the capacity are cut into pieces of it.
   Words are encoded once per worker: white space separates this tokenizer's words, so the ids
   of a text are those of its white-space-delimited chunks, one after the other. A comma or full
   stop after a letter is a chunk of its own.
2. Pieces are dealt evenly over partitions of at most ``PARTITION`` pieces; each runs best-fit
   decreasing and compares its bins with lower bounds from dual feasible functions
   (:func:`lower_bound`). One that meets them is certified: its pieces alone can't take fewer
   bins. If its gaps are less than a bin it gives up its emptiest bin only; otherwise others'
   pieces may fill its gaps, and it gives up a share of its emptiest bins; one that isn't certified
   may be packed better and gives up a larger share.
3. What was given up is pooled, whole bins at a time, dealt anew over fewer partitions and
   packed again (the old bins stay if the new ones aren't fewer), until one partition is left,
   nothing is given up, or all bins together meet the bound of all pieces: that certifies the
   whole packing, and no exchange could save a bin.

Each piece says whether the partition that closed its bin, or the whole, was certified.

No task holds more than about ``PARTITION`` pieces, whatever the documents. The packed pieces
hold no text. Defined results: null text is empty (one piece, the id 0); repeated rows are
packed each for itself; null doc_ids stay null; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import materialise

CAPACITY = 2048
PARTITION = 20_000
#: Bytes of words and their ids in a generation of a worker's cache.
CACHED_BYTES = 24 << 20
#: Shares of the bins that certified partitions with gaps and others give up.
GIVEN_UP, UNSURE = 0.25, 0.5
MAX_ROUNDS = 8

_tokenizers: dict[str, tuple] = {}
#: Bytes of characters from U+0300 on, where combining marks are, but for U+2000 to U+203F: dashes, quotes and the like.
_MARKS = re.compile(rb"[\xcc-\xe1\xe3-\xff]|\xe2[^\x80]")
#: Bytes below those that begin such a mark; a text of no others needs no search.
_LATIN = bytes(range(0xCC))
#: What byte-level vocabularies write for bytes that aren't printable Latin-1 characters.
_BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Signs right after a letter: no token holds both, so a space between them changes none.
_COMMA, _STOP = re.compile(rb",(?<=[a-z],)"), re.compile(rb"\.(?<=[a-z]\.)")


def _is_plain(word: bytes) -> bool:
    """Whether a word is of letters without marks that stay such in lower case: no mark can join what follows."""
    if not word or _MARKS.search(word):
        return False
    text = word.decode()
    return text.isalpha() and text.lower().isalpha()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str):
    """text -> ids as little-endian unsigned 32-bit bytes.

    Words are kept in two generations: a full young one becomes the old one, and a word found there
    moves up, so common words stay and what is held never exceeds twice ``CACHED_BYTES``.
    """
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        _tokenizers[path] = (tok, {"young": {}, "old": {}, "held": 0})
    tok, words = _tokenizers[path]
    model = tok.model

    def put(found: dict[bytes, bytes]) -> None:
        words["young"].update(found)
        words["held"] += sum(map(len, found)) + sum(map(len, found.values())) + 150 * len(found)

    def recall(chunks: set[bytes]) -> set[bytes]:
        """Those of chunks that no generation has; what the old one has moves up."""
        missing = chunks.difference(words["young"])
        put(moved := {w: ids for w, ids in zip(missing, map(words["old"].get, missing), strict=True) if ids is not None})
        return missing.difference(moved)

    def ids_of(new: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words of plain letters go to the model at once: what is before it lowers them and keeps them whole."""
        other = []
        for w in new:
            if w.isalpha() or _is_plain(w):
                text = w.decode().lower()
                tokens = model.tokenize(text if w.isascii() else text.encode().decode("latin-1").translate(_BYTE_CHARS))
                yield w, struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            else:
                other.append(w)
        if other:
            for w, e in zip(other, tok.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
                yield w, np.array(e.ids, dtype="<u4").tobytes()

    def learn(chunks: set[bytes]) -> None:
        whole, parts, split = [], set(), []
        for c in chunks:
            word = c.rstrip(b".,!*%$&#?;:")
            if len(word) < len(c) and (word.isalpha() or _is_plain(word)):
                split.append((c, word, c[len(word):]))
                parts.update(split[-1][1:])
            else:
                whole.append(c)
        if new := [*whole, *recall(parts.difference(whole))]:
            put(dict(ids_of(new)))
        young = words["young"]
        put({c: young[word] + young[rest] for c, word, rest in split})

    def encode(text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "replace")
        if not raw.translate(None, _LATIN) or not _MARKS.search(raw):  # T with a mark may compose otherwise than t with it
            raw = _STOP.sub(b" .", _COMMA.sub(b" ,", raw.lower()))
        chunks = raw.split()
        if words["held"] > CACHED_BYTES:
            words.update(young={}, old=words["young"], held=0)
        found = list(map(words["young"].get, chunks))
        if not all(found):
            if new := recall(set(compress(chunks, map(not_, found)))):
                learn(new)
            found = map(words["young"].__getitem__, chunks)
        return b"".join(found) + b"\0\0\0\0"

    return encode


def tokenised(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 (and ids, as little-endian bytes)."""
    path = tokenizer or default_tokenizer()
    slim = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types[: len(names)], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        hashing.release()  # what earlier stages left in this worker
        pa.default_memory_pool().release_unused()
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                ids = encode(text.as_py())
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), schema.types, strict=True)], schema=schema)

    sql = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return slim.mapInArrow(run, sql)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the bins' fills. Ties go to the bin opened first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = open_ >> n
        if fitting:
            room = n + ((fitting & -fitting).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                open_ &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        by_room[room - n].append(b)
        open_ |= 1 << (room - n)
    return bins, offsets, fills


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """Bins that any packing of the lengths (each as often as counts say) needs: the best of two families of dual feasible functions.

    f_t (t up to half the capacity): items above capacity - t count as full, items below t not
    at all. u_k: an item x counts as floor((k + 1) x / capacity) / k, or as x / capacity where
    (k + 1) x is a multiple of the capacity.
    """
    if not len(lengths):
        return 0
    n = np.zeros(capacity + 1, np.int64)
    np.add.at(n, lengths, 1 if counts is None else counts)
    size = np.arange(capacity + 1)
    words, count = np.cumsum(n * size), np.cumsum(n)
    best = -(-int(words[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        above = int(count[-1] - count[capacity - t])
        middle = int(words[capacity - t] - words[t - 1])
        best = max(best, above + -(-middle // capacity))
    for k in range(1, 65):
        whole = (k + 1) * size % capacity == 0
        worth = np.where(whole, k * size, (k + 1) * size // capacity * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((n * worth).sum()) // (k * capacity)))
    return best


def _pack_partition(capacity: int, last: bool, round_: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        ids = (np.int64(round_) << 56) | (np.int64(key[0]) << 24) | bins
        old = pdf["sequence_id"]
        if round_ and old.nunique() <= len(fills):
            bins, uniques = pd.factorize(old)
            fills = np.bincount(bins, weights=lengths).astype(int).tolist()
            ids, offsets = old.to_numpy(), pdf["offset"].to_numpy()
        bound = lower_bound(lengths, capacity)
        given = np.zeros(len(fills), bool)
        if not last:
            gaps = capacity - np.array(fills)
            order = np.argsort(-gaps, kind="stable")
            tight = len(fills) == -(-int(lengths.sum()) // capacity)
            most = 1 if tight else max(1, int(len(fills) * (GIVEN_UP if len(fills) == bound else UNSURE)))
            given[order[:most]] = gaps[order[:most]] > 0
        return pdf.drop(columns="part").assign(sequence_id=ids, offset=offsets, given_up=given[bins], certified=len(fills) == bound)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition: int = PARTITION) -> DataFrame:
    """pieces (with a length of 1 to capacity) plus sequence_id, offset and certified."""
    base = pieces.schema
    pool = materialise(
        pieces.withColumns({"piece_id": F.monotonically_increasing_id(), "sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}), "pieces"
    )
    lengths = pool.groupBy("length").agg(F.count("*").alias("n")).toPandas().sort_values("length")  # at most capacity rows
    n, parts, done, closed = int(lengths["n"].sum()), None, [], 0
    bound = lower_bound(lengths["length"].to_numpy(np.int64), capacity, lengths["n"].to_numpy(np.int64))
    columns = [*base.names, "piece_id", "sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema) + ", given_up boolean, certified boolean"
    for round_ in range(MAX_ROUNDS):
        before, parts = parts, max(1, -(-n // partition))
        last = parts == 1 or round_ == MAX_ROUNDS - 1 or before is not None and parts > 0.9 * before
        by = F.col("sequence_id") if round_ else F.col("piece_id")
        dealt = pool.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
        out = dealt.groupBy("part").applyInPandas(_pack_partition(capacity, last, round_), schema)
        if last and not done:
            return out.select(*base.names, "sequence_id", "offset", "certified")
        out = materialise(out, f"packed-{round_}")
        bins = out.filter("offset = 0").groupBy("given_up").count().collect()
        if closed + sum(r["count"] for r in bins) <= bound:
            done = [d.withColumn("certified", F.lit(True)) for d in [*done, out]]
            break
        closed += sum(r["count"] for r in bins if not r["given_up"])
        done.append(out.filter(~F.col("given_up")))
        pool = out.filter("given_up").select(*columns)
        n = 0 if last else pool.count()
        if not n:
            break
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(*base.names, "sequence_id", "offset", "certified")


def digest(docs: DataFrame, **options) -> DataFrame:
    return pack(tokenised(docs, **options))
