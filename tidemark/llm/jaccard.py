"""N-gram Jaccard join by blocked sparse matrix products.

A document is the set of its distinct word n-grams (hashed to 64 bits); two documents link when
their sets' Jaccard similarity reaches num / den. The result is a class for each document: the
connected component of the links. No link between different sets is lost:

1. Counts. A table of ``CELLS`` counters (fixed size, whatever the input) holds how often the
   n-grams of each cell occur in all documents. It orders n-grams, rarest first.
2. Candidates. Of a set of n, the rarest n - ceil(t * n) + 1 n-grams are indexed: sets that link
   share one of these. Sets that are equal are one node from here on; index groups with the same
   members are one group.
3. Star products. In each group the member that shares most with others is its centre; blocks
   of members are multiplied with it (incidence of members by n-grams times that of the centre),
   overlap counts accumulate and pairs below the bound that the sizes imply are discarded: by
   size alone and by parity bitmaps before the product, by overlap after it. Bitmaps hold the
   parity of a set's n-grams in each of a number of cells: the cells where two differ are at
   most the n-grams where the sets do, so no pair that links is lost. Links form components.
4. Block products. A group whose members are in one component by now can add nothing. Others
   that overlap form a family (one of more than ``FAMILY`` members is left as its groups); it is
   cut into blocks of about ``BLOCK`` members, all pairs of blocks are multiplied, and the links
   found across components join these. Only sets that pass by their bitmaps are multiplied.

So a group of thousands of copies costs a row a copy, not a row a pair, and no task holds more
than two blocks. Components of many links are found by alternating large and small stars over
tables, those of up to ``ONE_TASK`` links in one task; neither come to the driver. Intermediate tables are written to the shared folder.

Defined results: null or wordless text has no n-grams, links with nothing and is a class of its
own; fewer words than n are one n-gram; a null doc_id links with nothing and has a null class;
repeated rows get a row each, of the same class. Counts and sets cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .hashing import gram_hashes, mixed, word_hashes

WIDTH = 3
NUM, DEN = 90, 100
CELLS = 1 << 20
CELL_BLOCKS = 32
BLOCK = 256
FAMILY = 4 * BLOCK
SALTS = 8
DEAL = 2000
BROADCAST = 500_000
ONE_TASK = 1_000_000
ISIN = 6_000_000

def grams(texts, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Distinct n-grams of each text, ascending."""
    for h in word_hashes(texts):
        yield np.unique(gram_hashes(h, width))


def set_hash(g: np.ndarray) -> int | None:
    """Names a set of n-grams: its class; none for the empty set."""
    return int(mixed(mixed(g).sum(keepdims=True) ^ np.uint64(len(g)))[0].astype(np.int64)) if len(g) else None


def _texts(column) -> Iterator[str | None]:
    return (t.as_py() for t in column)


def cell_counts(docs: DataFrame, width: int, cells: int = CELLS) -> np.ndarray:
    """How often n-grams of each cell occur in all documents (saturating): cells * 4 bytes."""
    per = max(1, cells // CELL_BLOCKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        for b in batches:
            held, m = [], 0
            for h in word_hashes(_texts(b.column(0))):
                held.append(gram_hashes(h, width))
                m += len(h)
                if m > cells:
                    n += np.bincount((np.concatenate(held) % np.uint64(cells)).astype(np.int64), minlength=cells)
                    held, m = [], 0
            if held:
                n += np.bincount((np.concatenate(held) % np.uint64(cells)).astype(np.int64), minlength=cells)
        n = np.minimum(n, 2**31 - 1).astype("<i4")
        parts = [(i, n[i * per : (i + 1) * per]) for i in range(cells // per)]
        parts = [(i, x.tobytes()) for i, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(x.as_py(), "<i4").astype(np.int64)
                total[i] = total[i] + x if i in total else x
        done = {i: np.minimum(x, 2**31 - 1).astype("<i4").tobytes() for i, x in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array(list(done.values()), pa.binary())], names=["block", "n"])

    schema = "block int, n binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(CELL_BLOCKS, "block").mapInArrow(add, schema).collect()
    out = np.zeros(cells, np.int32)
    for r in rows:
        out[r["block"] * per : (r["block"] + 1) * per] = np.frombuffer(bytes(r["n"]), "<i4")
    return out


def _described(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n, cls (hash of the set), index, the n-grams to index the set by, bits, and the columns of docs after doc_id and text."""
    counts = docs.sparkSession.sparkContext.broadcast(cell_counts(docs, width))  # 4 * CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, index, bits = [], [], [], []
            for g in grams(_texts(b.column(1)), width):
                n.append(len(g))
                cls.append(set_hash(g))
                bits.append(parities(g, num, den))
                first = len(g) - -(-num * len(g) // den) + 1
                if len(g) and first < len(g):
                    rare = counts.value[(g % np.uint64(len(counts.value))).astype(np.int64)]
                    edge = np.partition(rare, first - 1)[first - 1]
                    under, ties = g[rare < edge], g[rare == edge]
                    g = np.concatenate([under, ties[: first - len(under)]])
                index.append(g.astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, index)]), pa.int32()), pa.array(np.concatenate(index) if index else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), lists, pa.array(bits, pa.binary()), *b.columns[2:]], names=["doc_id", "n", "cls", "index", "bits", *b.schema.names[2:]])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    return docs.mapInArrow(run, "doc_id long, n long, cls long, index array<long>, bits binary" + more)


def parities(g: np.ndarray, num: int = NUM, den: int = DEN) -> bytes:
    """Bitmap of the parities of a set in cells, a power of two of them; it can be folded.

    There are five cells or more for each n-gram in which a set of this size and one that links
    with it may differ, so that half the cells, as of unrelated sets, are clearly too many.
    """
    differ = 2 * len(g) * (den - num) // (den + num)
    cells = max(128, 1 << (5 * differ).bit_length())
    n = np.bincount(((g >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").tobytes()


def _differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Cells in which the bitmaps of a and b differ, the larger folded to the smaller one's size."""
    out = np.zeros((len(a), len(b)), np.int64)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for x in np.unique(la):
        for y in np.unique(lb):
            i, j = np.flatnonzero(la == x), np.flatnonzero(lb == y)
            size = min(x, y)
            fold = lambda rows, at: np.bitwise_xor.reduce(np.frombuffer(b"".join(rows[k] for k in at), np.uint64).reshape(len(at), -1, size // 8), axis=1)
            left, right = fold(a, i), fold(b, j)
            for k, row in zip(i, left, strict=True):
                out[k, j] = np.bitwise_count(right ^ row).sum(1)
    return out


def _pairable(side: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a unit's two sides; within one block (side 2) both are the whole."""
    if side[0] == 2:
        return (whole := np.arange(at, at + len(side))), whole
    return at + np.flatnonzero(side == 0), at + np.flatnonzero(side == 1)


def _units(pdf: pd.DataFrame, by: list[str], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each unit in pdf, sorted by ``by``: places of both sides, and which pairs are open, that
    is of different components and of sizes that don't rule a link out."""
    keys = pdf[by].to_numpy(np.int64)
    n, comp, side = (pdf[c].to_numpy() for c in ("n", "comp", "side"))
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    for s, e in zip(starts, [*starts[1:], len(pdf)], strict=True):
        if e - s < 2:
            continue
        a, b = _pairable(side[s:e], s)
        na, nb = n[a][:, None], n[b][None, :]
        open_ = (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (comp[a][:, None] != comp[b][None, :])
        if open_.any():
            rows, cols = open_.any(1), open_.any(0)
            yield a[rows], b[cols], open_[np.ix_(rows, cols)]


def _screen(by: list[str], num: int, den: int):
    """The rows of block pairs that have a partner by size and bitmap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*by, "cls"])
        n, bits = pdf["n"].to_numpy(), pdf["bits"].to_list()
        keep = np.zeros(len(pdf), bool)
        for a, b, open_ in _units(pdf, by, num, den):
            both = n[a][:, None] + n[b][None, :]
            most = (both - _differing([bits[i] for i in a], [bits[i] for i in b])) // 2
            open_ &= den * most >= num * (both - most)
            keep[a[open_.any(1)]] = True
            keep[b[open_.any(0)]] = True
        return pdf[keep].drop(columns=["bits", "n", "deal"])

    return run


def _with_sets(rows: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """rows with n and grams of their cls, from the texts of just these documents.

    Up to BROADCAST wanted documents are sent to the scan of docs; more are joined with it. Which
    class a text is of is told by its own set, as a doc_id can be there with several texts.
    """
    wanted = materialise(nodes.join(rows.select("cls").distinct(), "cls", "left_semi").select("doc_id").distinct(), "wanted")
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int | None] = {None}
        for b in batches:
            cls, sets = [], []
            for g in grams(_texts(b.column(0)), width):
                c = set_hash(g)
                if c not in done:  # once a task, however often the row is there
                    done.add(c)
                    cls.append(c)
                    sets.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], names=["cls", "n", "grams"])

    sets = docs.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(run, "cls long, n long, grams binary")
    return rows.join(sets, "cls")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sparse product: how many n-grams each set of left shares with each of right."""
    cat = np.concatenate(left)
    owner = np.repeat(np.arange(len(left)), [len(g) for g in left])
    order = np.argsort(cat, kind="stable")
    cat, owner = cat[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for j, g in enumerate(right):
        lo, hi = np.searchsorted(cat, g, "left"), np.searchsorted(cat, g, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out[:, j] = np.bincount(owner[at], minlength=len(left))
    return out


def _product(by: list[str], num: int, den: int):
    """Links between the two sides of block pairs, or within one: of each a forest over components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates([*by, "side", "cls"]).sort_values([*by, "cls"])
        n, comp, raw = pdf["n"].to_numpy(), pdf["comp"].to_numpy(), pdf["grams"].to_list()
        found = []
        for a, b, open_ in _units(pdf, by, num, den):
            sets = lambda at: [np.frombuffer(raw[i], np.uint64) for i in at]
            shared = overlaps(sets(a), sets(b))
            linked = open_ & (den * shared >= num * (n[a][:, None] + n[b][None, :] - shared))
            root: dict[int, int] = {}

            def top(x: int, root=root) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, j in zip(*np.nonzero(linked), strict=True):
                u, v = int(comp[a[i]]), int(comp[b[j]])
                if (x := top(u)) != (y := top(v)):
                    root[max(x, y)] = min(x, y)
                    found.append((u, v))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            x, y = top(u), top(v)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pd.DataFrame({"node": nodes, "root": [top(x) for x in nodes]}, dtype="int64")


def components(edges: DataFrame, name: str = "cc", one_task: int = ONE_TASK) -> DataFrame:
    """node, root (the smallest node reachable) for nodes of edges(u, v).

    Up to ``one_task`` edges, two numbers each, are united in one task; more by alternating large
    and small stars, until the edges stay the same.
    """
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(now)
    if before[0] <= one_task:
        return materialise(now.coalesce(1).mapInPandas(_union_find, "node long, root long"), name)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        now = materialise(small, name)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _dealt(rows: DataFrame, by: list[str], deals: int):
    """Units dealt over tasks' groups of about DEAL rows, so that small units share a call."""
    return rows.withColumn("deal", F.pmod(F.xxhash64(*by), F.lit(deals)).cast("int")).groupBy("deal")


def _screened(rows: DataFrame, by: list[str], nodes: DataFrame, num: int, den: int, deals: int) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by, "cls", "comp", "side").schema)
    out = rows.select(*by, "cls", "comp", "side").join(nodes.select("cls", "n", "bits"), "cls")
    return materialise(_dealt(out, by, deals).applyInPandas(_screen(by, num, den), schema), "screened")


def _entries_of(known: DataFrame, entries: DataFrame, several: DataFrame) -> DataFrame:
    """gram, cls of the entries whose gram is among several, where sets can meet.

    Up to ISIN of these are sent to the scan of the index, so that what can't meet isn't shuffled
    again; more are joined.
    """
    if several.count() > ISIN:
        return entries.join(several, "gram")
    wanted = known.sparkSession.sparkContext.broadcast(np.sort(np.array(several.toArrow()["gram"].to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wanted.value
        for b in batches:
            lists = b.column(1)
            gram, cls = lists.flatten().to_numpy(), np.repeat(b.column(0).to_numpy(), lists.value_lengths().to_numpy())
            if len(w) and len(gram):
                hit = w[np.minimum(np.searchsorted(w, gram), len(w) - 1)] == gram
                yield pa.RecordBatch.from_arrays([pa.array(gram[hit]), pa.array(cls[hit])], names=["gram", "cls"])

    return known.select("cls", "index").mapInArrow(run, "gram long, cls long")


def _linked(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows of _described, and cls, doc_id (the least of it), comp of every set; docs as there."""
    seen = materialise(_described(docs, width, num, den), "sets")
    known = seen.filter("doc_id IS NOT NULL AND n > 0")
    least = known.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    nodes = least.join(known.select("cls", "doc_id", "bits"), ["cls", "doc_id"]).dropDuplicates(["cls"])
    nodes = materialise(nodes, "nodes")

    entries = known.select("cls", F.explode("index").alias("gram"))
    several = entries.groupBy("gram").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b").select("gram")
    several = materialise(several, "grams")
    members = materialise(_entries_of(known, entries, several).distinct(), "members")
    # groups of the same members are one
    who = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y"), F.min("cls").alias("a"), F.max("cls").alias("b")]
    groups = members.groupBy("gram").agg(*who).groupBy("m", "x", "y", "a", "b").agg(F.min("gram").alias("gram"))
    members = materialise(members.join(groups.select("gram", "m"), "gram").join(nodes.select("cls", "n"), "cls"), "groups")

    degree = members.groupBy("cls").agg(F.sum("m").alias("degree"))
    centres = members.join(degree, "cls").groupBy("gram").agg(F.max_by("cls", F.struct("degree", "n", "cls")).alias("centre"))
    centres = centres.join(nodes.select(F.col("cls").alias("centre"), F.col("n").alias("cn")), "centre")
    pairs = members.join(centres, "gram").filter((F.col("cls") != F.col("centre")) & (F.lit(den) * F.least("n", "cn") >= F.lit(num) * F.greatest("n", "cn")))
    pairs = materialise(pairs.select("centre", "cls").distinct(), "pairs")
    # what is counted by a key is written before it's joined by that key: a join beside its count can't be split where a key is hot
    chunks = materialise(pairs.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")), "chunks")
    right = pairs.join(chunks, "centre").select("centre", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int").alias("chunk"), "cls", F.lit(1).alias("side"))
    left = chunks.select("centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("centre").alias("cls"), F.lit(0).alias("side"))
    blocks = left.unionByName(right).withColumn("comp", F.col("cls"))
    by = ["centre", "chunk"]
    deals = -(-members.count() // DEAL) or 1
    blocks = _screened(blocks, by, nodes, num, den, deals)
    links = _dealt(_with_sets(blocks, docs, nodes, width), by, deals).applyInPandas(_product(by, num, den), "u long, v long")
    first = components(links, "stars")

    placed = members.join(first, members["cls"] == first["node"], "left").select("gram", "cls", F.coalesce("root", "cls").alias("comp"))
    open_ = placed.groupBy("gram").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m"), F.min("cls").alias("least")).filter("a < b").select("gram", "m", "least")
    open_ = materialise(open_, "open-groups")
    rest = materialise(placed.join(open_, "gram"), "open")
    # groups that overlap are one family: a set goes to it once, however many groups hold it
    family = components(rest.select(F.col("cls").alias("u"), F.col("least").alias("v")), "families")
    rest = rest.join(family.withColumnRenamed("root", "family"), rest["cls"] == family["node"])
    sizes = materialise(family.groupBy(F.col("root").alias("family")).agg(F.count("*").alias("size")), "sizes")
    rest = rest.join(sizes, "family").select(
        *(F.when(F.col("size") <= FAMILY, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("family", "gram", "group"), ("size", "m", "m"))), (F.col("size") <= FAMILY).alias("whole"), "cls", "comp"
    ).distinct()
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    # a set goes to as many units as its group has parts, and it's these rows that are dealt
    rest = materialise(rest, "rest")
    deals = -(-(rest.agg(F.sum(parts.cast("long"))).first()[0] or 0) // DEAL) or 1
    rest = rest.withColumn("own", F.pmod(F.xxhash64("cls"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rest = rest.select("whole", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "comp", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    by = ["whole", "group", "i", "j"]
    rest = _screened(rest, by, nodes, num, den, deals)
    more = _dealt(_with_sets(rest, docs, nodes, width), by, deals).applyInPandas(_product(by, num, den), "u long, v long")
    second = components(more, "blocks")

    root = nodes.join(first, nodes["cls"] == first["node"], "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("comp"))
    return seen, root.join(second, root["comp"] == second["node"], "left").select("cls", "doc_id", F.coalesce("root", "comp").alias("comp"))


def classes(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    seen, root = _linked(docs, width, num, den)
    smallest = root.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = root.join(smallest, "comp").select("cls", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = seen.select("doc_id", "n", "cls", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(named, ["cls", "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def deduplicated(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with one row of each component of texts that link.

    It is a row of the smallest doc_id, and of that the text of the smallest hash. Texts without
    n-grams link with none: of these one of each doc_id stays. Rows without doc_id stay.
    """
    names = docs.columns
    doc_id, text = F.col("`doc_id`").cast("long"), F.col("`text`").cast("string")
    seen, root = _linked(docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")), width, num, den)
    texts = seen.filter("doc_id IS NOT NULL").groupBy("doc_id", "h").agg(F.min("cls").alias("cls"), (F.count("*") > 1).alias("again"))
    least = F.min(F.struct("doc_id", "h", "again")).alias("least")
    sets = texts.filter("cls IS NOT NULL").groupBy("cls").agg(least)  # before the join: many texts may be of one set
    sets = sets.join(root.select("cls", "comp"), "cls").groupBy("comp").agg(F.min("least").alias("least"))
    keep = sets.select("least.*").unionByName(texts.filter("cls IS NULL").groupBy("doc_id").agg(F.min(F.struct("h", "again")).alias("least")).select("doc_id", "least.*"))
    keep = keep.select(F.col("doc_id").alias("_keep"), F.col("h").alias("_kept"), F.col("again").alias("_again"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), doc_id.alias("_id"), F.xxhash64(text).alias("_h"))
    kept = rows.join(keep, (rows["_id"] == keep["_keep"]) & (rows["_h"] == keep["_kept"]))
    once = kept.filter(~F.col("_again")).select("row")
    again = kept.filter("_again").groupBy("_id", "_h").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(again).unionByName(rows.filter("_id IS NULL").select("row")).select("row.*")
