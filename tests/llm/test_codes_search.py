"""Vector codes, removal of repeated strings and ranked search, against plain loops."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical, repeats, vector_codes

# vector codes -----------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, label, vector), all fit to be kept, one vector an id."""
    ints = [[math.floor(4096 * x) for x in v] for _, _, v in rows]
    n = len(ints[0]) // parts
    cut = [[v[p * n : (p + 1) * n] for p in range(parts)] for v in ints]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for v in cut:
                own[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e])] if e in own else c for e, c in enumerate(books[p])]
    ends = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in x) for x in ends]
    by_label = collections.Counter()
    for (_, label, _), e in zip(rows, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in x), err, by_label[label], sha) for (i, label, _), x, err in zip(rows, ends, errors)), key=str)


VECTORS = "vec_id long, label int, embedding array<float>, code string, error int, part int, s0 int, vector int"


def coded(spark, rows):
    df = vector_codes.digest(spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], VECTORS).repartition(3))
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("dim, n", [(16, 300), (8, 40), (24, 9)])
def test_codes_are_those_of_plain_rounds(spark, dim, n):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(5, dim))
    rows = [(int(i), None if i % 5 == 0 else int(i) % 3, [float(np.float32(x)) for x in centres[rng.integers(5)] + rng.normal(size=dim) / 3]) for i in rng.permutation(3 * n)[:n]]
    rows += [(10_000 + i, 1, rows[0][2]) for i in range(20)] + [(None, 2, rows[1][2])]  # copies, and a row without id
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    good = [(i, 1, [float(i + j) / 8 for j in range(8)]) for i in range(5)]
    bad = [(50, 1, None), (-1, 1, [float("nan")] * 8), (-2, 1, [float("inf")] + [0.0] * 7), (-3, 1, [None] + [0.0] * 7), (7, 1, []), (8, 1, [1.0] * 16), (9, 1, [1.0] * 7)]
    assert coded(spark, good + bad) == plain_codes(good)
    assert coded(spark, []) == [] == coded(spark, bad[:4])
    twice = coded(spark, [*good, good[2]])  # a repeated row counts again, but starts one entry
    assert len(twice) == 6 and len({r[4] for r in twice}) == 1
    with pytest.raises(Exception, match="or more in size"):
        coded(spark, [(1, 1, [1e6] * 8)])


@pytest.mark.parametrize("length", [1, 2, 3, 8, 13])
@pytest.mark.parametrize("scale", [1, 1000, 2_000_000])
def test_bounds_drop_nothing_that_wins(length, scale):
    rng = np.random.default_rng(length * scale)
    x, book = rng.integers(-7, 8, (2000, length)) * scale, rng.integers(-7, 8, (16, length)) * scale
    counts = {}
    index, least = vector_codes.nearest(x, book, counts)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (least == d.min(1)).all()
    assert counts["all"] == 32_000 and counts["measured"] < (20_000 if length <= 3 else 32_000)


# repeated strings ---------------------------------------------------------------------------


def plain_repeats(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(r), sum(gone), len(spans), hashlib.sha256(bytes(x for x, g in zip(r, gone) if not g)).hexdigest()))
    return out


def removed(spark, texts, ids=None):
    rows = [(i, t, 1, 2, "3", "4") for i, t in zip(ids or range(len(texts)), texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th int, at int, raw string, own string").repartition(3)
    return sorted((tuple(r) for r in repeats.digest(df).collect()), key=str)


def wanted(texts, ids=None):
    return sorted(((i, *w) for i, w in zip(ids or range(len(texts)), plain_repeats(texts))), key=str)


def shared_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages, texts = [make(120) for _ in range(4)], []
    for _ in range(n):
        t = make(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p, a = rng.choice(passages), rng.randint(0, 200)
            t += p[a : a + rng.randint(200, 700)] + make(rng.randint(0, 60))
        texts.append(t)
    return texts


@pytest.mark.parametrize("step", [None, 300, 1024])
def test_repeats_are_those_of_all_substrings(spark, monkeypatch, step):
    if step:
        monkeypatch.setattr(repeats, "STEP", step)  # the tasks' workers are forked from here only in part: see the next test
    t = shared_texts(step or 1)
    long = max(t, key=len)
    t += [t[3], t[3], None, "", long[:399], long[:400], "x" + long[:400], long[:401], "a" * 3000, "ab" * 700, "z" * 399, "z" * 399]
    assert removed(spark, t) == wanted(t)


@pytest.mark.parametrize("step", [1, 7, 300, 1 << 18])
def test_anchors_do_not_depend_on_the_step(monkeypatch, step):
    for raw in ("".join(shared_texts(5, 6)).encode()[:4000], b"a" * 1500, b"abc" * 400, b"q" * 400):
        monkeypatch.setattr(repeats, "STEP", 1 << 18)
        want = repeats.anchors(raw)
        monkeypatch.setattr(repeats, "STEP", step)
        assert repeats.anchors(raw) == want
        assert sorted(u - d for u, lo, hi, _, _ in want for d in range(lo, hi + 1)) == list(range(len(raw) - 399))


def test_repeats_of_odd_tables(spark):
    t = shared_texts(3, 4)[0] + "y" * 500
    assert removed(spark, []) == []
    ids = [7, 7, None, None, 8]
    texts = [t, t, t + "tail", None, "short"]  # one row twice, rows without id
    assert removed(spark, texts, ids) == wanted(texts, ids)
    other = "".join(random.Random(2).choice("abcd") for _ in range(900))
    assert removed(spark, [t, other], [7, 7]) == wanted([t, other], [7, 7])  # one doc_id, two texts


def test_a_passage_in_a_third_of_all_rows(spark):
    """Every row has its own surroundings: no kind of block at the passage's edges is shared by many."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(900))
    noise = lambda: "".join(rng.choice("ghijkl ") for _ in range(rng.randint(0, 500)))
    texts = [noise() + passage[: 900 - i % 9] + noise() if i % 3 == 0 else noise() + noise() for i in range(300)]
    assert removed(spark, texts) == wanted(texts)


def passage_of(rng, words, size):
    """As many words as asked, size bytes together."""
    long, more = divmod(size - words + 1, words)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(long + (i < more))) for i in range(words))


def test_passages_go_by_their_bytes_not_by_their_words(spark):
    """Passages of over 50 words go from 400 bytes on; shorter ones stay, however many documents hold them."""
    rng = random.Random(11)
    noise = lambda: "".join(rng.choice("klmnop ") for _ in range(rng.randint(60, 400)))
    sizes = [(51, 399), (51, 400), (60, 373), (70, 450), (40, 420)]
    passages = [passage_of(rng, *x) for x in sizes]
    assert [(len(p.split()), len(p)) for p in passages] == sizes
    texts = [f"{noise()}<{i}{p}{i}>{noise()}" for p in passages for i in range(4)] + [noise() + noise() for _ in range(9)]
    got = removed(spark, texts)
    assert got == wanted(texts)
    gone = [size if size >= 400 else 0 for _, size in sizes for _ in range(4)] + [0] * 9
    by_id = {r[0]: r for r in got}
    assert [by_id[i][2] for i in range(len(texts))] == gone
    assert [by_id[i][1] for i in range(len(texts))] == [len(t) for t in texts]


# ranked search --------------------------------------------------------------------------------


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_ranks(docs, items, k):
    found = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    queries = collections.defaultdict(set)
    for i, t in items:
        queries[i].update(plain_terms(t))
    out = []
    for item, terms in queries.items():
        scores = []
        for i, c in found:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=5, shard=200, **options):
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, shard int, term int, n int").repartition(3)
    i = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, item int, term int")
    return sorted((tuple(r) for r in lexical.search(lexical.build(d, shard=shard), i, k, **options).collect()), key=str)


def word_texts(seed, n, longest=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Élan", "naïve", "漢字", "A1", "b_c"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, longest))) for _ in range(n)]


def test_ranks_are_those_of_all_scores(spark):
    docs = list(enumerate(word_texts(1, 400)))
    docs += [(i, docs[3][1]) for i in (900, 901, 902)] + [(None, docs[4][1]), (None, docs[4][1]), (5, docs[5][1]), (950, None), (951, ""), (952, " ,;! "), (953, "w1 " * 20_000)]
    items = list(enumerate(word_texts(2, 12, 8))) + [(100, "W1 w1, W2"), (101, None), (102, "nowhere"), (None, "w3 w9"), (None, "w4"), (103, "w5"), (103, "w6 w5")]
    want = plain_ranks(docs, items, 5)
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, block=30) == want  # queries in several blocks
    assert ranked(spark, docs, items, k=1000, shard=10**6) == plain_ranks(docs, items, 1000)
    assert ranked(spark, [], items) == [] == ranked(spark, docs, []) == ranked(spark, docs, [(1, None)]) == ranked(spark, [(1, None), (2, "")], items)


def test_terms_are_runs_of_letters_digits_and_the_rest():
    text = "".join(map(chr, range(256))) + " Été-2024 x_Y \u2028 \x85a"
    assert [t.decode() for t in lexical.terms(text.encode())] == plain_terms(text)


def test_boundaries_are_the_cheapest():
    rng = np.random.default_rng(3)
    lengths = np.array([5, 1, 40, 17, 100, 3, 100])
    s, off = rng.integers(1, 100, lengths.sum()), np.cumsum(lengths) - lengths
    starts = lexical.boundaries(s, lengths, longest=8, price=2)
    ends = np.append(starts[1:], len(s))
    assert set(off) <= set(starts) and (ends - starts).max() <= 8
    for o, n in zip(off, lengths):
        x, price = s[o : o + n], 2 * s[o : o + n].mean()
        best = [0.0]
        for j in range(1, n + 1):
            best.append(min(best[i] + price + (x[i:j].max() - x[i:j]).sum() for i in range(max(0, j - 8), j)))
        mine = sum(price + (s[a:b].max() - s[a:b]).sum() for a, b in zip(starts, ends) if o <= a < o + n)
        assert mine == pytest.approx(best[-1])


def test_blocks_are_skipped():
    """High scores stand together: most postings are never scored, and the best are the same."""
    rng = np.random.default_rng(5)
    n, names = 6000, ["a", "b", "c"]
    docs = [np.sort(rng.choice(n, 3000, replace=False)) for _ in names]
    tfs = [np.where((d > 2000) & (d < 2100), rng.integers(20, 90, len(d)), 1) for d in docs]
    lengths = np.full(n, 200)
    shard = lexical.Shard(names, docs, tfs, [700, 900, 800], lengths, n, int(lengths.sum()))
    got = shard.search(names, 10)
    total = np.zeros(n, np.int64)
    for d, tf, w in zip(docs, tfs, (700, 900, 800)):
        total[d] += lexical.posting_scores(np.int64(w), tf, lengths[d], n, int(lengths.sum()))
    best = np.lexsort((np.arange(n), -total))[:10]
    assert got[0].tolist() == best.tolist() and got[1].tolist() == total[best].tolist()
    assert shard.read < shard.whole / 3


def test_queries_are_registered(spark):
    from tidemark.llm import queries

    names = set(queries.queries())
    assert {"op11_vector_codes", "op12_repeats", "op13_ranked_search"} <= names
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_repeats(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).orderBy("doc_id").collect()
    assert [got[r["doc_id"]] for r in docs] == plain_repeats([r["text"] for r in docs])
