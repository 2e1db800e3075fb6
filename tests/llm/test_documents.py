"""The document operators on nulls, empty and long texts, ties, repeated rows, empty tables and
columns of clashing names; and against brute force."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, hashing, jaccard, langid, lm_score, mixing, packing, quality, spotsigs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, part string, cls string, key string, score string, bucket string, n string, k0 string, s string, rank string, salt int, times int, piece_id string"
LONG = "lorem ipsum dolor sit amet consectetur " * 2000


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "io", "ra", "su", "mer", "tol"]) for _ in range(rng.randint(1, 3)))
    base = [" ".join(word() for _ in range(rng.randint(1, 90))) + rng.choice([".", "", "\n"]) for _ in range(n)]
    return base


def documents(spark, rows):
    full = [(i, t, lang, src, len(t or "")) + ("x",) * 11 + (7, 7, "x") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    t = texts()
    rows = [(i, x, random.Random(i).choice(["en", "de", None]), random.Random(i).choice(["a", "b", "c", None])) for i, x in enumerate(t)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, "   \n\t", "de", "b"), (103, LONG, "en", "a"), (104, t[3], "en", "a"), (105, t[3], "de", "b"), (104, t[3], "en", "a"), (None, t[4], "en", "b"), (None, None, None, None), (106, "123 456 !!", "en", "c"), (107, "a", "en", "a"), (108, "ñandú ß 東京 😀 x", "es", "b")]
    df = documents(spark, rows).repartition(3).cache()
    df.rows = rows
    return df


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, []).cache()


# hashing ----------------------------------------------------------------------------------


def test_word_hashes():
    t = ["", None, " ", "a", "A b  a\tB\n", "x" * 2_500_000, "é É É", "a b"] * 2
    seen = {}
    for text, h in zip(t, hashing.word_hashes(t), strict=True):
        w = words(text)
        assert len(w) == len(h)
        assert all(seen.setdefault(x, int(y)) == int(y) for x, y in zip(w, h, strict=True))
    assert len(set(seen.values())) == len(seen)
    assert len(hashing.gram_hashes(np.zeros(0, np.uint64), 3)) == 0 and len(hashing.gram_hashes(np.arange(2, dtype=np.uint64), 3)) == 1


# language ---------------------------------------------------------------------------------


def test_language(spark, odd, none):
    got = langid.digest(odd).collect()
    assert len(got) == len(odd.rows)
    by = {r["doc_id"]: r for r in got}
    for i in (100, 101, 102, 106):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "es", "und") for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert langid.digest(none).count() == 0


def test_letters():
    assert [langid.has_letter(t) for t in ("1 ²Ⅷ_", "²a", "東", "!!", "é")] == [False, True, True, False, True]


def test_language_held_out(spark):
    rng = random.Random(0)
    kinds = {"x": "abcde", "y": "vwxyz", "z": "abxyz"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(rng.randint(8, 40))), k, "s") for i in range(300) for k in [rng.choice("xyz")]]
    got = {r["doc_id"]: r for r in langid.digest(documents(spark, rows)).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _ in rows if got[i]["held_out"])
    assert sum(r["rejected"] for r in got.values()) == 0


WORDS = {"x": "the quick brown fox runs over lazy dogs and then sleeps under green trees while rain falls", "y": "der schnelle braune fuchs läuft über faule hunde und schläft dann unter grünen bäumen bei regen"}


def test_unknown_languages_are_rejected(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[k].split()) for _ in range(rng.choice([1, 2, 5, 12, 40, 200]))).capitalize() + ".", k, "s") for i in range(1500) for k in "xy"]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    random_text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n))
    foreign = ["Это предложение на русском языке и оно довольно длинное", "Ελληνικά είναι μια γλώσσα που μιλιέται στην Ελλάδα", "这是一个中文句子它相当长没有空格", "Ez egy magyar mondat, amely elég hosszú ahhoz, hogy felismerjük", "To jest polskie zdanie napisane po polsku"]
    foreign += [" ".join(f"{rng.getrandbits(128):032x}" for _ in range(n)) for n in (3, 30)] + [random_text(n) for n in (90, 400, 3000)]
    got = {r["doc_id"]: r for r in langid.digest(documents(spark, [*rows, *((10_000 + i, t, None, "s") for i, t in enumerate(foreign))])).collect()}
    assert all(got[10_000 + i]["rejected"] and got[10_000 + i]["lang_pred"] in ("x", "y") for i in range(len(foreign)))
    known = [(got[i], k) for i, _, k, _ in rows if got[i]["held_out"]]
    assert np.mean([not r["rejected"] for r, _ in known]) >= 0.99 and np.mean([r["lang_pred"] == k for r, k in known]) > 0.97


def test_language_sample_is_fair(spark):
    """A row that is there thousands of times takes one place; refits agree."""
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(3, 40))] + [(50, "pasta rizo largo", "es", "s")] * 3000 + [(60 + i, t.replace("a", "ü"), "de", "s") for i, t in enumerate(texts(4, 40))]
    docs = documents(spark, rows)
    one, two = langid.train(docs, sample=30), langid.train(docs.repartition(7), sample=30)
    assert one["langs"] == ["de", "en", "es"] and one["limits"] == two["limits"] and (one["centroids"] == two["centroids"]).all()


def test_languages_equal_plain_loops(spark, odd):
    model = langid.train(odd.withColumn("lang", F.coalesce("lang", F.lit("de"))))
    t = [r[1] for r in odd.rows]
    for text, (lang, score, rejected) in zip(t, langid.classify(t, model), strict=True):
        if not text or not langid.has_letter(text):
            assert (lang, score, rejected) == ("und", 0.0, True)
            continue
        at, n = langid.features(text)
        v = {int(a): (1 + math.log(c)) * model["idf"][a] for a, c in zip(at, n, strict=True)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(float(c[a]) * x for a, x in v.items()) / norm for c in model["centroids"]]
        best = max(range(len(cos)), key=lambda k: cos[k])
        assert score == pytest.approx(max(0, cos[best]), abs=1e-5) and lang == model["langs"][model["owner"][best]]


def test_long_documents_meet_large_budgets():
    lengths = np.array([3_000_000, 5_000_001, 7_000_003])
    got = mixing.fit(lengths, np.array([5, 5, 5]), 40_000_000)
    assert (got <= 5).all() and (got * lengths).sum() == 39_000_013
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = rng.choice(np.arange(5, 90), rng.integers(1, 5), replace=False)
        counts = rng.integers(0, 5, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        best = 0
        for c in np.ndindex(*(counts + 1)):
            total = int((np.array(c) * lengths).sum())
            best = total if best < total <= budget else best
        out = mixing._few(lengths, counts, budget)
        assert (out <= counts).all() and (out * lengths).sum() == best
    assert mixing._few(np.arange(1, 200), np.full(199, 9), 5_000) is None


# quality ----------------------------------------------------------------------------------


def test_quality_of_long_texts(spark):
    rng = random.Random(3)
    word = lambda good: "".join(rng.choice("aeioulnrst" if good else "AEIOU0189!") for _ in range(5))
    rows = [(i, " ".join(word(i % 2) for _ in range(rng.randint(1200, 1900))), "en", "s") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] * 2, "doc_id long, quality int")
    got = [r for r in quality.digest(documents(spark, rows), labels).collect() if r["held_out"]]
    assert len(got) > 10 and all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(1)
    model = quality.initial(rng)
    model["bias"] += rng.normal(size=quality.FILTERS).astype(np.float32) / 4
    for text in (None, "", "a", "Some words. " * 9, "é" * 700, "lorem ipsum " * 900):
        raw = (text or "").encode()
        n = max(1, math.ceil(max(0, len(raw) - quality.WIDTH) / quality.STRIDE) + 1)
        raw += b"\0" * ((n - 1) * quality.STRIDE + quality.WIDTH - len(raw))
        acts = np.array([[max(0.0, float(x)) for x in np.concatenate([model["embed"][c] for c in raw[i * quality.STRIDE : i * quality.STRIDE + quality.WIDTH]]).astype(float) @ model["filters"] + model["bias"]] for i in range(n)])
        chunk = lambda size: np.array([acts[i : i + size].max(0) for i in range(0, n, size)])
        wide, small = chunk(quality.CHUNK), chunk(quality.SMALL)
        z = np.concatenate([wide.max(0), wide.mean(0), small.sum(0) / (len(small) + quality.SHRINK)]) @ model["out"] + float(model["out_bias"][0])
        assert quality.probability(model, text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_excerpts_cover_the_text():
    raw = "".join(chr(97 + i % 26) for i in range(50_000))
    got = quality.excerpt(raw, 600, 5)
    assert len(got) == 600 and quality.excerpt(raw[:600], 600, 5) == raw[:600].encode() and quality.excerpt(None, 10, 1) == b""



def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (103, None), (3, 1)], "doc_id long, quality int")
    got = quality.digest(odd, labels).collect()
    assert len(got) == len(odd.rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality.digest(none, labels).count() == 0
    assert {r["score"] for r in quality.digest(odd, labels.filter("quality = 1")).collect()} == {1.0}


def test_quality_ignores_labels_of_absent_documents(spark):
    rng = random.Random(9)
    text = lambda good: " ".join(rng.choice(("clear", "plain", "sound") if good else ("BUY", "!!!", "zzz")) for _ in range(40))
    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(120)], "doc_id long, text string")
    own = [(i, i % 2) for i in range(120)]
    absent = spark.range(1000, 60_000).selectExpr("id AS doc_id", "CAST(id % 7 = 0 AS INT) AS quality")
    both = spark.createDataFrame(own, "doc_id long, quality int")
    alone, among = (quality.train(docs, x, F.lit(True), sample=50) for x in (both, both.unionByName(absent)))
    assert set(alone) == set(among) and "constant" not in among and all((alone[k] == among[k]).all() for k in alone)


def test_quality_held_out(spark):
    rng = random.Random(0)
    t = texts(5, 400)
    y = [rng.random() < 0.7 for _ in t]
    rows = [(i, x if good else x.upper().replace(" ", "!! "), "en", "s") for i, (x, good) in enumerate(zip(t, y, strict=True)) if len(x) > 20]
    labels = spark.createDataFrame([(i, int(good)) for i, good in enumerate(y)], "doc_id long, quality int")
    got = [r for r in quality.digest(documents(spark, rows), labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in got]) > 0.95


def test_windows_cover_the_text():
    for n in (0, 1, 7, 8, 9, 10, 511, 4099):
        w = quality.windows(quality.padded("a" * n))
        assert (w > 0).any(1).sum() * quality.STRIDE >= n - quality.WIDTH and (n == 0 or w[-1].any())
        assert len(w) == max(1, math.ceil(max(0, n - quality.WIDTH) / quality.STRIDE) + 1)


def test_one_large_unlinked_group_is_dealt_evenly(spark, monkeypatch):
    """Texts over three words share their n-grams and hardly link: every call gets some DEAL rows of the blocks."""
    rng, seen, dealt = random.Random(12), [], jaccard._dealt
    rows = [(i, " ".join(rng.choice("abc") for _ in range(14)), "en", "x") for i in range(4000)]

    def spied(rows, by, deals):
        seen.append(rows.select(F.pmod(F.xxhash64(*by), F.lit(deals)).alias("deal")).groupBy("deal").count().agg(F.max("count"), F.count("*")).first())
        return dealt(rows, by, deals)

    monkeypatch.setattr(jaccard, "_dealt", spied)
    monkeypatch.setattr(jaccard, "DEAL", 2000)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(documents(spark, rows)).collect()}
    assert len(got) == 4000 and len(seen) == 4
    assert seen[2][1] > 5 and seen[2][0] <= 2 * jaccard.DEAL + 4 * jaccard.BLOCK


# packing ----------------------------------------------------------------------------------


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    want = collections.Counter()
    for i, t, _, _ in odd.rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[i, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.digest(odd).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_sequences(got)
    assert packing.digest(none).count() == 0


def test_ids_of_any_text():
    """Round trip of the word cache against the tokenizer over letters, marks, signs and spaces of all scripts."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    rng = random.Random(11)
    ranges = [(33, 127)] * 5 + [(0xC0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x600, 0x700), (0x1E00, 0x2000), (0x2000, 0x2070), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F600, 0x1F640)]
    pieces = ["İ,", "ΑΣ", "'s", "'LL", "don't", ".,!", "ﬁ", "a\u0301.", "\u0301", "\u200d", "Ǆ", "ß", "\x00", "\x1f", "\x85", "\u2028", "\xa0"]
    encode = packing.encoder(packing.default_tokenizer())

    def word():
        low, high = rng.choice(ranges)
        return rng.choice(pieces) if rng.random() < 0.15 else "".join(chr(rng.randrange(low, high)) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", ".", ",", "!?"])

    for _ in range(10_000):
        text = "".join(word() + rng.choice([" ", " ", "", "\n", "\t "]) for _ in range(rng.randint(1, 12)))
        assert list(np.frombuffer(encode(text), "<u4")) == [*tok.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_word_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_BYTES", 50_000)
    monkeypatch.setattr(packing, "_tokenizers", {})
    encode = packing.encoder(packing.default_tokenizer())
    words = packing._tokenizers[packing.default_tokenizer()][1]
    want = encode("common words, again")
    for i in range(300):
        encode(f"{i:x}" * 300)
        assert encode("common words, again") == want and b"again" in words["young"]
        for g in ("young", "old"):
            assert sum(len(k) + len(v) for k, v in words[g].items()) < 60_000
    assert words["old"] and 100 * 300 not in map(len, words["young"])


def test_words_of_letters_go_to_the_model_at_once(monkeypatch):
    """They are held without the comma or full stop after them; only others pass the whole tokenizer."""
    monkeypatch.setattr(packing, "_tokenizers", {})
    path, passed = packing.default_tokenizer(), []
    packing.encoder(path)
    tok, words = packing._tokenizers[path]

    class Noting:
        encode, model = tok.encode, tok.model

        def encode_batch_fast(self, texts, **options):
            passed.extend(texts)
            return tok.encode_batch_fast(texts, **options)

    packing._tokenizers[path] = (Noting(), words)
    encode = packing.encoder(path)

    def right(text):
        return list(np.frombuffer(encode(text), "<u4")) == [*tok.encode(text, add_special_tokens=False).ids, 0]

    assert right("Some words, some Words. words., some") and set(words["young"]) == {b"some", b"words", b",", b".", b".,"} and sorted(passed) == [",", ".", ".,"]
    assert all(right(chr(c) + "a" + chr(c)) and right(f"x{chr(c)}, {chr(c)}") for c in range(0x20, 0x300))
    assert right("it's, 1,000.5 a,b.c x,'s x.'ll \u00c9\u00df\u01c5, na\u00efve. \u0130, \u2028 \u2028, e.g., a,\u200d.")
    assert right("\0 new\0er, \0\0 a\0 other\0.") and right("<|endoftext|>, x<|startoftext|>. A,\u0301 b.\u0338 \u00c4Rger")


def test_the_bound_decides_what_is_given_up():
    import pandas as pd

    def given_up(lengths):
        out = packing._pack_partition(10, False, 0)((0,), pd.DataFrame({"length": lengths, "sequence_id": 0, "offset": 0, "part": 0}))
        assert out["certified"].nunique() == 1
        return bool(out["certified"].iloc[0]), out[out["given_up"]]["sequence_id"].nunique()

    assert given_up([7] * 40) == (True, 10)  # no two of them fit: certified by what counts as full, but with gaps
    assert given_up([5] * 40) == (True, 0) and given_up([5] * 39) == (True, 1)
    assert given_up([5, 4, 3, 3, 3, 2]) == (False, 1)  # 5 4, 3 3 3, 2 for what fits in 5 3 2, 4 3 3


@pytest.mark.parametrize(("lengths", "certified", "rounds"), [([100] * 400, True, 1), ([70] * 400, True, 1), ([51, 27, 26, 23, 25, 24, 24] * 150, None, None)])
def test_a_certified_packing_is_not_exchanged(spark, monkeypatch, lengths, certified, rounds):
    tables, write = [], packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, name: tables.append(name) or write(df, name))
    got = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long"), capacity=100, partition=200).collect()
    bound = packing.lower_bound(np.array(lengths), 100)
    assert check_sequences(got, 100) >= bound and len(got) == len(lengths)
    if certified:
        assert check_sequences(got, 100) == bound and {r["certified"] for r in got} == {True}
        assert sum(t.startswith("packed") for t in tables) == rounds


def check_sequences(rows, capacity=2048):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_repacking_rounds(spark):
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in rng.integers(1, 100, 3000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(pieces, capacity=100, partition=200).collect()
    assert sorted(r["length"] for r in got) == sorted(lengths) and len({r["doc_id"] for r in got}) == 3000
    alone = len(packing.best_fit_decreasing(np.array(lengths), 100)[2])
    assert packing.lower_bound(np.array(lengths), 100) <= check_sequences(got, 100) <= alone * 1.02 + 1


def test_lower_bound_and_best_fit():
    assert packing.lower_bound(np.zeros(0, int), 10) == 0
    assert packing.lower_bound(np.array([6] * 7), 10) == 7 and packing.lower_bound(np.array([4] * 7), 10) == 4 and packing.lower_bound(np.array([10, 10, 1]), 10) == 3
    rng = random.Random(4)
    for _ in range(200):
        items = [rng.randint(1, 10) for _ in range(rng.randint(1, 7))]
        best = len(items)
        for perm in range(3**0):
            best = min(best, exact_bins(sorted(items, reverse=True), 10))
        assert packing.lower_bound(np.array(items), 10) <= best <= len(packing.best_fit_decreasing(np.array(items), 10)[2])


def exact_bins(items, capacity, bins=()):
    if not items:
        return len(bins)
    options = [exact_bins(items[1:], capacity, tuple(sorted([*bins[:i], b + items[0], *bins[i + 1 :]]))) for i, b in enumerate(bins) if b + items[0] <= capacity]
    return min([*options, exact_bins(items[1:], capacity, tuple(sorted([*bins, items[0]])))])


# mixing -----------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """By the contract's words: shares by weight, what is above the cap dealt again to the others."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, left = {}, sum(sizes.values())
    while len(goal) < len(sizes):
        unit = left / sum(w for s, w in weight.items() if s not in goal)
        above = [s for s in names if s not in goal and unit * weight[s] > cap * sizes[s]]
        goal |= {s: float(cap * sizes[s]) for s in above} if above else {s: unit * weight[s] for s in names if s not in goal}
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in goal) if above else 0
    return goal


def test_targets(spark):
    def targets(sizes):
        rows = [("0" if s is None else "1" + s, n) for s, n in sizes.items()]
        out = mixing.targets(spark.createDataFrame(rows, "skey string, words long").repartition(3)).collect()
        assert {(r["skey"], r["source_size"]) for r in out} == set(rows)
        return {r["skey"][1:] if r["skey"] != "0" else None: r["target"] for r in out}

    assert targets({}) == {}
    got = targets({"a": 100, "b": 1000, "c": 5, None: 50})
    assert got["c"] == 15.0 and got[None] == 150.0 and got["a"] == 300.0 and got["b"] == pytest.approx(690)
    assert targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}
    assert targets({"": 4, None: 9, "\U0001f600": 70, "\uffee": 3}) == pytest.approx(plain_targets({"": 4, None: 9, "\U0001f600": 70, "\uffee": 3}))
    rng = random.Random(5)
    many = {f"s{rng.random()}": int(rng.paretovariate(0.6)) for _ in range(2000)} | {None: 77}
    got, want = targets(many), plain_targets(many)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(many.values()))


def test_knapsack_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        sizes = rng.sample(range(1, 15), rng.randint(1, 5))
        counts = [rng.randint(0, 3) for _ in sizes]
        budget = rng.randint(0, 60)
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + s * k for x in sums for k in range(c + 1) if x + s * k <= budget}
        got = mixing.knapsack(sizes, counts, budget)
        assert sum(s * k for s, k in zip(sizes, got, strict=True)) == max(sums) and all(0 <= k <= c for k, c in zip(got, counts, strict=True))


def test_mixing(spark, odd, none):
    got = mixing.digest(odd).collect()
    assert len(got) == len(odd.rows)
    size, total = collections.Counter(), 0
    for _, t, _, s in odd.rows:
        size[s] += len(words(t))
    goal = plain_targets(dict(size))
    taken = collections.Counter()
    for r in got:
        assert r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
        total += r["size"]
    assert total == sum(size.values())
    for s, n in size.items():
        assert abs(taken[n, round(goal[s], 6)] - goal[s]) <= 0.02 * goal[s] + 12000 * (s == "a") + 90
    assert sorted(map(str, got)) == sorted(map(str, mixing.digest(odd.repartition(5)).collect()))
    assert mixing.digest(none).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() == sum(r["times"] for r in got)


def test_mixing_hits_the_target(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "en", rng.choice("abbbcccc")) for i in range(900)] + [(1000 + i, "w w w", "en", "a") for i in range(400)]
    got = mixing.digest(documents(spark, rows)).collect()
    taken, goal = collections.Counter(), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        goal[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_mixing_of_repeated_rows(spark):
    """Rows of one doc_id and length share a hash; as many of them are taken as the quota says."""
    rows = [(7, "w w", "en", "a")] * 301 + [(8, "w w", "en", "a")] * 40 + [(i, "w w w", "en", "b") for i in range(100, 400)]
    got = mixing.digest(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for words, goal in {(r["source_size"], r["target"]) for r in got}:
        assert abs(sum(r["taken"] for r in got if r["source_size"] == words) - goal) <= 3
    assert len({r["times"] for r in got if r["doc_id"] == 7} | {r["times"] for r in got if r["doc_id"] == 8}) == 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.digest(documents(spark, rows[::-1]).repartition(7)).collect()))


def test_fit_of_long_documents():
    sums = lambda lengths, counts, budget: max(x for x in map(sum, itertools.product(*([n * k for k in range(c + 1)] for n, c in zip(lengths, counts, strict=True)))) if x <= budget)
    rng = random.Random(6)
    cases = [([45_000, 100_000], [1, 1], 50_000), ([35_000, 45_000, 50_000], [1, 1, 1], 80_000), ([300_000, 700_001], [3, 2], 1_000_000)]
    cases += [(rng.sample(range(24_500, 400_000), 5), [rng.randint(1, 3) for _ in range(5)], rng.randint(25_000, 900_000)) for _ in range(10)]
    for lengths, counts, budget in cases:
        got = mixing.fit(np.array(lengths), np.array(counts), min(budget, int(np.dot(lengths, counts))))
        assert (got <= counts).all() and int((got * lengths).sum()) == sums(lengths, counts, budget)
    many = np.array(sorted(rng.sample(range(24_500, 120_000), 2000)))
    assert (mixing.fit(many, np.ones(2000, int), 70_000_001) * many).sum() == 70_000_001
    # beyond REACH a document that fits isn't left out
    assert mixing.fit(np.array([45_000_000, 100_000_000]), np.array([1, 1]), 50_000_000).tolist() == [1, 0]


def test_mixing_of_long_documents(spark):
    rows = [(1, "w " * 45_000, "en", "a"), (2, "w " * 100_000, "en", "a"), (3, "w " * 95_000, "en", "b")]
    got = {r["row"]["doc_id"]: r for r in mixing.mix(documents(spark, rows), weights=(5, 19), carry=["doc_id"]).collect()}
    assert round(got[1]["target"]) == 50_000 and {i: r["times"] for i, r in got.items()} == {1: 1, 2: 0, 3: 2}


# near duplicates --------------------------------------------------------------------------


def brute_classes(rows, width, num, den):
    sets, root = [], {}
    for i, t, _, _ in rows:
        w = words(t)
        g = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        sets.append((i, g))
    least = {}
    nodes = list(range(len(sets)))
    root = {k: k for k in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and den * len(x & y) >= num * len(x | y):
                root[top(a)] = top(b)
    for k in nodes:
        if sets[k][0] is not None:
            least[top(k)] = min(least.get(top(k), 1 << 60), sets[k][0])
    return collections.Counter((i, len(g), (least[top(k)] if g else i) if i is not None else None) for k, (i, g) in enumerate(sets))


def near_rows(seed=2):
    rng = random.Random(seed)
    rows, base = [], texts(seed, 25)
    common = " ".join(f"c{i}" for i in range(60))
    for g, t in enumerate(base):
        w = (t + " " + t[::-1]).split() + ([*common.split()] if g % 2 else [])
        for _ in range(rng.choice([1, 1, 2, 7])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                v[rng.randrange(len(v))] = f"q{rng.randint(0, 9)}"
            rows.append((rng.randint(0, 10**6), " ".join(v).title() if rng.random() < 0.2 else "  ".join(v), "en", "s"))
    return rows


@pytest.mark.parametrize("shape", [(3, 90, 100), (5, 80, 100)])
def test_classes(spark, odd, shape):
    width, num, den = shape
    rows = near_rows()
    for r in (rows, odd.rows):
        got = collections.Counter(tuple(x) for x in jaccard.classes(documents(spark, r).repartition(4), width, num, den).select("doc_id", "n_shingles", "component_id").collect())
        assert got == brute_classes(r, width, num, den)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "FAMILY", 5)
    monkeypatch.setattr(jaccard, "BROADCAST", 0)
    monkeypatch.setattr(jaccard, "ISIN", 0)
    rows = near_rows(7)
    got = collections.Counter(tuple(x) for x in jaccard.classes(documents(spark, rows)).collect())
    assert got == brute_classes(rows, 3, 90, 100)


def repeated_rows(seed=4):
    """A third of the rows under doc_id 0, of different texts with as many shingles each, and near copies of these."""
    rng = random.Random(seed)
    bases = [[f"b{g}x{i}" for i in range(60)] for g in range(8)]
    near = lambda g, k: " ".join([*bases[g][:-1], f"{k}"])
    rows = [(0, near(g, f"z{k}"), "en", "s") for g in range(8) for k in range(2)]
    rows += [(1 + 10 * g + k, near(g, f"y{k}"), "en", "s") for g in range(8) for k in range(3)]
    rows += [(500 + k, " ".join(f"u{k}x{i}" for i in range(60)), "en", "s") for k in range(5)] + [rows[0], rows[20], (0, "", "en", "s"), (None, rows[0][1], "en", "s")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("broadcast", [jaccard.BROADCAST, 0])
def test_one_doc_id_with_several_texts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(jaccard, "BROADCAST", broadcast)
    rows = repeated_rows()
    got = collections.Counter(tuple(x) for x in jaccard.classes(documents(spark, rows).repartition(4)).collect())
    assert got == brute_classes(rows, 3, 90, 100)


def test_components(spark):
    r = random.Random(1)
    e = spark.createDataFrame([(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(400 + i, 401 + i) for i in range(20)] + [(5, 5)], "u long, v long")
    assert sorted(jaccard.components(e).collect()) == sorted(jaccard.components(e, one_task=0).collect())
    assert jaccard.components(e.limit(0)).count() == 0


def test_parities_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, len(a) // 2, replace=False), rng.integers(0, 2**63, rng.integers(1, 100), dtype=np.uint64)]))
        assert jaccard._differing([jaccard.parities(a)], [jaccard.parities(b)])[0, 0] <= len(np.setxor1d(a, b))


def test_deduplicated(spark, odd, none):
    out = jaccard.deduplicated(odd, width=5, num=80, den=100)
    assert out.columns == odd.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(104) == 0 and kept.count(105) == 0 and kept.count(3) == 1 and kept.count(None) == 2 and kept.count(100) == 1
    assert jaccard.classes(none).count() == 0 and jaccard.deduplicated(none).count() == 0


def brute_components(rows, width, num, den):
    """Lists of the places in rows of each component; of texts without n-grams, those of each doc_id."""
    sets, out = [], []
    for i, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    for k, (i, _) in enumerate(rows):
        linked = lambda m, k=k: den * len(sets[k] & sets[m]) >= num * len(sets[k] | sets[m]) if sets[k] and sets[m] else not sets[k] and not sets[m] and rows[k][0] == rows[m][0]
        if i is not None:
            near = [c for c in out if any(linked(m) for m in c)]
            out = [c for c in out if c not in near] + [[k, *(m for c in near for m in c)]]
    return out


def check_distinct(before, after, width=5, num=80, den=100):
    """One row of each component, of its smallest doc_id; all rows without doc_id."""
    left = collections.Counter(after)
    for c in brute_components(before, width, num, den):
        least = min(before[k][0] for k in c)
        options = {before[k] for k in c if before[k][0] == least}
        assert sum(left.pop(o, 0) for o in options) == 1
    assert left == collections.Counter(r for r in before if r[0] is None)


def test_pipeline(spark, odd, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = [(i, t, "en", random.Random(k).choice("ab")) for k, (i, t, _, _) in enumerate([*repeated_rows(), *near_rows()])]
    docs = documents(spark, rows).unionByName(odd)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    seen, paths, write = [pairs(docs)], [], corpus_pipeline.written

    def watched(df, name):
        out, path = write(df, name)
        assert out.columns == docs.columns
        seen.append(pairs(out))
        paths.append(path)
        return out, path

    monkeypatch.setattr(corpus_pipeline, "written", watched)
    monkeypatch.setattr(quality, "THRESHOLD", 0.0)
    before = set(os.listdir(common.checkpoint_dir(spark).removeprefix("file:")))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = set(os.listdir(common.checkpoint_dir(spark).removeprefix("file:"))) - before
    assert {os.path.basename(p) for p in paths} & left == {os.path.basename(paths[-1])}
    assert not [x for x in left if not x.startswith(("stage-mixture", "pieces", "packed"))]
    all_, lang, good, apart, mix = seen
    assert not collections.Counter(lang) - collections.Counter(all_) and collections.Counter(good) == collections.Counter(lang) and len(good) > 100
    check_distinct(good, apart)
    assert set(mix) <= set(apart) and max(collections.Counter(mix).values()) <= 3 * max(collections.Counter(apart).values())
    assert collections.Counter(r["doc_id"] for r in got if r["piece"] == 0) == collections.Counter(i for i, _ in mix)
    check_sequences(got)


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, _quality double, _rejected boolean, _lang_pred string, _cosine double, row string, size string, k0 string, rejected string, score string, h long, _id long, _keep long, times int, cls string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.1, True, "x", 0.0, "r", "s", "k", "y", "z", 5, 6, 7, 8, "c") for i, t, lang, s in rows], CLASHES)


def test_stages_on_odd_tables(spark, odd, tmp_path):
    """Each stage alone: clashing names, nulls, empty and long texts, repeated rows, and no rows at all."""
    import corpus_pipeline

    rng = random.Random(8)
    known = [(1000 + i, " ".join(rng.choice(WORDS[k].split()) for _ in range(30)), k, "ab"[i % 2]) for i in range(60) for k in "xy"[i % 2]]
    rows = [*odd.rows, *known, known[0], (3000, "Это предложение на русском языке и оно довольно длинное", None, "a"), (3001, "q" * 30_000, None, "b")]
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(2000)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, empty = clashing(spark, rows).repartition(3), clashing(spark, [])
    count = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    whole = count(docs)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns, name
        if name == "packing":
            check_sequences(out.collect())
            continue
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        got = count(out)
        assert not (set(got) - set(whole)), name
        if name == "language":
            assert not got - whole and got[known[0][:2]] == 2 and not any(i in (100, 101, 102, 106, 3000, 3001) for i, _ in got)
            assert sum(got[r[:2]] for r in known[1:]) >= 58
        if name == "near_duplicates":
            check_distinct([(i, t) for i, t, _, _ in rows], got.elements())
        if name == "mixture":
            assert all(n <= 3 * whole[r] for r, n in got.items())


# fingerprints -----------------------------------------------------------------------------


def brute_signatures(text):
    w = [x for x in re.split(r"[^\w]|_", (text or "").lower()) if x]
    c = [x for x in w if x not in spotsigs.ANCHORS]
    out, before = [], 0
    for x in w:
        if x in spotsigs.ANCHORS:
            if before + spotsigs.CHAIN <= len(c):
                out.append(" ".join([x, *c[before : before + spotsigs.CHAIN]]))
        else:
            before += 1
    n = spotsigs.CHAIN
    out = out or ([" ".join(w[i : i + n + 1]) for i in range(len(w) - n)] if len(w) > n else [" ".join(w)])
    return {hashlib.md5(s.encode()).hexdigest()[: spotsigs.HASH] for s in out}


@pytest.mark.parametrize("full", [spotsigs.FULL, 6, 0])
def test_fingerprints(spark, odd, none, monkeypatch, full):
    monkeypatch.setattr(spotsigs, "FULL", full)
    check_fingerprints(spark, odd.rows, odd)
    assert spotsigs.edited(none).count() == 0


def test_fingerprints_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "FULL", 10)
    t = texts(12, 12)
    rows = [(7, t[k % 5], "en", "s") for k in range(40)] + [(i * 100, x, "en", "s") for i, x in enumerate(t)] + [(8, t[0], "en", "s")] * 3
    check_fingerprints(spark, rows, documents(spark, rows).repartition(3))


def check_fingerprints(spark, all_rows, docs):
    rows = sorted((r for r in all_rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    want = collections.Counter()
    for k, (i, t, _, _) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        a, b, c = (brute_signatures(x) for x in (t, e, nxt))
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), round(len(a & b) / len(a | b), 9), round(len(a & c) / len(a | c), 9)] += 1
    got = spotsigs.edited(docs).collect()
    assert len(got) == len(all_rows)
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got if r["doc_id"] is not None) == want


def test_next_of_sparse_numbers(spark):
    n = sorted({random.Random(i).choice([i, i * 5000, i * 20_000_000, -i]) for i in range(200)})
    got = {r["at"]: r["following"] for r in spotsigs._following(spark.createDataFrame([(x,) for x in n], "at long"), "at").collect()}
    assert got == dict(zip(n, [*n[1:], None], strict=True))


@pytest.mark.parametrize("part", [spotsigs.PART, 3])
def test_near_pairs(spark, odd, none, monkeypatch, part):
    monkeypatch.setattr(spotsigs, "PART", part)
    rows = [(i, t.replace("io", "the"), "en", "s") for i, t in enumerate(texts(9, 30))]
    rows += [(100 + i, t + " extra", "en", "s") for i, t, _, _ in rows[:15]] + [(200, rows[0][1], "en", "s")]
    rows += [(3, t + " the same passage", "en", "s") for i, t, _, _ in rows[:6]]  # one doc_id, several texts
    rows += [(300 + i, "of boiler plate the " + " the ".join(f"w{i}{k} x{i}{k}" for k in range(9)), "en", "s") for i in range(12)]  # one signature in all
    rows += [r for r in odd.rows if r[0] is None]
    for threshold in (0.6, 0.8):
        sets = {}
        for i, t, _, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
            sets.setdefault(frozenset(brute_signatures(t)), i)
        found = [(x, y) for x, y in itertools.combinations(sets, 2) if len(x & y) / len(x | y) >= threshold]
        want = collections.Counter((*sorted((sets[x], sets[y])), round(len(x & y) / len(x | y), 9)) for x, y in found)
        got = collections.Counter((r["a"], r["b"], round(r["likeness"], 9)) for r in spotsigs.near_pairs(documents(spark, rows).repartition(3), threshold).collect())
        assert got == want and want
    assert spotsigs.near_pairs(none).count() == 0


@pytest.mark.parametrize("threshold, small, large", [(0.55, 55, 100), (0.1, 1, 10), (0.1, 100, 1000), (0.7, 70, 100)])
def test_near_pairs_at_the_bound(spark, threshold, small, large):
    """Sets whose likeness is the threshold itself, where products and logarithms are rounded."""
    text = lambda n: " ".join(f"the a{k} b{k}" for k in range(n))
    rows = [(1, text(large), "en", "s"), (2, text(small), "en", "s")]
    assert [(r["a"], r["b"]) for r in spotsigs.near_pairs(documents(spark, rows), threshold).collect()] == [(1, 2)]


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    text = lambda k, i: " ".join(letters[k][(i + j) % 5] + letters[k][(i * j) % 5] + letters[k][j % 3] for j in range(30))
    docs = documents(spark, [(i, text(k, i), k, "s") for k, n in (("aa", 20), ("bb", 12), ("cc", 4)) for i in range(n)])
    model = langid.train(docs)
    assert model["langs"] == ["aa", "bb"]
    got = langid.identify(docs, model, ["lang"]).collect()
    assert {r["lang_pred"] for r in got} == {"aa", "bb"} and all(r["lang"] == r["lang_pred"] for r in got if r["lang"] != "cc")


# language model ---------------------------------------------------------------------------


def test_lm_score(spark, odd, none):
    train = [t for i, t, _, _ in odd.rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    train = [t for i, t, _, _ in odd.rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = collections.Counter(x for t in train for x in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t, _, _ in odd.rows:
        w = [*words(t), None]
        want[i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    got = lm_score.digest(odd).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_score.digest(none).count() == 0


def lm_of(seg):
    """Filters and counts of segments, and N, V."""
    rows = seg.collect()
    words, pairs = (lm_score.Filter({r["seg"]: len(r["filter"]) for r in rows if r["kind"] == k}, rows[0]["of"]) for k in (1, 2))
    for r in rows:
        (words if r["kind"] == 1 else pairs).put(r["seg"], r["filter"])
    return words, pairs, *(sum(r[c] for r in rows if r["kind"] == 1) for c in ("total", "n"))


def test_lm_broadcast_and_probes_agree(spark, odd, monkeypatch):
    seg = lm_score.train(odd.select("text"))
    key = lambda df: sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())
    one = key(lm_score.score(odd, seg))
    assert key(lm_score.score(odd, seg, max_broadcast=0)) == one
    monkeypatch.setattr(lm_score, "SLICE", 100)
    assert key(lm_score.score(odd, seg)) == one
    monkeypatch.setattr(lm_score, "FLUSH", 30)
    assert key(lm_score.score(odd, seg, max_broadcast=0)) == one
    assert lm_score.score(odd.limit(0), seg, max_broadcast=0).count() == 0
    rare = lm_score.train(odd.select("text"), hot=1)  # none is frequent: every n-gram asks its segment
    assert key(lm_score.score(odd, rare, max_broadcast=0)) == one
    none = lm_score.train(odd.limit(0).select("text"))
    assert {(r["n_known"], r["train_tokens"]) for r in lm_score.score(odd, none).collect()} == {(0, 0)}


def test_lm_segments_by_any_number_of_tasks(spark, odd, monkeypatch):
    monkeypatch.setattr(lm_score, "SEGMENT_TEXT", 64)
    rows = lambda df: sorted((r["kind"], r["seg"], r["n"], r["total"], r["filter"], r["keys"], r["counts"]) for r in df.collect())
    many, one = (lm_score.train(odd.select("text"), most_tasks=k) for k in (lm_score.MOST_TASKS, 1))
    assert rows(many) == rows(one) and len(rows(one)) > 20
    assert len({(k, s) for k, s, *_ in rows(one)}) == len(rows(one))


def test_lm_frequent_words_ask_no_segment(spark, monkeypatch):
    """A word of every batch is answered by the broadcast; the rest goes to segments, and scores stay."""
    monkeypatch.setattr(lm_score, "FLUSH", 10)
    docs = documents(spark, [(i, f"common word w{i} x{i % 7} common word", "en", "s") for i in range(80)])
    size = sum(len(f"common word w{i} x{i % 7} common word") for i in range(80))
    seg = lm_score.train(docs.select("text"), hot=size // 60)
    word = {w: int(next(lm_score.tokens([w]))[0]) for w in ("common", "word", "w3", "x3")}
    found = {k: np.concatenate([np.frombuffer(r["hot"], lm_score.HOT_ENTRY) for r in seg.collect() if r["kind"] == k]) for k in (1, 2)}
    assert dict(zip(found[1]["key"].tolist(), found[1]["exact"].tolist(), strict=True)) == {word["common"]: 160, word["word"]: 160, int(lm_score.END): 80}
    assert sorted(found[2]["exact"].tolist()) == [80, 160]
    key = lambda df: sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())
    assert key(lm_score.score(docs, seg, max_broadcast=0)) == key(lm_score.score(docs, seg))


def test_lm_score_equals_plain_loops(spark, odd):
    seg = lm_score.train(odd.select("text"))
    words_, pairs, n, v = lm_of(seg)
    c1, c2 = collections.Counter(), collections.Counter()
    for t in lm_score.tokens([r[1] for r in odd.rows]):
        c1.update(t.tolist())
        c2.update(zip(t.tolist(), t[1:].tolist(), strict=False))
    quantised = lambda x: float(lm_score.VALUES[lm_score.levels_of(np.array([x]))[0]]) if x else 0.0
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm_score.score(odd, seg).collect()}
    far = []
    for i, text, _, _ in odd.rows:
        t = next(lm_score.tokens([text])).tolist()
        one = lambda f, k: float(f.counts(np.array([k], np.uint64))[0])
        pair = lambda a, b: int(lm_score.pair_hashes(np.array([a, b], np.uint64))[0])
        probed = exact = 0.0
        for k, w in enumerate(t[:300]):
            for known in (False, True):
                c = (lambda x: quantised(c1[x])) if known else (lambda x: one(words_, x))
                uni = (c(w) + 1) / (n + v + 1)
                if k:
                    seen = quantised(c2[t[k - 1], w]) if known else one(pairs, pair(t[k - 1], w))
                    uni = (min(seen, c(t[k - 1])) + lm_score.MU * uni) / (c(t[k - 1]) + lm_score.MU)
                if known:
                    exact += math.log10(uni)
                else:
                    probed += math.log10(uni)
        if len(t) <= 300:
            assert got[i, len(t)] == pytest.approx(probed, abs=1e-6)
            far.append(abs(probed - exact) / abs(exact))
    assert np.mean(far) < 0.02  # what the filter's false positives change


def test_bloom_levels():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    counts = rng.zipf(1.7, len(keys)).clip(1, 10**6)
    raw = lm_score.make_filter(keys, counts)
    f = lm_score.Filter({0: len(raw)}, 1)
    f.put(0, raw)
    got = f.counts(keys)
    exact = lm_score.VALUES[lm_score.levels_of(counts)]
    assert (got >= exact).all() and (got == exact).mean() > 0.97
    assert (f.counts(rng.integers(0, 2**63, 4000, dtype=np.uint64)) > 0).mean() < 0.03
    low = lm_score.VALUES[lm_score.levels_of(np.arange(1, 5000))] / np.arange(1, 5000)
    assert low.min() > 0.75 and low.max() < 1.34
