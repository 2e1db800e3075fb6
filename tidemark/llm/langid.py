"""Language identification by nearest clustered centroid.

A text is a vector of hashed character bigrams and trigrams of its letters (ASCII letters in
lower case, bytes of other letters as they are; every other character is a word boundary),
weighted 1 + ln(count) times idf and normalised. Every language has several centroids, from
spherical k-means over its sampled vectors. A text takes the language of the nearest centroid by
cosine and is rejected if it is farther than that language's limit for a text with so many
n-grams. A limit stands between two samples of cosines: those that texts of the language and
excerpts of every length have, and those of the same texts with their letters scrambled, which
are in no language. It is never under ``FLOOR``, where texts of other scripts are.

Fitting. Document frequencies are counted over all training rows, by features of which there
are ``FEATURES``: that table is what the driver gets. Centroids and limits are fitted on a sample
bounded by ``SAMPLE`` texts a language and ``SAMPLE_ALL`` in all: those of the smallest hashes
of doc_id and text, each distinct one once, so refits agree. They come as sparse vectors. The
broadcast model has at most ``CENTROIDS`` x ``MAX_LANGUAGES`` vectors of ``FEATURES`` floats:
where training rows name more languages, those of the most distinct texts are learned, ties by code
point, and texts in the others go to the nearest of these or are rejected.

Defined results: a text that is null, empty or without letters is ``und`` with score 0, and
rejected; without training rows every text is ``und``; ties go to the language first in code
point order; repeated rows are predicted each for itself. Whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold

FEATURES = 1 << 12
CENTROIDS = 4
SAMPLE = 500
SAMPLE_ALL = 20_000
MAX_LANGUAGES = 1000
#: Rejected below this share of the lowest percentile of the language's cosines, or less where
#: scrambled texts stay farther away than that, but not below the least share.
REJECT_SHARE, LEAST_SHARE = 0.75, 0.5
FLOOR = 0.04
#: Share of a language's sample that excerpts and scrambled texts are made of.
EXCERPTED = 0.25
SEED = 3
#: Texts are compared with training texts of as many n-grams: upper ends of the classes.
LENGTH_CLASSES = (8, 16, 32, 64, 128, 512)

_LETTER = re.compile(r"[^\W\d_]")
_BYTES = np.full(256, 0, np.uint32)
_BYTES[ord("a") : ord("z") + 1] = np.arange(1, 27)
_BYTES[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_BYTES[128:] = np.arange(27, 155)


def has_letter(text: str) -> bool:
    found = _LETTER.search(text)  # also numerals such as ² or Ⅷ, which are no letters
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text)))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text, ascending, and their counts."""
    b = _BYTES[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    b = np.concatenate([[0], b, [0]]).astype(np.uint32)
    inside = (b[:-1] > 0) | (b[1:] > 0)
    two = (b[:-1] * np.uint32(157) + b[1:]) * np.uint32(2654435761) >> np.uint32(21)
    mid = b[1:-1] > 0
    three = ((b[:-2] * np.uint32(157) + b[1:-1]) * np.uint32(157) + b[2:]) * np.uint32(2246822519) >> np.uint32(21)
    half = FEATURES // 2
    n = np.bincount(np.concatenate([two[inside] % half, half + three[mid] % half]).astype(np.int64), minlength=FEATURES)
    at = np.flatnonzero(n)
    return at, n[at]


def _vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(n)) * idf[at]
    return (w / (np.linalg.norm(w) or 1)).astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows of texts(text): documents with each feature, and documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs = np.zeros(FEATURES, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                df[features(text)[0]] += 1
                docs += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(df[at], docs)})

    rows = texts.mapInPandas(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, docs = np.zeros(FEATURES), 0
    for r in rows:
        if r["feature"] < 0:
            docs = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, docs


def _excerpts(text: str, seed: int) -> Iterator[tuple[int, str]]:
    """(1, excerpt) of each length class and (2, the same with its letters scrambled)."""
    rng = np.random.default_rng([SEED, seed & (2**63 - 1)])
    words = text.split()
    letters = [w for w in words if w[:1].isalpha()] or words
    for n in (1, *(c // 10 for c in LENGTH_CLASSES if c > 10), len(letters)):
        if not 0 < n <= len(letters):
            continue
        start = int(rng.integers(0, len(letters) - n + 1))
        part = " ".join(letters[start : start + n])
        yield 1, part
        yield 2, "".join(np.array(list(part))[rng.permutation(len(part))])


def _limits(cos: np.ndarray, classes: np.ndarray, kinds: np.ndarray) -> list[float]:
    """Of each length class, the cosine under which a text is rejected; a class with few texts takes the shorter one's."""
    out, low = [], FLOOR
    for k in range(len(LENGTH_CLASSES) + 1):
        own, not_own = cos[(classes == k) & (kinds < 2)], cos[(classes == k) & (kinds == 2)]
        if len(own) >= 10:
            least = float(np.percentile(own, 1))
            far = float(np.percentile(not_own, 99)) if len(not_own) >= 10 else 1.0
            low = max(FLOOR, min(REJECT_SHARE * least, max(LEAST_SHARE * least, far)))
        out.append(low)
    return out


def _length_class(n: float) -> int:
    return int(np.searchsorted(LENGTH_CLASSES, n))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts at rows spread by farthest-first from the mean."""
    k = min(k, len(x))
    start = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[start[0]]
    for _ in range(k - 1):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            if (own == j).any():
                m = x[own == j].mean(0)
                c[j] = m / (np.linalg.norm(m) or 1)
    return c


def train(labelled: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Model from all rows of labelled with a text and a language."""
    rows = labelled.select(
        F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{key}`").cast("string").alias("key")
    ).filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("key", "text"))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not per:
        return {"langs": [], "owner": np.zeros(0, int), "centroids": np.zeros((0, FEATURES), np.float32), "idf": np.ones(FEATURES), "limits": {}}
    df, docs = document_frequencies(rows.select("text"))
    idf = np.log((1 + docs) / (1 + df)) + 1
    each = min(sample, max(1, SAMPLE_ALL // len(per)))
    # twice as many by chance, then the first of each language by hash: the bound holds whatever is repeated
    share = F.create_map(*(F.lit(v) for k, n in sorted(per.items()) for v in (k, min(1.0, 2 * each / max(1, n)))))
    chosen = rows.filter(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))
    chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("place") <= each)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, h, place, t in zip(pdf["lang"], pdf["h"], pdf["place"], pdf["text"], strict=True):
                made = [(0, t)] + ([*_excerpts(t, h)] if place <= max(20, EXCERPTED * each) else [])
                for kind, made_text in made:
                    at, n = features(made_text)
                    out.append((lang, h, kind, at.astype("<i4").tobytes(), n.astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["lang", "h", "kind", "f", "n"])

    found: dict[str, list] = {}
    for r in chosen.mapInPandas(vectors, "lang string, h long, kind int, f binary, n binary").collect():
        found.setdefault(r["lang"], []).append((r["h"], r["kind"], bytes(r["f"]), bytes(r["n"])))
    langs, owner, centroids, limits = sorted(found), [], [], {}
    for i, name in enumerate(langs):
        x, size, kinds = [], [], []
        for _, kind, f, n in sorted(found[name]):
            at, n = np.frombuffer(f, "<i4"), np.frombuffer(n, "<i4")
            if len(at):
                row = np.zeros(FEATURES, np.float32)
                row[at] = _vector(at, n, idf)
                x.append(row)
                size.append(int(n.sum()))
                kinds.append(kind)
        kinds = np.array(kinds)
        if not (kinds == 0).any():
            continue
        x = np.array(x)
        c = k_means(x[kinds == 0], CENTROIDS)
        owner += [i] * len(c)
        centroids.append(c)
        cos, classes = (x @ c.T).max(1), np.searchsorted(LENGTH_CLASSES, size)
        for k, low in enumerate(_limits(cos, classes, kinds)):
            limits[i, k] = low
    return {"langs": langs, "owner": np.array(owner, int), "centroids": np.concatenate(centroids) if centroids else np.zeros((0, FEATURES), np.float32), "idf": idf, "limits": limits}


def classify(texts: list[str | None], model: dict) -> list[tuple[str, float, bool]]:
    """(language, cosine, rejected) of each text."""
    c, owner, idf = model["centroids"], model["owner"], model["idf"]
    out = []
    for text in texts:
        if not text or not len(c) or not has_letter(text):
            out.append(("und", 0.0, True))
            continue
        at, n = features(text)
        if not len(at):
            out.append((model["langs"][0], 0.0, True))
            continue
        cos = c[:, at] @ _vector(at, n, idf)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        limit = model["limits"][int(owner[best]), _length_class(n.sum())]
        out.append((model["langs"][owner[best]], score, score < limit))
    return out


def identify(docs: DataFrame, model: dict, keep: list[str], text: str = "text", names: tuple[str, ...] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Columns ``keep`` of docs with language, cosine and whether it's rejected, under names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = classify(b.column(len(keep)).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], *(pa.array(x, t) for x, t in zip(zip(*got, strict=True) if got else ((), (), ()), (pa.string(), pa.float64(), pa.bool_()), strict=True))],
                names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", "rejected"],
            )

    kept = [f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    out = inner.mapInArrow(run, ", ".join([*kept, "lang_pred string, score double, rejected boolean"]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(c).alias(n) for c, n in zip(("lang_pred", "score", "rejected"), names, strict=True)))


def held_out(key: Column) -> Column:
    return fold(key, 3) == 1


def digest(docs: DataFrame) -> DataFrame:
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
