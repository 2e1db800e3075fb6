"""Quality classifier: a byte-level convolutional network, trained and run in numpy.

A text's UTF-8 bytes are embedded and cut into chunks, of ``CHUNK`` and of ``SMALL`` windows;
chunks overlap by the window's width, so the windows of ``WIDTH`` bytes, ``STRIDE`` apart, cover
the whole text to its last byte, texts of any length. Every window meets ``FILTERS`` learned
filters (ReLU) and each chunk is max-pooled; a text's features are the maximum and the mean of
its chunks' maxima and the mean of its small chunks' maxima, combined by a logistic unit into
one probability.

Fitting. All labelled training documents that are there give the base rate of label 1. The weights
are learned from a sample bounded by ``sample`` of them for each label, chosen by a hash of doc_id
before anything is collected, and ``2 * sample * sample_bytes`` bytes in all, an equal share each: of
a longer text, ``SPANS`` seeded spans dealt over the whole of it. (Scoring reads every text whole.) The sample holds both labels alike; the
bias is then set back to the base rate. The seed is fixed, so refits agree. The model takes some
30 kB.

Defined results: null and empty texts are scored as one window of padding; without training
rows, or with one label only, every score is the base rate (1 if unknown); repeated rows are
scored each for itself; a doc_id counts once for each label that it has, labels of documents that
aren't there count for nothing; of a doc_id with several texts one is learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, materialise

EMBED, WIDTH, STRIDE, FILTERS, CHUNK, SMALL = 8, 8, 2, 24, 512, 16
#: Windows that are multiplied at once.
STEP = 8 * CHUNK
SAMPLE = 700
SAMPLE_BYTES = 6_000
SPANS = 6
THRESHOLD = 0.7
EPOCHS, BATCH, RATE, SEED = 6, 16, 0.01, 7
#: Small chunks that a text's mean is shrunk by, so that a few words aren't judged like a page.
SHRINK = 2


def padded(text: str | bytes | None) -> np.ndarray:
    """A text's bytes, with zeros up to the end of the last window."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")
    n = max(1, -(-max(0, len(raw) - WIDTH) // STRIDE) + 1)
    b = np.zeros((n - 1) * STRIDE + WIDTH, np.uint8)
    b[: len(raw)] = np.frombuffer(raw, np.uint8)
    return b


def windows(b: np.ndarray) -> np.ndarray:
    """The windows of padded bytes, or of their vectors: one below the other."""
    w = np.lib.stride_tricks.sliding_window_view(b, WIDTH, axis=0)[::STRIDE]
    return w if b.ndim == 1 else np.ascontiguousarray(w.transpose(0, 2, 1)).reshape(len(w), -1)


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    f = np.float32
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f),
        "filters": rng.normal(0, 1 / math.sqrt(EMBED * WIDTH), (WIDTH * EMBED, FILTERS)).astype(f),
        "bias": np.zeros(FILTERS, f),
        "out": rng.normal(0, 0.1, 3 * FILTERS).astype(f),
        "out_bias": np.zeros(1, f),
    }


def pooled(model: dict, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Features of a text's padded bytes, and what a gradient needs: where each chunk has its maxima."""
    tops, args, wide = [], [], []
    for at in range(0, (len(b) - WIDTH) // STRIDE + 1, STEP):
        x = windows(model["embed"][b[at * STRIDE : (at + STEP - 1) * STRIDE + WIDTH]])
        a = np.maximum(x @ model["filters"] + model["bias"], 0)
        n = -(-len(a) // SMALL)
        if len(a) < n * SMALL:
            a = np.concatenate([a, np.zeros((n * SMALL - len(a), FILTERS), np.float32)])
        small = a.reshape(n, SMALL, FILTERS)
        arg = small.argmax(1)
        tops.append(np.take_along_axis(small, arg[:, None], 1)[:, 0])
        args.append(arg + np.arange(n)[:, None] * SMALL + at)
        wide.append(np.maximum.reduceat(tops[-1], np.arange(0, n, CHUNK // SMALL), axis=0))
    tops, args, wide = np.concatenate(tops), np.concatenate(args), np.concatenate(wide)
    feats = np.concatenate([wide.max(0), wide.mean(0), tops.sum(0, dtype=np.float64) / (len(tops) + SHRINK)]).astype(np.float32)
    return feats, (tops, args, wide)


def _gradients(model: dict, b: np.ndarray, label: float, weight: float, grads: dict) -> None:
    feats, (tops, args, wide) = pooled(model, b)
    z = float(feats @ model["out"] + model["out_bias"][0])
    d = weight * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label)
    grads["out"] += d * feats
    grads["out_bias"] += d
    g_max, g_wide, g_small = np.split(d * model["out"], 3)
    dt = np.tile(g_small / (len(tops) + SHRINK), (len(tops), 1))  # of each small chunk's maximum
    per, cols = CHUNK // SMALL, np.arange(FILTERS)
    gw = np.tile(g_wide / len(wide), (len(wide), 1))
    gw[wide.argmax(0), cols] += g_max
    for c in range(len(wide)):
        part = tops[c * per : (c + 1) * per]
        dt[c * per + part.argmax(0), cols] += gw[c]
    dt *= tops > 0
    x = windows(model["embed"][b])
    da = np.zeros((len(tops) * SMALL, FILTERS), np.float32)
    da[args, cols] = dt
    da = da[: len(x)]
    grads["filters"] += x.T @ da
    grads["bias"] += dt.sum(0)
    dx = (da @ model["filters"].T).reshape(-1, WIDTH, EMBED)
    of_byte = np.zeros((len(b), EMBED), np.float32)
    for k in range(WIDTH):
        of_byte[k : k + STRIDE * len(x) : STRIDE][: len(x)] += dx[:, k]
    for j in range(EMBED):
        grads["embed"][:, j] += np.bincount(b, of_byte[:, j], 256)


def fit(texts: list[bytes], labels: list[int], base_rate: float) -> dict:
    """Adam on batches of texts; both labels weigh alike."""
    rng = np.random.default_rng(SEED)
    model = initial(rng)
    w = [padded(t) for t in texts]
    y = np.array(labels, float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m, v, step = {k: np.zeros_like(x) for k, x in model.items()}, {k: np.zeros_like(x) for k, x in model.items()}, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + RATE / 20
        order = rng.permutation(len(w))
        for at in range(0, len(order), BATCH):
            total = {k: np.zeros_like(x) for k, x in model.items()}
            for i in order[at : at + BATCH]:
                _gradients(model, w[i], y[i], weight[i], total)
            step += 1
            for k, x in model.items():
                g = total[k] / BATCH + 1e-4 * x * (k in ("filters", "out"))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    rate = min(max(base_rate, 1e-3), 1 - 1e-3)
    model["out_bias"] += np.float32(math.log(rate / (1 - rate)))
    return model


def excerpt(text: str | None, size: int, seed: int) -> bytes:
    """A text's bytes, or of a longer one ``SPANS`` spans of ``size`` bytes in all, dealt over the whole of it."""
    raw = (text or "").encode("utf-8", "replace")
    if len(raw) <= size:
        return raw
    rng = np.random.default_rng([SEED, seed & (2**63 - 1)])
    part, span = len(raw) // SPANS, size // SPANS
    starts = [i * part + int(rng.integers(0, part - span + 1)) for i in range(SPANS)]
    return b"".join(raw[at : at + span] for at in starts)


def train(docs: DataFrame, labels: DataFrame, trains: Column, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """docs and labels with doc_id; trains: a condition on the column ``key`` (doc_id)."""
    d = docs.select(F.col("`doc_id`").alias("key"), F.col("`text`").cast("string").alias("text"))
    lab = labels.select(F.col("`doc_id`").alias("key"), F.col("`quality`").cast("int").alias("y")).filter("y in (0, 1) AND key IS NOT NULL").filter(trains)
    # ids and labels of documents that are there, once each; every bound below is taken of these
    there = materialise(d.select("key").join(lab.distinct(), "key").distinct().withColumn("h", F.xxhash64(F.lit(SEED), F.col("key").cast("string"))), "labelled")
    per = {r["y"]: r["n"] for r in there.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = per.get(1, 0) / sum(per.values()) if per else 1.0
    if len(per) < 2:
        return {"constant": base}
    # the first of each label by hash: 2 * sample rows of two numbers are sent
    few = there.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy("h", "key"))).filter(F.col("place") <= sample)
    few = d.sparkSession.createDataFrame(few.select("key", "y", "h").collect(), there.schema)
    size = max(sample_bytes, 2 * sample * sample_bytes // sum(min(n, sample) for n in per.values()))  # fewer rows give longer excerpts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [excerpt(t.as_py(), size, seed) for t, seed in zip(b["text"], b["h"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["y"], b["h"], pa.array(raw, pa.binary())], names=["y", "h", "raw"])

    rows = d.join(F.broadcast(few), "key").select("text", "y", "h").mapInArrow(cut, "y int, h long, raw binary")
    # of a doc_id with several texts, the least; of each label, the first by hash
    rows = rows.groupBy("y", "h").agg(F.min("raw").alias("raw")).withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy("h"))).filter(F.col("place") <= sample)
    chosen = sorted((r["h"], r["y"], bytes(r["raw"])) for r in rows.collect())
    if len({y for _, y, _ in chosen}) < 2:
        return {"constant": base}
    return fit([raw for _, _, raw in chosen], [y for _, y, _ in chosen], base)


def probability(model: dict, text: str | None) -> float:
    if "constant" in model:
        return float(model["constant"])
    z = float(pooled(model, padded(text))[0] @ model["out"] + model["out_bias"][0])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: dict, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """Columns ``keep`` of docs and, under ``name``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [probability(shared.value, t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(got, pa.float64())], names=[*(f"k{i}" for i in range(len(keep))), "score"])

    kept = [f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    out = inner.mapInArrow(run, ", ".join([*kept, "score double"]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("score").alias(name))


def held_out(key: Column) -> Column:
    return fold(key, 4) == 2


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, ~held_out(F.col("key")))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
