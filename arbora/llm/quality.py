"""Quality of documents by a byte-level convolutional network, in numpy.

Bytes are embedded; learned filters of six bytes run over the whole text; their responses are max-pooled over chunks of
256 bytes that overlap by half; a small layer turns a chunk's maxima into a logit of being bad; the largest and the mean
logit of all chunks, and their number, make one probability.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import small_batches, table

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 6, 2, 48, 16
HALF = 128
CHUNK = 2 * HALF
#: Labelled documents a model learns from at most, of each label: those of the smallest hashes.
TRAIN_ROWS = 1500
#: Bytes that a scoring pass holds expanded at a time.
SEGMENT = 1 << 17
STEPS, BATCH, SEED = 500, 192, 5
Weights = dict[str, np.ndarray]


def fresh() -> Weights:
    r = np.random.default_rng(SEED)
    k = WIDTH * EMBED
    return {n: x.astype(np.float32) for n, x in {
        "e": r.normal(0, 0.5, (256, EMBED)), "w": r.normal(0, (2 / k) ** 0.5, (k, FILTERS)), "b": np.zeros(FILTERS),
        "v": r.normal(0, FILTERS**-0.5, (FILTERS + 1, HIDDEN)), "c": np.zeros(HIDDEN), "o": r.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
    }.items()}


def responses(p: Weights, raw: np.ndarray) -> np.ndarray:
    """(..., n bytes) -> (..., n / STRIDE - WIDTH / STRIDE + 1, FILTERS), before the rectifier."""
    pairs = p["e"][raw].reshape(*raw.shape[:-1], raw.shape[-1] // STRIDE, STRIDE * EMBED)
    n, step = pairs.shape[-2] - WIDTH // STRIDE + 1, STRIDE * EMBED
    out = pairs[..., :n, :] @ p["w"][:step]
    for k in range(1, WIDTH // STRIDE):
        out += pairs[..., k : k + n, :] @ p["w"][k * step : (k + 1) * step]
    return out


def padded(text: bytes) -> np.ndarray:
    """Whole halves of a text, one at least."""
    out = np.zeros(max(1, -(-len(text) // HALF)) * HALF, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def pooled(p: Weights, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The maxima of each half, with the share of it that is text; and where each text's halves start."""
    whole = [padded(t) for t in texts]
    raw = np.concatenate([*whole, np.zeros(WIDTH, np.uint8)])
    starts = np.cumsum([0, *(len(x) // HALF for x in whole)])
    out = np.zeros((starts[-1], FILTERS + 1), np.float32)
    inside = np.ones((len(raw) - WIDTH) // STRIDE, bool)  # windows that lie in one text
    for t, a, b in zip(texts, starts[:-1] * HALF, starts[1:] * HALF, strict=True):
        inside[(a + max(0, len(t) - WIDTH + 1) + STRIDE - 1) // STRIDE : b // STRIDE] = False
        out[a // HALF : b // HALF, FILTERS] = np.clip(len(t) - np.arange(0, b - a, HALF), 0, HALF) / HALF
    for a in range(0, len(raw) - WIDTH, SEGMENT):
        b = min(a + SEGMENT, len(raw) - WIDTH)
        r = np.maximum(responses(p, raw[a : b + WIDTH])[: (b - a) // STRIDE] + p["b"], 0)
        r[~inside[a // STRIDE : b // STRIDE]] = 0
        out[a // HALF : b // HALF, :FILTERS] = r.reshape(-1, HALF // STRIDE, FILTERS).max(axis=1)
    return out, starts


def logits(p: Weights, texts: list[bytes]) -> list[np.ndarray]:
    """Of each text, its chunks' logits of being bad."""
    halves, starts = pooled(p, texts)
    nxt = np.minimum(np.arange(len(halves)) + 1, np.repeat(np.maximum(starts[1:] - 1, starts[:-1]), np.diff(starts)))
    chunks = np.maximum(halves, halves[nxt])
    chunks[:, FILTERS] = np.where(nxt > np.arange(len(halves)), halves[:, FILTERS] + halves[nxt, FILTERS], halves[:, FILTERS]) / 2
    z = np.maximum(chunks @ p["v"] + p["c"], 0) @ p["o"] + p["d"]
    # the last half is in the chunk before, unless it is alone
    return [z[a : max(a + 1, b - 1)] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def gradients(p: Weights, raw: np.ndarray, fill: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> Weights:
    """Of the mean log loss of chunks (B, CHUNK), of which ``fill`` bytes are text."""
    n = len(raw)
    r = responses(p, raw)
    r[np.arange(r.shape[1]) * STRIDE + WIDTH > fill[:, None]] = -np.inf
    best = r.argmax(axis=1)
    top = np.take_along_axis(r, best[:, None, :], axis=1)[:, 0] + p["b"]
    m = np.concatenate([np.maximum(top, 0), (fill / CHUNK)[:, None]], axis=1).astype(np.float32)
    h = np.maximum(m @ p["v"] + p["c"], 0)
    z = h @ p["o"] + p["d"]
    dz = ((1 / (1 + np.exp(-z)) - bad) * weight / weight.sum()).astype(np.float32)
    dh = dz[:, None] * p["o"] * (h > 0)
    dm = (dh @ p["v"].T)[:, :FILTERS] * (top > 0)
    window = raw[np.arange(n)[:, None, None], best[:, :, None] * STRIDE + np.arange(WIDTH)]  # bytes at each maximum
    dw = np.einsum("bf,bfk->kf", dm, p["e"][window].reshape(n, FILTERS, -1), optimize=True)
    de = np.zeros_like(p["e"])
    np.add.at(de, window.ravel(), (dm[:, :, None] * p["w"].T[None]).reshape(-1, EMBED))
    return {"e": de, "w": dw, "b": dm.sum(0), "v": m.T @ dh, "c": dh.sum(0), "o": h.T @ dz, "d": dz.sum(keepdims=True)}


def features(z: np.ndarray) -> list[float]:
    return [float(z.max()), float(z.mean()), float(np.log(len(z)))]


def train(texts: list[bytes], good: np.ndarray) -> Weights:
    """Learns from whole texts: chunks at random first, then with the worst chunks of all; then how their logits combine."""
    p, rng = fresh(), np.random.default_rng(SEED)
    moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    bad = 1.0 - good
    share = np.clip(bad.mean(), 0.02, 0.98)
    by = [np.flatnonzero(bad == k) for k in (0, 1)]
    wide = [np.concatenate([padded(t), np.zeros(CHUNK, np.uint8)]) for t in texts]
    worst: np.ndarray | None = None
    for step in range(STEPS if len(texts) and all(map(len, by)) else 0):
        if step in (STEPS // 2, 3 * STEPS // 4):  # chunks of good texts that look bad teach most
            worst = np.array([int(z.argmax()) for t in range(0, len(texts), 32) for z in logits(p, texts[t : t + 32])])
        pick = np.concatenate([rng.choice(by[1], BATCH // 3), rng.choice(by[0], BATCH - BATCH // 3)])
        at = np.array([rng.integers(0, max(1, -(-len(texts[i]) // HALF) - 1)) for i in pick]) * HALF
        if worst is not None:
            hard = (rng.random(BATCH) < 0.5) & (bad[pick] == 0)
            at[hard] = worst[pick[hard]] * HALF
        raw = np.stack([wide[i][a : a + CHUNK] for i, a in zip(pick, at, strict=True)])
        fill = np.array([min(CHUNK, len(texts[i]) - a) for i, a in zip(pick, at, strict=True)])
        fill = np.maximum(fill, WIDTH)
        g = gradients(p, raw, fill, bad[pick], np.where(bad[pick] == 1, share * 3, (1 - share) * 1.5))
        rate = 4e-3 * (1 - step / STEPS) + 2e-4
        for k, x in g.items():
            a, b = moment[k]
            a += 0.1 * (x - a)
            b += 0.01 * (x * x - b)
            p[k] -= rate * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(b / (1 - 0.99 ** (step + 1))) + 1e-8)
    x = np.array([features(z) for t in range(0, len(texts), 32) for z in logits(p, texts[t : t + 32])]).reshape(-1, 3)
    return p | combine(x, good)


def combine(x: np.ndarray, good: np.ndarray) -> Weights:
    """Ridge logistic regression of the label on a text's features, by Newton's method. Few labels or one: near their share."""
    mean, sd = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(3), np.ones(3))
    a = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    beta = np.zeros(4)
    beta[0] = np.log((good.sum() + 1) / (len(good) - good.sum() + 1))
    ridge = np.diag([1e-3, 0.05, 0.05, 1.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + ridge, a.T @ (good - q) - ridge @ (beta - [beta[0], 0, 0, 0]))
        beta += step if np.abs(step).max() < 5 else step * 5 / np.abs(step).max()
    return {"beta": beta, "mean": mean, "sd": sd}


def probability(p: Weights, texts: list[bytes]) -> np.ndarray:
    x = np.array([features(z) for z in logits(p, texts)]).reshape(-1, 3)
    return 1 / (1 + np.exp(-np.clip(p["beta"][0] + ((x - p["mean"]) / p["sd"]) @ p["beta"][1:], -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Weights:
    """From documents with a label and an id of the training rows; at most ``most`` of each label, which one task learns from; only weights come to the driver."""
    have = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    few = [have.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few[0].union(few[1])), "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, t or "", k) for batch in batches for i, t, k in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        out = io.BytesIO()
        np.savez(out, **train([t.encode("utf-8", "replace") for _, t, _ in got], np.array([k for _, _, k in got], np.float64)))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    made = rows.select("doc_id", "text", F.col("quality").cast("int")).repartition(1).mapInArrow(learn, "model binary").collect()
    if not made:  # no rows, no task
        return train([], np.zeros(0))
    with np.load(io.BytesIO(made[0].model)) as model:
        return dict(model)


def score(docs: DataFrame, model: Weights, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability that the label is 1, from the whole text alone.

    Null texts count as empty, and those get the score of a text without bytes. Rows are scored one by one, so that
    repeated ones agree; a former score column is replaced; other columns are kept.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score") if "score" in docs.columns else docs
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 32):
                batch = whole.slice(k, 32)
                texts = [(t or "").encode("utf-8", "replace") for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability(model, texts))], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
