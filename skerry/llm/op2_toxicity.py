"""Toxicity by subword bags.

Every character n-gram (3 to 6) of ``<word>`` is hashed to one of BUCKETS embedding rows. A text is the mean of its words'
n-gram rows, and a linear softmax over that mean gives the two classes; rows and softmax are trained together in numpy
(momentum, minibatches; steps follow an n-gram's share of the texts, so that rare n-grams stay near zero). A misspelling that was never seen still shares n-grams with its word.

The fit sees at most ``max_train_rows`` labelled texts, those of smallest hash, chosen before any text is read; their whole texts are
reduced to bucket counts on the executors. Scoring is one pass without a shuffle: as mean and softmax are linear, each bucket adds one
number, which is summed for each different word of a block and then for each text.

Null and empty texts have no n-grams and score the training share of toxic texts. Without labelled rows every score is 0.05.
Rows with a null label or id are not learned from; a repeated id is learned from once, as toxic if any label says so, and by the text whose bag sorts first. Null ids are scored, and not held out.
Very long texts form a block of their own and are read whole; empty tables give no rows; columns besides id, text and label are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.blocks import BASE, Block, mix, text_blocks

BUCKETS, WIDTH, SIZES = 1 << 15, 8, (3, 4, 5, 6)
MAX_TRAIN_ROWS, EPOCHS, LEAST_STEPS, BATCH, RATE = 6000, 10, 400, 128, 100.0
THRESHOLD = 0.3


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of each lower-cased word in angle brackets, and its word's index."""
    marked = [f"<{w.lower()}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(marked)))
    buckets, owners = [], []
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for k in range(n):
            h = h * BASE + points[k : k + m]
        inside = owner[:m] == owner[n - 1 :]
        buckets.append((mix(h[inside]) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[:m][inside])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _words(b: Block) -> tuple[np.ndarray, list[str]]:
    codes, different = pd.factorize(b.words(lower=True))
    first = np.zeros(len(different), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, b.word_text(first)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in text_blocks(batch.column(2)):
            codes, words = _words(b)
            bucket, owner = subwords(words)
            order = np.argsort(owner, kind="stable")
            bucket = bucket[order]
            at = np.searchsorted(owner[order], np.arange(len(words) + 1))
            out = []
            for d in range(b.docs):
                used, times = np.unique(codes[b.first_word[d] : b.first_word[d + 1]], return_counts=True)
                size = at[used + 1] - at[used]
                mine = bucket[np.repeat(at[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                count = np.bincount(mine, np.repeat(times, size), minlength=BUCKETS)
                rows = np.flatnonzero(count)
                out.append((rows.astype(np.uint16).tobytes(), (count[rows] / max(count.sum(), 1)).astype(np.float16).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(b.first, b.docs) for k in (0, 1)] + [pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["id", "label", "rows", "share"])


class SubwordSoftmax:
    """Embedding rows, softmax weights and biases."""

    def __init__(self, share: float = 0.05):
        rng = np.random.default_rng(11)
        self.rows = rng.normal(0, 0.001, (BUCKETS, WIDTH)).astype(np.float32)
        self.weights = np.zeros((WIDTH, 2), np.float32)
        self.bias = np.log(np.array([1 - share, share], np.float32))

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = EPOCHS) -> SubwordSoftmax:
        rng = np.random.default_rng(12)
        self.weights = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
        speed = np.zeros_like(self.rows)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.weights, self.bias)]
        step = 0
        epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(bags)))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for s in range(0, len(order), BATCH):
                take = order[s : s + BATCH]
                x = np.zeros((len(take), BUCKETS), np.float32)
                for r, i in enumerate(take):
                    x[r, bags[i][0]] = bags[i][1]
                mean = x @ self.rows
                z = mean @ self.weights + self.bias
                z = np.exp(z - z.max(1, keepdims=True))
                error = z / z.sum(1, keepdims=True)
                error[np.arange(len(take)), label[take]] -= 1
                error /= len(take)
                step += 1
                speed *= 0.9
                speed += x.T @ (error @ self.weights.T)
                head = zip((self.weights, self.bias), (mean.T @ error, error.sum(0)), moments, strict=True)
                self.rows -= RATE * speed
                for p, g, (m, v) in head:
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def table(self) -> tuple[np.ndarray, float]:
        """What one n-gram of each bucket adds to the log-odds, and the log-odds of an empty mean."""
        return (self.rows @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def score_block(b: Block, table: np.ndarray, bias: float, empty: float) -> np.ndarray:
    codes, words = _words(b)
    bucket, owner = subwords(words)
    total = np.bincount(owner, table[bucket], minlength=len(words))
    count = np.bincount(owner, minlength=len(words))
    n = np.bincount(b.word_doc, count[codes], minlength=b.docs)
    odds = np.bincount(b.word_doc, total[codes], minlength=b.docs) / np.maximum(n, 1) + bias
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(odds, -700, 700))), empty)


def held_out(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> tuple[SubwordSoftmax, float]:
    """The model, and the share of toxic texts among those learned from. ``docs``: id, text; ``labels``: id, label (0/1)."""
    known = labels.filter("id is not null and label is not null").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_train_rows)  # so many rows at most
    bags = docs.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(_bags, "id long, label int, rows binary, share binary")
    got = bags.groupBy("id").agg(F.min(F.struct("label", "rows", "share")).alias("x")).select("id", "x.*").toArrow()
    if not got.num_rows:
        return SubwordSoftmax(), 0.05
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    label = (got["label"].to_numpy()[order] > 0).astype(np.int64)
    share = float((label.sum() + 0.5) / (len(label) + 10))
    rows, shares = (got[c].combine_chunks() for c in ("rows", "share"))
    pairs = [(np.frombuffer(rows[i].as_buffer(), np.uint16), np.frombuffer(shares[i].as_buffer(), np.float16)) for i in order.tolist()]
    return SubwordSoftmax(share).fit(pairs, label), share


def toxicity_score(text: Column, model: SubwordSoftmax, empty: float) -> Column:
    table, bias = model.table()

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [score_block(b, table, bias, empty) for b in text_blocks(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")).filter(~held_out(F.col("id"), 4))
    model, share = train(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    out = docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), toxicity_score(F.col("text"), model, share).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
