"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import ALNUM, _table, hash_words, mixed, read, saved, shingle_hashes

#: log2 of the number of weights: the model has that many at most.
BITS = 20
#: Labelled rows that training takes at most (those with the smallest hash of doc_id), and rows of one learner.
TRAIN_ROWS, LEARNER_ROWS = 20_000, 5_000
EPOCHS = 4
#: Bytes of text whose words are held at a time.
SLICE = 1 << 20
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
#: Bytes of runs of ASCII punctuation.
MARKS = _table((0x00, 0x20), (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x7F, 0xFF))


def features(texts: pa.Array, bits: int = BITS):
    """For each text its feature numbers and values (of length 1 together; 0 is the constant feature).

    n-grams of three streams: words (1, 2), runs of punctuation (1, 2) and word shapes (1 to 3): how a
    word is capitalised, its length class, and whether it repeats the word before it. Texts are taken
    ``SLICE`` bytes at a time, so memory does not grow with their number.
    """
    until = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + SLICE, "right")))
        yield from _features(texts.slice(at, end - at), bits)
        at = end


def _features(texts: pa.Array, bits: int):
    word, at, size, caps = hash_words(texts, ALNUM, shapes=True)
    mark, mark_at = hash_words(texts, MARKS)
    same = np.zeros(len(word), np.int64)
    same[1:] = word[1:] == word[:-1]
    same[at[at < len(word)]] = 0  # the first word of a text repeats none
    shape = np.where(caps == 0, 0, np.where(caps == size, 2, 1)) + 3 * same + 6 * np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 6)
    shape = mixed(shape.astype(np.uint64) + np.uint64(1 << 40))
    top = np.uint64((1 << bits) - 1)
    for i in range(len(texts)):
        grams = [shingle_hashes(stream[b[i] : b[i + 1]], k) + np.uint64(s) for s, (stream, b, most) in enumerate(((word, at, 2), (mark, mark_at, 2), (shape, at, 3))) for k in range(1, most + 1)]
        index, n = np.unique(mixed(np.concatenate(grams)) % top + np.uint64(1), return_counts=True)
        value = n / max(1.0, float(np.sqrt((n * n).sum())))
        yield np.append(index.astype(np.int64), 0), np.append(value, 0.5)


class Ftrl:
    """FTRL-proximal for logistic loss; keeps two sums a weight."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] += g * g


def train(rows: DataFrame, learner_rows: int = LEARNER_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights from ``(doc_id, text, label)``, whose number the caller bounds.

    Rows are dealt by hash to learners of about ``learner_rows`` rows, which Spark trains side by side;
    the weights are the learners' means. Without rows all weights are 0.
    """
    learners = max(1, round(rows.count() / learner_rows))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        x = list(features(table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())))
        y = table["label"].to_pylist()
        model = Ftrl()
        for epoch in range(epochs):
            for j in np.random.RandomState(epoch).permutation(len(x)):
                model.update(*x[j], y[j])
        some = np.flatnonzero(model.n)
        w = model.weights(some)
        return pa.table({"i": pa.array(some[w != 0]), "w": pa.array(w[w != 0])})

    dealt = rows.withColumn("learner", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(learners)))
    means = dealt.groupBy("learner").applyInArrow(run, "i long, w double").groupBy("i").agg((F.sum("w") / learners).alias("w")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[means["i"].to_numpy()] = means["w"].to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(row, score)``: each row of ``docs`` as a struct and the probability of label 1. The weights, at
    most 2**BITS floats, are broadcast. Null and empty texts have the constant feature only."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            s = [1 / (1 + np.exp(-np.clip(float(w[i] @ x), -35, 35))) for i, x in features(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("row", F.lit(0.0).alias("score")).schema)


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``bound`` labelled documents outside the held-out fold."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").alias("label")).where(fold(F.col("doc_id"), 3) != 1).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # ids only; the bound makes it small enough to broadcast
    return saved(docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, bound: int = TRAIN_ROWS) -> DataFrame:
    """``(row, score)`` of all ``docs``, by a model trained on ``labels(doc_id, quality)``.

    Repeated label rows count once; labels without a document and rows with null labels are ignored.
    """
    return score(docs, train(training_rows(training_docs if training_docs is not None else docs, labels, bound)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, read(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("row.doc_id"), 3) == 1, F.lit(False))
    return scored.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
