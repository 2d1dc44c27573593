"""Quality scores by hashed word n-grams (operator 12).

Words are runs of letters, digits and characters outside ASCII; each run of one sign counts as
a word as well. A text's features are its words, pairs of neighbouring words and the repeats of a
word one or two words on (whatever the word), hashed to `2**bits` buckets; a bucket with c of a
text's N n-grams has the value sqrt(c / N), so texts of any length have norm 1. A logistic regression over them is trained by follow-the-regularised-
leader updates (per coordinate, L1 and L2), and scores a text by a sparse dot product.

Training takes at most `per_class` rows of each label, those whose ids hash lowest, and goes
through them until it has made `steps` updates, twice at least, in which both labels weigh the
same; the copies are sorted so that the trainer, one task, reads a row at a time and holds
nothing but the model. The model, 2**bits numbers of 4 bytes, is broadcast.

Odd input: a null or empty text has no features, its score is that of the bias alone. An id
labelled both ways teaches nothing, nor does a label other than 0 and 1, a null id or one without
a document; of several texts with one id the smallest teaches. Every row is scored, repeated
ones alike. Without labelled rows all scores are 0.5. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import doc_groups, materialize, small_batches, text_buffers
from folioscan.llm.shingles import PIECE, _power_tables, mix, stream

BITS, PER_CLASS, STEPS, THRESHOLD = 18, 4000, 20_000, 0.3
_U = np.uint64
#: 0 for what parts words, 1 for what makes them, 2 for other signs.
KIND = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_BYTE = stream(256, 12)
_SECOND = stream(1, 13)[0] | _U(1)
_SAME, _SAME_AFTER_NEXT = stream(2, 14)


@dataclass(frozen=True)
class Rates:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.01


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the rows that offsets delimit in data."""
    low, high = int(offsets[0]), int(offsets[-1])
    data = data[low:high]
    kind = KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == 2) & (data[1:] != data[:-1]))
    inner = offsets - low
    new[inner[(inner > 0) & (inner < len(data))]] = True
    edges = np.append(np.flatnonzero(new), len(data))
    is_word = kind[edges[:-1]] > 0
    start, end = edges[:-1][is_word], edges[1:][is_word]
    out = np.empty(len(start), _U)
    with np.errstate(over="ignore"):
        for i, j in doc_groups(np.append(start, end[-1:]), PIECE):
            piece = data[start[i] : end[j - 1]]
            power, inverse = _power_tables(len(piece))
            total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[piece] * power[: len(piece)], dtype=_U)])
            a, b = start[i:j] - start[i], end[i:j] - start[i]
            out[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(_U))
    return out, np.searchsorted(inner, start, "right") - 1


def features(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets in order, values) of each row."""
    data, offsets = text_buffers(column)
    for i, j in doc_groups(offsets, PIECE):
        word, row = hashed_words(data, offsets[i : j + 1])
        with np.errstate(over="ignore"):
            pair = np.where(word[:-1] == word[1:], _SAME, mix(word[:-1] * _SECOND + word[1:]))
        inside, again = row[:-1] == row[1:], (word[:-2] == word[2:]) & (row[:-2] == row[2:])
        hashed = np.concatenate([word, pair[inside], np.full(again.sum(), _SAME_AFTER_NEXT)])
        key = np.concatenate([row, row[:-1][inside], row[:-2][again]]) << bits | (hashed >> _U(64 - bits)).astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        bounds = np.searchsorted(key >> bits, np.arange(j - i + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield key[a:b] & ((1 << bits) - 1), np.sqrt(count[a:b] / max(1, count[a:b].sum()))


class Ftrl:
    """Follow the regularised leader, per coordinate; the last coordinate is the bias, free of penalties."""

    def __init__(self, size: int, rates: Rates):
        self.z, self.n, self.rates = np.zeros(size + 1), np.zeros(size + 1), rates

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, r = self.z[at], self.rates
        free = at == len(self.z) - 1
        l1, l2 = np.where(free, 0.0, r.l1), np.where(free, 0.0, r.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((r.beta + np.sqrt(self.n[at])) / r.alpha + l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = weight * (chance(float(w @ x)) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.rates.alpha * w
        self.n[at] += g * g


def chance(score: float) -> float:
    return 1 / (1 + math.exp(-score)) if score >= 0 else math.exp(score) / (1 + math.exp(score))


def _extract(bits: int) -> Callable:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at.astype(np.int32).tobytes(), x.astype(np.float32).tobytes()) for at, x in features(batch.column(2), bits)]
            own = [pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["doc_id", "label", "at", "x"])

    return extract


def _trainer(bits: int, rates: Rates, weight: dict[int, float]) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(1 << bits, rates)
        for batch in batches:
            for label, at, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                model.learn(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), label, weight[label])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(np.arange(len(model.z))).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    return train


def learns(doc_id: Column) -> Column:
    """Whether an id's label may be learned: crc32 of its digits isn't a multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def train_quality(docs: DataFrame, labels: DataFrame, bits: int = BITS, per_class: int = PER_CLASS, steps: int = STEPS, rates: Rates = Rates()) -> np.ndarray:  # noqa: B008
    """The weights of a model of labels.quality; the last one is the bias."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(learns(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = materialize(marked.join(rows.select("doc_id"), "doc_id", "left_semi"), "marked")
    lowest = lambda label: marked.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    sample = materialize(lowest(0).union(lowest(1)), "sample")  # at most 2 per_class ids
    n = {label: sample.where(F.col("label") == label).count() for label in (0, 1)}
    weight = {label: sum(n.values()) / (2 * max(1, n[label])) for label in n}
    epochs = max(2, -(-steps // max(1, sum(n.values()))))
    texts = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    taught = small_batches(texts.select("doc_id", "label", "text")).mapInArrow(_extract(bits), "doc_id long, label int, at binary, x binary")
    taught = taught.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = taught.repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "doc_id"), "doc_id").select("label", "at", "x")
    model = ordered.mapInArrow(_trainer(bits, rates, weight), "weights binary").first()
    return np.frombuffer(model[0], np.float32) if model else np.zeros((1 << bits) + 1, np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; nothing is shuffled."""
    sent, bits = docs.sparkSession.sparkContext.broadcast(weights), (len(weights) - 1).bit_length() - 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(np.float64)
        for batch in batches:
            scores = [chance(float(w[at] @ x + w[-1])) for at, x in features(batch.column(1), bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = small_batches(rows).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Scores of all documents under a model of the labels outside the held-out fifth."""
    return score_quality(docs, train_quality(docs, labels, per_class=per_class))
