"""Toxicity (operator 9): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learned on a bounded sample of labelled rows (`most`, least hashes of doc_id first); the weights
are one array of 2**bits floats, of which L1 leaves few, broadcast whole. Scores depend on the
text alone.

Nulls count as empty texts, whose score comes from the intercept. Labels that are null don't
count; of several labels for one document the largest holds. Without any label, or with one
class only, the score is the smoothed share of label 1 (0.25 without labels). Repeated rows give
repeated results; an empty table gives none; extra columns are left out or kept as asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.llm.session import cut
from argentum.llm.words import Words, mix

BITS = 21
#: Most labelled documents that the classifier is fitted on.
SAMPLE = 8000
#: Bytes of their features together; documents of the sample beyond aren't learned from.
SAMPLE_BYTES = 256 << 20
#: Documents of the sample that a feature must occur in; rarer ones identify single documents.
SUPPORT = 3
#: What a document of label 1 counts for against one of label 0.
POSITIVE = 3.0


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each document: (slots, n+1 offsets): words, pairs, and pairs with one word between."""
    h, doc, n = words.hashes(), words.doc(), len(words)
    kinds, of = [mix(h ^ np.uint64(0x51))], [doc]
    for gap, salt in ((1, 0x52), (2, 0x53)):
        if n > gap:
            same = doc[gap:] == doc[:-gap]
            kinds.append(mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(salt))[same])
            of.append(doc[gap:][same])
    slot = np.concatenate(kinds) >> np.uint64(64 - bits)
    key = np.unique(np.concatenate(of).astype(np.uint64) << np.uint64(bits) | slot)
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(key, np.arange(words.count + 1).astype(np.uint64) << np.uint64(bits))


def stripped(column: pa.Array) -> Words:
    """Words in lower case without marks at their ends, so that a word before a comma is the same word."""
    w = Words(column, lower=True)
    if len(w):
        mark = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()[]{}*_-", np.uint8))
        for _ in range(3):
            long = w.end - w.start > 1
            w.end = w.end - (long & mark[w.data[w.end - 1]])
            long = w.end - w.start > 1
            w.start = w.start + (long & mark[w.data[w.start]])
    return w


@dataclass
class Model:
    """Sparse weights: slots that are not zero, their values, and the intercept."""

    slots: np.ndarray
    values: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.slots] = self.values
        return out

    def score(self, column: pa.Array, weights: np.ndarray) -> np.ndarray:
        slots, of = features(stripped(column), self.bits)
        total = np.concatenate([[0.0], np.cumsum(weights[slots], dtype=np.float64)])
        return 1 / (1 + np.exp(-np.clip(self.bias + total[of[1:]] - total[of[:-1]], -35, 35)))


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0, passes: int = 4, support: int = SUPPORT, positive: float = POSITIVE) -> Model:
    """FTRL-proximal over (slots, label) rows: per-coordinate rates, L1 sets weights to exactly 0."""
    ones = sum(y for _, y in rows)
    if not rows or ones in (0, len(rows)):
        share = (ones + 0.5) / (len(rows) + 2)  # under one half without labels: nothing is rejected for want of them
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(share / (1 - share))), bits)
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the intercept, without L1

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        limit = np.where(at == size, 0.0, l1)
        return np.where(np.abs(zi) <= limit, 0.0, -(zi - np.sign(zi) * limit) / ((beta + np.sqrt(n[at])) / alpha + l2))

    often = np.zeros(size, np.int32)
    for slots, _ in rows:
        often[slots] += 1
    for k, (slots, y) in enumerate(rows):
        rows[k] = (slots[often[slots] >= support], y)
    for _ in range(passes):
        for slots, y in rows:
            at = np.append(slots, size)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - y) * (positive if y else 1.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    kept = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Model(kept, weights(kept).astype(np.float32), float(weights(np.array([size]))[0]), bits)


def calibrated(rows: list[tuple[np.ndarray, int]], bits: int = BITS, share: int = 5) -> Model:
    """Fits on all but every fifth row; slope and intercept of the log odds are then fitted on these (Platt), held near 1 and 0."""
    learn, check = [r for i, r in enumerate(rows) if i % share], [r for i, r in enumerate(rows) if not i % share]
    y = np.array([label for _, label in check], float)
    if not learn or y.sum() in (0, len(y)) or len({label for _, label in learn}) < 2:
        return fit(rows, bits)
    model = fit(learn, bits)
    dense = model.dense()
    z = np.array([model.bias + dense[slots].sum() for slots, _ in check])
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method on two numbers
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * z).sum() + (slope - 1), (p - y).sum() + 0.1 * shift])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        slope, shift = max(0.2, slope - float(np.clip(step[0], -0.5, 0.5))), shift - float(np.clip(step[1], -0.5, 0.5))
    return Model(model.slots, (model.values * slope).astype(np.float32), model.bias * slope + shift, bits)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Rows that are never learned from: crc32 of doc_id as text is divisible by `folds`."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, folds: int = 5, bits: int = BITS) -> Model:
    """Fits on at most `most` labelled documents outside the held-out fold.

    The sample is chosen from labels (small rows, top `most` by hash); its documents are then
    found by a join against that bounded table, and their features, not texts, go to the driver:
    of rows that share a doc_id those of the least text, and in the sample's order as many as SAMPLE_BYTES holds.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(folds=folds))
    known = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                slots, of = features(stripped(some.column(1)), bits)
                rows = [slots[x:y].astype("<i4").tobytes() for x, y in zip(of[:-1], of[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array(rows, pa.binary()), some.column(2)], ["doc_id", "slots", "label"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    made = cut(texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, slots binary, label int"), "features")
    upto = F.sum(F.octet_length("slots").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at most `most` rows
    found = made.join(F.broadcast(made.select("doc_id", upto.alias("upto")).filter(F.col("upto") <= SAMPLE_BYTES)), "doc_id").select("doc_id", "slots", "label").toArrow()
    rows = sorted(((hash_order(i), i, s, int(y > 0)) for i, s, y in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), found.column(2).to_pylist(), strict=True)))
    del found
    return calibrated([(np.frombuffer(s, "<i4"), y) for _, _, s, y in rows], bits)


def hash_order(i: int) -> int:
    """A fixed order of documents for learning, unrelated to their ids."""
    return int(mix(np.array([i & (1 << 64) - 1], np.uint64))[0])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), column: str = "score") -> DataFrame:
    """The columns `keep` of docs and a score: one map over the scan."""
    from pyspark.sql import types as T

    schema = T.StructType([f for c in keep for f in docs.schema.fields if f.name == c] + [T.StructField(column, T.DoubleType())])
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    text = list(keep).index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        dense = m.dense()
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(m.score(some.column(text), dense))], [*keep, column])

    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    scored = score(docs, train(docs, labels, most))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
