"""LM scoring (operator 3): a log-bilinear model, trained in numpy with noise-contrastive estimation.

Symbols are the most frequent words and, for all other words, classes by the word's last bytes, so
every word has a symbol, seen or not. Two preceding symbols predict the next one: the context's
vectors add up, and their product with an output vector, plus a bias, is the log score. Scores of two
contexts add, so sums over the vocabulary for all pairs of preceding symbols are one product of two
matrices, and probabilities are normalised exactly. A word of a class has the class's probability times
its smoothed share of the class.

Counts are over all training tokens of all documents. Texts become symbols once, in a written table, from
which both training and scoring read. Documents are dealt to shards by a hash of doc_id; every shard trains
the model on all its training tokens from one start, and shards' parameters are averaged by tokens (iterative
parameter mixing). Shards and the order in them depend on the documents alone, so scores don't change with
files or partitions. Words beyond the bounded head are counted and looked up by joins.

Nulls count as empty texts, which have the end token alone. Rows without doc_id are held out. Repeated
rows are scored each. Without training tokens all probabilities come from the smoothing alone. An
empty table gives no row. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.session import cut
from argentum.llm.words import Words, mix

#: Words with a symbol of their own; classes of other words; the size of vectors.
WORDS, CLASSES, SIZE = 1535, 512, 32
#: Words whose counts every worker holds (12 bytes each); counts of others are joined.
HEAD = 1 << 16
SMOOTH = 0.1
END = np.uint64(0)  # the end token's hash; no word has it but by chance of 2**-64
NOISE, BATCH = 256, 4096
#: Rows of a batch whose products with the noise are made at once: they stay in a core's cache.
ROWS = 512
#: Training tokens of a shard, and the pieces in which its parameters are averaged.
SHARD, BLOCKS = 1 << 22, 256
#: Most tasks that train at the same time; each may have several shards.
TASKS = 10_000


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token of each text, an end after every text: (hashes, classes, n+1 offsets)."""
    w = Words(column, lower=True)
    h = w.hashes()
    h[h == END] = np.uint64(1)
    size = w.end - w.start
    tail = np.zeros(len(w), np.uint64)
    for k in (1, 2, 3):
        long = size >= k
        tail[long] = tail[long] << np.uint64(8) | w.data[w.end[long] - k]
    classes = (mix(tail) % np.uint64(CLASSES)).astype(np.int32)
    at = w.of[1:]
    return np.insert(h, at, END), np.insert(classes, at, 0), w.of + np.arange(len(w.of))


def learned(folds: int = 10):
    """Rows to learn from: crc32 of doc_id as text is not divisible by `folds`."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0, F.lit(False))


def counted(docs: DataFrame) -> DataFrame:
    """word (hash), class, n over all training tokens; counted in each part before the exchange. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def sums(some: list[tuple]) -> tuple:
            h, c, n = (np.concatenate(x) for x in zip(*some, strict=True))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, c[first], np.bincount(back, weights=n, minlength=len(u)).astype(np.int64)

        for batch in batches:
            for a in range(0, len(batch), 512):
                h, c, _ = tokens(batch.column(0).slice(a, 512))
                held.append(sums([(h, c, np.ones(len(h), np.int64))]))
                if sum(len(x[0]) for x in held[1:]) > 1 << 20:
                    held = [sums(held)]
        if held:
            u, c, n = sums(held)
            for a in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (u.view(np.int64), c.astype(np.int32), n)], ["word", "class", "n"])

    return docs.filter(learned()).select("text").mapInArrow(run, "word long, class int, n long").groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Head words (sorted hashes) with counts; symbols: 0 end, then words, then classes."""

    head: np.ndarray
    count: np.ndarray
    symbol: np.ndarray  # of each head word, -1 if it goes by its class
    total: int  # N
    distinct: int  # V
    class_total: np.ndarray  # training tokens of words without a symbol, by class
    class_distinct: np.ndarray
    words: int

    @property
    def size(self) -> int:
        return 1 + self.words + CLASSES

    def look(self, h: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, count or -1 where the head doesn't have it) of tokens."""
        at = np.searchsorted(self.head, h)
        at[at == len(self.head)] = 0
        known = self.head[at] == h if len(self.head) else np.zeros(len(h), bool)
        symbol = np.where(known, self.symbol[at], -1) if len(self.head) else np.full(len(h), -1)
        symbol = np.where(h == END, 0, np.where(symbol < 0, 1 + self.words + classes, symbol))
        return symbol.astype(np.int64), np.where(known, self.count[at], -1) if len(self.head) else np.full(len(h), -1)

    def class_share(self) -> np.ndarray:
        """log10 of the smoothed size of each symbol's class; 0 for words with a symbol of their own."""
        out = np.zeros(self.size)
        out[1 + self.words :] = np.log10(self.class_total + SMOOTH * (self.class_distinct + 1))
        return out

    def unigram(self) -> np.ndarray:
        """Smoothed share of each symbol."""
        n = np.zeros(self.size)
        own = self.symbol >= 0
        n[self.symbol[own]] = self.count[own]
        n[1 + self.words :] = self.class_total
        return (n + SMOOTH * 4) / (n + SMOOTH * 4).sum()


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Words of the highest counts, at most `most` of them: all down to some count, found from a histogram of a few thousand rows."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor((F.log2("n") - 10) * 64))
    histogram = counts.groupBy(step.cast("int").alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect()
    least, total = 1 << 62, 0
    for row in sorted(histogram, reverse=True):
        total += row["words"]
        if total > most:
            break
        least = row["n"]
    return counts.filter(F.col("n") >= least)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded head and the totals of a table of counts."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent(counts, HEAD).toArrow()  # at most HEAD rows
    h, n, classes = (top.column(c).combine_chunks().to_numpy() for c in ("word", "n", "class"))
    order = np.lexsort((h, -n))
    h, n, classes = h[order].view(np.uint64), n[order], classes[order]
    symbol = np.full(len(h), -1)
    own = np.flatnonzero(h != END)[:WORDS]
    symbol[own] = 1 + np.arange(len(own))
    symbol[h == END] = 0
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, tokens_, words in counts.groupBy("class").agg(F.sum("n"), F.count("*")).collect():  # CLASSES rows
        class_total[c], class_distinct[c] = tokens_, words
    single = symbol >= 0  # what has a symbol of its own is not in its class
    np.subtract.at(class_total, classes[single], n[single])
    np.subtract.at(class_distinct, classes[single], 1)
    order = np.argsort(h)
    return Vocabulary(h[order], n[order], symbol[order], int(total), int(distinct), class_total, class_distinct, WORDS)


@dataclass
class Model:
    """Vectors of the two preceding symbols, of outputs, and output biases."""

    near: np.ndarray
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.near.ravel(), self.far.ravel(), self.out.ravel(), self.bias]).astype(np.float32)

    @classmethod
    def of(cls, flat: np.ndarray, v: int, d: int) -> Model:
        a, b, c, bias = np.split(flat.astype(np.float32), [v * d, 2 * v * d, 3 * v * d])
        return cls(a.reshape(v, d), b.reshape(v, d), c.reshape(v, d), bias)


def start(unigram: np.ndarray, d: int = SIZE) -> Model:
    """Small random vectors, biases at the unigram logarithm: the same wherever it is made."""
    rng, v = np.random.default_rng(11), len(unigram)
    make = lambda: (rng.standard_normal((v, d)) * 0.1).astype(np.float32)
    return Model(make(), make(), make(), np.log(unigram).astype(np.float32))


def summed(at: np.ndarray, rows: np.ndarray, v: int) -> np.ndarray:
    """Sums of rows by index."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    s = at[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out = np.zeros((v, rows.shape[1]), np.float32)
    out[s[first]] = np.add.reduceat(rows[order], first)
    return out


class Trainer:
    """Noise-contrastive estimation by mini-batches with Adagrad; each batch shares its noise."""

    def __init__(self, unigram: np.ndarray, rate: float = 0.3, seed: int = 5):
        self.m, self.p, self.rate = start(unigram), unigram, np.float32(rate)
        self.rng, self.cdf = np.random.default_rng(seed), np.cumsum(unigram)
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.seen = 0
        self.g = [np.full_like(x, 0.1) for x in (self.m.near, self.m.far, self.m.out, self.m.bias)]

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        m, n, v = self.m, len(target), len(self.p)
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), v - 1)
        context, wanted, own = m.near[one] + m.far[two], m.out[target], m.bias - self.log_noise
        # P(data) of a target wants 1, of noise 0; gradients of the log likelihood
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", context, wanted) + own[target], -30, 30)))
        others = m.out[noise]
        turned, less = np.ascontiguousarray(-others.T), -own[noise]
        d_context, d_noise, d_bias = up[:, None] * wanted, np.zeros_like(others), np.zeros(NOISE, np.float32)
        for a in range(0, n, ROWS):
            some = context[a : a + ROWS]
            p = some @ turned
            p += less
            np.clip(p, -30, 30, out=p)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            d_context[a : a + ROWS] -= p @ others
            d_noise -= p.T @ some
            d_bias -= p.sum(0)
        both = np.concatenate([target, noise])
        grads = [summed(one, d_context, v), summed(two, d_context, v), summed(both, np.concatenate([up[:, None] * context, d_noise]), v), np.bincount(both, weights=np.concatenate([up, d_bias]), minlength=v).astype(np.float32)]
        for x, g, total in zip((m.near, m.far, m.out, m.bias), grads, self.g, strict=True):
            g *= np.float32(32.0 / n)
            total += g * g
            g /= np.sqrt(total)
            g *= self.rate
            x += g
        self.seen += n


def contexts(symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before, and the one before that; the end symbol before a text's first."""
    one, two = np.zeros_like(symbols), np.zeros_like(symbols)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    first = of[:-1][np.diff(of) > 0]
    one[first] = 0
    two[first] = 0
    second = first + 1
    two[second[second < len(two)]] = 0
    return one, two


def encoded(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """Symbols of each text (16-bit numbers), what its head words count for, and its other words with their numbers.

    base: log10 of smoothed counts; classed: the same of those that go by a class, less the class's size.
    """
    held = docs.sparkSession.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, part, row = held.value, TaskContext.get().partitionId(), 0
        share = v.class_share()
        for batch in batches:
            for a in range(0, len(batch), 512):
                some = batch.slice(a, 512)
                h, c, of = tokens(some.column(1))
                symbols, n = v.look(h, c)
                later = n < 0  # counts of words outside the head come later
                base = np.log10(np.maximum(n, 0) + SMOOTH)
                base[later] = 0
                classed = np.where(symbols > v.words, base - share[symbols], 0)
                sums = [np.add.reduceat(x, of[:-1]) for x in ((~later).astype(np.int64), base, classed)]
                doc, words = np.repeat(np.arange(len(some)), np.diff(of))[later], h[later]
                order = np.lexsort((words, doc))
                doc, words = doc[order], words[order]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (words[1:] != words[:-1])])) if len(doc) else np.zeros(0, np.int64)
                edges = pa.array(np.searchsorted(doc[first], np.arange(len(of))), pa.int32())
                other = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (words[first].view(np.int64), np.diff(np.append(first, len(doc))).astype(np.int32))]
                raw = symbols.astype("<u2").tobytes()
                lists = pa.array([raw[2 * x : 2 * y] for x, y in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array((part << 32) + row + np.arange(len(some))), pa.array(np.diff(of)), *map(pa.array, sums), lists, *other], ["doc_id", "row", "n_tokens", "n_known", "base", "classed", "symbols", "words", "times"])
                row += len(some)

    return docs.mapInArrow(run, "doc_id long, row long, n_tokens long, n_known long, base double, classed double, symbols binary, words array<long>, times array<int>")


def unpacked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of several texts and their n+1 offsets."""
    return np.frombuffer(b"".join(texts), "<u2").astype(np.int64), np.cumsum([0, *(len(t) // 2 for t in texts)])


def steps(trainer: Trainer, texts: list[bytes]) -> None:
    """Training on some whole texts, their tokens in a random order."""
    symbols, of = unpacked(texts)
    one, two = contexts(symbols, of)
    order = trainer.rng.permutation(len(symbols))
    for b in range(0, len(order), BATCH):
        own = order[b : b + BATCH]
        trainer.step(one[own], two[own], symbols[own])


def train(texts: DataFrame, voc: Vocabulary) -> Model:
    """Every shard trains on all its training tokens; the average by tokens. texts: doc_id, symbols."""
    held = texts.sparkSession.sparkContext.broadcast(voc.unigram())
    shards = max(1, -(-voc.total // SHARD))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, size, trainer = None, [], 0, None

        def made() -> pa.RecordBatch:
            steps(trainer, waiting)
            data = np.array_split((trainer.m.flat().astype(np.float64) * trainer.seen).astype("<f4"), BLOCKS)
            return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([shard] * BLOCKS, pa.int64()), pa.array([trainer.seen] * BLOCKS, pa.int64()), pa.array([x.tobytes() for x in data], pa.binary())], ["block", "shard", "seen", "data"])

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != shard:
                    if trainer:
                        yield made()
                    shard, waiting, size, trainer = number, [], 0, Trainer(held.value)
                waiting.append(text)
                size += len(text) // 2
                if size >= 32 * BATCH:  # as many texts together wherever batches end
                    steps(trainer, waiting)
                    waiting, size = [], 0
        if trainer:
            yield made()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for block, seen, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                total = totals.setdefault(block, [0, 0.0])
                total[0] += seen
                total[1] = total[1] + np.frombuffer(data.as_buffer(), "<f4").astype(np.float64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), pa.array([(x / seen).astype("<f4").tobytes() for seen, x in totals.values()], pa.binary())], ["block", "data"])

    key = F.xxhash64("doc_id", "symbols")
    rows = texts.filter(learned()).select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"), "doc_id", "symbols")
    parts = rows.repartitionById(min(shards, TASKS), F.pmod("shard", F.lit(TASKS)).cast("int")).sortWithinPartitions("shard", "key", "doc_id", "symbols").select("shard", "symbols").mapInArrow(learn, "block int, shard long, seen long, data binary")
    summed_ = parts.repartition("block").sortWithinPartitions("block", "shard").select("block", "seen", "data").mapInArrow(add, "block int, data binary")
    blocks = sorted(summed_.collect())  # BLOCKS rows
    if not blocks:
        return start(voc.unigram())
    return Model.of(np.concatenate([np.frombuffer(r["data"], "<f4") for r in blocks]), voc.size, SIZE)


class Scorer:
    """Exactly normalised log10 probabilities of symbols from tables of the model."""

    def __init__(self, model: Model):
        self.one = model.near @ model.out.T + model.bias  # log score by preceding symbol and output
        self.two = model.far @ model.out.T
        a, b = self.one.max(1), self.two.max(1)
        self.z = np.log(np.exp(self.one - a[:, None]) @ np.exp(self.two - b[:, None]).T) + a[:, None] + b[None, :]

    def score(self, one: np.ndarray, two: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return ((self.one[one, symbol] + self.two[two, symbol] - self.z[one, two]) / np.log(10)).astype(np.float64)


def points(texts: DataFrame, model: Model) -> DataFrame:
    """Adds to each text the model's log10 probability of its symbols; what only encoding needs goes."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(held.value)
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                symbols, of = unpacked(some.column(6).to_pylist())
                found = np.add.reduceat(scorer.score(*contexts(symbols, of), symbols), of[:-1])
                yield pa.RecordBatch.from_arrays([*some.columns[:6], pa.array(found)], [*some.schema.names[:6], "points"])

    wanted = ["doc_id", "row", "n_tokens", "n_known", "base", "classed", "symbols"]
    return texts.select(wanted).mapInArrow(run, "doc_id long, row long, n_tokens long, n_known long, base double, classed double, points double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = cut(counted(docs), "counts")
    voc = vocabulary(counts)
    texts = cut(encoded(docs, voc), "symbols")
    scored = points(texts, train(texts.select("doc_id", "symbols"), voc))
    rest = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    looked = rest.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(n + SMOOTH)).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"))
    return scored.join(looked, "row", "left").select(
        "doc_id",
        (~learned()).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(voc.total + SMOOTH * (voc.distinct + 1))))).alias("base_score"),
        (F.col("points") + F.col("classed") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
