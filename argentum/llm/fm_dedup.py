"""Substring dedup with compressed FM-indexes (operator 4).

Words covered by a window of `window` successive words that also starts in a document with a smaller
doc_id are removed, judged on the input.

1. Module repeats finds the runs of windows whose anchors occur several times.
2. Such runs go to shards by anchor hash, so that equal windows meet. A shard is an FM-index over its
   different runs: the BWT of their words in a wavelet matrix with packed bits, and for each suffix the least
   document that has its run, with minima of blocks for the least of any interval.
3. The runs are streamed through backward search, all side by side: word by word each window's interval
   of the suffix array becomes narrower; the matching statistic is the number of words until it is empty.
   Windows whose statistic reaches the threshold and whose interval has a smaller document are reported.

Nulls count as texts without words. Rows with equal doc_id are one document to each other: neither is
smaller. Rows without doc_id come first. Matches never cross documents. An empty table gives no row;
columns besides doc_id and text are carried as they are when texts are returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from argentum.llm import repeats
from argentum.llm.repeats import PART, TEXT_HASH, RANGES, STRINGS, Slice, choose, covered, cuts, dealt, gather, messages, ordered, pack, ranges, several, to_itself, unpack
from argentum.llm.words import Words, grams, mix, powers

WINDOW, GRAM = 13, 7


class WaveletMatrix:
    """Rank of any symbol in a sequence, by one packed bit vector for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        n = len(seq)
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place, less the same at place 0 (see starts)."""
        i = at
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            words, before = self.levels[level]
            w = i >> 6
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(symbol >> b & 1, self.zeros[level] + ones, i - ones)
        return i


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least: ranks of pairs, doubling."""
    rank, n, length = seq.astype(np.uint64), len(seq), 1
    order = np.argsort(rank, kind="stable")
    while length < depth:
        key = rank << np.uint64(32)
        key[: n - length] |= rank[length:] + np.uint64(1)
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.uint64)
        s = key[order]
        new[1:] = np.cumsum(s[1:] != s[:-1])
        rank[order] = new
        length *= 2
        if int(new[-1]) == n - 1:
            break
    return order


class FMIndex:
    """Over texts of symbols 1.. put one after another with 0 between; patterns of at most `depth` symbols.

    marks: a number for each place; of an interval of suffixes the least mark can be had. The suffix array itself isn't kept.
    """

    def __init__(self, seq: np.ndarray, depth: int, marks: np.ndarray):
        bits = max(1, int(seq.max()).bit_length())
        order = suffix_order(seq, depth)
        self.size = len(seq)
        self.bwt = WaveletMatrix(seq[order - 1], bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=(1 << bits) + 1))])
        self.base = self.bwt.rank(np.arange(1 << bits), np.zeros(1 << bits, np.int64))
        self.least = Least(marks[order])

    def backward(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with the symbol and then with what the intervals stood for."""
        start = self.first[symbol] - self.base[symbol]
        return start + self.bwt.rank(symbol, low), start + self.bwt.rank(symbol, high)


class Least:
    """The least value of any interval that isn't empty: values at its ends, and a table over the minima of whole blocks between."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        self.values = values
        whole = len(values) // self.BLOCK
        self.tables = [values[: whole * self.BLOCK].reshape(-1, self.BLOCK).min(1)] if whole else []
        n = 1
        while 2 * n <= whole:
            t = self.tables[-1]
            self.tables.append(np.minimum(t[:-n], t[n:]))
            n *= 2

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = self.values[low]
        a, b = -(-low // self.BLOCK), high // self.BLOCK  # whole blocks
        for j in range(self.BLOCK):
            for at in (low + j, high - 1 - j):
                inside = (low <= at) & (at < high)
                out[inside] = np.minimum(out[inside], self.values[at[inside]])
        some = np.flatnonzero(b > a)
        a, b = a[some], b[some]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            t = self.tables[k]
            out[some[own]] = np.minimum(out[some[own]], np.minimum(t[a[own]], t[b[own] - (1 << k)]))
        return out


def matching(index: FMIndex, seq: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of the streamed sequence: (statistic, low, high); statistic: words from the window's end that match."""
    n = len(starts)
    low, high, statistic = np.zeros(n, np.int64), np.full(n, index.size, np.int64), np.zeros(n, np.int64)
    live = np.arange(n)
    for j in range(window - 1, -1, -1):
        if not len(live):
            break
        a, b = index.backward(seq[starts[live] + j], low[live], high[live])
        ok = b > a
        live, a, b = live[ok], a[ok], b[ok]
        low[live], high[live] = a, b
        statistic[live] += 1
    return statistic, low, high


def read_words(table: pa.Table, window: int = WINDOW) -> list[Slice]:
    w = Words(table.column("text"))
    return repeats.sliced(w.hashes(), w.of, lambda some: grams(some, GRAM), GRAM, window)


def document_ranks(table: pa.Table) -> np.ndarray:
    """Number of distinct smaller doc_ids of each row of an ordered part; null is the smallest."""
    ids = table.column("doc_id").combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    new = np.zeros(len(values), np.int64)
    new[1:] = (values[1:] != values[:-1]) | (known[1:] != known[:-1])
    return np.cumsum(new)


def different(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings one after another: which ones are the first of their kind, and the kind of each."""
    rows = np.zeros((len(size), int(size.max())), np.uint32)
    rows[np.arange(rows.shape[1]) < size[:, None]] = words
    key = mix(sum(rows[:, j] * power for j, power in enumerate(powers(rows.shape[1]))) + size.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(size), bool)
    for a in range(1, len(size), 1 << 14):
        own, last = order[a : a + (1 << 14)], order[a - 1 : a - 1 + (1 << 14)][: len(order) - a]
        new[a : a + (1 << 14)] = (rows[own] != rows[last]).any(1) | (size[own] != size[last])
    kind = np.empty(len(size), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def strings(size: np.ndarray, data: np.ndarray) -> pa.Array:
    """Texts one after another as a column."""
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def search(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """A shard: indexes its different runs, streams them through the index and answers with ranges of repeated windows."""
    shard = table.column("bucket")[0].as_py()
    kinds = table.column("kind").to_numpy()
    passing = table.filter(pa.array(kinds == RANGES)).select(["part", "bucket", "kind", "data"])
    table = table.filter(pa.array(kinds == STRINGS)).sort_by("part")
    if not len(table):
        return passing
    got = [unpack(b, "<u4", "<u2", "?", "<i8", "<u4", "u1") for b in table.column("data").to_pylist()]
    place, size, known, ids = (np.concatenate([g[k] for g in got]) for k in range(4))
    place, size = place.astype(np.int64), size.astype(np.int64)
    part = np.repeat(table.column("part").to_numpy(), [len(g[0]) for g in got])
    words = Words(strings(np.concatenate([g[4] for g in got]), np.concatenate([g[5] for g in got]))).numbers()[1].astype(np.int32)
    del got
    # Documents by number: those without an id first.
    by = np.lexsort((ids, known))
    document = np.empty(len(ids), np.uint32)
    document[by] = np.cumsum(np.concatenate([[0], (ids[by[1:]] != ids[by[:-1]]) | (known[by[1:]] != known[by[:-1]])]))
    first, kind = different(words.astype(np.uint32) + np.uint32(1), size)
    least = np.full(len(first), np.iinfo(np.uint32).max, np.uint32)
    np.minimum.at(least, kind, document)
    ends = np.cumsum(size)
    own = size[first]
    begin = np.cumsum(own + 1) - (own + 1)
    seq = np.zeros(int((own + 1).sum()), np.int32)
    to = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    seq[np.repeat(begin, own) + to] = words[np.repeat((ends - size)[first], own) + to] + 1
    index = FMIndex(seq, window, np.repeat(least, own + 1))
    windows = own - window + 1
    which = np.repeat(np.arange(len(own)), windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    smallest = np.full((len(own), int(windows.max())), np.iinfo(np.uint32).max, np.uint32)
    step = 1 << 17
    for a in range(0, len(which), step):
        w, off = which[a : a + step], offset[a : a + step]
        statistic, low, high = matching(index, seq, begin[w] + off, window)
        hit = statistic >= window
        smallest[w[hit], off[hit]] = index.least.of(low[hit], high[hit])
    row, off = np.nonzero(smallest[kind] < document[:, None])
    of, start = part[row], place[row] + off
    by = np.argsort(of, kind="stable")
    rows = [(int(of[x[0]]), shard, RANGES, ranges(start[x], start[x])) for x in np.split(by, np.flatnonzero(np.diff(of[by])) + 1) if len(x)]
    return pa.concat_tables([passing, messages(rows)])


def joined(w: Words, keep: np.ndarray, first: int, last: int) -> list[bytes]:
    """Texts of documents first..last-1: their kept words, joined by one blank."""
    words = slice(w.of[first], w.of[last])
    own = keep[words]
    start, size = w.start[words][own], (w.end[words] - w.start[words])[own] + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    out = np.append(w.data, np.uint8(32))[at] if len(at) and at[-1] >= len(w.data) else w.data[at]
    out[ends[1:] - 1] = 32
    raw, of = out.tobytes(), ends[np.concatenate([[0], np.cumsum(own)])[w.of[first : last + 1] - w.of[first]]].tolist()
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(of[:-1], of[1:], strict=True)]


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def fm_dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """docs with repeated words cut from text (left words joined by one blank), and n_words, n_removed.

    digest: doc_id, sizes and a SHA-256 of the text that is left, instead. window: GRAM words at least.
    """
    rows = docs.select("doc_id", "text") if digest else docs
    rows = rows.withColumn("doc_id", rows["doc_id"].cast("long"))
    parts, n = dealt(rows)
    buckets = 2 * n  # a shard holds about half of what one part sends: its index takes several times as much while it is made

    def runs(table: pa.Table, w: Words | None = None) -> repeats.Runs:
        w = w or Words(table.column("text"))
        h = w.hashes()
        return gather(h, w.of, repeats.sliced(h, w.of, lambda some: grams(some, GRAM), GRAM, window), window)

    narrow = parts.select("doc_id", "text", TEXT_HASH, PART)
    heard = several(narrow, runs)

    def send(table: pa.Table, received: pa.Table) -> pa.Table:
        if not len(table):
            return messages([])
        part, table = table.column(PART)[0].as_py(), ordered(table)
        w = Words(table.column("text"))
        r = runs(table, w)
        some, done = choose(r, received, buckets, document_ranks(table))
        ids = table.column("doc_id").combine_chunks()
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        rows = to_itself(part, buckets, done)
        for bucket, own in some.by_bucket():
            low, size = some.low[own], some.high[own] + window - some.low[own]
            start = w.start[low]
            long = w.end[low + size - 1] - start
            text = w.data[np.repeat(start - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))]
            doc = some.doc[own]
            rows.append((part, bucket, STRINGS, pack(low.astype("<u4"), size.astype("<u2"), known[doc], ids[doc].astype("<i8"), long.astype("<u4"), text)))
        return messages(rows)

    answers = narrow.groupBy(PART).cogroup(heard.groupBy("part")).applyInArrow(send, repeats.MESSAGE).groupBy("bucket").applyInArrow(lambda t: search(t, window), repeats.MESSAGE)
    carried = [c for c in rows.columns if c not in ("n_words", "n_removed")]
    if digest:
        schema = T._parse_datatype_string(DIGEST)
    else:
        schema = T.StructType([*(rows.schema[c] for c in carried), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def finish(table: pa.Table, received: pa.Table) -> pa.Table:
        table = ordered(table)
        w = Words(table.column("text"))
        mask = covered(received, window, len(w))
        sums = np.concatenate([[0], np.cumsum(mask)])
        left = [x for a, b in cuts(np.diff(w.of), 1 << 17) for x in joined(w, ~mask, a, b)]
        made = {"n_words": pa.array(np.diff(w.of)), "n_removed": pa.array(sums[w.of[1:]] - sums[w.of[:-1]])}
        if digest:
            made |= {"doc_id": table.column("doc_id"), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())}
        else:
            text = pa.array([x.decode() for x in left], pa.string())
            made |= {c: table.column(c) for c in carried if c != "text"} | {"text": pc.if_else(pc.is_null(table.column("text").combine_chunks()), pa.scalar(None, pa.string()), text)}
        names = [f.name for f in schema.fields]
        return pa.Table.from_arrays([made[c] for c in names], names)

    return parts.groupBy(PART).cogroup(answers.groupBy("part")).applyInArrow(finish, schema)
