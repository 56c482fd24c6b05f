"""Suffix-array dedup (operator 1): a distributed merge sort of suffixes that knows common prefixes.

Bytes covered by a string of `length` bytes that also starts earlier (smaller doc_id, or earlier in
the document) are removed, judged on the input.

1. Module repeats leaves the suffixes at anchors that occur several times.
2. Each part sorts these suffixes and sends them as front-coded runs: the length of the prefix shared
   with the suffix before, and the rest. Runs go to buckets by anchor hash, so that equal windows meet.
3. Each bucket merges its runs with a loser tree. A node keeps the length of the prefix that the loser
   shares with the last winner; a larger one wins without a look at the strings, and of equal ones the
   comparison starts behind the known prefix. The merge yields a suffix array with its LCP array.
4. For each distance of a window's start before its anchor, intervals of the suffix array with LCP long
   enough, and intervals of the sorted bytes before the anchor, give the windows that are equal; all but
   the earliest are removed. Parts get ranges of places back, and cut their texts.

Nulls count as empty texts. Texts shorter than `length` are kept whole. Documents with equal doc_id are
ordered by text, those without doc_id come first. Matches never cross documents. An empty table gives
no row. Columns besides doc_id and text are carried as they are when texts are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from argentum.llm import repeats
from argentum.llm.repeats import PART, TEXT_HASH, RANGES, STRINGS, Chosen, Runs, Slice, byte_grams, choose, covered, dealt, gather, messages, ordered, pack, ranges, several, to_itself, unpack
from argentum.llm.words import buffers

LENGTH, GRAM = 100, 32


def read_bytes(table: pa.Table, length: int = LENGTH) -> list[Slice]:
    data, bounds = buffers(table.column("text"))
    return repeats.sliced(data, bounds, lambda some: byte_grams(some, GRAM), GRAM, length)


def read_runs(table: pa.Table, length: int = LENGTH) -> Runs:
    data, bounds = buffers(table.column("text"))
    return gather(data, bounds, read_bytes(table, length), length)


def padded(values: np.ndarray, length: int) -> np.ndarray:
    """For each place, moved by `length`, the values from there on; zeros at both ends."""
    zeros = np.zeros(length, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([zeros, values, zeros]), length)


def strings(view: np.ndarray, some: Chosen, own: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Strings of chosen runs as rows: anchor, right (from the anchor on), its length, left (before it, reversed), its length, least distance."""
    q, low, high = some.at[own], some.low[own], some.high[own]
    right_n, left_n = high + length - q, q - low
    right = view[q + length] * (np.arange(length) < right_n[:, None])
    left = view[q][:, ::-1][:, : length - GRAM] * (np.arange(length - GRAM) < left_n[:, None])
    return q, right, right_n, left, left_n, q - high


def common_prefixes(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of sorted rows: the length of the prefix that each shares with the one before."""
    differs = np.ones(rows.shape, bool)
    differs[1:] = rows[1:] != rows[:-1]
    lcp = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return np.minimum(lcp, np.minimum(size, np.concatenate([[0], size[:-1]])))


def sorted_rows(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.lexsort((size, np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()))


def encode_run(at: np.ndarray, right: np.ndarray, right_n: np.ndarray, left: np.ndarray, left_n: np.ndarray, least: np.ndarray) -> bytes:
    """A sorted run: shared prefix lengths and the rest of each suffix; and what belongs to it."""
    order = sorted_rows(right, right_n)
    right, right_n, left, left_n = right[order], right_n[order], left[order], left_n[order]
    lcp = common_prefixes(right, right_n)
    col = np.arange(right.shape[1])
    rest = right[(col >= lcp[:, None]) & (col < right_n[:, None])]
    return pack(at[order].astype("<u4"), lcp.astype("u1"), right_n.astype("u1"), rest, left_n.astype("u1"), left[np.arange(left.shape[1]) < left_n[:, None]], least[order].astype("u1"))


class Run:
    """Reads a front-coded run, one suffix after another."""

    def __init__(self, blob: bytes):
        self.places, lcp, size, rest, self.left_n, self.left, self.least = unpack(blob, "<u4", "u1", "u1", "u1", "u1", "u1", "u1")
        self.lcp, self.size, self.rest = lcp.tolist(), size, rest.tobytes()
        self.ends = np.cumsum(size.astype(np.int64) - lcp).tolist()
        self.at, self.text = -1, b""

    def step(self) -> int:
        """Goes to the next suffix; the prefix it shares with the one before, or -1 at the end."""
        self.at = i = self.at + 1
        if i >= len(self.lcp):
            return -1
        n = self.lcp[i]
        self.text = self.text[:n] + self.rest[self.ends[i - 1] if i else 0 : self.ends[i]]
        return n


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first `known` bytes are not looked at."""
    n = min(len(a), len(b))
    if known < n and a[known] != b[known]:
        return known
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loser tree over sorted runs: (run, place in it, LCP with the suffix before) in sorted order."""
    k = 1
    while k < len(runs):
        k *= 2
    lcps = [runs[i].step() if i < len(runs) else -1 for i in range(k)]  # of each run's head with the last winner
    texts = [runs[i].text if lcps[i] >= 0 else b"" for i in range(k)]
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's shared prefix with the winner where it was compared."""
        x, y = lcps[a], lcps[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = texts[a], texts[b]
        n = shared(s, t, x)
        if n == len(s) or n < len(t) and s[n] < t[n]:
            lcps[b] = n
            return a, b
        lcps[a] = n
        return b, a

    winners = [*range(k)]
    level = k
    while level > 1:  # the first tournament
        level //= 2
        nxt = []
        for i in range(level):
            w, losers[level + i] = play(winners[2 * i], winners[2 * i + 1])
            nxt.append(w)
        winners = nxt
    w, who, where, prefix = winners[0], [], [], []
    while lcps[w] >= 0:
        run = runs[w]
        who.append(w)
        where.append(run.at)
        prefix.append(lcps[w])
        x = run.step()
        lcps[w], s = x, run.text
        texts[w] = s
        node = (w + k) >> 1
        while node:
            b = losers[node]
            y = lcps[b]
            if y > x:
                losers[node], w, x, s = w, b, y, texts[b]
            elif y == x and x >= 0:
                t = texts[b]
                n = shared(s, t, x)
                if n == len(s) or n < len(t) and s[n] < t[n]:
                    lcps[b] = n
                else:
                    lcps[w] = n
                    losers[node], w, s = w, b, t
            node >>= 1
    return np.array(who, np.int64), np.array(where, np.int64), np.array(prefix, np.int64)


def repeated(part: np.ndarray, at: np.ndarray, lcp: np.ndarray, left: np.ndarray, left_n: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Over a suffix array: (suffix, distance) of the windows that start earlier too.

    Windows with one distance from their anchors are equal if both their parts from the anchor on lie in one interval of the suffix
    array, and their parts before it in one interval of the array of sorted left parts.
    """
    m = len(at)
    before = sorted_rows(left, left_n)
    left_lcp = common_prefixes(left[before], left_n[before])
    earliest = np.lexsort((at, part))
    found = []
    group = np.empty(m, np.uint64)
    for d in range(length - GRAM + 1):
        own = earliest[((least <= d) & (d <= left_n))[earliest]]
        if len(own) < 2:
            continue
        group[before] = np.cumsum(left_lcp < d).astype(np.uint64)
        key = np.cumsum(lcp < length - d).astype(np.uint64)[own] << np.uint64(32) | group[own]
        by = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[by[1:]] == key[by[:-1]]) + 1
        found.append((own[by[again]], np.full(len(again), d)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def compare(table: pa.Table, length: int = LENGTH) -> pa.Table:
    """A bucket: merges its parts' runs and answers with ranges of repeated windows; answers that only pass go on."""
    bucket = table.column("bucket")[0].as_py()
    kind = table.column("kind").to_numpy()
    passing = table.filter(pa.array(kind == RANGES)).select(["part", "bucket", "kind", "data"])
    table = table.filter(pa.array(kind == STRINGS)).sort_by("part")
    if not len(table):
        return passing
    parts = table.column("part").to_pylist()
    held = [Run(b) for b in table.column("data").to_pylist()]
    who, where, lcp = merge(held)
    sizes = [len(r.places) for r in held]
    first = np.cumsum([0, *sizes])
    order = first[who] + where
    cat = lambda name: np.concatenate([getattr(r, name) for r in held]).astype(np.int64)
    left_n = cat("left_n")
    left = np.zeros((len(order), length - GRAM), np.uint8)
    left[np.arange(length - GRAM) < left_n[:, None]] = np.concatenate([r.left for r in held])
    part, at = np.repeat(np.array(parts), sizes)[order], cat("places")[order]
    suffix, distance = repeated(part, at, lcp, left[order], left_n[order], cat("least")[order], length)
    of, start = part[suffix], at[suffix] - distance
    by = np.argsort(of, kind="stable")
    rows = [(int(of[own[0]]), bucket, RANGES, ranges(start[own], start[own])) for own in np.split(by, np.flatnonzero(np.diff(of[by])) + 1) if len(own)]
    return pa.concat_tables([passing, messages(rows)])


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """docs with repeated bytes cut from text (characters cut in two are dropped), and n_removed, n_spans.

    digest: doc_id, sizes and a SHA-256 of the bytes that are left, instead.
    """
    rows = docs.select("doc_id", "text") if digest else docs
    parts, buckets = dealt(rows.withColumn("doc_id", rows["doc_id"].cast("long")))  # a bucket holds about what one part sends
    narrow = parts.select("doc_id", "text", TEXT_HASH, PART)
    heard = several(narrow, lambda table: read_runs(table, length))

    def send(table: pa.Table, received: pa.Table) -> pa.Table:
        if not len(table):
            return messages([])
        part, r = table.column(PART)[0].as_py(), read_runs(ordered(table), length)
        some, done = choose(r, received, buckets)
        found, view = to_itself(part, buckets, done), padded(r.values, length)
        for bucket, own in some.by_bucket():
            found.append((part, bucket, STRINGS, encode_run(*strings(view, some, own, length))))
        return messages(found)

    answers = narrow.groupBy(PART).cogroup(heard.groupBy("part")).applyInArrow(send, repeats.MESSAGE).groupBy("bucket").applyInArrow(lambda t: compare(t, length), repeats.MESSAGE)
    kept_columns = [c for c in rows.columns if c not in ("n_removed", "n_spans")]
    if digest:
        schema = T._parse_datatype_string(DIGEST)
    else:
        schema = T.StructType([*(rows.withColumn("doc_id", rows["doc_id"].cast("long")).schema[c] for c in kept_columns), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])

    def finish(table: pa.Table, received: pa.Table) -> pa.Table:
        columns = [f.name for f in schema.fields]
        table = ordered(table)
        data, bounds = buffers(table.column("text"))
        mask = covered(received, length, len(data))
        sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        begin = mask.copy()
        begin[1:] &= ~mask[:-1]
        edges = bounds[:-1][np.diff(bounds) > 0]
        begin[edges] = mask[edges]
        sums[1:] = np.cumsum(begin, dtype=np.int32)
        spans = sums[bounds[1:]] - sums[bounds[:-1]]
        left = [data[a:b][~mask[a:b]].tobytes() if x else data[a:b].tobytes() for a, b, x in zip(bounds[:-1].tolist(), bounds[1:].tolist(), total.tolist(), strict=True)]
        made = {"n_removed": pa.array(total, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        if digest:
            made |= {"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(bounds)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())}
        else:
            text = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string())
            made |= {c: table.column(c) for c in kept_columns if c != "text"} | {"text": pc.if_else(pc.is_null(table.column("text").combine_chunks()), pa.scalar(None, pa.string()), text)}
        return pa.Table.from_arrays([made[c] for c in columns], columns)

    return parts.groupBy(PART).cogroup(answers.groupBy("part")).applyInArrow(finish, schema)
