"""Finding what may repeat, before strings are exchanged: shared by the two substring operators.

Values are bytes or word hashes; a window is so many successive values of one document. The least
k-gram hash in a window is its anchor, which depends on the window alone: equal windows have their
anchor at the same place. So a document becomes runs of windows with one anchor each, and only runs
whose anchor occurs elsewhere can hold a repeated window.

Documents are dealt to parts by ranges of doc_id, so that (part, place in the part) is the order of
documents. Equal runs of a part are one (bytes are compared, not hashes), so that copies don't
multiply what is sent. Each part gives a row for each of its anchors; a window over the anchor's hash
says how many runs have it, and parts hear of those that several have. The strings of these runs then
go to buckets by the anchor's hash, where the operator's own structure decides which windows repeat.
An anchor with more than HOT runs, as at the edge of a passage that very many documents have, is sent
window by window, to buckets by the hash of the whole window: equal windows meet, and the rest spreads.
Answers are ranges of window starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.llm.session import cut
from argentum.llm.words import _BASE, _MASK, inside, mix, powers
from argentum.operators.ordered import bounds, numbers, position

PART, TEXT_HASH = "_argentum_part", "_argentum_hash"
#: Runs of an anchor beyond which its windows are sent one by one.
HOT = 1 << 14
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 24) - 1)
#: Values handled at once, which bounds a worker's arrays.
STEP = 1 << 19


@dataclass
class Slice:
    """Documents of a part handled together, and the runs of windows in them."""

    first: int  # number of the first document in the part
    values: np.ndarray
    bounds: np.ndarray
    at: np.ndarray  # anchor
    low: np.ndarray  # first window with that anchor
    high: np.ndarray  # last window
    hash: np.ndarray
    span: np.ndarray
    doc: np.ndarray  # document in the slice
    offset: int = 0  # values of the first document before the slice


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k successive bytes; k is a power of two: windows double."""
    h, power, n = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    while n < k:
        if len(h) <= n:
            return np.zeros(0, np.uint64)
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power & _MASK, 2 * n
    return mix(h)


_inverse = np.array([1], np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _inverse
    while len(_inverse) < n:
        top = np.uint64(int(_inverse[-1]) * _INVERSE & _MASK)
        _inverse = np.concatenate([_inverse, _inverse * top])
    return _inverse[:n]


def runs(values: np.ndarray, bounds: np.ndarray, grams: np.ndarray, k: int, window: int, first: int) -> Slice | None:
    """The runs of windows with one anchor, in order. Fewer values than a place can tell (2**24), which sliced() sees to."""
    if len(grams) > int(_PLACE) + 1:
        raise ValueError(f"{len(grams)} places in a slice")
    ok = inside(bounds, window, len(values))
    if not ok.any():
        return None
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, n = window - k + 1, 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < width:
        least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
    at = (least & _PLACE).astype(np.int64)[: len(ok)]
    change = np.empty(len(ok), bool)
    change[0] = True
    change[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
    low = np.flatnonzero(change)
    high = np.append(low[1:], len(ok)) - 1
    keep = ok[low]
    low, high = low[keep], high[keep]
    doc = np.searchsorted(bounds, low, "right") - 1
    # A run never goes on into another document, as windows in between are not inside one.
    at = at[low]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)), dtype=np.uint64)])
    span = mix((total[high + window] - total[low]) * _inverses(len(values))[low] ^ (at - low).astype(np.uint64) << np.uint64(48) ^ (high - low).astype(np.uint64) << np.uint64(56))
    return Slice(first, values, bounds, at, low, high, grams[at], span, doc)


def cuts(sizes: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `step` values together."""
    a, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and total + n > step:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def sliced(values: np.ndarray, of: np.ndarray, grams: Callable[[np.ndarray], np.ndarray], k: int, window: int) -> list[Slice]:
    """Slices of a part's values with their runs; `of`: n+1 offsets of documents.

    A document of more than STEP values is cut into pieces that share window-1 values: each window is in one of them.
    """
    out = []
    for a, b in cuts(np.diff(of), STEP):
        size = int(of[b] - of[a])
        long = b == a + 1 and size > STEP
        for at in range(0, max(1, size - window + 1), STEP) if long else (0,):
            some = values[of[a] + at : min(of[a] + at + STEP + window - 1, of[b]) if long else of[b]]
            s = runs(some, np.array([0, len(some)]) if long else of[a : b + 1] - of[a], grams(some), k, window, a)
            if s is not None:
                s.offset = at
                out.append(s)
    return out


@dataclass
class Runs:
    """All runs of a part, with places in the part's values."""

    values: np.ndarray
    window: int
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    hash: np.ndarray
    span: np.ndarray
    doc: np.ndarray  # document in the part

    def view(self, width: int) -> np.ndarray:
        """For each place the values from there on, zeros behind the last."""
        padded = np.concatenate([self.values, np.zeros(width, self.values.dtype)])
        return np.lib.stride_tricks.sliding_window_view(padded, width)


def gather(values: np.ndarray, of: np.ndarray, slices: list[Slice], window: int) -> Runs:
    """The runs of a part's slices together; `of`: n+1 offsets of documents."""
    cat = lambda xs, t: np.concatenate(xs).astype(t, copy=False) if xs else np.zeros(0, t)
    base = [int(of[s.first]) + s.offset for s in slices]
    places = [cat([getattr(s, name) + b for s, b in zip(slices, base, strict=True)], np.int64) for name in ("at", "low", "high")]
    return Runs(values, window, *places, cat([s.hash for s in slices], np.uint64), cat([s.span for s in slices], np.uint64), cat([s.doc + s.first for s in slices], np.int64))


def speakers(view: np.ndarray, keys: tuple[np.ndarray, ...], low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each string the first one equal to it: those with equal keys are compared value by value. In the order of places."""
    order = np.lexsort(keys)  # stable: the first of equal ones comes first
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    out = np.empty(len(order), np.int64)
    if len(order):
        out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    some = np.flatnonzero(out != np.arange(len(out)))
    column = np.arange(view.shape[1])
    for a in range(0, len(some), 1 << 14):
        own = some[a : a + (1 << 14)]
        other = out[own]
        differ = ((view[low[own]] != view[low[other]]) & (column < size[own][:, None])).any(1) | (size[own] != size[other])
        out[own[differ]] = own[differ]
    return out


def window_hashes(view: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Hashes of whole windows; view: rows of a window's width."""
    out, power = np.empty(len(low), np.uint64), powers(view.shape[1])
    for a in range(0, len(low), 1 << 14):
        out[a : a + (1 << 14)] = ((view[low[a : a + (1 << 14)]].astype(np.uint64) + np.uint64(1)) * power).sum(1, dtype=np.uint64)
    return mix(out)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, compressed; the reader knows their types."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(r) for r in raw], "<u4").tobytes() + zstandard.compress(b"".join(raw), 1)


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, "<u4", len(types)).tolist()
    raw, at, out = zstandard.decompress(blob[4 * len(types) :]), 0, []
    for n, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


MESSAGE = "part int, bucket int, kind int, data binary"
_ARROW = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
#: Kinds of messages: strings for a bucket, and ranges of window starts for a part.
STRINGS, RANGES = 0, 1


def messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 4, _ARROW.types, strict=True)], schema=_ARROW)


def ranges(first: np.ndarray, last: np.ndarray) -> bytes:
    """Ranges of window starts of a part, those that touch as one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1] + 1
    ends = np.append(np.flatnonzero(new)[1:], len(first)) - 1
    return pack(first[new].astype("<u4"), (last[ends] - first[new]).astype("<u4"))


def covered(received: pa.Table, window: int, total: int) -> np.ndarray:
    """A mask of the part's values that lie in a window whose start was answered."""
    change = np.zeros(total + 1, np.int32)
    for data in received.column("data").to_pylist():
        first, more = (x.astype(np.int64) for x in unpack(data, "<u4", "<u4"))
        np.add.at(change, first, 1)
        np.add.at(change, first + more + window, -1)
    return np.cumsum(change[:-1]) > 0


def dealt(docs: DataFrame, each: int = 10 << 20) -> tuple[DataFrame, int]:
    """docs with a part number (PART) and a hash of the text (TEXT_HASH), dealt by the part, and the number of parts.

    Parts grow with (doc_id, hash), doc_id null first, and have about `each` bytes by the sizes of all texts. A doc_id with more
    than that (or the rows without one) has as many parts as it needs, by equal shares of the hash's values; all such ids are found by one job.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = cut(docs.select("doc_id", F.octet_length(raw).cast("long").alias("size")), "sizes")
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(1, -(-total // each))
    docs = docs.withColumn(TEXT_HASH, F.xxhash64(raw))
    if n == 1:
        return docs.withColumn(PART, F.lit(0)).repartition(1, PART), 1
    heavy = narrow.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).filter((F.col("size") > each) & (F.col("rows") > 1)).select("doc_id", "size").collect()  # fewer than parts
    shares = {r["doc_id"]: -(-r["size"] // each) for r in heavy}
    alone = sorted(k for k in shares if k is not None)
    found = sorted({*bounds(narrow.filter("doc_id is not null"), "doc_id", n), *(k + i for k in alone for i in (0, 1) if k + i < 1 << 63)})
    # Ranges of doc_id: first those without one, then those between the cuts; a range is one part, or the shares of its doc_id.
    width = np.ones(len(found) + 2, np.int64)
    width[0] = shares.get(None, 1)
    width[np.searchsorted(found, alone, "right") + 1] = [shares[k] for k in alone]
    first = np.cumsum(width) - width
    spot = F.when(F.col("doc_id").isNull(), 0).otherwise(position(F.col("doc_id"), found) + 1)
    share = F.shiftright(F.shiftrightunsigned(F.col(TEXT_HASH).bitwiseXOR(F.lit(-(1 << 63))), 33) * F.element_at(numbers(width.tolist()), spot + 1), 31)
    return docs.withColumn(PART, (F.element_at(numbers(first.tolist()), spot + 1) + share).cast("int")).repartition(int(width.sum()), PART), int(width.sum())


def ordered(table: pa.Table) -> pa.Table:
    """A part's documents by doc_id, null first; of equal ids by the text's hash and the text, so that a repeated run sees the same order."""
    import pyarrow.compute as pc

    at = pc.sort_indices(table.select(["doc_id", TEXT_HASH, "text"]), sort_keys=[("doc_id", "ascending"), (TEXT_HASH, "ascending"), ("text", "ascending")], null_placement="at_start")
    return table.take(at)


def several(parts: DataFrame, read: Callable[[pa.Table], Runs]) -> DataFrame:
    """(part, anchor, total) of anchors that several different runs have, for each part that has it."""

    def ask(table: pa.Table) -> pa.Table:
        part, r = table.column(PART)[0].as_py(), read(ordered(table))
        order = np.lexsort((r.span, r.hash))
        h, span = r.hash[order], r.span[order]
        anchor = np.ones(len(h), bool)
        anchor[1:] = h[1:] != h[:-1]
        new = anchor.copy()
        new[1:] |= span[1:] != span[:-1]
        first = np.flatnonzero(anchor)
        n = np.add.reduceat(new.astype(np.int32), first) if len(first) else np.zeros(0, np.int32)
        return pa.table({"part": pa.array(np.full(len(first), part, np.int32)), "anchor": pa.array(h[first].view(np.int64)), "n": pa.array(n.astype(np.int32))})

    asked = parts.groupBy(PART).applyInArrow(ask, "part int, anchor long, n int")
    return asked.withColumn("total", F.sum("n").over(Window.partitionBy("anchor"))).filter("total > 1").select("part", "anchor", "total")


@dataclass
class Chosen:
    """Runs (or single windows) of a part whose strings go to buckets."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray
    bucket: np.ndarray

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(self.bucket, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(self.bucket[order])) + 1) if len(order) else []:
            yield int(self.bucket[own[0]]), own


def choose(r: Runs, heard: pa.Table, buckets: int, rank: np.ndarray | None = None) -> tuple[Chosen, list[tuple[np.ndarray, np.ndarray]]]:
    """What a part sends, and ranges of its windows that an equal run or window of the part settles.

    rank: of each document; where given, only strings of documents with a smaller rank settle others.
    """
    view = r.view(int((r.high - r.low).max(initial=0)) + r.window)
    speaker = speakers(view, (r.span, r.hash), r.low, r.high - r.low + r.window)
    settled = speaker != np.arange(len(speaker))
    if rank is not None:
        settled &= rank[r.doc[speaker]] < rank[r.doc]
    done = [(r.low[settled], r.high[settled])]
    left = np.flatnonzero(~settled)
    anchors = heard.column("anchor").combine_chunks().to_numpy().view(np.uint64)
    totals = heard.column("total").combine_chunks().to_numpy()
    order = np.argsort(anchors)
    anchors, totals = anchors[order], totals[order]
    where = np.minimum(np.searchsorted(anchors, r.hash[left]), max(0, len(anchors) - 1))
    known = anchors[where] == r.hash[left] if len(anchors) else np.zeros(len(left), bool)
    total = np.where(known, totals[where], 1) if len(anchors) else np.ones(len(left), np.int64)
    _, inverse, own = np.unique(r.hash[left], return_inverse=True, return_counts=True)
    wanted = known | (own[inverse] > 1)
    calm, hot = left[wanted & (total <= HOT)], left[wanted & (total > HOT)]
    place = lambda h: ((mix(h ^ np.uint64(0xA5)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    size = r.high[hot] - r.low[hot] + 1
    start = np.repeat(r.low[hot], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    by = np.argsort(start, kind="stable")
    start, of = start[by], np.repeat(hot, size)[by]
    if len(start):
        whole = r.view(r.window)
        h = window_hashes(whole, start)
        first = speakers(whole, (h,), start, np.full(len(start), r.window))
        same = first != np.arange(len(first))
        if rank is not None:
            same &= rank[r.doc[of[first]]] < rank[r.doc[of]]
        done.append((start[same], start[same]))
        start, of, h = start[~same], of[~same], h[~same]
        spread = place(h)
    else:
        spread = np.zeros(0, np.int64)
    cat = lambda a, b: np.concatenate([a, b])
    return Chosen(cat(r.at[calm], r.at[of]), cat(r.low[calm], start), cat(r.high[calm], start), cat(r.doc[calm], r.doc[of]), cat(place(r.hash[calm]), spread)), done


def to_itself(part: int, buckets: int, done: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """The message of a part to itself; it takes the way through a bucket."""
    first, last = (np.concatenate(x) for x in zip(*done, strict=True))
    return [(part, part % buckets, RANGES, ranges(first, last))] if len(first) else []
