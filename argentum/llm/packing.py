"""Best-fit packing (operator 6): best fit decreasing, with a segment tree over remaining capacities.

Lengths are whole numbers up to the capacity, so the order of best fit decreasing is known from
how many pieces there are of each length, at most `capacity` numbers whatever the input. The tree
plans over them on the driver: open bins with equal contents form one group, and a search for the
tightest open bin takes logarithmic time. A piece then finds its place by its rank among the
pieces of its length; ranks come from counts per part, so that a length that many pieces share
is not gathered anywhere.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.llm.byte_bpe import gathered
from argentum.llm.session import cut
from argentum.llm.word_tokens import forget, pieces


class CapacityTree:
    """Which remaining capacities 0..n have open bins; the tightest of at least x in O(log n)."""

    def __init__(self, n: int):
        self.size = 1 << max(1, n).bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, x: int) -> int | None:
        """The least open capacity of at least x."""
        i = x + self.size
        if self.open[i]:
            return x
        while i > 1:
            if not i & 1 and self.open[i + 1]:  # the right neighbour under the same parent
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


#: Runs of pieces of one length: ranks from `rank` on go to `bins` bins from `bin` on, `each` to a bin, from `offset` on.
Placement = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Best fit decreasing for so many pieces of each length: (length, rank, bin, bins, each, offset), and the number of bins."""
    tree, groups, out, bins = CapacityTree(capacity), defaultdict(list), [], 0
    for length in sorted((n for n in counts if n > 0 and counts[n] > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # open new bins, as many as needed
                room, each = capacity, capacity // length
                first, many = bins, -(-left // each)
                bins += many
            else:
                first, many = groups[room].pop()
                if not groups[room]:
                    tree.set(room, False)
                each = room // length
            used = min(many, left // each)
            if used:
                out.append((length, rank, first, used, each, capacity - room))
                rank, left = rank + used * each, left - used * each
                _put(tree, groups, room - each * length, first, used)
            if left and used < many:  # the last bin of this length gets fewer
                out.append((length, rank, first + used, 1, left, capacity - room))
                _put(tree, groups, room - left * length, first + used, 1)
                rank, left, used = rank + left, 0, used + 1
            if used < many:
                _put(tree, groups, room, first + used, many - used)
    return out, bins


def _put(tree: CapacityTree, groups: dict, room: int, first: int, many: int) -> None:
    if room:
        groups[room].append((first, many))
        tree.set(room, True)


#: Characters that are encoded at once, which bounds a worker's arrays.
BATCH = 3 << 20


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32, and part, row, which are unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = pieces(vocabulary), np.array([end_id], "<u4").tobytes()
        part, row = TaskContext.get().partitionId(), 0
        for keys, texts in gathered(batches, BATCH):
            rows = []
            for key, ids in zip(keys, encoder.encode(texts), strict=True):
                ids += end
                for i in range(0, len(ids), 4 * capacity):
                    piece = ids[i : i + 4 * capacity]
                    rows.append((key, i // (4 * capacity), i // 4, len(piece) // 4, zlib.crc32(piece), part, row + len(rows)))
            row += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "row"])
        forget(vocabulary)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, row long")


def place(rows: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to `capacity` and the columns part, row (unique, in the order that decides ties).

    The order within a part is that of `row`; parts follow by number. Rows must be
    stable, as from a written table.
    """
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placements, _ = plan({r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)  # at most `capacity` rows
    table: dict[int, np.ndarray] = {}
    for p in placements:
        table.setdefault(p[0], []).append(p[1:])
    table = {k: np.array(v, np.int64) for k, v in table.items()}

    # Within a part, a row's rank among its length: the (part, length) groups of a part are small, as a part is one task's input.
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part", "length").orderBy("row")).cast("long") - 1).join(before.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            lengths, ranks = f["length"].to_numpy(), f["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            edges = np.flatnonzero(np.diff(lengths[order])) + 1
            for at in np.split(order, edges) if len(order) else []:
                length = int(lengths[at[0]])
                t = table[length]
                k = np.searchsorted(t[:, 0], ranks[at], "right") - 1
                rel = ranks[at] - t[k, 0]
                sequence[at] = t[k, 1] + rel // t[k, 3]
                offset[at] = t[k, 4] + rel % t[k, 3] * length
            yield f[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Packs the ids of all documents (doc_id, text) into sequences of at most `capacity` ids.

    Nulls count as empty texts, which have the end id alone. Only documents longer than
    `capacity` are cut. Repeated rows are packed each; an empty table gives no row; extra
    columns are left out.
    """
    return place(cut(tokenized(docs, os.fspath(vocabulary), end_id, capacity), "pieces"), capacity)


def sequences(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Contents of each sequence in order: sequence_id, used, pieces (at most `capacity` of them)."""
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length"))).alias("pieces"))
