"""Near pairs in a metric space, exactly, without comparing all blocks: pivots, and what the triangle inequality rules out.

Pivots are rows far from each other, chosen on a bounded sample. Each row gets its distances to the pivots; a tree of
cuts through these distances, made on the sample too, deals rows to cells, and a large cell to blocks of about `block`
rows by a hash. A cell keeps the least and greatest distance to each pivot. By the triangle inequality a row and a cell whose
interval at some pivot is further off than the radius have no near pair, so the row isn't copied to that cell.

Of two blocks one is at home in a group and rows of the other one come to it; which one is decided by a hash, so
that no block is host to all. A group holds its home rows as one matrix and lets the others stream past, in chunks
that are groups of their own where there are many. The sample only decides how much is ruled out, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.plans.shared import cut, importable

#: Rows that pivots and cuts are chosen on, about; pivots; cells at most (their bounds go to every task: 4096 bytes for 32).
SAMPLE, PIVOTS, CELLS = 1 << 14, 12, 1 << 10
#: Rows of a block, and how many times as many, about, stream past it in one group.
BLOCK, CHUNK = 1 << 13, 4
#: Rows of a block at most, where little is ruled out.
WIDE = 1 << 16
#: Distances compared at once.
AT_ONCE = 1 << 22
#: Slack for rounding; what it lets in is left to the caller's exact condition.
SLACK = 1e-6


class Hamming:
    """64-bit numbers by the number of different bits."""

    kind = "long"

    @staticmethod
    def read(column: pa.Array) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False).view(np.uint64)

    @staticmethod
    def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x[:, None] ^ y[None, :])

    @classmethod
    def near(cls, x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
        return cls.between(x, y) <= radius


class Angle:
    """Vectors of one length by their angle; a vector of zeros is at a right angle to all."""

    kind = "array<float>"

    @staticmethod
    def read(column: pa.Array) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    @staticmethod
    def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ y.T, -1, 1))

    @staticmethod
    def near(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
        return x @ y.T >= np.cos(min(radius, np.pi)) - 1e-15


@dataclass
class Tree:
    """Cells by cuts through distances to pivots: node i has the children 2i+1 and 2i+2; the last level's nodes are the cells."""

    depth: int
    pivot: np.ndarray
    value: np.ndarray

    def cell(self, distance: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(distance), np.int64), np.arange(len(distance))
        for _ in range(self.depth):
            at = 2 * at + 1 + (distance[rows, self.pivot[at]] > self.value[at])
        return at - ((1 << self.depth) - 1)


def spread(sample: np.ndarray, metric: type, pivots: int) -> np.ndarray:
    """Rows of the sample, each as far from those before as there is one."""
    if not len(sample):
        return sample
    chosen, near = [0], metric.between(sample, sample[:1])[:, 0].astype(np.float64)
    while len(chosen) < min(pivots, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, metric.between(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def grown(distance: np.ndarray, depth: int) -> Tree:
    """Cuts each node of the sample in halves at the pivot whose distances differ most there."""
    nodes = (1 << depth) - 1
    tree = Tree(depth, np.zeros(max(1, nodes), np.int64), np.zeros(max(1, nodes)))
    held = {0: np.arange(len(distance))}
    for i in range(nodes):
        own = held.pop(i)
        if len(own):
            tree.pivot[i] = np.ptp(distance[own].astype(np.float64), axis=0).argmax()
            at = distance[own, tree.pivot[i]]
            tree.value[i] = np.median(at)
            above = at > tree.value[i]
            held[2 * i + 1], held[2 * i + 2] = own[~above], own[above]
        else:
            held[2 * i + 1] = held[2 * i + 2] = own
    return tree


@dataclass
class Bounds:
    """What cells hold: least and greatest distances to each pivot (cells x pivots), and their numbers of blocks."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray

    def reach(self, distance: np.ndarray, radius: float) -> np.ndarray:
        """rows x cells: whether a row at these distances from the pivots can have a near one in the cell."""
        out = np.broadcast_to(self.blocks > 0, (len(distance), len(self.blocks))).copy()
        for p in range(len(self.pivots)):
            d = distance[:, p, None].astype(np.float64)
            out &= (d >= self.low[:, p] - radius) & (d <= self.high[:, p] + radius)
        return out


@dataclass
class Index:
    """Rows dealt to blocks. `placed`: id, value, cell, block, chunk (as a guest), and the columns `carried` along."""

    placed: DataFrame
    metric: type
    radius: float
    bounds: Bounds
    chunks: int
    carried: tuple[str, ...] = ()

    def copies(self) -> DataFrame:
        """home, block, chunk, side, id, value: each row at home (side 0) and in the groups that it has to meet (side 1)."""
        metric, bounds, chunks, radius = self.metric, self.bounds, self.chunks, self.radius + SLACK
        first = np.cumsum(bounds.blocks) - bounds.blocks  # number of a cell's first block
        total = int(bounds.blocks.sum())
        kind, carried = self.placed.schema["id"].dataType.simpleString(), self.carried
        more = "".join(f", {c} {self.placed.schema[c].dataType.simpleString()}" for c in carried)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                value = metric.read(batch.column("value"))
                cell, block, part = (batch.column(c).to_numpy() for c in ("cell", "block", "chunk"))
                own = first[cell] + block
                step = max(1, AT_ONCE // max(1, total))
                for a in range(0, len(value), step):
                    some = slice(a, a + step)
                    row, other = np.nonzero(np.repeat(bounds.reach(metric.between(value[some], bounds.pivots), radius), bounds.blocks, axis=1))
                    row += a
                    mine = own[row]
                    # Of two blocks the one that the parity of their sum names is host.
                    host = np.where((mine + other) % 2 == 0, np.minimum(mine, other), np.maximum(mine, other))
                    row, other = row[host == other], other[host == other]
                    guest = other != own[row]
                    row, other = row[guest], other[guest]
                    home = np.repeat(np.arange(len(own))[some], chunks)
                    rows, to = np.concatenate([home, row]), np.concatenate([own[home], other])
                    chunk = np.concatenate([np.tile(np.arange(chunks), len(home) // chunks), part[row]])
                    side = np.concatenate([np.zeros(len(home), np.int8), np.ones(len(row), np.int8)])
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(chunk), pa.array(side), *[batch.column(c).take(at) for c in ("id", "value", *carried)]], ["home", "chunk", "side", "id", "value", *carried])

        return self.placed.mapInArrow(run, f"home long, chunk long, side byte, id {kind}, value {metric.kind}{more}")

    def pairs(self, made: Callable[[pa.RecordBatch, pa.RecordBatch], Callable] | None = None, schema: str | None = None) -> DataFrame:
        """Pairs (a < b) at most radius apart, up to rounding, each once.

        made: what tasks make of pairs instead, so that these needn't be joined with their rows; columns by `schema`. It takes two sets of rows
        (id, value, and what is carried) and returns a function of places in them (i, j) whose result is a batch.
        """
        metric, radius = self.metric, self.radius + SLACK
        kind = self.placed.schema["id"].dataType.simpleString()
        names = ["id", "value", *self.carried]

        def ordered(one: pa.RecordBatch, two: pa.RecordBatch) -> Callable:
            import pyarrow.compute as pc

            def some(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
                p, q = one.column("id").take(pa.array(i)), two.column("id").take(pa.array(j))
                return pa.RecordBatch.from_arrays([pc.min_element_wise(p, q), pc.max_element_wise(p, q)], ["a", "b"])

            return some

        make = made or ordered

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, host, values = None, [], None, None
            for batch in batches:
                if not len(batch):
                    continue
                home, chunk, side = (batch.column(c).to_numpy() for c in ("home", "chunk", "side"))
                new = np.flatnonzero((np.diff(home) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1
                for a, b in zip([0, *new.tolist()], [*new.tolist(), len(batch)], strict=True):
                    some = batch.slice(a, b - a).select(names)
                    if key != (home[a], chunk[a]):
                        if held and host is None and key[1] == 0:
                            host, values = whole(held)
                            yield from meet(host, values, host, values, True)
                        key, held, host = (home[a], chunk[a]), [], None
                    if side[a] == 0:
                        held.append(some)
                        continue
                    if not held:
                        continue
                    if host is None:  # all that is at home has come
                        host, values = whole(held)
                        if key[1] == 0:
                            yield from meet(host, values, host, values, True)
                    yield from meet(some, metric.read(some.column("value")), host, values, False)
            if held and host is None and key[1] == 0:
                host, values = whole(held)
                yield from meet(host, values, host, values, True)

        def whole(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
            host = pa.RecordBatch.from_arrays([pa.concat_arrays([h.column(c) for h in held]) for c in names], names)
            return host, metric.read(host.column("value"))

        def meet(one: pa.RecordBatch, x: np.ndarray, two: pa.RecordBatch, y: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
            of = make(one, two)
            step = max(1, AT_ONCE // max(1, len(y)))
            for a in range(0, len(x), step):
                i, j = np.nonzero(metric.near(x[a : a + step], y, radius))
                i += a
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield of(i, j)

        return self.copies().repartition("home", "chunk").sortWithinPartitions("home", "chunk", "side", *self.carried[:1]).mapInArrow(run, schema or f"a {kind}, b {kind}")


def index(rows: DataFrame, metric: type, radius: float, block: int | None = None, pivots: int = PIVOTS, cells: int = CELLS, carried: tuple[str, ...] = ()) -> Index:
    """An index of rows (id, value, and columns that are carried along); ids differ. Rows that share the first of `carried` share their blocks in a cell.

    Where the sample says that pivots rule out less than half, blocks are larger, up to WIDE, as rows are copied to about half of them.
    """
    importable(rows.sparkSession)
    n = rows.count()
    step = max(1, n // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("value").limit(4 * SAMPLE).toArrow().column(0).combine_chunks()
    sample = metric.read(sample)
    if len(sample):  # the same whatever order it came in
        sample = sample[np.lexsort(sample.reshape(len(sample), -1).T)]
    chosen = spread(sample, metric, pivots)
    if block is None:
        distance = metric.between(sample, chosen).astype(np.float64) if len(sample) else np.zeros((0, 1))
        coarse = grown(distance, 4)
        at = coarse.cell(distance)
        ends = [np.array([f(distance[at == k], axis=0, initial=e) for k in range(16)]) for f, e in ((np.min, np.inf), (np.max, -np.inf))]
        share = Bounds(chosen, *ends, np.ones(16, np.int64)).reach(distance[:1024], radius).mean() if len(chosen) else 0.0
        block = max(BLOCK, min(WIDE, n // 16)) if share > 0.5 else BLOCK
    depth = max(0, min(int(cells).bit_length() - 1, (-(-n // block) - 1).bit_length(), max(1, len(sample) // 8).bit_length() - 1))
    tree = grown(metric.between(sample, chosen) if len(sample) else np.zeros((0, 1)), depth)
    more = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    kind, names = rows.schema["id"].dataType.simpleString(), [f"d{i}" for i in range(max(1, len(chosen)))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = metric.read(batch.column("value"))
            distance = metric.between(value, chosen).astype(np.float64) if len(chosen) else np.zeros((len(value), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.cell(distance)), *[pa.array(d) for d in distance.T]], ["id", "value", *carried, "key", "cell", *names])

    found = rows.select("id", F.col("value").cast(metric.kind).alias("value"), *carried, F.xxhash64(*(carried[:1] or ("id",))).alias("key")).mapInArrow(place, f"id {kind}, value {metric.kind}{more}, key long, cell long, {', '.join(d + ' double' for d in names)}")
    found = cut(found, "cells")
    bounds = found.groupBy("cell").agg(F.count("*").alias("n"), *[f(d).alias(f"{f.__name__}_{d}") for d in names for f in (F.min, F.max)]).toPandas()  # a row a cell
    count, low, high = np.zeros(1 << depth, np.int64), np.full((1 << depth, len(names)), np.inf), np.full((1 << depth, len(names)), -np.inf)
    count[bounds["cell"]] = bounds["n"]
    for i, d in enumerate(names):
        low[bounds["cell"], i], high[bounds["cell"], i] = bounds[f"min_{d}"], bounds[f"max_{d}"]
    blocks = -(-count // block)
    width = F.element_at(F.split(F.lit(",".join(map(str, np.maximum(blocks, 1).tolist()))), ",").cast("array<bigint>"), (F.col("cell") + 1).cast("int"))
    chunks = max(1, -(-n // (CHUNK * block)))
    placed = found.select("id", "value", *carried, "cell", F.pmod(F.col("key"), width).alias("block"), F.pmod(F.shiftright("key", 24), F.lit(chunks)).alias("chunk"))
    return Index(placed, metric, radius, Bounds(chosen, low, high, blocks), chunks, carried)


def near_pairs(rows: DataFrame, metric: type, radius: float, **sizes: int) -> DataFrame:
    """Pairs (a < b) of rows (id, value) at most radius apart, up to rounding."""
    return index(rows, metric, radius, **sizes).pairs()
