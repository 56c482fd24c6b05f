"""Clusters that links join in order, under limits on all cross pairs, without a table of links or of pairs of clusters.

A link can be decided once it comes before every other one that is still open at both its clusters; what is decided elsewhere
can't touch them before. So clusters are dealt to groups that one task holds. A scan over all pairs of rows, in blocks, finds each
cluster's first open link that leaves its group, and no more: a row a cluster and block. Each group then decides its own links in
order, until they come after one that leaves. Where a cluster stopped is one link, and these links make the next groups.
A cross pair under the limit or a shared photo stays in the way whatever the clusters grow to, so such pairs are passed over at once.

Links are in the order of their score, strongest first, then of the places of their rows. Scores count with nine digits and are
summed in the order of the vector, so that they are the same wherever they are computed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions.scalar import dot
from argentum.operators.components import components
from argentum.plans.shared import cut, importable

#: Digits of a score that count.
DIGITS = 9
#: Rows and columns whose products are computed at once.
TILE, WIDE = 1 << 9, 1 << 12
#: Links of a group that are held at once.
AHEAD = 1 << 20


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of all pairs."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += x[:, k, None] * y[None, :, k]
    return np.round(out, DIGITS)


def products_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of rows with rows."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return np.round(out, DIGITS)


def before(s, a, b, t, c, d):
    """Whether links of score s between places a < b come before those of score t, places c < d."""
    return (s > t) | ((s == t) & ((a < c) | ((a == c) & (b < d))))


@dataclass
class Rows:
    """Rows of whole clusters, one after another. s, a, b: the link at which a row's cluster stopped; start: each cluster's first row, code: each row's cluster."""

    place: np.ndarray
    cluster: np.ndarray
    part: np.ndarray
    photo: np.ndarray
    s: np.ndarray
    a: np.ndarray
    b: np.ndarray
    x: np.ndarray

    def __post_init__(self) -> None:
        new = np.ones(len(self.cluster), bool)
        new[1:] = self.cluster[1:] != self.cluster[:-1]
        self.start, self.code = np.flatnonzero(new), np.cumsum(new) - 1
        self.end = np.append(self.start[1:], len(new))

    def __len__(self) -> int:
        return len(self.place)

    def slice(self, i: int, j: int) -> Rows:
        return Rows(*(v[i:j] for v in (self.place, self.cluster, self.part, self.photo, self.s, self.a, self.b, self.x)))

    def tiles(self, rows: int) -> Iterator[tuple[int, int]]:
        """Ranges of whole clusters with about so many rows."""
        i = 0
        while i < len(self):
            j = int(self.start[np.searchsorted(self.start, i + rows, "right") - 1]) if i + rows < len(self) else len(self)
            j = j if j > i else int(self.end[self.code[i]])
            yield i, j
            i = j


class First:
    """The first link of each cluster so far."""

    def __init__(self, n: int, least: float) -> None:
        self.s, self.a, self.b = np.full(n, least), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)

    def take(self, at: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        order = np.lexsort((b, a, -s, at))
        order = order[np.append(True, np.diff(at[order]) != 0)]
        at, s, a, b = at[order], s[order], a[order], b[order]
        better = before(s, a, b, self.s[at], self.a[at], self.b[at])
        at = at[better]
        self.s[at], self.a[at], self.b[at] = s[better], a[better], b[better]

    def found(self) -> np.ndarray:
        return np.flatnonzero(self.b >= 0)


class Home:
    """Rows that others meet: what leaves their groups is kept for their clusters."""

    def __init__(self, rows: Rows, link: float, least: float, slack: float) -> None:
        self.rows, self.link, self.least, self.slack = rows, link, least, slack
        self.first = First(len(rows.start), link)
        self.photos, number = np.unique(rows.photo, return_inverse=True)
        self.taken = np.sort(rows.code * len(self.photos) + number)

    def itself(self) -> None:
        for i, j in self.rows.tiles(TILE):
            self.meet(self.rows.slice(i, j), self.first, int(self.rows.code[i]), i)

    def meet(self, guests: Rows, first: First, shift: int = 0, begin: int = 0) -> None:
        """guests: whole clusters, first: theirs, from place `shift` on; begin: the row at home to begin with."""
        for i, j in guests.tiles(TILE):
            for k, m in self.rows.slice(begin, len(self.rows)).tiles(WIDE) if begin else self.rows.tiles(WIDE):
                self._tile(guests, first, shift, i, j, k + begin, m + begin)

    def _tile(self, guests: Rows, first: First, shift: int, i: int, j: int, k: int, m: int) -> None:
        """Guests i to j meet rows k to m at home."""
        home, enough = self.rows, self.least - self.slack
        if j - i <= TILE and m - k <= WIDE:
            score = guests.x[i:j] @ home.x[k:m].T
            y, z = self._strong(guests, first, shift, score, i, k)
            for mine, theirs in ((guests.start, home.start), (guests.end - 1, home.end - 1)):  # two of the cross pairs rule out most
                good = score[mine[guests.code[y]] - i, theirs[home.code[z]] - k] >= enough
                y, z = y[good], z[good]
            c, d, at = _pairs(guests.code[y], home.code[z])
            low = _lowest(score, guests.start[c] - i, guests.end[c] - i, home.start[d] - k, home.end[d] - k)
        else:  # a large cluster, in parts
            c0, d0, some = guests.code[i], home.code[k], []
            lows = np.full((guests.code[j - 1] - c0 + 1, home.code[m - 1] - d0 + 1), np.inf)
            for p in range(i, j, TILE):
                q = min(j, p + TILE)
                c1, c2 = guests.code[p], guests.code[q - 1] + 1
                for r in range(k, m, WIDE):
                    t = min(m, r + WIDE)
                    d1, d2 = home.code[r], home.code[t - 1] + 1
                    score = guests.x[p:q] @ home.x[r:t].T
                    part = np.minimum.reduceat(np.minimum.reduceat(score, np.maximum(guests.start[c1:c2] - p, 0), 0), np.maximum(home.start[d1:d2] - r, 0), 1)
                    at = lows[c1 - c0 : c2 - c0, d1 - d0 : d2 - d0]
                    np.minimum(at, part, out=at)
                    y, z = self._strong(guests, first, shift, score, p, r)
                    good = at[guests.code[y] - c1, home.code[z] - d1] >= enough
                    y, z = y[good], z[good]
                    if len(y):
                        some.append(self._exact(guests, first, shift, y, z))
            y, z = (np.concatenate([s[n] for s in some]) if some else np.zeros(0, np.int64) for n in (0, 1))
            c, d, at = _pairs(guests.code[y], home.code[z])
            low = lows[c - c0, d - d0]
        if not len(y):
            return
        good = low >= enough
        good[good] = ~self._shared(guests, c[good], d[good])
        for n in np.flatnonzero(good & (low < self.least + self.slack)).tolist():  # too close to tell
            one, two = slice(guests.start[c[n]], guests.end[c[n]]), slice(home.start[d[n]], home.end[d[n]])
            good[n] = least_of(guests.x[one], home.x[two], self.least)
        y, z, s, a, b = self._exact(guests, first, shift, y[good[at]], z[good[at]])
        if len(y):
            first.take(guests.code[y] + shift, s, a, b)
            self.first.take(home.code[z], s, a, b)

    def _strong(self, guests: Rows, first: First, shift: int, score: np.ndarray, p: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Guests and rows at home, between groups, whose link may be open and come before those found so far; score: of those from p and r on."""
        home = self.rows
        at = np.flatnonzero(score >= self.link - self.slack)
        s, (y, z) = score.ravel()[at], np.divmod(at, score.shape[1])
        y, z = y + p, z + r
        good = (s >= np.minimum(first.s[guests.code[y] + shift], self.first.s[home.code[z]]) - self.slack) & (s <= np.minimum(guests.s[y], home.s[z]) + self.slack) & (guests.part[y] != home.part[z])
        return y[good], z[good]

    def _exact(self, guests: Rows, first: First, shift: int, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of these the ones whose link is open and comes before those found so far, with its rank; of a pair of clusters the first one."""
        home = self.rows
        s = products_of(guests.x[y].astype(np.float64), home.x[z].astype(np.float64))
        a, b = np.minimum(guests.place[y], home.place[z]), np.maximum(guests.place[y], home.place[z])
        good = s >= self.link
        for rows, at in ((guests, y), (home, z)):
            good &= ~before(s, a, b, rows.s[at], rows.a[at], rows.b[at])
        c, d = guests.code[y] + shift, home.code[z]
        good &= before(s, a, b, first.s[c], first.a[c], first.b[c]) | before(s, a, b, self.first.s[d], self.first.a[d], self.first.b[d])
        y, z, s, a, b, c, d = (v[good] for v in (y, z, s, a, b, c, d))
        order = np.lexsort((b, a, -s, d, c))
        c, d = c[order], d[order]
        order = order[np.append(True, (np.diff(c) != 0) | (np.diff(d) != 0))] if len(order) else order
        return y[order], z[order], s[order], a[order], b[order]

    def _shared(self, guests: Rows, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Whether the guests' clusters c have a photo of clusters d at home."""
        sizes = guests.end[c] - guests.start[c]
        out, done = np.zeros(len(c), bool), 0
        ends = np.cumsum(sizes)
        while done < len(c):  # about a million rows at once
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 20), "right")))
            own, n = np.arange(done, upto), sizes[done:upto]
            row = np.repeat(guests.start[c[own]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            pair, photo = np.repeat(own, n), guests.photo[row]
            at = np.minimum(np.searchsorted(self.photos, photo), len(self.photos) - 1)
            key = d[pair] * len(self.photos) + at
            near = np.minimum(np.searchsorted(self.taken, key), len(self.taken) - 1)
            out[pair[(self.photos[at] == photo) & (self.taken[near] == key)]] = True
            done = upto
        return out


def _pairs(c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs, and the number of each one given."""
    wide = int(d.max()) + 1 if len(d) else 1
    pairs, at = np.unique(c * wide + d, return_inverse=True)
    return *np.divmod(pairs, wide), at


def _lowest(score: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least score of rows i to j and columns k to m, for each of these."""
    out, done = np.full(len(i), np.inf), 0
    ends = np.cumsum((j - i) * (m - k))
    while done < len(i):  # about a million at once
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 20), "right")))
        n = ((j - i) * (m - k))[done:upto]
        begin = np.append(0, np.cumsum(n)[:-1])
        row, column = np.divmod(np.arange(n.sum()) - np.repeat(begin, n), np.repeat((m - k)[done:upto], n))
        out[done:upto] = np.minimum.reduceat(score[row + np.repeat(i[done:upto], n), column + np.repeat(k[done:upto], n)], begin)
        done = upto
    return out


def least_of(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether all pairs reach `least`."""
    return all(products(x[i : i + TILE].astype(np.float64), y[j : j + WIDE].astype(np.float64)).min() >= least for i in range(0, len(x), TILE) for j in range(0, len(y), WIDE))


def decide(rows: Rows, out: First, link: float, least: float, mean: float) -> np.ndarray:
    """Decides the links within one group, in order, as far as they come before those that leave it.

    out: of each cluster the first link that leaves; becomes where it stopped (b < 0: nowhere). The result is the number of the
    cluster that each one belongs to now. Of a group's links at most AHEAD are held, the first ones; what these decide leaves fewer for later.
    """
    n = len(rows.start)
    head, size, members = list(range(n)), (rows.end - rows.start).tolist(), [[k] for k in range(n)]
    if n == 1:
        return np.array(head)
    held = list(_scores(rows)) if len(rows) <= WIDE // 2 else None  # else computed again each time
    low, total = _between(rows, held or _scores(rows))
    stuck, after = set(), (np.inf, -1, -1)
    while True:
        i, j, s, a, b, whole = _ahead(rows, held or _scores(rows), link, low >= least, np.array(head), after)
        # How many of these come before the one that leaves, for each cluster.
        rank = np.lexsort((np.append(out.b, b), np.append(out.a, a), -np.append(out.s, s)))
        free, own = np.zeros(n, np.int64), rank < n
        free[rank[own]] = np.cumsum(~own)[own]
        free = np.where(out.b < 0, len(s), free).tolist()
        for k, (c, d) in enumerate(zip(rows.code[i].tolist(), rows.code[j].tolist(), strict=True)):
            p, q = head[c], head[d]
            if p == q or low[p, q] < least:
                continue
            if p in stuck or q in stuck or k >= free[p] or k >= free[q]:
                for c in {p, q} - stuck:
                    out.take(np.array([c]), s[[k]], a[[k]], b[[k]])
                    stuck.add(c)
                continue
            if round(total[p, q] / (size[p] * size[q]), DIGITS) < mean:
                continue
            for m in members[q]:
                head[m] = p
            members[p] += members[q]
            size[p] += size[q]
            free[p] = min(free[p], free[q])
            low[p] = np.minimum(low[p], low[q])
            low[:, p] = low[p]
            total[p] += total[q]
            total[:, p] = total[p]
            out.take(np.array([p]), out.s[[q]], out.a[[q]], out.b[[q]])
        if whole:
            return np.array(head)
        after = (s[-1], a[-1], b[-1])


def _scores(rows: Rows) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first column, scores: blocks that hold every pair of rows of two clusters, in one order at least."""
    x = rows.x.astype(np.float64)
    for p in range(0, len(x), TILE):
        for r in range(p, len(x), WIDE):
            if rows.code[p] != rows.code[min(len(x), r + WIDE) - 1]:
                yield p, r, products(x[p : p + TILE], x[r : r + WIDE])


def _between(rows: Rows, scores: Iterable[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each two clusters the least score (with a common photo: none) and the sum."""
    n = len(rows.start)
    low, total = np.full((n, n), np.inf), np.zeros((n, n))
    for p, r, score in scores:
        q, t = p + score.shape[0], r + score.shape[1]
        c, d = rows.code[p], rows.code[r]
        starts = [np.maximum(rows.start[rows.code[u] : rows.code[v - 1] + 1] - u, 0) for u, v in ((p, q), (r, t))]
        at = slice(c, c + len(starts[0])), slice(d, d + len(starts[1]))
        apart = np.where(rows.photo[p:q, None] == rows.photo[None, r:t], -np.inf, score)
        low[at] = np.minimum(low[at], np.minimum.reduceat(np.minimum.reduceat(apart, starts[0], 0), starts[1], 1))
        total[at] += np.add.reduceat(np.add.reduceat(score, starts[0], 0), starts[1], 1)
    low, total = np.triu(low, 1), np.triu(total, 1)  # where rows come before columns all are there
    return low + low.T, total + total.T


def _ahead(rows: Rows, scores: Iterable[tuple[int, int, np.ndarray]], link: float, alive: np.ndarray, head: np.ndarray, after: tuple) -> tuple:
    """The first open links of clusters whose pairs are alive, in order, after one; and whether these are all."""
    found, n, whole = [], 0, True
    for p, r, score in scores:
        i, j = np.nonzero(score >= link)
        s, i, j = score[i, j], i + p, j + r
        c, d = head[rows.code[i]], head[rows.code[j]]
        good = (i < j) & (c != d) & alive[c, d]
        s, i, j = s[good], i[good], j[good]
        a, b = np.minimum(rows.place[i], rows.place[j]), np.maximum(rows.place[i], rows.place[j])
        good = before(*after, s, a, b)
        for k in (i, j):
            good &= ~before(s, a, b, rows.s[k], rows.a[k], rows.b[k])
        found.append([v[good] for v in (i, j, s, a, b)])
        n += int(good.sum())
        if n > 2 * AHEAD:
            found, n, whole = [_sorted(found, AHEAD)], AHEAD, False
    out = _sorted(found, AHEAD) if found else [np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64, np.int64)]
    return *out, whole and n <= AHEAD


def _sorted(found: list[list[np.ndarray]], most: int) -> list[np.ndarray]:
    i, j, s, a, b = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((b, a, -s))[:most]
    return [v[order] for v in (i, j, s, a, b)]


#: Blocks that rows are dealt to, at least where there are rows enough; and rows of a block at most (one task holds a block).
BLOCKS, FEW, MANY = 8, 1 << 11, 1 << 17
STATE = ("id", "photo_id", "vector", "place", "photo", "cluster", "s", "a", "b")


def _rows(batch: pa.RecordBatch, kind: type) -> Rows:
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(batch), -1)
    return Rows(*(number(c) for c in ("place", "cluster", "part", "photo", "s", "a", "b")), x)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in batches]) for k in range(batches[0].num_columns)], batches[0].schema.names)


def leaving(dealt: DataFrame, link: float, least: float, slack: float, kind: type) -> DataFrame:
    """part, cluster, s, a, b: first open links of clusters with those of other parts; a row for each block that a cluster meets.

    Rows of a cluster share a block. Each two blocks meet in one task, that holds one of them while the other one streams past.
    """
    n = dealt.count()
    blocks = max(1, min(BLOCKS, n // FEW), -(-n // MANY))
    block, other = F.col("block"), F.col("other")
    at = dealt.select("part", "cluster", "place", "photo", "s", "a", "b", "vector", F.pmod(F.xxhash64("cluster"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    side = F.when(block == other, 2).when(block < other, 0).otherwise(1).alias("side")
    at = at.withColumns({"home": F.least(block, other), "guest": F.greatest(block, other)})
    number = F.expr(f"int(home * {blocks} - home * (home - 1) div 2 + guest - home)")
    at = at.select("part", "cluster", "place", "photo", "s", "a", "b", "vector", side, number.alias("number"))

    def links(rows: Rows, first: First) -> pa.RecordBatch:
        k = first.found()
        own = rows.start[k]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (rows.part[own], rows.cluster[own], first.s[k], first.a[k], first.b[k])], ["part", "cluster", "s", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, held, guests, waiting = None, [], [], 0
        for batch in batches:
            cut = int((batch.column("side").to_numpy() != 1).sum())  # rows at home come first
            if cut:
                held.append(batch.slice(0, cut))
            if cut == len(batch):
                continue
            guests.append(batch.slice(cut))
            waiting += len(batch) - cut
            if not held or waiting < WIDE:
                continue
            host = host or Home(_rows(_joined(held), kind), link, least, slack)
            whole = _joined(guests)
            rows = _rows(whole, kind)
            upto = int(rows.start[-1])  # more of the last cluster may come
            if upto:
                some = rows.slice(0, upto)
                first = First(len(some.start), link)
                host.meet(some, first)
                yield links(some, first)
            guests, waiting = [whole.slice(upto)], len(whole) - upto
        if not held:
            return
        host = host or Home(_rows(_joined(held), kind), link, least, slack)
        if guests:
            rows = _rows(_joined(guests), kind)
            first = First(len(rows.start), link)
            host.meet(rows, first)
            yield links(rows, first)
        if held[0].column("side")[0].as_py() == 2:
            host.itself()
        yield links(host.rows, host.first)

    return at.repartitionById(blocks * (blocks + 1) // 2, "number").sortWithinPartitions("side", "cluster").mapInArrow(run, "part long, cluster long, s double, a long, b long")


def decided(dealt: DataFrame, out: DataFrame | None, link: float, least: float, mean: float) -> DataFrame:
    """STATE after the links within each part are decided. out: see leaving (None: no links leave their parts)."""
    rows = dealt.select("part", *STATE)
    if out is not None:
        rows = rows.unionByName(out, allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}

    def done(batch: pa.RecordBatch) -> pa.RecordBatch:
        mark = batch.column("place").is_null().to_numpy(zero_copy_only=False)
        own, leave = batch.filter(pa.array(~mark)), batch.filter(pa.array(mark))
        rows = _rows(own, np.float32)
        first = First(len(rows.start), link)
        labels = rows.cluster[rows.start]
        if len(leave):
            order = np.argsort(labels)
            at = order[np.searchsorted(labels[order], leave.column("cluster").to_numpy())]
            first.take(at, *(leave.column(c).to_numpy() for c in ("s", "a", "b")))
        head = np.arange(len(labels))
        parts = rows.part[rows.start]
        begin = np.flatnonzero(np.append(True, np.diff(parts) != 0))
        for c, d in zip(begin.tolist(), np.append(begin[1:], len(parts)).tolist(), strict=True):
            if d - c > 1:
                some = First(d - c, link)
                some.s, some.a, some.b = first.s[c:d], first.a[c:d], first.b[c:d]
                head[c:d] = c + decide(rows.slice(int(rows.start[c]), int(rows.end[d - 1])), some, link, least, mean)
        new = {"cluster": labels[head], "s": first.s[head], "a": first.a[head], "b": first.b[head]}
        return pa.RecordBatch.from_arrays([pa.array(new[c][rows.code]) if c in new else own.column(c) for c in STATE], list(STATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column("part").to_numpy()
            cut = len(part) if not held else int(np.searchsorted(part, part[0], "right")) if held[-1].column("part")[-1].as_py() == part[0] else 0
            last = int(np.searchsorted(part, part[-1]))  # more of the last part may come
            if held and cut < len(part):
                yield done(_joined([*held, batch.slice(0, cut)]))
                held = []
            else:
                cut = 0
            if not held and last > cut:
                yield done(batch.slice(cut, last - cut))
                cut = last
            held.append(batch.slice(cut))
        if held:
            yield done(_joined(held))

    schema = ", ".join(f"{c} {kinds[c]}" for c in STATE)
    return rows.repartition("part").sortWithinPartitions("part", F.col("place").isNull(), "cluster").mapInArrow(run, schema)


def parts(state: DataFrame, alone: int) -> DataFrame:
    """cluster, part: clusters go together by the links at which they stopped, as far as at most `alone` rows.

    Of more the first link is taken, which can be decided for sure, with what stopped at its clusters, first ones first.
    """
    own = state.select("place", "cluster")
    stopped = state.filter("place = cluster").select("cluster", "s", "a", "b")
    ends = stopped.join(own.select(F.col("place").alias("a"), F.col("cluster").alias("x")), "a").join(own.select(F.col("place").alias("b"), F.col("cluster").alias("y")), "b")
    edges = cut(ends.select("cluster", F.when(F.col("x") == F.col("cluster"), F.col("y")).otherwise(F.col("x")).alias("other"), "s", "a", "b"), "stopped")
    sizes = own.groupBy("cluster").agg(F.count("*").alias("size"))
    found = components(edges.select(F.col("cluster").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cluster").join(sizes, "cluster")
    found = cut(found.join(found.groupBy("component").agg(F.sum("size").alias("rows")), "component"), "parts")
    small = found.filter(F.col("rows") <= alone).select("cluster", F.col("component").alias("part"))
    large = found.filter(F.col("rows") > alone)
    if large.isEmpty():
        return small
    near = edges.join(large, "cluster")
    roots = near.groupBy("component", "a", "b").agg(F.count("*").alias("n"), F.min("cluster").alias("p"), F.max("cluster").alias("q")).filter("n = 2").select("component", "p", "q")
    near = near.join(roots, "component").filter("(other = p or other = q) and cluster <> p and cluster <> q")
    order = Window.partitionBy("component").orderBy(F.desc("s"), "a", "b", "cluster").rowsBetween(Window.unboundedPreceding, 0)
    leaves = near.withColumn("upto", F.sum("size").over(order)).filter(F.col("upto") <= alone).select("cluster", F.col("p").alias("part"))
    return small.union(leaves).union(roots.select(F.explode(F.array("p", "q")).alias("cluster"), F.col("p").alias("part")))  # all others wait alone


def in_rounds(rows: DataFrame, link: float, least: float, mean: float, alone: int) -> DataFrame:
    """cluster, id, photo_id of all rows. rows: id, photo_id, vector, place (their order), photo (a number). alone: rows of a group, about."""
    importable(rows.sparkSession)
    squares, size = rows.agg(F.max(dot(F.col("vector"), F.col("vector"))), F.max(F.size("vector"))).first()
    kind = np.float32
    slack = ((size or 0) + 8) * np.finfo(kind).eps / 2 * (squares or 0.0)
    if slack > 1e-3:
        kind, slack = np.float64, slack * np.finfo(np.float64).eps / np.finfo(kind).eps
    slack += 10.0**-DIGITS
    dealt, ended = begun(rows, "place"), []
    while True:
        after = cut(decided(dealt, leaving(dealt, link, least, slack, kind), link, least, mean), "clusters")
        ended.append(after.filter("b < 0").select("cluster", "id", "photo_id"))
        state = after.filter("b >= 0")
        n = state.count()
        if not n:
            return reduce(DataFrame.union, ended)
        dealt = state.withColumn("part", F.lit(0).cast("long")) if n <= alone else state.join(parts(state, alone), "cluster", "left").withColumn("part", F.coalesce("part", "cluster"))


def begun(rows: DataFrame, part: str) -> DataFrame:
    """STATE of rows that are clusters of one, dealt to parts by a column."""
    new = {"cluster": F.col("place"), "s": F.lit(float("inf")), "a": F.lit(-1).cast("long"), "b": F.lit(-1).cast("long"), "part": F.col(part), "vector": F.col("vector").cast("array<float>")}
    return rows.withColumns(new).select("part", *STATE)


def placed(vectors: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Adds place, that increases in the order of `by`, and photo, a number for each photo_id."""
    order = list(dict.fromkeys([*by, "id"]))
    rows = cut(vectors.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    if rows.schema["photo_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn("photo", F.coalesce(F.col("photo_id").cast("long"), F.lit(-(2**63))))
    return cut(rows.withColumn("photo", F.min("place").over(Window.partitionBy("photo_id"))), "placed")
