"""Token-ID output compressed by Re-Pair grammars (operator 2).

A shard holds documents with successive ids. Its file has the grammar (rules: pairs of
symbols; `lengths`: ids that each symbol expands to), the compressed sequence, and where
each document begins, so that any document can be decoded without the others.

Re-Pair replaces the most frequent pair of neighbours again and again. Here a round
replaces many frequent pairs at once, those with the higher count first where they
overlap; rounds go on until no pair of neighbours is left that repeats often enough.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argentum.llm.byte_bpe import gathered
from argentum.llm.repeats import PART, TEXT_HASH, dealt
from argentum.llm.session import place
from argentum.llm.word_tokens import pieces

MAGIC = b"RPR1"
#: Most shards whose places are broadcast; beyond, they are joined by a shuffle.
SMALL = 200_000
HASH, SLOTS = np.uint64(0x9E3779B97F4A7C15), 20


def frequent(pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, place, rank): pairs that occur `least` times, most frequent first; where they are, ascending; and which one is there."""
    # A slot of the hash table holds at least as many as each of its pairs: what is left is counted exactly.
    slot = (pair * HASH >> np.uint64(64 - SLOTS)).view(np.int64)
    place = np.flatnonzero(np.bincount(slot, minlength=1 << SLOTS)[slot] >= least)
    keys, which, count = np.unique(pair[place], return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    order = order[: np.count_nonzero(count >= least)]
    rank = np.full(len(keys), -1, np.int64)
    rank[order] = np.arange(len(order))
    rank = rank[which]
    return keys[order], place[rank >= 0], rank[rank >= 0]


def compress(ids: np.ndarray, breaks: np.ndarray, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Re-Pair: (sequence, rules, breaks in the sequence, base). Symbols from `base` on are rules; pairs never cross a break.

    least: occurrences that a pair needs; at the end no pair has as many.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    seq, rules, top = ids.astype(np.uint32), [], base
    edge = np.zeros(len(seq) + 1, bool)  # a document begins here
    edge[breaks] = True
    edge = edge[:-1]
    # Where a pair may be frequent: those seldom in a round stay so unless they have a new symbol.
    live = np.ones(len(seq), bool)
    while len(seq) > 1:
        inner = ~edge[1:]
        twin = inner & (seq[1:] == seq[:-1])
        some = inner & live[:-1] | twin
        # Of a run of one symbol, every second pair counts: they don't overlap.
        at = np.flatnonzero(twin)
        if len(at):
            begin = np.ones(len(at), bool)
            begin[1:] = np.diff(at) > 1
            first = np.flatnonzero(begin)
            some[at[(np.arange(len(at)) - first[np.cumsum(begin) - 1]) % 2 == 1]] = False
        some = np.flatnonzero(some)
        keys, place, rank = frequent(seq[some].astype(np.uint64) << np.uint64(32) | seq[some + 1], least)
        if not len(keys):
            break
        place = some[place]
        live = np.zeros(len(seq), bool)
        live[place] = True
        # Of overlapping places the one of lower rank stays: keep local minima, a few times; the most frequent pair wins everywhere.
        score = np.full(len(seq) + 2, len(keys), np.int64)  # of the place before each
        kept, taken = [], np.zeros(len(seq) + 2, bool)
        for _ in range(4):
            score[place + 1] = rank
            win = (rank < score[place]) & (rank < score[place + 2])
            kept.append((place[win], rank[win]))
            taken[place[win] + 1] = True
            score[place + 1] = len(keys)
            stay = ~(taken[place] | taken[place + 1] | taken[place + 2])
            place, rank = place[stay], rank[stay]
            if not len(place):
                break
        where, rank = (np.concatenate(x) for x in zip(*kept, strict=True))
        # A pair that lost too many places waits for the next round.
        worth = np.bincount(rank, minlength=len(keys)) >= least
        own = worth[rank]
        where, symbol = where[own], (np.cumsum(worth) - 1)[rank[own]]
        used = keys[worth]
        rules.append(np.stack([used >> np.uint64(32), used & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        seq[where] = top + symbol
        top += len(used)
        live[where] = True
        live[where[where > 0] - 1] = True
        rest = np.ones(len(seq), bool)
        rest[where + 1] = False
        seq, edge, live = seq[rest], edge[rest], live[rest]
    new_breaks = np.flatnonzero(edge)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), new_breaks, base


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; rules refer to earlier rules only."""
    out, left = np.zeros(len(rules), np.int64), np.arange(len(rules))
    while len(left):  # as many times as rules are nested
        both = sizes(rules[left].ravel(), out, base).reshape(-1, 2)
        known = both.all(1)
        if not known.any():
            raise ValueError("rules that refer to later ones")
        out[left[known]] = both[known].sum(1)
        left = left[~known]
    return out


def sizes(seq: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Ids that each symbol expands to."""
    out = np.ones(len(seq), np.int64)
    big = seq >= base
    out[big] = lengths[seq[big] - base]
    return out


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of a sequence: all symbols that are rules are replaced at once, until none is left."""
    size, left = sizes(seq, lengths, base), sizes(rules[:, 0], lengths, base)
    at, out = np.cumsum(size) - size, np.empty(int(size.sum()), np.uint32)
    while len(seq):
        big = seq >= base
        out[at[~big]] = seq[~big]
        rule, at = seq[big] - base, at[big]
        seq, at = np.concatenate([rules[rule, 0], rules[rule, 1]]), np.concatenate([at, at + left[rule]])
    return out


def dump(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A shard's file: magic, sizes, then rules, lengths, document places and the sequence, each packed."""
    seq, rules, places, base = compress(ids, starts)
    parts = [rules.astype("<u4").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), places.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), seq.astype("<u4").tobytes()]
    packed = [zstandard.compress(p, 1) for p in parts]
    return MAGIC + np.array([base, len(ids), len(starts), *map(len, packed)], "<u8").tobytes() + b"".join(packed)


class Shard:
    """Reads a shard's file; any document or range of ids can be had alone."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard of ids")
        head = np.frombuffer(blob, "<u8", 8, 4)
        self.base, self.size, self.documents = map(int, head[:3])
        at, parts = 68, []
        for n in head[3:].tolist():
            parts.append(np.frombuffer(zstandard.decompress(blob[at : at + n]), "<u4"))
            at += n
        rules, self.lengths, self.places, self.starts, self.seq = parts
        self.rules = rules.reshape(-1, 2)

    def document(self, i: int) -> np.ndarray:
        end = self.places[i + 1] if i + 1 < self.documents else len(self.seq)
        return expand(self.seq[self.places[i] : end], self.rules, self.lengths, self.base)

    def all(self) -> np.ndarray:
        return expand(self.seq, self.rules, self.lengths, self.base)

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the shard: only symbols that reach into the range are expanded."""
        size = sizes(self.seq, self.lengths, self.base)
        ends = np.cumsum(size)
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left")
        first = ends[i] - size[i] if i < len(ends) else 0
        return expand(self.seq[i : j + 1], self.rules, self.lengths, self.base)[a - first : b - first]


SHARD = "shard int, piece int, first_id long, last_id long, n_docs long, n_ids long, doc_ids binary, data binary"


def write_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, shard_ids: int = 1 << 19) -> None:
    """Writes ids of all documents (doc_id, text), ascending by doc_id, as a table of shard files in `path`.

    One exchange by ranges of doc_id, whose limits come from the sizes of all texts; a shard's memory is bounded by `shard_ids` (a longer
    document is a shard of its own). Nulls count as empty texts, rows with equal ids are ordered by the text's hash, then the text,
    null first; rows without doc_id come first.
    """
    vocabulary = os.fspath(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = pieces(vocabulary), np.array([end_id], "<u4").tobytes()
        part, number, held, keys, size = -1, 0, [], [], 0

        def shard() -> pa.RecordBatch:
            n = np.array([len(x) // 4 for x in held])
            blob = dump(np.frombuffer(b"".join(held), "<u4"), np.cumsum(n) - n)
            known = np.array([k is not None for k in keys])
            ids = np.array([k or 0 for k in keys], "<i8")
            columns = [[part], [number], [keys[0]], [keys[-1]], [len(keys)], [int(n.sum())], [zstandard.compress(known.tobytes() + ids.tobytes(), 1)], [blob]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary()), strict=True)], ["shard", "piece", "first_id", "last_id", "n_docs", "n_ids", "doc_ids", "data"])

        for own, texts in gathered(batches):
            for (key, _, of), ids in zip(own, encoder.encode(texts), strict=True):
                ids += end
                if size and (of != part or size + len(ids) // 4 > shard_ids):
                    yield shard()
                    number, held, keys, size = number + 1, [], [], 0
                part = of
                held.append(ids)
                keys.append(key)
                size += len(ids) // 4
        if keys:
            yield shard()

    parts, _ = dealt(docs.select("doc_id", "text"))
    parts.select("doc_id", "text", TEXT_HASH, PART).sortWithinPartitions(PART, F.col("doc_id").asc_nulls_first(), TEXT_HASH, F.col("text").asc_nulls_first()).mapInArrow(run, SHARD).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a written table: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and ids if asked for.

    Shards' first places are running sums over one row a shard.
    """
    files = spark.read.schema(SHARD).parquet(path)
    sizes = files.select("shard", "piece", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.select("shard", "piece", "before")
    if files.count() <= SMALL:  # a row for each shard, a few bytes
        sizes = F.broadcast(sizes)
    rows = files.select("shard", "piece", "n_docs", "doc_ids", "data").join(sizes, ["shard", "piece"])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, n = Shard(row["data"]), row["n_docs"]
                raw = zstandard.decompress(row["doc_ids"])
                known, keys = np.frombuffer(raw, bool, n), np.frombuffer(raw, "<i8", n, n)
                ids, bounds = shard.all().astype("<u4", copy=False), np.append(shard.starts, shard.size).astype(np.int64)
                each = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [pa.array(keys, pa.int64(), mask=~known), pa.array(bounds[:-1] + row["before"]), pa.array(np.diff(bounds)), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([x.tobytes() for x in each], pa.binary())] if with_ids else []), ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return rows.mapInArrow(run, schema)


def target(spark: SparkSession) -> str:
    """A new place for a table of ids in the shared folder; it goes when the driver's process ends."""
    return place(spark, "ids")
