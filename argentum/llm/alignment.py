"""Alignment of two tokenizers over the same texts (operator 13).

Tokenizer A is a byte-level BPE file, B a sentencepiece model that puts a blank before a text; A gets the blank too.
Texts are cut into chunks that neither tokenizer looks across (module chunks), each with its leading blank.

For a chunk, tokens of A and B are the nodes of a bipartite graph, joined where their byte ranges overlap. Union-find
over all new chunks at once gives its connected components, which are exactly the smallest groups of whole tokens of
both sides with the same bytes. A component's members expand to its links: the pairs whose ranges end together.

1. A map gives each document its counts, the digest of its groups, and its linked pairs with how often each occurs.
   The result is written, so no text is read twice.
2. Pairs are counted over the corpus: summed in each task, then by key. The highest count of each B id is joined.
3. Counts of at most `most` pairs of highest count go to the documents as arrays. Pairs below are joined by a shuffle.

Texts that are null or empty, or whose tokens don't give their bytes back, have no tokens: zeros and ''. Any length
is accepted. Each row is returned once and counts once, repeated rows repeatedly; an empty table gives no row;
columns besides doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.byte_bpe import gathered
from argentum.llm.chunks import CACHE, LONG, chunks
from argentum.llm.session import cut
from argentum.llm.token_counts import byte_names

#: Pairs whose counts go to every task, about 17 bytes each.
MOST = 1 << 18
#: Chunks that go to A's library as one text.
TOGETHER = 256
#: Different pairs that a task holds while it counts.
HELD = 1 << 20


def union(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over edges (u, v) of n nodes: the least node of each node's component."""
    head = np.arange(n)
    while True:
        a, b = head[u], head[v]
        apart = a != b
        if not apart.any():
            return head
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(head, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := head[head], head):
            head = up


def groups(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component (least token of A in it) of each token of A and of B; both cover the same bytes, given by their ends."""
    a_start, b_start = (np.concatenate([[0], x[:-1]]) for x in (a_end, b_end))
    cuts = np.union1d(a_start, b_start)  # from each cut to the next, one token of either side
    u, v = np.searchsorted(a_end, cuts, "right"), np.searchsorted(b_end, cuts, "right")
    head = union(len(a_end) + len(b_end), u, len(a_end) + v)
    return head[: len(a_end)], head[len(a_end) :]


class Aligner:
    """Aligned chunks of two vocabularies: for each known chunk its numbers of tokens and groups, its links and its groups as text."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte = {c: i for i, c in enumerate(byte_names())}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        b = self.b
        self.b_size = b.get_piece_size()
        pieces = [b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces across blanks: chunks would not be apart")

        size = max(len(self.a_bytes), self.b_size)
        self.a_size, self.b_len = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        #: An id and what stands after it: within a side, between sides, after a group, after a chunk.
        self.written = [f"{i}{mark}" for i in range(size) for mark in (",", "|", ";", "\n")]
        self.forget()

    def forget(self) -> None:
        """Keeps the chunks that were used several times, if they are few enough."""
        often = np.flatnonzero(self.used > 1) if hasattr(self, "used") else np.zeros(0, np.int64)
        if not 0 < len(often) <= CACHE // 2:
            self.known: dict[str, int] = {}
            self.texts: list[str | None] = []  # None: bytes don't come back
            self.counts, self.used = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
            self.keys, self.of = np.zeros(0, np.uint32), np.zeros(1, np.int64)
            self.size = 0
            return
        to = np.full(len(self.used), -1)
        to[often] = np.arange(len(often))
        to = to.tolist()
        self.known = {c: to[i] for c, i in self.known.items() if to[i] >= 0}
        self.texts = [self.texts[i] for i in often.tolist()]
        self.keys, self.of = self.links(often)
        self.counts, self.used = self.counts[often], np.zeros(len(often), np.int64)
        self.size = sum(map(len, self.known))

    def links(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links' keys of known chunks, one after another, and their n+1 offsets."""
        n = self.of[at + 1] - self.of[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.keys[np.arange(ends[-1]) + np.repeat(self.of[at] - ends[:-1], n)], ends

    def a_ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of chunks, and how many each has. Chunks after which nothing changes are encoded as one text, a few hundred at a time."""
        plain = [c[-1] > " " and not c[-1].isspace() and c[:2] != "  " and not c[1:2].isspace() for c in new]
        raw = list(map(len, map(str.encode, new)))
        out, count = [], np.empty(len(new), np.int64)
        for a in range(0, len(new), TOGETHER):
            b = min(a + TOGETHER, len(new))
            if all(plain[a:b]):
                ids = np.array(self.a.encode_batch_fast(["".join(new[a:b])], add_special_tokens=False)[0].ids, np.int64)
                ends, at = np.cumsum(self.a_size[ids]), np.cumsum(raw[a:b])
                last = np.searchsorted(ends, at)
                if last[-1] < len(ids) and np.array_equal(ends[last], at):
                    out.append(ids)
                    count[a:b] = np.diff(last, prepend=-1)
                    continue
            each = [e.ids for e in self.a.encode_batch_fast(new[a:b], add_special_tokens=False)]
            out.append(np.fromiter(chain.from_iterable(each), np.int64))
            count[a:b] = list(map(len, each))
        return np.concatenate(out), count

    def good(self, new: list[str], ids: np.ndarray, count: np.ndarray, held: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether the bytes of each chunk come back."""
        ends = np.concatenate([[0], np.cumsum(count)])
        bytes_ = np.concatenate([[0], np.cumsum(size[ids])])
        raw = "".join(new).encode()
        if np.array_equal(np.diff(bytes_[ends]), list(map(len, map(str.encode, new)))) and b"".join(map(held.__getitem__, ids.tolist())) == raw:
            return np.ones(len(new), bool)
        return np.array([b"".join(map(held.__getitem__, ids[a:b].tolist())) == c.encode() for c, a, b in zip(new, ends[:-1], ends[1:], strict=True)])

    def learn(self, new: list[str]) -> None:
        """Aligns new chunks, all side by side."""
        if not new:
            return
        # Chunks that end in white space last: they can't be encoded together with others.
        new.sort(key=lambda c: c[-1].isspace() or c[1:2].isspace())
        a_ids, n_a = self.a_ids(new)
        each = self.b.encode([c[1:] for c in new], num_threads=1)
        b_ids, n_b = np.fromiter(chain.from_iterable(each), np.int64), np.array(list(map(len, each)))
        good = self.good(new, a_ids, n_a, self.a_bytes, self.a_size) & self.good(new, b_ids, n_b, self.b_bytes, self.b_len)
        if not good.all():
            a_ids, b_ids = a_ids[np.repeat(good, n_a)], b_ids[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        a_head, b_head = groups(np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_len[b_ids])) if len(a_ids) else (a_ids, b_ids)
        # A component's members lie side by side: its last two end together, no others do.
        a_end, b_end = (np.append(x[1:] != x[:-1], True)[: len(x)] for x in (a_head, b_head))
        a_last, b_last = np.flatnonzero(a_end), np.flatnonzero(b_end)
        keys = (a_ids[a_last] * self.b_size + b_ids[b_last]).astype(np.uint32)
        g_of = np.searchsorted(a_last, np.concatenate([[0], np.cumsum(n_a)]))
        # Groups as text, all at once: A's members, then B's, each with the mark after it.
        a_group, b_group = np.cumsum(a_end) - a_end, np.cumsum(b_end) - b_end
        code = np.empty(len(a_ids) + len(b_ids), np.int64)
        code[np.arange(len(a_ids)) + np.concatenate([[0], b_last + 1])[a_group]] = 4 * a_ids + a_end
        mark = 2 * b_end
        mark[(np.cumsum(n_b) - 1)[n_b > 0]] = 3
        code[np.arange(len(b_ids)) + (a_last + 1)[b_group]] = 4 * b_ids + mark
        lines = iter("".join(map(self.written.__getitem__, code.tolist())).split("\n"))
        first = len(self.texts)
        self.texts += [next(lines) if g else None for g in good.tolist()]
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.size += sum(map(len, new))
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, np.diff(g_of)], 1)])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.keys, self.of = np.concatenate([self.keys, keys]), np.concatenate([self.of, self.of[-1] + g_of[1:]])

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """For each text: numbers of A tokens, B tokens and groups, the groups' digest ('' without tokens), and the links' keys (A id * size of B + B id)."""
        if len(self.known) > CACHE or self.size > CACHE * LONG:
            self.forget()
        parts = [chunks(f" {t}") if t else [] for t in texts]
        self.learn(list(set().union(*parts).difference(self.known)))
        get, held = self.known.__getitem__, self.texts
        every = np.fromiter(map(get, chain.from_iterable(parts)), np.int64)
        self.used += np.bincount(every, minlength=len(self.used))
        some, flat = list(map(held.__getitem__, every.tolist())), self.counts[every]
        keys, ends = self.links(every)
        at = 0
        for p in parts:
            a, at = at, at + len(p)
            own = some[a:at]
            if not p or None in own:
                yield 0, 0, 0, "", np.zeros(0, np.uint32)
            else:
                yield *flat[a:at].sum(0).tolist(), hashlib.sha256(";".join(own).encode()).hexdigest(), keys[ends[a] : ends[at]]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for each pair of files and worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _packed(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Different keys as differences, and how often each occurs."""
    keys, n = np.unique(keys, return_counts=True)
    return np.diff(keys, prepend=np.uint32(0)).astype("<u4").tobytes(), n.astype("<u4").tobytes()


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, row in the batch) of the columns keys and times."""
    keys = [np.cumsum(np.frombuffer(x, "<u4"), dtype=np.int64) for x in batch.column("keys").to_pylist()]
    n = [np.frombuffer(x, "<u4") for x in batch.column("times").to_pylist()]
    row = np.repeat(np.arange(len(keys)), list(map(len, keys)))
    return np.concatenate(keys or [[]]).astype(np.int64), np.concatenate(n or [[]]).astype(np.int64), row


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row (different for each), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times: one map over the scan."""
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        for keys, texts in gathered(batches, 2 << 20):
            found = [(x[0], x[1], x[2], len(x[4]), x[3], *_packed(x[4])) for x in both.align(texts)]
            columns = [pa.array(range(row, row + len(keys)), pa.int64()), pa.array(keys, pa.int64())]
            columns += [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()], strict=True)]
            row += len(keys)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary")


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """key, b, n (links of the pair over all rows), best (no other pair of the same B id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, n, _ = _unpacked(batch)
            held, which = np.unique(np.concatenate([held, keys]), return_inverse=True)
            sums = np.bincount(which, np.concatenate([sums, n]), len(held)).astype(np.int64)
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], ["key", "n"])
                held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], ["key", "n"])

    sums = rows.select("keys", "times").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    sums = cut(sums.withColumn("b", F.col("key") % b_size), "pairs")
    top = sums.groupBy("b").agg(F.max("n").alias("top"))  # a row for each id of B's vocabulary at most
    return sums.join(F.broadcast(top), "b").select("key", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, most: int = MOST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row (see the module).

    most: pairs whose counts go to every task; the result is the same for any value.
    """
    b_size = aligner(a_path, b_path).b_size
    rows = cut(aligned(docs, a_path, b_path), "aligned", compression="zstd")
    pairs = cut(pair_counts(rows, b_size), "counted")
    # The least count that at most `most` pairs reach: from how many pairs have counts of one size (a few hundred rows).
    size = F.floor(F.log2("n") * 8)
    steps = sorted(((r.size, r.pairs, r.least) for r in pairs.groupBy(size.alias("size")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()), reverse=True)
    least, room = 1 << 62, most
    for _, some, low in steps:
        room -= some
        if room < 0:
            break
        least = low
    all_in = room >= 0
    known = pairs.filter(F.col("n") >= least).toArrow().sort_by("key")
    keys, counts, best = (known.column(c).to_numpy() for c in ("key", "n", "best"))

    def look(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        key, n, row = _unpacked(batch)
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        return key, n, row, at, keys[at] == key if len(keys) else np.zeros(len(key), bool)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, n, row, at, there = look(batch)
            n, row, at = n[there], row[there], at[there]
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            if len(n):
                np.add.at(sums[0], row, n * best[at])
                np.add.at(sums[1], row, n * counts[at])
            yield pa.RecordBatch.from_arrays(batch.columns[:7] + [pa.array(x) for x in sums], [*names, "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, row, _, there = look(batch)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("row").to_numpy()[row[~there]]), pa.array(key[~there]), pa.array(n[~there])], ["row", "key", "times"])

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = rows.mapInArrow(common, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if not all_in:
        links = rows.select("row", "keys", "times").mapInArrow(rare, "row long, key long, times long").join(pairs.filter(F.col("n") < least), "key")
        links = links.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        zero = F.lit(0)
        out = out.join(links, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", zero), "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero)})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
