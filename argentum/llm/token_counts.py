"""Numbers of tokens by a byte-level BPE vocabulary, without ids (operator 12).

A text is cut into chunks that don't depend on each other (module chunks), a chunk into pre-tokens by the
vocabulary's pattern. The symbols of a pre-token are a linked list of bytes; a heap holds the adjacent pairs that
have a merge, and the pair of lowest rank is popped (the leftmost of equals) and merged until none is left. A
pre-token has as many tokens as it has bytes less merges: nothing is put into an array of ids. Counts of
pre-tokens and chunks are cached in each worker.

Strings of added tokens inside a text are one token each, as is the library's default; what stands between them
is treated as texts of their own.

Nulls and empty texts have no tokens. Any length is accepted; a batch of rows is the only thing held. Repeated rows
give repeated results, an empty table gives no row, columns besides doc_id and text are left out. doc_id may be null.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.chunks import CACHE, LONG, chunks

#: Fixed value: the pattern that byte-level vocabularies of this kind are made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
#: Bits of a symbol's number in a packed pair.
BITS = 20


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Kept(dict):
    """Results of a function by its text, in two generations: what is asked for again moves from the old one to the new one."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> int:
        n = self.old.get(text)
        if n is None:
            n = self.make(text)
        if len(text) <= LONG:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[text] = n
        return n


class TokenCounter:
    """Counts tokens by the merges of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, names = file["model"], byte_names()
        if file["normalizer"] or model["type"] != "BPE" or file["pre_tokenizer"].get("add_prefix_space") or model["ignore_merges"]:
            raise ValueError("a byte-level BPE vocabulary without normaliser and prefix is needed")
        vocab = model["vocab"]
        self.symbols = [vocab[c] for c in names]
        self.merges = {vocab[a] << BITS | vocab[b]: rank << BITS | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        added = [t["content"] for t in file["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError("added tokens that depend on what is around them aren't known here")
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pretokens = regex.compile(PATTERN).findall
        self.pieces = Kept(lambda piece: self.merged(piece.encode()))
        self.parts = Kept(lambda part: sum(map(self.pieces.__getitem__, self.pretokens(part))))

    def merged(self, piece: bytes) -> int:
        """Tokens of one pre-token: symbols less merges."""
        n, merges = len(piece), self.merges
        symbol = [self.symbols[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(to, i) for i in range(n - 1) if (to := merges.get(symbol[i] << BITS | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        left, mask = n, (1 << BITS) - 1
        while heap:
            to, i = heapq.heappop(heap)
            # What was pushed before one of the two symbols changed is no longer there.
            if symbol[i] < 0 or (j := after[i]) >= n or merges.get(symbol[i] << BITS | symbol[j]) != to:
                continue
            symbol[i], symbol[j] = to & mask, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (to := merges.get(symbol[i] << BITS | symbol[k])) is not None:
                    heapq.heappush(heap, (to, i))
            h = before[i]
            if h >= 0 and (to := merges.get(symbol[h] << BITS | symbol[i])) is not None:
                heapq.heappush(heap, (to, h))
        return left

    def count(self, text: str) -> int:
        """Tokens of a text."""
        n, texts = 0, [text]
        if self.added and self.added.search(text):
            texts = self.added.split(text)
            n = len(texts) - 1
        get = self.parts.__getitem__
        return n + sum(sum(map(get, chunks(t))) for t in texts)


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter for each vocabulary and worker."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row: a map over the scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
