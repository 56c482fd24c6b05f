"""Byte-level BPE encoding and decoding (operator 5).

Texts become arrays of code points; each code point has a class; boundaries of
pre-tokens follow from neighbouring classes and from the prefix composition of
transition functions (an associative scan, block by block), without a regular
expression. The slices feed a cache of merged byte pairs. Offsets of pre-tokens
are kept and used to decode.

Nulls count as empty texts: no tokens. Any code point is accepted, texts may be
of any length, repeated rows give repeated results, an empty table gives no row.
Extra columns are left out of the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LETTER, NUMBER, SPACE, OTHER, BLANK, QUOTE = range(6)

#: Code points with the White_Space property.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that stand alone after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: States of the scan: no ending pending, or so many of its letters to come, or just over.
IDLE, TWO, ONE, OVER = range(4)
#: Separates slices on the way to str.split; a lone surrogate is in no valid text.
MARK = "\ud800"
CACHE = 250_000
SMALL = 64  # longest piece that goes to the cache


def class_table() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE)] = SPACE
    table[32] = BLANK
    table[39] = QUOTE
    return table


def _pack(maps: tuple[int, int, int, int]) -> int:
    return sum(to << 2 * state for state, to in enumerate(maps))


#: A function on the four states takes 8 bits; COMPOSE[f << 8 | g] is g after f.
_F = np.arange(256, dtype=np.uint16)
_G = np.stack([_F >> 2 * s & 3 for s in range(4)])
COMPOSE = np.zeros((256, 256), np.uint8)
for _s in range(4):
    COMPOSE |= (_G[:, None, :][_G[_s][:, None], 0, _F[None, :]] << 2 * _s).astype(np.uint8)
COMPOSE = COMPOSE.reshape(-1)

STEP_LETTER = _pack((IDLE, ONE, OVER, IDLE))
STEP_RESET = _pack((IDLE,) * 4)
STEP_SHORT = _pack((ONE,) * 4)
STEP_LONG = _pack((TWO,) * 4)


def scan(steps: np.ndarray, block: int = 128) -> np.ndarray:
    """Prefix compositions of functions: blocks side by side, then over the blocks' totals."""
    n = len(steps)
    if n <= block:
        out, f = np.empty(n, np.uint8), _pack((0, 1, 2, 3))
        for i in range(n):
            out[i] = f = COMPOSE[f << 8 | int(steps[i])]
        return out
    rows = -(-n // block)
    padded = np.full(rows * block, _pack((0, 1, 2, 3)), np.uint8)
    padded[:n] = steps
    grid = np.ascontiguousarray(padded.reshape(rows, block).T)
    for j in range(1, block):
        grid[j] = COMPOSE[(grid[j - 1].astype(np.uint16) << 8) | grid[j]]
    before = np.empty(rows, np.uint8)
    before[0] = _pack((0, 1, 2, 3))
    before[1:] = scan(grid[-1], block)[:-1]
    grid = COMPOSE[(before.astype(np.uint16) << 8)[None, :] | grid]
    return grid.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, edges: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. points: code points of texts in a row; edges: where texts begin."""
    n = len(points)
    kind = table[points]
    begin = np.zeros(n + 1, bool)  # of a text
    begin[edges] = True
    begin[n] = True
    white = (kind == SPACE) | (kind == BLANK)
    group = kind.copy()
    group[kind == QUOTE] = OTHER
    group[white] = SPACE
    last_white = white.copy()  # white space before something else of the same text
    last_white[:-1] &= ~white[1:]
    last_white[-1:] = False
    last_white &= ~begin[1:]
    joins = last_white & (kind == BLANK)  # this blank begins the next token
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = group[1:] != group[:-1]
    start |= last_white  # one token for all but the last white space
    start[1:] &= ~joins[:-1]
    start |= begin[:-1]
    # endings after an apostrophe that begins a token: not in a run of others, not after a joining blank
    quote = kind == QUOTE
    if quote.any():
        at = np.flatnonzero(quote & start)
        ahead = np.full((2, len(at)), 0, np.uint32)
        for k in (1, 2):
            i = at + k
            ok = i < n
            ok[ok] = ~begin[i[ok]]
            if k == 2:
                ok &= ahead[0] > 0
            ahead[k - 1, ok] = points[i[ok]]
        steps = np.full(n, STEP_RESET, np.uint8)
        steps[kind == LETTER] = STEP_LETTER
        short = np.isin(ahead[0], [ord(e) for e in ENDINGS if len(e) == 1])
        long = np.isin(ahead[0].astype(np.uint64) << np.uint64(32) | ahead[1], [ord(e[0]) << 32 | ord(e[1]) for e in ENDINGS if len(e) == 2])
        steps[at[long]] = STEP_LONG
        steps[at[short]] = STEP_SHORT
        steps[begin[:-1] & (steps == STEP_LETTER)] = STEP_RESET
        state = scan(steps) & 3  # from IDLE, after each code point
        previous = np.empty(n, np.uint8)
        previous[0], previous[1:] = IDLE, state[:-1]
        letter = steps == STEP_LETTER
        start[letter & ((previous == TWO) | (previous == ONE))] = False
        start[letter & (previous == OVER)] = True
    return np.flatnonzero(start)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges pairs of lowest rank first, leftmost first among equals; n log n in the length."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class ByteBPE:
    """Encoder and decoder of one vocabulary; ranks: a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.table = class_table()
        self.cache: dict[str, bytes] = {}
        words = [b""] * (1 + max(self.ranks.values(), default=-1))
        for token, rank in self.ranks.items():
            words[rank] = token
        self.words = words

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token, as little-endian unsigned 32-bit integers."""
        ids = np.array(merge(text.encode(), self.ranks), "<u4").tobytes()
        if len(text) <= SMALL:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[text] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
        """For each text its ids and the offsets of its pre-tokens, in code points."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(points):
            return [b""] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        bounds = np.cumsum([0, *map(len, texts)])
        full = bounds[:-1][np.diff(bounds) > 0]
        starts = boundaries(points, full, self.table)
        spread = np.insert(points, starts[1:], ord(MARK))
        pieces = spread.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split(MARK)
        get, make = self.cache.get, self.piece
        ids = [get(p) or make(p) for p in pieces]
        of = np.searchsorted(starts, bounds)
        return [b"".join(ids[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)], [starts[a:b] - c for a, b, c in zip(of[:-1], of[1:], bounds, strict=False)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids."""
        words = self.words
        return b"".join([words[i] for i in np.frombuffer(ids, "<u4").tolist()])


SCHEMA = "doc_id long, n_tokens long, n_pretokens long, ids binary, offsets binary, decoded binary"
_encoders: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """One encoder for each vocabulary and worker."""
    if path not in _encoders:
        _encoders[path] = ByteBPE(path)
    return _encoders[path]


def gathered(batches: Iterator[pa.RecordBatch], chars: int = 8 << 20) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts (null: empty) of rows, about so many characters at a time, whatever the batches' sizes.

    Text is column 1; a key is column 0, or a tuple of all other columns.
    """
    keys, texts, size = [], [], 0
    for batch in batches:
        other = [c.to_pylist() for i, c in enumerate(batch.columns) if i != 1]
        for key, text in zip(other[0] if len(other) == 1 else zip(*other, strict=True), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= chars:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def encode_documents(docs: DataFrame, vocabulary: str, digest: bool = False) -> DataFrame:
    """doc_id and text to ids (little-endian), offsets of pre-tokens and the bytes decoded from the ids.

    digest: the ids and the decoded bytes as SHA-256 instead, so that the large columns
    never leave the workers. A map over the scan: no shuffle; a lost task is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for keys, texts in gathered(batches, 4 << 20):
            ids, offsets = bpe.encode(texts)
            head = [pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            back = (bpe.decode(x) for x in ids)
            if digest:
                yield pa.RecordBatch.from_arrays([*head, pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*head, pa.array([len(o) for o in offsets], pa.int64()), pa.array(ids, pa.binary()), pa.array([o.astype("<u4").tobytes() for o in offsets], pa.binary()), pa.array(list(back), pa.binary())], ["doc_id", "n_tokens", "n_pretokens", "ids", "offsets", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else SCHEMA)
