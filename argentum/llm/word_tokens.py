"""Ids of whole texts by a tokenizers file whose pre-tokens never hold white space.

Such a tokenizer treats the pieces between blanks apart from each other, so ids of
pieces are cached and only new pieces go to the library, many at once.
"""

from __future__ import annotations

from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from argentum.llm.words import Words

#: Pieces in a generation of the cache.
CACHE = 250_000
LONG = 64
#: New pieces that go to the library at once.
TOGETHER = 512
#: Marks that the pre-tokenizer takes together as a run; without those of contractions and special tokens.
_MARK = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;=?@[]^_{}~", np.uint8))
MARKS = 16
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_held: dict[str, "Pieces"] = {}


def lowered(text: str) -> str:
    """The text in lower case where the library's own steps make the same of both, else unchanged."""
    if "<|" in text:  # special tokens are found by case
        return text
    if text.isascii():
        return text.lower()
    try:  # Latin-1 is normalised, in lower case too
        text.encode("latin-1")
        return text.lower()
    except UnicodeEncodeError:
        pass
    if "\u03a3" in text or "\u0130" in text or not is_normalized("NFC", text):
        return text
    low = text.lower()
    return low if is_normalized("NFC", low) else text


class Pieces:
    """Encodes lists of texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)  # ids that end a run of letters
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}  # of pieces in UTF-8
        self.old: dict[bytes, bytes] = {}

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only make one run each, so that many can be encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self._any(words)
        raw, a, out = ids.tobytes(), 0, []
        for b in ends:
            out.append(raw[a:b])
            a = b
        return out

    def _any(self, some: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of new pieces; short ones stay in the cache."""
        texts = [p.decode() for p in new]
        out: list[bytes] = [b""] * len(new)
        word = [p.isalpha() and len(p) <= LONG for p in texts]
        for make, kind in ((self._letters, True), (self._any, False)):
            some = [i for i, w in enumerate(word) if w == kind]
            for a in range(0, len(some), TOGETHER):
                own = some[a : a + TOGETHER]
                for i, ids in zip(own, make([texts[i] for i in own]), strict=True):
                    out[i] = ids
        self.cache.update((p, ids) for p, t, ids in zip(new, texts, out, strict=True) if len(t) <= LONG)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: every distinct piece of the batch is looked up once, then ids are gathered."""
        words = Words(pa.array([lowered(t) for t in texts], pa.large_string()))
        if not len(words):
            return [b""] * len(texts)
        # Marks after a letter or digit, at a piece's end, are a run of their own.
        size, marks, some = words.end - words.start, np.zeros(len(words), np.int64), np.arange(len(words))
        for j in range(1, MARKS + 1):
            some = some[size[some] > j]
            some = some[_MARK[words.data[words.end[some] - j]]]
            marks[some] = j
        cuts = np.flatnonzero(marks)
        at = words.end[cuts] - marks[cuts]
        own = _ALNUM[words.data[at - 1]]
        cuts, at = cuts[own], at[own]
        words.start = np.insert(words.start, cuts + 1, at)
        words.end = np.insert(words.end, cuts, at)
        words.of = np.searchsorted(words.start, words.bounds)
        cache, raw = self.cache, words.data.tobytes()
        first, inverse = words.numbers()
        distinct = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
        # Two generations: what is looked up again moves from the old one to the new one.
        if len(cache) > CACHE:
            self.old, self.cache = cache, {}
            cache = self.cache
        ids = list(map(cache.get, distinct))
        missing = [i for i, x in enumerate(ids) if x is None]
        new = []
        for i in missing:
            x = self.old.get(distinct[i])
            if x is None:
                new.append(i)
            else:
                cache[distinct[i]] = ids[i] = x
        for i, x in zip(new, self._learn([distinct[i] for i in new]), strict=True):
            ids[i] = x
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        begin = np.cumsum(size) - size
        n = size[inverse]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.arange(ends[-1]) + np.repeat(begin[inverse] - ends[:-1], n)].tobytes()
        bounds = (4 * ends[words.of]).tolist()
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def forget(path: str) -> None:
    """Drops a worker's cache, as it may go on with other work."""
    if path in _held:
        _held[path].cache, _held[path].old = {}, {}


def pieces(path: str) -> Pieces:
    """One encoder for each file and worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]
