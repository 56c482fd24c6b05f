"""Fingerprints against a plain restatement with the same hash function."""

import random
import re

import regex
import xxhash

from argentum.llm import syncmers
from argentum.llm.session import ship
from tests.llm import brute
from tests.llm.data import corner_docs, frame

SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
MASK = (1 << 64) - 1


def h(*values):
    """Spark's xxhash64: 42 as the first seed, each value's hash as the next one's."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & MASK).to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def prints(text, k=syncmers.K, s=syncmers.S):
    """The least hashes of k-mers whose least s-mer is the first or the last one."""
    w = [x for x in re.split(r"[\x09-\x0D ]+", (text or "").strip(" \t\n\x0b\x0c\r")) if x]
    w = [y for x in w for y in regex.findall(rf"[{SCRIPTS}]|[^{SCRIPTS}]+", x)]
    w = [y for x in w for y in (x if len(x) > syncmers.LONG else [x])]
    if 0 < len(w) < k:
        w = list(" ".join(w))
    found = set()
    for i in range(len(w) - k + 1):
        small = [signed(h(*w[i + j : i + j + s])) for j in range(k - s + 1)]
        if min(small) in (small[0], small[-1]):
            found.add(h(*[small[j] for j in sorted({*range(0, len(small), s), len(small) - 1})]))
    if not found and w:
        found = {h(" ".join(w))}
    return sorted(x >> 64 - 4 * syncmers.DIGITS for x in found)[: syncmers.SIZE]


def alike(a, b):
    both = sorted({*a, *b})[: syncmers.SIZE]
    return len({*a} & {*b} & {*both}) / len(both) if both else 1.0


def text_of(hashes):
    return "".join(f"{x:0{syncmers.DIGITS}x}" for x in hashes)


def test_fingerprints_against_a_plain_restatement(spark):
    ship(spark)
    docs = [*corner_docs(), (80, "漢字だけの文は空白なしで続く" * 30), (81, "one two three"), (82, "1234"), (83, "a b c d e f"), (84, "mixed 漢字とカナ text ไทย and x漢y " * 9), (85, "z" * 33 + " one " + "q" * 32)]
    texts = [t or "" for _, t in brute.by_text(docs)]
    want = []
    for (key, _), text, after in zip(brute.by_text(docs), texts, texts[1:] + texts[:1], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, n = prints(text), prints(edited), prints(after)
        want.append((str(key), len(text), text_of(a), text_of(b), round(alike(a, b), 9), round(alike(a, n), 9)))
    got = [(str(r["doc_id"]), r["n_chars"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in syncmers.with_edited(frame(spark, docs)).collect()]
    assert sorted(got) == sorted(want)


def test_texts_without_blanks_stay_alike(spark):
    ship(spark)
    rng = random.Random(1)  # a quadratic sequence, tried first, reads nearly the same backwards
    docs = [(i, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(800))) for i in (1, 2)]
    got = {r["doc_id"]: r for r in syncmers.with_edited(frame(spark, docs)).collect()}
    assert got[1]["near_edited"] > 0.4 and got[1]["near_next"] < 0.1


def test_lines_without_blanks_stay_alike(spark):
    """Texts of several long lines: words are lines there."""
    ship(spark)
    rng, docs = random.Random(2), []
    for n in (5, 6, 8, 12, 20):
        for low, high in ((0x4E00, 0x5E00), (0x61, 0x7B)):
            docs += [(1000 * n + low + i, "\n".join("".join(chr(rng.randrange(low, high)) for _ in range(50)) for _ in range(n))) for i in range(2)]
    docs.sort()
    got = {r["doc_id"]: r for r in syncmers.with_edited(frame(spark, docs)).collect()}
    assert min(r["near_edited"] for r in got.values()) > 0.4 and max(r["near_next"] for r in got.values()) < 0.2


def test_fingerprints_alone(spark):
    ship(spark)
    got = {(str(r["doc_id"]), r["n_chars"], r["fingerprint"]) for r in syncmers.fingerprints(frame(spark, corner_docs())).collect()}
    assert got == {(str(k), len(t or ""), text_of(prints(t))) for k, t in corner_docs()}
