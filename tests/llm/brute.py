"""Plain restatements of what the operators return, for small inputs."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def signed(text):
    """Spark's xxhash64 of a text."""
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (h >> 63 << 64)


def order(docs):
    """(doc_id, text) by doc_id, null first, then the text's hash, then text."""
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, signed(d[1]), d[1] is not None, d[1] or ""))


def by_text(docs):
    """(doc_id, text) by doc_id, null first, then text, null as empty."""
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))


def bytes_left(docs, length=100):
    seen, out = set(), []
    for key, text in order(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def words_left(docs, window=13):
    first, out = {}, []
    rows = order(docs)
    for key, text in rows:
        w = WORD.findall(text or "")
        rank = (key is not None, key or 0)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), rank)
    for key, text in rows:
        w = WORD.findall(text or "")
        rank, gone = (key is not None, key or 0), [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < rank:
                gone[p : p + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()
        out.append((key, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return out


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_groups(docs, percent=75):
    """doc_id -> component; docs without ids left out."""
    rows = [(k, shingles(t)) for k, t in docs if k is not None]
    head = {k: k for k, _ in rows}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                p, q = find(a), find(b)
                head[max(p, q)] = min(p, q)
    return {k: find(k) for k in head}
