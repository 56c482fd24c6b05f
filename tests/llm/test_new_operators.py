"""Operators 11 to 13 against plain restatements and the libraries themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import public_tokenizers
import pytest

from argentum.llm import alignment, conversations, token_counts
from argentum.llm import queries as Q
from argentum.llm.session import ship
from tests.llm.data import corner_docs, frame

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, roles): the least suffix from each row and state, letters compared as they are."""

    @cache
    def rest(i, state, inserted):
        ways = []
        if i == len(rows) and state in (0, 3):
            ways.append((0, "", ()))
        if inserted < 3:
            for to, role in ((NEXT[state].get(r), r) for r in "ua"):
                if to:
                    c, s, o = rest(i, to, inserted + 1)
                    ways.append((c + 3, "I" + s, ((role, None), *o)))
        if i < len(rows):
            c, s, o = rest(i + 1, state, 0)
            ways.append((c + 4, "D" + s, o))
            if found[i] not in ("blank", "duplicate"):
                extra = 3 * (found[i] == "truncated")
                initial = rows[i][0][:1]
                if initial in NEXT[state]:
                    c, s, o = rest(i + 1, NEXT[state][initial], 0)
                    ways.append((c + extra, "K" + s, ((rows[i][0], i), *o)))
                for r in "ua":
                    if r in NEXT[state]:
                        c, s, o = rest(i + 1, NEXT[state][r], 0)
                        ways.append((c + 3 + extra, "R" + s, ((r, i), *o)))
        return min(ways, default=(10**9, "", ()), key=lambda w: w[:2])

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in NEXT:
            rest(i, state, 0)
    return rest(0, 0, 0)


def repaired(rows):
    """Rows (turn, role, text) of one conversation in order -> what the operator returns but conv_id."""
    turns = {t for t, _, _ in rows if t is not None}
    two = [r[1:] for r in rows]
    found = faults(two)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(two, two[1:], strict=False))
    cost, audit, out = cheapest(tuple(two), tuple(found))
    lines = [f"{role if i is not None and role == two[i][0] else {'u': 'user', 'a': 'assistant'}[role]}:{'' if i is None else two[i][1]}" for role, i in out]
    n = Counter(found)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    """Rows (conv, turn, role, text) -> conv -> rows after damage."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += []
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for conv, own in out.items():
        out[conv] = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    return out


def conversation_rows(seed, n):
    rng, out = random.Random(seed), []
    texts = ["Yes.", "No", "", " \t", "Why?", "Again!", "so \n", "end. ", None, "é。", "U+0085\x85", "x.\x1c"]
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(12)):
            for _ in range(1 + (rng.random() < 0.1)):
                role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "sage", "unknown"])
                out.append((conv, rng.choice([turn, turn, turn, turn + 300, None]), role, rng.choice(texts)))
        out.append((conv, 3, "user", "same."))
        if rng.random() < 0.3:
            out.append((conv, 3, "user", "same."))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_query(spark, rows):
    df = ship(spark).createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int")
    return {r[0]: tuple(r[1:]) for r in conversations.repair(conversations.damage(df), "live", "copies").select(*COLUMNS).collect()}


def test_repair_equals_plain_search(spark):
    rows = conversation_rows(5, 150)
    rows += [(900, t, "user" if t % 2 else "assistant", f"t{t % 40}.") for t in range(700)]  # several pieces
    assert repair_query(spark, rows) == {c: repaired(own) for c, own in damaged(rows).items()}


def test_repair_without_rows(spark):
    assert repair_query(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repair_query(spark, [(gone, 0, "user", "x")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repair_of_any_rows(spark):
    """Without live and copies, text ids, turns that no long holds the gaps of."""
    df = spark.createDataFrame([("k", -(2**63), "user", "a."), ("k", 2**63 - 1, "assistant", "b."), ("l", 1, "system", "s")], "conv_id string, turn long, role string, text string")
    got = {r.conv_id: r for r in conversations.repair(df).collect()}
    assert (got["k"].gaps, got["k"].audit, got["k"].cost) == (None, "KK", 0)
    assert (got["l"].audit, got["l"].cost, got["l"].n_repaired) == ("D", 4, 0)


def test_trie_shares_prefixes():
    trie, rng = conversations.Trie(), random.Random(1)
    some = sorted({"".join(rng.choice("bcfg") for _ in range(rng.randrange(9))) for _ in range(500)})
    for s in some:
        assert trie.answer(s) == conversations.Trie().answer(s)
    assert trie.layers == len({s[:i] for s in some for i in range(1, len(s) + 1)})


def test_conversations_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in Q.op11_conversation_repair(spark, sf).select(*COLUMNS).collect()} == {c: repaired(own) for c, own in damaged(rows).items()}


TEXTS = ["", None, " ", "  ", "a", " a", "a  b", "don't we'll I'VE  it's\n\n  ok '' 's 12 3.5 ñandú", "a\n \nb", "a \nb\n  c", "x" * 3000, "ab" * 2000 + " end", "é漢字🙂 " * 60, "tab\t\tx  y　 z", "\x1c a \x1fb\x85c", "a<|endoftext|>b <|endoftext|> c<|endoftext|><|endoftext|>", "<|endoftext|>", "  <|endoftext|>  x", "<s>a</s> <unk> [x] <0x41>", "a▁b ▁c", "\x00 nul\x00", "é ́x", "漢字" * 900, "\r\n\r\n  x\r\n", "a " * 700 + "  ", "​ ​"]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A_PATH)
    rows = [*enumerate(TEXTS), *[(100 + (k or 0), t) for k, t in corner_docs()]]
    got = token_counts.token_counts(frame(spark, rows), A_PATH, 512).collect()
    want = sorted((k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for k, t in rows)
    assert sorted(map(tuple, got)) == want
    assert token_counts.token_counts(frame(spark, []), A_PATH).collect() == []
    assert token_counts.token_counts(frame(spark, [(None, "a b"), (None, "a b")]), A_PATH).collect() == [(None, 3, 2, False)] * 2


def test_counts_of_documents(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A_PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: len(library.encode(d.text, add_special_tokens=False).ids) for d in docs}
    assert {r.doc_id: r.n_tokens for r in Q.op12_token_counts(spark, sf).collect()} == want


def plain_alignment(rows):
    """One position at a time, pairs counted with dictionaries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B_PATH)
    byte = {c: i for i, c in enumerate(token_counts.byte_names())}
    links, out = [], []
    for key, text in rows:
        x, y = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        xs = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([i - b.piece_to_id("<0x00>")]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(xs) != f" {text}".encode() or b"".join(ys) != f" {text}".encode():
            links.append([])
            out.append((key, 0, 0, 0, 0, ""))
            continue
        xe, ye = ([sum(map(len, s[: i + 1])) for i in range(len(s))] for s in (xs, ys)) if len(x) < 300 else (_ends(xs), _ends(ys))
        both = set(xe) & set(ye)
        ends = sorted(both)
        parts, i, j = [], 0, 0
        for e in ends:
            ii, jj = xe.index(e) + 1, ye.index(e) + 1
            parts.append(f"{','.join(map(str, x[i:ii]))}|{','.join(map(str, y[j:jj]))}")
            i, j = ii, jj
        links.append([(x[i], y[j]) for i, e in enumerate(xe) for j in ([ye.index(e)] if e in both else [])])
        out.append((key, len(x), len(y), len(ends), len(links[-1]), hashlib.sha256(";".join(parts).encode()).hexdigest()))
    counts = Counter(p for own in links for p in own)
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted((*o[:5], sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own), o[5]) for o, own in zip(out, links, strict=True))


def _ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


@pytest.mark.parametrize("most", [alignment.MOST, 40, 0])
def test_alignment_equals_plain_positions(spark, most):
    rows = [*enumerate(TEXTS), *[(100 + (k or 0), t) for k, t in corner_docs()]]
    got = alignment.align_documents(frame(ship(spark), rows), A_PATH, B_PATH, most)
    assert sorted(map(tuple, got.collect())) == plain_alignment(rows)


def test_alignment_of_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    got = alignment.align_documents(frame(spark, rows), A_PATH, B_PATH)
    assert sorted(map(tuple, got.collect())) == plain_alignment(rows)
    assert alignment.align_documents(frame(spark, []), A_PATH, B_PATH).collect() == []


def test_caches_that_overflow(monkeypatch, sf):
    """Results stay the same when chunks are forgotten, kept or come again."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()[:80] + TEXTS
    aligner = alignment.Aligner(A_PATH, B_PATH)
    want = [(*r[:4], r[4].tolist()) for r in aligner.align(texts)]
    monkeypatch.setattr(alignment, "CACHE", 900)
    monkeypatch.setattr(token_counts, "CACHE", 50)
    small, got, kept = alignment.Aligner(A_PATH, B_PATH), [], set()
    for a in range(0, len(texts), 3):
        got += [(*r[:4], r[4].tolist()) for r in small.align(texts[a : a + 3])]
        kept.add(len(small.known) > 0 and min(small.used.shape[0], len(small.texts)) == len(small.known) == len(small.of) - 1)
    assert got == want and kept == {True}
    counter, library = token_counts.TokenCounter(A_PATH), Tokenizer.from_file(A_PATH)
    for t in texts:
        assert counter.count(t or "") == len(library.encode(t or "", add_special_tokens=False).ids)
        assert len(counter.pieces) <= 50 and len(counter.parts) <= 50
