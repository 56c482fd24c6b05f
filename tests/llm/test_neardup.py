"""Near-duplicates: doc_ids that repeat, buckets with several components, and recall over all pairs."""

import random
from collections import Counter

from argentum.llm import neardup, stages
from argentum.llm.session import ship
from tests.llm import brute
from tests.llm.data import corner_docs, frame, prose


def groups(docs):
    """(doc_id, n_shingles, component_id, kept) of each row; rows of one doc_id are one document."""
    links = {}
    sets = [(k, brute.shingles(t)) for k, t in docs]
    head = {k: k for k, _ in docs}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if a is not None and b is not None and both and 100 * both >= 75 * (len(s) + len(t) - both):
                links[a, b] = True
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return Counter((k, len(s), None if k is None else find(k) if s else k, k is None or not s or find(k) == k) for k, s in sets)


def found(spark, docs, parts=2):
    ship(spark)
    got = neardup.near_duplicates(frame(spark, docs).repartition(parts)).collect()
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)


def edited(rng, text, n=1):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
    return " ".join(w)


def test_one_document_with_two_texts(spark):
    rng = random.Random(1)
    a, b = prose(rng, 120), prose(rng, 120)
    docs = [(1, a), (1, b), (2, edited(rng, a)), (3, edited(rng, b))]
    assert found(spark, docs) == groups(docs) and {k[2] for k in groups(docs)} == {1}


def test_repeated_ids_and_corner_cases(spark):
    docs = corner_docs()
    rng = random.Random(2)
    texts = [prose(rng, 80) for _ in range(6)]
    docs += [(200, t) for t in texts] + [(200, texts[0]), (200, ""), (201, edited(rng, texts[3])), (202, texts[5]), (199, texts[5])]
    got = found(spark, docs)
    assert got == groups(docs) and sum(got.values()) == len(docs)
    left = Counter(r["doc_id"] for r in stages.drop_near_duplicates(spark, frame(spark, docs), "").collect())
    gone = {k for k, _, _, kept in groups(docs) if not kept}
    assert left == Counter(k for k, _ in docs if k not in gone)


def test_large_buckets_of_several_components(spark, monkeypatch):
    """Blocks far smaller than a bucket; chains, so that components join over many members."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(3)
    docs, text = [], prose(rng, 100)
    for i in range(60):  # each near to the next, the first not to the last
        docs.append((i, text))
        text = edited(rng, text, 2)
    base = prose(rng, 100)
    docs += [(100 + i, edited(rng, base, rng.randrange(0, 6))) for i in range(60)]
    assert found(spark, docs) == groups(docs)


def test_recall_over_all_pairs(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()]
    want = brute.near_groups(docs)
    ship(spark)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")).collect()}
    assert got == want and sum(k != v for k, v in want.items()) > 50
