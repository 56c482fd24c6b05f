"""The classifier against a plain restatement of its learning rule, and its figures on held-out documents."""

import math
import random

import numpy as np
import pyarrow as pa

from argentum.llm import toxicity
from argentum.llm.session import ship


def plain_ftrl(rows, alpha=1.0, beta=1.0, l1=12.0, l2=1.0, passes=4, support=3, positive=3.0):
    """FTRL-proximal with dictionaries, one coordinate at a time; None is the intercept."""
    often = {}
    for slots, _ in rows:
        for s in slots:
            often[s] = often.get(s, 0) + 1
    z, n = {}, {}

    def weight(s):
        x, limit = z.get(s, 0.0), 0.0 if s is None else l1
        if abs(x) <= limit:
            return 0.0
        return -(x - math.copysign(limit, x)) / ((beta + math.sqrt(n.get(s, 0.0))) / alpha + l2)

    for _ in range(passes):
        for slots, y in rows:
            at = [s for s in slots if often[s] >= support] + [None]
            w = {s: weight(s) for s in at}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
            g = (p - y) * (positive if y else 1)
            for s in at:
                before = n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[s]
                n[s] = before + g * g
    return {s: weight(s) for s in z if weight(s) != 0}


def test_learning_equals_a_plain_restatement():
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        y = int(rng.random() < 0.3)
        rows.append((sorted({rng.randrange(60) for _ in range(12)} | ({61, 62} if y and rng.random() < 0.8 else {63}) | {rng.randrange(100, 5000)}), y))
    want = plain_ftrl(rows)
    model = toxicity.fit([(np.array(s), y) for s, y in rows], bits=13)
    assert abs(model.bias - want.pop(None)) < 1e-9
    got = dict(zip(model.slots.tolist(), model.values.tolist(), strict=True))
    assert got.keys() == want.keys() and len(got) > 3
    assert all(abs(got[s] - want[s]) < 1e-5 for s in want) and got[61] > 0 > got[63]


def test_features_are_words_pairs_and_skips():
    texts = ["one two three two", "", "one", "Two, one", None]
    slots, of = toxicity.features(toxicity.stripped(pa.array(texts)))
    sizes = np.diff(of).tolist()
    # one two three two: 3 words, 3 pairs, 2 with one between; two one: 2 words, 1 pair
    assert sizes == [8, 0, 1, 3, 0]
    sets = [set(slots[a:b].tolist()) for a, b in zip(of[:-1], of[1:], strict=True)]
    assert sets[2] < sets[0] and len(sets[3] & sets[0]) == 2


def test_held_out_documents(spark):
    """Figures on the labelled documents that were not learned from (README names them)."""
    ship(spark)
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi"), labels)
    rows = scored.filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").select("score", "predicted", "toxic").collect()
    score, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    order = score.argsort().argsort() + 1
    area = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    caught = np.mean([r["predicted"] for r in rows if r["toxic"]])
    loss = -np.mean(np.log(np.where(y, score, 1 - score)))
    print(f"held out {len(rows)}, toxic {y.sum()}, area {area:.4f}, right {right:.4f}, caught {caught:.4f}, log loss {loss:.4f}")
    assert len(rows) > 500 and area > 0.9 and right > 0.9 and caught > 0.6 and loss < 0.35
