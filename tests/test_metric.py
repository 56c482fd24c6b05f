"""The metric index: exact pairs, and fewer blocks that meet than there are pairs of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from argentum.operators import duplicates, metric, people


def clusters(rng, n, k, apart=0.05):
    """Unit vectors around k centres."""
    centres = rng.normal(size=(k, 16))
    v = centres[rng.integers(0, k, n)] + apart * rng.normal(size=(n, 16))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def vectors(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, value array<float>")


@pytest.mark.parametrize("block,chunk", [(8192, 256), (16, 1), (40, 3)])
def test_angles_against_all_pairs(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(metric, "CHUNK", chunk)
    v = clusters(np.random.default_rng(1), 300, 12)
    v[50] = v[51] = v[52]
    got = sorted(map(tuple, metric.near_pairs(vectors(spark, v), metric.Angle, 0.3, block=block).collect()))
    angle = np.arccos(np.clip(v.astype(np.float64) @ v.astype(np.float64).T, -1, 1))
    i, j = np.nonzero(np.triu(angle <= 0.3, 1))
    assert got == list(zip(i.tolist(), j.tolist(), strict=True)) and len(got) > 500


@pytest.mark.parametrize("block", [8192, 10, 33])
def test_bits_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(metric, "CHUNK", 2)
    monkeypatch.setattr(metric, "AT_ONCE", 500)
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 63), 1 << 63, 12)
    values = sorted({int(b) ^ int(sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 9), replace=False))) for b in base for _ in range(25)})
    rows = spark.createDataFrame([(v, v) for v in values], "id long, value long")
    got = sorted(map(tuple, metric.near_pairs(rows, metric.Hamming, 9, block=block).collect()))
    want = [(x, y) for a, x in enumerate(values) for y in values[a + 1 :] if ((x ^ y) & (1 << 64) - 1).bit_count() <= 9]
    assert got == want


def test_empty_and_single(spark):
    assert metric.near_pairs(vectors(spark, np.zeros((0, 4))), metric.Angle, 0.5).collect() == []
    assert metric.near_pairs(vectors(spark, np.ones((1, 4))), metric.Angle, 0.5).collect() == []
    same = vectors(spark, np.ones((70, 4)))  # one look: no cut tells the rows apart
    assert metric.near_pairs(same, metric.Angle, 0.0, block=16).count() == 70 * 69 // 2


def test_rows_that_meet_grow_below_the_square(spark):
    """Copies of rows, on clustered data whose number of clusters grows with it."""
    copies = []
    for n in (500, 2000):
        found = metric.index(vectors(spark, clusters(np.random.default_rng(3), n, n // 25)), metric.Angle, 0.2, block=25)
        copies.append(found.copies().filter("side = 1").count())
        assert found.bounds.blocks.sum() >= n // 25
        assert copies[-1] < n * (found.bounds.blocks.sum() - 1) / 4  # half of these would meet without an index
    assert copies[1] < 8 * copies[0]  # 16 times as many pairs of blocks


def test_scored_pairs_are_not_joined_with_their_rows(spark):
    """Pairs may be many times as many as rows: they are scored where they meet."""
    v = clusters(np.random.default_rng(4), 200, 8, 0.3)
    df = spark.createDataFrame([(i, f"p{i // 2}", x.tolist()) for i, x in enumerate(v)], "id long, photo_id string, vector array<float>")
    found = people.links(df, 0.5, block=40)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    s = v.astype(float) @ v.astype(float).T
    want = [(i, j) for i in range(200) for j in range(i + 1, 200) if i // 2 != j // 2 and s[i, j] >= 0.5]
    got = sorted(map(tuple, found.collect()))
    assert [r[:2] for r in got] == want and np.allclose([r[2] for r in got], [s[p] for p in want], rtol=0, atol=1e-12)


def test_near_hashes_send_no_side_whole(spark):
    """Whatever the estimate of sizes says: probes, and near pairs, are many for each row."""
    rows = spark.range(300).select("id", F.xxhash64("id").alias("bits"))
    for distance in (8, 12):
        plan = duplicates.near_hashes(rows, distance).select("a", "b")._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if "Join Inner" in x]
        assert sum("strategy=merge" in x for x in joins) >= len(joins) - 1 > 0  # all but that of copies with their hash
