"""Aligned faces against plain loops."""

import math
import random

import numpy as np

from argentum.operators import alignment
from argentum.plans import changes
from pyspark.sql import functions as F


def plain_turn(points):
    sx, sy = (sum(p[k] for p in points) / 5 for k in (0, 1))
    dx, dy = (sum(p[k] for p in alignment.TEMPLATE) / 5 for k in (0, 1))
    dot = cross = norm = 0.0
    for (x, y), (u, v) in zip(points, alignment.TEMPLATE, strict=True):
        dot += (x - sx) * (u - dx) + (y - sy) * (v - dy)
        cross += (x - sx) * (v - dy) - (y - sy) * (u - dx)
        norm += (x - sx) ** 2 + (y - sy) ** 2
    if norm < 1:
        return None
    a, b = dot / norm, cross / norm
    return a, b, dx - a * sx + b * sy, dy - b * sx - a * sy


def plain_sample(rgb, turn):
    a, b, tx, ty = turn
    height, width, _ = rgb.shape
    out = np.zeros((3, 112, 112))
    for y in range(112):
        for x in range(112):
            s = a * a + b * b
            u, v = (a * (x - tx) + b * (y - ty)) / s, (-b * (x - tx) + a * (y - ty)) / s
            if u < 0 or v < 0 or u >= width - 1 or v >= height - 1:
                continue
            i, j = math.floor(u), math.floor(v)
            for c in range(3):
                p = [float(rgb[j + q, i + p, c]) for q in (0, 1) for p in (0, 1)]
                out[c, y, x] = (p[0] * (1 - (u - i)) + p[1] * (u - i)) * (1 - (v - j)) + (p[2] * (1 - (u - i)) + p[3] * (u - i)) * (v - j)
    return out


def test_aligned_faces_against_plain_loops(spark):
    rng, np_rng = random.Random(1), np.random.default_rng(1)
    rows, want = [], {}
    for i in range(6):
        w, h = rng.randrange(90, 160), rng.randrange(90, 160)
        rgb = np_rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        k, turn = rng.uniform(0.5, 1.5), rng.uniform(-0.6, 0.6)
        points = [((x * math.cos(turn) - y * math.sin(turn)) * k + rng.gauss(20, 2), (x * math.sin(turn) + y * math.cos(turn)) * k + rng.gauss(5, 2)) for x, y in alignment.TEMPLATE]
        rows.append((i, 30.0, 24.0, points, w, h, rgb.tobytes()))
        want[i] = (plain_turn(points), plain_sample(rgb, plain_turn(points)))
    good = rows[0]
    odd = [(10, 23.9, 80.0, *good[3:]), (11, 30.0, 30.0, [(5.0, 5.0)] * 5, *good[4:]), (12, 30.0, 30.0, good[3][:4], *good[4:]), (13, 30.0, 30.0, good[3], 7, 7, b"123"), (14, 30.0, 30.0, None, None, None, None), (15, 30.0, 30.0, [(math.nan, 1.0), *good[3][1:]], *good[4:])]
    df = spark.createDataFrame(rows + odd, "id long, bbox_width double, bbox_height double, points array<struct<x:double,y:double>>, width int, height int, pixels binary")
    got = {r["id"]: r for r in alignment.aligned(df).collect()}
    for i, (turn, tensor) in want.items():
        assert np.allclose(tuple(got[i]["turn"]), turn) and np.abs(np.array(got[i]["tensor"]).reshape(3, 112, 112) - tensor).max() < 1e-3
        assert (tensor > 0).mean() > 0.2
    assert all(got[i]["tensor"] is None for i in range(10, 16)) and all(got[i]["turn"] is None for i in (10, 11, 12, 14, 15))


def test_points_of_the_template_stay(spark):
    df = spark.range(1).select(alignment.similarity(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in alignment.TEMPLATE])).alias("t"))
    assert np.allclose(tuple(df.first()["t"]), (1, 0, 0, 0), atol=1e-9)


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 1e-9],), ([math.nan, 1.0],), ([1.0],), ([math.inf, 1.0],), (None,)], "v array<float>")
    got = [r[0] for r in df.select(alignment.unit(F.col("v"), 2)).collect()]
    assert np.allclose(got[0], (0.6, 0.8)) and got[1:] == [None] * 5


def test_turns_of_many_rows_are_compiled(spark, sf):
    """The same numbers as by the column, without a function of higher order."""
    p = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct((F.col("id") * (k + 3) % 17).alias("x"), (F.col("id") * (2 * k + 5) % 13).alias("y")))
    df = spark.range(200).select("id", p.alias("p"))
    got = {r["id"]: tuple(r)[1:] for r in alignment.turned(df, F.col("p")).select("id", "a", "b", "tx", "ty").collect()}
    want = {r["id"]: tuple(r["t"]) for r in df.select("id", alignment.similarity(F.col("p")).alias("t")).collect() if r["t"]}
    assert got == want and 150 < len(got) < 200
    assert "lambda" not in changes.face_turns(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
