"""Faces turned into a fixed place: the closed-form similarity of five points as columns, and pixels sampled along it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.plans.shared import importable

SIDE, PIXELS = 112, 24
# Where the eyes, the nose and the corners of the mouth lie in a face of SIDE pixels.
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
#: Sample places computed at once.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def similarity(points: Column) -> Column:
    """struct(a, b, tx, ty): the turn and scale that brings five points (structs of x, y) nearest to TEMPLATE; null for points that lie too
    close together, aren't finite or aren't five. A point (x, y) goes to (a x - b y + tx, b x + a y + ty)."""
    ux, uy = (sum(p[k] for p in TEMPLATE) / 5.0 for k in (0, 1))
    total = lambda xs: reduce(lambda s, x: s + x, xs, F.lit(0.0))
    # Five points are spelled out, as folding over an array costs many times as much; what is used again is bound.
    wide = F.struct(*[F.get(points, k)[x].cast("double").alias(f"{x}{k}") for k in range(5) for x in "xy"])

    def centred(p: Column) -> Column:
        """The points' mean, and the points from there."""
        mean = F.struct(*[(total([p[f"{x}{k}"] for k in range(5)]) / 5.0).alias(x) for x in "xy"])
        return let(mean, lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y"), *[(p[f"{x}{k}"] - m[x]).alias(f"{x}{k}") for k in range(5) for x in "xy"]))

    def sums(c: Column) -> Column:
        near = [(c[f"x{k}"], c[f"y{k}"], F.lit(x - ux), F.lit(y - uy)) for k, (x, y) in enumerate(TEMPLATE)]
        all_ = F.struct(total([x * u + y * v for x, y, u, v in near]).alias("dot"), total([x * v - y * u for x, y, u, v in near]).alias("cross"), total([x * x + y * y for x, y, _, _ in near]).alias("norm"))

        def scaled(s: Column) -> Column:
            good = (s["norm"] >= 1.0) & (s["norm"] < float("inf"))
            return F.struct(c["x"].alias("x"), c["y"].alias("y"), F.when(good, s["dot"] / s["norm"]).alias("a"), F.when(good, s["cross"] / s["norm"]).alias("b"))

        return let(all_, scaled)

    def turn(t: Column) -> Column:
        a, b = t["a"], t["b"]
        out = F.struct(a.alias("a"), b.alias("b"), (F.lit(ux) - a * t["x"] + b * t["y"]).alias("tx"), (F.lit(uy) - b * t["x"] - a * t["y"]).alias("ty"))
        return F.when(a * a + b * b >= 1e-8, out)

    return F.when(F.size(points) == 5, let(let(let(wide, centred), sums), turn))


def turned(rows: DataFrame, points: Column) -> DataFrame:
    """Adds a, b, tx, ty as similarity has them, without rows that have no turn. For many rows: each step is a row of its own that the next one
    reads, which is compiled as a whole, where bound values inside of a column are interpreted."""
    ux, uy = (sum(p[k] for p in TEMPLATE) / 5.0 for k in (0, 1))
    total = lambda xs: reduce(lambda s, x: s + x, xs, F.lit(0.0))
    step = lambda df, **made: df.select("*", F.inline(F.array(F.struct(*[x.alias(n) for n, x in made.items()]))))
    names, c = rows.columns, lambda n: F.col("_" + n)
    at = [(f"{x}{k}", x) for x in "xy" for k in range(5)]
    df = step(rows.filter(F.size(points) == 5), **{"_" + n: F.get(points, int(n[1]))[x].cast("double") for n, x in at})
    df = step(df, _mx=total([c(n) for n, x in at if x == "x"]) / 5.0, _my=total([c(n) for n, x in at if x == "y"]) / 5.0)
    df = step(df, **{"_n" + n: c(n) - c("m" + x) for n, x in at})
    near = [(c(f"nx{k}"), c(f"ny{k}"), F.lit(x - ux), F.lit(y - uy)) for k, (x, y) in enumerate(TEMPLATE)]
    df = step(df, _dot=total([x * u + y * v for x, y, u, v in near]), _cross=total([x * v - y * u for x, y, u, v in near]), _norm=total([x * x + y * y for x, y, _, _ in near]))
    df = step(df.filter((c("norm") >= 1.0) & (c("norm") < float("inf"))), a=c("dot") / c("norm"), b=c("cross") / c("norm"))
    a, b = F.col("a"), F.col("b")
    return df.filter(a * a + b * b >= 1e-8).select(*names, a, b, (F.lit(ux) - a * c("mx") + b * c("my")).alias("tx"), (F.lit(uy) - b * c("mx") - a * c("my")).alias("ty"))


def sampled(rgb: np.ndarray, a: float, b: float, tx: float, ty: float, side: int = SIDE) -> np.ndarray:
    """3 x side x side numbers: each place of the turned face from the four pixels around where it came from; 0 outside."""
    height, width = rgb.shape[:2]
    out, scale = np.zeros((3, side, side), np.float32), a * a + b * b
    dx = np.arange(side) - tx
    for top in range(0, side, BLOCK):
        dy = (np.arange(top, min(top + BLOCK, side)) - ty)[:, None]
        sx, sy = (a * dx + b * dy) / scale, (-b * dx + a * dy) / scale
        inside = (sx >= 0) & (sy >= 0) & (sx < width - 1) & (sy < height - 1)
        x, y = sx[inside], sy[inside]
        x0, y0 = x.astype(np.int64), y.astype(np.int64)
        fx, fy = (x - x0)[:, None], (y - y0)[:, None]
        p = [rgb[y0 + j, x0 + i].astype(np.float64) for j in (0, 1) for i in (0, 1)]
        value = (1 - fx) * (1 - fy) * p[0] + fx * (1 - fy) * p[1] + (1 - fx) * fy * p[2] + fx * fy * p[3]
        row, column = np.nonzero(inside)
        out[:, row + top, column] = value.T
    return out


def aligned(faces: DataFrame, side: int = SIDE) -> DataFrame:
    """Adds turn (a, b, tx, ty) and tensor (array<float>, colour by colour, row by row) to faces: id, bbox_width, bbox_height, points, width, height,
    pixels (8-bit RGB rows). Both are null for faces under PIXELS, points that give no turn, and pictures that don't fit their size."""
    importable(faces.sparkSession)
    large = F.least("bbox_width", "bbox_height") >= PIXELS
    rows = faces.withColumn("turn", F.when(large, similarity(F.col("points"))))
    kind = faces.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for width, height, pixels, turn in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "pixels", "turn")), strict=True):
                fits = turn is not None and pixels is not None and width and height and len(pixels) == 3 * width * height
                made.append(sampled(np.frombuffer(pixels, np.uint8).reshape(height, width, 3), **turn, side=side).reshape(-1) if fits else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("turn"), pa.array(made, pa.list_(pa.float32()))], ["id", "turn", "tensor"])

    return rows.select("id", "width", "height", "pixels", "turn").mapInArrow(run, f"id {kind}, turn struct<a:double,b:double,tx:double,ty:double>, tensor array<float>")


def unit(vector: Column, size: int = 128) -> Column:
    """A model's numbers at length 1; null for a vector of another size, numbers that aren't finite, or almost no length."""
    values = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v))
    return F.when((F.size(vector) == size) & ~bad & (norm >= 1e-8), F.transform(values, lambda v: v / norm))
