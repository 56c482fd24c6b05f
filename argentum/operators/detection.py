"""Face boxes from a detector's heads: anchors by place, scores, boxes and landmarks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.operators.faces import suppressed

#: Pixels of the detector's square input, the least score, and the overlap beyond which of two boxes one goes.
INPUT, SCORE, OVERLAP = 640, 0.6, 0.3
# Landmarks in the order of the head's numbers.
LANDMARKS = ("right_eye", "left_eye", "nose", "mouth_right", "mouth_left")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def decoded(heads: DataFrame, size: int = INPUT, least: float = SCORE) -> DataFrame:
    """image_id, stride, cell, score, x, y, width, height and landmarks (structs of x, y), a row for each box with a score of `least`.

    heads: image_id, stride, cls, obj (a number a cell), bbox (4), kps (10), scale_x, scale_y. The cells of a stride lie row by row in the
    input's square of `size` pixels. Score: the root of class times object, each within 0 and 1. A score that is no number and
    sides that aren't finite make no box; a head whose arrays don't fit its stride is an error.
    """
    c = F.col
    cols = F.floor(F.lit(size) / c("stride")).cast("int")
    wide = {"cls": 1, "obj": 1, "bbox": 4, "kps": 10}
    fits = [F.assert_true(F.size(name) == cols * cols * n, F.format_string("unexpected size of %s at stride %d", F.lit(name), c("stride"))) for name, n in wide.items()]
    checked = heads.filter(F.coalesce(*fits).isNull())
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))
    cells = checked.select("image_id", "stride", "scale_x", "scale_y", "obj", "bbox", "kps", cols.alias("cols"), F.posexplode("cls").alias("cell", "cls"))
    at = lambda name, i: F.get(name, i).cast("double")
    score = F.sqrt(unit(c("cls")) * unit(at("obj", c("cell"))))
    found = cells.withColumn("score", score).filter(~F.isnan("cls") & ~F.isnan(at("obj", c("cell"))) & (c("score") >= least))
    col, row, s = c("cell") % c("cols"), F.floor(c("cell") / c("cols")), c("stride")
    box = lambda i: at("bbox", c("cell") * 4 + i)
    found = found.select("*", ((col + box(0)) * s).alias("cx"), ((row + box(1)) * s).alias("cy"), (F.exp(box(2)) * s).alias("w"), (F.exp(box(3)) * s).alias("h"))
    found = found.filter(finite(c("cx")) & finite(c("cy")) & finite(c("w")) & finite(c("h")))
    point = lambda n: F.struct(((at("kps", c("cell") * 10 + 2 * n) + col) * s * c("scale_x")).alias("x"), ((at("kps", c("cell") * 10 + 2 * n + 1) + row) * s * c("scale_y")).alias("y"))
    sides = [((c("cx") - c("w") / 2.0) * c("scale_x")).alias("x"), ((c("cy") - c("h") / 2.0) * c("scale_y")).alias("y"), (c("w") * c("scale_x")).alias("width"), (c("h") * c("scale_y")).alias("height")]
    return found.select("image_id", "stride", "cell", "score", *sides, *[point(n).alias(name) for n, name in enumerate(LANDMARKS)])


def detected(heads: DataFrame, size: int = INPUT, least: float = SCORE, threshold: float = OVERLAP) -> DataFrame:
    """Boxes of all heads of an image, those left that overlap no better one. Ties in the order of strides and cells."""
    boxes = decoded(heads, size, least).withColumn("box_id", F.struct("stride", "cell"))
    return suppressed(boxes, threshold).drop("box_id")
