"""Faces: what a photo's faces say together, summaries of moments, non-maximum suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.functions.scalar import EXPRESSION_TRUST, iou, known_state
from argentum.operators.catalog import in_one_row


def metrics(faces: DataFrame, by: str | list[str] = "photo_id") -> DataFrame:
    """One row a photo: counts of eyes by state, faces with both eyes open, sharpness, smiles that can be trusted.

    faces: photo_id, face_index, left_state, right_state (null: not seen), face_sharpness, smile_score,
    expression_confidence. One aggregation, summed in parts.
    """
    left, right = known_state(F.col("left_state")), known_state(F.col("right_state"))
    eyes = lambda state: (F.coalesce(left == state, F.lit(False)).cast("int") + F.coalesce(right == state, F.lit(False)).cast("int"))
    trusted = F.when(F.col("expression_confidence") >= EXPRESSION_TRUST, F.col("smile_score"))
    out = faces.groupBy(by).agg(
        F.count("*").alias("face_count"),
        F.sum(eyes("OPEN")).alias("open_eye_count"),
        F.sum(eyes("CLOSED")).alias("closed_eye_count"),
        F.sum(eyes("UNCERTAIN")).alias("uncertain_eye_count"),
        F.count_if((left == "OPEN") & (right == "OPEN")).alias("open_eye_face_count"),
        F.avg("face_sharpness").alias("average_face_sharpness"),
        F.min("face_sharpness").alias("weakest_face_sharpness"),
        F.max("face_sharpness").alias("best_face_sharpness"),
        F.avg(trusted).alias("average_expression_score"),
        F.min_by("smile_score", F.when(F.col("smile_score").isNotNull(), F.col("face_index"))).alias("first_smile"),
    )
    return out.withColumn("likely_all_eyes_open", (F.col("closed_eye_count") == 0) & (F.col("uncertain_eye_count") == 0) & (F.col("open_eye_face_count") > 0))


def usual_count(rows: DataFrame, by: str, count: str = "face_count") -> DataFrame:
    """The most frequent face count above 0 of each group; of equally frequent ones the largest."""
    n = rows.filter(F.col(count) > 0).groupBy(by, count).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.max_by(count, F.struct("n", count)).alias("usual_face_count"))


def shot_score() -> Column:
    """How well a group shot came out."""
    z = F.lit(0.0)
    return F.col("open_eye_face_count") * 3.0 - F.col("closed_eye_count") * 2.0 + F.col("face_count") + F.coalesce(F.col("average_face_sharpness") * 2.0, z) + F.coalesce("average_expression_score", z)


def moment_summary(photos: DataFrame, per_photo: DataFrame, analysed: DataFrame) -> DataFrame:
    """One row a moment: photos with results, eyes by state, sharpness range, the best group shot.

    photos: id, moment_id (active); per_photo: metrics(); analysed: photo_id of analyses. Ties go to the least id.
    """
    rows = photos.filter("moment_id is not null").select("moment_id", F.col("id").alias("photo_id"))
    done = analysed.select("photo_id").union(per_photo.select("photo_id")).distinct()
    joined = rows.join(done, "photo_id", "left_semi").join(per_photo, "photo_id", "left")
    best = F.max(F.when(F.col("face_count") > 0, shot_score()))
    out = joined.groupBy("moment_id").agg(
        F.count("*").alias("photos_with_results"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for c, name in (("face_count", "total_faces"), ("open_eye_count", "open_eyes"), ("closed_eye_count", "closed_eyes"), ("uncertain_eye_count", "unclear_eyes"))],
        F.min("weakest_face_sharpness").alias("min_quality"),
        F.max("best_face_sharpness").alias("max_quality"),
        best.alias("best_score"),
        F.min_by("photo_id", F.when(F.col("face_count") > 0, F.struct((-shot_score()).alias("x"), F.col("photo_id")))).alias("best_group_shot"),
    )
    return out


def totals(faces: DataFrame, analysed: DataFrame, photos: DataFrame, version: str) -> DataFrame:
    """One row: photos that this version has checked, and faces found in them."""
    now = analysed.filter(F.col("analyzer_version") == version).select("photo_id").distinct().join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    checked = now.agg(F.count("*").alias("photos_checked"))
    return in_one_row(checked, faces.join(now, "photo_id", "left_semi").agg(F.count("*").alias("faces_detected")))


def suppressed(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Non-maximum suppression in each image: boxes that overlap a better kept one go.

    boxes: image_id, box_id, score, x, y, width, height and more. A fold over an image's boxes by score, the kept ones as its
    state, within the engine's own expressions; ties go by box_id. An image holds as many boxes as a detector gives.
    """
    rank = F.struct((-F.col("score")).alias("_minus"), F.col("box_id").alias("_box"), F.struct(*boxes.columns).alias("row"))
    ordered = F.transform(F.array_sort(F.collect_list(rank)), lambda r: r["row"])
    sides = boxes.groupBy("image_id").agg(ordered.alias("rows"))
    none = F.filter("rows", lambda r: F.lit(False))  # typed as the boxes are
    kept = F.aggregate("rows", none, lambda kept, r: F.when(F.exists(kept, lambda k: iou(k, r) > threshold), kept).otherwise(F.array_append(kept, r)))
    return sides.select(F.inline(kept)).select(*boxes.columns)
