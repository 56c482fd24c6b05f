"""KEEP, REVIEW and REMOVE: scores within a group, the ladder of rules, reasons, and what the user decided."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions.scalar import CLOSE_BITS, CONFIDENT_GAP, TIE, clamp, exposure_bonus, hamming, people_score, technical_score
from argentum.plans.shared import cut

# Reason codes and what they say.
REASONS = {
    "SharpestInGroup": "Strongest measured sharpness in this group",
    "StrongFaceSharpness": "Strongest face sharpness in this group",
    "PossibleClosedEyes": "One or more faces may have closed eyes",
    "AllEyesLikelyOpen": "All detected eyes likely open",
    "StrongerExpression": "Stronger reliable expression score than alternatives",
    "LowerExpression": "Lower expression score than the suggested keeper",
    "GoodExposure": "Exposure acceptable",
    "ExposureProblem": "Possible exposure problem",
    "ExactDuplicate": "Identical file contents; a keeper is available",
    "StrongerAlternative": "A stronger equivalent exists in this group",
    "UniqueMoment": "Unique photo; no equivalent alternative found",
    "NoBetterAlternative": "No clearly better alternative found; review rather than reject",
    "BestOfGroup": "Best overall candidate in this group",
    "EyeStateUncertain": "One or more eye states are uncertain",
    "FaceCountMismatch": "Face count differs from other frames in this group",
    "CloseComparison": "Top candidates are very close; review recommended",
    "KeptByUser": "Kept by you",
    "TechnicalUnavailable": "Technical analysis unavailable; inspect the original",
}
FACES = ("face_count", "closed_eye_count", "uncertain_eye_count", "likely_all_eyes_open", "average_face_sharpness", "average_expression_score", "first_smile")


def latest_override(log: DataFrame) -> DataFrame:
    """The last decision of each photo: (id, photo_id, actual_decision) -> photo_id, actual_decision."""
    return log.groupBy("photo_id").agg(F.max_by("actual_decision", "id").alias("actual_decision"))


def scored(photos: DataFrame) -> DataFrame:
    """Adds score; photos has the measures, and metrics of faces (null: none)."""
    c = F.col
    score = technical_score(c("sharpness"), c("highlight_clipping"), c("shadow_clipping")) + people_score(c("face_count"), c("average_face_sharpness"), c("average_expression_score"), c("first_smile")) + exposure_bonus(c("exposure"))
    return photos.withColumn("score", score)


def recommend(photos: DataFrame, overrides: DataFrame | None = None, eye_rules: bool = True) -> DataFrame:
    """photo_id, moment_id, decision, confidence, codes (array), reasoning (JSON), compared_to, best_of_group.

    photos: id, moment_id, is_kept, analysis_status, thumbnail_path, sha256, perceptual_hash, the measures, and
    where known the columns FACES; overrides: photo_id, actual_decision, and where known moment_id (of_photos). A photo without a moment is a group of its own.
    A group's best, second best and copies are aggregates joined back, so no task gathers a group. All are by moment_id itself and read the same measures: photos
    that are dealt by moment are not sent again. They are read four times, so what is costly should be written before; what is decided is written. eye_rules: closed or uncertain eyes count.
    """
    kinds = {"face_count": "long", "closed_eye_count": "long", "uncertain_eye_count": "long", "likely_all_eyes_open": "boolean"}
    for name in FACES:
        if name not in photos.columns:
            photos = photos.withColumn(name, F.lit(None).cast(kinds.get(name, "double")))
    c = F.col
    rows = _grouped(_judged(photos.filter("moment_id is not null"), overrides))
    if overrides is not None and "moment_id" in overrides.columns:
        overrides = overrides.filter("moment_id is null").drop("moment_id")
    alone = _judged(photos.filter("moment_id is null"), overrides)
    own = c("eligible") & c("id").isNotNull()
    alone = alone.withColumns({"n": F.when(own, F.lit(1).cast("long")), "best": F.when(own, F.struct(*_order())), "second": F.lit(0.0), "usual": F.lit(None).cast("long"), "keeper_id": F.lit(None).cast(photos.schema["id"].dataType)})
    rows = rows.unionByName(alone)

    gap = c("best.score") - c("second")
    tied = F.abs(gap) <= TIE
    confident = ~tied & (gap >= CONFIDENT_GAP)
    is_best = F.coalesce(c("id") == c("best.id"), F.lit(False))
    close = F.coalesce(hamming(c("perceptual_hash"), c("best.perceptual_hash")) <= CLOSE_BITS, F.lit(False))
    sharp, best_sharp = F.coalesce("sharpness", F.lit(0.0)), F.coalesce("best.sharpness", F.lit(0.0))
    zero = F.lit(0)
    closed = (F.coalesce("closed_eye_count", zero) > 0) & F.lit(eye_rules)
    unsure = (F.coalesce("uncertain_eye_count", zero) > 0) & F.lit(eye_rules)
    less = F.when(sharp < best_sharp, F.lit("SharpestInGroup"))
    near = F.when(close, F.lit("CloseComparison")).otherwise("UniqueMoment")

    def codes(*items: str | Column) -> Column:
        return F.array(*[F.lit(x) if isinstance(x, str) else x for x in items])

    winner = codes(
        F.when(c("n") == 1, F.lit("UniqueMoment")).when(tied, "CloseComparison").otherwise("BestOfGroup"),
        F.when((c("faces") > 0) & F.coalesce("likely_all_eyes_open", F.lit(False)), F.lit("AllEyesLikelyOpen")),
        F.when((c("faces") > 0) & c("average_face_sharpness").isNotNull(), F.lit("StrongFaceSharpness")),
        F.when((c("faces") > 0) & c("average_expression_score").isNotNull(), F.lit("StrongerExpression")),
        F.when(c("faces") == 0, F.lit("SharpestInGroup")),
        F.when(exposure_bonus(c("exposure")) > 0, F.lit("GoodExposure")),
    )
    sure = F.least(F.when(tied, 0.62).when(confident, 0.65 + clamp(gap * 2.0, 0.0, 0.3)).otherwise(0.7), F.lit(0.95))
    lower = F.when(F.coalesce("average_expression_score", F.lit(1.0)) < F.coalesce("best.average_expression_score", F.lit(0.0)), F.lit("LowerExpression"))
    none = F.lit(None).cast(photos.schema["id"].dataType)
    with_faces = c("faces") > 0
    # Rules in order: condition, decision, confidence, codes, what the photo was compared with.
    ladder: list[tuple[Column, Column | str, Column | float, Column, Column]] = [
        (c("best").isNull() & ~c("is_kept"), "REVIEW", 0.0, codes("TechnicalUnavailable"), none),
        (c("is_kept"), "KEEP", 1.0, codes("KeptByUser"), none),
        (~c("technical"), "REVIEW", 0.0, codes("TechnicalUnavailable"), none),
        (c("id") == c("keeper_id"), "KEEP", 1.0, codes("ExactDuplicate", "BestOfGroup"), none),
        (c("keeper_id").isNotNull(), "REMOVE", 1.0, codes("ExactDuplicate"), c("keeper_id")),
        ((c("n") == 1) & (sharp < 0.2), "REVIEW", 0.55, codes("NoBetterAlternative"), none),
        (is_best, "KEEP", sure, winner, none),
        (c("content") == c("best.sha256"), "REMOVE", 1.0, codes("ExactDuplicate"), c("best.id")),
        (with_faces & closed & close, F.when(c("best.likely_all_eyes_open"), "REMOVE").otherwise("REVIEW"), F.when(c("best.likely_all_eyes_open"), 0.82).otherwise(0.6), codes("PossibleClosedEyes", "StrongerAlternative"), c("best.id")),
        (with_faces & unsure, "REVIEW", 0.65, codes("EyeStateUncertain", "CloseComparison"), c("best.id")),
        (with_faces & close & (sharp + 0.05 < best_sharp), "REVIEW", 0.58, codes("StrongerAlternative", "SharpestInGroup"), c("best.id")),
        (with_faces, "REVIEW", 0.55, codes(near, less, lower), c("best.id")),
        (close & (sharp < 0.2) & (best_sharp >= 0.5), "REVIEW", 0.5, codes("SharpestInGroup", "NoBetterAlternative"), c("best.id")),
        (F.lit(True), "REVIEW", 0.5, codes(near, less), c("best.id")),
    ]

    def pick(i: int) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return reduce(lambda out, rule: F.when(F.coalesce(rule[0], F.lit(False)), lit(rule[i])).otherwise(out), reversed(ladder[:-1]), lit(ladder[-1][i]))

    also = codes(
        F.when(c("best").isNotNull() & (c("faces") > 0) & (c("faces") + 1 == c("usual")), F.lit("FaceCountMismatch")),
        F.when(c("best").isNotNull() & ((F.coalesce("highlight_clipping", F.lit(0.0)) > 0.15) | (F.coalesce("shadow_clipping", F.lit(0.0)) > 0.3)), F.lit("ExposureProblem")),
    )
    out = rows.select(
        c("id").alias("photo_id"),
        "moment_id",
        "user",
        pick(1).alias("decision"),
        pick(2).cast("double").alias("confidence"),
        F.array_compact(F.concat(pick(3), also)).alias("codes"),
        pick(4).alias("compared_to"),
        F.when(is_best & (c("n") > 1), c("n")).alias("best_of_group"),
    )
    out = _in_place(out)
    # A user's decision replaces the decision, not the codes.
    said = c("user").isin("KEEP", "REVIEW", "REMOVE")
    decided = F.coalesce(said, F.lit(False))
    return out.select("photo_id", "moment_id", F.when(decided, c("user")).otherwise(c("decision")).alias("decision"), F.when(decided, 1.0).otherwise(c("confidence")).alias("confidence"), "codes", reasoning(F.when(decided, F.array(F.lit("KeptByUser"))).otherwise(c("codes"))).alias("reasoning"), "compared_to", "best_of_group")


def _judged(photos: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Adds what the user said, score, faces, content, whether a photo may be the best of its group; kept as the user's last word says."""
    c = F.col
    if overrides is None:
        rows = photos.withColumn("user", F.lit(None).cast("string"))
    else:
        by = ["moment_id", "id"] if "moment_id" in overrides.columns else ["id"]
        said = overrides.withColumnsRenamed({"photo_id": "id", "actual_decision": "user"}).select(*by, "user")
        # Dealt by moment alone, as the photos may be: they then stay where they are.
        rows = photos.join(said.repartition("moment_id") if len(by) > 1 else said, by, "left")
    rows = scored(rows.withColumn("is_kept", c("is_kept") | F.coalesce(c("user") == "KEEP", F.lit(False)))).withColumn("faces", F.coalesce("face_count", F.lit(0).cast("long")))
    removed = F.coalesce(c("user") == "REMOVE", F.lit(False)) | F.coalesce(c("analysis_status") == "user_remove", F.lit(False))
    technical = c("sharpness").isNotNull() & c("thumbnail_path").isNotNull()
    return rows.withColumns({"eligible": ~removed & technical, "technical": technical, "content": F.when(c("sha256") != "", c("sha256"))})


def _order() -> list[Column]:
    """Best of a group first: kept, then score, then least id; behind them what others are compared with."""
    c = F.col
    return [F.coalesce((~c("is_kept")).cast("int"), F.lit(2)).alias("x"), (-c("score")).alias("y"), c("id"), *map(c, ("score", "sharpness", "sha256", "perceptual_hash", "likely_all_eyes_open", "average_expression_score"))]


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds n, best, second, usual, keeper_id of each photo's moment; rows has no null in moment_id.

    second is the score that comes second by rank: the largest of the others wherever the best isn't kept, and read only there.
    """
    c = F.col
    able = rows.filter("eligible")
    # All three aggregates read the whole order: they then share one shuffle with the rows, where there is one, as none of them needs fewer columns.
    lead = F.struct(*_order())
    sizes = rows.groupBy("moment_id", "faces").agg(F.count("*").alias("k"), F.count_if("eligible").alias("able"), F.min(F.when(c("eligible"), lead)).alias("best"))
    group = sizes.groupBy("moment_id").agg(F.sum("able").alias("n"), F.min("best").alias("best"), F.max_by("faces", F.when(c("faces") > 0, F.struct("k", "faces"))).alias("usual"))
    # Two rows a moment are left before a shuffle (WindowGroupLimit).
    place = F.row_number().over(Window.partitionBy("moment_id").orderBy(*_order()))
    second = able.withColumn("place", place).filter("place = 2").select("moment_id", c("score").alias("second"))
    # Of copies the kept ones come first, then the best of the group, then the least id. The best is among copies whose first by rank it is, and then no other comes before it.
    kept, _, id_ = _order()[:3]
    copies = able.filter("content is not null").groupBy("moment_id", "content").agg(F.count("*").alias("same"), F.min(F.struct(kept, id_))["id"].alias("least_id"), F.min(lead)["id"].alias("first_id")).filter("same > 1").drop("same")
    out = rows.join(group, "moment_id", "left").join(second, "moment_id", "left").join(copies, ["moment_id", "content"], "left")
    keeper = F.when(c("first_id") == c("best.id"), c("first_id")).otherwise(c("least_id"))
    return out.withColumns({"second": F.coalesce("second", F.lit(0.0)), "keeper_id": keeper}).drop("first_id", "least_id")


#: Whether rows that are joined by several columns, and lie by one of them, are dealt anew by all.
ANEW = "spark.sql.requireAllClusterKeysForCoPartition"


def _in_place(df: DataFrame) -> DataFrame:
    """Written and read again; rows that lie by moment stay there for joins by moment and contents, or moment and id. The session's setting is as before afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(ANEW)
    conf.set(ANEW, "false")
    try:
        return cut(df, "decided")
    finally:
        conf.set(ANEW, before)


def of_photos(overrides: DataFrame, photos: DataFrame) -> DataFrame:
    """Overrides (photo_id, actual_decision) with moment_id of their photos; those without a photo go. Reads id and moment_id alone."""
    return photos.select(F.col("id").alias("photo_id"), "moment_id").join(overrides, "photo_id").dropDuplicates(["moment_id", "photo_id"])


def count_mismatches(photos: DataFrame) -> DataFrame:
    """(photo_id, moment_id) of photos with the code FaceCountMismatch: one face less than is usual in a moment that has an eligible photo.

    The same as recommend without overrides says, from what this rule reads alone.
    """
    c = F.col
    grp = F.coalesce("moment_id", F.concat(F.lit("unique:"), c("id").cast("string")))
    able = (c("sharpness").isNotNull() & c("thumbnail_path").isNotNull()) & ~F.coalesce(c("analysis_status") == "user_remove", F.lit(False))
    rows = photos.select("id", "moment_id", grp.alias("grp"), F.coalesce("face_count", F.lit(0)).alias("faces"), able.alias("able"))
    sizes = rows.groupBy("grp", "faces").agg(F.count("*").alias("k"), F.max("able").alias("able"))
    usual = sizes.groupBy("grp").agg(F.max("able").alias("able"), F.max_by("faces", F.when(c("faces") > 0, F.struct("k", "faces"))).alias("usual")).filter("able")
    found = rows.filter("faces > 0").join(usual, "grp").filter("faces + 1 = usual")
    return found.select(c("id").alias("photo_id"), "moment_id")


def reasoning(codes: Column) -> Column:
    """Messages and codes as JSON."""
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.to_json(F.struct(F.transform(codes, lambda x: F.try_element_at(table, x)).alias("messages"), codes.alias("codes")))


def messages(raw: Column) -> Column:
    """Messages from stored reasoning: a bundle, a list, or the text itself."""
    bundle = F.from_json(raw, "struct<messages:array<string>,codes:array<string>>")
    known = F.coalesce(F.forall(bundle["codes"], lambda x: x.isin(*REASONS)), F.lit(False))
    listed = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))
    return F.coalesce(F.when(known, bundle["messages"]), listed, F.array(raw))


def sentence(raw: Column) -> Column:
    return F.array_join(messages(raw), "; ")


def keeper_scores(rows: DataFrame) -> DataFrame:
    """Scores of a group in order, for display: the place of each photo."""
    w = Window.partitionBy("moment_id").orderBy(F.desc("is_kept"), F.desc("score"), "id")
    return scored(rows).withColumn("place", F.row_number().over(w))
