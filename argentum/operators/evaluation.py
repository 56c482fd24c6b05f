"""How well eye states are told: confusion, rates, buckets, and the progress of labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.functions.scalar import confidence_bucket, html_escaped, openness_bucket, percent_text, ratio, size_bucket

LABELS = ("OPEN", "CLOSED", "IGNORE")
LEAST_EYES = 100


def usable(eyes: DataFrame) -> DataFrame:
    """Eyes that count: labelled OPEN or CLOSED. eyes: gt, pred, confidence, face_size, openness."""
    return eyes.filter(F.col("gt").isin("OPEN", "CLOSED"))


def confusion(eyes: DataFrame) -> DataFrame:
    """Rows by label, a column for each state."""
    return usable(eyes).groupBy("gt").pivot("pred", ["OPEN", "CLOSED", "UNCERTAIN"]).count().na.fill(0)


def report(eyes: DataFrame) -> DataFrame:
    """One row of counts and rates; x/0 is 0."""
    g, p = F.col("gt"), F.col("pred")
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    counts = eyes.agg(
        n(g.isin(*LABELS)).alias("labelled_eyes"),
        n(g == "IGNORE").alias("ignored"),
        *[n((g == x) & (p == y)).alias(f"{x.lower()}_{y.lower()}") for x in ("OPEN", "CLOSED") for y in ("OPEN", "CLOSED", "UNCERTAIN")],
    )
    c = F.col
    opened, closed = (c(f"{x}_open") + c(f"{x}_closed") + c(f"{x}_uncertain") for x in ("open", "closed"))
    sure = c("open_open") + c("open_closed") + c("closed_open") + c("closed_closed")
    rates = {
        "confident_accuracy": (c("open_open") + c("closed_closed"), sure),
        "coverage": (sure, opened + closed),
        "uncertain_rate": (c("open_uncertain") + c("closed_uncertain"), opened + closed),
        "false_closed_rate": (c("open_closed"), opened),
        "false_open_rate": (c("closed_open"), closed),
        "open_precision": (c("open_open"), c("open_open") + c("closed_open")),
        "open_recall": (c("open_open"), opened),
        "closed_precision": (c("closed_closed"), c("closed_closed") + c("open_closed")),
        "closed_recall": (c("closed_closed"), closed),
    }
    return counts.select("*", opened.alias("open_gt"), closed.alias("closed_gt"), *[ratio(*v).alias(k) for k, v in rates.items()])


def buckets(eyes: DataFrame, bucket: Column) -> DataFrame:
    """Statistics by bucket; the false-closed rate is over all samples of a bucket."""
    g, p = F.col("gt"), F.col("pred")
    rows = usable(eyes).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("samples"), F.count_if(p.isin("OPEN", "CLOSED")).alias("confident"), F.count_if(p == g).alias("correct"), F.count_if(p == "UNCERTAIN").alias("uncertain"), F.count_if((p == "CLOSED") & (g == "OPEN")).alias("false_closed"))
    c = F.col
    return rows.select("*", ratio(c("confident"), c("samples")).alias("coverage"), ratio(c("correct"), c("confident")).alias("accuracy"), ratio(c("false_closed"), c("samples")).alias("false_closed_rate"), ratio(c("uncertain"), c("samples")).alias("uncertain_rate"))


def by_size(eyes: DataFrame) -> DataFrame:
    return buckets(eyes, size_bucket(F.col("face_size")))


def by_confidence(eyes: DataFrame) -> DataFrame:
    return buckets(eyes, confidence_bucket(F.col("confidence")))


def openness_histogram(eyes: DataFrame) -> DataFrame:
    """Open eyes that were told closed, by openness."""
    return eyes.filter("gt = 'OPEN' and pred = 'CLOSED'").groupBy(openness_bucket(F.col("openness")).alias("bucket")).agg(F.count("*").alias("n"))


def failures(eyes: DataFrame) -> DataFrame:
    """Eyes told wrong, as text for a review: those that are open first. eyes: filename, face_index, side, gt, pred, confidence, face_size, openness."""
    c = F.col
    wrong = eyes.filter("gt = 'OPEN' and pred = 'CLOSED' or gt = 'CLOSED' and pred = 'OPEN'")
    shown = F.coalesce(F.format_string("%.3f", "openness"), F.lit("none"))
    return wrong.select(
        html_escaped(c("filename")).alias("filename"),
        (c("face_index") + 1).alias("face"),
        "side",
        F.concat("gt", F.lit(" → "), "pred").alias("what"),
        F.format_string("%.2f", "confidence").alias("confidence"),
        F.format_string("%.0fpx", "face_size").alias("face_size"),
        F.when(c("openness").isNull(), "none").otherwise(shown).alias("openness"),
    ).orderBy(c("what").desc(), "filename", "face", "side")


def enough(eyes: DataFrame, least: int = LEAST_EYES) -> bool:
    """Whether there are eyes enough for an evaluation."""
    return usable(eyes).limit(least).count() >= least


def enough_row(eyes: DataFrame, least: int = LEAST_EYES) -> DataFrame:
    """The same as one row: enough."""
    return usable(eyes).agg((F.count("*") >= least).alias("enough"))


def predictions_with_labels(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted eyes with their labels: both have filename, face_index, side."""
    return predictions.join(truth, ["filename", "face_index", "side"], "left")


def text_report(spark_report: DataFrame) -> DataFrame:
    """The rates of report() as lines: name, text."""
    names = ["confident_accuracy", "coverage", "uncertain_rate", "false_closed_rate", "false_open_rate", "open_precision", "open_recall", "closed_precision", "closed_recall"]
    return spark_report.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), percent_text(F.col(n)).alias("text")) for n in names])).alias("x")).select("x.*")


def label_progress(truth: DataFrame, photos: DataFrame | None = None) -> DataFrame:
    """One row of counts. truth: filename, face, left_eye, right_eye (a file without faces has null face)."""
    if photos is not None:
        truth = truth.join(photos.select("filename").distinct(), "filename", "left_semi")
    good = lambda c: F.coalesce(F.col(c).isin(*LABELS), F.lit(False))
    each = lambda v: F.sum((F.coalesce(F.col("left_eye") == v, F.lit(False)).cast("int") + F.coalesce(F.col("right_eye") == v, F.lit(False)).cast("int")))
    out = truth.agg(F.count_distinct("filename").alias("photos_reviewed"), F.count_if(good("left_eye") & good("right_eye")).alias("faces_reviewed"), *[F.coalesce(each(v), F.lit(0)).cast("long").alias(v.lower()) for v in LABELS])
    return out.withColumn("eyes_labelled", F.col("open") + F.col("closed") + F.col("ignore")).withColumn("usable_eyes", F.col("open") + F.col("closed"))


def work_items(photos: DataFrame) -> DataFrame:
    """One item for each face, one for a photo without any. photos: idx, filename, status, faces (array of indexes)."""
    items = photos.select("idx", "filename", "status", F.explode_outer(F.when(F.col("status") == "ok", F.col("faces"))).alias("face_index"))
    kind = F.when(F.col("status") != "ok", F.col("status")).when(F.col("face_index").isNull(), "no_faces").otherwise("face")
    return items.select("idx", "filename", kind.alias("kind"), "face_index")


def first_unlabelled(items: DataFrame, truth: DataFrame) -> DataFrame:
    """The place of the first item to label, else the last item's. items: place, filename, kind, face_index."""
    done = truth.filter(F.col("left_eye").isin(*LABELS) & F.col("right_eye").isin(*LABELS)).select("filename", F.col("face").alias("face_index"), F.lit(True).alias("done")).distinct()
    seen = truth.select("filename", F.lit(True).alias("seen")).distinct()
    joined = items.join(done, ["filename", "face_index"], "left").join(seen, "filename", "left")
    open_ = F.when(F.col("kind") == "face", F.col("done").isNull()).otherwise(F.col("seen").isNull())
    return joined.agg(F.coalesce(F.min(F.when(open_, F.col("place"))), F.max("place"), F.lit(0)).alias("place"))


def next_photo(items: DataFrame, place: int, filename: str) -> DataFrame:
    """The next item of another photo, else the same place."""
    return items.agg(F.coalesce(F.min(F.when((F.col("place") > place) & (F.col("filename") != filename), F.col("place"))), F.lit(place)).alias("place"))
