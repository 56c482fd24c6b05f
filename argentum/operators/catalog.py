"""Views over the catalog: the library with its analysis, what is active, pages, statistics, the bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions.scalar import ratio

PAGE, MOST = 200, 500


def library(photos: DataFrame, analysis: DataFrame, protected: DataFrame) -> DataFrame:
    """Photos with their analysis, if any, and whether the user keeps them."""
    marks = protected.select("photo_id").distinct().withColumn("is_kept", F.lit(True))
    joined = photos.join(analysis.withColumnRenamed("photo_id", "id"), "id", "left").join(marks.withColumnRenamed("photo_id", "id"), "id", "left")
    return joined.withColumn("is_kept", F.coalesce("is_kept", F.lit(False)))


def active(photos: DataFrame, bin_entries: DataFrame, key: str = "id") -> DataFrame:
    """Photos that are not in the bin."""
    return photos.join(bin_entries.select(F.col("photo_id").alias(key)), key, "left_anti")


def without_secondaries(photos: DataFrame, pairs: DataFrame) -> DataFrame:
    """Photos less the second one of each pair."""
    return photos.join(pairs.select(F.col("paired_id").alias("id")), "id", "left_anti")


def without_pairs(photos: DataFrame, pairs: DataFrame) -> DataFrame:
    """Photos less both of each pair."""
    return photos.join(pairs.select(F.explode(F.array("primary_id", "paired_id")).alias("id")), "id", "left_anti")


def page(photos: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page, newest first; the limit is held between 1 and 500."""
    when = F.coalesce("capture_time", "created_at")
    return photos.orderBy(when.desc(), F.col("id").asc()).offset(max(0, offset)).limit(min(MOST, max(1, limit)))


def merged_pages(*pages: DataFrame) -> DataFrame:
    """Pages put together; a photo that is on two of them comes once."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["id"])


def dashboard(photos: DataFrame, bin_entries: DataFrame, protected: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row: active photos and bytes, exact duplicates beyond the first, removals, reviews.

    Reviews count whether or not their photos are in the bin.
    """
    here = active(photos, bin_entries)
    # One pass over photos: the totals come from the groups of equal contents.
    content = F.when(F.col("sha256") != "", F.col("sha256"))
    groups = here.groupBy(content.alias("sha256")).agg(F.count("*").alias("c"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.max("file_size").alias("most"))
    twice = (F.col("c") > 1) & F.col("sha256").isNotNull()
    totals = groups.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("total_photos"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce(F.sum(F.when(twice, F.col("c") - 1)), F.lit(0)).cast("long").alias("exact_duplicates"),
        F.coalesce(F.sum(F.when(twice, (F.col("c") - 1) * F.col("most"))), F.lit(0)).cast("long").alias("exact_duplicates_bytes"),
    )
    removals = here.join(recommendations.filter("decision = 'REMOVE'").select(F.col("photo_id").alias("id")), "id").join(protected.select(F.col("photo_id").alias("id")), "id", "left_anti")
    gone = removals.agg(F.count("*").alias("recommended_removals"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("recommended_removals_bytes"))
    reviews = recommendations.filter("decision = 'REVIEW'").agg(F.count("*").alias("needs_review"))
    # One row each; put under one another, the largest value of a column is the only one.
    return in_one_row(totals, gone, reviews)


def in_one_row(*tables: DataFrame) -> DataFrame:
    """Tables of one row with different columns side by side."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    return whole.agg(*[F.max(c).alias(c) for c in whole.columns])


def bin_list(photos: DataFrame, bin_entries: DataFrame) -> DataFrame:
    """What is in the bin, latest first, with the place where it lies now."""
    joined = photos.join(bin_entries.withColumnRenamed("photo_id", "id"), "id")
    return joined.withColumn("absolute_path", F.coalesce("trash_path", "original_path")).orderBy(F.col("deleted_at").desc(), "id")


def visible_bin(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Bin rows whose file is there; files: paths that exist."""
    return listed.join(files.select(F.col("path").alias("absolute_path")).distinct(), "absolute_path", "left_semi")


def pending_faces(photos: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Photos whose faces were not analysed by this version."""
    current = done.filter(F.col("analyzer_version") == version).select(F.col("photo_id").alias("id"))
    return photos.join(current, "id", "left_anti")


def complete_analysis(analysis: DataFrame) -> DataFrame:
    """Rows whose measures are all there, so that they can be used again."""
    needed = ("sharpness", "exposure", "contrast", "highlight_clipping", "shadow_clipping")
    return analysis.dropna(subset=list(needed))


def reusable(photos: DataFrame, done: DataFrame) -> DataFrame:
    """For each photo one complete analysis of another photo with the same contents: the least id decides.

    photos: id, sha256; done: analysis rows with sha256 and photo_id.
    """
    other = done.filter("sha256 <> ''").select(F.col("photo_id").alias("source_id"), "sha256", *[c for c in done.columns if c not in ("photo_id", "sha256")])
    keep = [c for c in other.columns if c != "sha256"]
    # The two least sources of each contents are enough: a photo takes the first that isn't itself.
    least = lambda rows, name: rows.groupBy("sha256").agg(F.min_by(F.struct(*keep), "source_id").alias(name))
    one = least(other, "one")
    two = least(other.join(one.select("sha256", F.col("one.source_id").alias("first")), "sha256").filter("source_id <> first"), "two")
    joined = photos.select("id", "sha256").join(one, "sha256").join(two, "sha256", "left")
    return joined.select("id", F.when(F.col("id") != F.col("one.source_id"), F.col("one")).otherwise(F.col("two")).alias("best")).filter("best is not null").select("id", "best.*")


def progress(processed: DataFrame) -> DataFrame:
    """Percent done of each session: session_id, processed_files, total_files."""
    return processed.select("session_id", F.round(100 * ratio(F.col("processed_files"), F.col("total_files"))).cast("int").alias("percent"))


def first_error(errors: DataFrame) -> DataFrame:
    """The reason a session failed: its first error."""
    return errors.groupBy("session_id").agg(F.min_by("reason", "id").alias("reason"))


def shown_decision(photos: DataFrame, recommendations: DataFrame) -> DataFrame:
    """REMOVE is shown as REJECT; without a recommendation an error is for review, the rest is pending."""
    joined = photos.select("id", "analysis_status").join(recommendations.select(F.col("photo_id").alias("id"), "decision"), "id", "left")
    shown = F.when(F.col("decision") == "REMOVE", "REJECT").when(F.col("decision").isNotNull(), F.col("decision")).when(F.col("analysis_status") == "error", "REVIEW")
    return joined.select("id", shown.alias("shown"))


def numbered(page: DataFrame, first: int = 1, name: str = "place") -> DataFrame:
    """A page's rows with their places, in the order that the page has. A page is a few rows, in one partition."""
    return page.coalesce(1).withColumn(name, F.monotonically_increasing_id() + F.lit(first))


def neighbours(items: DataFrame, order: tuple[str, ...] = ("id",), by: str = "album") -> DataFrame:
    """Previous and next item of a viewer, in a circle, within each album."""
    w = Window.partitionBy(by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return items.withColumn("previous_id", F.coalesce(F.lag("id").over(w), F.last("id").over(whole))).withColumn("next_id", F.coalesce(F.lead("id").over(w), F.first("id").over(whole)))
