"""Changes of the catalog as new tables: every function returns rows, the caller writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions.scalar import capped, file_name


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """New rows in place of old ones with the same keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def scanned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Photos after a scan: by path, the old id stays, the status is pending again."""
    ids = old.select("absolute_path", F.col("id").alias("_old"))
    fresh = new.join(ids, "absolute_path", "left").withColumn("id", F.coalesce("_old", "id")).drop("_old").withColumn("analysis_status", F.lit("pending"))
    return upserted(old, fresh, ("absolute_path",))


def inserted_new(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Old rows, and new ones whose keys are not there yet."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def without(rows: DataFrame, ids: DataFrame, key: str = "photo_id") -> DataFrame:
    """Rows whose photo is not among ids (column id)."""
    return rows.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def purged(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without what belongs to the photos in ids: their rows, pairs, and recommendations of their moments."""
    out = {}
    for name, rows in tables.items():
        if name == "photos":
            out[name] = without(rows, ids, "id")
        elif name == "logical_photos":
            out[name] = without(without(rows, ids, "primary_id"), ids, "paired_id")
        elif name == "recommendations":
            moments = tables["photos"].join(ids, "id", "left_semi").filter("moment_id is not null").select("moment_id").distinct()
            out[name] = without(rows, ids).join(moments, "moment_id", "left_anti").select(*rows.columns)
        else:
            out[name] = without(rows, ids)
    return out


def reset(tables: dict[str, DataFrame], keep: DataFrame) -> dict[str, DataFrame]:
    """An empty library but for photos in the bin (keep: photo_id): pairs and recommendations go, bin rows stay."""
    out = {}
    for name, rows in tables.items():
        if name in ("logical_photos", "recommendations", "moment_groups"):
            out[name] = rows.limit(0)
        elif name == "photos":
            out[name] = rows.join(keep.select(F.col("photo_id").alias("id")), "id", "left_semi")
        else:
            out[name] = rows.join(keep.select("photo_id"), "photo_id", "left_semi")
    return out


def orphans(files: DataFrame, referenced: DataFrame) -> DataFrame:
    """Files (path) that nothing refers to."""
    return files.join(referenced.select("path"), "path", "left_anti")


def status_after_analysis(photos: DataFrame) -> DataFrame:
    return photos.withColumn("analysis_status", F.when(F.col("perceptual_hash").isNotNull(), "technical_ready").otherwise("error"))


def status_after_decisions(photos: DataFrame, decided: DataFrame) -> DataFrame:
    """decision_ready where there is a decision and a hash."""
    marks = decided.select(F.col("photo_id").alias("id"), F.lit(True).alias("_d")).distinct()
    ready = F.col("_d") & F.col("perceptual_hash").isNotNull()
    return photos.join(marks, "id", "left").withColumn("analysis_status", F.when(F.coalesce(ready, F.lit(False)), "decision_ready").otherwise(F.col("analysis_status"))).drop("_d")


def errors(rows: DataFrame) -> DataFrame:
    """Error rows with the reason cut to 500 characters."""
    return rows.withColumn("reason", capped(F.col("reason")))


def interrupted(sessions: DataFrame) -> DataFrame:
    """Sessions that were running when the program ended."""
    return sessions.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def checkpoint(log: DataFrame) -> DataFrame:
    """The state of each session from its log: the last row by number."""
    rest = [c for c in log.columns if c not in ("session_id", "seq")]
    return log.groupBy("session_id").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("session_id", "s.*")


def stale(photos: DataFrame, files: DataFrame, mounted: DataFrame | None = None) -> DataFrame:
    """Ids of active photos whose file is gone, or that are resource-fork twins.

    files: paths that exist; mounted: volumes that are there. A file on a volume that is not mounted isn't gone.
    """
    twin = file_name(F.col("absolute_path")).startswith("._")
    gone = photos.join(files.select(F.col("path").alias("absolute_path")), "absolute_path", "left_anti")
    if mounted is not None:
        volume = F.regexp_extract("absolute_path", r"^/Volumes/([^/]+)", 1)
        there = mounted.select(F.col("volume"), F.lit(True).alias("_m"))
        gone = gone.withColumn("volume", volume).join(there, "volume", "left").filter("volume = '' or _m").select(*photos.columns)
    return gone.select("id").union(photos.filter(twin).select("id")).distinct()


def missing(paths: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """Paths that are certainly gone: no such file, though the folder is there."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return paths.join(files.select("path"), "path", "left_anti").withColumn("_p", parent).join(folders.select(F.col("path").alias("_p")), "_p", "left_semi").drop("_p")


def moved_to_bin(photos: DataFrame, bin_entries: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Bin rows after a move: photos that are kept, or in the bin already, are not moved."""
    wanted = photos.join(ids, "id", "left_semi").filter("not is_kept").join(bin_entries.select(F.col("photo_id").alias("id")), "id", "left_anti")
    new = wanted.select(F.col("id").alias("photo_id"), F.col("absolute_path").alias("original_path"), F.lit(None).cast("string").alias("trash_path"), F.lit(at).alias("deleted_at"), F.lit("active").alias("state"))
    return bin_entries.unionByName(new, allowMissingColumns=True)


def recovered(bin_entries: DataFrame, ids: DataFrame, files: DataFrame) -> DataFrame:
    """Bin rows after recovery: a row stays if the original place is taken, or if its hash changed.

    files: path, sha256 of what lies in the bin and at original places; bin_entries has sha256.
    """
    taken = bin_entries.join(files.select(F.col("path").alias("original_path")), "original_path", "left_semi").select("photo_id")
    same = bin_entries.join(files.select(F.col("path").alias("trash_path"), F.col("sha256").alias("_h")), "trash_path").filter("sha256 is null or sha256 = _h").select("photo_id")
    gone = bin_entries.join(ids.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").join(same, "photo_id", "left_semi").join(taken, "photo_id", "left_anti").select(F.col("photo_id").alias("id"))
    return without(bin_entries, gone)


def chosen_keeper(protected: DataFrame, active: DataFrame, group: DataFrame, keeper) -> DataFrame:
    """Protected rows after a choice: the keeper, none of its group's others. It must be in the group and active."""
    if group.join(active.select("id"), "id", "left_semi").filter(F.col("id") == keeper).isEmpty():
        raise ValueError("the keeper must be an active photo of this group")
    rest = without(protected, group)
    return rest.union(protected.sparkSession.createDataFrame([(keeper,)], rest.select("photo_id").schema))


def labelled(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of eyes after an update: filename, face, left_eye, right_eye; null leaves what was there."""
    bad = labels.filter((F.col("left_eye").isNotNull() & ~F.col("left_eye").isin("OPEN", "CLOSED", "IGNORE")) | (F.col("right_eye").isNotNull() & ~F.col("right_eye").isin("OPEN", "CLOSED", "IGNORE")))
    if not bad.isEmpty():
        raise ValueError("not a label: OPEN, CLOSED or IGNORE are")
    new = labels.select("filename", "face", F.col("left_eye").alias("_l"), F.col("right_eye").alias("_r"))
    joined = truth.join(new, ["filename", "face"], "full")
    return joined.select("filename", "face", F.coalesce("_l", "left_eye", F.lit("")).alias("left_eye"), F.coalesce("_r", "right_eye", F.lit("")).alias("right_eye"))
