"""The driver's tables as tables of a media catalog: each adapter and its DuckDB SQL say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PHOTOS_SQL = """photos AS (SELECT doc_id AS id, '/library/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.jpg' AS absolute_path,
 n_chars AS file_size, sha256(text) AS sha256, CAST(DATE '2024-01-01' + CAST((doc_id * 7919) % 1000 AS INTEGER) AS VARCHAR) AS created_at, source, lang FROM documents)"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as photos: contents by hash of the text, a path by source and language."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id") * 7919, F.lit(1000)).cast("int"))
    path = F.concat(F.lit("/library/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return d.select(F.col("doc_id").alias("id"), path.alias("absolute_path"), F.col("n_chars").alias("file_size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit(None).cast("string").alias("capture_time"), day.cast("string").alias("created_at"), "source", "lang")


BIN_SQL = "bin AS (SELECT doc_id AS photo_id FROM labels WHERE toxic = 1 AND quality = 0)"
KEPT_SQL = "kept AS (SELECT doc_id AS photo_id FROM labels WHERE toxic = 0 AND quality = 0)"
RECS_SQL = "recs AS (SELECT doc_id AS photo_id, CASE WHEN toxic = 1 THEN 'REMOVE' WHEN quality = 0 THEN 'REVIEW' ELSE 'KEEP' END AS decision FROM labels)"


def bin_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").filter("toxic = 1 and quality = 0")
    return rows.select(F.col("doc_id").alias("photo_id"), F.lit("/library").alias("original_path"), F.concat(F.lit("/trash/"), F.col("doc_id").cast("string")).alias("trash_path"), F.lit("2024-06-01").alias("deleted_at"), F.lit("active").alias("state"))


def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 0 and quality = 0").select(F.col("doc_id").alias("photo_id"))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("toxic") == 1, "REMOVE").when(F.col("quality") == 0, "REVIEW").otherwise("KEEP")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("photo_id"), decision.alias("decision"))


def event_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as photos with a time."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("t"), "user_id", "event_type", "value", "props")


SHOTS_SQL = """lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
shots AS (SELECT l_orderkey AS moment_id, l_orderkey * 1000 + pos AS id, pos, l_linenumber = 7 AS is_kept,
 l_quantity / 50.0 AS sharpness, l_extendedprice / 100000.0 AS exposure, l_discount * 2.0 AS highlight, l_tax * 5.0 AS shadow,
 l_quantity / 100.0 AS contrast, l_discount AS saturation, l_tax * 10.0 AS flat,
 sha256(CAST(l_partkey % 40 AS VARCHAR)) AS sha256, substr(sha256(CAST(l_suppkey % 10 AS VARCHAR)), 1, 16) AS phash,
 CASE WHEN l_linestatus = 'O' THEN 'thumb' END AS thumb,
 l_returnflag, l_linenumber, l_partkey, l_suppkey, l_tax, l_discount FROM lines)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as photos with measures: an order is a moment."""
    from pyspark.sql import Window

    c = F.col
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w).cast("long"))
    digest = lambda col: F.sha2(col.cast("string").cast("binary"), 256)
    return rows.select(
        c("l_orderkey").alias("moment_id"),
        (c("l_orderkey") * 1000 + c("pos")).alias("id"),
        "pos",
        (c("l_linenumber") == 7).alias("is_kept"),
        (c("l_quantity") / 50.0).alias("sharpness"),
        (c("l_extendedprice") / 100000.0).alias("exposure"),
        (c("l_discount") * 2.0).alias("highlight_clipping"),
        (c("l_tax") * 5.0).alias("shadow_clipping"),
        (c("l_quantity") / 100.0).alias("contrast"),
        c("l_discount").alias("mean_saturation"),
        (c("l_tax") * 10.0).alias("flat_fraction"),
        digest(c("l_partkey") % 40).alias("sha256"),
        F.substring(digest(c("l_suppkey") % 10), 1, 16).alias("perceptual_hash"),
        F.when(c("l_linestatus") == "O", "thumb").alias("thumbnail_path"),
        F.lit("technical_ready").alias("analysis_status"),
        "l_returnflag",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_tax",
        "l_discount",
    )


FACES_SQL = """faces AS (SELECT id AS photo_id, moment_id, pos AS face_index,
 CASE l_returnflag WHEN 'A' THEN 'OPEN' WHEN 'N' THEN 'CLOSED' ELSE 'odd' END AS left_state,
 CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'OPEN' ELSE 'UNCERTAIN' END AS right_state,
 sharpness AS face_sharpness, CASE WHEN l_linenumber <> 5 THEN l_discount * 10.0 END AS smile_score, l_tax * 10.0 AS expression_confidence FROM shots)"""


def faces(spark: SparkSession, sf_dir: str, by: str = "moment_id", *more: str) -> DataFrame:
    """lineitem as faces of photos (an order is a photo, or each line where by is id). more: columns of shots that come along."""
    c = F.col
    left = F.when(c("l_returnflag") == "A", "OPEN").when(c("l_returnflag") == "N", "CLOSED").otherwise("odd")
    right = F.when(c("l_linenumber") % 3 == 1, "OPEN").when(c("l_linenumber") % 3 == 2, "UNCERTAIN")
    return shots(spark, sf_dir).select(*more, c(by).alias("photo_id"), c("pos").alias("face_index"), left.alias("left_state"), right.alias("right_state"), c("sharpness").alias("face_sharpness"), F.when(c("l_linenumber") != 5, c("l_discount") * 10.0).alias("smile_score"), (c("l_tax") * 10.0).alias("expression_confidence"))


EYES_SQL = """eyes AS (SELECT CASE WHEN l.toxic = 1 THEN 'CLOSED' WHEN d.lang = 'es' THEN 'IGNORE' ELSE 'OPEN' END AS gt,
 CASE WHEN d.n_chars < 800 THEN 'CLOSED' WHEN d.n_chars < 1600 THEN 'UNCERTAIN' ELSE 'OPEN' END AS pred,
 (d.n_chars % 100) / 100.0 AS confidence, CAST(d.n_chars % 250 AS DOUBLE) AS face_size,
 CASE WHEN d.n_chars % 7 <> 0 THEN (d.n_chars % 101) / 100.0 END AS openness FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def eyes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """labels and documents as labelled eyes with predictions."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    c = F.col
    gt = F.when(c("toxic") == 1, "CLOSED").when(c("lang") == "es", "IGNORE").otherwise("OPEN")
    pred = F.when(c("n_chars") < 800, "CLOSED").when(c("n_chars") < 1600, "UNCERTAIN").otherwise("OPEN")
    return joined.select(*more, gt.alias("gt"), pred.alias("pred"), ((c("n_chars") % 100) / 100.0).alias("confidence"), (c("n_chars") % 250).cast("double").alias("face_size"), F.when(c("n_chars") % 7 != 0, (c("n_chars") % 101) / 100.0).alias("openness"))


def sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 64-bit hashes: a bit for each positive number."""
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.expr("0L"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("bits"))


HASHES_SQL = "hashes AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS v FROM embeddings)"
EDGES_SQL = "edges AS (SELECT a.id AS a, b.id AS b, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance FROM hashes a JOIN hashes b ON a.id < b.id)"
#: Vectors whose signs serve as looks of photos.
LOOKS = 400
BITS_SQL = "bits AS (SELECT vec_id, list_reduce(list_prepend(CAST(0 AS UBIGINT), list_transform(embedding, lambda x: CAST(x > 0 AS UBIGINT))), lambda s, b: CAST(s * 2 % 18446744073709551616::HUGEINT + b AS UBIGINT)) AS h FROM embeddings)"

#: One to one as a recursion over all pairs in order: a pair whose sides are both free is taken. Needs WITH RECURSIVE and c (grp, raw_id, jpeg_id, a, b: the order).
MATCH_SQL = """q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY a, b) AS n FROM c),
m AS (SELECT grp, n, raw_id, jpeg_id, true AS won, [raw_id] AS raws, [jpeg_id] AS jpegs FROM q WHERE n = 1 UNION ALL
 SELECT q.grp, q.n, q.raw_id, q.jpeg_id, NOT list_contains(raws, q.raw_id) AND NOT list_contains(jpegs, q.jpeg_id) AS won,
 CASE WHEN list_contains(raws, q.raw_id) OR list_contains(jpegs, q.jpeg_id) THEN raws ELSE list_append(raws, q.raw_id) END,
 CASE WHEN list_contains(raws, q.raw_id) OR list_contains(jpegs, q.jpeg_id) THEN jpegs ELSE list_append(jpegs, q.jpeg_id) END FROM m JOIN q ON q.grp = m.grp AND q.n = m.n + 1)"""
