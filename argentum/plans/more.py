"""Further queries over the driver's tables: filters, joins, changes of state, labels and expressions of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.functions import scalar
from argentum.operators import catalog, decisions, duplicates, evaluation, moments, pairs, people, state
from argentum.operators import faces as face
from argentum.plans import adapters as ad
from argentum.plans.queries import NAMED_SQL, named_files
from argentum.plans.registry import query
from argentum.sources import files, formats

c = F.col


def r6(column, name: str):
    return F.round(column.cast("double"), 6).alias(name)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document and the one after it."""
    ids = ad.table(spark, sf_dir, "documents").filter("doc_id % 10 = 0").select("doc_id")
    return ids.select(c("doc_id").alias("primary_id"), (c("doc_id") + 1).alias("paired_id"))


PAIRS_SQL = "pairs AS (SELECT doc_id AS primary_id, doc_id + 1 AS paired_id FROM documents WHERE doc_id % 10 = 0)"


@query(f"WITH {PAIRS_SQL} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT paired_id FROM pairs)")
def primary_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos less the second one of each pair."""
    return catalog.without_secondaries(ad.photos(spark, sf_dir), _pairs(spark, sf_dir)).select("id")


@query(f"WITH {PAIRS_SQL} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT paired_id FROM pairs) AND doc_id NOT IN (SELECT primary_id FROM pairs)")
def unpaired_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that belong to no pair."""
    return catalog.without_pairs(ad.photos(spark, sf_dir), _pairs(spark, sf_dir)).select("id")


@query(f"WITH {PAIRS_SQL} SELECT primary_id, paired_id, a.lang AS primary_lang, b.lang AS paired_lang FROM pairs JOIN documents a ON a.doc_id = primary_id JOIN documents b ON b.doc_id = paired_id")
def resolved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with both photos."""
    photos = ad.photos(spark, sf_dir).select("id", "lang")
    return pairs.resolved(_pairs(spark, sf_dir), photos).select("primary_id", "paired_id", c("primary.lang").alias("primary_lang"), c("paired.lang").alias("paired_lang"))


FILES_SQL = """p AS (SELECT o_orderkey AS id, o_totalprice AS size, '/Cards/' || CAST(o_custkey AS VARCHAR) AS dir, 'img_' || CAST(o_orderkey % 5 AS VARCHAR) AS stem,
 CASE o_orderstatus WHEN 'F' THEN 'nef' WHEN 'O' THEN 'jpg' ELSE 'png' END AS ext, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS t FROM orders),
c AS (SELECT r.id AS raw_id, j.id AS jpeg_id, r.dir || '/' || r.stem AS grp, r.id AS a, j.id AS b, r.t IS NOT NULL AND j.t IS NOT NULL AS timed FROM p r JOIN p j ON r.ext = 'nef' AND j.ext = 'jpg' AND r.dir = j.dir AND r.stem = j.stem AND r.size <> j.size AND coalesce(abs(epoch_us(r.t) - epoch_us(j.t)) // 1000000 <= 5184000, true))"""


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as RAW and JPEG files: a folder for each customer, a few names, times for two of three."""
    ext = F.when(c("o_orderstatus") == "F", "NEF").when(c("o_orderstatus") == "O", "jpg").otherwise("png")
    path = F.concat(F.lit("/Cards/"), c("o_custkey").cast("string"), F.lit("/IMG_"), (c("o_orderkey") % 5).cast("string"), F.lit("."), ext)
    time = F.when(c("o_orderkey") % 3 > 0, F.date_format(c("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return ad.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").alias("file_size"), time.alias("capture_time"), path.alias("absolute_path"), ext.alias("extension"))


@query(f"WITH {FILES_SQL} SELECT raw_id, jpeg_id FROM c")
def file_pair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW and JPEG files of one folder and stem, not more than 60 days apart where both times are known."""
    return pairs.candidates(order_files(spark, sf_dir), 60 * 86400).select(c("r_id").alias("raw_id"), c("j_id").alias("jpeg_id"))


@query(f"""WITH RECURSIVE {FILES_SQL}, {ad.MATCH_SQL}
SELECT m.raw_id AS primary_id, m.jpeg_id AS paired_id, CASE WHEN timed THEN '{pairs.BY_TIME}' ELSE '{pairs.BY_NAME}' END AS match_reason FROM m JOIN c ON c.raw_id = m.raw_id AND c.jpeg_id = m.jpeg_id WHERE won""")
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW and JPEG files one to one, and why."""
    return pairs.logical_pairs(order_files(spark, sf_dir), 60 * 86400)


@query(f"WITH {ad.SHOTS_SQL} SELECT id FROM shots WHERE l_linenumber <> 2 AND l_tax > 0 AND thumb IS NOT NULL")
def complete_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses whose measures are all there."""
    rows = ad.shots(spark, sf_dir).select("id", F.when(c("l_linenumber") != 2, c("sharpness")).alias("sharpness"), "exposure", F.when(c("l_tax") > 0, c("contrast")).alias("contrast"), F.when(c("thumbnail_path").isNotNull(), c("highlight_clipping")).alias("highlight_clipping"), "shadow_clipping")
    return catalog.complete_analysis(rows).select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_face_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos whose faces this version has not analysed."""
    done = ad.table(spark, sf_dir, "labels").select(c("doc_id").alias("photo_id"), F.concat(F.lit("v"), c("quality").cast("string")).alias("analyzer_version"))
    return catalog.pending_faces(ad.photos(spark, sf_dir), done, "v1").select("id")


@query("SELECT vec_id // 2 AS photo_id, vec_id % 2 AS face_index FROM embeddings WHERE least(30 + vec_id % 30, 35 + vec_id % 20) >= 40 AND vec_id % 3 <> 0 AND vec_id % 11 <> 0 AND vec_id // 2 % 5 <> 0")
def face_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces large enough and with a usable vector of this version."""
    rows = ad.table(spark, sf_dir, "embeddings").select(c("vec_id"), F.floor(c("vec_id") / 2).alias("photo_id"), (c("vec_id") % 2).alias("face_index"), "embedding")
    found = rows.select("photo_id", "face_index", (30 + c("vec_id") % 30).alias("bbox_width"), (35 + c("vec_id") % 20).alias("bbox_height"))
    text = F.when(c("vec_id") % 11 == 0, F.lit("[1.0, 2.0]")).otherwise(F.to_json("embedding"))
    signatures = rows.select("photo_id", "face_index", text.alias("signature"), F.when(c("vec_id") % 3 == 0, "v1").otherwise("v2").alias("version"))
    photos = rows.filter("photo_id % 5 <> 0").select(c("photo_id").alias("id"), F.lit("/p").alias("absolute_path")).distinct()
    return people.candidates(found, signatures, photos, "v2", 64).select("photo_id", "face_index")


@query("SELECT doc_id AS id FROM documents WHERE (doc_id % 4 = 0 AND lang IN ('en', 'de')) OR doc_id % 7 = 0")
def stale_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos whose file is gone from a volume that is there, and resource-fork twins."""
    name = F.concat(F.when(c("doc_id") % 7 == 0, "._").otherwise(""), c("doc_id").cast("string"), F.lit(".jpg"))
    rows = ad.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), F.concat(F.lit("/Volumes/"), "lang", F.lit("/"), name).alias("absolute_path"))
    mounted = spark.createDataFrame([("en",), ("de",)], "volume string")
    return state.stale(rows, rows.filter("id % 4 <> 0").select(c("absolute_path").alias("path")), mounted)


@query(f"WITH {ad.PHOTOS_SQL} SELECT absolute_path AS path FROM photos WHERE id % 3 = 0 AND lang <> 'fr'")
def missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are certainly gone, as their folder is there."""
    rows = ad.photos(spark, sf_dir).select("id", "lang", "source", c("absolute_path").alias("path"))
    folders = rows.filter("lang <> 'fr'").select(F.concat(F.lit("/library/"), "source", F.lit("/"), "lang").alias("path")).distinct()
    return state.missing(rows.select("path"), rows.filter("id % 3 <> 0").select("path"), folders)


@query(f"WITH {ad.BIN_SQL} SELECT photo_id AS id, '/trash/' || CAST(photo_id AS VARCHAR) AS absolute_path FROM bin JOIN documents ON doc_id = photo_id WHERE photo_id % 2 = 0")
def visible_bin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin rows whose file is there."""
    there = ad.table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.concat(F.lit("/trash/"), c("doc_id").cast("string")).alias("path"))
    return catalog.visible_bin(catalog.bin_list(ad.photos(spark, sf_dir), ad.bin_entries(spark, sf_dir)), there).select("id", "absolute_path")


@query(f"WITH {ad.SHOTS_SQL}, {ad.FACES_SQL}, now AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0) SELECT (SELECT count(*) FROM now) AS photos_checked, (SELECT count(*) FROM faces WHERE moment_id IN (SELECT k FROM now)) AS faces_detected")
def face_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos checked by this version, and their faces."""
    o = ad.table(spark, sf_dir, "orders")
    analysed = o.select(c("o_orderkey").alias("photo_id"), c("o_orderstatus").alias("analyzer_version"))
    return face.totals(ad.faces(spark, sf_dir), analysed, o.filter("o_custkey % 2 = 0").select(c("o_orderkey").alias("id")), "O")


@query(f"WITH {ad.PHOTOS_SQL}, d AS (SELECT p.id AS source_id, p.sha256, l.quality FROM labels l JOIN photos p ON p.id = l.doc_id) SELECT p.id, min(source_id) AS source_id, arg_min(quality, source_id) AS quality FROM photos p JOIN d ON d.sha256 = p.sha256 AND d.source_id <> p.id GROUP BY p.id")
def reused_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysis of another photo with the same contents."""
    photos = ad.photos(spark, sf_dir).select("id", "sha256")
    done = ad.table(spark, sf_dir, "labels").select(c("doc_id").alias("id"), "quality").join(photos, "id").select(c("id").alias("photo_id"), "sha256", "quality")
    return catalog.reusable(photos, done)


@query(f"WITH {ad.PHOTOS_SQL}, {ad.RECS_SQL} SELECT source AS moment_id, string_agg(CAST(id AS VARCHAR) || coalesce(r.decision, ''), ' ' ORDER BY created_at, id) AS photos FROM photos p LEFT JOIN recs r ON r.photo_id = p.id GROUP BY source")
def listed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments (sources) with their photos in order and the decisions."""
    photos = ad.photos(spark, sf_dir).withColumn("moment_id", c("source"))
    groups = photos.groupBy("moment_id").agg(F.min("created_at").alias("start_time"))
    listed = moments.with_photos(groups, photos, ad.recommendations(spark, sf_dir))
    return listed.select("moment_id", F.array_join(F.transform("photos", lambda x: F.concat(x["id"].cast("string"), F.coalesce(x["decision"], F.lit("")))), " ").alias("photos"))


@query(f"""WITH {ad.PHOTOS_SQL}, {ad.RECS_SQL}, {ad.KEPT_SQL} SELECT source AS moment_id, id AS keeper_id FROM photos p LEFT JOIN recs r ON r.photo_id = p.id LEFT JOIN kept k ON k.photo_id = p.id
QUALIFY row_number() OVER (PARTITION BY source ORDER BY k.photo_id IS NULL, coalesce(r.decision, '') <> 'KEEP', created_at, id) = 1""")
def comparison_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photo that others of its moment are compared with."""
    kept = ad.protected(spark, sf_dir).select(c("photo_id").alias("id"), F.lit(True).alias("is_kept"))
    photos = ad.photos(spark, sf_dir).withColumn("moment_id", c("source")).join(kept, "id", "left").withColumn("is_kept", F.coalesce("is_kept", F.lit(False)))
    return moments.comparison_keeper(photos, ad.recommendations(spark, sf_dir))


@query(f"WITH {ad.RECS_SQL} SELECT photo_id, decision FROM recs JOIN documents ON doc_id = photo_id WHERE photo_id % 3 <> 0 AND lang = CASE WHEN photo_id % 2 = 0 THEN 'en' ELSE lang END")
def fitting_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations whose photo is still in the same moment."""
    lang = ad.table(spark, sf_dir, "documents").select(c("doc_id").alias("photo_id"), "lang")
    recs = ad.recommendations(spark, sf_dir).join(lang, "photo_id").select("photo_id", F.when(c("photo_id") % 2 == 0, "en").otherwise(c("lang")).alias("moment_id"), "decision")
    photos = lang.select(c("photo_id").alias("id"), F.when(c("photo_id") % 3 != 0, c("lang")).alias("moment_id"))
    return moments.stale_recommendations(recs, photos).select("photo_id", "decision")


PEOPLE_SQL = "f AS (SELECT vec_id AS id, vec_id // 2 AS photo_id, 'p' || CAST(vec_id % 60 AS VARCHAR) AS person_key FROM embeddings WHERE vec_id // 2 % 3 <> 0)"


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), F.floor(c("vec_id") / 2).alias("photo_id"), F.concat(F.lit("p"), (c("vec_id") % 60).cast("string")).alias("person_key"))
    return people.with_photos(rows, rows.filter("photo_id % 3 <> 0").select(c("photo_id").alias("id")).distinct())


@query(f"WITH {PEOPLE_SQL} SELECT person_key, count(*) AS size, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY photo_id, id) AS faces FROM f GROUP BY person_key HAVING count(*) >= 2")
def listed_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with the faces whose photos are still there."""
    return _people(spark, sf_dir).select("person_key", "size", F.array_join(F.transform("faces", lambda x: x["id"].cast("string")), " ").alias("faces"))


@query(f"WITH {PEOPLE_SQL}, g AS (SELECT person_key, list(id ORDER BY photo_id, id) AS v FROM f GROUP BY person_key HAVING count(*) >= 2) SELECT person_key, array_to_string(v[:3], ' ') AS shown, CAST(greatest(len(v) - 3, 0) AS INTEGER) AS more FROM g")
def people_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first faces of each person, and how many more there are."""
    return people.preview(_people(spark, sf_dir), 3).select("person_key", F.array_join(F.transform("faces", lambda x: x["id"].cast("string")), " ").alias("shown"), "more")


@query("SELECT vec_id // 2 AS filename, vec_id % 2 AS face_index, 'L' AS side, CASE WHEN vec_id % 3 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS pred, CASE WHEN vec_id % 5 > 0 THEN 'OPEN' END AS gt FROM embeddings")
def labelled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted eyes with their labels, where there are any."""
    rows = ad.table(spark, sf_dir, "embeddings").select("vec_id", F.floor(c("vec_id") / 2).alias("filename"), (c("vec_id") % 2).alias("face_index"), F.lit("L").alias("side"))
    predictions = rows.select("filename", "face_index", "side", F.when(c("vec_id") % 3 == 0, "OPEN").otherwise("CLOSED").alias("pred"))
    return evaluation.predictions_with_labels(predictions, rows.filter("vec_id % 5 > 0").select("filename", "face_index", "side", F.lit("OPEN").alias("gt")))


@query("SELECT doc_id AS id, CASE WHEN lang <> 'fr' THEN 'old' ELSE 'new' END AS state FROM documents")
def inserted_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were there stay, others come in."""
    rows = ad.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "lang")
    return state.inserted_new(rows.filter("lang <> 'fr'").select("id", F.lit("old").alias("state")), rows.select("id", F.lit("new").alias("state")).unionByName(rows.select("id", F.lit("new").alias("state"))), ("id",))


@query("SELECT doc_id AS id, CASE WHEN n_chars % 5 = 0 THEN 'error' ELSE 'technical_ready' END AS analysis_status FROM documents")
def statuses_after_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready where there is a hash, else an error."""
    rows = ad.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), F.when(c("n_chars") % 5 != 0, "00").alias("perceptual_hash"))
    return state.status_after_analysis(rows).select("id", "analysis_status")


@query("SELECT doc_id AS id, CASE WHEN n_chars % 5 <> 0 AND doc_id IN (SELECT doc_id FROM labels) THEN 'decision_ready' ELSE 'technical_ready' END AS analysis_status FROM documents")
def statuses_after_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready for a decision where there is one and a hash."""
    rows = ad.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), F.when(c("n_chars") % 5 != 0, "00").alias("perceptual_hash"), F.lit("technical_ready").alias("analysis_status"))
    return state.status_after_decisions(rows, ad.recommendations(spark, sf_dir)).select("id", "analysis_status")


@query(f"WITH {ad.BIN_SQL} SELECT 'photos' AS name, doc_id AS id FROM documents WHERE doc_id IN (SELECT photo_id FROM bin) UNION ALL SELECT 'labels', doc_id FROM labels WHERE doc_id IN (SELECT photo_id FROM bin)")
def reset_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty library but for what is in the bin."""
    recs = ad.recommendations(spark, sf_dir)
    tables = {"photos": ad.photos(spark, sf_dir), "recommendations": recs, "analysis": recs.select("photo_id"), "logical_photos": _pairs(spark, sf_dir)}
    out = state.reset(tables, ad.bin_entries(spark, sf_dir).select("photo_id"))
    rows = out["photos"].select(F.lit("photos").alias("name"), "id").union(out["analysis"].select(F.lit("labels"), "photo_id"))
    return rows.union(out["recommendations"].select(F.lit("recommendations"), "photo_id")).union(out["logical_photos"].select(F.lit("pairs"), "primary_id"))


@query(f"WITH {ad.PHOTOS_SQL} SELECT absolute_path AS path FROM photos WHERE id % 6 <> 0")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no row refers to."""
    rows = ad.photos(spark, sf_dir)
    return state.orphans(rows.select(c("absolute_path").alias("path")), rows.filter("id % 6 = 0").select(c("absolute_path").alias("path")))


@query("SELECT doc_id AS id, substr(text, 1, 500) AS reason FROM documents")
def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with reasons of at most 500 characters."""
    return state.errors(ad.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), c("text").alias("reason")))


@query("WITH l AS (SELECT user_id AS session_id, arg_max(event_type, event_id) AS status, arg_max(\"value\", event_id) AS v FROM events GROUP BY user_id) SELECT session_id, CASE WHEN status = 'click' THEN 'interrupted' ELSE status END AS status, v FROM l")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each session; what was running is interrupted."""
    log = ad.table(spark, sf_dir, "events").select(c("user_id").alias("session_id"), c("event_id").alias("seq"), F.when(c("event_type") == "click", "running").otherwise(c("event_type")).alias("status"), c("value").alias("v"))
    return state.interrupted(state.checkpoint(log))


@query("SELECT user_id AS session_id, arg_min(event_type, event_id) AS reason FROM events GROUP BY user_id")
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each session failed: its first error."""
    return catalog.first_error(ad.table(spark, sf_dir, "events").select(c("user_id").alias("session_id"), c("event_id").alias("id"), c("event_type").alias("reason")))


@query("SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(round(100.0 * (o_orderkey % 7) / (o_orderkey % 9)) AS INTEGER) END AS percent FROM orders")
def session_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent done of each session."""
    return catalog.progress(ad.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("session_id"), (c("o_orderkey") % 7).alias("processed_files"), (c("o_orderkey") % 9).alias("total_files")))


@query("SELECT page_id, 'data:text/html;base64,' || base64(encode(html)) AS url FROM pages")
def inline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as data addresses."""
    rows = ad.table(spark, sf_dir, "pages").select("page_id", c("html").cast("binary").alias("content"))
    return rows.select("page_id", files.data_url("content", "text/html").alias("url"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM pages""")
def escaped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they may stand in a page."""
    return ad.table(spark, sf_dir, "pages").select("page_id", scalar.html_escaped(c("html")).alias("html"))


WRONG_SQL = ad.EYES_SQL.replace("SELECT CASE", "SELECT d.doc_id, CASE", 1)


@query(f"""WITH {WRONG_SQL} SELECT CAST(doc_id AS VARCHAR) || '&lt;' AS filename, doc_id % 3 + 1 AS face, gt || ' → ' || pred AS what, printf('%.2f', confidence) AS confidence, printf('%.0fpx', face_size) AS face_size, CASE WHEN openness IS NULL THEN 'none' ELSE printf('%.3f', openness) END AS openness
FROM eyes WHERE (gt = 'OPEN' AND pred = 'CLOSED') OR (gt = 'CLOSED' AND pred = 'OPEN')""")
def wrong_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eyes that were told wrong, for a review."""
    rows = ad.eyes(spark, sf_dir, "doc_id").select("*", F.concat(c("doc_id").cast("string"), F.lit("<")).alias("filename"), (c("doc_id") % 3).alias("face_index"), F.lit("left").alias("side"))
    return evaluation.failures(rows).drop("side")


@query(f"WITH {ad.EYES_SQL} SELECT count(*) FILTER (gt <> 'IGNORE') >= 100 AS enough FROM eyes")
def enough_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an evaluation has eyes enough."""
    return evaluation.enough_row(ad.eyes(spark, sf_dir))


TRUTH_SQL = "t AS (SELECT doc_id AS filename, 0 AS face, CASE doc_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'IGNORE' ELSE '' END AS l, CASE doc_id % 5 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'IGNORE' ELSE '' END AS r FROM labels)"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda n: F.when(c("doc_id") % n == 0, "OPEN").when(c("doc_id") % n == 1, "CLOSED").when(c("doc_id") % n == 2, "IGNORE").otherwise("")
    return ad.table(spark, sf_dir, "labels").select(c("doc_id").alias("filename"), F.lit(0).alias("face"), kind(4).alias("left_eye"), kind(5).alias("right_eye"))


@query(f"""WITH {TRUTH_SQL}, n AS (SELECT count(DISTINCT filename) AS photos_reviewed, count(*) FILTER (l <> '' AND r <> '') AS faces_reviewed, CAST(sum((l = 'OPEN')::INT + (r = 'OPEN')::INT) AS BIGINT) AS "open", CAST(sum((l = 'CLOSED')::INT + (r = 'CLOSED')::INT) AS BIGINT) AS closed, CAST(sum((l = 'IGNORE')::INT + (r = 'IGNORE')::INT) AS BIGINT) AS "ignore" FROM t)
SELECT *, "open" + closed + "ignore" AS eyes_labelled, "open" + closed AS usable_eyes FROM n""")
def labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the labelling has come."""
    return evaluation.label_progress(_truth(spark, sf_dir))


@query(f"WITH {TRUTH_SQL} SELECT filename, face, CASE WHEN filename % 2 = 0 THEN 'CLOSED' ELSE l END AS left_eye, r AS right_eye FROM t")
def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after an update of some."""
    truth = _truth(spark, sf_dir)
    return state.labelled(truth, truth.filter("filename % 2 = 0").select("filename", "face", F.lit("CLOSED").alias("left_eye"), F.lit(None).cast("string").alias("right_eye")))


@query("""SELECT doc_id AS filename, CASE WHEN doc_id % 5 = 0 THEN 'error' WHEN n_chars % 4 = 0 THEN 'no_faces' ELSE 'face' END AS kind, CASE WHEN doc_id % 5 <> 0 AND n_chars % 4 > 0 THEN f END AS face_index
FROM documents, unnest(generate_series(0, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE greatest(CAST(n_chars % 4 AS BIGINT) - 1, 0) END)) AS u(f)""")
def label_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be labelled: each face, and photos without any."""
    faces = F.when(c("n_chars") % 4 > 0, F.sequence(F.lit(0).cast("long"), c("n_chars") % 4 - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = ad.table(spark, sf_dir, "documents").select(c("doc_id").alias("idx"), c("doc_id").alias("filename"), F.when(c("doc_id") % 5 == 0, "error").otherwise("ok").alias("status"), faces.alias("faces"))
    return evaluation.work_items(rows).select("filename", "kind", "face_index")


@query(f"WITH {TRUTH_SQL} SELECT coalesce(min(CASE WHEN l = '' OR r = '' THEN filename END), max(filename)) AS place FROM t")
def first_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first face that isn't labelled."""
    truth = _truth(spark, sf_dir)
    items = truth.select(c("filename").alias("place"), "filename", F.lit("face").alias("kind"), c("face").alias("face_index"))
    return evaluation.first_unlabelled(items, truth)


@query("SELECT min(doc_id) AS place FROM documents WHERE doc_id > 20 AND lang <> 'en'")
def next_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next item of another photo (a language)."""
    return evaluation.next_photo(ad.table(spark, sf_dir, "documents").select(c("doc_id").alias("place"), c("lang").alias("filename")), 20, "en")


@query("SELECT doc_id AS id FROM documents")
def pages_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that overlap, each photo once."""
    rows = ad.photos(spark, sf_dir).select("id", "lang")
    return catalog.merged_pages(rows.filter("id % 3 <> 0"), rows.filter("id % 2 = 0 or id % 3 = 0"), rows).select("id")


@query(f"""WITH {ad.SHOTS_SQL}, n AS (SELECT id, contrast, highlight, phash, lag(phash) OVER w AS q, lag(contrast) OVER w AS k, sha256, lag(sha256) OVER w AS z, lag(highlight) OVER w AS g FROM shots WINDOW w AS (PARTITION BY moment_id ORDER BY pos)),
d AS (SELECT id, bit_count(xor(CAST('0x' || phash AS UBIGINT), CAST('0x' || q AS UBIGINT))) AS d, CASE WHEN z IS NOT NULL AND id % 4 > 0 THEN bit_count(xor(CAST('0x' || substr(sha256, 1, 16) AS UBIGINT), CAST('0x' || substr(z, 1, 16) AS UBIGINT))) END AS p, contrast * 20 AS a, k * 20 AS b, abs(highlight - g) * 100 AS gap FROM n)
SELECT id, coalesce(CASE WHEN d IS NULL THEN false WHEN p IS NULL THEN d <= 12 WHEN a < 8.0 OR b < 8.0 THEN d <= 4 AND p <= 4 AND gap <= 20.0 ELSE (d <= 12 AND p <= 18) OR (p <= 8 AND d <= 24) END, false) AS alike FROM d""")
def visual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a photo looks like the one before it in its moment."""
    from pyspark.sql import Window

    w = Window.partitionBy("moment_id").orderBy("pos")
    before = lambda x: F.lag(x).over(w)
    digest = F.substring("sha256", 1, 16)
    rows = ad.shots(spark, sf_dir).select("id", scalar.hamming(c("perceptual_hash"), before("perceptual_hash")).alias("d"), F.when(c("id") % 4 > 0, scalar.hamming(digest, before(digest))).alias("p"), (c("contrast") * 20).alias("a"), (before("contrast") * 20).alias("b"), (F.abs(c("highlight_clipping") - before("highlight_clipping")) * 100).alias("gap"))
    return rows.select("id", scalar.visual_match(c("d"), c("p"), c("a"), c("b"), c("gap")).alias("alike"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT a.vec_id AS id, round(CASE WHEN a.vec_id % 9 = 0 THEN -1.0 ELSE list_dot_product(a.e, b.e) END, 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of neighbours; a vector of another size is unlike all."""
    rows = ad.table(spark, sf_dir, "embeddings")
    one = rows.select(c("vec_id").alias("id"), F.when(c("vec_id") % 9 == 0, F.slice("embedding", 1, 8)).otherwise(c("embedding")).alias("x"))
    two = rows.select((c("vec_id") - 1).alias("id"), c("embedding").alias("y"))
    return one.join(two, "id").select("id", r6(scalar.cosine(c("x"), c("y"), 64), "score"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 4 THEN epoch_us(o_orderdate + INTERVAL 61 SECOND) END AS us FROM orders")
def photo_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from the texts that cameras and catalogs use."""
    t = c("o_orderdate").cast("timestamp") + F.expr("INTERVAL 61 SECONDS")
    kinds = ["\"'yyyy:MM:dd HH:mm:ss'\"", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH.mm.ss"]
    kinds[0] = "yyyy:MM:dd HH:mm:ss"
    raw = F.when(c("o_orderkey") % 5 == 4, F.lit("noon"))
    for i, kind in enumerate(kinds):
        raw = raw.when(c("o_orderkey") % 5 == i, F.concat(F.lit('"' if i == 0 else " "), F.date_format(t, kind), F.lit('"' if i == 0 else " ")))
    return ad.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.unix_micros(scalar.photo_time(raw)).alias("us"))


@query(r"""WITH p AS (SELECT page_id, url, list_extract(string_split(url, '/'), -1) AS n FROM pages) SELECT page_id, lower(regexp_extract(url, '^(.*)/[^/]*$', 1)) AS dir, n AS name, lower(CASE WHEN regexp_matches(n, '^.+\.[^.]*$') THEN regexp_replace(n, '\.[^.]*$', '') ELSE n END) AS stem,
 CASE WHEN regexp_matches(n, '^.+\.[^.]*$') THEN lower(regexp_extract(n, '\.([^.]*)$', 1)) END AS extension FROM p""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, names, stems and extensions."""
    u = c("url")
    return ad.table(spark, sf_dir, "pages").select("page_id", scalar.directory(u).alias("dir"), scalar.file_name(u).alias("name"), scalar.stem(u).alias("stem"), scalar.extension(u).alias("extension"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 6 THEN l_discount * 10 END AS o, l_quantity AS px, 1 - l_tax AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN px < 24 OR o IS NULL THEN 'UNCERTAIN' WHEN o >= 0.52 THEN 'OPEN' WHEN o <= 0.38 THEN 'CLOSED' ELSE 'UNCERTAIN' END AS state,
 round(CASE WHEN px < 24 THEN 0.2 WHEN o IS NULL THEN 0.25 WHEN o >= 0.52 THEN least(1.0, greatest(0.0, (o - 0.52) / 0.35 + 0.55)) * v WHEN o <= 0.38 THEN least(1.0, greatest(0.0, (0.38 - o) / 0.35 + 0.55)) * v ELSE 0.45 * v END, 6) AS confidence FROM e""")
def eye_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of eyes from their openness."""
    told = scalar.eye_state(F.when(c("l_linenumber") != 6, c("l_discount") * 10), c("l_quantity"), 1 - c("l_tax"))
    return ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", told.alias("e")).select("l_orderkey", "l_linenumber", "l_partkey", c("e.state").alias("state"), r6(c("e.confidence"), "confidence"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS w, l_quantity + 5 AS h, 10.0 AS ny, l_discount * 100 AS lx, 12 + l_tax * 100 AS ly, 30.0 AS rx, 11.0 AS ry, l_quantity * 2 AS px FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN px >= 24 THEN least(1.0, greatest(0.0, sqrt((rx - lx) ** 2 + (ry - ly) ** 2) / greatest(w, 1.0) * 0.65 + (least(0.5, greatest(-0.5, (ny - (ly + ry) * 0.5) / greatest(h, 1.0))) + 0.15) * 0.35)) END, 6) AS smile,
 round(CASE WHEN px < 24 THEN 0.3 ELSE 1.0 END * least(1.0, px / 70.0), 6) AS confidence FROM e""")
def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smiles from landmarks."""
    q = c("l_quantity")
    told = scalar.expression(q, q + 5, F.lit(10.0), c("l_discount") * 100, 12 + c("l_tax") * 100, F.lit(30.0), F.lit(11.0), q * 2)
    return ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", told.alias("e")).select("l_orderkey", "l_linenumber", "l_partkey", r6(c("e.smile_score"), "smile"), r6(c("e.confidence"), "confidence"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS w, l_discount * 200 AS x, l_tax * 200 AS y FROM lineitem),
i AS (SELECT *, greatest(least(x + w, 40.0) - greatest(x, 10.0), 0) * greatest(least(y + 20, 30.0) - greatest(y, 5.0), 0) AS n FROM b) SELECT l_orderkey, l_linenumber, l_partkey, round(n / (w * 20 + 750 - n), 6) AS iou FROM i""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far boxes overlap with one box."""
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    own, other = box(c("l_discount") * 200, c("l_tax") * 200, c("l_quantity"), F.lit(20.0)), box(F.lit(10.0), F.lit(5.0), F.lit(30.0), F.lit(25.0))
    return ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(scalar.iou(own, other), "iou"))


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'Identical file contents; a keeper is available; Kept by you' WHEN 1 THEN 'a; b' WHEN 2 THEN 'plain text' ELSE '{"messages":["x"],"codes":["Other"]}' END AS said FROM documents""")
def said_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reasons as sentences: bundles, lists, and texts themselves."""
    made = decisions.reasoning(F.array(F.lit("ExactDuplicate"), F.lit("KeptByUser")))
    raw = F.when(c("doc_id") % 4 == 0, made).when(c("doc_id") % 4 == 1, F.lit('["a","b"]')).when(c("doc_id") % 4 == 2, F.lit("plain text")).otherwise(F.lit('{"messages":["x"],"codes":["Other"]}'))
    return ad.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), decisions.sentence(raw).alias("said"))


KINDS = [(b"\xff\xd8\xff\xe0", "a.jpg", "Jpeg"), (b"GIF89a..", "b.png", "Gif"), (b"II*\x00\x08\x00\x00\x00....", "c.NEF", "Nef"), (b"II*\x00\x08\x00\x00\x00....", "d.tif", "Tiff"), (b"....ftypheic" + b"." * 12, "e.heif", "Heif"), (b"RIFF....WEBP", "f", "WebP"), (b"no picture", "g.TIFF", "Tiff"), (b"no picture", "._h.txt", None)]


@query("SELECT doc_id AS id, CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if k is None else repr(k)}" for i, (_, _, k) in enumerate(KINDS)) + " END AS format, doc_id % 8 NOT IN (5, 7) AS is_photo, doc_id % 8 = 2 AS is_raw FROM documents")
def detected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by name and first bytes; whether a name is a photo's; whether its extension is a RAW one."""
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in KINDS]), (c("doc_id") % len(KINDS) + 1).cast("int"))
    rows = ad.table(spark, sf_dir, "documents").select("doc_id", pick(0).alias("content"), pick(1).alias("path"))
    return rows.select(c("doc_id").alias("id"), formats.detect(c("path"), c("content")).alias("format"), formats.is_photo_path(c("path")).alias("is_photo"), formats.is_raw(scalar.extension(c("path"))).alias("is_raw"))


@query(f"WITH {NAMED_SQL} SELECT id, CASE extension " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in formats.EXTENSIONS.items()) + f" END AS format, extension IN ({', '.join(repr(e) for e, n in formats.EXTENSIONS.items() if n in formats.RAW)}) AS is_raw FROM named")
def format_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of each file by the dimension of extensions."""
    dim = formats.format_dim(spark)  # of fixed size
    return named_files(spark, sf_dir).withColumn("extension", F.lower("extension")).join(F.broadcast(dim), "extension").select("id", "format", "is_raw")


def _heads() -> list[tuple[bytes, str]]:
    """First bytes of each known signature, and its format."""
    out = []
    for places, name in [*formats.MAGIC, *formats.MAGIC_LATE]:
        head = bytearray(max(o + len(b) for o, b in places))
        for o, b in places:
            head[o : o + len(b)] = b
        out.append((bytes(head), name))
    out += [(bytes(4) + b"ftyp" + brand.encode("latin-1") + bytes(4), name) for brand, name in formats.BRANDS.items()]
    return out + [(order + bytes(4) + mark, name) for mark, name in formats.TIFF_MARKS.items() for order in (b"II*\0", b"MM\0*")]


HEADS = _heads()


@query(f"SELECT doc_id AS id, [{', '.join(repr(n) for _, n in HEADS)}][doc_id % {len(HEADS)} + 1] AS format FROM documents")
def sniffed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by first bytes: each document's bytes behind one of all signatures, without a name that tells more."""
    head = F.element_at(F.array(*[F.lit(h) for h, _ in HEADS]), (c("doc_id") % len(HEADS) + 1).cast("int"))
    rows = ad.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), F.concat(head, c("text").cast("binary")).alias("content"))
    return rows.select("id", formats.detect(F.lit("file"), c("content")).alias("format"))


@query(f"""WITH RECURSIVE {ad.BITS_SQL}, p AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 's' || CAST(vec_id % 21 AS VARCHAR) ELSE '' END AS s, h & 72057594037927935::UBIGINT AS h FROM bits),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND ((a.s <> '' AND a.s = b.s) OR bit_count(xor(a.h, b.h)) <= 12)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b), m AS (SELECT a AS id, least(a, min(b)) AS group_id FROM reach GROUP BY a),
g AS (SELECT group_id, count(*) AS n, count(*) FILTER (s <> '') AS k, min(s) FILTER (s <> '') AS x, max(s) FILTER (s <> '') AS y FROM m JOIN p ON p.id = m.id GROUP BY group_id)
SELECT id, m.group_id, CASE WHEN k = n AND x = y THEN 'exact' ELSE 'similar' END AS kind, n AS group_count FROM m JOIN g ON g.group_id = m.group_id""")
def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of photos with equal contents or looks that match; the looks are 56 bits, so that some are near."""
    bits = c("bits").bitwiseAND(F.lit((1 << 56) - 1))
    hashes = ad.sign_hashes(spark, sf_dir)
    content = F.when(c("id") % 7 == 0, F.concat(F.lit("s"), (c("id") % 21).cast("string"))).otherwise("")
    # Both hashes are the same bits: the rule then asks for 12 at most.
    rows = hashes.select("id", content.alias("sha256"), F.lpad(F.hex(bits), 16, "0").alias("perceptual_hash"), bits.alias("phash"), F.lit(50.0).alias("contrast"), *[F.lit(0.0).alias(x) for x in ("red", "green", "blue")])
    return duplicates.grouped(rows, duplicates.links(rows)).select("id", "group_id", "kind", "group_count")


@query(f"WITH {ad.SHOTS_SQL} SELECT id, row_number() OVER (PARTITION BY moment_id ORDER BY is_kept DESC, 0.35 * sharpness + 0.10 * (1.0 - least(1.0, highlight + shadow)) + CASE WHEN exposure BETWEEN 0.25 AND 0.85 THEN 0.05 ELSE 0.0 END DESC, id) AS place FROM shots")
def score_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each photo among those of its moment."""
    rows = ad.shots(spark, sf_dir)
    for name in ("average_face_sharpness", "average_expression_score", "first_smile"):
        rows = rows.withColumn(name, F.lit(None).cast("double"))
    return decisions.keeper_scores(rows.withColumn("face_count", F.lit(0))).select("id", c("place").cast("long").alias("place"))
