"""Queries over the driver's tables: groups after changes, places in an order, boxes of a detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.operators import alignment, catalog, decisions, detection, duplicates, guard, images, incremental, ranks, state
from argentum.operators import faces as face
from argentum.plans import adapters as ad
from argentum.plans.queries import MOMENTS_SQL
from argentum.plans.registry import query
from argentum.plans.shared import cut, place
from argentum.sources import files

c = F.col

LEFT = "(SELECT * FROM events WHERE event_id % 89 <> 0 OR event_id % 97 = 0)"


@query(f"WITH RECURSIVE {MOMENTS_SQL.replace('FROM events', f'FROM {LEFT}')} SELECT event_id, st AS segment FROM r")
def moments_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of events after some have come and others have gone: days in reach are cut again, the rest is kept."""
    rows = ad.event_photos(spark, sf_dir).select("id", "t")
    late, gone = c("id") % 97 == 0, (c("id") % 89 == 0) & (c("id") % 97 != 0)
    old = incremental.moments_of(rows.filter(~late), parts=spark.sparkContext.defaultParallelism)
    now, _ = incremental.change_moments(old, rows.filter(late), rows.filter(gone), parts=spark.sparkContext.defaultParallelism)
    return now.rows.select(c("id").alias("event_id"), "segment")


@query(f"""WITH RECURSIVE {ad.HASHES_SQL}, {ad.EDGES_SQL}, near AS MATERIALIZED (SELECT a, b FROM edges WHERE distance <= 18 AND (a % 17 <> 0 OR a % 13 = 0) AND (b % 17 <> 0 OR b % 13 = 0)), sym AS MATERIALIZED (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a AS id, a AS r FROM sym UNION SELECT s.b, reach.r FROM reach JOIN sym s ON s.a = reach.id)
SELECT id, min(r) AS component FROM reach GROUP BY id""")
def groups_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near hashes after some have come and others have gone: groups in reach are found again, the rest is kept."""
    before, after = c("id") % 13 != 0, (c("id") % 17 != 0) | (c("id") % 13 == 0)
    links = cut(duplicates.near_hashes_of(ad.sign_hashes(spark, sf_dir), 18, (before, after)), "near")
    late = (c("a") % 13 == 0) | (c("b") % 13 == 0)
    old = incremental.groups_of(links.filter(~late))
    gone = old.members.filter("id % 17 = 0 and id % 13 <> 0").select("id", "component")
    alone = ad.sign_hashes(spark, sf_dir).filter("id % 17 = 0 and id % 13 <> 0").join(gone, "id", "left_anti").select("id", F.lit(None).cast("long").alias("component"))
    now, _ = incremental.change_groups(old, links.filter(late), gone.union(alone))
    return now.members.select("id", "component")


@query(f"WITH {ad.PHOTOS_SQL}, {ad.BIN_SQL} SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM photos WHERE id NOT IN (SELECT photo_id FROM bin)")
def library_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each photo in the library's order."""
    rows = catalog.active(ad.photos(spark, sf_dir), ad.bin_entries(spark, sf_dir)).select("id", "created_at")
    return ranks.ranked(rows, (F.desc("created_at"), c("id")), spark.sparkContext.defaultParallelism).placed("place").select("id", c("place").cast("long").alias("place"))


@query(f"WITH {ad.PHOTOS_SQL}, {ad.BIN_SQL} SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM photos WHERE id NOT IN (SELECT photo_id FROM bin) ORDER BY created_at DESC, id LIMIT 40 OFFSET 120")
def library_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far down, from the ranges that hold it; each row says which place it has, so that a page in another order differs."""
    rows = catalog.active(ad.photos(spark, sf_dir), ad.bin_entries(spark, sf_dir)).select("id", "created_at")
    page = ranks.ranked(rows, (F.desc("created_at"), c("id")), spark.sparkContext.defaultParallelism).page(120, 40)
    return catalog.numbered(page, 121, "place").select("id", "place")


BOXES_SQL = """boxes AS (SELECT moment_id AS image_id, pos AS box_id, l_discount AS score, CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 30 AS DOUBLE) AS y, contrast * 100.0 AS width, CAST(l_partkey % 23 + 4 AS DOUBLE) AS height FROM shots),
q AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS n FROM boxes),
m AS (SELECT image_id, n, box_id, true AS won, [{'x': x, 'y': y, 'w': width, 'h': height}] AS kept FROM q WHERE n = 1 UNION ALL
 SELECT image_id, n, box_id, NOT hit, CASE WHEN hit THEN kept ELSE list_append(kept, s) END FROM (SELECT q.image_id, q.n, q.box_id, m.kept, {'x': q.x, 'y': q.y, 'w': q.width, 'h': q.height} AS s,
  len(list_filter(m.kept, lambda k: greatest(least(k.x + k.w, q.x + q.width) - greatest(k.x, q.x), 0) * greatest(least(k.y + k.h, q.y + q.height) - greatest(k.y, q.y), 0)
   / (k.w * k.h + q.width * q.height - greatest(least(k.x + k.w, q.x + q.width) - greatest(k.x, q.x), 0) * greatest(least(k.y + k.h, q.y + q.height) - greatest(k.y, q.y), 0)) > 0.3)) > 0 AS hit FROM m JOIN q ON q.image_id = m.image_id AND q.n = m.n + 1))"""


@query(f"WITH RECURSIVE {ad.SHOTS_SQL}, {BOXES_SQL} SELECT image_id, box_id FROM m WHERE won")
def kept_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each image that overlap no better one too much."""
    rows = ad.shots(spark, sf_dir)
    boxes = rows.select(c("moment_id").alias("image_id"), c("pos").alias("box_id"), c("l_discount").alias("score"), (c("l_partkey") % 40).cast("double").alias("x"), (c("l_suppkey") % 30).cast("double").alias("y"), (c("contrast") * 100.0).alias("width"), (c("l_partkey") % 23 + 4).cast("double").alias("height"))
    return face.suppressed(boxes).select("image_id", "box_id")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 8) AS e FROM embeddings),
k AS (SELECT vec_id AS image_id, k AS cell, sqrt(greatest(0, least(1, abs(e[k + 1]))) * greatest(0, least(1, abs(e[k + 5])))) AS score, k % 2 AS col, k // 2 AS r, e, k FROM e, range(4) AS t(k)),
b AS (SELECT *, (col + e[9 + 4 * k]) * 32 AS cx, (r + e[10 + 4 * k]) * 32 AS cy, exp(e[11 + 4 * k]) * 32 AS w, exp(e[12 + 4 * k]) * 32 AS h FROM k WHERE score >= 0.6)
SELECT image_id, CAST(cell AS INT) AS cell, round(score, 6) AS score, round((cx - w / 2) * 1.5, 6) AS x, round((cy - h / 2) * 0.75, 6) AS y, round(w * 1.5, 6) AS width, round(h * 0.75, 6) AS height,
 round((e[25 + 10 * k + 4] + col) * 48, 6) AS nose_x, round((e[25 + 10 * k + 5] + r) * 24, 6) AS nose_y FROM b""")
def head_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes decoded from vectors that serve as a detector's heads of two by two cells."""
    e = F.transform("embedding", lambda x: x.cast("double") * 8)
    size = lambda a: F.transform(a, F.abs)
    heads = ad.table(spark, sf_dir, "embeddings").select(c("vec_id").alias("image_id"), F.lit(32).alias("stride"), size(F.slice(e, 1, 4)).alias("cls"), size(F.slice(e, 5, 4)).alias("obj"), F.slice(e, 9, 16).alias("bbox"), F.slice(e, 25, 40).alias("kps"), F.lit(1.5).alias("scale_x"), F.lit(0.75).alias("scale_y"))
    r6 = lambda x, name: F.round(x, 6).alias(name)
    return detection.decoded(heads, 64).select("image_id", "cell", *[r6(c(n), n) for n in ("score", "x", "y", "width", "height")], r6(c("nose.x"), "nose_x"), r6(c("nose.y"), "nose_y"))


@query(f"""WITH {ad.SHOTS_SQL}, f AS (SELECT id, moment_id, thumb, l_partkey % 3 AS faces FROM shots), k AS (SELECT moment_id, faces, count(*) AS n FROM f WHERE faces > 0 GROUP BY 1, 2),
u AS (SELECT moment_id, faces AS usual FROM k QUALIFY row_number() OVER (PARTITION BY moment_id ORDER BY n DESC, faces DESC) = 1)
SELECT id AS photo_id FROM f JOIN u ON u.moment_id = f.moment_id WHERE faces > 0 AND faces + 1 = usual AND f.moment_id IN (SELECT moment_id FROM f WHERE thumb IS NOT NULL)""")
def face_count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with one face less than is usual in their moment."""
    rows = ad.shots(spark, sf_dir).withColumn("face_count", c("l_partkey") % 3)
    return decisions.count_mismatches(rows).select("photo_id")


#: Five points of a face from a line of an order, as SQL and as columns: around the template, moved, and scaled by the quantity.
SPOTS = [(x, y, i) for i, (x, y) in enumerate(alignment.TEMPLATE)]
SPOT_SQL = {axis: ", ".join(f"({p[k]} + (l_partkey * {7 + p[2] + 5 * k} % 11) * 0.7) * l_quantity / 20 + l_suppkey % {13 + k}" for p in SPOTS) for k, axis in enumerate("xy")}
TURNED_SQL = f"""p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, [{SPOT_SQL["x"]}] AS x, [{SPOT_SQL["y"]}] AS y FROM lineitem),
u AS (SELECT [{", ".join(str(x) for x, _ in alignment.TEMPLATE)}] AS u, [{", ".join(str(y) for _, y in alignment.TEMPLATE)}] AS v),
m AS (SELECT *, list_avg(x) AS mx, list_avg(y) AS my, list_avg(u) AS mu, list_avg(v) AS mv FROM p, u),
s AS (SELECT *, list_sum(list_transform(range(1, 6), lambda i: (x[i] - mx) * (u[i] - mu) + (y[i] - my) * (v[i] - mv))) AS d, list_sum(list_transform(range(1, 6), lambda i: (x[i] - mx) * (v[i] - mv) - (y[i] - my) * (u[i] - mu))) AS c,
 list_sum(list_transform(range(1, 6), lambda i: (x[i] - mx) ** 2 + (y[i] - my) ** 2)) AS n FROM m)"""


@query(f"WITH {TURNED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(d / n, 6) + 0.0 AS a, round(c / n, 6) + 0.0 AS b, round(mu - d / n * mx + c / n * my, 6) + 0.0 AS tx, round(mv - c / n * mx - d / n * my, 6) + 0.0 AS ty FROM s WHERE l_quantity >= 24 AND n >= 1")
def face_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn and scale that brings the points of each large face to their places."""
    rows = ad.table(spark, sf_dir, "lineitem").filter("l_quantity >= 24")
    place = lambda p, k: (F.lit(p[k]) + (c("l_partkey") * (7 + p[2] + 5 * k) % 11) * 0.7) * c("l_quantity") / 20 + c("l_suppkey") % (13 + k)
    points = F.array(*[F.struct(place(p, 0).alias("x"), place(p, 1).alias("y")) for p in SPOTS])
    found = alignment.turned(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), points)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", *[(F.round(x, 6) + 0.0).alias(x) for x in ("a", "b", "tx", "ty")])


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT vec_id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last, round(list_sum(list_transform(v, lambda x: (x / n) ** 2)), 6) AS length FROM n WHERE n >= 1e-8""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors at length 1."""
    rows = ad.table(spark, sf_dir, "embeddings").select("vec_id", alignment.unit(F.transform("embedding", lambda x: x.cast("double") * (1 + c("vec_id") % 5)), 64).alias("v")).filter("v is not null")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("vec_id", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 63), 6).alias("last"), F.round(length, 6).alias("length"))


WIDE, HIGH = 16, 8
PIXELS_SQL = f"""h AS (SELECT page_id AS id, rpad(substr(hex(encode(html)), 1, {6 * WIDE * HIGH}), {6 * WIDE * HIGH}, '0') AS h FROM pages),
b AS (SELECT id, list_transform(range(0, {3 * WIDE * HIGH}), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INT)) AS b FROM h),
g AS (SELECT id, list_transform(range(0, {WIDE * HIGH}), lambda i: (2126 * b[3 * i + 1] + 7152 * b[3 * i + 2] + 722 * b[3 * i + 3]) // 10000) AS g,
 list_transform(range(0, {WIDE * HIGH}), lambda i: CASE WHEN greatest(b[3 * i + 1], b[3 * i + 2], b[3 * i + 3]) > 0 THEN (greatest(b[3 * i + 1], b[3 * i + 2], b[3 * i + 3]) - least(b[3 * i + 1], b[3 * i + 2], b[3 * i + 3]))::DOUBLE / greatest(b[3 * i + 1], b[3 * i + 2], b[3 * i + 3]) ELSE 0 END) AS s FROM b),
l AS (SELECT *, list_transform(list_filter(range(0, {WIDE * HIGH}), lambda i: i // {WIDE} BETWEEN 1 AND {HIGH - 2} AND i % {WIDE} BETWEEN 1 AND {WIDE - 2}), lambda i: g[i - {WIDE} + 1] + g[i + {WIDE} + 1] + g[i] + g[i + 2] - 4 * g[i + 1]) AS l FROM g)"""


@query(f"""WITH {PIXELS_SQL} SELECT id, round(list_avg(g) / 255, 6) AS exposure, round(list_aggregate(g, 'stddev_pop') / 127.5, 6) AS contrast, round(len(list_filter(g, lambda x: x < 10)) / {WIDE * HIGH}.0, 6) AS shadow_clipping, round(len(list_filter(g, lambda x: x > 245)) / {WIDE * HIGH}.0, 6) AS highlight_clipping,
 round(list_avg(s), 6) AS mean_saturation, CASE WHEN list_aggregate(g, 'stddev_pop') < 14 THEN 1.0 ELSE 0.0 END AS flat_fraction, round(least(1.0, list_aggregate(l, 'var_pop') / 1000), 6) AS sharpness,
 array_to_string(list_transform(range(0, {HIGH}), lambda y: printf('%02x', CAST(list_sum(list_transform(range(0, 8), lambda k: CASE WHEN g[y * {WIDE} + CAST(floor((k + 0.5) * {WIDE} / 9) AS INT) + 1] > g[y * {WIDE} + CAST(floor((k + 1.5) * {WIDE} / 9) AS INT) + 1] THEN 1 << k ELSE 0 END)) AS INT))), '') AS perceptual_hash FROM l""")
def picture_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of small pictures whose pixels are the bytes of pages."""
    pixels = F.unhex(F.rpad(F.substring(F.hex(c("html").cast("binary")), 1, 6 * WIDE * HIGH), 6 * WIDE * HIGH, "0"))
    pictures = ad.table(spark, sf_dir, "pages").select(c("page_id").alias("id"), F.lit(WIDE).alias("width"), F.lit(HIGH).alias("height"), F.lit(None).cast("int").alias("orientation"), pixels.alias("pixels"))
    names = ("exposure", "contrast", "shadow_clipping", "highlight_clipping", "mean_saturation", "flat_fraction", "sharpness")
    return images.measure(pictures).select("id", *[F.round(n, 6).alias(n) for n in names], "perceptual_hash")


@query("""WITH o AS (SELECT vec_id // 2 AS photo_id, vec_id % 2 AS face_index, 'v1' AS version, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id % 5 <> 0), n AS (SELECT vec_id // 2 AS photo_id, vec_id % 2 AS face_index, 'v2' AS version, embedding[2]::DOUBLE AS first FROM embeddings WHERE vec_id % 3 = 0)
SELECT photo_id, face_index, version, round(first, 6) AS first FROM n UNION ALL SELECT photo_id, face_index, version, round(first, 6) FROM o WHERE (photo_id, face_index) NOT IN (SELECT (photo_id, face_index) FROM n)""")
def upserted_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of faces put into the catalog: photo and face together are the key."""
    face_of = [F.floor(c("vec_id") / 2).alias("photo_id"), (c("vec_id") % 2).alias("face_index")]
    rows = ad.table(spark, sf_dir, "embeddings")
    side = lambda keep, version, i: rows.filter(keep).select(*face_of, F.lit(version).alias("version"), F.round(F.get("embedding", i).cast("double"), 6).alias("first"))
    return state.upserted(side("vec_id % 5 <> 0", "v1", 0), side("vec_id % 3 = 0", "v2", 1), ("photo_id", "face_index"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN 'Cam' || lang END AS camera_model, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 8 + 1 END AS orientation, CASE WHEN doc_id % 7 <> 0 THEN '2024:01:' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' 10:00:00' END AS capture_time FROM documents""")
def camera_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera metadata read from bytes: a TIFF directory of three entries made from each document, in either byte order."""
    small = c("doc_id") % 2 == 0

    def number(value, size: int):
        """A number's bytes in the row's order, as hexadecimal digits."""
        big = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
        return F.when(small, F.concat(*[F.substring(big, 2 * (size - i) - 1, 2) for i in range(size)])).otherwise(big)

    text = lambda x: F.concat(F.hex(F.encode(x, "UTF-8")), F.lit("00"))
    model, at = F.concat(F.lit("Cam"), "lang"), F.concat(F.lit("2024:01:"), F.lpad((c("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:00"))
    entry = lambda tag, kind, n, value: F.concat(number(F.lit(tag), 2), number(F.lit(kind), 2), number(n, 4), value)
    length = F.octet_length(model) + 1
    head = F.concat(F.when(small, "49492A00").otherwise("4D4D002A"), number(F.lit(8), 4), number(F.lit(3), 2))
    first = entry(0x0110, 2, length, number(F.lit(50), 4))
    second = entry(0x0112, 3, F.lit(1), F.concat(number(c("doc_id") % 8 + 1, 2), F.lit("0000")))
    third = entry(0x0132, 2, F.lit(20), number(length + 50, 4))
    content = F.when(c("doc_id") % 7 == 0, c("text").cast("binary")).otherwise(F.unhex(F.concat(head, first, second, third, F.lit("00000000"), text(model), text(at))))
    found = files.with_metadata(ad.table(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("path"), content.alias("content")))
    return found.select(c("path").cast("long").alias("id"), "camera_model", "orientation", "capture_time")


@query("""WITH t AS (SELECT doc_id, toxic, quality FROM labels)
SELECT CAST(doc_id AS VARCHAR) || '.jpg' AS filename, 0 AS face, CASE WHEN toxic = 1 THEN 'CLOSED' ELSE 'OPEN' END AS left_eye, CASE WHEN doc_id % 5 = 0 THEN 'SHUT' ELSE '' END AS right_eye, CASE WHEN doc_id % 5 = 0 THEN 'no such label' END AS problem FROM t WHERE doc_id % 4 = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR) || '.jpg', NULL, '', '', NULL FROM t WHERE doc_id % 4 = 1 UNION ALL SELECT NULL, NULL, NULL, NULL, 'not a JSON object' FROM t WHERE doc_id % 4 = 2""")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files: with faces, without, broken ones, and keys that are left out."""
    name = F.concat(c("doc_id").cast("string"), F.lit(".jpg"))
    faces = F.format_string('{"%s":[{"face":0,"left_eye":"%s"%s}],"_note":[]}', name, F.when(c("toxic") == 1, "CLOSED").otherwise("OPEN"), F.when(c("doc_id") % 5 == 0, ',"right_eye":"SHUT"').otherwise(""))
    value = F.when(c("doc_id") % 4 == 0, faces).when(c("doc_id") % 4 == 1, F.format_string('{"%s":[]}', name)).when(c("doc_id") % 4 == 2, "[1, 2").otherwise('{"_only":[]}')
    return files.ground_truth(ad.table(spark, sf_dir, "labels").select(value.alias("value")))


@query("SELECT p_name AS file, p_brand AS make, p_type AS model, p_size AS raw_width, CAST(floor(p_retailprice) AS INT) AS raw_height FROM part")
def raw_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of RAW files, written with tabs and read again."""
    path = place(spark, "manifest")
    rows = ad.table(spark, sf_dir, "part").select(c("p_name").alias("file"), c("p_brand").alias("make"), c("p_type").alias("model"), c("p_size").alias("raw_width"), F.floor("p_retailprice").cast("int").alias("raw_height"))
    rows.write.option("header", True).csv(path, sep="\t")
    return files.manifest(spark, path)


@query("""WITH w AS (SELECT p_partkey AS id, p_partkey * 3600 - 500000 AS s, p_partkey * 3600 - 500000 + CASE WHEN p_partkey % 200 = 0 THEN 400000 ELSE p_size * 150 END AS e FROM part)
SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id < b.id AND a.s <= b.e AND b.s <= a.e""")
def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of time windows that meet: most of some hours, a few of days."""
    start = c("p_partkey") * 3600 - 500_000
    end = start + F.when(c("p_partkey") % 200 == 0, 400_000).otherwise(c("p_size") * 150)
    rows = ad.table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.timestamp_seconds(start).alias("start_time"), F.timestamp_seconds(end).alias("end_time"))
    return guard.overlapping(rows, 900)
