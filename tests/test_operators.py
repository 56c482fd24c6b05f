"""Operators on literal rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from argentum.functions import scalar
from argentum.operators import catalog, decisions, duplicates, evaluation, guard, images, moments, pairs, people, state
from argentum.operators import faces as face
from argentum.sources import files, formats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("0" * 16, "0" * 16, 0), ("0" * 16, "f" * 16, 64), ("0" * 16, "0" * 15 + "1", 1), ("", "", None), ("00", "00", None), ("abc", "0" * 16, None), ("0" * 16, "0" * 15, None), ("z" * 16, "0" * 16, None), ("F" * 16, "f" * 16, 0)],
)
def test_hamming(spark, a, b, want):
    assert one(spark, scalar.hamming(lit(a), lit(b))) == want


def test_grades(spark):
    got = [one(spark, scalar.grade(lit(n))) for n in (0, 4, 5, 12, 13, 24, 25, 64)]
    assert got == ["near-identical"] * 2 + ["similar"] * 2 + ["related"] * 2 + ["distinct"] * 2


@pytest.mark.parametrize(
    ("measures", "want"),
    [
        ((0.5, 0.9, 0.2, 0.4, 0.0, 0.3, 0.1), "overexposed"),
        ((0.5, 0.1, 0.3, 0.0, 0.5, 0.3, 0.1), "underexposed"),
        ((0.8, 0.5, 0.5, 0.0, 0.0, 0.05, 0.7), "screenshot"),
        ((0.2, 0.7, 0.3, 0.0, 0.0, 0.05, 0.5), "document"),
        ((0.5, 0.5, 0.5, 0.0, 0.0, 0.5, 0.1), None),
    ],
)
def test_junk(spark, measures, want):
    got = one(spark, scalar.junk(*map(lit, measures)))
    assert (got and got["category"]) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2024-01-02T03:04:05Z", 5), ("2024-01-02T05:04:05+02:00", 5), ('"2024:01:02 03:04:05"', 5), ("2024.01.02 03:04:05", 5), ("2024-01-02 03:04:05", 5), ("2024-01-02 03:04:05.5", 5.5), (" ", None), ("yesterday", None), ("2024-13-02 03:04:05", None), (None, None)],
)
def test_photo_time(spark, raw, want):
    got = one(spark, scalar.photo_time(lit(raw).cast("string")))
    assert got == (None if want is None else dt.datetime(2024, 1, 2, 3, 4, int(want), round(want % 1 * 1e6)))


def test_paths(spark):
    rows = [("/a/B/IMG.One.JPG", "/a/b", "img.one", "jpg"), ("/a/.hidden", "/a", ".hidden", None), ("x", "", "x", None)]
    for path, d, s, e in rows:
        assert (one(spark, scalar.directory(lit(path))), one(spark, scalar.stem(lit(path))), one(spark, scalar.extension(lit(path)))) == (d, s, e)


def test_signature(spark):
    import hashlib

    ids = ["b", "aä"]
    want = hashlib.sha256(b"".join(len(i.encode()).to_bytes(8, "little") + i.encode() for i in sorted(ids))).hexdigest()
    assert one(spark, scalar.signature(F.array(*map(lit, ids)))) == want


def test_formats(spark):
    assert one(spark, formats.from_extension(lit("..JPEG"))) == "Jpeg" and one(spark, formats.from_extension(lit("txt"))) is None
    heads = [(b"\xff\xd8\xff\xe0", "Jpeg"), (b"RIFF0000WEBPxx", "WebP"), (b"0000ftypavif", "Avif"), (b"0000ftypcrx ", "Cr3"), (b"0000ftypzzzz", None), (b"II*\0....CR\x02\0", "Cr2"), (b"MM\0*00000000", "Tiff"), (b"FOVb", "X3f"), (b"", None), (b"BM", "Bmp")]
    for data, want in heads:
        assert one(spark, formats.sniff(lit(bytearray(data)))) == want
    tiff = lit(bytearray(b"II*\0abcdefgh"))
    assert one(spark, formats.detect(lit("a.dng"), tiff)) == "Dng" and one(spark, formats.detect(lit("a.jpg"), tiff)) == "Tiff"
    assert one(spark, formats.detect(lit("a.heif"), lit(bytearray(b"0000ftypheic")))) == "Heif" and one(spark, formats.detect(lit("a.png"), lit(bytearray(b"?")))) == "Png"
    assert [one(spark, formats.is_photo_path(lit(p))) for p in ("/a/._x.jpg", "/a/.x.jpg", "/a/x", "/a/x.NEF")] == [False, True, False, True]
    assert formats.registry(spark).count() == 43 and formats.registry(spark).filter("not analyze").count() == 2


PHOTO = "id string, absolute_path string, extension string, file_size long, capture_time string"


def photo(id_, path, size, when=None):
    return (id_, path, path.rsplit(".", 1)[-1], size, when)


def test_pairs(spark):
    rows = [
        photo("p1", "/d/A.NEF", 10),
        photo("p2", "/D/a.jpg", 5),
        photo("p3", "/e/a.jpg", 5),  # another folder
        photo("p4", "/f/b.cr2", 7),
        photo("p5", "/f/b.jpg", 7),  # same size
        photo("p6", "/g/c.arw", 9, "2024-01-01T00:00:00Z"),
        photo("p7", "/g/c.jpg", 3, "2024-01-01T00:02:01Z"),  # too late
        photo("p8", "/h/d.arw", 9, "2024-01-01T00:00:00Z"),
        photo("p9", "/h/d.jpg", 3, "2024-01-01T00:02:00.9Z"),  # 120 whole seconds
        photo("q1", "/i/e.arw", 9, "odd"),
        photo("q2", "/i/e.jpeg", 3, "2024-01-01T00:00:00Z"),
        photo("q3", "/i/e.jpg", 4, "2024-01-01T00:00:00Z"),
    ]
    got = {(r["primary_id"], r["paired_id"]): r["match_reason"] for r in pairs.logical_pairs(spark.createDataFrame(rows, PHOTO)).collect()}
    assert got == {("p1", "p2"): pairs.BY_NAME, ("p8", "p9"): pairs.BY_TIME, ("q1", "q2"): pairs.BY_TIME}


def timed(spark, rows):
    return spark.createDataFrame([(i, None if s is None else dt.datetime(2024, 1, 1, 10) + dt.timedelta(seconds=s)) for i, s in rows], "id string, t timestamp")


def test_moments(spark):
    got = moments.moments(timed(spark, [("a", 0), ("b", 90), ("c", 1500), ("n", None), ("m", None)])).collect()
    assert [(r["first_id"], r["last_id"], r["photo_count"]) for r in got] == [("a", "b", 2)]
    edges = [("a", 0), ("b", 180.9), ("c", 362), ("d", 400)]  # a gap counts whole seconds
    assert sorted((r["first_id"], r["last_id"]) for r in moments.moments(timed(spark, edges)).collect()) == [("a", "b"), ("c", "d")]
    assert moments.moments(timed(spark, [])).collect() == []


@pytest.mark.parametrize("parts", [1, 3])
def test_moments_match_a_plain_loop(spark, parts):
    rng = np.random.default_rng(parts)
    at = np.cumsum(rng.choice([1, 60, 120, 179, 180, 181, 400], 300)).tolist()
    rows = [(f"p{i:03}", float(s)) for i, s in enumerate(at)]
    want, now = [], []
    for i, s in rows:
        if now and not (s - now[-1][1] <= 180 and s - now[0][1] <= 900):
            want.append(now)
            now = []
        now.append((i, s))
    want = sorted((g[0][0], g[-1][0], len(g)) for g in [*want, now] if len(g) > 1)
    got = moments.moments(timed(spark, rows), parts=parts).collect()
    assert sorted((r["first_id"], r["last_id"], r["photo_count"]) for r in got) == want


@pytest.mark.parametrize("parts,steps", [(1, (5, 7, 30)), (6, (5, 7, 30)), (40, (5, 7, 30)), (9, (0, 0, 1)), (30, (0, 100, 170, 180)), (25, (0, 0, 0, 179, 181))])
def test_one_time_without_gaps_is_cut_by_many_ranges(spark, parts, steps):
    """One session over all ranges, ranges shorter and longer than a span, ties."""
    rng = np.random.default_rng(parts)
    at = np.cumsum(rng.choice(steps, 700)).tolist()
    rows = [(f"p{i:03}", float(s)) for i, s in enumerate(at)]
    start, want, last = None, {}, None
    for i, s in rows:
        if start is None or s - start > 900 or s - last > 180:
            start = s
        last = s
        want[i] = start
    got = moments.segments(timed(spark, rows), parts=parts).collect()
    low = min(r["segment"] for r in got)
    assert {r["id"]: (r["segment"] - low) / 1e6 for r in got} == {i: s - at[0] for i, s in want.items()}


def test_moment_ids_are_kept(spark):
    new = moments.moments(timed(spark, [("a", 0), ("b", 1)]))
    old = spark.createDataFrame([("old", "b"), ("old", "a")], "moment_id string, id string")
    for count, want in ((2, "old"), (3, new.first()["moment_id"])):
        assert moments.kept_ids(new, old, spark.createDataFrame([("old", count)], "id string, photo_count long")).first()["moment_id"] == want


DUP = "id string, absolute_path string, sha256 string, perceptual_hash string, file_size long, is_kept boolean"


def test_duplicates(spark):
    rows = [(f"u{i:04}", f"/u{i}", f"s{i}", f"{(i * 2654435761 * 40503) % (1 << 64):016x}", 1, False) for i in range(300)]
    rows += [("x1", "/b", "same", None, 5, False), ("x2", "/a", "same", "bad", 5, False), ("x3", "/c", "same", None, 5, True)]
    rows += [("y1", "/y1", "", "ffff000000000000", 7, False), ("y2", "/y2", None, "ffff000000000fff", 7, False), ("y3", "/y3", "z", "ffff0000ffffffff", 7, False)]
    photos = spark.createDataFrame(rows, DUP)
    groups = duplicates.grouped(photos, duplicates.links(photos)).join(photos, "id")
    got = {}
    for r in groups.collect():
        got.setdefault((r["kind"], r["group_id"]), []).append(r["id"])
    assert sorted(got[("exact", "x1")]) == ["x1", "x2", "x3"] and sorted(got[("similar", "y1")]) == ["y1", "y2"]
    members = groups.filter("group_id = 'x1'").select("id", "group_id", "kind", "absolute_path", "file_size", "is_kept")
    assert duplicates.keepers(members).first()["keeper_id"] == "x3"
    assert tuple(duplicates.cleanup(members).first()) == (2, 10)


def test_visual_rule(spark):
    flat = lambda d, p, gap: one(spark, scalar.visual_match(lit(d), lit(p), lit(3.0), lit(50.0), lit(gap)))
    rich = lambda d, p: one(spark, scalar.visual_match(lit(d), lit(p).cast("int"), lit(30.0), lit(50.0), lit(99.0)))
    assert [flat(4, 4, 20.0), flat(5, 4, 0.0), flat(4, 4, 21.0)] == [True, False, False]
    assert [rich(12, 18), rich(13, 18), rich(24, 8), rich(25, 8), rich(12, None), rich(13, None), rich(None, 0)] == [True, False, True, False, True, False, False]


SHOT = "id string, moment_id string, is_kept boolean, analysis_status string, thumbnail_path string, sha256 string, perceptual_hash string, sharpness double, exposure double, highlight_clipping double, shadow_clipping double"


def shot(id_, sharp, moment="m", kept=False, sha=None, thumb="t", status="technical_ready", bits="0" * 16):
    return (id_, moment, kept, status, thumb, sha or id_, bits, sharp, 0.5, 0.0, 0.0)


def decide(spark, rows, overrides=None, faces=None, **more):
    df = spark.createDataFrame(rows, SHOT)
    if faces:
        df = df.join(spark.createDataFrame([Row(**f) for f in faces]), "id", "left")
    over = spark.createDataFrame(overrides, "photo_id string, actual_decision string") if overrides else None
    return {r["photo_id"]: r for r in decisions.recommend(df, over, **more).collect()}


def test_decisions(spark):
    got = decide(spark, [shot("a", 0.8), shot("b", 0.1)])
    assert (got["a"]["decision"], got["b"]["decision"], got["b"]["compared_to"], got["a"]["best_of_group"]) == ("KEEP", "REVIEW", "a", 2)
    assert got["b"]["codes"] == ["SharpestInGroup", "NoBetterAlternative"] and got["a"]["codes"] == ["BestOfGroup", "SharpestInGroup", "GoodExposure"]
    got = decide(spark, [shot("a", 0.5, sha="s"), shot("b", 0.9, sha="s")])
    assert (got["a"]["decision"], got["b"]["decision"]) == ("REMOVE", "KEEP")
    got = decide(spark, [shot("a", 0.5, kept=True, sha="s"), shot("b", 0.9, sha="s")])
    assert (got["a"]["codes"], got["b"]["decision"], got["b"]["compared_to"]) == (["KeptByUser"], "REMOVE", "a")
    got = decide(spark, [shot("a", 0.5, moment=None, thumb=None), shot("b", 0.1, moment=None), shot("c", None, kept=True)])
    assert [(got[k]["decision"], got[k]["confidence"]) for k in "abc"] == [("REVIEW", 0.0), ("REVIEW", 0.55), ("KEEP", 1.0)]
    got = decide(spark, [shot("a", 0.8), shot("b", 0.79)])
    assert (got["a"]["confidence"], got["a"]["codes"][0]) == (0.62, "CloseComparison")


def test_overrides(spark):
    got = decide(spark, [shot("a", 0.8), shot("b", 0.1)], [("a", "REMOVE"), ("b", "KEEP")])
    assert (got["a"]["decision"], got["a"]["confidence"], got["b"]["decision"]) == ("REMOVE", 1.0, "KEEP")
    assert "Kept by you" in got["a"]["reasoning"] and got["a"]["codes"] != ["KeptByUser"]
    log = spark.createDataFrame([(1, "a", "KEEP"), (3, "a", "REVIEW"), (2, "a", "REMOVE")], "id long, photo_id string, actual_decision string")
    assert decisions.latest_override(log).first()["actual_decision"] == "REVIEW"


def test_faces_in_decisions(spark):
    faces = [dict(id="a", face_count=1, closed_eye_count=0, uncertain_eye_count=0, likely_all_eyes_open=True, average_face_sharpness=0.5, average_expression_score=0.5, first_smile=0.5), dict(id="b", face_count=1, closed_eye_count=1, uncertain_eye_count=0, likely_all_eyes_open=False, average_face_sharpness=0.2, average_expression_score=0.1, first_smile=0.1)]
    got = decide(spark, [shot("a", 0.8), shot("b", 0.7)], faces=faces)
    assert (got["b"]["decision"], got["b"]["confidence"]) == ("REMOVE", 0.82) and "AllEyesLikelyOpen" in got["a"]["codes"]
    got = decide(spark, [shot("a", 0.8), shot("b", 0.7)], faces=faces, eye_rules=False)
    assert got["b"]["decision"] == "REVIEW"


def test_reasons(spark):
    raw = one(spark, decisions.reasoning(F.array(lit("GoodExposure"), lit("KeptByUser"))))
    assert one(spark, decisions.messages(lit(raw))) == ["Exposure acceptable", "Kept by you"]
    assert one(spark, decisions.messages(lit('["x"]'))) == ["x"] and one(spark, decisions.sentence(lit("plain"))) == "plain"


FACE = "photo_id string, face_index long, left_state string, right_state string, face_sharpness double, smile_score double, expression_confidence double"


def test_face_metrics(spark):
    rows = [("a", 0, "OPEN", "OPEN", 0.4, 0.9, 0.5), ("a", 1, "OPEN", None, 0.6, 0.1, 0.4), ("b", 0, "odd", "CLOSED", None, None, None)]
    got = {r["photo_id"]: r for r in face.metrics(spark.createDataFrame(rows, FACE)).collect()}
    a, b = got["a"], got["b"]
    assert (a["face_count"], a["open_eye_face_count"], a["average_face_sharpness"], a["average_expression_score"], a["likely_all_eyes_open"]) == (2, 1, 0.5, 0.9, True)
    assert (b["closed_eye_count"], b["uncertain_eye_count"], b["average_face_sharpness"], b["likely_all_eyes_open"]) == (1, 1, None, False)
    n = spark.createDataFrame([("g", 1), ("g", 1), ("g", 3), ("g", 3), ("g", 0)], "grp string, face_count long")
    assert face.usual_count(n, "grp").first()["usual_face_count"] == 3


def test_suppression(spark):
    rows = [("i", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("i", 2, 0.8, 1.0, 1.0, 10.0, 10.0), ("i", 3, 0.7, 30.0, 0.0, 5.0, 5.0)]
    got = face.suppressed(spark.createDataFrame(rows, "image_id string, box_id long, score double, x double, y double, width double, height double"))
    assert sorted(r["box_id"] for r in got.collect()) == [1, 3]


def vectors(spark, rows):
    return spark.createDataFrame([(i, p, [float(x) for x in np.array(v) / np.linalg.norm(v)]) for i, p, v in rows], "id long, photo_id string, vector array<float>")


def test_people(spark):
    base, other = np.eye(8)[0], np.eye(8)[1]
    near = lambda v, k: v + 0.1 * np.eye(8)[k]
    rows = [(1, "a", near(base, 2)), (2, "b", near(base, 3)), (3, "c", near(base, 4)), (4, "a", near(other, 2)), (5, "b", near(other, 3)), (6, "a", near(base, 5))]
    got = {}
    for r in people.groups(vectors(spark, rows)).collect():
        got.setdefault(r["person_key"], []).append(r["id"])
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [4, 5]]
    # A bridge between two that are far apart joins only one of them.
    bridge = [(1, "a", [1, 0]), (2, "b", [0.78, 0.62]), (3, "c", [0.2, 0.98])]
    assert sorted(r["id"] for r in people.groups(vectors(spark, bridge)).collect()) in ([1, 2], [2, 3])
    assert people.groups(vectors(spark, []).limit(0)).collect() == []


def test_guard(spark):
    when = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    groups = spark.createDataFrame([("m1", when(0), when(100)), ("m2", when(100), when(200)), ("m3", when(500), when(600)), ("m4", None, when(50))], "id string, start_time timestamp, end_time timestamp")
    photos = spark.createDataFrame([(f"{m}{k}", m, "0" * 15 + str(k)) for m in ("m1", "m2", "m3", "m4") for k in (0, 1)], "id string, moment_id string, perceptual_hash string")
    got = guard.duplicate_moments(groups, photos).collect()
    assert [(r["moment_a"], r["moment_b"], r["shared_photo_pairs"]) for r in got] == [("m1", "m2", 4)]


EYE = "gt string, pred string, confidence double, face_size double, openness double"


def test_evaluation(spark):
    eyes = spark.createDataFrame([("OPEN", "CLOSED", 0.8, 50.0, 0.35), ("OPEN", "OPEN", 0.9, 100.0, 0.6), ("CLOSED", "UNCERTAIN", 0.4, 30.0, None), ("IGNORE", "OPEN", 0.9, 90.0, 0.7), ("odd", "OPEN", 0.1, 1.0, 0.1)], EYE)
    r = evaluation.report(eyes).first()
    assert (r["labelled_eyes"], r["ignored"], r["false_closed_rate"], r["coverage"], r["closed_recall"]) == (4, 1, 0.5, 2 / 3, 0.0)
    assert {x["bucket"]: x["false_closed"] for x in evaluation.by_size(eyes).collect()} == {"40–79px": 1, "80–119px": 0, "<40px": 0}
    assert evaluation.openness_histogram(eyes).first()["bucket"] == "0.30–0.40"
    assert not evaluation.enough(eyes) and evaluation.enough(eyes, 3)
    assert dict(evaluation.text_report(evaluation.report(eyes)).collect())["coverage"] == "66.7%"
    assert evaluation.report(eyes.limit(0)).first()["coverage"] == 0.0


def test_labels(spark, tmp_path):
    text = '{"_meta": {}, "a.jpg": [{"face": 0, "left_eye": "OPEN", "right_eye": "CLOSED"}, {"face": 1, "left_eye": "OPEN"}], "b.jpg": [], "c.jpg": null}'
    truth = files.ground_truth(spark.createDataFrame([(text,)], "value string"))
    assert truth.count() == 3 and truth.filter("problem is not null").count() == 0
    p = evaluation.label_progress(truth).first()
    assert (p["photos_reviewed"], p["faces_reviewed"], p["eyes_labelled"], p["usable_eyes"]) == (2, 1, 3, 3)
    bad = files.ground_truth(spark.createDataFrame([('{"a": [{"face": 0, "left_eye": "SHUT"}]}',), ("[]",), ("{",)], "value string"))
    assert bad.filter("problem is not null").count() == 3
    new = state.labelled(truth.drop("problem").filter("face is not null"), spark.createDataFrame([("a.jpg", 1, None, "IGNORE")], "filename string, face int, left_eye string, right_eye string"))
    assert {(r["face"], r["left_eye"], r["right_eye"]) for r in new.collect()} == {(0, "OPEN", "CLOSED"), (1, "OPEN", "IGNORE")}
    items = evaluation.work_items(spark.createDataFrame([(0, "a.jpg", "ok", [0, 1]), (1, "b.jpg", "ok", []), (2, "d.jpg", "missing", None)], "idx int, filename string, status string, faces array<int>"))
    assert [tuple(r)[2:] for r in items.orderBy("idx", "face_index").collect()] == [("face", 0), ("face", 1), ("no_faces", None), ("missing", None)]
    placed = items.withColumn("place", F.col("idx") * 2 + F.coalesce("face_index", F.lit(0)))
    assert evaluation.first_unlabelled(placed, truth).first()["place"] == 1 and evaluation.next_photo(placed, 1, "a.jpg").first()["place"] == 2


def test_state(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    old = spark.createDataFrame([(1, "/a", "ready"), (2, "/b", "ready")], "id long, absolute_path string, analysis_status string")
    new = spark.createDataFrame([(9, "/b", "x"), (3, "/c", "x")], "id long, absolute_path string, analysis_status string")
    assert {(r["id"], r["analysis_status"]) for r in state.scanned(old, new).collect()} == {(1, "ready"), (2, "pending"), (3, "pending")}
    recs = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "photo_id long, moment_id long")
    photos = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id long, moment_id long")
    couple = spark.createDataFrame([(1, 3)], "primary_id long, paired_id long")
    out = state.purged({"photos": photos, "recommendations": recs, "logical_photos": couple}, ids(1))
    assert [out[k].count() for k in ("photos", "recommendations", "logical_photos")] == [2, 1, 0]
    lib = spark.createDataFrame([(1, "/a", False), (2, "/b", True)], "id long, absolute_path string, is_kept boolean")
    none = spark.createDataFrame([], "photo_id long, original_path string, trash_path string, deleted_at string, state string")
    binned = state.moved_to_bin(lib, none, ids(1, 2), "now")
    assert [r["photo_id"] for r in binned.collect()] == [1]
    assert [r["id"] for r in catalog.active(lib, binned).collect()] == [2]
    keep = state.chosen_keeper(spark.createDataFrame([(2,)], "photo_id long"), lib, ids(1, 2), 1)
    assert [r["photo_id"] for r in keep.collect()] == [1]
    with pytest.raises(ValueError):
        state.chosen_keeper(keep, lib, ids(1), 2)
    paths = spark.createDataFrame([("/b",)], "path string")
    assert {r["id"] for r in state.stale(spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/Volumes/X/c"), (4, "/._b")], "id long, absolute_path string"), paths.union(spark.createDataFrame([("/._b",)], "path string")), spark.createDataFrame([("Y",)], "volume string")).collect()} == {1, 4}
    trash = spark.createDataFrame([(1, "/a", "/t/1", "h"), (2, "/b", "/t/2", "h"), (3, "/c", "/t/3", "h")], "photo_id long, original_path string, trash_path string, sha256 string")
    there = spark.createDataFrame([("/t/1", "h"), ("/t/2", "h"), ("/b", "x"), ("/t/3", "changed")], "path string, sha256 string")
    assert {r["photo_id"] for r in state.recovered(trash, ids(1, 2, 3), there).collect()} == {2, 3}


def test_pages(spark):
    rows = spark.createDataFrame([(f"{i:05}", None, "same") for i in range(1005)], "id string, capture_time string, created_at string")
    seen = [r["id"] for k in range(0, 1005, 200) for r in catalog.page(rows, k, 200).collect()]
    assert seen == [f"{i:05}" for i in range(1005)]
    assert catalog.page(rows, -5, 9999).count() == 500 and catalog.page(rows, 0, 0).count() == 1


def test_reuse(spark):
    photos = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "id long, sha256 string")
    done = spark.createDataFrame([(1, "s", 0.5), (2, "s", 0.6)], "photo_id long, sha256 string, sharpness double")
    assert {(r["id"], r["source_id"]) for r in catalog.reusable(photos, done).collect()} == {(1, 2), (2, 1)}


def test_pictures(spark):
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    white = np.full((32, 32, 3), 255, np.uint8)
    rows = [("n", 60, 40, 1, bytearray(noise.tobytes())), ("t", 60, 40, 6, bytearray(noise.tobytes())), ("w", 32, 32, None, bytearray(white.tobytes())), ("x", 5, 5, 1, bytearray(b"abc")), ("z", None, 5, 1, None)]
    got = {r["id"]: r for r in images.measure(spark.createDataFrame(rows, "id string, width int, height int, orientation int, pixels binary")).collect()}
    assert got["w"]["highlight_clipping"] == 1.0 and got["w"]["flat_fraction"] == 1.0 and got["w"]["perceptual_hash"] == "0" * 16
    assert got["n"]["sharpness"] == 1.0 and len(got["n"]["perceptual_hash"]) == 16 and got["n"]["perceptual_hash"] != got["t"]["perceptual_hash"]
    assert got["x"]["error"] and got["z"]["error"] and got["x"]["sharpness"] is None
    assert [images.oriented(noise, k).shape[:2] for k in (1, 3, 5, 6, 8)] == [(40, 60), (40, 60), (60, 40), (60, 40), (60, 40)]


def test_metadata():
    import struct

    entries = [(0x010F, 2, b'"Maker"\0'), (0x0112, 3, 6), (0x0132, 2, b"2024:01:02 03:04:05\0")]
    head, extra = struct.pack("<H", len(entries)), b""
    at = 8 + 2 + 12 * len(entries) + 4
    for tag, kind, v in entries:
        if kind == 2:
            head += struct.pack("<HHII", tag, kind, len(v), at + len(extra))
            extra += v
        else:
            head += struct.pack("<HHIHH", tag, kind, 1, v, 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + head + struct.pack("<I", 0) + extra
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"
    for data in (tiff, jpeg):
        assert files.exif(data) == {"capture_time": "2024:01:02 03:04:05", "camera_make": "Maker", "camera_model": None, "orientation": 6, "gps_available": False}
    assert files.exif(b"junk")["camera_make"] is None and files.exif(None)["orientation"] is None


def test_files(spark, tmp_path):
    for name in ("a.JPG", ".portrait.jpg", "._b.jpg", "_DSC1.NEF", "x.txt"):
        (tmp_path / name).write_bytes(b"\xff\xd8\xff")
    (tmp_path / ".Trash").mkdir()
    (tmp_path / ".Trash" / "t.jpg").write_bytes(b"")
    assert sorted(r["filename"] for r in files.walk(spark, str(tmp_path)).collect()) == [".portrait.jpg", "_DSC1.NEF", "a.JPG"]
    assert [r["filename"] for r in files.listing(spark, str(tmp_path)).collect()] == ["a.JPG"]
    got = files.contents(spark, str(tmp_path)).collect()
    assert [(r["file_size"], r["format"]) for r in got] == [(3, "Jpeg")]
    (tmp_path / "m.tsv").write_text("file\tmake\tmodel\traw_width\traw_height\na.cr2\tM\tX\t10\t20\n")
    assert files.manifest(spark, str(tmp_path / "m.tsv")).first()["raw_height"] == 20


def test_moment_stream(spark, tmp_path):
    from argentum.streaming.moments import moment_stream

    base = dt.datetime(2024, 1, 1)
    rows = [("lib", i, base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 60, 120, 1000, 1010, 9000, 9001, 90000])]
    schema = "library string, id long, t timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = moment_stream(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["first_id"], r["last_id"], r["photo_count"]) for r in spark.table("closed").collect()) == [(0, 2, 3), (3, 4, 2), (5, 6, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_moment_stream_in_any_order(spark, tmp_path, seed):
    """Batches with rows out of order within the watermark, several libraries, and rows that are too late."""
    from argentum.streaming.moments import moment_stream

    rng = random.Random(seed)
    base, schema = dt.datetime(2024, 1, 1), "library string, id long, t timestamp"
    rows = []
    for lib in "ab":
        at = 0
        for _ in range(90):
            at += rng.choice([0, 20, 60, 150, 181, 400])
            rows.append((lib, at))
    rows = [(lib, i, at) for i, (lib, at) in enumerate(rows)]
    rows += [("a", 1000, 100_000), ("b", 1001, 100_000)]
    # A row comes at most 500 seconds after rows of later times, which the watermark of 600 allows.
    order = sorted(rows, key=lambda r: r[2] + rng.random() * 500)
    size = 12
    import os

    for k, a in enumerate(range(0, len(order), size)):
        some = [(lib, i, base + dt.timedelta(seconds=at)) for lib, i, at in order[a : a + size]]
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / f"one{k}"))
        (file,) = (tmp_path / f"one{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        os.utime(file, (1_700_000_000 + 10 * k,) * 2)
        file.rename(tmp_path / "in" / f"{k:03}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"ordered{seed}"
    q = moment_stream(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted((r["library"], (r["end_us"] - r["start_us"]) // 1_000_000, r["first_id"], r["last_id"], r["photo_count"]) for r in spark.table(name).collect())
    want = []
    for lib in "ab":
        now = []
        for _, i, at in sorted((r for r in rows if r[0] == lib), key=lambda r: (r[2], r[1])):
            if now and (at - now[-1][1] > 180 or at - now[0][1] > 900):
                want.append((lib, now))
                now = []
            now.append((i, at))
    assert got == sorted((lib, m[-1][1] - m[0][1], m[0][0], m[-1][0], len(m)) for lib, m in want if len(m) > 1)


def test_components(spark):
    from argentum.operators.components import components

    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 130)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(150)] + [(7, 7), (None, 3)]
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            head[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in head}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_small_views(spark):
    rows = spark.createDataFrame([("s", 3, 12), ("t", 0, 0)], "session_id string, processed_files long, total_files long")
    assert dict(catalog.progress(rows).collect()) == {"s": 25, "t": 0}
    errors = spark.createDataFrame([("s", 2, "late"), ("s", 1, "first" * 200)], "session_id string, id long, reason string")
    assert catalog.first_error(errors).first()["reason"].startswith("first")
    assert max(len(r["reason"]) for r in state.errors(errors).collect()) == 500
    log = spark.createDataFrame([("s", 1, "running"), ("s", 2, "done")], "session_id string, seq long, status string")
    assert state.checkpoint(log).first()["status"] == "done"
    assert [r["status"] for r in state.interrupted(log).orderBy("seq").collect()] == ["interrupted", "done"]
    a = spark.createDataFrame([(1,), (2,)], "id long")
    assert catalog.merged_pages(a, a).count() == 2
    photos = spark.createDataFrame([(1, "m", False, "2", None), (2, "m", False, "1", None)], "id long, moment_id string, is_kept boolean, capture_time string, created_at string")
    recs = spark.createDataFrame([(1, "KEEP")], "photo_id long, decision string")
    assert moments.comparison_keeper(photos, recs).first()["keeper_id"] == 1
    assert moments.comparison_keeper(photos, recs.limit(0)).first()["keeper_id"] == 2
    nested = moments.with_photos(spark.createDataFrame([("m", "1")], "moment_id string, start_time string"), photos, recs).first()["photos"]
    assert [p["id"] for p in nested] == [2, 1]
    done = spark.createDataFrame([(1, "v1"), (2, "v0")], "photo_id long, analyzer_version string")
    assert [r["id"] for r in catalog.pending_faces(a, done, "v1").collect()] == [2]
    assert tuple(face.totals(spark.createDataFrame([(1,), (1,), (2,)], "photo_id long"), done, a, "v1").first()) == (1, 2)
    someone = spark.createDataFrame([("k", i, i, 9) for i in range(9)], "person_key string, id long, photo_id long, size long")
    seen = people.preview(people.with_photos(someone, spark.range(9))).first()
    assert (len(seen["faces"]), seen["more"]) == (7, 2)
    couple = spark.createDataFrame([(1, 2), (1, 5)], "primary_id long, paired_id long")
    assert pairs.resolved(couple, a).count() == 1


def test_eyes(spark):
    state_ = lambda o, px: tuple(one(spark, scalar.eye_state(lit(o).cast("double"), lit(px), lit(1.0))))
    assert state_(0.6, 50.0)[0] == "OPEN" and state_(0.3, 50.0)[0] == "CLOSED" and state_(0.45, 50.0) == ("UNCERTAIN", 0.45)
    assert state_(None, 50.0) == ("UNCERTAIN", 0.25) and state_(0.6, 10.0) == ("UNCERTAIN", 0.2)
    box = lambda x: F.struct(lit(x).alias("x"), lit(0.0).alias("y"), lit(10.0).alias("width"), lit(10.0).alias("height"))
    assert one(spark, scalar.iou(box(0.0), box(5.0))) == pytest.approx(1 / 3) and one(spark, scalar.iou(box(0.0), box(20.0))) == 0
    smile = one(spark, scalar.expression(*map(lit, (100.0, 100.0, 50.0, 30.0, 70.0, 70.0, 70.0, 70.0))))
    assert smile["smile_score"] == pytest.approx(0.4 * 0.65 + (-0.2 + 0.15) * 0.35) and smile["confidence"] == 1.0
    assert one(spark, scalar.expression(*map(lit, (9.0, 9.0, 5.0, 3.0, 7.0, 7.0, 7.0, 20.0))))["smile_score"] is None


def test_many_ranges(spark):
    """As many ranges as asked for, about equal ones, and places as a search in the sorted cuts gives them."""
    import bisect

    from pyspark.sql import functions as F

    from argentum.operators import ordered

    rows = spark.range(60000).select((F.col("id") * 7 - 100).alias("k"))
    for parts in (1, 50, 900):
        cuts = ordered.bounds(rows, "k", parts)
        assert len(cuts) == parts - 1
        got = rows.select("k", ordered.position(F.col("k"), cuts).alias("p")).toPandas()
        assert got.p.tolist() == [bisect.bisect_right(cuts, k) for k in got.k]
        assert got.p.value_counts().max() <= 2 * 60000 / parts
    assert ordered.bounds(rows.limit(0), "k", 900) == []


def test_near_values_by_bands_and_by_blocks(spark, monkeypatch):
    """Both ways find every pair, also with several blocks and negative numbers."""
    import random

    from argentum.operators import duplicates

    rng = random.Random(5)
    values = {rng.getrandbits(64) - (1 << 63) for _ in range(60)}
    for v in list(values):
        for _ in range(4):
            w = v & (1 << 64) - 1
            for b in rng.sample(range(64), rng.randrange(1, 24)):
                w ^= 1 << b
            values.add(w - (1 << 64) if w >> 63 else w)
    order = sorted(values)
    rows = spark.createDataFrame([(v,) for v in order], "h long")
    for distance in (0, 3, 8, 12, 20):
        want = sorted((g, h, ((g ^ h) & (1 << 64) - 1).bit_count()) for i, g in enumerate(order) for h in order[i + 1 :] if ((g ^ h) & (1 << 64) - 1).bit_count() <= distance)
        assert sorted(tuple(r) for r in duplicates.near_values(rows, distance).collect()) == want
        with monkeypatch.context() as m:
            m.setattr(duplicates, "SHARE", 0)  # no join by bands
            assert sorted(tuple(r) for r in duplicates.near_values(rows, distance).collect()) == want


def test_data_addresses_have_no_breaks(spark):
    import base64

    from argentum.sources.files import data_url

    raw = bytes(range(256)) * 3
    got = spark.createDataFrame([(raw,)], "content binary").select(data_url().alias("u")).first()["u"]
    assert got == "data:image/jpeg;base64," + base64.b64encode(raw).decode()


def test_openness_and_sharpness_of_a_region_against_plain_loops():
    import numpy as np

    from argentum.operators import images

    rng = np.random.default_rng(3)
    gray = rng.integers(0, 256, (40, 50)).astype(np.uint8)
    g = gray.astype(int)
    for cx, cy, radius in ((20, 20, 6.4), (1, 1, 4), (49, 38, 5), (25.5, 10.2, 0.1)):
        r = max(1, round(radius))
        apart = [abs(g[y - 1][x] - g[y + 1][x]) for y in range(max(1, round(cy) - r), min(39, round(cy) + r)) for x in range(max(0, round(cx) - r), min(50, round(cx) + r))]
        assert abs(images.openness(gray, cx, cy, radius) - min(1, sum(apart) / len(apart) / 64)) < 1e-9
    assert images.openness(gray, 90, 90, 3) is None
    quiet = (100 + rng.integers(0, 9, (40, 50))).astype(np.uint8)
    q = quiet.astype(int)
    v = [q[y - 1][x] + q[y + 1][x] + q[y][x - 1] + q[y][x + 1] - 4 * q[y][x] for y in range(6, 19) for x in range(11, 24)]
    mean = sum(v) / len(v)
    assert abs(images.region_sharpness(quiet, 10, 5, 15, 15) - min(1, sum((x - mean) ** 2 for x in v) / len(v) / 1000)) < 1e-9
    assert images.region_sharpness(quiet, 45, 5, 15, 15) is None and images.region_sharpness(quiet, 0, 0, 7, 20) is None


@pytest.mark.parametrize("seed", range(4))
def test_matching_in_rounds_is_greedy(spark, seed):
    """Random candidates, chains that take a round each, one side with very many candidates."""
    rng = random.Random(seed)
    found = {(rng.randrange(6), rng.randrange(30), rng.randrange(30)) for _ in range(500)} | {(10, i, i + d) for i in range(6) for d in (0, 1)} | {(11, 0, j) for j in range(300)}
    rows = sorted((g, f"r{g}-{a:03}", f"j{g}-{b:03}") for g, a, b in found)
    want, taken = [], set()
    for g, a, b in rows:
        if a not in taken and b not in taken:
            taken |= {a, b}
            want.append((a, b))
    df = spark.createDataFrame(rows, "g long, r string, j string")
    assert sorted(map(tuple, pairs.match(df, ("g",), "r", "j", ("r",), ("j",)).collect())) == sorted(want)
    assert pairs.match(df.limit(0), ("g",), "r", "j", ("r",), ("j",)).collect() == []
