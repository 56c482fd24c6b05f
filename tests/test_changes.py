"""What is kept and changed: moments and groups after changes, overlaps, places in an order, boxes."""

import datetime as dt
import math
import random
import re
import re

import pytest
from pyspark.sql import functions as F

from argentum.operators import decisions, detection, guard, incremental, ranks
from argentum.operators import faces as face
from argentum.operators.components import components
from argentum.operators.moments import segments
from argentum.plans import changes
from argentum.plans import queries as base

BASE = dt.datetime(2024, 1, 1)


def timed(spark, rows):
    return spark.createDataFrame([(i, BASE + dt.timedelta(seconds=s)) for i, s in rows], "id long, t timestamp")


@pytest.mark.parametrize("seed", range(3))
def test_moments_after_changes(spark, seed):
    """Inserts and deletes anywhere, also such that join and part days; only days within reach are read."""
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(400):
        at += rng.choice([10, 100, 179, 180, 181, 500, 20_000 if i % 7 else 200_000])
        rows.append((i, at))
    width = 86_400_000_000
    gone = rng.sample(rows, 12)
    new = [(1000 + k, rng.choice(rows)[1] + rng.choice([-170, 0, 60, 190, 86_400])) for k in range(12)]
    old = incremental.moments_of(timed(spark, rows), parts=4, width=width)
    now, again = incremental.change_moments(old, timed(spark, new), timed(spark, gone), parts=3, width=width)
    full = [r for r in rows if r not in gone] + new
    want = sorted((r["id"], r["segment"]) for r in segments(timed(spark, full)).collect())
    assert sorted((r["id"], r["segment"]) for r in now.rows.collect()) == want
    assert {tuple(r) for r in now.cells.collect()} == {tuple(r) for r in incremental._summary(now.rows).collect()}
    # A second change on top.
    more, _ = incremental.change_moments(now, timed(spark, gone[:3]), timed(spark, new[:3]), parts=2, width=width)
    full = [r for r in full if r not in new[:3]] + gone[:3]
    assert sorted((r["id"], r["segment"]) for r in more.rows.collect()) == sorted((r["id"], r["segment"]) for r in segments(timed(spark, full)).collect())


def test_a_small_change_reads_few_rows(spark):
    rows = [(i, 400 * i) for i in range(20_000)]  # ninety days, each photo alone
    old = incremental.moments_of(timed(spark, rows))
    for k in (1, 4):
        new = [(50_000 + j, 2_000_000 * j + 60) for j in range(k)]
        _, again = incremental.change_moments(old, timed(spark, new), timed(spark, []))
        assert again.count() <= k * 3 * 217  # three days each
    empty = incremental.moments_of(timed(spark, []))
    now, _ = incremental.change_moments(empty, timed(spark, rows[:5]), timed(spark, []))
    assert now.rows.count() == 5


@pytest.mark.parametrize("seed", range(2))
def test_groups_after_changes(spark, seed):
    rng = random.Random(seed)
    links = sorted({tuple(sorted(rng.sample(range(60 * g, 60 * g + 60), 2))) for g in range(5) for _ in range(35)})
    gone = rng.sample(range(300), 20)
    new = [tuple(sorted(rng.sample(range(330), 2))) for _ in range(6)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    old = incremental.groups_of(frame(links))
    where = {r["id"]: r["component"] for r in old.members.collect()}
    now, again = incremental.change_groups(old, frame(new), spark.createDataFrame([(i, where.get(i)) for i in gone], "id long, component long"))
    left = [x for x in links + new if not {*x} & {*gone}]
    want = {r["node"]: r["component"] for r in components(frame(left)).collect()}
    assert {r["id"]: r["component"] for r in now.members.collect()} == want
    assert sorted(tuple(r) for r in now.links.select("a", "b").collect()) == sorted({*left})
    same, few = incremental.change_groups(now, frame([(400, 401)]), spark.createDataFrame([], "id long, component long"))
    assert few.members.count() == 2 and same.members.count() == len(want) + 2


def test_overlaps_of_windows_of_any_length(spark):
    rng = random.Random(3)
    rows = [("year", 0, 31_536_000), ("point", 5000, 5000), ("same", 5000, 5000), ("before", -90_000, -10), ("touch", -10, 3), ("odd", 9, 8), ("none", None, 4)]
    for i in range(120):
        s = rng.randrange(-100_000, 400_000)
        rows.append((f"m{i:03}", s, s + rng.choice([0, 10, 900, 5000, 100_000])))
    at = lambda s: None if s is None else BASE + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(i, at(s), at(e)) for i, s, e in rows], "id string, start_time timestamp, end_time timestamp")
    good = [r for r in rows if None not in r and r[1] <= r[2]]
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(good) for b in good[k + 1 :] if a[1] <= b[2] and b[1] <= a[2])
    for grid in (900, 7):
        assert sorted(map(tuple, guard.overlapping(df, grid).collect())) == want
    pieces = df.filter("id = 'year'").select(F.explode(guard.nodes(F.lit(0).cast("long"), F.lit(35_039).cast("long"), 16))).count()
    assert pieces <= 32


def test_overlaps_send_no_side_whole(spark):
    """Whatever the estimate of sizes says: nodes are several for each window."""
    df = spark.range(1000).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("start_time"), F.timestamp_seconds(F.col("id") * 3600 + 5000).alias("end_time"))
    found = guard.overlapping(df, 900)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 999


def test_pages_and_places(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(40)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, day long")
    index = ranks.ranked(df, (F.desc("day"), F.col("id")), 7)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for offset, limit in ((0, 10), (250, 300), (890, 50), (900, 5), (1200, 3), (120, 1)):
        page = index.page(offset, limit)
        assert [tuple(r) for r in page.collect()] == order[offset : offset + limit]
    plan = index.page(890, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_argentum_part#\d+ = 6", plan)
    assert {(r["id"], r["rank"]) for r in index.placed().collect()} == {(r[0], k + 1) for k, r in enumerate(order)}
    assert ranks.ranked(df.limit(0), (F.col("id"),), 3).page(0, 5).collect() == []


def test_neighbours_in_a_circle(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaaab") if i else "alone") for i in range(300)] + [(400, None), (401, None)]
    got = {r["id"]: (r["previous_id"], r["next_id"]) for r in ranks.circle(spark.createDataFrame(rows, "id long, album string"), ("id",), "album", 6).collect()}
    want = {}
    for album in ("a", "b", "alone", None):
        ids = sorted(i for i, x in rows if x == album)
        want |= {i: (ids[k - 1], ids[(k + 1) % len(ids)]) for k, i in enumerate(ids)}
    assert got == want


def plain_iou(a, b):
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def test_suppression_against_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(i % 9, i, round(rng.random(), 1), *(round(rng.uniform(0, 30), 2) for _ in range(2)), *(rng.choice([0.0, 5.0, 12.5, 20.0]) for _ in range(2)), f"n{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "image_id long, box_id long, score double, x double, y double, width double, height double, note string")
    want = []
    for image in range(9):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[1])):
            if not any(plain_iou(k[3:7], r[3:7]) > 0.3 for k in kept):
                kept.append(r)
        want += kept
    assert sorted(map(tuple, face.suppressed(df).collect())) == sorted(want)
    assert face.suppressed(df.limit(0)).collect() == []


def test_heads_against_a_plain_loop(spark):
    rng = random.Random(7)
    rows, want = [], []
    for image in range(4):
        for stride in (8, 16, 32):
            cols = 64 // stride
            cls, obj = ([rng.choice([rng.uniform(-0.2, 1.3), 0.9, math.nan, math.inf, -math.inf]) for _ in range(cols * cols)] for _ in range(2))
            bbox = [rng.choice([rng.gauss(0, 1), 1e30 if rng.random() < 0.05 else 0.5]) for _ in range(4 * cols * cols)]
            kps = [rng.gauss(0, 1) for _ in range(10 * cols * cols)]
            rows.append((image, stride, cls, obj, bbox, kps, 1.5, 0.5))
            for k in range(cols * cols):
                if math.isnan(cls[k]) or math.isnan(obj[k]):
                    continue
                score = math.sqrt(min(1, max(0, cls[k])) * min(1, max(0, obj[k])))
                if score < 0.6:
                    continue
                col, row = k % cols, k // cols
                try:
                    w, h = math.exp(bbox[4 * k + 2]) * stride, math.exp(bbox[4 * k + 3]) * stride
                except OverflowError:
                    continue
                cx, cy = (col + bbox[4 * k]) * stride, (row + bbox[4 * k + 1]) * stride
                nose = ((kps[10 * k + 4] + col) * stride * 1.5, (kps[10 * k + 5] + row) * stride * 0.5)
                want.append((image, stride, k, score, (cx - w / 2) * 1.5, (cy - h / 2) * 0.5, w * 1.5, h * 0.5, *nose))
    df = spark.createDataFrame(rows, "image_id long, stride int, cls array<double>, obj array<double>, bbox array<double>, kps array<double>, scale_x double, scale_y double")
    got = [(r["image_id"], r["stride"], r["cell"], r["score"], r["x"], r["y"], r["width"], r["height"], r["nose"]["x"], r["nose"]["y"]) for r in detection.decoded(df, 64).collect()]
    assert len(got) == len(want) > 40
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[3:], b[3:], strict=True))
    kept = detection.detected(df, 64).collect()
    assert 0 < len(kept) < len(got) and {(r["image_id"], r["stride"], r["cell"]) for r in kept} <= {x[:3] for x in got}
    with pytest.raises(Exception, match="unexpected size of bbox"):
        detection.decoded(df.withColumn("bbox", F.slice("bbox", 1, 7)), 64).collect()


def test_copies_stay_together_when_the_least_goes(spark, tmp_path):
    """Equal hashes whose least row goes, comes late, or is the only one that stays."""
    rng = random.Random(11)
    looks = [[rng.choice([-1.0, 1.0]) for _ in range(64)] for _ in range(14)]
    for k in range(7, 14):  # near the first ones
        looks[k] = [-x if i < k else x for i, x in enumerate(looks[k - 7])]
    rows = [(i, looks[rng.randrange(14)]) for i in [*range(17, 120), *range(17 * 13, 17 * 13 + 40)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    kept = [(i, v) for i, v in rows if i % 17 or i % 13 == 0]
    head = {i: i for i, _ in kept}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, v in kept:
        for j, w in kept:
            if i < j and sum(x != y for x, y in zip(v, w, strict=True)) <= 18:
                p, q = sorted((root(i), root(j)))
                head[q] = p
    groups = {}
    for i, _ in kept:
        groups.setdefault(root(i), []).append(i)
    want = sorted((i, g) for g, ids in groups.items() if len(ids) > 1 for i in ids)
    assert sorted(map(tuple, changes.groups_after_changes(spark, str(tmp_path)).collect())) == want and len(groups) > 2


def test_count_mismatches_are_those_of_recommend(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, 0, 1, 1, 2, 3]), rng.choice([None, 0.5]), rng.choice([None, None, "t"]), rng.choice(["user_remove", "ready"])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, moment_id string, face_count long, sharpness double, thumbnail_path string, analysis_status string")
    full = df.select("*", F.lit(False).alias("is_kept"), *[F.lit("0" * 16).alias(x) for x in ("sha256", "perceptual_hash")], *[F.lit(0.5).alias(x) for x in ("exposure", "highlight_clipping", "shadow_clipping", "contrast", "mean_saturation", "flat_fraction")])
    want = sorted(r["photo_id"] for r in decisions.recommend(full).filter(F.array_contains("codes", "FaceCountMismatch")).collect())
    assert sorted(r["photo_id"] for r in decisions.count_mismatches(full).collect()) == want and want


def sent(spark, monkeypatch, query, sf):
    """What a recommendation's shuffles are keyed by, those that are read again once: of what it writes and of what it returns."""
    plans = []

    def plan(df):
        before = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plans.append(df.select("*")._jdf.queryExecution().executedPlan().toString())
        spark.conf.set("spark.sql.adaptive.enabled", before)

    real = decisions.cut
    monkeypatch.setattr(decisions, "cut", lambda df, name: plan(df) or real(df, name))
    plan(query(spark, sf))
    return [re.sub(r"#\d+L?", "", re.search(r"partitioning\((.*), \d+\)", x)[1]) for p in plans for x in p.splitlines() if "- Exchange hashpartitioning" in x]


def test_faces_and_overrides_leave_lines_where_their_moment_is(spark, sf, monkeypatch):
    found = sent(spark, monkeypatch, base.recommendations_with_faces, sf)
    # Lines and their ids once each, and once more those without a moment; the rest is overrides.
    assert found.count("l_orderkey") == 4 and set(found) <= {"l_orderkey", "user_id", "photo_id", "moment_id"}, found
    assert spark.conf.get(decisions.ANEW) == "true"


def test_overrides_of_photos_say_the_same(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *"abcdefghijkl"]), rng.choice([None, False, False, True]), rng.choice([None, "", *"pqrs"]), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice([None, "t", "t"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, moment_id string, is_kept boolean, sha256 string, sharpness double, thumbnail_path string")
    df = df.select("*", F.lit("ready").alias("analysis_status"), F.lit("0" * 16).alias("perceptual_hash"), *[F.lit(0.2).alias(x) for x in ("exposure", "highlight_clipping", "shadow_clipping")])
    said = spark.createDataFrame([(i, rng.choice(["KEEP", "REMOVE", "REVIEW"])) for i in range(0, 140, 3)], "photo_id long, actual_decision string")
    want = sorted(map(str, decisions.recommend(df, said).collect()))
    assert sorted(map(str, decisions.recommend(df.repartition(3, "moment_id"), decisions.of_photos(said, df)).collect())) == want and len(want) == 120
    # By hand: of several copies that may stay one is kept, and it is the best of the moment if that is among them.
    user = {r["photo_id"]: r["actual_decision"] for r in said.collect()}
    got = {r["photo_id"]: r for r in decisions.recommend(df, said).collect()}
    able = [(i, m, 0 if k or user.get(i) == "KEEP" else 2 if k is None else 1, x, s) for i, m, k, x, s, t in rows if m and s is not None and t and user.get(i) != "REMOVE"]
    copied = 0
    for i, m, kept, x, _ in able:
        same = [a for a in able if a[1] == m and a[3] == x]
        best = min((a for a in able if a[1] == m), key=lambda a: (a[2], -a[4], a[0]))[0]
        if x and len(same) > 1 and kept and i not in user:
            keeper = min(same, key=lambda a: (a[2], a[0] != best, a[0]))[0]
            assert (got[i]["decision"], got[i]["compared_to"]) == (("KEEP", None) if i == keeper else ("REMOVE", keeper))
            copied += 1
    assert copied > 9


def test_recommendations_send_lines_once(spark, sf, monkeypatch):
    """Once, and once more those without a moment; whatever is joined afterwards lies there already."""
    assert sent(spark, monkeypatch, base.recommendations, sf) == ["l_orderkey"] * 2
