"""The driver's contract: every query runs over the small tables; those with SQL agree with DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from argentum.plans import queries as base


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 6) if isinstance(x, float) else x


def rows(columns, got):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(base.QUERIES))
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_person_groups_match_a_plain_loop(spark, sf):
    import numpy as np

    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    v, photo = np.stack(table.embedding).astype(float), (table.vec_id // 2).tolist()
    ids, score = table.vec_id.tolist(), v @ v.T
    edges = sorted((-score[i, j], i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if photo[i] != photo[j] and score[i, j] >= 0.35)
    groups = {i: [i] for i in range(len(v))}
    head = list(range(len(v)))
    for _, i, j in edges:
        a, b = head[i], head[j]
        cross = score[np.ix_(groups[a], groups[b])]
        if a == b or {photo[k] for k in groups[a]} & {photo[k] for k in groups[b]} or cross.min() < 0.20 or cross.mean() < 0.25:
            continue
        for k in groups[b]:
            head[k] = a
        groups[a] += groups.pop(b)
    want = sorted(sorted(ids[k] for k in g) for g in groups.values() if len(g) > 1)
    got = {}
    for r in base.person_groups(spark, sf).collect():
        got.setdefault(r["person_key"], []).append(r["id"])
    assert sorted(map(sorted, got.values())) == want


def test_logical_pairs_match_a_plain_loop(spark, sf):
    found = sorted(tuple(r) for r in base.pair_candidates(spark, sf).collect())
    done, taken, want = set(), set(), []
    for _, a, b in found:
        if a not in done and b not in taken:
            done.add(a)
            taken.add(b)
            want.append((a, b))
    assert sorted(tuple(r) for r in base.logical_pairs(spark, sf).collect()) == sorted(want)


def test_file_pairs_match_a_plain_loop(spark, sf):
    """RAW files in the order of paths take the first JPEG of their folder and stem that is free."""
    import datetime as dt

    from argentum.operators.pairs import BY_NAME, BY_TIME
    from argentum.plans import more

    groups = {}
    for r in more.order_files(spark, sf).collect():
        name = r["absolute_path"].rsplit(".", 1)[0].lower()
        groups.setdefault(name, []).append(r)
    want = []
    for rows_ in groups.values():
        order = sorted(rows_, key=lambda r: (r["absolute_path"], r["id"]))
        taken = set()
        for a in order:
            if a["extension"] != "NEF":
                continue
            for b in order:
                if b["extension"] != "jpg" or b["id"] in taken or a["file_size"] == b["file_size"]:
                    continue
                times = [r["capture_time"] and dt.datetime.fromisoformat(r["capture_time"]) for r in (a, b)]
                if all(times) and abs((times[0] - times[1]).total_seconds()) > 60 * 86400:
                    continue
                taken.add(b["id"])
                want.append((a["id"], b["id"], BY_TIME if all(times) else BY_NAME))
                break
    assert sorted(tuple(r) for r in more.file_pairs(spark, sf).collect()) == sorted(want) and len(want) > 50


def test_plans_push_down(spark, sf, capsys):
    base.near_hash_edges(spark, sf).explain("simple")
    base.dashboard_stats(spark, sf).explain("simple")
    text = capsys.readouterr().out
    assert "BroadcastNestedLoopJoin BuildRight, Inner, (" not in text and "ReadSchema: struct<vec_id" in text


#: Lists whose order counts: what their rows are sorted by, after SQL's own ORDER BY where the SQL has one.
ORDERED = {
    "library_page": "created_at DESC, id",
    "library_page_offset": None,
    "library_deep_page": "place",
    "bin_listing": "id",
    "wrong_eyes": "what DESC, filename, face",
    "listed_people": "size DESC, person_key",
}


@pytest.mark.parametrize("name", ORDERED)
def test_order_of_lists(spark, sf, duck, name):
    """Row by row: a shuffled result fails."""
    df = entry.queries()[name](spark, sf)
    sql = entry.oracle_sql()[name]
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = duck.execute(f"SELECT {columns} FROM ({sql}) AS q{f' ORDER BY {ORDERED[name]}' if ORDERED[name] else ''}").fetchall()
    got = [tuple(map(plain, r)) for r in df.collect()]
    assert got == [tuple(map(plain, r)) for r in want] and len(got) > 1


def test_order_of_duplicate_moments(spark):
    import datetime as dt

    from argentum.operators import guard

    base = dt.datetime(2024, 1, 1)
    groups = spark.createDataFrame([(m, base, base + dt.timedelta(minutes=5)) for m in "abcd"], "id string, start_time timestamp, end_time timestamp")
    photos = spark.createDataFrame([(i, m, "00000000000000ff") for i, m in enumerate("aabcccdddd")], "id long, moment_id string, perceptual_hash string")
    got = [tuple(r)[:3] for r in guard.duplicate_moments(groups, photos).collect()]
    assert got == [("c", "d", 12), ("a", "d", 8), ("a", "c", 6), ("b", "d", 4), ("b", "c", 3), ("a", "b", 2)]


def test_order_of_moments(spark):
    from argentum.operators import moments

    groups = spark.createDataFrame([("m1", "2024-01-01"), ("m2", "2024-02-01"), ("m3", "2024-02-01")], "moment_id string, start_time string")
    photos = spark.createDataFrame([(2, "m1", "2024-01-02"), (1, "m1", "2024-01-02"), (3, "m1", "2024-01-01")], "id long, moment_id string, created_at string").selectExpr("*", "cast(null as string) as capture_time")
    got = moments.with_photos(groups, photos, spark.createDataFrame([], "photo_id long, decision string")).collect()
    assert [r["moment_id"] for r in got] == ["m2", "m3", "m1"] and [p["id"] for p in got[2]["photos"]] == [3, 1, 2]
