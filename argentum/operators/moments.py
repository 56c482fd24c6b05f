"""Moments: photos in order of time, cut where a gap is too long, the order is unknown, or a span is too long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions.scalar import signature
from argentum.operators.ordered import RANGE, lagged
from argentum.plans.shared import cut, importable

GAP, SPAN = 180, 900


def following(us: np.ndarray, first: np.ndarray, limit: int) -> np.ndarray:
    """For each row the row that begins the next segment, if it begins one itself: the first one further off than limit or behind a gap."""
    n, gaps = len(us), np.append(np.flatnonzero(first), len(us))
    return np.minimum(np.searchsorted(us, us + limit, "right"), gaps[np.searchsorted(gaps[:-1], np.arange(n), "right")])


def roots(after: np.ndarray) -> np.ndarray:
    """The last row that each row leads to, by pointer doubling."""
    own = np.arange(len(after))
    to = np.where(after < len(after), after, own)
    while not np.array_equal(further := to[to], to):
        to = further
    return to


def reached(after: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Rows that those in `begins` lead to, and these: sets whose pointers jump twice as far in each step."""
    n = len(after)
    out, jump = np.append(begins, False), np.append(after, n)
    while (jump[:-1] < n).any():
        out[jump[np.flatnonzero(out)]] = True
        jump = jump[jump]
    out[jump[np.flatnonzero(out)]] = True
    return out[:n]


def segments(photos: DataFrame, gap: int = GAP, span: int = SPAN, parts: int = 8) -> DataFrame:
    """(id, t) to (id, t, segment): t is a timestamp, null ones are left out; segment: microseconds of its first row.

    Rows are dealt by ranges of time, one task a range, however long the time without a gap is. Gaps depend on neighbours
    alone. The span rule depends on where the last segment began: a range answers for each time that this may be
    where the last segment that begins in it would begin (a step function, as later rows never lead to earlier
    ones). One row a range, these functions are followed from range to range; then each range cuts its rows.
    """
    timed = photos.select("id", F.unix_micros(F.col("t").cast("timestamp")).alias("us"))
    known = lagged(timed.filter("us is not null"), "us", ("id",), {"before": "us"}, parts)
    far = F.col("before").isNull() | (F.floor((F.col("us") - F.col("before")) / 1_000_000) > gap)
    rows = cut(known.select("id", "us", far.alias("first"), F.col(RANGE).cast("long").alias(RANGE)), "times")
    limit = span * 1_000_000 + 999_999  # seconds count whole

    def read(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = table.sort_by([("us", "ascending"), ("first", "descending")])
        return table, table.column("us").to_numpy(), table.column("first").to_numpy()

    def answers(table: pa.Table) -> pa.Table:
        table, us, first = read(table)
        end = us[roots(following(us, first, limit))]
        gap_at = int(first.argmax()) if first.any() else len(us)
        at, to = us[:gap_at], end[:gap_at]
        last = np.append(to[1:] != to[:-1], True)[: len(to)]  # of rows that lead to one segment the last says so
        return pa.table({RANGE: table.column(RANGE)[:1], "gap_to": pa.array([int(end[gap_at]) if gap_at < len(us) else None], pa.int64()), "at": pa.array([at[last].tobytes()], pa.binary()), "to": pa.array([to[last].tobytes()], pa.binary())})

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: int | None = None
        for batch in batches:
            out = []
            for gap_to, at, to in zip(*(batch.column(c).to_pylist() for c in ("gap_to", "at", "to")), strict=True):
                out.append(begun)
                at, to = np.frombuffer(at, np.int64), np.frombuffer(to, np.int64)
                i = int(np.searchsorted(at, begun + limit, "right")) if begun is not None else len(at)
                begun = int(to[i]) if i < len(at) else gap_to if gap_to is not None else begun
            yield pa.RecordBatch.from_arrays([batch.column(RANGE), pa.array(out, pa.int64())], [RANGE, "begun"])

    def divide(table: pa.Table, before: pa.Table) -> pa.Table:
        table, us, first = read(table)
        begun, after = before.column("begun")[0].as_py(), following(us, first, limit)
        begins = first.copy()
        if begun is not None:
            entry = int(np.searchsorted(us, begun + limit, "right"))
            if entry < len(us) and not first[: entry + 1].any():
                begins[entry] = True
        begins = reached(after, begins)
        at = np.maximum.accumulate(np.where(begins, np.arange(len(us)), -1))
        segment = np.where(at >= 0, us[at], begun if begun is not None else 0)
        return pa.table({"id": table.column("id"), "us": table.column("us"), "segment": pa.array(segment)})

    kind = photos.schema["id"].dataType.simpleString()
    asked = rows.groupBy(RANGE).applyInArrow(answers, f"{RANGE} long, gap_to long, at binary, to binary")
    told = asked.repartition(1).sortWithinPartitions(RANGE).mapInArrow(follow, f"{RANGE} long, begun long")  # a row a range
    importable(photos.sparkSession)
    divided = rows.groupBy(RANGE).cogroup(told.groupBy(RANGE)).applyInArrow(divide, f"id {kind}, us long, segment long")
    return divided.select("id", F.timestamp_micros("us").alias("t"), "segment")


def moments(photos: DataFrame, gap: int = GAP, span: int = SPAN, parts: int = 8) -> DataFrame:
    """Segments of at least two photos: moment_id (of the members), first_id, last_id, start, end, photo_count, ids."""
    rows = segments(photos, gap, span, parts)
    first, last = F.min(F.struct("t", "id")), F.max(F.struct("t", "id"))
    groups = rows.groupBy("segment").agg(first.alias("a"), last.alias("b"), F.count("*").alias("photo_count"), F.collect_list(F.col("id").cast("string")).alias("ids")).filter("photo_count >= 2")
    return groups.select(signature(F.col("ids")).alias("moment_id"), F.col("a.id").alias("first_id"), F.col("b.id").alias("last_id"), F.col("a.t").alias("start_time"), F.col("b.t").alias("end_time"), "photo_count", "ids")


def kept_ids(new: DataFrame, old_members: DataFrame, old_groups: DataFrame) -> DataFrame:
    """New moments take the id of an old one with the same members, if its stored count agrees.

    old_members: moment_id, id; old_groups: id, photo_count.
    """
    old = old_members.groupBy("moment_id").agg(signature(F.collect_list(F.col("id").cast("string"))).alias("members"), F.count("*").alias("n"))
    valid = old.join(old_groups.select(F.col("id").alias("moment_id"), "photo_count"), "moment_id").filter("n = photo_count")
    best = valid.groupBy("members").agg(F.max("moment_id").alias("old_id"))
    return new.join(best, new.moment_id == best.members, "left").withColumn("moment_id", F.coalesce("old_id", "moment_id")).drop("members", "old_id")


def sessions_by(rows: DataFrame, key: str, gap: int = GAP) -> DataFrame:
    """Gap sessions within each key: (key, id, t) to one row a session."""
    w = Window.partitionBy(key).orderBy("t", "id")
    us = F.unix_micros("t")
    before = F.lag(us).over(w)
    new = (before.isNull() | (F.floor((us - before) / 1_000_000) > gap)).cast("int")
    numbered = rows.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n"), F.min("t").alias("start_time"), F.max("t").alias("end_time"))


def stale_recommendations(recommendations: DataFrame, photos: DataFrame) -> DataFrame:
    """Recommendations that still fit: the photo is in the same moment. Those without a moment go."""
    now = photos.select(F.col("id").alias("photo_id"), "moment_id").filter("moment_id is not null")
    return recommendations.join(now, ["photo_id", "moment_id"], "left_semi")


def with_photos(groups: DataFrame, photos: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Moments, latest first, each with its photos in order and their decisions."""
    rows = photos.join(recommendations.select(F.col("photo_id").alias("id"), "decision"), "id", "left")
    when = F.coalesce("capture_time", "created_at")
    nested = rows.groupBy("moment_id").agg(F.sort_array(F.collect_list(F.struct(when.alias("time"), "id", "decision"))).alias("photos"))
    return groups.join(nested, "moment_id", "left").orderBy(F.col("start_time").desc(), "moment_id")


def comparison_keeper(photos: DataFrame, recommendations: DataFrame) -> DataFrame:
    """The photo that others of its moment are compared with: kept, else recommended, else first."""
    rows = photos.join(recommendations.select(F.col("photo_id").alias("id"), "decision"), "id", "left")
    rank = F.struct((~F.col("is_kept")).alias("x"), F.coalesce(F.col("decision") != "KEEP", F.lit(True)).alias("y"), F.coalesce("capture_time", "created_at").alias("z"), "id")
    return rows.groupBy("moment_id").agg(F.min_by("id", rank).alias("keeper_id"))


__all__ = ["GAP", "RANGE", "SPAN", "comparison_keeper", "kept_ids", "moments", "segments", "sessions_by", "stale_recommendations", "with_photos"]
