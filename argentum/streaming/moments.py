"""Moments of a stream in the order of event time: late photos within the watermark give what a batch gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from argentum.operators.moments import GAP, SPAN
from argentum.plans.shared import importable

OUT = "library string, start_us long, end_us long, photo_count long, first_id long, last_id long"
NAMES = [c.split()[0] for c in OUT.split(", ")]
STATE = "start_us long, last_us long, n long, first_id long, last_id long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Moments(StatefulProcessor):
    """Of each library: photos that the watermark has not passed, as a list, and the open moment, five numbers.

    A photo waits until the watermark passes it; then no earlier one can come, and it is given to the open moment in
    the order of (time, id). Timers wake a library without new rows: for its first waiting photo, and for when its open moment can't go on.
    """

    def __init__(self, gap: int, span: int):
        self.gap, self.span = (gap + 1) * 1_000_000, (span + 1) * 1_000_000  # seconds count whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long")
        self.open = handle.getValueState("open", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            self.waiting.appendList(list(zip(f["us"].astype("int64").tolist(), f["id"].astype("int64").tolist(), strict=True)))
        yield from self.release(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.release(key, timerValues)

    def release(self, key: tuple, times) -> Iterator[pd.DataFrame]:
        mark = times.getCurrentWatermarkInMs() * 1000
        held = sorted((int(us), int(i)) for us, i in self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in held if x[0] <= mark]
        rest = held[len(due) :]
        now = tuple(self.open.get()) if self.open.exists() else None
        done = []
        for us, i in due:
            if now and us - now[1] < self.gap and us - now[0] < self.span:
                now = (now[0], us, now[2] + 1, now[3], i)
            else:
                done.append(now)
                now = (us, us, 1, i, i)
        # What comes later is behind the watermark: a moment that can't reach there is closed.
        if now and mark + 1 >= min(now[1] + self.gap, now[0] + self.span):
            done.append(now)
            now = None
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if now:
            self.open.update(now)
        elif self.open.exists():
            self.open.clear()
        wake = [-(-rest[0][0] // 1000)] if rest else []
        wake += [-(-min(now[1] + self.gap, now[0] + self.span) // 1000)] if now else []
        for at in {max(x, mark // 1000 + 1) for x in wake} - set(self.handle.listTimers()):
            self.handle.registerTimer(at)
        out = [(key[0], *m) for m in done if m and m[2] >= 2]
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def moment_stream(photos: DataFrame, late: str = "10 minutes", gap: int = GAP, span: int = SPAN) -> DataFrame:
    """photos: library, id, t (timestamp). Each moment of at least two photos, once it can't change any more.

    The moments are those of a batch over all rows that came within the watermark, in whatever order and batches they
    came; rows behind it are dropped. Rows without library or time don't count.

    Needs RocksDB as state store: sets PROVIDER in the session where it is not set.
    """
    spark = importable(photos.sparkSession)
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    rows = photos.filter("library is not null and t is not null").withWatermark("t", late).selectExpr("library", "id", "t", "unix_micros(t) as us")
    return rows.groupBy("library").transformWithStateInPandas(Moments(gap, span), OUT, "append", "eventtime")
