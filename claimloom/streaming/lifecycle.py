"""The lifecycle as streams: decode, dedup, latest state, progress, velocity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from claimloom.sources.storage import shared_dir

#: What transformWithState and its timers need.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def decoded(events: DataFrame, schemas: dict[str, str], kind: str = "event_type", payload: str = "props") -> DataFrame:
    """Each type's payload by its own schema, as column payload_<type>; types that aren't declared are left out."""
    rows = events.where(F.col(kind).isin(*schemas))
    return rows.select("*", *(F.when(F.col(kind) == name, F.from_json(payload, schema)).alias(f"payload_{name}") for name, schema in schemas.items()))


def deduplicated(events: DataFrame, key: str, time: str, horizon: str) -> DataFrame:
    """One event per idempotency key within the horizon; state older than that is dropped."""
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def latest_state(events: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """Each key's newest value (update or complete mode)."""
    return events.groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def windowed_counts(events: DataFrame, key: str, time: str, length: str, slide: str, late: str) -> DataFrame:
    """Counts in sliding windows; late rows beyond the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, length, slide), key).agg(F.count("*").alias("n"))


class TrailingCount(StatefulProcessor):
    """Counts each event's key in the trailing seconds, itself and its second's others included.

    An event waits until the watermark has passed its second, so that all before it is there; what
    arrives later than that is dropped by Spark. Told events stay as counts by second for as long
    as a later event may reach back to them. One timer a key: when its earliest event is due, or,
    when none waits, when its newest second can't be reached any more and the state goes.
    """

    def __init__(self, key: str, span: int) -> None:
        self.key, self.span = key, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, at long")
        self.told = handle.getListState("told", "at long, n long")

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer((at + 1) * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        pairs = [(None if pd.isna(i) else int(i), int(t)) for i, t in zip(new["event_id"], new["at"], strict=True)]
        self.waiting.appendList(pairs)
        due = min(t for _, t in pairs)
        timers = [old // 1000 - 1 for old in self.handle.listTimers()]
        earlier = [t for _, t in self.waiting.get()] if not timers else [min(timers)]
        self._timer(min(due, *earlier))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        waiting = list(self.waiting.get())
        due = sorted(((t, i) for i, t in waiting if t < mark), key=lambda x: x[0])
        later = [(i, t) for i, t in waiting if t >= mark]
        seconds: dict[int, int] = {t: n for t, n in self.told.get()}
        for t, _ in due:
            seconds[t] = seconds.get(t, 0) + 1
        at = np.array(sorted(seconds), np.int64)
        sums = np.concatenate(([0], np.cumsum([seconds[t] for t in at.tolist()], dtype=np.int64)))
        when = np.array([t for t, _ in due], np.int64)
        recent = sums[np.searchsorted(at, when, "right")] - sums[np.searchsorted(at, when - self.span, "left")]
        kept = [(t, n) for t, n in seconds.items() if t + self.span >= mark]
        self.waiting.put(later) if later else self.waiting.clear()
        self.told.put(kept) if kept else self.told.clear()
        self._timer(min(t for _, t in later) if later else max(t for t, _ in kept) + self.span if kept else None)
        yield pd.DataFrame({"event_id": pd.array([i for _, i in due], "Int64"), self.key: [key[0]] * len(due), "recent": recent})


def trailing_counts(events: DataFrame, key: str, time: str, days: int, late: str) -> DataFrame:
    """(event_id, key, recent), each event's exact count of its key in the trailing days, within its second."""
    out = StructType.fromDDL(f"event_id long, {key} {events.schema[key].dataType.simpleString()}, recent long")
    rows = events.withWatermark(time, late).select("event_id", key, time, F.col(time).cast("long").alias("at"))
    return rows.groupBy(key).transformWithStateInPandas(TrailingCount(key, days * 86400), outputStructType=out, outputMode="Append", timeMode="EventTime")


def gated(uploads: DataFrame, started: DataFrame, done: DataFrame, key: str, horizon: str, late: str) -> DataFrame:
    """(event_id, key, ignored) of each upload: ignored if its key is done, or was started within the horizon before.

    uploads, started: streams of (event_id, key, ts). done: a table of keys. An upload that nothing
    was started for comes out when the watermark has passed it; one for which several were, once.
    """
    known = done.select(key).distinct().withColumn("done", F.lit(True))
    left = uploads.withWatermark("ts", late).join(known, key, "left")
    right = started.select(F.col(key).alias("started_key"), F.col("ts").alias("started_at")).withWatermark("started_at", late)
    reach = F.expr(f"{key} = started_key AND started_at <= ts AND started_at >= ts - INTERVAL {horizon}")
    flag = F.coalesce("done", F.lit(False)) | F.col("started_at").isNotNull()
    return left.join(right, reach, "leftOuter").select("event_id", key, "ts", flag.alias("ignored")).dropDuplicatesWithinWatermark(["event_id"]).drop("ts")


def upsert_each_batch(path: str, key: str, time: str):
    """A foreachBatch writer that keeps the newest row of each key under path.

    Every batch writes a folder of its own, so that a batch that runs again writes the same one.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), time).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def monotonic_progress(events: DataFrame, terminal: float = 100.0, key: str = "user_id", id_col: str = "event_id", time: str = "ts", value: str = "value") -> DataFrame:
    """T4: (id, key, progress): never falls; nothing after the terminal value."""
    schema = f"{id_col} {events.schema[id_col].dataType.simpleString()}, {key} {events.schema[key].dataType.simpleString()}, progress double"

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, done = state.get if state.exists else (float("-inf"), False)
        rows = pd.concat(list(frames)).sort_values([time, id_col])
        progress = np.maximum(np.maximum.accumulate(rows[value].to_numpy(float)), best)
        ended = np.flatnonzero(progress >= terminal)
        kept = 0 if done else int(ended[0]) + 1 if len(ended) else len(progress)
        state.update((float(progress[kept - 1]) if kept else best, done or len(ended) > 0))
        yield pd.DataFrame({id_col: rows[id_col].to_numpy()[:kept], key: of[0], "progress": progress[:kept]})

    return events.groupBy(key).applyInPandasWithState(step, schema, "best double, done boolean", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The stream, by name, run over all that is there, with its state and rows in the shared folder; no row reaches the driver.

    Appended rows go to a file sink. A complete result is written anew by each batch, in a folder of
    its own, so that a batch that runs again writes the same one; the newest is read.
    """
    spark = stream.sparkSession
    path = shared_dir(spark)
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{path}/rows").start()
    else:
        q = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    if mode == "append":
        return rows
    return rows.where(F.col("batch") == rows.select(F.max("batch")).scalar()).drop("batch")


def drained_to_end(events: DataFrame, make, beats: DataFrame, name: str) -> DataFrame:
    """The rows of make(events) over all that is there, and over what only a later event brings out.

    The stream runs until it has read everything and stops; then beats, rows of a later time, are
    written beside the events, and it goes on from its checkpoint, so that the watermark passes them.
    """
    spark = events.sparkSession
    path = shared_dir(spark)
    beats.limit(0).write.parquet(f"{path}/beats")
    stream = make(events.unionByName(spark.readStream.schema(beats.schema).parquet(f"{path}/beats")))
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        for run in range(2):
            if run:
                beats.write.mode("append").parquet(f"{path}/beats")
            stream.writeStream.queryName(f"{name}_{run}").outputMode("append").option("checkpointLocation", f"{path}/state").format("parquet").option("path", f"{path}/rows").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
