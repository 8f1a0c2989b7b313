"""Stateful streams over several micro-batches, late rows and a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimloom.streaming import lifecycle as streams

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp"
T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in streams.ROCKS}
    for k, v in streams.ROCKS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def feed(spark, path, batch):
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, make, path, out):
    """One run over what is there, from the checkpoint of the last."""
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))
    stream.writeStream.option("checkpointLocation", f"{out}/state").format("parquet").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").collect()


def test_trailing_counts_are_exact_over_batches(spark, rocks, tmp_path):
    rng = random.Random(1)
    events = [(i, rng.choice([1, 1, 1, 2, 3]), "x", T0 + dt.timedelta(seconds=rng.randrange(60 * 86400))) for i in range(300)]
    events += [(900 + i, 1, "x", T0 + 20 * DAY + dt.timedelta(milliseconds=i)) for i in range(5)]  # one second
    events.sort(key=lambda e: e[3])
    make = lambda rows: streams.trailing_counts(rows, "user_id", "ts", 7, "1 day")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    head = events[:100]
    rng.shuffle(head)  # out of order within a batch
    for part in (head, events[100:200], events[200:]):
        feed(spark, path, part)
        got = run(spark, make, path, out)
    assert len(got) < len(events)  # the last day waits
    feed(spark, path, [(None, -1, "beat", T0 + 400 * DAY)])
    feed(spark, path, [(5000, 1, "x", T0)])  # too late: dropped
    got = {r["event_id"]: r["recent"] for r in run(spark, make, path, out)}
    second = lambda t: int((t - T0).total_seconds())
    want = {i: sum(u == v and second(t) - 7 * 86400 <= second(s) <= second(t) for _, v, _, s in events) for i, u, _, t in events}
    assert got == want


def test_gate_is_the_same_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    events = sorted(((i, rng.randrange(12), rng.choice(["up", "start"]), T0 + dt.timedelta(seconds=rng.randrange(40 * 86400))) for i in range(250)), key=lambda e: e[3])
    done = spark.createDataFrame([(3,), (3,), (4,)], "user_id long")

    def gate(rows):
        of = lambda kind: rows.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
        return streams.gated(of("up"), of("start"), done, "user_id", "3 DAYS", "1 day")

    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (events[:90], events[90:180], events[180:], [(None, -1, k, T0 + 400 * DAY) for k in ("up", "start")]):
        feed(spark, path, part)
        got = run(spark, gate, path, out)
    told = [(r["event_id"], r["ignored"]) for r in got if r["event_id"] is not None]
    ups = [e for e in events if e[2] == "up"]
    want = {i: u in (3, 4) or any(v == u and k == "start" and t - 3 * DAY <= s <= t for _, v, k, s in events) for i, u, _, t in ups}
    assert len(told) == len(ups) and dict(told) == want and len(set(want.values())) == 2
