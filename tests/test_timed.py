"""Event-time state machines: streams with rows out of order and late ones give what the batch gives."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomline.streaming import alerts, stateful, timed

END = 10_000_000  # seconds: a last row that moves the watermark past all others


def replay(spark, at, name, rows, schema, build, delay="60 seconds", keep=None, sentinel=None, outputs="append"):
    """Rows (micro-batches of (seconds, ...)) as a stream of files, one micro-batch each; the result of build(stream)."""
    src = at / f"{name}-in"
    for k, batch in enumerate([*rows, *([[sentinel]] if sentinel else [])]):
        df = spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_micros(((F.col("s") + 3600) * 1_000_000).cast("long"))).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(src))
    # files in order of their time of writing; the clock begins an hour after the epoch, where watermarks begin
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src)).withWatermark("ts", delay)
    q = build(stream).writeStream.outputMode(outputs).format("memory").queryName(name).option("checkpointLocation", str(at / f"{name}-c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return [tuple(r) for r in spark.table(name).collect()]


def batch_of(spark, rows, schema):
    return spark.createDataFrame([r for b in rows for r in b], schema).withColumn("ts", F.timestamp_micros(((F.col("s") + 3600) * 1_000_000).cast("long"))).drop("s")


def shuffled(rows, seed, parts, slack):
    """Rows in micro-batches whose times overlap by less than the watermark's delay."""
    r = random.Random(seed)
    order = sorted(rows, key=lambda x: x[0] + r.uniform(0, slack))
    size = -(-len(order) // parts)
    return [order[k : k + size] for k in range(0, len(order), size)]


def test_increase_with_resets_out_of_order_and_late_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(float(s), f"k{s % 3}", s, None if s % 17 == 0 else float(r.randint(0, 50))) for s in range(0, 400, 5)]
    schema = "s double, key string, id long, v double"
    batches = shuffled(rows, 1, 4, 50)
    build = lambda st: timed.increase_stream(st, "key", "ts", "id", "v")
    got = replay(spark, tmp_path, "inc", batches, schema, build, sentinel=(float(END), "end", 0, 0.0))
    want = alerts.increase(batch_of(spark, batches, schema), ["key"], "ts", "v").select("key", "ts", "id", "v", F.col("increase").cast("double")).collect()
    assert sorted(map(repr, got)) == sorted(repr(tuple(x)) for x in want)
    # a row later than the watermark is dropped: the others are as if it had never been
    late = [[(0.0, "a", 1, 5.0), (1000.0, "a", 2, 9.0)], [(1500.0, "a", 3, 4.0)], [(10.0, "a", 4, 7.0), (1550.0, "a", 5, 6.0)]]
    got = replay(spark, tmp_path, "late", late, schema, build, sentinel=(float(END), "end", 0, 0.0))
    assert sorted((x[2], x[4]) for x in got) == [(1, 0.0), (2, 4.0), (3, 4.0), (5, 2.0)]


def test_token_bucket_stream_equals_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [(round(r.uniform(0, 300), 1), r.choice("ab"), k, float(r.randint(1, 6))) for k in range(80)]
    schema = "s double, key string, id long, cost double"
    batches = shuffled(rows, 2, 4, 40)
    got = replay(spark, tmp_path, "bucket", batches, schema, lambda st: timed.token_bucket_stream(st, "ts", 0.5, 8.0), sentinel=(float(END), "end", 0, 1.0))
    batch = batch_of(spark, batches, schema).withColumn("at", F.unix_micros("ts") / 1e6)
    want = {x["id"]: (x["key"], x["admitted"], x["wait"]) for x in stateful.token_bucket(batch, 0.5, 8.0).collect()}
    assert len(got) == len(want)
    for key, i, admitted, wait in got:
        assert want[i][0] == key and want[i][1:] == pytest.approx((admitted, wait), abs=1e-6)


def test_reasoning_stream_equals_batch(spark, tmp_path):
    r = random.Random(7)
    texts = {k: "".join(r.choice(["ab", "<think>", "</think>", "x<", "think"]) for _ in range(40)) for k in ("p", "q", "r")}
    rows = []
    for n, (key, text) in enumerate(texts.items()):
        cuts = [0, *sorted(r.sample(range(1, len(text)), 12)), len(text)]
        rows += [(10.0 * i + n, key, i, text[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    schema = "s double, key string, seq long, chunk string"
    batches = shuffled(rows, 3, 4, 55)
    got = replay(spark, tmp_path, "split", batches, schema, lambda st: timed.split_reasoning_stream(st, "ts", idle="5 minutes"), sentinel=(float(END), "end", 0, "-"))
    for w in stateful.split_reasoning(batch_of(spark, batches, schema)).collect():
        own = sorted(x for x in got if x[0] == w["key"])
        assert "".join(x[2] for x in sorted(own, key=lambda x: x[1])) == w["emitted"]
        assert "".join(x[3] for x in sorted(own, key=lambda x: x[1])) == w["thought"]
        assert max(x[4] for x in own) == w["dropped_closes"] and any(x[6] for x in own) == w["unclosed"]
    # a null chunk ends a key at once; what comes later begins anew
    ended = [[(0.0, "a", 0, "x<think>y"), (1.0, "a", 1, None), (2.0, "a", 2, "z</think>")]]
    got = replay(spark, tmp_path, "ended", ended, schema, lambda st: timed.split_reasoning_stream(st, "ts"), sentinel=(float(END), "end", 0, "-"))
    assert sorted(x[1:] for x in got if x[0] == "a")[:2] == [(0, "x", "y", 0, 0, False), (1, "", "", 0, 0, True)]
    assert sorted(x[2:5] for x in got if x[0] == "a" and x[1] == 2) == [("", "", 1), ("z", "", 1)]  # the chunk, and the end of its key


def test_lease_spells_on_streams_and_batches(spark, tmp_path):
    r = random.Random(9)
    rows = [(float(t), f"w{k}") for k in range(3) for t in sorted(r.sample(range(0, 3000), 25))] + [(100.0, "w9"), (200.0, "w9"), (300.0, "w9"), (150.0, "w9")]
    schema = "s double, key string"
    batches = shuffled(rows, 4, 5, 50)
    batch = timed.lease_spells(batch_of(spark, batches, schema), "key", "ts", 100)
    want = sorted(map(tuple, batch.collect()))
    got = replay(spark, tmp_path, "lease", batches, schema, lambda st: timed.lease_spells(st, "key", "ts", 100), sentinel=(float(END), "end"))
    assert sorted(x for x in got if x[0] != "end") == want
    nine = [(x[4], (x[3] - x[1]).total_seconds()) for x in want if x[0] == "w9"]
    assert nine == [(3, 200.0), (1, 100.0)]  # a heartbeat at the moment of expiry acquires the lease anew
    # an early heartbeat that comes last joins two spells that were apart
    joined = [[(0.0, "a"), (150.0, "a")], [(80.0, "a")]]
    got = replay(spark, tmp_path, "joined", joined, schema, lambda st: timed.lease_spells(st, "key", "ts", 100), delay="100 seconds", sentinel=(float(END), "end"))
    assert [(x[0], x[4]) for x in got] == [("a", 3)]


def test_lease_clock_drops_leases_by_ttl(spark, tmp_path):
    """By the clock: Spark goes on for ever, so the test waits for rows and stops the stream."""
    src = tmp_path / "beats"
    spark.createDataFrame([("a",), ("a",)], "key string").coalesce(1).write.parquet(str(src))
    stream = timed.lease_clock(spark.readStream.schema("key string").parquet(str(src)), "key", 3600)

    def run(rows):
        q = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            for _ in range(120):
                got = sorted(tuple(r)[:3] for r in spark.read.schema("key string, what string, beats long").parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out" / "_spark_metadata").exists() else []
                if len(got) >= rows:
                    return got
                time.sleep(0.5)
        finally:
            q.stop()
        return got

    assert run(1) == [("a", "acquired", 2)]
    spark.createDataFrame([("a",), ("b",)], "key string").coalesce(1).write.mode("append").parquet(str(src))
    assert run(3) == [("a", "acquired", 2), ("a", "renewed", 3), ("b", "acquired", 1)]


@pytest.mark.parametrize("times", [1, 2, 3])
def test_held_alerts_of_a_stream_equal_the_batch(spark, tmp_path, times):
    r = random.Random(13)
    rows = [(float(s), f"k{s % 2}", float(r.choice([1, 1, 9]) if 300 < s < 900 or s > 1300 else 1)) for s in range(0, 2000, 7) if not 1000 < s < 1100]
    schema = "s double, k string, v double"
    batches = shuffled(rows, 5, 4, 50)
    build = lambda df: alerts.held(alerts.alert_rate(df, "ts", "v", ["k"], 15.0, "2 minutes", "1 minute", 1.0), ["k"], F.col("fires"), times, 60)
    want = sorted(map(tuple, build(batch_of(spark, batches, schema)).collect()))
    got = replay(spark, tmp_path, f"held{times}", batches, schema, build, sentinel=(float(END), "end", 0.0))
    assert want and sorted(got) == want


def test_held_ratio_without_keys_and_gauge(spark, tmp_path):
    rows = [(float(s), f"k{s % 2}", float(s // 100 % 3)) for s in range(0, 1500, 10)]
    schema = "s double, k string, v double"
    batches = shuffled(rows, 6, 3, 40)
    ratio = lambda df: alerts.held(alerts.alert_ratio(df, "ts", [], F.col("v") > 1, F.lit(True), 0.25, "2 minutes", "1 minute"), [], F.col("fires"), 2, 60)
    gauge = lambda df: alerts.held(alerts.alert_gauge(df, "ts", "v", ["k"], above=1.0), ["k"], F.col("fires"), 1, 60)
    for name, build in (("ratio", ratio), ("gauge", gauge)):
        want = sorted(map(tuple, build(batch_of(spark, batches, schema)).collect()))
        got = replay(spark, tmp_path, name, batches, schema, build, sentinel=(float(END), "end", 0.0))
        assert want and sorted(got) == want


def test_rows_are_let_out_in_order():
    """The buffer alone: what is final goes by (time, id), the rest waits; chunks wait for earlier ones that are not final."""
    rows = [(30, 1, "c"), (10, 2, "b"), (10, 1, "a"), (50, 0, "d")]
    assert timed.Increase().ready(list(rows), 30) == ([(10, 1, "a"), (10, 2, "b"), (30, 1, "c")], [(50, 0, "d")])
    chunks = timed.ReasoningSplitter(False, 1000)
    assert chunks.ready([(10, 5, "late number", False), (40, 4, "not final", False), (5, 3, "first", False)], 20) == ([(5, 3, "first", False)], [(40, 4, "not final", False), (10, 5, "late number", False)])
    assert timed.ceil_ms(1001) == 2 and timed.ceil_ms(1000) == 1
    assert isinstance(pd.Timedelta("1 hour") / pd.Timedelta(milliseconds=1), float)
