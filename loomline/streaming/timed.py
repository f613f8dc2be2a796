"""Per-key state machines on event time (transformWithState): leases, alerts that must hold, counters, token buckets, reasoning splits.

Each gives on a stream what its batch form gives on the same rows, whatever order they arrive in, as long as none is later than the
stream's watermark: rows wait in state until the watermark has passed them, and a timer lets them out in order. Rows later than the watermark are dropped by Spark. Streams need
withWatermark(ts, ...) before, and the RocksDB state store; use_state_store() sets it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import CAP, SPLIT_COLUMNS, admit, advance

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def ceil_ms(micros: int) -> int:
    return -(-micros // 1000)


class InOrder(StatefulProcessor):
    """Rows wait in a list until the watermark has passed their time; then release() gets them in order.

    Columns: at (microseconds), id (order among equal times), and `fields`. A subclass gives the schema of its own state, what a row does to it, and when a key that has nothing
    waiting may be forgotten.
    """

    fields: Sequence[tuple[str, str]] = ()
    state_schema = ""
    columns: Sequence[str] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["at bigint", "id bigint", *[f"{n} {t}" for n, t in self.fields]]))
        self.own = handle.getValueState("own", self.state_schema)

    def start(self) -> tuple:
        """The state of a new key."""
        raise NotImplementedError

    def step(self, key: tuple, state: tuple, row: tuple) -> tuple[tuple, Iterable[tuple]]:
        """The state after a row, and the rows that it emits."""
        raise NotImplementedError

    def idle_from(self, state: tuple) -> int | None:
        """Event time in ms from which a key with nothing waiting can be forgotten; None for never."""
        return None

    def finish(self, key: tuple, state: tuple) -> Iterable[tuple]:
        """What a key that is forgotten still emits."""
        return ()

    def ready(self, rows: list[tuple], final_us: int) -> tuple[list[tuple], list[tuple]]:
        """(rows to let out, in order; rows that still wait)."""
        rows.sort(key=lambda r: r[:2])
        cut = next((k for k, r in enumerate(rows) if r[0] > final_us), len(rows))
        return rows[:cut], rows[cut:]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, first = ["at", "id", *[n for n, _ in self.fields]], None
        for pdf in rows:
            own = [tuple(None if x is None or x != x else x for x in r) for r in zip(*(pdf[n].tolist() for n in names), strict=True)]
            if own:
                self.waiting.appendList(own)
                first = min(r[0] for r in own) if first is None else min(first, *[r[0] for r in own])
        if first is not None:
            self.handle.registerTimer(max(ceil_ms(first), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.own.get()
        state = None if held is None else tuple(held)
        out: list[tuple] = []
        free, rest = self.ready([tuple(r) for r in self.waiting.get()], now * 1000)
        if free:
            state = self.start() if state is None else state
            for row in free:
                state, emitted = self.step(key, state, row)
                out += emitted
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if rest:
            self.handle.registerTimer(max(ceil_ms(min(r[0] for r in rest)), now + 1))
        if state is not None:
            end = self.idle_from(state)
            if not rest and end is not None and end <= now:
                out += self.finish(key, state)
                self.own.clear()
            else:
                self.own.update(state)
                if not rest and end is not None:
                    self.handle.registerTimer(end)
        return iter([pd.DataFrame(out, columns=list(self.columns))] if out else ())

    def close(self) -> None:
        pass


class Increase(InOrder):
    """The last sample of each series as state."""

    fields = (("value", "double"),)
    state_schema = "last double"
    columns = ("key", "at", "id", "value", "increase")

    def start(self):
        return (None,)

    def step(self, key, state, row):
        at, id_, value = row
        before = state[0]
        if value is None:
            return state, [(key[0], at, id_, None, None)]
        up = 0.0 if before is None else value if value < before else value - before
        return (value,), [(key[0], at, id_, value, up)]


def _keyed(stream: DataFrame, key: Column, ts: str, id_: Column, **fields: Column):
    """Rows as the processors take them, grouped by key. The event time stays beside them, so that late rows are dropped."""
    use_state_store(stream.sparkSession)
    return stream.select(key.cast("string").alias("key"), F.col(ts).alias("event_time"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), id_.cast("long").alias("id"), *[c.alias(n) for n, c in fields.items()]).groupBy("key")


def increase_stream(samples: DataFrame, key: str, ts: str, id_: str, value: str) -> DataFrame:
    """key, at, id, value, increase: alerts.increase() over a stream, for each series in order of (ts, id). A null sample is passed over."""
    grouped = _keyed(samples, F.col(key), ts, F.col(id_), value=F.col(value).cast("double"))
    out = grouped.transformWithStateInPandas(Increase(), "key string, at long, id long, value double, increase double", "append", "eventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


class TokenBucket(InOrder):
    """The bucket as state. One that has filled up again is a new one, so it is forgotten."""

    fields = (("came", "double"), ("cost", "double"))
    state_schema = "tokens double, last double"
    columns = ("key", "id", "admitted", "wait")

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def start(self):
        return (self.burst, None)

    def step(self, key, state, row):
        _, id_, came, cost = row
        tokens, last = state
        tokens, last, wait = admit(tokens, came if last is None else last, came, cost, self.rate, self.burst)
        return (tokens, last), [(key[0], id_, last, wait)]

    def idle_from(self, state):
        tokens, last = state
        return int(1000 * (last + (self.burst - tokens) / self.rate)) + 1000


def token_bucket_stream(events: DataFrame, ts: str, rate: float, burst: float) -> DataFrame:
    """stateful.token_bucket() over a stream: key, id, admitted, wait. events: key, id, cost and the event time ts, whose seconds are the clock."""
    grouped = _keyed(events, F.col("key"), ts, F.col("id"), came=F.unix_micros(F.col(ts).cast("timestamp")) / 1e6, cost=F.col("cost").cast("double"))
    return grouped.transformWithStateInPandas(TokenBucket(rate, burst), "key string, id long, admitted double, wait double", "append", "eventTime")


class ReasoningSplitter(InOrder):
    """Chunks in order of their number. A chunk waits for those before it that have come but whose time is not final yet; after `idle` ms without one the key ends."""

    fields = (("chunk", "string"), ("ended", "boolean"))
    state_schema = "buffer string, thinking boolean, kept bigint, closes int, overflow bigint, seq bigint, at bigint"
    columns = tuple(SPLIT_COLUMNS)

    def __init__(self, starts_thinking: bool, idle_ms: int, cap: int = CAP):
        self.starts_thinking, self.idle_ms, self.cap = starts_thinking, idle_ms, cap

    def start(self):
        return ("", self.starts_thinking, 0, 0, 0, -1, 0)

    def ready(self, rows, final_us):
        rows.sort(key=lambda r: r[1])
        cut = next((k for k, r in enumerate(rows) if r[0] > final_us), len(rows))
        return rows[:cut], rows[cut:]

    def step(self, key, state, row):
        buffer, thinking, kept, closes, over, seq, latest = state
        at, id_, chunk, ended = row
        buffer, thinking, kept, emitted, thought, stray, lost = advance(buffer, thinking, kept, chunk or "", bool(ended), self.cap)
        closes, over = closes + stray, over + lost
        out = [(key[0], id_, emitted, thought, closes, over, bool(ended) and thinking)]
        return (self.start() if ended else (buffer, thinking, kept, closes, over, id_, max(at, latest))), out

    def idle_from(self, state):
        return 0 if state[5] < 0 else ceil_ms(state[6]) + self.idle_ms

    def finish(self, key, state):
        buffer, thinking, kept, closes, over, seq, _ = state
        if seq < 0:  # ended by its own last chunk
            return ()
        _, thinking, kept, emitted, thought, stray, lost = advance(buffer, thinking, kept, "", True, self.cap)
        return [(key[0], seq, emitted, thought, closes + stray, over + lost, thinking)]


def split_reasoning_stream(chunks: DataFrame, ts: str, starts_thinking: bool = False, idle: str = "1 hour") -> DataFrame:
    """stateful.split_reasoning() over a stream: one row a chunk, and one for what the end lets go, so their emitted and thought texts joined by seq are the batch's.

    chunks: key, seq, chunk and the event time ts. A null chunk ends its key; so does a pause of `idle`.
    """
    idle_ms = int(pd.Timedelta(idle) / pd.Timedelta(milliseconds=1))
    grouped = _keyed(chunks, F.col("key"), ts, F.col("seq"), chunk=F.col("chunk"), ended=F.col("chunk").isNull())
    return grouped.transformWithStateInPandas(ReasoningSplitter(starts_thinking, idle_ms), ", ".join(f"{n} {t}" for n, t in SPLIT_COLUMNS.items()), "append", "eventTime")


class Leases(StatefulProcessor):
    """Spells of heartbeats in a list. A heartbeat joins the spells that it lies less than the time to live from, so a late one can join two. One timer a key, at the earliest end of a spell:
    each call to the state is a message, so a key costs a few, however many spells it has."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spells = handle.getListState("spells", "acquired bigint, last bigint, beats bigint")

    def timer(self, spells: list[tuple], now_ms: int) -> None:
        """A timer at the end of the spell that ends first."""
        self.handle.registerTimer(max(ceil_ms(min(last for _, last, _ in spells) + self.ttl), now_ms + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(v) for v in self.spells.get()]
        spells = before + [(int(a), int(a), 1) for pdf in rows for a in pdf["at"].tolist()]
        after: list[list[int]] = []
        for a, last, beats in sorted(spells):
            if after and a < after[-1][1] + self.ttl:
                after[-1][1], after[-1][2] = max(after[-1][1], last), after[-1][2] + beats
            else:
                after.append([a, last, beats])
        if after:
            self.spells.put([tuple(x) for x in after])
            self.timer(after, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        spells = sorted(tuple(v) for v in self.spells.get())
        over = [x for x in spells if x[1] + self.ttl <= now * 1000]  # no heartbeat that comes from now on can prolong it
        rest = [x for x in spells if x[1] + self.ttl > now * 1000]
        if over and rest:
            self.spells.put(rest)
        elif over:
            self.spells.clear()
        if rest:
            self.timer(rest, now)
        out = [(key[0], a, last, last + self.ttl, beats) for a, last, beats in over]
        return iter([pd.DataFrame(out, columns=["key", "acquired", "last", "expires", "beats"])] if out else ())

    def close(self) -> None:
        pass


def lease_spells(heartbeats: DataFrame, key: str, ts: str, ttl_seconds: int = 3600) -> DataFrame:
    """Each time a lease was held: key, acquired, last (heartbeat), expires, beats. It lapses when no heartbeat has come for ttl_seconds; one that comes then, or later, acquires it anew.

    On a stream, one row when the lease has expired.
    """
    ttl, spell = ttl_seconds * 1_000_000, ("acquired", "last", "expires")
    if heartbeats.isStreaming:
        out = _keyed(heartbeats, F.col(key), ts, F.lit(0)).transformWithStateInPandas(Leases(ttl), "key string, acquired long, last long, expires long, beats long", "append", "eventTime")
    else:
        by = Window.partitionBy("key").orderBy("at")
        rows = heartbeats.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).filter("at is not null")
        begins = F.coalesce(F.col("at") >= F.lag("at").over(by) + ttl, F.lit(True))
        rows = rows.withColumn("__n", F.sum(begins.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        out = rows.groupBy("key", "__n").agg(F.min("at").alias("acquired"), F.max("at").alias("last"), F.count("*").alias("beats")).withColumn("expires", F.col("last") + ttl)
    return out.select("key", *[F.timestamp_micros(c).alias(c) for c in spell], "beats")


class LeaseClock(StatefulProcessor):
    """The lease as a value that Spark drops when its time to live has passed on the clock."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.beats = handle.getValueState("lease", "beats bigint", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.beats.exists()
        beats = (self.beats.get()[0] if held else 0) + sum(len(pdf) for pdf in rows)
        self.beats.update((beats,))
        now = timerValues.getCurrentProcessingTimeInMs()
        yield pd.DataFrame([(key[0], "renewed" if held else "acquired", beats, now + self.ttl)], columns=["key", "what", "beats", "expires"])

    def close(self) -> None:
        pass


def lease_clock(heartbeats: DataFrame, key: str, ttl_seconds: float) -> DataFrame:
    """Leases by the clock, for streams without event times: key, what (acquired or renewed), beats and expires for each key that is heard from in a micro-batch."""
    use_state_store(heartbeats.sparkSession)
    out = heartbeats.select(F.col(key).cast("string").alias("key")).groupBy("key").transformWithStateInPandas(LeaseClock(int(1000 * ttl_seconds)), "key string, what string, beats long, expires long", "append", "processingTime")
    return out.withColumn("expires", F.timestamp_millis("expires"))


class Held(StatefulProcessor):
    """How many consecutive windows have fired, and when the last one ended. Windows close in order, so only those of one micro-batch need sorting."""

    def __init__(self, by: Sequence[str], columns: Sequence[str], times: int, slide_seconds: int):
        self.by, self.columns, self.times, self.slide = list(by), list(columns), times, slide_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", "last bigint, run bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, run = self.run.get() if self.run.exists() else (None, 0)
        pdf = pd.concat(list(rows)).sort_values("ended_at")
        keep = []
        for t in pdf["ended_at"].tolist():
            run = run + 1 if last is not None and t - last == self.slide else 1
            last = t
            keep.append(run >= self.times)
        self.run.update((int(last), int(run)))
        self.handle.registerTimer(max((int(last) + self.slide) * 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pdf.loc[keep, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists() and (self.run.get()[0] + self.slide) * 1000 < timerValues.getCurrentWatermarkInMs():
            self.run.clear()  # the next window would have come: the run is over
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def held_stream(measured: DataFrame, by: Sequence[str], firing: Column, times: int, slide_seconds: int) -> DataFrame:
    """alerts.held() over watermarked windows of a stream (alerts.windowed() and what is built on it, which have their event time in `closed`)."""
    use_state_store(measured.sparkSession)
    columns = [c for c in measured.columns if c != "closed"]
    rows = measured.filter(firing).withColumn("ended_at", F.col("at").cast("timestamp").cast("long")).withColumn("no_key", F.lit(0))
    schema = measured.select(*columns).schema
    return rows.groupBy(*(by or ["no_key"])).transformWithStateInPandas(Held(by, columns, times, slide_seconds), schema, "append", "eventTime")
