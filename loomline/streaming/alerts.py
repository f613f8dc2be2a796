"""Windowed measures and alerts over event streams; the same expressions run on batches.

Times are event times. Watermarks are the caller's: withWatermark before, for streams. Sliding windows are `length` long and move by `slide`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timed import held_stream


def windowed(events: DataFrame, ts: str, by: Sequence[str], length: str, slide: str | None, **measures: Column) -> DataFrame:
    """Aggregates by window end and keys; on a stream also `closed`, the window's event time, which state that follows goes by."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    closed = [F.window_time("__w").alias("closed")] if events.isStreaming else []
    return events.groupBy(w.alias("__w"), *by).agg(*[m.alias(n) for n, m in measures.items()]).select(F.col("__w.end").alias("at"), *by, *measures, *closed)


def held(measured: DataFrame, by: Sequence[str], firing: Column, times: int, slide_seconds: int) -> DataFrame:
    """Windows in which the condition has held for `times` consecutive windows; a missing window breaks the run. On a stream, as the windows close."""
    if times <= 1:
        return measured.filter(firing).drop("closed")
    if measured.isStreaming:
        return held_stream(measured, by, firing, times, slide_seconds)
    w = Window.partitionBy(*by).orderBy("__t")
    rows = measured.withColumn("__t", F.col("at").cast("timestamp").cast("long")).filter(firing)
    back = F.lag("__t", times - 1).over(w)
    return rows.withColumn("__b", back).filter(F.col("__t") - F.col("__b") == (times - 1) * slide_seconds).drop("__t", "__b")


def alert_rate(events: DataFrame, ts: str, value: str, by: Sequence[str], limit: float, length: str = "5 minutes", slide: str = "1 minute", minutes: float = 5.0) -> DataFrame:
    """Per minute rate over the window, with fires: rate above the limit."""
    out = windowed(events, ts, by, length, slide, total=F.sum(value))
    return out.withColumn("rate", F.col("total") / minutes).withColumn("fires", F.col("total") / minutes > limit)


def alert_ratio(events: DataFrame, ts: str, by: Sequence[str], bad: Column, all_: Column, limit: float = 0.25, length: str = "10 minutes", slide: str = "1 minute") -> DataFrame:
    """Bad over all in the window, with fires."""
    out = windowed(events, ts, by, length, slide, bad=F.count_if(bad), n=F.count_if(all_))
    return out.withColumn("ratio", F.try_divide("bad", "n")).withColumn("fires", F.coalesce(F.try_divide("bad", "n") > limit, F.lit(False)))


def alert_gauge(events: DataFrame, ts: str, value: str, by: Sequence[str], above: float | None = None, below: float | None = None) -> DataFrame:
    """Last value of each minute, with fires: above or below the limit."""
    out = windowed(events, ts, by, "1 minute", None, last=F.max_by(value, F.struct(ts, value)))
    return out.withColumn("fires", (F.col("last") > above) if above is not None else (F.col("last") < below))


def alert_increase(events: DataFrame, ts: str, by: Sequence[str], condition: Column) -> DataFrame:
    """Minutes with any occurrence."""
    return windowed(events, ts, by, "1 minute", None, n=F.count_if(condition)).filter("n > 0")


def velocity(events: DataFrame, ts: str, value: str, by: Sequence[str]) -> DataFrame:
    """Per minute sum over two minutes."""
    return windowed(events, ts, by, "2 minutes", "1 minute", total=F.sum(value)).withColumn("velocity", F.col("total") / 2)


def histogram_quantile(buckets: DataFrame, by: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Quantiles by linear interpolation inside the bucket. buckets: by, le (upper bound), n (count in the bucket)."""
    w = Window.partitionBy(*by).orderBy("le")
    rows = buckets.withColumn("cum", F.sum("n").over(w)).withColumn("lower", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    q = rows.withColumn("q", F.explode(F.array(*map(F.lit, quantiles))))
    rank = F.col("q") * F.col("total")
    hit = q.filter((F.col("cum") >= rank) & (F.col("cum") - F.col("n") < rank))
    return hit.select(*by, "q", (F.col("lower") + (F.col("le") - F.col("lower")) * (rank - (F.col("cum") - F.col("n"))) / F.col("n")).alias("value"))


def status_share(events: DataFrame, ts: str, status: str, length: str = "1 hour") -> DataFrame:
    """Share of each status in its window."""
    n = windowed(events, ts, [status], length, None, n=F.count("*"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("at")))


def hit_ratio(events: DataFrame, ts: str, hit: Column, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    return windowed(events, ts, [], length, slide, hits=F.count_if(hit), n=F.count("*")).withColumn("ratio", F.col("hits") / F.col("n"))


def increase(samples: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Increase of a counter since the sample before; a fall is a reset, so the new value counts whole; the first sample has 0. A null sample is passed over. timed.increase_stream() is its stream form."""
    before = F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return samples.withColumn("increase", F.when(F.col(value).isNull(), None).when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


# Headers that never leave, attributes inserted where absent.
SECRET_HEADERS = ("http.request.header.authorization", "http.request.header.cookie", "http.request.header.x_api_key")


def scrub(attributes: Column, defaults: dict[str, str], secret: Sequence[str] = SECRET_HEADERS) -> Column:
    """Secret keys removed, defaults inserted where absent."""
    kept = F.map_filter(attributes, lambda k, v: ~k.isin(*secret))
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(kept, k)), kept)


def leases(heartbeats: DataFrame, key: str, ts: str, as_of: str, ttl_seconds: int = 3600) -> DataFrame:
    """Expiry of each lease (last heartbeat plus its time to live) and whether it is active at as_of."""
    out = heartbeats.groupBy(key).agg(F.max(F.col(ts).cast("timestamp").cast("long")).alias("last"))
    expires = F.col("last") + ttl_seconds
    return out.select(key, expires.alias("expires"), (F.lit(as_of).cast("timestamp").cast("long") < expires).alias("active"))


def deadband(failures: Column, headroom: Column, latency: Column, max_latency: float, min_headroom: float) -> Column:
    """The first rule that holds acts, else nothing: failure, headroom, latency over one and a half times the limit."""
    return F.when(failures > 0, "REPAIR").when(headroom < min_headroom, "REFACTOR").when(latency > 1.5 * max_latency, "OPTIMISE").otherwise("EQUILIBRIUM")
