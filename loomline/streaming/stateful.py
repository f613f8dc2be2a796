"""Per-key state machines as batches: the reasoning splitter and the token bucket (timed.py has their streams); dead letters and change loops.

Within a key, rows are handled in sequence order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, CAP = "<think>", "</think>", 65_536
SPLIT_COLUMNS = {"key": "string", "seq": "long", "emitted": "string", "thought": "string", "dropped_closes": "int", "overflow": "long", "unclosed": "boolean"}


def advance(buffer: str, thinking: bool, kept: int, chunk: str, last: bool, cap: int = CAP) -> tuple[str, bool, int, str, str, int, int]:
    """Feed a chunk: (buffer, thinking, thought kept so far, emitted, thought, stray closes, thought dropped)."""
    text, out, thought, stray, over = buffer + chunk, [], [], 0, 0
    while text:
        tags = (CLOSE,) if thinking else (OPEN, CLOSE)
        at, tag = min(((i, t) for t in tags if (i := text.find(t)) >= 0), default=(-1, ""))
        hold = 0
        if at < 0 and not last:  # the longest end that may begin a tag waits
            hold = next((n for n in range(min(len(text), len(CLOSE) - 1), 0, -1) if any(t.startswith(text[-n:]) for t in tags)), 0)
        cut = at if at >= 0 else len(text) - hold
        piece, text = text[:cut], text[cut + len(tag) :] if at >= 0 else text[cut:]
        if thinking:
            room = max(0, cap - kept)
            thought.append(piece[:room])
            kept += min(room, len(piece))
            over += max(0, len(piece) - room)
        else:
            out.append(piece)
        if at < 0:
            break
        if tag == CLOSE and not thinking:
            stray += 1
        else:
            thinking = tag == OPEN
    return text, thinking, kept, "".join(out), "".join(thought), stray, over


def split_reasoning(chunks: DataFrame, starts_thinking: bool = False) -> DataFrame:
    """Emitted and thought text of each stream, tags cut across chunks joined. chunks: key, seq, chunk. One row a key, unclosed if it ends in thought."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buffer, thinking, kept, emitted, thought, closes, over = "", starts_thinking, 0, [], [], 0, 0
        rows = pdf.sort_values("seq")
        n = len(rows)
        for i, chunk in enumerate(rows["chunk"].fillna("").tolist()):
            buffer, thinking, kept, e, t, c, o = advance(buffer, thinking, kept, chunk, i == n - 1)
            emitted.append(e), thought.append(t)
            closes, over = closes + c, over + o
        return pd.DataFrame([(rows["key"].iloc[0], int(rows["seq"].max()), "".join(emitted), "".join(thought), closes, over, thinking)], columns=list(SPLIT_COLUMNS))

    return chunks.selectExpr("cast(key as string) key", "cast(seq as bigint) seq", "chunk").groupBy("key").applyInPandas(run, ", ".join(f"{n} {t}" for n, t in SPLIT_COLUMNS.items()))


def admit(tokens: float, last: float, at: float, cost: float, rate: float, burst: float) -> tuple[float, float, float]:
    """(tokens left, time of admission, wait): refill, wait while short, subtract."""
    now = max(at, last)
    tokens = min(burst, tokens + (now - last) * rate)
    wait = max(0.0, (cost - tokens) / rate)
    return tokens + wait * rate - cost, now + wait, now + wait - at


def token_bucket(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """When each event is admitted: key, id, admitted, wait. events: key, id, at (seconds), cost. Event time stands for the clock; a bucket is sequential, so one pass a key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        tokens, last, out = burst, float(pdf["at"].iloc[0]), []
        for r in pdf.itertuples():
            tokens, last, wait = admit(tokens, last, float(r.at), float(r.cost), rate, burst)
            out.append((r.key, r.id, last, wait))
        return pd.DataFrame(out, columns=["key", "id", "admitted", "wait"])

    return events.selectExpr("cast(key as string) key", "cast(id as bigint) id", "cast(at as double) at", "cast(cost as double) cost").groupBy("key").applyInPandas(run, "key string, id long, admitted double, wait double")


def consume(stream: DataFrame, column: str, schema: str, table: str, dead: str, checkpoint: str):
    """Start a query that decodes JSON rows into `table` and undecodable ones into `dead` (parquet folders).

    A micro-batch has a folder of its own in each (batch=N, a partition column), which is overwritten: one that is run again after a failure leaves no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        decoded = batch.select(F.col(column), F.from_json(column, schema).alias("r"), F.try_parse_json(column).isNotNull().alias("ok"))
        decoded.filter("ok and r is not null").select("r.*").write.mode("overwrite").parquet(f"{table}/batch={number}")
        decoded.filter("not ok or r is null").select(column, F.current_timestamp().alias("seen")).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _expired(ts: str, as_of: str, hours: float) -> Column:
    return F.col(ts).cast("timestamp").cast("double") < F.lit(as_of).cast("timestamp").cast("double") - hours * 3600


def keep_dead(dead: DataFrame, ts: str, as_of: str, hours: float) -> DataFrame:
    """The dead letters that a purge leaves; those without a time stay."""
    return dead.filter(~F.coalesce(_expired(ts, as_of, hours), F.lit(False)))


def purge_dead(dead: DataFrame, ts: str, as_of: str, hours: float) -> DataFrame:
    """One row: how many dead letters would go and stay (a dry run); keep_dead() gives those that stay."""
    old = F.coalesce(_expired(ts, as_of, hours), F.lit(False))
    return dead.agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))


def on_change(files: DataFrame, handle, checkpoint: str):
    """Run handle(batch) for every micro-batch of changed rows: the continuous re-evaluation loop."""
    return files.writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
