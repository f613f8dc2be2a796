"""Repeated fixed-length windows of token sequences, without shuffling every window.

Every window holds one anchor: the gram with the smallest hash in it (leftmost of equals). Equal windows hold equal
anchors at equal places, so a window can only repeat if its anchor does. Consecutive windows with one anchor travel as one
run: (anchor hash, hash of the run's whole stretch, document, place). Runs whose anchor occurs once in the corpus are dropped
before anything else is compared. Runs with equal stretches hold equal windows: they are counted first, so that a
group of copies is one stretch with a weight in all that follows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, forget, mix, raw_texts, rolling, settle, slices, tidy
from .idfilter import KeyFilter

#: A text with more tokens is handled in stretches of this many, so that places fit the low bits of a sort key.
CHUNK = 1 << 20
_PLACE = U64(0xFFFFFF)
BASE_1, BASE_2, BASE_3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        inverse = pow(BASE_3, -1, 1 << 64)
        for name, base in (("_powers", BASE_3), ("_inverses", inverse)):
            line = np.full(size, base, U64)
            line[0] = 1
            globals()[name] = np.cumprod(line)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each interval, one after another."""
    return np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def runs(values: np.ndarray, offsets: np.ndarray, width: int, gram: int, reach: int, most: int = CHUNK) -> tuple[np.ndarray, ...]:
    """row, first window, number of windows, how many of them have `reach` tokens left in the row, anchor hash, stretch hash and times of each run.

    values holds the tokens of all rows, one after another; offsets says where each begins. A stretch goes `reach` tokens from its last window's
    start, or to the end of its row. Equal runs that follow one another (periodic text) are one run so many times. At most `most` windows a row.
    """
    counts = np.clip(np.diff(offsets) - width + 1, 0, most)
    row = np.repeat(np.arange(len(counts)), counts)
    if not len(row):
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.int64, U64, U64, np.int64))
    at = spread(offsets[:-1], counts)
    grams = mix(rolling(values, gram, BASE_1))
    least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=U64), width - gram + 1)
    anchor = (least[at] & _PLACE).astype(np.int64)  # a place, so rows never share one
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    row, lo, owner = row[first], at[first], anchor[first]
    n = np.diff(np.append(first, len(anchor)))
    end = np.minimum(lo + n + reach - 1, offsets[row + 1])
    _grow(len(values) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * _powers[: len(values)], dtype=U64)])
    stretch = (sums[end] - sums[lo]) * _inverses[lo]
    shape = (owner - lo).astype(U64) * U64(BASE_2) + n.astype(U64) * U64(BASE_1) + (end - lo).astype(U64) * U64(BASE_3)
    stretch, anchor = mix(stretch + shape), grams[owner]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(row)))
    row, lo, n, anchor, stretch = (x[new] for x in (row, lo, n, anchor, stretch))
    return row, lo - offsets[row], n, np.clip(offsets[row + 1] - lo - reach + 1, 0, n), anchor, stretch, times


def run_table(docs: DataFrame, tokens: Callable, lift: Callable[[np.ndarray], np.ndarray], width: int, gram: int, reach: int, name: str) -> DataFrame:
    """Settled runs of all texts: doc_id, lo, n, deep, anchor, stretch, times.

    tokens() makes a function from texts to (tokens one after another, offsets); lift turns tokens into 64-bit values.
    """

    def find(batches):
        tokens_of = tokens()
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_numpy()
                values, offsets = tokens_of(raw_texts(part))
                blocks = [(0, values, offsets)] if len(values) - width < CHUNK else [(at, own := values[at : at + CHUNK + reach - 1], np.array([0, len(own)])) for at in range(0, len(values) - width + 1, CHUNK)]  # a long text has its part for itself
                for at, own, places in blocks:
                    row, lo, n, deep, anchor, stretch, times = runs(lift(own), places, width, gram, reach)
                    columns = [pa.array(ids[row]), pa.array(lo + at), pa.array(n.astype(np.int32)), pa.array(deep.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(times.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lo", "n", "deep", "anchor", "stretch", "times"])

    known = docs.filter("doc_id is not null")
    return settle(known.mapInArrow(tidy(find), "doc_id long, lo long, n int, deep int, anchor long, stretch long, times int"), name)


def repeated_runs(table: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(runs whose anchor repeats, their stretches), both settled; the table of all runs is deleted.

    A stretch has copies (how many runs are equal to it), n, deep and first (the earliest of the runs: doc_id, lo). Every count combines before its shuffle, so
    a hot anchor or stretch arrives as one row a task.
    """
    anchors = settle(table.groupBy("anchor").agg(F.sum("times").alias("c")).filter("c > 1").select("anchor"), f"{name}-anchors")
    likely, _ = KeyFilter(anchors, "anchor").split(table, "anchor")
    some = settle(likely.join(anchors, "anchor", "left_semi"), f"{name}-repeated")
    forget(table, anchors)
    stretches = some.groupBy("anchor", "stretch").agg(F.sum("times").alias("copies"), F.min("n").alias("n"), F.min("deep").alias("deep"), F.min(F.struct("doc_id", "lo")).alias("first"))
    return some, settle(stretches, f"{name}-stretches")


def later_runs(some: DataFrame, stretches: DataFrame) -> DataFrame:
    """The runs that are not the first of their stretch: doc_id, lo, n, deep, times. Their windows count with the first run's."""
    twice = stretches.filter("copies > 1").select("anchor", "stretch", "first")
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("lo") == F.col("first.lo"))
    joined = some.join(twice, ["anchor", "stretch"]).filter(~is_first | (F.col("times") > 1))
    return joined.select("doc_id", F.when(is_first, F.col("lo") + F.col("n")).otherwise(F.col("lo")).alias("lo"), "n", "deep", F.when(is_first, F.col("times") - 1).otherwise(F.col("times")).alias("times"))


def by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """doc_id and `items`: the rows' columns as an array of structs; bounded by what one text holds."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("items"))


def flat_items(items: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each item, the items) of a list column."""
    sizes = items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), items.flatten()


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end): the union of the intervals, whatever their order."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(starts, n), 1)
    np.add.at(edge, np.minimum(ends, n), -1)
    return np.cumsum(edge[:-1]) > 0
