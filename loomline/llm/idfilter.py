"""A runtime filter on 64-bit keys: rows that surely have no partner leave before a shuffle.

A bitmap with one bit for each hash bucket, at most 2^max_bits bits (8 MB at the default) whatever the input. Rows that pass
may still lack a partner, so a join follows; the filter changes what is shuffled, never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, tidy


def _bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(U64)) >> U64(64 - bits)).astype(np.int64)


class KeyFilter:
    """May a key be among those the filter was built from? Travels to tasks as a broadcast variable."""

    def __init__(self, keys: DataFrame, column: str, per_key: int = 16, max_bits: int = 26):
        n = keys.count()
        bits = self.bits = min(max_bits, max(12, (per_key * max(1, n)).bit_length()))

        def words(batches):
            seen = np.zeros(1 << (bits - 6), U64)
            for batch in batches:
                at = _bits(batch.column(0).to_numpy(zero_copy_only=False), bits)
                np.bitwise_or.at(seen, at >> 6, U64(1) << (at & 63).astype(U64))
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some].view(np.int64))], ["word", "bits"])

        made = keys.select(F.col(column).cast("long")).filter(f"`{column}` is not null").mapInArrow(tidy(words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        bitmap = np.zeros(1 << (bits - 6), U64)
        bitmap[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(U64)
        self.shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    def mask(self, keys: np.ndarray) -> np.ndarray:
        at = _bits(keys, self.bits)
        return (self.shared.value[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(bool)

    def hits(self, keys: pa.Array) -> np.ndarray:
        """Which of a batch's keys may have a partner; null keys have none. For tasks that filter and go on in one pass."""
        return self.mask(keys.fill_null(0).to_numpy(zero_copy_only=False)) & np.asarray(keys.is_valid())

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """(rows that may have a partner, rows that have none; null keys have none). Every row is in exactly one of them."""
        return self._rows(df, column, True), self._rows(df, column, False)

    def _rows(self, df: DataFrame, column: str, want: bool) -> DataFrame:
        hits = self.hits

        def keep(batches):
            for batch in batches:
                yield batch.filter(pa.array(hits(batch.column(column)) == want))

        return df.mapInArrow(tidy(keep), df.schema)
