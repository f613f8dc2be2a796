"""Best-fit packing by exact-complement hashing (operator 9).

Documents become id sequences, long ones are cut, and the pieces fill sequences of a fixed capacity.
The plan needs only how many pieces there are of each length (at most `capacity` numbers): it indexes
single, pair and triple length sums, fills gaps exactly while the counts last, and best-fits the rest.
Spark ranks the pieces of each length, by salted counts so that a common length is no hot group, and
the rank says which sequence and offset the plan gives the piece.

Edge cases: null or empty text is the end id alone, a piece of length 1. Repeated rows are packed each.
A null doc_id is packed like any other.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, settle, slices, tidy


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """Text and id of the added tokens of a tokenizer file, which take their one id wherever they stand in a text."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path}: an added token that takes in or looks at its surroundings")
    return tuple((t["content"], t["id"]) for t in added)


@lru_cache(2)
def byte_bpe(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """Text to ids by the byte-level BPE of a ranks file and the added tokens: the ids of the tokenizer file with the same vocabulary."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))
    return lambda text: bpe.encode(text, allowed_special="all") if any(t in text for t, _ in added) else bpe.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and salt (spreads pieces of one length). Added tokens are those of the tokenizer file, by default the .json beside the ranks."""
    added = added_tokens(tokenizer_path or f"{os.path.splitext(ranks_path)[0]}.json")

    def run(batches):
        encode = byte_bpe(ranks_path, pattern, added)
        for part in (part for batch in batches for part in slices(batch)):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].data)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Which lengths share a sequence, and how many such sequences there are."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        #: (lengths in one sequence, how many sequences)
        self.groups: list[tuple[tuple[int, ...], int]] = []
        self._fill_exactly()
        self._best_fit()

    def _take(self, lengths: tuple[int, ...]) -> None:
        """As many sequences of these lengths as the counts allow."""
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(self.left[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                self.left[x] -= n * k
            self.groups.append((lengths, n))

    def _pair(self, gap: int, below: int) -> list[int]:
        """Lengths a >= gap - a, a <= below, both available: the pair sums that equal the gap, largest a first."""
        a = np.arange(min(below, gap - 1), (gap + 1) // 2 - 1, -1)
        return a[(self.left[a] > 0) & (self.left[gap - a] > 0)].tolist() if len(a) else []

    def _fill_exactly(self) -> None:
        left = self.left
        if left[self.capacity]:
            self._take((self.capacity,))
        for length in range(self.capacity - 1, 0, -1):
            gap = self.capacity - length
            if not left[length]:
                continue
            self._take((length, gap))
            if left[length]:
                for a in self._pair(gap, length):
                    self._take((length, a, gap - a))
                    if not left[length]:
                        break
            if left[length]:
                for a in range(min(length, gap - 2), max(0, (gap - 1) // 3), -1):
                    if left[a]:
                        for b in self._pair(gap - a, a):
                            self._take((length, a, b, gap - a - b))
                            if not left[length] or not left[a]:
                                break
                    if not left[length]:
                        break

    def _best_fit(self) -> None:
        """Longest first, each into the fullest open sequences that have room; sequences alike stay together."""
        open_by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        rooms = np.zeros(self.capacity + 1, bool)

        def add(lengths: tuple[int, ...], room: int, n: int) -> None:
            open_by_room[room][lengths] = open_by_room[room].get(lengths, 0) + n
            rooms[room] = True

        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                fits = np.flatnonzero(rooms[length:])
                if not len(fits):
                    per = self.capacity // length  # several to a fresh sequence
                    whole, rest = divmod(n, per)
                    if whole:
                        add((length,) * per, self.capacity - per * length, whole)
                    if rest:
                        add((length,) * rest, self.capacity - rest * length, 1)
                    self.left[length] = 0
                    break
                room = length + int(fits[0])
                lengths, m = open_by_room[room].popitem()
                used = min(n, m)
                if m > used:
                    open_by_room[room][lengths] = m - used
                rooms[room] = bool(open_by_room[room])
                add((*lengths, length), room - length, used)
                self.left[length] -= used
        self.groups += [(lengths, n) for by in open_by_room.values() for lengths, n in by.items()]

    def lookup(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """length -> (first rank of each stretch, its first sequence id, offset): rank r of the length is in the last stretch that begins at or before r."""
        at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        rank: dict[int, int] = defaultdict(int)
        first = 0
        for lengths, n in self.groups:
            offset = 0
            for length in lengths:
                at[length].append((rank[length], first, offset))
                rank[length] += n
                offset += length
            first += n
        return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in at.items()}


def pack(pieced: DataFrame, capacity: int = 2048, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset. pieced: doc_id, piece, length and any more columns, one row a piece."""
    salted = pieced.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = settle(salted.groupBy("length", "__salt").agg(F.count("*").alias("n")), "piece-counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    lookup = Plan(by_length, capacity).lookup()
    before = counts.select("length", "__salt", (F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece"))).join(F.broadcast(before), ["length", "__salt"])  # at most capacity * salts rows
    ranked = ranked.withColumn("__rank", F.col("__rank") - 1 + F.col("__before")).drop("__salt", "__before")

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                own = np.flatnonzero(length == one)
                starts, firsts, offsets = lookup[int(one)]
                k = np.searchsorted(starts, rank[own], "right") - 1
                sequence[own] = firsts[k] + rank[own] - starts[k]
                offset[own] = offsets[k]
            keep = [n for n in batch.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "__rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.mapInArrow(tidy(place), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = settle(pieces(docs, ranks_path, pattern, capacity), "pieces")  # tokenised once
    return pack(made, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
