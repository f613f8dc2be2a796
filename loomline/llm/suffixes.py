"""Suffix-array deduplication over bytes by depth-limited radix sort (operator 10).

Suffixes are ordered only through their first `width` bytes by most-significant-digit passes; suffixes that stay equal to
that depth are exactly the repeated windows, and every byte they cover goes. On the way the passes stop at a shallower depth,
`notice`, whose equal groups are reported as n_repeated and remove nothing.

The first pass runs over the whole corpus: its digit is a suffix's anchor gram and the anchor's place (see windows.py), so equal suffixes share it,
and a suffix whose digit occurs once leaves. The others are dealt out by that digit and sorted by 8-byte digits, single suffixes dropping out after each
pass. Equal stretches are one row with a weight. A digit with more than `hot_group` different stretches is too much for
one task: its suffixes are dealt out by all their digits and counted by Spark.

Edge cases: null or short texts have no window. Rows that repeat a doc_id and its text are documents of their own, so each repeats the other.
Of rows that share a doc_id but not a text, the text with the smallest hash is the document; the others are left whole and
match nothing, like rows with a null doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, forget, id_and_text, mix, one_text_each, raw_texts, rolling, settle, slices
from .idfilter import KeyFilter
from .windows import BASE_1, BASE_2, by_document, cover, flat_items, later_runs, repeated_runs, run_table, spread

DIGIT = 8
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(BASE_1))


def byte_tokens():
    def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    return tokens


def lift(tokens: np.ndarray) -> np.ndarray:
    return _BYTE[tokens]


def digits_of(data: np.ndarray) -> np.ndarray:
    """The digit at every place: the next 8 bytes as one number, so digits order as their bytes do."""
    out = np.zeros(max(0, len(data) - DIGIT + 1), U64)
    for k in range(DIGIT):
        out = out << U64(8) | data[k : k + len(out)].astype(U64)
    return out


def radix_equal(group: np.ndarray, weight: np.ndarray, digits: np.ndarray, starts: np.ndarray, ends: np.ndarray, depths: tuple[int, ...]) -> list[np.ndarray]:
    """For each depth, which suffixes equal another one of their group (or stand for several) through so many bytes.

    group is sorted; a suffix takes part as far as `ends` lets it. Each pass sorts the groups that a digit breaks and drops suffixes that have become single.
    """
    out = [np.zeros(len(starts), bool) for _ in depths]
    live, key, at = np.arange(len(starts)), group, 0
    for mark, depth in zip(out, depths, strict=True):
        far = starts[live] + depth <= ends[live]
        live, key = live[far], key[far]
        # the last digit may overlap the one before
        for k in [*range(at, depth - DIGIT, DIGIT), depth - DIGIT]:
            digit = digits[starts[live] + k]
            new = np.ones(len(live), bool)
            new[1:] = key[1:] != key[:-1]
            split = np.flatnonzero(~new[1:] & (digit[1:] != digit[:-1])) + 1
            if len(split):
                number = np.cumsum(new) - 1
                broken = np.zeros(number[-1] + 1, bool)
                broken[number[split]] = True
                rows = np.flatnonzero(broken[number])
                order = rows[np.lexsort((digit[rows], number[rows]))]
                live[rows], digit[rows] = live[order], digit[order]
                new[1:] |= digit[1:] != digit[:-1]
            key = np.cumsum(new)
            stay = (np.bincount(key, weight[live]) > 1)[key]
            live, key = live[stay], key[stay]
            if not len(live):
                break
        mark[live] = True
        at = depth
    return out


def _as_runs(doc: np.ndarray, at: np.ndarray, width: int, deep: bool) -> pa.RecordBatch:
    """(doc_id, lo, hi, deep) of windows sorted by document and place: consecutive starts merge."""
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(first[1:], len(at)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(at[first]), pa.array(at[last] + width), pa.array(np.full(len(first), deep))], ["doc_id", "lo", "hi", "deep"])


def _sorted_groups(notice: int, width: int, rows: int = 500):
    """Radix passes over whole first-digit groups, some rows at a time; the input is sorted by anchor."""

    def solve(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        data, ends = byte_tokens()(table.column("context").to_pylist())
        doc, lo, n, anchor, place, copies = (table.column(c).to_numpy() for c in ("doc_id", "lo", "n", "anchor", "place", "copies"))
        row, step = np.repeat(np.arange(len(n)), n), spread(np.zeros(len(n), np.int64), n)
        first = mix(anchor.view(U64)[row] + (place[row] - step).astype(U64) * U64(BASE_2))  # the anchor and where it is in the suffix
        order = np.argsort(first, kind="stable")
        row, step = row[order], step[order]
        for deep, same in enumerate(radix_equal(first[order], copies[row], digits_of(data), ends[row] + step, ends[row + 1], (notice, width))):
            if not same.any():
                continue
            doc_of, at = doc[row[same]], (lo[row] + step)[same]
            sort = np.lexsort((at, doc_of))
            yield _as_runs(doc_of[sort], at[sort], width if deep else notice, bool(deep))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in slices(batch, 1 << 20, "context"):
                anchor = part.column("anchor").to_numpy()
                begin = 0
                if held and held[-1].column("anchor")[-1].as_py() != anchor[0] and sum(b.num_rows for b in held) >= rows:
                    yield from solve(held)
                    held = []
                for cut in (np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist():
                    if sum(b.num_rows for b in held) + cut - begin >= rows:
                        held.append(part.slice(begin, cut - begin))
                        yield from solve(held)
                        held, begin = [], cut
                held.append(part.slice(begin))
        if held:
            yield from solve(held)

    return run


def removal_intervals(docs: DataFrame, width: int = 400, notice: int = 256, gram: int = 96, hot_group: int = 4_000) -> DataFrame:
    """Settled: doc_id and items: array of (lo, hi, deep), bytes that repeated windows cover (of `width` bytes where deep, else of `notice`); docs: doc_id and text."""
    some, stretches = repeated_runs(run_table(docs, byte_tokens, lift, notice, gram, width, "byte-runs"), "byte-runs")
    hot = stretches.groupBy("anchor").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > hot_group).select("anchor", F.lit(True).alias("hot"))
    firsts = stretches.join(hot, "anchor", "left").select(F.col("first.doc_id").alias("doc_id"), F.col("first.lo").alias("lo"), "n", "copies", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))
    places = settle(by_document(firsts, "lo", "n", "copies", "anchor", "hot"), "byte-places")
    texts = KeyFilter(places, "doc_id").split(docs, "doc_id")[0].join(places.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "items")

    def contexts(batches):
        for batch in batches:
            for part in slices(batch):
                raw = raw_texts(part)
                row, flat = flat_items(part.column("items"))
                lo, n = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
                cut = [raw[r][a : a + k + width - 1] for r, a, k in zip(row.tolist(), lo.tolist(), n.tolist(), strict=True)]
                # the windows of a run share its anchor: its leftmost place lies in all of them
                anchor, place, begin = flat.field("anchor").to_numpy(), np.empty(len(n), np.int64), 0
                data, offsets = byte_tokens()(cut)
                grams = mix(rolling(lift(data), gram, BASE_1)) if len(data) >= gram else np.empty(0, U64)
                for i, begin in enumerate(offsets[:-1].tolist()):
                    place[i] = int(np.flatnonzero(grams[begin : begin + notice - gram + n[i]] == anchor[i : i + 1].view(U64)[0])[0])
                columns = [pa.array(part.column("doc_id").to_numpy()[row]), pa.array(lo), pa.array(n), flat.field("copies"), pa.array(anchor), flat.field("hot"), pa.array(place), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lo", "n", "copies", "anchor", "hot", "place", "context"])

    def all_digits(batches):
        for batch in batches:
            for part in slices(batch, column="context"):
                for doc, lo, n, copies, context in zip(*(part.column(c).to_pylist() for c in ("doc_id", "lo", "n", "copies", "context")), strict=True):
                    values = lift(np.frombuffer(context, np.uint8))
                    for depth in (notice, width):
                        one, two = (mix(rolling(values, depth, b))[:n].view(np.int64) for b in (BASE_1, BASE_2))
                        k = len(one)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, doc)), pa.array(lo + np.arange(k)), pa.array(np.full(k, copies)), pa.array(np.full(k, depth, np.int32)), pa.array(one), pa.array(two)], ["doc_id", "at", "copies", "depth", "h1", "h2"])

    cut = settle(texts.mapInArrow(contexts, "doc_id long, lo long, n int, copies long, anchor long, hot boolean, place long, context binary"), "byte-contexts")
    dealt = cut.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "lo")
    few = dealt.mapInArrow(_sorted_groups(notice, width), "doc_id long, lo long, hi long, deep boolean")
    many = cut.filter("hot").mapInArrow(all_digits, "doc_id long, at long, copies long, depth int, h1 long, h2 long")
    equal = many.groupBy("depth", "h1", "h2").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    many = many.join(equal, ["depth", "h1", "h2"], "left_semi").select("doc_id", F.col("at").alias("lo"), (F.col("at") + F.col("depth")).alias("hi"), (F.col("depth") == width).alias("deep"))
    # the suffixes of a later run have been sorted with the first one's, as its weight
    end = lambda n, depth, deep: F.struct((F.col("lo") + F.col("n") * (F.col("times") - 1) + F.col(n) + (depth - 1)).alias("hi"), F.lit(deep).alias("deep"))
    later = later_runs(some, stretches).select("doc_id", "lo", F.explode(F.array(end("n", notice, False), F.when(F.col("deep") > 0, end("deep", width, True)))).alias("x"))
    later = later.filter("x is not null").select("doc_id", "lo", "x.hi", "x.deep")
    found = settle(by_document(later.unionByName(few).unionByName(many), "lo", "hi", "deep"), "byte-removals")
    forget(some, stretches, places, cut)
    return found


def remove_repeats(docs: DataFrame, width: int = 400, notice: int = 256, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated and kept (the remaining bytes, null unless keep_bytes), one row a row of docs.

    n_repeated counts the bytes that repeated strings of `notice` bytes or more cover: passages too short to be removed show there.
    """
    base = id_and_text(docs)
    known, aside = one_text_each(base)
    gone_from = removal_intervals(known, width, notice)
    some, whole = KeyFilter(gone_from, "doc_id").split(known, "doc_id")  # only texts that may lose bytes are shuffled
    kind = "array<struct<lo:bigint,hi:bigint,deep:boolean>>"
    marked = some.join(gone_from.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", F.col("items").cast(kind).alias("items"))
    for rest in (whole, *aside):
        marked = marked.unionByName(rest.withColumn("items", F.lit(None).cast(kind)))

    def strip(batches):
        for batch in batches:
            for part in slices(batch):
                row, flat = flat_items(part.column("items"))
                lo, hi, deep = flat.field("lo").to_numpy(), flat.field("hi").to_numpy(), flat.field("deep").to_numpy(zero_copy_only=False).astype(bool)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                rows = []
                for i, raw in enumerate(raw_texts(part)):
                    kept, gone, n_repeated = raw, np.zeros(0, bool), 0
                    if bounds[i] < bounds[i + 1]:
                        own = slice(bounds[i], bounds[i + 1])
                        gone = cover(len(raw), lo[own][deep[own]], hi[own][deep[own]])
                        kept, n_repeated = np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(cover(len(raw), lo[own], hi[own]).sum())
                    n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    rows.append((len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), n_repeated, kept if keep_bytes else None))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept"])

    return marked.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary")
