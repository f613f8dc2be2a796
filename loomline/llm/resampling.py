"""Target-distribution importance resampling (operator 12).

A document's features are its word n-grams, hashed to buckets by CRC-32. A bucket's gain is the log ratio of its smoothed shares in the target
texts and in the corpus; a document's weight is the mean gain of its features; Gumbel noise drawn from its id turns a top-k choice
into sampling without replacement.

Texts are scanned as UTF-8 bytes: separators collapse to single spaces, and one overlapped scan with boundary lookarounds meets every
word start and reads off the spans of all n-grams that begin there. Matches stream through the CRC into two bytes a feature, so a long text needs little more than
itself. Each text is scanned once: the buckets are a written table, which the counts and the weights read.

Edge cases: null text has no words. A document without features has weight 0. Rows that repeat a doc_id are drawn for themselves, with the same noise; equal
scores go by doc_id, then by n_features; a null doc_id has the noise of an empty one and comes last among equals. Without target texts, or without documents, gains follow from the smoothing alone.
Percentages and minimum length count rows. Other columns are ignored, or carried by draw_documents().
"""

from __future__ import annotations

import math
import zlib
from itertools import chain
from operator import methodcaller

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, forget, named, raw_texts, settle, slices

#: ASCII characters that separate words, once A-Z are lower-cased; a byte from 0x80 on belongs to a word.
SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MAX_BUCKETS = 1 << 16


def collapsed(text: bytes) -> bytes:
    """Lower-case words with one space between them."""
    return SEPARATORS.sub(b" ", text.lower()).strip(b" ")


def scanner(orders: int) -> tuple[regex.Pattern, methodcaller]:
    """A pattern that matches at every word, with the n-gram of each order that begins there as its groups (unset where the text ends before), and what reads the groups off a match."""
    grams = [b" ".join([b"[^ ]++"] * n) for n in range(1, orders + 1)]
    ahead = b"".join(rb"(?=(%s)(?![^ ])|)" % g for g in grams)
    return regex.compile(rb"(?<![^ ])%s[^ ]++(?![^ ])" % ahead), methodcaller("group", *range(1, orders + 1)) if orders > 1 else lambda m: (m[1],)


def feature_buckets(words: bytes, scan: tuple[regex.Pattern, methodcaller], buckets: int) -> np.ndarray:
    """The bucket of every n-gram of collapsed words, repeats included."""
    pattern, groups = scan
    spans = filter(None, chain.from_iterable(map(groups, pattern.finditer(words, overlapped=True))))
    return (np.fromiter(map(zlib.crc32, spans), np.uint32) % buckets).astype(np.uint16)


def bucket_table(docs: DataFrame, orders: int, buckets: int, carry: bool = False) -> DataFrame:
    """Settled: doc_id, n_words, n_features, buckets (little-endian 16-bit numbers), and doc: a struct of all columns, if wanted."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
    bound_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    own = [F.struct(*[named(c) for c in docs.columns]).alias("doc")] if carry else []
    base = docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("__text"), *own)
    names = ["doc_id", *(["doc"] if carry else [])]

    def run(batches):
        scan = scanner(orders)
        for part in (part for batch in batches for part in slices(batch, column="__text")):
            words = [collapsed(t) for t in raw_texts(part, "__text")]
            found = [feature_buckets(w, scan, buckets) for w in words]
            made = {
                "n_words": pa.array([w.count(b" ") + 1 if w else 0 for w in words], pa.int64()),
                "n_features": pa.array([len(f) for f in found], pa.int64()),
                "buckets": pa.array([f.astype("<u2").tobytes() for f in found], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *made.values()], [*names, *made])

    schema = base.select(*names).schema.add("n_words", "long").add("n_features", "long").add("buckets", "binary")
    return settle(base.mapInArrow(run, schema), "resampling-buckets")


def bucket_counts(table: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds: tasks count their own rows, Spark adds them up, the driver gets at most `buckets` rows."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("buckets").to_pylist()), "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in table.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed shares), by bucket."""
    s_all, t_all, smooth = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: (float(t + 1) * float(s_all + smooth)) / (float(s + 1) * float(t_all + smooth))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the document's id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighed(table: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """The bucket table with weight and score instead of buckets."""
    shared = table.sparkSession.sparkContext.broadcast(gains)  # 8 bytes a bucket

    def run(batches):
        for batch in batches:
            own = [shared.value[np.frombuffer(x.as_buffer(), "<u2")] for x in batch.column("buckets")]
            weight = pa.array([int(g.sum()) // len(g) if len(g) else 0 for g in own], pa.int64())
            at = batch.schema.get_field_index("buckets")
            yield batch.set_column(at, "weight", weight)

    schema = table.drop("buckets").schema.add("weight", "long")
    return table.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """scored with rank: 1, 2, 3... for the drawn rows in falling order of score, null for the others.

    The driver sees how many rows have each score. Scores are whole thousandths of logarithms, so they take some ten thousand values however many rows there are; what
    they say is where the draw ends and how many rows are above each score. Rows of one score are numbered among themselves.
    """
    able = scored.filter(F.col("n_words") >= min_words)
    levels = sorted(((r["score"], r["n"]) for r in able.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    most = percent * sum(n for _, n in levels) // 100
    above, first = [], 0
    for score, n in levels:
        if first >= most:
            break
        above.append((score, first))
        first += n
    if not above:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    offsets = scored.sparkSession.createDataFrame(pd.DataFrame(above, columns=["__score", "__above"]))
    may = F.coalesce((F.col("n_words") >= min_words) & (F.col("score") >= above[-1][0]), F.lit(False))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features"))
    hit = scored.filter(may).withColumn("__place", place).join(F.broadcast(offsets), F.col("score") == F.col("__score"))  # a row a score
    rank = F.col("__above") + F.col("__place")
    hit = hit.select(*[F.col(f"`{c}`") for c in scored.columns], F.when(rank <= most, rank).cast("long").alias("rank"))
    return hit.unionByName(scored.filter(~may).withColumn("rank", F.lit(None).cast("long")))


def scored(docs: DataFrame, target: DataFrame, orders: int = 2, buckets: int = 10_000, seed: int = 7, carry: bool = False) -> DataFrame:
    """Settled: doc_id, n_words, n_features, weight, score (and doc) of every row of docs."""
    aims = bucket_table(target, orders, buckets)
    table = bucket_table(docs, orders, buckets, carry)
    gains = bucket_gains(bucket_counts(table, buckets), bucket_counts(aims, buckets))
    out = settle(weighed(table, gains, seed), "resampling-scores")
    forget(aims, table)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, **options) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; percent of those with min_words words are drawn, the others have no rank.

    target has the texts whose distribution is aimed at, in text.
    """
    return ranked(scored(docs, target, **options), percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")


def draw_documents(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, **options) -> DataFrame:
    """The drawn documents with all their columns, in no order."""
    out = ranked(scored(docs, target, carry=True, **options), percent, min_words).filter("rank is not null")
    return out.select(*[named(c, "doc") for c in docs.columns])
