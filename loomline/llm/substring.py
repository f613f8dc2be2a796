"""Exact substring deduplication over words (operator 2).

Rabin-Karp hashes of every window of `width` words are counted in Spark; a window whose words also start earlier in the corpus (smaller
doc_id, or the same document further left) is repeated, and every word it covers goes. Overlapping repeated windows
merge into maximal removal intervals. Windows are judged on the input.

Windows whose anchor occurs once (see windows.py) cannot repeat and are not counted. Windows of equal stretches are counted once,
with the number of stretches as their weight.

Edge cases: null or short texts have no window and keep every word. Rows that repeat a doc_id and its text are one document: they
do not repeat one another. Of rows that share a doc_id but not a text, the text with the smallest hash is the document; the others
are left whole and match nothing, like rows with a null doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import U64, WordHashes, forget, id_and_text, mix, named, one_text_each, raw_texts, rolling, settle, slices, tidy
from .idfilter import KeyFilter
from .windows import BASE_1, BASE_2, by_document, cover, flat_items, later_runs, repeated_runs, run_table, spread


def word_tokens():
    return WordHashes().of_texts


def removal_intervals(docs: DataFrame, width: int = 20, gram: int = 6) -> DataFrame:
    """Settled: doc_id and items: array of (lo, hi), word places that repeated windows cover; docs: doc_id and text."""
    some, stretches = repeated_runs(run_table(docs, word_tokens, lambda v: v, width, gram, width, "word-runs"), "word-runs")
    places = settle(by_document(stretches.select(F.col("first.doc_id").alias("doc_id"), F.col("first.lo").alias("lo"), "n", "copies"), "lo", "n", "copies"), "word-places")

    def windows(batches):
        tokens_of = word_tokens()
        for batch in batches:
            for part in slices(batch):
                values, offsets = tokens_of(raw_texts(part))
                if len(values) < width:
                    continue
                one, two = mix(rolling(values, width, BASE_1)), mix(rolling(values, width, BASE_2))
                row, flat = flat_items(part.column("items"))
                lo, n, copies = (flat.field(c).to_numpy() for c in ("lo", "n", "copies"))
                at = spread(offsets[row] + lo, n)
                each = np.repeat(np.arange(len(n)), n)
                doc = part.column("doc_id").to_numpy()[row]
                columns = (doc[each], at - offsets[row][each], copies[each], one[at].view(np.int64), (two[at] >> U64(32)).astype(np.uint32).view(np.int32))  # 96 bits
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["doc_id", "at", "copies", "h1", "h2"])

    texts = KeyFilter(places, "doc_id").split(docs, "doc_id")[0].join(places.hint("shuffle_hash"), "doc_id")
    hashed = settle(texts.select("doc_id", "text", "items").mapInArrow(tidy(windows), "doc_id long, at long, copies long, h1 long, h2 int"), "word-windows")
    # a window at one place alone stays there: its copies go with the later runs of its stretch
    counted = hashed.groupBy("h1", "h2").agg(F.sum("copies").alias("n"), F.count("*").alias("places"), F.min(F.struct("doc_id", "at")).alias("first")).filter("n > 1 and places > 1")
    twice = settle(counted.select("h1", "h2", "first"), "word-twice")
    likely = KeyFilter(twice, "h1").split(hashed, "h1")[0]  # only windows at two places or more are shuffled again
    again = likely.join(twice, ["h1", "h2"]).filter(~((F.col("doc_id") == F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))))
    again = again.select("doc_id", F.col("at").alias("lo"), (F.col("at") + width).alias("hi"))
    # the windows of a later run have been counted with the first one's, so none of them is the earliest
    later = later_runs(some, stretches).select("doc_id", "lo", (F.col("lo") + F.col("n") * F.col("times") + (width - 1)).alias("hi"))
    found = settle(by_document(later.unionByName(again), "lo", "hi"), "word-removals")
    forget(some, stretches, places, hashed, twice)
    return found


def strip_text(docs: DataFrame, width: int = 20) -> DataFrame:
    """The documents, all columns and rows, with repeated passages gone from text (and n_chars brought up to date)."""
    done = remove_substrings(docs, width, carry=True)
    fresh = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*[fresh[c].alias(c) if c in fresh else named(c, "doc") for c in docs.columns])


def remove_substrings(docs: DataFrame, width: int = 20, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space), one row a row of docs; if wanted, doc: a struct of the row's columns but text."""
    own = [F.struct(*[named(c) for c in docs.columns if c != "text"]).alias("doc")] if carry else []
    more = ["doc"] if carry else []
    base = id_and_text(docs, *own)
    known, aside = one_text_each(base)
    gone_from = removal_intervals(known.select("doc_id", "text"), width)
    spared = KeyFilter(gone_from, "doc_id")
    some, hits = spared.split(known, "doc_id")[0], spared.hits  # only texts that may lose words are shuffled
    kind = "array<struct<lo:bigint,hi:bigint>>"
    marked = some.join(gone_from.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", F.col("items").cast(kind).alias("items"), F.lit(False).alias("all"), *more)
    for rest, every in ((known, True), *[(x, False) for x in aside]):  # strip() drops those of all known rows that are among the shuffled ones: no second Python task before it
        marked = marked.unionByName(rest.select("doc_id", "text", F.lit(None).cast(kind).alias("items"), F.lit(every).alias("all"), *more))

    def strip(batches):
        for batch in batches:
            twice = np.asarray(batch.column("all")) & hits(batch.column("doc_id"))
            for part in slices(batch.filter(pa.array(~twice)) if twice.any() else batch):
                row, flat = flat_items(part.column("items"))
                lo, hi, bounds = flat.field("lo").to_numpy(), flat.field("hi").to_numpy(), np.searchsorted(row, np.arange(part.num_rows + 1))
                rows = []
                for i, text in enumerate(raw_texts(part)):
                    words, own = text.split(), slice(bounds[i], bounds[i + 1])
                    gone = cover(len(words), lo[own], hi[own]) if bounds[i] < bounds[i + 1] else None
                    kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    rows.append((len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(part.column, more), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], ["doc_id", *more, "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = StructType([marked.schema["doc_id"], *[marked.schema[c] for c in more]])
    for name, kind_of in (("n_words", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType()), ("kept_text", StringType())):
        out = out.add(name, kind_of)
    return marked.mapInArrow(tidy(strip), out)
