"""Helpers shared by the corpus operators: table reading, settled tables, word hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space; bytes.split() splits on exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is set on a single machine; on a cluster that is an error, since executors don't see the driver's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: the lineage ends there, and any executor can read it."""
    at = f"{shared_dir(df.sparkSession)}/loomline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.settled_at = at
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again: what was made of them is settled itself."""
    for table in tables:
        spark, at = table.sparkSession, table.settled_at
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def named(name: str, inside: str = "") -> Column:
    """A column by its whole name, dots and backticks included; a field of the struct `inside`, if one is named."""
    quoted = f"`{name.replace('`', '``')}`"
    return F.col(f"{inside}.{quoted}" if inside else quoted).alias(name)


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of whole texts are bounded by bytes, not by rows alone: sets the session's limit, unless it is smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
        spark.conf.set(key, str(most))


def id_and_text(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text ('' for null), whatever other columns there are; doc_id as long."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def one_text_each(base: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(rows whose doc_id has one text, or the one with the smallest hash; the other rows, if there are any). base: doc_id, text and more."""
    h = F.xxhash64("text")
    several = base.filter("doc_id is not null").select("doc_id", h.alias("h")).groupBy("doc_id").agg(F.min("h").alias("__h"), F.max("h").alias("top")).filter("__h <> top").select("doc_id", "__h")
    several = settle(several, "shared-ids")
    if several.isEmpty():
        return base, []
    marked = base.join(several, "doc_id", "left").withColumn("__aside", F.coalesce(h != F.col("__h"), F.lit(False)))
    split = lambda c: marked.filter(c).select(*base.columns)
    return split(~F.col("__aside")), [split("__aside")]


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow task that gives free memory back to the system once it is through. Spark keeps Python workers for later tasks, so what each of them once needed
    would stand beside the executor's heap in all later stages, those without Python too."""

    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


#: Tasks work on stretches of so many bytes of text at a time, so their memory does not depend on Arrow's batches.
BLOCK = 1 << 18


def slices(batch: pa.RecordBatch, block: int = BLOCK, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A record batch in parts of about `block` bytes of text, one row at least. Nothing is copied."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + block, "right")))
        yield batch.slice(at, end - at)
        at = end


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def sha_hex(col: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(col.cast("binary"), 256)


class WordHashes(dict):
    """word (bytes or str) -> 64-bit hash, remembered; forgets everything beyond a bound, so memory stays bounded."""

    def __init__(self, bound: int = 100_000, seed: int = 0):
        super().__init__()
        self.bound, self.seed = bound, seed

    def __missing__(self, word):
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, one after another, and where each text's begin (one more than there are texts)."""
        split = [t.split() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), U64, offsets[-1]), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash (mod 2^64) of every window of `width` values, by doubling: no loop over positions."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    # power[k] hashes blocks of 2^k values; blocks join as hash(left) * base^len(right) + hash(right)
    block, size, factor = values, 1, base
    out, done = None, 0
    rest = width
    while rest:
        if rest & 1:
            part = block[done : done + n] if out is not None else block[:n]
            out = part if out is None else out * U64(factor & 0xFFFFFFFFFFFFFFFF) + part
            done += size
        rest >>= 1
        if rest:
            block = block[:-size] * U64(factor & 0xFFFFFFFFFFFFFFFF) + block[size:]
            factor = factor * factor & 0xFFFFFFFFFFFFFFFF
            size *= 2
    return out
