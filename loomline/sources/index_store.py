"""A stored index that is brought up to date by content hash: only partitions with changed keys are written again.

A folder holds, by bucket of the key, the manifest (key, hash) and the index rows; a bucket's files lie under the version that wrote them. The file CURRENT names each bucket's version.
An update writes the changed buckets as files of a new version and then puts a new CURRENT in the place of the old one by one rename: readers see the old version or the new one, and an update that
fails, or whose executors are lost, leaves the old one. Files are deleted by vacuum() alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Update:
    """What an update did: the version that is current now, keys by what happened to them, and buckets written and left."""

    version: int
    created: int
    modified: int
    deleted: int
    unchanged: int
    written: int
    left: int


class StoredIndex:
    """An index over rows with a key and a content. build gets the rows (key, content and the other columns) to be indexed and gives rows with the key."""

    def __init__(self, spark: SparkSession, folder: str, key: str, content: str, build: Callable[[DataFrame], DataFrame], buckets: int = 256):
        self.spark, self.folder, self.key, self.content, self.build, self.buckets = spark, folder.rstrip("/"), key, content, build, buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def current(self) -> dict:
        """version, versions (of each bucket), the schemas, and the number of buckets, as CURRENT has them."""
        at = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(at):
            return {"version": 0, "versions": {}, "schema": None, "manifest": None, "buckets": self.buckets}
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.folder}/CURRENT").collect()))

    def _read(self, state: dict, what: str) -> DataFrame | None:
        if not state["versions"]:
            return None
        schema = StructType.fromJson(json.loads(state["schema" if what == "rows" else "manifest"]))
        paths = [f"{self.folder}/{what}/version={v}/bucket={b}" for b, v in state["versions"].items()]
        return self.spark.read.schema(schema).parquet(*[p for p in paths if self._fs.exists(self._path(p))] or [self._empty(what)])

    def _empty(self, what: str) -> str:
        at = f"{self.folder}/{what}/empty"
        self._fs.mkdirs(self._path(at))
        return at

    def rows(self) -> DataFrame | None:
        """The index rows of the current version; None before the first update."""
        return self._read(self.current(), "rows")

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.state_buckets)).cast("int")

    def update(self, rows: DataFrame) -> Update:
        """Bring the index up to the rows, one a key: keys that are new or have another content are indexed, those that are gone leave. A key of null, or twice in rows, is an error."""
        state = self.current()
        self.state_buckets = state["buckets"]
        hashed = rows.withColumn("__hash", F.sha2(F.coalesce(F.col(self.content).cast("string"), F.lit("")), 256))
        bad = hashed.groupBy(self.key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(self.key).isNull()).limit(1).collect()
        if bad:
            raise ValueError(f"a key is null or repeats: {bad[0][self.key]!r}")
        now = hashed.select(self.key, F.col("__hash").alias("hash"))
        manifest = self._read(state, "manifest")
        before = now.limit(0) if manifest is None else manifest
        both = now.withColumnRenamed("hash", "h").join(before.withColumnRenamed("hash", "g"), self.key, "full_outer")
        change = F.when(F.col("g").isNull(), "created").when(F.col("h").isNull(), "deleted").when(F.col("h") != F.col("g"), "modified").otherwise("unchanged")
        both = both.select(self.key, "h", change.alias("change"), self._bucket().alias("bucket"))
        counted = both.groupBy("bucket", "change").agg(F.count("*").alias("n")).collect()  # four rows a bucket at most
        of = {c: sum(r["n"] for r in counted if r["change"] == c) for c in ("created", "modified", "deleted", "unchanged")}
        touched = sorted({r["bucket"] for r in counted if r["change"] != "unchanged"})
        left = len({r["bucket"] for r in counted}) - len(touched)
        if not touched:
            return Update(state["version"], *of.values(), 0, left)
        version = state["version"] + 1
        mine = F.col("bucket").isin(touched)
        fresh = both.filter(mine & F.col("change").isin("created", "modified")).select(self.key)
        made = self.build(hashed.drop("__hash").join(fresh, self.key, "left_semi"))
        old = self._read(state | {"versions": {b: v for b, v in state["versions"].items() if int(b) in touched}}, "rows")
        if old is not None:  # what stays in the touched buckets moves along
            kept = both.filter(mine & (F.col("change") == "unchanged")).select(self.key)
            made = made.unionByName(old.join(kept, self.key, "left_semi"))
        manifest = both.filter(mine & (F.col("change") != "deleted")).select(self.key, F.col("h").alias("hash"), "bucket")
        for what, table in (("rows", made.withColumn("bucket", self._bucket())), ("manifest", manifest)):
            at = f"{self.folder}/{what}/version={version}"
            table.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        versions = state["versions"] | {str(b): version for b in touched}
        self._switch({"version": version, "versions": versions, "schema": made.schema.json(), "manifest": manifest.drop("bucket").schema.json(), "buckets": self.state_buckets})
        return Update(version, *of.values(), len(touched), left)

    def _switch(self, state: dict) -> None:
        """Put a new CURRENT in the place of the old one, by one rename that replaces it."""
        temporary = self._path(f"{self.folder}/.current-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, self._path(f"{self.folder}/CURRENT"), options)

    def vacuum(self) -> int:
        """Delete the files of buckets that CURRENT no longer names; no reader or update may be at work. How many bucket folders went."""
        state, gone = self.current(), 0
        named = {(v, int(b)) for b, v in state["versions"].items()}
        for what in ("rows", "manifest"):
            top = self._path(f"{self.folder}/{what}")
            for folder in self._fs.listStatus(top) if self._fs.exists(top) else []:
                name = folder.getPath().getName()
                if not name.startswith("version="):
                    continue
                version, buckets = int(name.removeprefix("version=")), [f.getPath() for f in self._fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("bucket=")]
                for p in buckets:
                    if (version, int(p.getName().removeprefix("bucket="))) not in named:
                        gone += bool(self._fs.delete(p, True))
        return gone
