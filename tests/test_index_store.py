"""The stored index: what is written again, versions, failures."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomline.sources.index_store import StoredIndex

SCHEMA = "id long, text string, size int"


def files(at):
    return {str(p.relative_to(at)): p.stat().st_mtime_ns for p in Path(at).rglob("part-*.parquet")}


def words(rows):
    return rows.select("id", F.explode(F.split("text", " ")).alias("word"))


def content(index):
    return sorted(map(tuple, index.rows().collect()))


def want(rows):
    return sorted((k, w) for k, t, _ in rows for w in t.split(" "))


def test_second_run_writes_only_what_changed(spark, tmp_path):
    at = str(tmp_path / "index")
    index = StoredIndex(spark, at, "id", "text", words, buckets=16)
    assert index.rows() is None
    rows = [(k, f"a{k} b{k % 3}", 1) for k in range(200)]
    first = index.update(spark.createDataFrame(rows, SCHEMA))
    assert (first.version, first.created, first.written, first.left) == (1, 200, 16, 0) and content(index) == want(rows)
    before = files(at)
    same = index.update(spark.createDataFrame([(k, t, 99) for k, t, _ in rows], SCHEMA))  # another column is no change
    assert (same.version, same.written, same.left, same.unchanged) == (1, 0, 16, 200) and files(at) == before
    rows = [(7, "new text here", 1) if r[0] == 7 else r for r in rows]
    second = index.update(spark.createDataFrame(rows, SCHEMA))
    assert (second.version, second.modified, second.written, second.left) == (2, 1, 1, 15)
    after = files(at)
    assert {f: after[f] for f in before} == before and len(after) - len(before) == 2  # one bucket's rows and manifest
    assert content(index) == want(rows)
    rows = [r for r in rows if r[0] not in (3, 4)] + [(1000, "x", 1)]
    third = index.update(spark.createDataFrame(rows, SCHEMA))
    assert (third.created, third.deleted, third.modified) == (1, 2, 0) and third.written <= 3 and content(index) == want(rows)
    assert index.vacuum() > 0 and content(index) == want(rows)
    assert content(StoredIndex(spark, at, "id", "text", words, buckets=4)) == want(rows)  # the number of buckets is the folder's
    gone = index.update(spark.createDataFrame([], SCHEMA))
    assert gone.deleted == 199 and content(index) == []


def test_failed_updates_leave_the_old_version(spark, tmp_path):
    at = str(tmp_path / "index")
    rows = [(k, "t", 1) for k in range(30)]
    StoredIndex(spark, at, "id", "text", words, buckets=4).update(spark.createDataFrame(rows, SCHEMA))
    broken = StoredIndex(spark, at, "id", "text", lambda r: words(r).withColumn("word", F.raise_error(F.lit("broken")).cast("string")), buckets=4)
    with pytest.raises(Exception, match="broken"):
        broken.update(spark.createDataFrame([(k, "u", 1) for k in range(30)], SCHEMA))
    index = StoredIndex(spark, at, "id", "text", words, buckets=4)
    assert index.current()["version"] == 1 and content(index) == want(rows)
    assert index.update(spark.createDataFrame([(k, "u", 1) for k in range(30)], SCHEMA)).version == 2
    assert content(index) == sorted((k, "u") for k in range(30))
    for bad in ([(1, "a", 1), (1, "b", 1)], [(None, "a", 1)]):
        with pytest.raises(ValueError, match="null or repeats"):
            index.update(spark.createDataFrame(bad, SCHEMA))
