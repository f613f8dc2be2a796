"""Data sources for whole-file formats: round trips, partitions, streams, commits."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.sources import filesource as fs


@pytest.fixture(scope="module")
def session(spark):
    fs.register(spark)
    return spark


def spans(session, n=40):
    return session.range(n).select(
        F.concat(F.lit("t"), F.col("id") % 4).alias("trace_id"),
        F.col("id").cast("string").alias("span_id"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("0")).cast("string").alias("parent_span_id"),
        F.lit("chat é").alias("name"),
        F.lit(3).alias("kind"),
        (F.col("id") * 1.5).alias("start_ms"),
        (F.col("id") * 1.5 + 0.25).alias("end_ms"),
        F.create_map(F.lit("n"), F.col("id").cast("string"), F.lit("ok"), F.lit("true"), F.lit("x"), F.lit("2.5"), F.lit("tools"), F.lit('["a", "7", "true"]'), F.lit("s"), F.lit("plain [")).alias("attributes"),
        F.array(F.struct(F.lit("first").alias("name"), (F.col("id") * 1.0).alias("at_ms"), F.create_map(F.lit("k"), F.lit("v")).alias("attributes"))).alias("events"),
        F.lit(2).alias("status_code"),
        F.lit("bad").alias("status_message"),
        F.lit("lib").alias("scope"),
        F.create_map(F.lit("service.name"), F.concat(F.lit("svc"), F.col("id") % 2)).alias("resource"),
    )


def plain(df):
    return sorted(repr(r.asDict(recursive=True)) for r in df.collect())


def test_traces_round_trip_with_arrays(session, tmp_path):
    df, at = spans(session), str(tmp_path / "traces")
    df.repartition(3).write.format("otlp_traces").mode("append").option("rowsPerFile", 5).save(at)
    names = [p.name for p in (tmp_path / "traces").iterdir()]
    assert len(names) >= 8 and all(n.startswith("part-") and n.endswith(".json") for n in names)
    back = session.read.format("otlp_traces").load(at)
    assert back.columns == df.columns and plain(back.select(*df.columns)) == plain(df)
    value = {a["key"]: a["value"] for a in json.loads(next((tmp_path / "traces").iterdir()).read_text())["resourceSpans"][0]["scopeSpans"][0]["spans"][0]["attributes"]}
    assert value["tools"] == {"arrayValue": {"values": [{"stringValue": "a"}, {"intValue": "7"}, {"boolValue": True}]}}
    assert value["ok"] == {"boolValue": True} and value["x"] == {"doubleValue": 2.5} and value["s"] == {"stringValue": "plain ["} and "intValue" in value["n"]
    assert session.read.format("otlp_traces").option("partitionBytes", 1).load(at).rdd.getNumPartitions() == len(names)
    assert session.read.format("otlp_traces").load(at).rdd.getNumPartitions() == 1


def test_overwrite_append_and_failed_writes(session, tmp_path):
    at = str(tmp_path / "w")
    write = lambda df, mode: df.write.format("otlp_traces").mode(mode).save(at)
    write(spans(session, 4), "append")
    write(spans(session, 3), "append")
    assert session.read.format("otlp_traces").load(at).count() == 7
    write(spans(session, 2), "overwrite")
    assert session.read.format("otlp_traces").load(at).count() == 2
    broken = spans(session, 20).repartition(4).withColumn("name", F.when(F.col("span_id") == "11", F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        write(broken, "append")
    assert session.read.format("otlp_traces").load(at).count() == 2 and all(p.name.startswith("part-") for p in (tmp_path / "w").iterdir())


def test_malformed_and_empty_files(session, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text('{"resourceSpans": [{"scopeSpans": [{"spans": [{"name": "x"}]}]}]}')
    (tmp_path / "_hidden.json").write_text("{bad")
    rows = session.read.format("otlp_traces").load(str(tmp_path)).collect()
    assert [(r["name"], r["kind"], r["start_ms"], r["attributes"], r["events"], r["parent_span_id"]) for r in rows] == [("x", 0, None, {}, [], None)]
    (tmp_path / "c.json").write_text("{bad")
    with pytest.raises(Exception, match="cannot read .*c.json"):
        session.read.format("otlp_traces").load(str(tmp_path)).collect()


def test_stream_reads_each_file_once(session, tmp_path):
    at = str(tmp_path / "in")

    def run():
        q = session.readStream.format("otlp_traces").load(at).select("span_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return session.read.parquet(str(tmp_path / "out")).count()

    spans(session, 6).write.format("otlp_traces").mode("append").save(at)
    assert run() == 6
    assert run() == 6
    spans(session, 5).write.format("otlp_traces").mode("append").save(at)
    assert run() == 11


def test_findings_and_reports(session, tmp_path):
    found = session.createDataFrame([("lint", f"R{k % 3}", "error", f"m{k}", f"src/{k}.py", k if k % 2 else None, f"f{k}" if k % 3 else None) for k in range(12)], fs.Findings.columns)
    found.write.format("sarif_results").mode("append").save(str(tmp_path / "s"))
    assert plain(session.read.format("sarif_results").load(str(tmp_path / "s"))) == plain(found)
    cases = session.createDataFrame([("one", "a.py", "t1", 0.5, "passed", None), ("one", "a.py", "t2", 0.0, "failed", "no <&> way"), ("two", "b.py", "t3", 1.25, "error", "x"), (None, "c.py", "t4", 0.0, "skipped", None)], fs.TestReports.columns)
    cases.write.format("junit_cases").mode("append").save(str(tmp_path / "j"))
    assert plain(session.read.format("junit_cases").load(str(tmp_path / "j"))) == plain(cases)
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "r.xml").write_text('<testsuites><testsuite name="out"><testsuite name="in"><testcase classname="c" name="n" time="2"><failure>why</failure></testcase></testsuite></testsuite></testsuites>')
    assert [tuple(r) for r in session.read.format("junit_cases").load(str(tmp_path / "n")).collect()] == [("in", "c", "n", 2.0, "failed", "why")]
