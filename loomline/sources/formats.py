"""Sources and sinks in the formats that tools leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import number_rows
from ..operators.transcripts import parse_steps


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Transcript steps of JSON-lines files; see parse_steps."""
    return parse_steps(spark.read.text(path), "value")


# Event types by native name.
EVENT_TYPES = {"process_exec": "EXEC", "exec": "EXEC", "execve": "EXEC", "process_kprobe": "KPROBE", "connect": "CONNECT", "open": "FILE_OPEN", "openat": "FILE_OPEN", "ptrace": "PTRACE", "setuid": "SETUID"}


def read_audit_events(lines: DataFrame, column: str, *keep: str) -> DataFrame:
    """Flat, nested-process and rule-engine JSON events in one schema: event_type, pid, binary, args, path, ip, seconds. Blank and # lines are skipped; a malformed line fails the query."""
    rows = lines.filter(~F.col(column).rlike(r"^\s*(#|$)"))
    get = lambda *paths: F.coalesce(*[F.get_json_object(column, f"$.{p}") for p in paths])
    kind = F.lower(F.coalesce(get("event_type", "type", "syscall"), get("output_fields.evt\\.type"), F.when(get("process_exec").isNotNull(), "process_exec"), F.when(get("process_kprobe").isNotNull(), "process_kprobe")))
    mapped = F.lit("UNKNOWN")
    for k, v in EVENT_TYPES.items():
        mapped = F.when(kind == k, v).otherwise(mapped)
    ok = F.when(F.try_parse_json(column).isNotNull(), mapped).otherwise(F.raise_error(F.concat(F.lit("malformed event: "), F.left(column, F.lit(80)))))
    when = F.to_timestamp(get("time", "timestamp", "process_exec.time"))
    return rows.select(
        *keep,
        ok.alias("event_type"),
        get("pid", "process_exec.process.pid", "process_kprobe.process.pid").try_cast("bigint").alias("pid"),
        get("binary", "comm", "process_exec.process.binary", "process_kprobe.process.binary").alias("binary"),
        get("args", "process_exec.process.arguments").alias("args"),
        get("path", "filename").alias("path"),
        get("ip", "dst_ip").alias("ip"),
        F.coalesce(when.cast("double"), F.lit(0.0)).alias("seconds"),
    )


SARIF = "struct<runs:array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,partialFingerprints:map<string,string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>>>>"


def write_sarif(findings: DataFrame, most: int = 2000) -> DataFrame:
    """Findings logs: tool, part (from 0), log (JSON). A log has up to `most` results of one tool in order of fingerprint; the next ones go into the tool's next part, so a log's size is bounded however many
    findings a tool has. findings: tool, rule_id, level, message, file_path, fingerprint. Only rules that fired are declared."""
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.create_map(F.lit("primary/v1"), "fingerprint").alias("partialFingerprints"),
        F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
    )
    rows = number_rows(findings.select("tool", "rule_id", "level", "message", "file_path", "fingerprint"), ["tool", "fingerprint", "file_path", "rule_id", "level", "message"], "n", 0)
    first = rows.groupBy(F.col("tool").alias("of")).agg(F.min("n").alias("begins"))
    placed = rows.join(first, F.col("tool").eqNullSafe(F.col("of"))).withColumn("part", F.expr(f"(n - begins) div {most}"))
    g = placed.withColumn("r", result).groupBy("tool", "part").agg(F.array_sort(F.collect_list(F.struct("n", "r")), lambda a, b: F.when(a["n"] < b["n"], -1).otherwise(1)).alias("rs"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    run = F.struct(F.struct(F.struct(F.col("tool").alias("name"), F.transform("rules", lambda x: F.struct(x.alias("id"))).alias("rules")).alias("driver")).alias("tool"), F.col("rs.r").alias("results"))
    return g.select("tool", "part", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("log"))


def parse_sarif(logs: DataFrame, column: str) -> DataFrame:
    """tool, rule_id, level, message (80 characters), file_path, fingerprint of results that have a fingerprint."""
    runs = logs.select(F.explode(F.from_json(column, SARIF)["runs"]).alias("run"))
    r = runs.select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    return r.select("tool", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), F.left("r.message.text", F.lit(80)).alias("message"), F.get("r.locations", F.lit(0))["physicalLocation"]["artifactLocation"]["uri"].alias("file_path"), F.get(F.map_values("r.partialFingerprints"), F.lit(0)).alias("fingerprint")).filter("fingerprint is not null")


def any_value(v: Column) -> Column:
    """A typed OTLP value of text: bool before int before double before string."""
    return F.struct(
        F.when(v.isin("true", "false"), v.cast("boolean")).alias("boolValue"),
        F.when(v.rlike(r"^-?\d{1,18}$"), v).alias("intValue"),
        F.when(v.rlike(r"^-?\d+\.\d+$"), v.try_cast("double")).alias("doubleValue"),
        F.when(~v.isin("true", "false") & ~v.rlike(r"^-?\d{1,18}$") & ~v.rlike(r"^-?\d+\.\d+$"), v).alias("stringValue"),
    )


def to_otlp_json(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, otlp (JSON): attributes sorted by key, times as nanosecond strings, empty parent and message left out. spans: trace_id, span_id, parent_span_id, name, start_ms, end_ms, attributes, status_code."""
    attrs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.struct(e["key"].alias("key"), any_value(e["value"]).alias("value")))
    ns = lambda c: (F.col(c).cast("decimal(20,3)") * 1_000_000).cast("decimal(24,0)").cast("string")
    body = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.when(F.col("parent_span_id") != "", F.col("parent_span_id")).alias("parentSpanId"), "name", ns("start_ms").alias("startTimeUnixNano"), ns("end_ms").alias("endTimeUnixNano"), attrs.alias("attributes"), F.struct(F.col("status_code").alias("code")).alias("status"))
    return spans.select("trace_id", "span_id", F.to_json(body).alias("otlp"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Repository facts of a snapshot file ({"repositories": [...]}); rows with an error stay."""
    schema = "repositories array<struct<requested:string,full_name:string,stars:bigint,forks:bigint,open_issues:bigint,releases:bigint,created_at:string,pushed_at:string,latest_release_at:string,fetched_at:string,archived:boolean,license:string,error:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("repositories").alias("r")).select("r.*")


def batch_load(rows: DataFrame, day: Column, day_value: str, checks: dict[str, Column], strict: bool = True, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of one partition date. Strict: any reject empties the accepted chunk. limit is the declared extract limit."""
    part = rows.filter(day == day_value)
    part = part if limit is None else part.limit(limit)
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    judged = part.withColumn("problems", bad)
    rejected = judged.filter(F.size("problems") > 0)
    accepted = judged.filter(F.size("problems") == 0).drop("problems")
    if strict:
        accepted = accepted.join(F.broadcast(rejected.limit(1).select(F.lit(1).alias("__any"))), F.lit(True), "left_anti")
    return accepted, rejected


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """passed, failed and seconds of each file, over nested suites."""
    schema = "_file string, _classname string, _name string, _time double, failure string, error string"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    bad = F.col("failure").isNotNull() | F.col("error").isNotNull()
    return cases.groupBy(F.coalesce("_file", "_classname").alias("file")).agg(F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"), F.sum(F.coalesce("_time", F.lit(0.0))).alias("seconds"))


LEDGER = "timestamp string, measurements map<string, array<bigint>>"


def append_ledger(entries: DataFrame, folder: str) -> None:
    """Add ledger entries (timestamp, measurements) as JSON shards of their own: writers never touch each other's files."""
    entries.select("timestamp", "measurements").write.mode("append").json(folder)


def read_ledger(spark: SparkSession, folder: str, keep: int | None = 100) -> DataFrame:
    """timestamp, sli, good, valid of the newest `keep` entries (all for None) of a folder of shards. A shard with a line that is no entry is left out as a whole; entries that
    say nothing of an indicator have no row for it."""
    raw = spark.read.schema(f"{LEDGER}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder).select("*", F.col("_metadata.file_path").alias("shard"))
    bad = raw.filter(F.col("_corrupt_record").isNotNull() | F.col("timestamp").isNull()).select("shard").distinct()
    good = raw.join(bad, "shard", "left_anti").select("timestamp", "measurements")
    if keep is not None:
        newest = good.select("timestamp").distinct().orderBy(F.desc("timestamp")).limit(keep)
        good = good.join(newest, "timestamp", "left_semi")
    return good.select("timestamp", F.explode("measurements").alias("sli", "m")).select("timestamp", "sli", F.get("m", F.lit(0)).alias("good"), F.get("m", F.lit(1)).alias("valid"))
