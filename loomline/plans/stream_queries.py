"""Queries of windowed alerts, state machines and source formats over events, conversations and orders."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.text import jitter
from ..operators import findings as fi
from ..operators import graph as gr
from ..operators import joins as jo
from ..sources import filesource as fsrc
from ..sources import formats as fm
from ..streaming import alerts as al
from ..streaming import stateful as sf
from ..streaming import timed as tm
from .registry import oracle_of, register
from .tables import table

_SLIDE = "SELECT unnest(generate_series(time_bucket(INTERVAL '{s} minutes', ts) - INTERVAL '{back} minutes', time_bucket(INTERVAL '{s} minutes', ts), INTERVAL '{s} minutes')) + INTERVAL '{l} minutes' AS ended, events.* FROM events"


def slide(length: int, step: int) -> str:
    return _SLIDE.format(s=step, back=length - step, l=length)


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def r3(spark, d):
    a = al.alert_rate(events(spark, d), "ts", "value", ["event_type"], 60.0, "60 minutes", "15 minutes", 1.0)
    return al.held(a, ["event_type"], F.col("fires"), 2, 900).select(F.col("at").cast("long").alias("ended"), "event_type", F.round("rate", 3).alias("rate"))


register("r3_rate_alert", r3, f"WITH w AS ({slide(60, 15)}), g AS (SELECT ended, event_type, sum(value) AS rate FROM w GROUP BY 1, 2 HAVING sum(value) > 60), h AS (SELECT *, lag(ended) OVER (PARTITION BY event_type ORDER BY ended) AS b FROM g) SELECT epoch(ended)::BIGINT AS ended, event_type, round(rate, 3) AS rate FROM h WHERE ended - b = INTERVAL '15 minutes'")


def r4(spark, d):
    a = al.alert_ratio(events(spark, d), "ts", ["event_type"], F.col("value") > 50, F.lit(True), 0.25, "60 minutes", "30 minutes")
    return a.select(F.col("at").cast("long").alias("ended"), "event_type", "bad", "n", F.round("ratio", 6).alias("ratio"), "fires")


register("r4_ratio_alert", r4, f"WITH w AS ({slide(60, 30)}) SELECT epoch(ended)::BIGINT AS ended, event_type, count(*) FILTER (value > 50) AS bad, count(*) AS n, round(count(*) FILTER (value > 50) / count(*), 6) AS ratio, count(*) FILTER (value > 50) / count(*) > 0.25 AS fires FROM w GROUP BY ended, event_type")


def r5(spark, d):
    e = events(spark, d)
    g = al.alert_gauge(e, "ts", "value", ["event_type"], above=80.0).filter("fires").select(F.col("at").cast("long").alias("ended"), "event_type", F.lit("gauge").alias("what"))
    return g.unionByName(al.alert_increase(e, "ts", ["event_type"], F.col("event_type") == "error").select(F.col("at").cast("long").alias("ended"), "event_type", F.lit("increase").alias("what")))


register("r5_gauge_increase", r5, "WITH m AS (SELECT date_trunc('minute', ts) + INTERVAL '1 minute' AS ended, event_type, arg_max(value, (ts, value)) AS last FROM events GROUP BY 1, 2) SELECT epoch(ended)::BIGINT AS ended, event_type, 'gauge' AS what FROM m WHERE last > 80 UNION ALL SELECT epoch(ended)::BIGINT, event_type, 'increase' FROM m WHERE event_type = 'error'")


def r6(spark, d):
    return al.velocity(events(spark, d), "ts", "value", ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("velocity"), 2).alias("velocity"))


register("r6_velocity", r6, f"WITH w AS ({slide(2, 1)}), g AS (SELECT ended, event_type, sum(value) / 2 AS v FROM w GROUP BY 1, 2) SELECT event_type, count(*) AS n, round(sum(v), 2) AS velocity FROM g GROUP BY 1")


def r7(spark, d):
    b = table(spark, d, "events").groupBy("event_type", (F.ceil(F.col("value") / 10) * 10.0).alias("le")).agg(F.count("*").alias("n"))
    return al.histogram_quantile(b, ["event_type"], [0.5, 0.9, 0.99]).select("event_type", "q", F.round("value", 4).alias("value"))


register("r7_quantiles", r7, "WITH b AS (SELECT event_type, ceil(value / 10) * 10.0 AS le, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS cum, coalesce(lag(le) OVER w, 0) AS lo, sum(n) OVER (PARTITION BY event_type) AS t FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)), q AS (SELECT *, unnest([0.5, 0.9, 0.99])::DOUBLE AS q FROM c) SELECT event_type, q, round(lo + (le - lo) * (q * t - (cum - n)) / n, 4) AS value FROM q WHERE cum >= q * t AND cum - n < q * t")


def r8(spark, d):
    e = events(spark, d)
    s = al.status_share(e, "ts", "event_type").select(F.col("at").cast("long").alias("ended"), "event_type", F.round("share", 6).alias("share"))
    h = al.hit_ratio(e, "ts", F.col("event_type") == "view", "60 minutes").select(F.col("at").cast("long").alias("ended"), F.lit("hits").alias("event_type"), F.round("ratio", 6).alias("share"))
    return s.unionByName(h)


register("r8_shares", r8, "WITH h AS (SELECT epoch(date_trunc('hour', ts))::BIGINT + 3600 AS ended, event_type FROM events) SELECT ended, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY ended), 6) AS share FROM h GROUP BY 1, 2 UNION ALL SELECT ended, 'hits', round(count(*) FILTER (event_type = 'view') / count(*), 6) FROM h GROUP BY 1")


def r9(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 50).alias("counter"))
    return al.increase(e, ["user_id"], "event_id", "counter").groupBy("user_id").agg(F.sum("increase").alias("increase"))


register("r9_increase", r9, "WITH c AS (SELECT user_id, event_id % 50 AS c, lag(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, sum(CASE WHEN b IS NULL THEN 0 WHEN c < b THEN c ELSE c - b END)::BIGINT AS increase FROM c GROUP BY 1")


def r10(spark, d):
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("http.request.header.cookie"), F.lit("x"), F.lit("k"), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, F.lit("env")).otherwise(F.lit("zone")), F.lit("own")).alias("a"))
    return e.select("event_id", al.scrub(F.col("a"), {"env": "prod"}).alias("a")).select("event_id", F.array_join(F.array_sort(F.map_keys("a")), ",").alias("keys"), F.col("a")["env"].alias("env"))


register("r10_scrub", r10, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'env,k' ELSE 'env,k,zone' END AS keys, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'prod' END AS env FROM events")


def r11(spark, d):
    return al.leases(events(spark, d), "user_id", "ts", "2024-01-30 00:00:00", 86400)


register("r11_leases", r11, "SELECT user_id, epoch(max(date_trunc('second', ts)))::BIGINT + 86400 AS expires, epoch(TIMESTAMP '2024-01-30 00:00:00') < epoch(max(date_trunc('second', ts))) + 86400 AS active FROM events GROUP BY 1")


def r12(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(al.deadband(F.when(F.col("event_type") == "error", 1).otherwise(0), F.col("event_id") % 10, F.col("value"), 40.0, 2).alias("action")).agg(F.count("*").alias("n"))


register("r12_deadband", r12, "SELECT CASE WHEN event_type = 'error' THEN 'REPAIR' WHEN event_id % 10 < 2 THEN 'REFACTOR' WHEN value > 60 THEN 'OPTIMISE' ELSE 'EQUILIBRIUM' END AS action, count(*) AS n FROM events GROUP BY 1")

_CHUNK = "CASE WHEN turn % 3 = 0 THEN concat('a<thi', '') WHEN turn % 3 = 1 THEN concat('nk>', role) ELSE 'b</think>c' END"


def r1(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.expr(_CHUNK).alias("chunk"))
    return sf.split_reasoning(c).select("key", "emitted", "thought", "dropped_closes", "unclosed")


register(
    "r1_reasoning",
    r1,
    f"""WITH t AS (SELECT conv_id, string_agg({_CHUNK}, '' ORDER BY turn) AS t FROM conversations GROUP BY 1), u AS (SELECT conv_id, t, length(t) - length(replace(t, '<think>', '')) > length(t) - length(replace(t, '</think>', '')) AS x, (length(t) - length(replace(t, '<think>', ''))) // 7 AS o, (length(t) - length(replace(t, '</think>', ''))) // 8 AS c FROM t)
SELECT conv_id::VARCHAR AS key, regexp_replace(regexp_replace(t, '(?s)<think>.*?(</think>|$)', '', 'g'), '</think>', '', 'g') AS emitted, array_to_string(regexp_extract_all(t, '(?s)<think>(.*?)(?:</think>|$)', 1), '') AS thought, greatest(c - o, 0)::INT AS dropped_closes, o > c AS unclosed FROM u""",
)


def r2(spark, d):
    e = table(spark, d, "events").selectExpr("user_id AS key", "event_id AS id", "cast(event_id AS DOUBLE) / 100 AS at", "1.0 + event_id % 3 AS cost")
    return sf.token_bucket(e, 0.5, 5.0)


register(
    "r2_token_bucket",
    r2,
    """WITH RECURSIVE t AS (SELECT user_id::VARCHAR AS key, event_id AS id, event_id::DOUBLE / 100 AS came, (1 + event_id % 3)::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT key, id, k, greatest(0.0, (cost - 5.0) / 0.5) AS wait, came + greatest(0.0, (cost - 5.0) / 0.5) AS admitted, 5.0::DOUBLE + greatest(0.0, (cost - 5.0) / 0.5) * 0.5 - cost AS tokens FROM t WHERE k = 1
UNION ALL SELECT key, id, k, begun + hold - came, begun + hold, room + hold * 0.5 - cost FROM (SELECT *, greatest(0.0, (cost - room) / 0.5) AS hold FROM (SELECT t.*, greatest(t.came, r.admitted) AS begun, least(5.0, r.tokens + (greatest(t.came, r.admitted) - r.admitted) * 0.5) AS room FROM r JOIN t ON t.key = r.key AND t.k = r.k + 1)))
SELECT key, id, admitted, wait FROM r""",
)


def r16j(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", jitter(F.col("event_id"), F.lit(8.0)).alias("wait"))


register("p16_jitter", r16j)


def s3(spark, d):
    e = table(spark, d, "events")
    line = (
        F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.lit("execve").alias("type"), F.col("event_id").alias("pid"), F.col("event_type").alias("binary"), F.lit("2024-01-01T00:00:10Z").alias("time"))))
        .when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.struct(F.struct(F.col("event_id").alias("pid"), F.col("event_type").alias("binary")).alias("process")).alias("process_exec"))))
        .otherwise(F.to_json(F.struct(F.lit("weird").alias("event_type"), F.col("event_id").alias("pid"), F.col("event_type").alias("comm"))))
    )
    return fm.read_audit_events(e.select("event_id", line.alias("value")), "value", "event_id").select("event_id", F.col("event_type").alias("kind"), "pid", "binary", "seconds")


register("s3_audit_events", s3, "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'UNKNOWN' ELSE 'EXEC' END AS kind, event_id AS pid, event_type AS binary, CASE WHEN event_id % 3 = 0 THEN 1704067210.0 ELSE 0.0 END::DOUBLE AS seconds FROM events")


def s45(spark, d):
    f = table(spark, d, "lineitem").filter("l_returnflag = 'R'").selectExpr("concat('tool', l_suppkey % 5) AS tool", "concat('RULE', l_linenumber) AS rule_id", "'warning' AS level", "repeat('m', l_linenumber * 20) AS message", "concat('f', l_partkey) AS file_path", "concat(l_orderkey, '-', l_linenumber) AS fingerprint")
    return fm.parse_sarif(fm.write_sarif(f), "log").groupBy("tool", "rule_id").agg(F.count("*").alias("n"), F.max(F.length("message")).alias("longest"), F.countDistinct("fingerprint").alias("fingerprints"))


register("s4_s5_sarif", s45, "SELECT concat('tool', l_suppkey % 5) AS tool, concat('RULE', l_linenumber) AS rule_id, count(*) AS n, max(least(80, l_linenumber * 20))::INT AS longest, count(DISTINCT concat(l_orderkey, '-', l_linenumber)) AS fingerprints FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")


def s6(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit("p")).alias("parent_span_id"), F.col("event_type").alias("name"), F.col("event_id").cast("double").alias("start_ms"), (F.col("event_id") + 1.5).alias("end_ms"), F.create_map(F.lit("z"), F.lit("true"), F.lit("k"), F.get_json_object("props", "$.k")).alias("attributes"), F.lit(1).alias("status_code"))
    o = fm.to_otlp_json(s)
    return o.select("span_id", F.get_json_object("otlp", "$.endTimeUnixNano").alias("ended"), F.get_json_object("otlp", "$.attributes[0].value.intValue").alias("k"), F.get_json_object("otlp", "$.attributes[1].value.boolValue").alias("z"), F.get_json_object("otlp", "$.parentSpanId").alias("parent"))


register("s6_otlp", s6, "SELECT event_id::VARCHAR AS span_id, (event_id * 1000000 + 1500000)::VARCHAR AS ended, props->>'k' AS k, 'true' AS z, CASE WHEN event_id % 2 = 1 THEN 'p' END AS parent FROM events")


def s6s(spark, d):
    """Spans of the events, with array values, written as trace files and read again."""
    fsrc.register(spark)
    e = table(spark, d, "events").selectExpr(
        "cast(user_id AS string) AS trace_id", "cast(event_id AS string) AS span_id", "CASE WHEN event_id % 2 = 1 THEN 'p' END AS parent_span_id", "event_type AS name", "1 AS kind", "cast(event_id AS double) AS start_ms", "event_id + 1.5D AS end_ms",
        "map('k', get_json_object(props, '$.k'), 'tools', concat('[\"', event_type, '\", \"', event_id % 3, '\"]')) AS attributes", "cast(array() AS array<struct<name:string,at_ms:double,attributes:map<string,string>>>) AS events", "0 AS status_code", "'' AS status_message", "'lib' AS scope", "map('service.name', 's') AS resource",
    )
    at = f"{gr.shared_folder(spark)}/traces-{uuid4().hex}"
    e.write.format("otlp_traces").mode("append").save(at)
    back = spark.read.format("otlp_traces").load(at)
    return back.selectExpr("trace_id", "span_id", "parent_span_id AS parent", "name", "start_ms", "end_ms", "attributes['k'] AS k", "get_json_object(attributes['tools'], '$[0]') AS tool", "get_json_object(attributes['tools'], '$[1]') AS n", "resource['service.name'] AS service")


register("s6_trace_source", s6s, "SELECT user_id::VARCHAR AS trace_id, event_id::VARCHAR AS span_id, CASE WHEN event_id % 2 = 1 THEN 'p' END AS parent, event_type AS name, event_id::DOUBLE AS start_ms, event_id + 1.5::DOUBLE AS end_ms, props->>'k' AS k, event_type AS tool, (event_id % 3)::VARCHAR AS n, 's' AS service FROM events")


def s8(spark, d):
    from ..operators.pages import decode_body

    p = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"), F.lit("text/html; charset=utf-8").alias("ct"), "html")
    return p.select("page_id", F.md5(decode_body(F.col("body"), F.col("ct"))).alias("digest"))


register("s8_charsets", s8, "SELECT page_id, md5(html) AS digest FROM pages")


def s10(spark, d):
    return sf.purge_dead(events(spark, d).filter("event_type = 'error'"), "ts", "2024-01-20 00:00:00", 24.0)


register("s10_purge", s10, "SELECT count(*) FILTER (epoch(ts) < epoch(TIMESTAMP '2024-01-20 00:00:00') - 86400) AS purged, count(*) FILTER (epoch(ts) >= epoch(TIMESTAMP '2024-01-20 00:00:00') - 86400) AS kept FROM events WHERE event_type = 'error'")


def s11(spark, d):
    o = table(spark, d, "orders")
    a, r = fm.batch_load(o, F.date_format("o_orderdate", "yyyy"), "1995", {"price": F.col("o_totalprice") > 1000, "customer": F.col("o_custkey") % 9 != 0}, strict=False)
    return a.select(F.lit("accepted").alias("what"), "o_orderkey").unionByName(r.select(F.array_join("problems", "+").alias("what"), "o_orderkey")).groupBy("what").agg(F.count("*").alias("n"))


register("s11_batch_load", s11, "SELECT what, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 1000 AND o_custkey % 9 <> 0 THEN 'accepted' ELSE array_to_string(list_filter([CASE WHEN o_totalprice <= 1000 THEN 'price' END, CASE WHEN o_custkey % 9 = 0 THEN 'customer' END], lambda x: x IS NOT NULL), '+') END AS what FROM orders WHERE strftime(o_orderdate, '%Y') = '1995') GROUP BY 1")


def s9(spark, d):
    """Snapshots of one nation's suppliers each, written as files of their own and read again."""
    s = table(spark, d, "supplier").selectExpr("s_nationkey", "named_struct('requested', concat('o/r', s_suppkey), 'full_name', s_name, 'stars', s_suppkey * 3, 'archived', s_suppkey % 7 = 0, 'error', CASE WHEN s_suppkey % 11 = 0 THEN 'gone' END) AS r")
    at = f"{gr.shared_folder(spark)}/facts-{uuid4().hex}"
    s.groupBy("s_nationkey").agg(F.collect_list("r").alias("repositories")).select("repositories").write.option("maxRecordsPerFile", 1).json(at)
    return fm.read_facts(spark, at).select("requested", "full_name", "stars", "archived", "error")


register("s9_facts", s9, "SELECT concat('o/r', s_suppkey) AS requested, s_name AS full_name, s_suppkey * 3 AS stars, s_suppkey % 7 = 0 AS archived, CASE WHEN s_suppkey % 11 = 0 THEN 'gone' END AS error FROM supplier")


def s13(spark, d):
    """Test reports with a case for each order, written as XML and read again."""
    o = table(spark, d, "orders").selectExpr("concat('tests/test_', o_custkey % 50, '.py') AS _file", "concat('c', o_custkey % 50) AS _classname", "concat('t', o_orderkey) AS _name", "cast(o_orderkey % 8 AS double) / 4 AS _time", "CASE WHEN o_orderkey % 9 = 0 THEN 'no' END AS failure", "CASE WHEN o_orderkey % 10 = 0 THEN 'bad' END AS error")
    at = f"{gr.shared_folder(spark)}/junit-{uuid4().hex}"
    o.write.format("xml").option("rowTag", "testcase").option("rootTag", "testsuite").save(at)
    return fm.read_junit(spark, at).select("file", "passed", "failed", F.round("seconds", 3).alias("seconds"))


register("s13_junit", s13, "SELECT concat('tests/test_', o_custkey % 50, '.py') AS file, count(*) FILTER (o_orderkey % 9 <> 0 AND o_orderkey % 10 <> 0) AS passed, count(*) FILTER (o_orderkey % 9 = 0 OR o_orderkey % 10 = 0) AS failed, round(sum((o_orderkey % 8)::DOUBLE / 4), 3) AS seconds FROM orders GROUP BY 1")


def a9(spark, d):
    p = table(spark, d, "lineitem").selectExpr("concat('src/', l_returnflag, '/', l_linestatus, '/x') AS path", "l_quantity AS added")
    prefixes = spark.createDataFrame([("src/R", "feature"), ("src/N/O", "quality"), ("src/A", "tooling")], "prefix string, kind string")
    kinds = jo.classify_paths(p.select("path").distinct(), "path", "path", prefixes, F.lit("other")).filter("kind <> 'other'")
    g = p.join(kinds, "path").groupBy("kind").agg(F.sum("added").alias("added"), F.count_if(F.col("provenance").startswith("declared")).alias("declared"))
    total = g.agg(F.sum("added").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("kind", F.round("added", 2).alias("added"), F.round(F.col("added") / F.col("t"), 6).alias("share"), "declared")


register("a9_balance", a9, "WITH k AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'feature' WHEN l_returnflag = 'A' THEN 'tooling' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'quality' ELSE 'other' END AS kind, l_quantity AS q FROM lineitem) SELECT kind, round(sum(q), 2) AS added, round(sum(q) / sum(sum(q)) OVER (), 6) AS share, count(*) AS declared FROM k WHERE kind <> 'other' GROUP BY 1")

#: Audit events made of the rows of events; valid in Spark and DuckDB.
_EVENT = (
    "CASE event_id % 7 WHEN 0 THEN 'exec' WHEN 1 THEN 'connect' WHEN 2 THEN 'open' WHEN 3 THEN 'open' WHEN 4 THEN 'privilege' ELSE 'other' END AS kind",
    "CASE WHEN event_id % 7 = 0 THEN concat('/usr/bin/', CASE event_type WHEN 'click' THEN 'nc' WHEN 'error' THEN 'bash' ELSE 'git' END) ELSE '' END AS program",
    "CASE WHEN event_type = 'error' THEN '-i' ELSE '' END AS arguments",
    "CASE event_id % 7 WHEN 1 THEN concat('10.', user_id % 250, '.0.', event_id % 9, ':80') WHEN 2 THEN concat('/etc/', event_type, '/../shadow', CASE WHEN event_id % 2 = 0 THEN '' ELSE 'y' END) WHEN 3 THEN concat('//root/./.ssh/', event_type) ELSE '' END AS target",
    "CASE event_id % 7 WHEN 4 THEN 'setuid' WHEN 5 THEN 'PTRACE_attach' ELSE '' END AS syscall",
)


def a18(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", *_EVENT)
    return fi.audit_events(e, "event_id")


register(
    "a18_event_rules",
    a18,
    f"""WITH e AS (SELECT event_id, event_type, user_id, {', '.join(_EVENT)} FROM events) SELECT event_id, 'EBPF001' AS rule_id, 'critical' AS severity, concat(program, ' ', arguments) AS subject FROM e WHERE kind = 'exec' AND event_type IN ('click', 'error')
UNION ALL SELECT event_id, 'EBPF002', 'high', split_part(target, ':', 1) FROM e WHERE kind = 'connect' UNION ALL SELECT event_id, 'EBPF003', 'critical', '/etc/shadow' FROM e WHERE event_id % 7 = 2 AND event_id % 2 = 0
UNION ALL SELECT event_id, 'EBPF003', 'critical', concat('/root/.ssh/', event_type) FROM e WHERE event_id % 7 = 3 UNION ALL SELECT event_id, 'EBPF004', 'high', 'setuid' FROM e WHERE kind = 'privilege' UNION ALL SELECT event_id, 'EBPF005', 'high', 'ptrace_attach' FROM e WHERE event_id % 7 = 5""",
)


def u4(spark, d):
    from ..functions.sql import register_sql

    register_sql(spark)
    table(spark, d, "documents").createOrReplaceTempView("loomline_documents")
    return spark.sql("SELECT doc_id, token_count38(text) AS tokens, token_words(text) AS words FROM loomline_documents")


register("u4_sql_functions", u4, r"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(length(text) / 3.8)::BIGINT) END::BIGINT AS tokens, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS words FROM documents")


def u5(spark, d):
    from ..functions.sql import register_sql

    register_sql(spark)
    table(spark, d, "documents").createOrReplaceTempView("loomline_documents")
    return spark.sql("SELECT doc_id, line_no, md5(line) AS digest FROM loomline_documents, LATERAL find_lines(text, 'token = ')")


register("u5_table_function", u5, r"WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) SELECT doc_id, line_no, md5(line) AS digest FROM l WHERE contains(line, 'token = ')")


def replayed(spark, d, name, build, delay="1 hour"):
    """build(stream) over the events table read as a stream, run to its end. A last row a century later moves the watermark past all others; its key is -1 and empty."""
    e, at = table(spark, d, "events"), f"{gr.shared_folder(spark)}/{name}-{uuid4().hex}"
    last = e.agg(F.max("ts").alias("ts")).select(*[(F.col("ts") + F.expr("interval 100 years") if f.name == "ts" else F.lit(-1 if f.name == "user_id" else "" if f.name == "event_type" else None)).cast(f.dataType).alias(f.name) for f in e.schema])
    last.write.parquet(f"{at}/last")
    streams = [spark.readStream.schema(e.schema).parquet(p) for p in (f"{d}/events.parque[t]", f"{at}/last")]  # a pattern: a stream's path must be a folder else
    rows = streams[0].unionByName(streams[1]).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = build(rows)
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


_SPELLS = "WITH b AS (SELECT user_id, epoch_us(ts) AS beat, epoch_us(ts) >= lag(epoch_us(ts)) OVER w + 86400000000 AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(CASE WHEN coalesce(fresh, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY beat ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT user_id::VARCHAR AS key, min(beat)::BIGINT AS acquired, max(beat)::BIGINT + 86400000000 AS expires, count(*) AS beats FROM n GROUP BY user_id, k"


def _spells(rows):
    return rows.select("key", F.unix_micros("acquired").alias("acquired"), F.unix_micros("expires").alias("expires"), "beats")


register("r11_lease_spells", lambda spark, d: _spells(tm.lease_spells(events(spark, d), "user_id", "ts", 86400)), _SPELLS)
register("r11_lease_stream", lambda spark, d: _spells(replayed(spark, d, "leases", lambda s: tm.lease_spells(s, "user_id", "ts", 86400))).filter("key <> '-1'"), _SPELLS)


def r9s(spark, d):
    samples = lambda s: s.withColumn("counter", F.col("event_id") % 50)
    out = replayed(spark, d, "increase", lambda s: tm.increase_stream(samples(s), "user_id", "ts", "event_id", "counter"))
    return out.filter("key <> '-1'").groupBy("key").agg(F.sum("increase").cast("long").alias("increase"))


register("r9_increase_stream", r9s, "WITH c AS (SELECT user_id, event_id % 50 AS c, lag(event_id % 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id::VARCHAR AS key, sum(CASE WHEN b IS NULL THEN 0 WHEN c < b THEN c ELSE c - b END)::BIGINT AS increase FROM c GROUP BY 1")


def r3s(spark, d):
    held = lambda s: al.held(al.alert_rate(s, "ts", "value", ["event_type"], 60.0, "60 minutes", "15 minutes", 1.0), ["event_type"], F.col("fires"), 2, 900)
    return replayed(spark, d, "rate", held).select(F.col("at").cast("long").alias("ended"), "event_type", F.round("rate", 3).alias("rate"))


register("r3_rate_alert_stream", r3s, oracle_of("r3_rate_alert"))
