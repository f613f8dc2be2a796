"""Queries of deciding joins over the star schema, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jo
from .registry import register
from .tables import table


def j4(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "concat('src/', p_brand, '/m', p_size % 5, '/f', p_partkey, '.py') AS path")
    prefixes = spark.createDataFrame([("src", "core"), ("src/Brand#11", "eleven"), ("src/Brand#12/m1", "one"), ("src/Brand#1", "trap")], "prefix string, kind string")
    return jo.classify_paths(p, "p_partkey", "path", prefixes, F.lit("other"))


register("j4_longest_prefix", j4, "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'eleven' WHEN p_brand = 'Brand#12' AND p_size % 5 = 1 THEN 'one' WHEN p_brand = 'Brand#1' THEN 'trap' ELSE 'core' END AS kind, CASE WHEN p_brand = 'Brand#11' THEN 'declared:src/Brand#11' WHEN p_brand = 'Brand#12' AND p_size % 5 = 1 THEN 'declared:src/Brand#12/m1' WHEN p_brand = 'Brand#1' THEN 'declared:src/Brand#1' ELSE 'declared:src' END AS provenance FROM part")


def j5(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE ' extra' END) AS title")
    m = table(spark, d, "part").filter("p_partkey % 10 = 0").groupBy("p_name").agg(F.max("p_size").cast("string").alias("size")).select(F.col("p_name").alias("name"), "size")
    return jo.match_titles(p, "p_partkey", "title", m)


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
register(
    "j5_fuzzy_title",
    j5,
    f"""WITH a AS (SELECT p_partkey, {_NORM.format("concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE ' extra' END)")} AS t FROM part), m AS (SELECT {_NORM.format('p_name')} AS n, size FROM (SELECT p_name, max(p_size)::VARCHAR AS size FROM part WHERE p_partkey % 10 = 0 GROUP BY 1)),
x AS (SELECT p_partkey, size, 'exact' AS how FROM a JOIN m ON t = n), r AS (SELECT p_partkey, count(*) AS c, max(size) AS size FROM a JOIN m ON contains(t, n) OR contains(n, t) WHERE p_partkey NOT IN (SELECT p_partkey FROM x) GROUP BY 1)
SELECT * FROM x UNION ALL SELECT p_partkey, size, 'contained' FROM r WHERE c = 1""",
)


def j7(spark, d):
    o = table(spark, d, "orders")
    kind = "CASE WHEN o_orderkey % 3 = 0 THEN 'roadmap' ELSE 'defect' END AS kind"
    existing = o.filter("o_orderkey % 5 <> 0").selectExpr("concat('T', o_orderkey, ' ') AS title", kind, "CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'READY' END AS state", "cast(o_orderkey % 4 AS INT) AS points")
    current = o.filter("o_orderkey % 7 <> 0").selectExpr("concat('T', o_orderkey) AS title", kind, "cast(o_orderkey % 8 AS INT) AS points")
    return jo.reconcile_board(existing, current).groupBy("kind", "state", "change").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


register(
    "j7_board",
    j7,
    """WITH o AS (SELECT o_orderkey % 5 <> 0 AS e, o_orderkey % 7 <> 0 AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'roadmap' ELSE 'defect' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'READY' END AS es, (o_orderkey % 4)::INT AS ep, (o_orderkey % 8)::INT AS cp FROM orders),
r AS (SELECT kind, CASE WHEN NOT e THEN 'BACKLOG' WHEN NOT c THEN 'DONE' ELSE es END AS state, CASE WHEN c THEN cp ELSE ep END AS points, CASE WHEN NOT e THEN 'opened' WHEN NOT c AND es = 'DONE' THEN 'dropped' WHEN NOT c THEN 'closed' WHEN cp <> ep THEN 'refreshed' ELSE 'unchanged' END AS change FROM o WHERE e OR c)
SELECT kind, state, change, count(*) AS n, sum(points)::BIGINT AS points FROM r WHERE change <> 'dropped' GROUP BY 1, 2, 3""",
)


def j8(spark, d):
    c = table(spark, d, "customer")
    v = lambda name, miss, changed: c.filter(f"c_custkey % {miss} <> 0").selectExpr("c_custkey", f"CASE WHEN c_custkey % {changed} = 0 THEN concat(c_name, '{name}') ELSE c_name END AS v")
    return jo.merge3(v("b", 11, 100000007), v("o", 7, 5), v("t", 13, 6), "c_custkey").groupBy("side", "outcome").agg(F.count("*").alias("n"))


register(
    "j8_merge3",
    j8,
    """WITH k AS (SELECT CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS b, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN concat(c_name, 'o') ELSE c_name END END AS o, CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_custkey % 6 = 0 THEN concat(c_name, 't') ELSE c_name END END AS t FROM customer),
s AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b THEN 'ours' WHEN o IS NOT DISTINCT FROM b THEN 'theirs' ELSE 'collision' END AS side FROM k WHERE b IS NOT NULL OR o IS NOT NULL OR t IS NOT NULL)
SELECT side, CASE WHEN side = 'collision' THEN 'collision' WHEN (CASE WHEN side = 'ours' THEN o ELSE t END) IS NULL THEN 'deleted' WHEN (CASE WHEN side = 'ours' THEN o ELSE t END) IS NOT DISTINCT FROM b THEN 'same' ELSE 'changed' END AS outcome, count(*) AS n FROM s GROUP BY 1, 2""",
)


def j9(spark, d):
    e = table(spark, d, "lineitem").selectExpr("l_orderkey AS src", "l_partkey AS dst", "CASE WHEN l_returnflag = 'R' THEN 'CALLS' ELSE 'IMPORTS' END AS kind")
    return jo.dangling(e, table(spark, d, "part").filter("p_partkey % 4 <> 0").selectExpr("p_partkey AS id"), ["CALLS"]).groupBy("dst").agg(F.count("*").alias("n"))


register("j9_dangling", j9, "SELECT l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0) GROUP BY 1")


def j10(spark, d):
    calls = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS call_id", "CASE WHEN l_linenumber % 2 = 0 THEN concat('id', l_partkey) ELSE concat('name', l_partkey % 1500) END AS target", "l_linenumber AS args")
    nodes = table(spark, d, "part").selectExpr("concat('id', p_partkey) AS id", "concat('name', p_partkey % 1500) AS name", "2 AS required", "cast(2 + p_size % 3 AS INT) AS total", "p_size % 7 = 0 AS varargs")
    return jo.arity_mismatch(calls, nodes)


register(
    "j10_arity",
    j10,
    """WITH n AS (SELECT p_partkey, p_partkey % 1500 AS m, 2 AS required, 2 + p_size % 3 AS total, p_size % 7 = 0 AS varargs, count(*) OVER (PARTITION BY p_partkey % 1500) AS c FROM part),
x AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, concat('id', l_partkey) AS target, l_linenumber AS args, required, total, varargs FROM lineitem JOIN n ON l_partkey = p_partkey WHERE l_linenumber % 2 = 0
UNION ALL SELECT l_orderkey * 10 + l_linenumber, concat('name', l_partkey % 1500), l_linenumber, required, total, varargs FROM lineitem JOIN n ON l_partkey % 1500 = m AND c = 1 WHERE l_linenumber % 2 = 1)
SELECT call_id, target, CASE WHEN args < required THEN 'too_few' ELSE 'too_many' END AS issue FROM x WHERE args < required OR (args > total AND NOT varargs)""",
)


def j11(spark, d):
    leashes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("defect")).agg(F.collect_set("l_partkey").alias("files"))
    return jo.invalidated(leashes, table(spark, d, "part").filter("p_size = 7").selectExpr("p_partkey AS file"))


register("j11_leash", j11, "SELECT DISTINCT l_orderkey AS defect FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7")


def j12(spark, d):
    ours = table(spark, d, "nation").filter("n_nationkey % 3 = 0").selectExpr("n_name AS feature")
    others = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_name AS holder", "n_name AS feature", "concat('r', s_suppkey % 4) AS evidence", "CASE s_suppkey % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'adopt' ELSE 'integrate' END AS disposition")
    return jo.find_gaps(ours, others)


register("j12_gaps", j12, "SELECT n_name AS feature, count(DISTINCT s_name) AS holders, string_agg(DISTINCT concat('r', s_suppkey % 4), ',' ORDER BY concat('r', s_suppkey % 4)) AS evidence, CASE min(CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) WHEN 0 THEN 'integrate' WHEN 1 THEN 'adopt' ELSE 'build' END AS disposition FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0 GROUP BY 1")


def j13(spark, d):
    dep = table(spark, d, "part").filter("p_size = 1").selectExpr("p_partkey AS symbol", "p_partkey % 10 AS file")
    return jo.unmigrated(dep, table(spark, d, "lineitem").selectExpr("l_partkey AS symbol", "l_suppkey % 10 AS caller_file")).groupBy("symbol").agg(F.count("*").alias("n"))


register("j13_unmigrated", j13, "SELECT l_partkey AS symbol, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1 AND l_suppkey % 10 <> p_partkey % 10 GROUP BY 1")


def j14(spark, d):
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("old"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.lit("new")).otherwise(F.lit("z")), F.lit("n")).alias("args"))
    m = jo.migrate_args(e, "args", {"k": "key", "old": "new"}, ["key"])
    return m.select("event_id", F.col("args")["key"].alias("key"), F.col("args")["new"].alias("new"), F.size("warnings").alias("warnings"))


register("j14_migrate_args", j14, "SELECT event_id, concat('[', props->>'k', ']') AS key, CASE WHEN event_id % 2 = 0 THEN 'n' ELSE event_type END AS new, 2 AS warnings FROM events")


def j15(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("span_id"), F.col("event_type").alias("span_type"), F.when(F.col("event_id") % 4 == 0, "SERVER").otherwise("CLIENT").alias("kind"), F.create_map(F.lit("k"), F.when(F.col("event_id") % 10 == 0, F.lit("x")).otherwise(F.get_json_object("props", "$.k")), F.lit("mode"), F.col("event_type"), F.when(F.col("event_id") % 6 == 0, F.lit("legacy")).otherwise(F.lit("odd")), F.lit("1")).alias("attributes"))
    types = spark.createDataFrame([("click", "CLIENT", ["k", "user"]), ("view", "CLIENT", ["k"]), ("purchase", "SERVER", [])], "span_type string, kind string, required array<string>")
    attrs = spark.createDataFrame([("k", "int", None, None), ("mode", "string", None, ["click", "view"]), ("legacy", "string", "modern", None)], "name string, type string, replaced_by string, allowed array<string>")
    return jo.validate_spans(e, types, attrs).groupBy("issue", "subject").agg(F.count("*").alias("n"))


register(
    "j15_span_conventions",
    j15,
    """WITH f AS (SELECT 'unknown_type' AS issue, event_type AS subject FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') UNION ALL SELECT 'wrong_kind', CASE WHEN event_id % 4 = 0 THEN 'SERVER' ELSE 'CLIENT' END FROM events WHERE (event_type IN ('click', 'view') AND event_id % 4 = 0) OR (event_type = 'purchase' AND event_id % 4 <> 0)
UNION ALL SELECT 'missing', 'user' FROM events WHERE event_type = 'click' UNION ALL SELECT 'wrong_type', 'k' FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'undeclared_value', 'mode' FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT CASE WHEN event_id % 6 = 0 THEN 'deprecated' ELSE 'unknown_attribute' END, CASE WHEN event_id % 6 = 0 THEN 'legacy' ELSE 'odd' END FROM events)
SELECT issue, subject, count(*) AS n FROM f GROUP BY 1, 2""",
)


def j16(spark, d):
    calls = table(spark, d, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), F.create_map(F.lit("k"), F.when(F.col("event_id") % 9 == 0, F.lit("bad")).otherwise(F.get_json_object("props", "$.k")), F.when(F.col("event_id") % 5 == 0, F.lit("zz")).otherwise(F.lit("name")), F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("args"))
    rows = [(t, p, ty, req, ml, lo, hi) for t in ("click", "view", "purchase") for p, ty, req, ml, lo, hi in (("k", "int", True, None, 10.0, 80.0), ("name", "string", True, 6, None, None))]
    contract = spark.createDataFrame(rows, "tool string, param string, type string, required boolean, max_len int, low double, high double")
    return jo.validate_calls(calls, contract).groupBy("issue", "param").agg(F.count("*").alias("n"))


register(
    "j16_contracts",
    j16,
    """WITH e AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE props->>'k' END AS k, event_type IN ('click', 'view', 'purchase') AS known FROM events), f AS (SELECT 'unknown_tool' AS issue, event_type AS param FROM e WHERE NOT known
UNION ALL SELECT 'type', 'k' FROM e WHERE known AND NOT regexp_matches(k, '^-?[0-9]+$') UNION ALL SELECT 'range', 'k' FROM e WHERE known AND regexp_matches(k, '^-?[0-9]+$') AND (TRY_CAST(k AS DOUBLE) < 10 OR TRY_CAST(k AS DOUBLE) > 80)
UNION ALL SELECT 'extra', 'zz' FROM e WHERE known AND event_id % 5 = 0 UNION ALL SELECT 'missing', 'name' FROM e WHERE known AND event_id % 5 = 0 UNION ALL SELECT 'too_long', 'name' FROM e WHERE known AND event_id % 5 <> 0 AND length(concat('user', user_id)) > 6) SELECT issue, param, count(*) AS n FROM f GROUP BY 1, 2""",
)


def j17(spark, d):
    p = table(spark, d, "part")
    deps = p.selectExpr("p_name || p_partkey AS name", "CASE WHEN p_partkey % 8 <> 0 THEN concat('1.', p_size % 4, '.0') END AS floor", "CASE WHEN p_partkey % 6 = 0 THEN 'main' ELSE 'v1' END AS ref", "CASE WHEN p_partkey % 9 = 0 THEN 'http://a.net' ELSE 'https://a.net' END AS url")
    facts = p.selectExpr("p_name || p_partkey AS name", "CASE WHEN p_size % 2 = 0 THEN '1.9.0' ELSE '2.0.0' END AS latest", "p_partkey % 25 = 0 AS archived", "CASE WHEN p_partkey % 10 = 0 THEN 'Dormant' ELSE 'Active' END AS band")
    return jo.audit_inventory(deps, facts).groupBy("risk", "severity").agg(F.count("*").alias("n"))


register(
    "j17_inventory",
    j17,
    """WITH f AS (SELECT 'stale_floor' AS risk, 'medium' AS severity FROM part WHERE p_partkey % 8 <> 0 AND p_size % 2 <> 0 UNION ALL SELECT 'mutable_ref', 'high' FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'unpinned', 'medium' FROM part WHERE p_partkey % 8 = 0 UNION ALL SELECT 'plaintext', 'high' FROM part WHERE p_partkey % 9 = 0
UNION ALL SELECT 'archived', 'high' FROM part WHERE p_partkey % 25 = 0 UNION ALL SELECT 'dormant', 'medium' FROM part WHERE p_partkey % 25 <> 0 AND p_partkey % 10 = 0) SELECT risk, severity, count(*) AS n FROM f GROUP BY 1, 2""",
)


def j18(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN 'open' ELSE 'exec' END AS hook", "CASE WHEN event_id % 3 = 0 THEN CASE event_id % 4 WHEN 0 THEN '/etc/shadow' WHEN 1 THEN '/etc/shadow2' WHEN 2 THEN '/root/../x' ELSE '/tmp/a' END ELSE concat('/bin/', event_type) END AS target")
    return jo.apply_policy(e, ["/bin/click", "/bin/view"], ["/bin/error"], ["/etc/shadow"]).groupBy("rule", "blocked").agg(F.count("*").alias("n"))


register("j18_policy", j18, "WITH r AS (SELECT CASE WHEN event_id % 3 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'sensitive_path' WHEN 2 THEN 'evasion' ELSE 'allow' END WHEN event_type = 'error' THEN 'denied' WHEN event_type NOT IN ('click', 'view') THEN 'not_allowed' ELSE 'allow' END AS rule FROM events) SELECT rule, rule <> 'allow' AS blocked, count(*) AS n FROM r GROUP BY 1, 2")


def j19(spark, d):
    p = table(spark, d, "part")
    reach = table(spark, d, "lineitem").filter("l_shipdate < '1993-01-01'").selectExpr("l_partkey AS name").distinct()
    return jo.untested(p.selectExpr("p_partkey AS name"), p.filter("p_size % 2 = 0").selectExpr("p_partkey AS name"), reach)


register("j19_untested", j19, "SELECT p_partkey AS name FROM part WHERE p_size % 2 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < '1993-01-01')")


def j20(spark, d):
    groups = table(spark, d, "nation").selectExpr("concat('g', n_regionkey) AS ref", "n_nationkey AS gpos", "concat('a', n_nationkey) AS attribute", "CASE WHEN n_nationkey % 2 = 0 THEN 'required' ELSE 'opt' END AS level")
    spans = table(spark, d, "supplier").selectExpr("s_suppkey AS span", "1 AS pos", "concat('g', s_suppkey % 6) AS ref", "cast(null AS string) AS attribute", "cast(null AS string) AS level").unionAll(
        table(spark, d, "supplier").selectExpr("s_suppkey", "2", "cast(null AS string)", "concat('a', s_nationkey)", "CASE WHEN s_suppkey % 2 = 0 THEN 'direct' END")
    )
    return jo.expand_groups(spans, groups)


register(
    "j20_groups",
    j20,
    """WITH r AS (SELECT s_suppkey AS span, concat('a', n_nationkey) AS attribute, CASE WHEN n_nationkey % 2 = 0 THEN 'required' ELSE 'opt' END AS level, 1 AS pos FROM supplier JOIN nation ON s_suppkey % 6 = n_regionkey UNION ALL SELECT s_suppkey, concat('a', s_nationkey), CASE WHEN s_suppkey % 2 = 0 THEN 'direct' END, 2 FROM supplier)
SELECT span, attribute, arg_max(level, pos) FILTER (level IS NOT NULL) AS level FROM r GROUP BY 1, 2 UNION ALL SELECT s_suppkey, concat('g', s_suppkey % 6), 'unknown group' FROM supplier WHERE s_suppkey % 6 = 5""",
)


def a24(spark, d):
    r = table(spark, d, "part").selectExpr("p_name || p_partkey AS name", "CASE WHEN p_partkey % 9 <> 0 THEN '1.0.0' END AS since", "concat(p_size % 4, '.', p_partkey % 2, '.0') AS removal", "p_partkey % 3 <> 0 AS warns", "CASE WHEN p_partkey % 5 = 0 THEN 'REMOVED' ELSE 'DEPRECATED' END AS state", "CASE WHEN p_partkey % 7 = 0 THEN '1.2.0' END AS flag_expires")
    return jo.audit_lifecycle(r, "2.0.0").groupBy("issue").agg(F.count("*").alias("n"))


register(
    "a24_lifecycle",
    a24,
    """WITH f AS (SELECT 'missing_metadata' AS issue FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT 'overdue' FROM part WHERE p_partkey % 5 <> 0 AND (p_size % 4, p_partkey % 2) <= (2, 0) UNION ALL SELECT 'non_major_removal' FROM part WHERE p_partkey % 2 <> 0 UNION ALL SELECT 'silent' FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 = 0 UNION ALL SELECT 'expired_flag' FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 = 0)
SELECT issue, count(*) AS n FROM f GROUP BY 1""",
)


def s12(spark, d):
    inv = table(spark, d, "orders").selectExpr("o_orderkey AS k", "date_format(o_orderdate, 'yyyy-MM') AS period", "o_totalprice AS amount")
    paid = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")).alias("paid"))
    return jo.summarise(jo.reconcile(inv, paid, "k", 5.0, "percent")).select("period", "n", F.round("difference", 1).alias("difference"), "resolved")


register("s12_invoices", s12, "WITH p AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS paid FROM lineitem GROUP BY 1) SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, round(sum(o_totalprice - coalesce(paid, 0)), 1) AS difference, count(*) FILTER (abs(o_totalprice - coalesce(paid, 0)) <= 0.05 * o_totalprice) AS resolved FROM orders LEFT JOIN p ON o_orderkey = k GROUP BY 1")
