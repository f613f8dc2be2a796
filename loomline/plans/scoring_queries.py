"""Queries of scorecards, boards and budgets over orders, lineitem, events, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as sc
from .registry import register
from .tables import table

# ---- model runs from lineitem: a supplier is a model, a line is a run
RUN_EXPRS = [
    "concat('m', l_suppkey % 12) AS model_id", "l_orderkey * 10 + l_linenumber AS task_id", "l_returnflag <> 'R' AS tests_passed", "cast(l_quantity * 100 AS BIGINT) AS prompt_tokens",
    "cast(l_linenumber * 250 AS BIGINT) AS completion_tokens", "cast(l_orderkey % 7 AS INT) AS invariants", "l_linenumber <= 2 AS headroom", "1.0 - l_discount AS minimality",
]
RUN = ", ".join(RUN_EXPRS)
PRICE_ROWS = [(f"m{i}", 0.25 * i, 0.75 * i, i % 5 == 0) for i in range(10)]
_RUNS = f"WITH prices AS (SELECT * FROM (VALUES {', '.join(f'({m!r}, {a}, {b}, {str(c).lower()})' for m, a, b, c in PRICE_ROWS)}) p(model_id, pi, po, is_local)), r0 AS (SELECT {RUN} FROM lineitem), runs AS (SELECT r0.*, CASE WHEN coalesce(is_local, false) THEN 0.0 ELSE greatest(0, prompt_tokens) / 1e6 * coalesce(pi, 1.0) + greatest(0, completion_tokens) / 1e6 * coalesce(po, 3.0) END::DOUBLE AS cost_usd, coalesce(is_local, false) AS is_local FROM r0 LEFT JOIN prices USING (model_id))"


def prices(spark):
    return spark.createDataFrame(PRICE_ROWS, "model_id string, input_usd_per_m double, output_usd_per_m double, is_local boolean")


def runs(spark, d):
    return sc.token_cost(table(spark, d, "lineitem").selectExpr(*RUN_EXPRS), prices(spark))


def j3(spark, d):
    return runs(spark, d).groupBy("model_id").agg(F.round(F.sum("cost_usd"), 2).alias("cost"), F.count("*").alias("n"))


register("j3_token_cost", j3, f"{_RUNS} SELECT model_id, round(sum(cost_usd), 2) AS cost, count(*) AS n FROM runs GROUP BY 1")


def a3(spark, d):
    b = sc.leaderboard(runs(spark, d))
    return b.select("model_id", "tasks", "passed", F.round("pass_rate", 4).alias("pass_rate"), F.round("compliance", 4).alias("compliance"), F.round("headroom_rate", 4).alias("headroom_rate"), F.round("total_cost", 2).alias("total_cost"), "composite", "rank")


register(
    "a3_leaderboard",
    a3,
    f"""{_RUNS}, g AS (SELECT model_id, count(*) AS tasks, count(*) FILTER (tests_passed) AS passed, sum(invariants) AS inv, avg(headroom::INT) AS headroom_rate, avg(minimality) AS mini, sum(cost_usd) AS total_cost FROM runs GROUP BY 1),
h AS (SELECT *, 100.0 * passed / tasks AS pass_rate, 100.0 * inv / (6 * tasks) AS compliance, total_cost / greatest(inv, 1) AS cpi FROM g),
c AS (SELECT *, round(0.35 * pass_rate + 0.30 * compliance + 20.0 * mini + 0.15 * CASE WHEN cpi <= 0 THEN 100.0 ELSE greatest(0.0, 100.0 - 20.0 * log10(greatest(1.0, cpi * 1e5))) END, 2) AS composite FROM h)
SELECT model_id, tasks, passed, round(pass_rate, 4) AS pass_rate, round(compliance, 4) AS compliance, round(headroom_rate, 4) AS headroom_rate, round(total_cost, 2) AS total_cost, composite, row_number() OVER (ORDER BY composite DESC, model_id)::INT AS rank FROM c""",
)


def a4(spark, d):
    r = runs(spark, d).withColumn("grp", F.col("invariants").cast("string")).withColumn("is_local", F.col("model_id").isin("m0", "m5")).withColumn("verified", F.col("tests_passed"))
    o = sc.offload(r, (3.0, 15.0))
    return o.select("grp", "local_tokens", "tokens", F.round("hypothetical", 1).alias("hypothetical"), F.round("actual", 1).alias("actual"), F.round("savings", 1).alias("savings"), F.round("offload_pct", 1).alias("offload_pct"), "verified", "violated")


register(
    "a4_offload",
    a4,
    f"""{_RUNS} SELECT invariants::VARCHAR AS grp, sum(CASE WHEN is_local THEN prompt_tokens + completion_tokens ELSE 0 END)::BIGINT AS local_tokens, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens, round(sum((prompt_tokens * 3.0 + completion_tokens * 15.0) / 1e6), 1) AS hypothetical,
round(sum(cost_usd), 1) AS actual, round(greatest(0.0, sum((prompt_tokens * 3.0 + completion_tokens * 15.0) / 1e6) - sum(cost_usd)), 1) AS savings, round(100.0 * sum(CASE WHEN is_local THEN prompt_tokens + completion_tokens ELSE 0 END) / sum(prompt_tokens + completion_tokens), 1) AS offload_pct, count(*) FILTER (tests_passed) AS verified, count(*) FILTER (NOT tests_passed) AS violated FROM runs GROUP BY 1""",
)


def a25(spark, d):
    r = table(spark, d, "lineitem").selectExpr("l_returnflag", "l_tax AS draft_cost", "l_discount + 0.05 AS frontier_cost", "l_linestatus = 'O' AS draft_passes")
    return sc.cascade(r).groupBy("l_returnflag", "tier").agg(F.count("*").alias("n"), F.round(F.sum("spent"), 4).alias("spent"), F.round(F.sum("saved"), 4).alias("saved"))


register("a25_cascade", a25, "SELECT l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'draft' ELSE 'frontier' END AS tier, count(*) AS n, round(sum(CASE WHEN l_linestatus = 'O' THEN l_tax ELSE l_tax + l_discount + 0.05 END), 4) AS spent, round(sum(CASE WHEN l_linestatus = 'O' THEN greatest(l_discount + 0.05 - l_tax, 0.0) ELSE 0.0 END), 4) AS saved FROM lineitem GROUP BY 1, 2")

FEATURES = {"l_quantity": (0.4, 50.0), "l_linenumber": (0.2, 5.0), "l_discount": (0.2, 0.1), "l_tax": (0.1, 0.08)}
_CX = "least(1.0, " + " + ".join(f"{w} * least(1.0, {k} / {f})" for k, (w, f) in FEATURES.items()) + " + CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE 0.0 END)"


def decisions(spark, d):
    li = table(spark, d, "lineitem")
    c = sc.complexity(FEATURES, F.col("l_returnflag") == "R", 0.1)
    tier = sc.banded(F.round(c, 6), ((0.66, "frontier"), (0.33, "mid"), (0.0, "local")))
    return li.select("l_orderkey", "l_linenumber", F.round(c, 6).alias("c"), F.col("l_tax").alias("h"), tier.alias("tier"))


def p10(spark, d):
    return decisions(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("c"), 5).alias("mean"))


register("p10_routing", p10, f"SELECT CASE WHEN c >= 0.66 THEN 'frontier' WHEN c >= 0.33 THEN 'mid' ELSE 'local' END AS tier, count(*) AS n, round(avg(c), 5) AS mean FROM (SELECT round({_CX}, 6) AS c FROM lineitem) GROUP BY 1")


def a23(spark, d):
    dec = decisions(spark, d).withColumn("tier", F.when(F.col("l_orderkey") % 2 == 0, "frontier").otherwise("local"))
    return sc.audit_routing(dec).groupBy("issue").agg(F.count("*").alias("n"))


register("a23_routing_audit", a23, f"SELECT issue, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 2 = 0 AND c < 0.25 AND h < 0.15 THEN 'wasteful_frontier' WHEN l_orderkey % 2 <> 0 AND (c > 0.70 OR h > 0.45) THEN 'fragile_local' END AS issue FROM (SELECT l_orderkey, round({_CX}, 6) AS c, l_tax AS h FROM lineitem)) WHERE issue IS NOT NULL GROUP BY 1")

# ---- milestones and boards from orders
ISSUE = ["concat('M', o_custkey % 40) AS milestone", "o_orderkey AS number", "o_orderstatus = 'O' AS is_open", "o_orderdate AS created_at", "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 20 DAYS END AS closed_at", "array(CASE WHEN o_orderkey % 9 = 0 THEN 'priority/p0' ELSE 'type/bug' END, CASE WHEN o_orderkey % 17 = 0 THEN 'epic' ELSE 'x' END) AS labels"]
_ISSUES = "WITH issues AS (SELECT concat('M', o_custkey % 40) AS milestone, o_orderkey AS number, o_orderstatus = 'O' AS is_open, o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 20 DAYS END AS closed_at, [CASE WHEN o_orderkey % 9 = 0 THEN 'priority/p0' ELSE 'type/bug' END, CASE WHEN o_orderkey % 17 = 0 THEN 'epic' ELSE 'x' END] AS labels FROM orders)"
AS_OF = "1998-07-01 00:00:00"


def issues(spark, d):
    return table(spark, d, "orders").selectExpr(*ISSUE)


def a5_rows(spark, d):
    return sc.milestone_metrics(issues(spark, d), F.lit(AS_OF), 90.0)


_A5 = f"""{_ISSUES}, g AS (SELECT milestone, count(*) AS total, count(*) FILTER (is_open) AS open, count(*) FILTER (epoch(created_at) >= epoch(TIMESTAMP '{AS_OF}') - 90 * 86400.0) / 90.0 AS scope, count(*) FILTER (epoch(closed_at) >= epoch(TIMESTAMP '{AS_OF}') - 90 * 86400.0) / 90.0 AS burn FROM issues GROUP BY 1),
m AS (SELECT milestone, total, open, total - open AS closed, round((total - open) / total, 4) AS completion, round(scope, 2) AS scope_velocity, round(burn, 2) AS burn_velocity, round(burn / greatest(scope, 0.01), 2) AS convergence_ratio, CASE WHEN open = 0 THEN 0.0 WHEN burn - scope > 0.05 THEN round(open / (burn - scope), 1) END AS days_to_convergence, open > 0 AND burn - scope <= 0.05 AS live_locked FROM g)"""
register("a5_milestones", a5_rows, f"{_A5} SELECT * FROM m")


def a6(spark, d):
    a = sc.milestone_findings(a5_rows(spark, d), "AIR_LOCKED").groupBy("rule_id", "level").agg(F.count("*").alias("n"))
    b = sc.airlock_findings(issues(spark, d), "AIR_LOCKED", ["priority/p0"]).groupBy("rule_id", "level").agg(F.count("*").alias("n"))
    return a.unionByName(b)


register(
    "a6_milestone_rules",
    a6,
    f"""{_A5}, f AS (SELECT 'MLS001' AS rule_id, CASE WHEN live_locked THEN 'error' ELSE 'warning' END AS level FROM m WHERE open > 0 AND (live_locked OR convergence_ratio < 1.0) UNION ALL SELECT 'MLS003', CASE WHEN total > 100 THEN 'error' ELSE 'warning' END FROM m WHERE total > 50
UNION ALL SELECT 'MLS004', 'warning' FROM m WHERE open >= 15 AND completion BETWEEN 0.70 AND 0.90 UNION ALL SELECT 'MLS002', 'error' FROM issues WHERE is_open AND NOT list_contains(labels, 'priority/p0')) SELECT rule_id, level, count(*) AS n FROM f GROUP BY 1, 2""",
)


def a7(spark, d):
    return sc.rollover(issues(spark, d), "NEXT", ["priority/p0", "epic"])


register("a7_rollover", a7, f"{_ISSUES} SELECT number, list_has_any(labels, ['priority/p0', 'epic']) AS kept, CASE WHEN list_has_any(labels, ['priority/p0', 'epic']) THEN milestone ELSE 'NEXT' END AS milestone FROM issues WHERE is_open")

ITEM = [
    "o_custkey % 20 AS board", "o_orderkey AS number", "CASE WHEN o_orderkey % 4 = 0 THEN 'pull_request' ELSE 'issue' END AS kind",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'P0_CRITICAL' WHEN '2-HIGH' THEN 'P1_HIGH' WHEN '3-MEDIUM' THEN 'P2_MEDIUM' ELSE 'P3_LOW' END AS priority",
    "array(CASE WHEN o_orderkey % 3 = 0 THEN 'type/bug' ELSE 'other' END, CASE WHEN o_orderkey % 10 = 0 THEN 'Type/Security' ELSE 'performance' END) AS labels",
    "CASE WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderkey % 2 = 0 THEN 'READY' ELSE 'BACKLOG' END AS state", "array(o_orderkey + 1, o_orderkey + 2) AS depends_on",
    "cast(o_orderkey % 3 AS INT) AS n_blocks", "o_orderkey % 8 <> 0 AS checks_passing", "cast(o_orderkey % 5 AS INT) AS threads", "cast(o_custkey % 9 AS INT) AS business_value", "cast(o_custkey % 6 AS INT) AS effort_points",
    "cast(o_orderkey % 30 AS DOUBLE) AS age_days", "CASE WHEN o_orderkey % 13 = 0 THEN 'waiting' END AS blocked_reason",
]
_ITEMS = "WITH items AS (SELECT " + ", ".join(ITEM).replace("array(", "list_value(") + " FROM orders), held AS (SELECT DISTINCT number FROM (SELECT number, unnest(depends_on) AS dep FROM items) n WHERE EXISTS (SELECT 1 FROM items i WHERE i.number = n.dep AND i.state <> 'DONE'))"
_SCORED = f"""{_ITEMS}, scored AS (SELECT i.*, h.number IS NOT NULL AS is_blocked, round((CASE priority WHEN 'P0_CRITICAL' THEN 1000.0 WHEN 'P1_HIGH' THEN 500.0 WHEN 'P2_MEDIUM' THEN 200.0 WHEN 'P3_LOW' THEN 50.0 ELSE 200.0 END
+ list_sum(list_transform(labels, lambda x: CASE lower(x) WHEN 'type/security' THEN 400.0 WHEN 'type/bug' THEN 250.0 WHEN 'performance' THEN 150.0 ELSE 0.0 END)) + 150.0 * n_blocks + CASE WHEN kind = 'pull_request' THEN 300.0 + CASE WHEN checks_passing THEN 0.0 ELSE 250.0 END + 50.0 * threads ELSE 0.0 END
+ 25.0 * business_value / greatest(effort_points, 1) + least(12.0 * age_days, 200.0))::DOUBLE * CASE WHEN h.number IS NULL THEN 1.0 ELSE 0.2 END, 2) AS score FROM items i LEFT JOIN held h ON i.number = h.number)"""


def items(spark, d):
    return table(spark, d, "orders").selectExpr(*ITEM)


def j6(spark, d):
    return sc.blocked(items(spark, d))


register("j6_blocked", j6, f"{_ITEMS} SELECT number FROM held")


def k1(spark, d):
    return sc.prioritise(items(spark, d)).select("number", "score", "is_blocked")


register("k1_priority", k1, f"{_SCORED} SELECT number, score, is_blocked FROM scored")


def k2(spark, d):
    return sc.next_action(sc.prioritise(items(spark, d)), ["board"])


register(
    "k2_next_action",
    k2,
    f"""{_SCORED}, t AS (SELECT *, CASE WHEN kind = 'pull_request' AND state <> 'DONE' AND (NOT checks_passing OR threads > 0) THEN 0 WHEN kind = 'issue' AND state IN ('READY', 'BACKLOG') AND blocked_reason IS NULL AND NOT is_blocked THEN 1 WHEN blocked_reason IS NULL THEN 2 END AS tier FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY tier, score DESC, number) AS k FROM t WHERE tier IS NOT NULL) SELECT board, number, score, CASE WHEN tier = 2 THEN 'PROGRESS_ITEM' WHEN tier = 1 THEN 'IMPLEMENT_ISSUE' WHEN NOT checks_passing THEN 'REMEDIATE_PR_CHECKS' ELSE 'RESOLVE_REVIEW_THREADS' END AS action FROM r WHERE k = 1""",
)


def k3(spark, d):
    s = sc.prioritise(items(spark, d))
    return sc.promote_top(s, ["board"]).filter("state = 'IN_PROGRESS'").select("board", "number", F.lit("promoted").alias("what")).unionByName(sc.deferred(s).select("board", "number", F.lit("deferred").alias("what")))


register(
    "k3_promote_deferred",
    k3,
    f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY score DESC, number) AS k FROM scored WHERE kind = 'issue' AND state IN ('READY', 'BACKLOG') AND blocked_reason IS NULL AND NOT is_blocked)
SELECT board, number, 'promoted' AS what FROM r WHERE k = 1 UNION ALL SELECT board, number, 'deferred' FROM scored WHERE kind = 'issue' AND state IN ('READY', 'BACKLOG') AND blocked_reason IS NOT NULL""",
)

# ---- repository facts from customers
FACT = [
    "c_name AS repo", "cast(c_acctbal * 2 AS BIGINT) AS stars", "c_custkey % 4 AS releases", "TIMESTAMP '2015-01-01 00:00:00' + make_interval(0, 0, 0, cast(c_custkey % 3000 AS INT)) AS created_at", "TIMESTAMP '2023-01-01 00:00:00' + make_interval(0, 0, 0, cast(c_custkey % 700 AS INT)) AS pushed_at",
    "CASE WHEN c_custkey % 4 > 1 THEN TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(c_custkey % 400 AS INT)) END AS latest_release_at", "TIMESTAMP '2025-01-01 00:00:00' AS fetched_at", "c_custkey % 50 = 0 AS archived", "CASE WHEN c_custkey % 3 = 0 THEN 'MIT' END AS license", "CASE WHEN c_custkey % 97 = 0 THEN 'not found' END AS error",
]


def facts(spark, d):
    # SQL's cast to an integer rounds, ties to even; Spark's cuts
    return table(spark, d, "customer").selectExpr(*[x.replace("cast(c_acctbal * 2 AS BIGINT)", "cast(rint(c_acctbal * 2) AS BIGINT)") for x in FACT])


def a10(spark, d):
    m = sc.maturity(facts(spark, d))
    return m.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("mean"))


def _dk(x, now, h):
    return f"coalesce(greatest(0.0, least(1.0, 1.0 - (epoch({now}) - epoch({x})) / 86400.0 / {h})), 0.0)"


_FACTS = "WITH facts AS (SELECT " + ", ".join(FACT).replace("make_interval(0, 0, 0, cast(", "to_days(cast(") + " FROM customer)"
_MAT = f"""{_FACTS}, m AS (SELECT repo, error, 100.0 * (0.30 * {_dk('pushed_at', 'fetched_at', 730.0)} + 0.25 * CASE WHEN releases <= 0 THEN 0.0 ELSE 0.4 + 0.6 * {_dk('latest_release_at', 'fetched_at', 540.0)} END + 0.20 * CASE WHEN archived THEN 0.0 WHEN license IS NOT NULL THEN 1.0 ELSE 0.4 END
+ 0.15 * greatest(0.0, least(1.0, (epoch(fetched_at) - epoch(created_at)) / (86400.0 * 365.25) / 5.0)) + 0.10 * CASE WHEN stars <= 0 THEN 0.0 ELSE least(1.0, log10(stars + 1) / log10(20000.0)) END)::DOUBLE AS s FROM facts)"""
register("a10_maturity", a10, f"{_MAT} SELECT CASE WHEN error IS NOT NULL THEN 'Unknown' WHEN s >= 75 THEN 'Mature' WHEN s >= 55 THEN 'Established' WHEN s >= 35 THEN 'Active' WHEN s >= 15 THEN 'Emerging' ELSE 'Dormant' END AS band, count(*) AS n, round(avg(CASE WHEN error IS NULL THEN round(s, 1) ELSE 0.0 END), 1) AS mean FROM m GROUP BY 1")


def a11(spark, d):
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    t = l.selectExpr("source", "quality AS dai_good", "1 AS dai_all", "toxic AS ifi_bad", "1 AS ifi_all", "cast(doc_id % 2 AS INT) AS cim_good", "1 AS cim_all", "CASE WHEN doc_id % 61 = 0 THEN 'AX001' END AS rule_id")
    a = sc.ax_score(t, ["source"])
    return a.select("source", F.round("ax", 6).alias("ax"), "passes")


register("a11_ax_score", a11, "SELECT source, round(ax, 6) + 0.0 AS ax, ax >= 0.7 AND NOT hard AS passes FROM (SELECT source, 0.4::DOUBLE * sum(quality) / count(*) + 0.3::DOUBLE * (1 - sum(toxic) / count(*)) + 0.3::DOUBLE * sum(doc_id % 2) / count(*) AS ax, bool_or(doc_id % 61 = 0) AS hard FROM labels JOIN documents USING (doc_id) GROUP BY 1)")


def a13(spark, d):
    docs = table(spark, d, "documents")
    pillars = docs.select(F.col("lang").alias("pillar")).distinct().unionByName(spark.createDataFrame([("unmeasured",)], "pillar string"))
    found = docs.groupBy(F.col("lang").alias("pillar")).agg(F.count_if(F.col("text").contains("!!") & (F.col("lang") == "en")).alias("findings"))
    return sc.certify(pillars, found)


register(
    "a13_certify",
    a13,
    "WITH f AS (SELECT lang AS pillar, count(*) FILTER (contains(text, '!!') AND lang = 'en') = 0 AS ok FROM documents GROUP BY 1 UNION ALL SELECT 'unmeasured', false) SELECT bool_and(ok) AS certified, avg(CASE WHEN ok THEN 100.0 ELSE 0.0 END)::DOUBLE AS score, sha256(string_agg(concat(pillar, '=', ok), ',' ORDER BY pillar)) AS digest FROM f",
)

QUALITY = ["doc_id AS key", "CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END AS complexity", "CASE WHEN contains(text, '@') THEN 1 ELSE 0 END AS sanitisation", "cast(CASE WHEN doc_id % 20 = 0 THEN doc_id % 3 ELSE 0 END AS INT) AS failures", "CASE WHEN contains(text, '|') THEN 2 ELSE 0 END AS warnings", "80.0 AS baseline"]
_QUALITY = "WITH q AS (SELECT " + ", ".join(QUALITY) + " FROM documents), s AS (SELECT *, least(100.0, greatest(0.0, 100.0 - 20.0 * complexity - 15.0 * sanitisation - CASE WHEN failures > 0 THEN greatest(25.0 * failures, 30.0) ELSE 0.0 END - 5.0 * warnings))::DOUBLE AS score FROM q)"


def a14(spark, d):
    q = sc.quality(table(spark, d, "documents").selectExpr(*QUALITY))
    return q.select("key", "score", "health", F.col("delta").cast("double").alias("delta"))


register("a14_quality", a14, f"{_QUALITY} SELECT key, score, CASE WHEN failures > 0 OR score < 50 THEN 'CRITICAL' WHEN score < 90 THEN 'NEEDS_REMEDIATION' ELSE 'HEALTHY' END AS health, score - 80.0::DOUBLE AS delta FROM s")


def a15(spark, d):
    return sc.feedback(table(spark, d, "documents").selectExpr(*QUALITY))


register(
    "a15_feedback",
    a15,
    f"""{_QUALITY} SELECT key, 0 AS rank, 'HIGH' AS priority, 'tests' AS category FROM q WHERE failures > 0 UNION ALL SELECT key, 0, 'HIGH', 'sanitisation' FROM q WHERE sanitisation > 0 UNION ALL SELECT key, 1, 'MEDIUM', 'complexity' FROM q WHERE complexity > 0
UNION ALL SELECT key, 2, 'LOW', 'headroom' FROM q WHERE warnings > 0 UNION ALL SELECT key, 3, 'INFO', 'elevate' FROM q WHERE failures + sanitisation + complexity + warnings = 0""",
)


def a16(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("trace_id"), (F.col("ts").cast("timestamp").cast("double") * 1000).alias("start_ms"), (F.col("ts").cast("timestamp").cast("double") * 1000 + F.col("value")).alias("end_ms"), F.create_map(F.lit("gen_ai.usage.input_tokens"), F.get_json_object("props", "$.k"), F.lit("gen_ai.usage.output_tokens"), (F.col("event_id") % 7).cast("string")).alias("attributes"))
    return sc.trace_rollup(e).select("trace_id", F.round("duration_ms", 0).alias("duration_ms"), "tokens_in", "tokens_out", "tokens", "spans")


register("a16_trace_rollup", a16, "SELECT user_id::VARCHAR AS trace_id, round(max(epoch_us(ts) / 1000.0 + value) - min(epoch_us(ts) / 1000.0), 0) AS duration_ms, sum((props->>'k')::BIGINT)::BIGINT AS tokens_in, sum(event_id % 7)::BIGINT AS tokens_out, (sum((props->>'k')::BIGINT) + sum(event_id % 7))::BIGINT AS tokens, count(*) AS spans FROM events GROUP BY 1")


def a19(spark, d):
    return sc.containment(table(spark, d, "events").select("user_id", (F.col("event_type") != "view").alias("blocked")), ["user_id"]).select("user_id", F.round("rate", 6).alias("rate"), "contained")


register("a19_containment", a19, "SELECT user_id, round(avg((event_type <> 'view')::INT), 6) AS rate, bool_and(event_type <> 'view') AS contained FROM events GROUP BY 1")


def a20(spark, d):
    l = table(spark, d, "labels").selectExpr("quality", "toxic AS violations")
    return sc.resilience(l, ["quality"]).select("quality", F.round("resilience", 6).alias("resilience"), "violations")


register("a20_resilience", a20, "SELECT quality, round(count(*) FILTER (toxic = 0) / count(*), 6) AS resilience, sum(toxic)::BIGINT AS violations FROM labels GROUP BY 1")


def a21(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("declared"), F.collect_set(F.when(F.col("l_linenumber") > 1, F.col("l_suppkey"))).alias("returned"), F.collect_set("l_partkey").alias("arguments"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("allowed"))
    pairs = li.withColumnRenamed("l_orderkey", "id").withColumn("content", F.col("id").cast("string")).withColumn("sent_hash", F.sha2(F.when(F.col("id") % 11 == 0, F.lit("x")).otherwise(F.col("id").cast("string")), 256))
    return sc.handshake(pairs)


register(
    "a21_handshake",
    a21,
    """WITH g AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey) AS d, list(DISTINCT l_suppkey) FILTER (l_linenumber > 1) AS r, list(DISTINCT l_partkey) AS a, list(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') AS o FROM lineitem GROUP BY 1)
SELECT id, round(least(1.0, (len(list_filter(d, lambda x: NOT coalesce(list_contains(r, x), false))) + len(list_filter(a, lambda x: NOT coalesce(list_contains(o, x), false)))) / greatest(len(d), 1)), 4) AS loss, id % 11 = 0 AS tampered FROM g""",
)

# ---- service levels from events per day
OBJECTIVES = [("availability", 0.75, 20, 5), ("conversion", 0.30, 20, 5), ("strict", 1.0, 20, 1), ("loose", 0.01, 20, 1)]
_OBJ = ", ".join(f"('{s}', {t}::DOUBLE, {w}, {m})" for s, t, w, m in OBJECTIVES)


def history(spark, d):
    e = table(spark, d, "events").withColumn("iteration", F.date_format("ts", "yyyy-MM-dd HH"))
    kind = F.col("event_type")
    return sc.measure(e, ["iteration"], {"availability": (kind != "error", F.lit(True)), "conversion": (kind == "purchase", kind.isin("purchase", "click")), "strict": (kind != "error", F.lit(True)), "loose": (kind != "none", F.lit(True))})


def n5(spark, d):
    return history(spark, d)


_HIST = "WITH h AS (SELECT strftime(ts, '%Y-%m-%d %H') AS iteration, count(*) FILTER (event_type <> 'error') AS a, count(*) AS v, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type IN ('purchase', 'click')) AS pc FROM events GROUP BY 1), m AS (SELECT iteration, 'availability' AS sli, a AS good, v AS valid FROM h UNION ALL SELECT iteration, 'conversion', p, pc FROM h UNION ALL SELECT iteration, 'strict', a, v FROM h UNION ALL SELECT iteration, 'loose', v, v FROM h)"
register("n5_measure", n5, f"{_HIST} SELECT iteration, sli, good, valid FROM m")


def s7(spark, d):
    return sc.retain(history(spark, d), "iteration", 30)


register("s7_retention", s7, f"{_HIST} SELECT iteration, sli, good, valid FROM m WHERE iteration IN (SELECT DISTINCT iteration FROM m ORDER BY iteration DESC LIMIT 30)")


def states(spark, d):
    return sc.slo_state(history(spark, d), spark.createDataFrame(OBJECTIVES, "sli string, target double, window int, min_valid int"))


def n4(spark, d):
    s = states(spark, d)
    return s.select("sli", "n", F.round("observed", 6).alias("observed"), F.when(F.col("burn") < 1e9, F.round("burn", 6)).alias("burn"), F.when(F.col("consumed") < 1e9, F.round("consumed", 6)).alias("consumed"), "status")


_STATES = f"""{_HIST}, o AS (SELECT * FROM (VALUES {_OBJ}) o(sli, target, w, min_valid)), st AS (SELECT iteration, row_number() OVER (ORDER BY iteration DESC) AS age FROM (SELECT DISTINCT iteration FROM m)),
s AS (SELECT o.sli, target, w, min_valid, least((SELECT count(*) FROM st), w) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(valid), 0) AS valid FROM o LEFT JOIN (SELECT m.*, age FROM m JOIN st USING (iteration)) x ON x.sli = o.sli AND age <= w GROUP BY ALL),
b AS (SELECT *, CASE WHEN valid = 0 THEN 1.0 ELSE good / valid END AS observed FROM s), c AS (SELECT *, CASE WHEN target >= 1 THEN CASE WHEN observed < 1 THEN 1e300 ELSE 0.0 END ELSE (1 - observed) / (1 - target) END AS burn FROM b),
z AS (SELECT *, burn * n / w AS consumed FROM c), r AS (SELECT *, CASE WHEN valid < min_valid THEN 'INSUFFICIENT_DATA' WHEN consumed >= 1 THEN 'EXHAUSTED' WHEN burn > 2 AND n >= 3 THEN 'BURNING' WHEN n >= w AND consumed <= 0.05 THEN 'UNSPENT' ELSE 'HEALTHY' END AS status FROM z)"""
register("n4_slo_state", n4, f"{_STATES} SELECT sli, n::BIGINT AS n, round(observed, 6) AS observed, CASE WHEN burn < 1e9 THEN round(burn, 6) END AS burn, CASE WHEN consumed < 1e9 THEN round(consumed, 6) END AS consumed, status FROM r")


def n6(spark, d):
    return sc.decide_phase(states(spark, d))


register(
    "n6_phase",
    n6,
    f"{_STATES}, k AS (SELECT *, CASE status WHEN 'EXHAUSTED' THEN 0 WHEN 'BURNING' THEN 1 WHEN 'HEALTHY' THEN 2 WHEN 'INSUFFICIENT_DATA' THEN 3 ELSE 4 END AS p FROM r) SELECT CASE WHEN status IN ('EXHAUSTED', 'BURNING') THEN 'REACTIVE_REMEDIATION' WHEN status = 'UNSPENT' THEN 'OBJECTIVE_REVIEW' ELSE 'PROACTIVE_ELEVATION' END AS phase, CASE WHEN (SELECT bool_and(status = 'UNSPENT') FROM r) THEN 'all objectives' ELSE sli END AS driver FROM k ORDER BY p, burn DESC, sli LIMIT 1",
)
