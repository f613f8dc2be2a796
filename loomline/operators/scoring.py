"""Scorecards, boards and budgets: aggregations that rate groups and rank items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Priority bases, label weights.
BASE_WEIGHTS = {"P0_CRITICAL": 1000.0, "P1_HIGH": 500.0, "P2_MEDIUM": 200.0, "P3_LOW": 50.0}
LABEL_WEIGHTS = {"type/security": 400.0, "type/bug": 250.0, "performance": 150.0, "type/feature": 100.0, "type/docs": 50.0}
# Maturity weights and bands.
SIGNALS = {"recent_activity": 0.30, "release_discipline": 0.25, "governance": 0.20, "longevity": 0.15, "adoption": 0.10}
BANDS = ((75.0, "Mature"), (55.0, "Established"), (35.0, "Active"), (15.0, "Emerging"), (0.0, "Dormant"))


def case_map(key: Column, mapping: Mapping[str, float], default: float | None) -> Column:
    """A value for each key, as one CASE."""
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def banded(value: Column, bands: Sequence[tuple[float, str]]) -> Column:
    """The name of the first band whose floor the value reaches; bands run downwards, the last is the rest."""
    out = F.lit(bands[-1][1])
    for floor, name in reversed(bands[:-1]):
        out = F.when(value >= floor, name).otherwise(out)
    return out


def token_cost(runs: DataFrame, prices: DataFrame, default: tuple[float, float] = (1.0, 3.0)) -> DataFrame:
    """runs (model_id, prompt_tokens, completion_tokens, ...) with cost_usd. Unknown models cost the default per million; local ones nothing; negative tokens count 0."""
    p = prices.select("model_id", "input_usd_per_m", "output_usd_per_m", "is_local")
    joined = runs.join(p, "model_id", "left")
    million = lambda n, price, other: F.greatest(F.lit(0), F.col(n)) / 1e6 * F.coalesce(price, F.lit(other))
    cost = million("prompt_tokens", "input_usd_per_m", default[0]) + million("completion_tokens", "output_usd_per_m", default[1])
    return joined.withColumn("cost_usd", F.when(F.coalesce("is_local", F.lit(False)), 0.0).otherwise(cost)).drop("input_usd_per_m", "output_usd_per_m", "is_local")


def leaderboard(runs: DataFrame) -> DataFrame:
    """Models by composite score. runs: model_id, tests_passed, invariants (0-6), headroom, minimality, cost_usd."""
    g = runs.groupBy("model_id").agg(
        F.count("*").alias("tasks"),
        F.count_if("tests_passed").alias("passed"),
        F.sum("invariants").alias("inv"),
        F.avg(F.col("headroom").cast("double")).alias("headroom_rate"),
        F.avg("minimality").alias("minimality"),
        F.sum("cost_usd").alias("total_cost"),
    )
    g = g.withColumn("pass_rate", 100.0 * F.col("passed") / F.col("tasks")).withColumn("compliance", 100.0 * F.col("inv") / (6 * F.col("tasks")))
    g = g.withColumn("cost_per_task", F.col("total_cost") / F.greatest("passed", F.lit(1))).withColumn("cost_per_invariant", F.col("total_cost") / F.greatest("inv", F.lit(1)))
    efficiency = F.when(F.col("cost_per_invariant") <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 20.0 * F.log10(F.greatest(F.lit(1.0), F.col("cost_per_invariant") * 1e5))))
    g = g.withColumn("composite", F.round(0.35 * F.col("pass_rate") + 0.30 * F.col("compliance") + 20.0 * F.col("minimality") + 0.15 * efficiency, 2))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "model_id")))  # one row a model: a small table


def offload(results: DataFrame, frontier: tuple[float, float]) -> DataFrame:
    """Per group: tokens by role group, actual cost against everything at the frontier price, savings and share offloaded.
    results: grp, is_local, prompt_tokens, completion_tokens, cost_usd, verified."""
    whole = (F.col("prompt_tokens") * frontier[0] + F.col("completion_tokens") * frontier[1]) / 1e6
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    g = results.groupBy("grp").agg(F.sum(F.when(F.col("is_local"), tokens).otherwise(0)).alias("local_tokens"), F.sum(tokens).alias("tokens"), F.sum(whole).alias("hypothetical"), F.sum("cost_usd").alias("actual"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("violated"))
    return g.withColumn("savings", F.greatest(F.lit(0.0), F.col("hypothetical") - F.col("actual"))).withColumn("offload_pct", F.coalesce(F.try_divide(100.0 * F.col("local_tokens"), "tokens"), F.lit(0.0)))


def cascade(runs: DataFrame) -> DataFrame:
    """Draft first: a draft that passes keeps its tier and saves the difference; else both are spent. runs: draft_cost, frontier_cost, draft_passes."""
    ok = F.col("draft_passes")
    return runs.withColumn("tier", F.when(ok, "draft").otherwise("frontier")).withColumn("spent", F.when(ok, F.col("draft_cost")).otherwise(F.col("draft_cost") + F.col("frontier_cost"))).withColumn("saved", F.when(ok, F.greatest(F.col("frontier_cost") - F.col("draft_cost"), F.lit(0.0))).otherwise(0.0))


def complexity(features: Mapping[str, tuple[float, float]], flag: Column, flag_weight: float) -> Column:
    """Weighted sum of saturating features: name -> (weight, value at which it saturates); a flag adds its weight; at most 1."""
    total = F.when(flag, flag_weight).otherwise(0.0)
    for name, (weight, full) in features.items():
        total = total + weight * F.least(F.lit(1.0), F.col(name) / full)
    return F.least(F.lit(1.0), total)


def audit_routing(decisions: DataFrame) -> DataFrame:
    """Wasteful frontier calls (complexity < .25 and entropy < .15) and fragile local ones (complexity > .70 or entropy > .45). decisions: tier, c, h."""
    wasteful = (F.col("tier") == "frontier") & (F.col("c") < 0.25) & (F.col("h") < 0.15)
    fragile = (F.col("tier") == "local") & ((F.col("c") > 0.70) | (F.col("h") > 0.45))
    return decisions.withColumn("issue", F.when(wasteful, "wasteful_frontier").when(fragile, "fragile_local")).filter("issue is not null")


def milestone_metrics(issues: DataFrame, as_of: Column, days: float) -> DataFrame:
    """Open, closed, completion, scope and burn velocity over the trailing days, their ratio, days to convergence, live-lock.
    issues: milestone, is_open, created_at, closed_at. Future dates are inside the window."""
    since = as_of.cast("timestamp").cast("double") - max(days * 86400.0, 1.0)
    inside = lambda c: F.count_if(F.col(c).cast("timestamp").cast("double") >= since) / max(days, 0.1)
    g = issues.groupBy("milestone").agg(F.count("*").alias("total"), F.count_if("is_open").alias("open"), inside("created_at").alias("scope"), inside("closed_at").alias("burn"))
    net = F.col("burn") - F.col("scope")
    return g.select(
        "milestone",
        "total",
        "open",
        (F.col("total") - F.col("open")).alias("closed"),
        F.round((F.col("total") - F.col("open")) / F.col("total"), 4).alias("completion"),
        F.round("scope", 2).alias("scope_velocity"),
        F.round("burn", 2).alias("burn_velocity"),
        F.round(F.col("burn") / F.greatest("scope", F.lit(0.01)), 2).alias("convergence_ratio"),
        F.when(F.col("open") == 0, 0.0).when(net > 0.05, F.round(F.col("open") / net, 1)).alias("days_to_convergence"),
        ((F.col("open") > 0) & (net <= 0.05)).alias("live_locked"),
    )


def milestone_findings(metrics: DataFrame, phase: str, most: int = 50, critical: int = 100, healthy_ratio: float = 1.0) -> DataFrame:
    """Rules over milestone_metrics(): MLS001 convergence, MLS003 sizing, MLS004 stagnant band."""
    strict = phase in ("AIR_LOCKED", "FROZEN")
    some = F.col("open") > 0
    found = F.array(
        F.when(some & F.col("live_locked"), F.struct(F.lit("MLS001").alias("rule_id"), F.lit("error" if strict else "warning").alias("level"))).when(some & (F.col("convergence_ratio") < healthy_ratio), F.struct(F.lit("MLS001").alias("rule_id"), F.lit("warning").alias("level"))),
        F.when(F.col("total") > critical, F.struct(F.lit("MLS003").alias("rule_id"), F.lit("error").alias("level"))).when(F.col("total") > most, F.struct(F.lit("MLS003").alias("rule_id"), F.lit("warning").alias("level"))),
        F.when(some & F.col("completion").between(0.70, 0.90) & (F.col("open") >= 15), F.struct(F.lit("MLS004").alias("rule_id"), F.lit("warning").alias("level"))),
    )
    return metrics.select("milestone", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("milestone", "f.rule_id", "f.level")


def airlock_findings(issues: DataFrame, phase: str, blockers: Sequence[str]) -> DataFrame:
    """MLS002: open issues a restricted phase doesn't admit: any when frozen, those without a blocker label when air-locked. issues: number, is_open, labels."""
    open_ = issues.filter("is_open")
    if phase == "AIR_LOCKED":
        open_ = open_.filter(~F.arrays_overlap("labels", F.array(*map(F.lit, blockers))))
    elif phase != "FROZEN":
        open_ = open_.filter(F.lit(False))
    return open_.select("number", F.lit("MLS002").alias("rule_id"), F.lit("error").alias("level"))


def rollover(issues: DataFrame, target: str, keep: Sequence[str]) -> DataFrame:
    """Open issues with the milestone they go to: those with a label to keep stay. issues: number, milestone, is_open, labels."""
    stays = F.arrays_overlap("labels", F.array(*map(F.lit, keep)))
    return issues.filter("is_open").select("number", F.when(stays, F.col("milestone")).otherwise(target).alias("milestone"), stays.alias("kept"))


def blocked(items: DataFrame, done: str = "DONE") -> DataFrame:
    """Numbers of items with a dependency that exists and isn't done. items: number, state, depends_on."""
    need = items.select("number", F.explode("depends_on").alias("dep"))
    open_ = items.filter(F.col("state") != done).select(F.col("number").alias("dep"))
    return need.join(open_, "dep", "left_semi").select("number").distinct()


def prioritise(items: DataFrame) -> DataFrame:
    """score of each item: base, labels, what it unblocks, pull-request terms, value for effort, age; a fifth of it if blocked.
    items: number, kind, priority, labels, state, depends_on, n_blocks, checks_passing, threads, business_value, effort_points, age_days."""
    labels = F.aggregate("labels", F.lit(0.0), lambda a, x: a + case_map(F.lower(x), LABEL_WEIGHTS, 0.0))
    pull = F.when(F.col("kind") == "pull_request", 300.0 + F.when(F.col("checks_passing"), 0.0).otherwise(250.0) + 50.0 * F.greatest("threads", F.lit(0))).otherwise(0.0)
    score = case_map(F.col("priority"), BASE_WEIGHTS, 200.0) + labels + 150.0 * F.col("n_blocks") + pull + 25.0 * F.col("business_value") / F.greatest("effort_points", F.lit(1)) + F.least(12.0 * F.col("age_days"), F.lit(200.0))
    held = blocked(items).withColumn("is_blocked", F.lit(True))
    scored = items.join(held, "number", "left").withColumn("is_blocked", F.coalesce("is_blocked", F.lit(False)))
    return scored.withColumn("score", F.round(score * F.when(F.col("is_blocked"), 0.2).otherwise(1.0), 2))


def next_action(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """One action a board: the first pull request in trouble by score, else the first unblocked issue, else the first item not held.
    scored: prioritise() with the board's columns and blocked_reason."""
    trouble = (F.col("kind") == "pull_request") & (F.col("state") != "DONE")
    free = (F.col("kind") == "issue") & F.col("state").isin("READY", "BACKLOG") & F.col("blocked_reason").isNull() & ~F.col("is_blocked")
    tier = F.when(trouble & ~F.col("checks_passing"), 0).when(trouble & (F.col("threads") > 0), 0).when(free, 1).when(F.col("blocked_reason").isNull(), 2)
    action = F.when(F.col("tier") == 2, "PROGRESS_ITEM").when(F.col("tier") == 1, "IMPLEMENT_ISSUE").when(~F.col("checks_passing"), "REMEDIATE_PR_CHECKS").otherwise("RESOLVE_REVIEW_THREADS")
    ranked = scored.withColumn("tier", tier).filter("tier is not null").withColumn("action", action)
    return ranked.groupBy(*by).agg(F.min(F.struct("tier", (-F.col("score")).alias("minus"), "number", "action")).alias("m")).select(*by, "m.number", "m.action", (-F.col("m.minus")).alias("score"))


def promote_top(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """The items, the first free one of each board put in progress."""
    free = (F.col("kind") == "issue") & F.col("state").isin("READY", "BACKLOG") & F.col("blocked_reason").isNull() & ~F.col("is_blocked")
    top = scored.filter(free).groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("minus"), "number")).alias("m")).select(*by, F.col("m.number").alias("number"), F.lit(True).alias("__top"))
    return scored.join(top, [*by, "number"], "left").withColumn("state", F.when(F.col("__top"), "IN_PROGRESS").otherwise(F.col("state"))).drop("__top")


def deferred(scored: DataFrame) -> DataFrame:
    """Issues that a recorded blocker holds back."""
    return scored.filter((F.col("kind") == "issue") & F.col("state").isin("READY", "BACKLOG") & F.col("blocked_reason").isNotNull())


def decay(then: Column, now: Column, horizon_days: float) -> Column:
    """1 for just now, falling in a line to 0 at the horizon; 0 for never."""
    age = (now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")) / 86400.0
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - age / horizon_days)), F.lit(0.0))


def maturity(facts: DataFrame) -> DataFrame:
    """score (one decimal) and band. facts: repo, stars, releases, created_at, pushed_at, latest_release_at, fetched_at, archived, license, error."""
    now = F.col("fetched_at")
    years = (now.cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double")) / (86400.0 * 365.25)
    signals = {
        "recent_activity": decay(F.col("pushed_at"), now, 730.0),
        "release_discipline": F.when(F.col("releases") <= 0, 0.0).otherwise(0.4 + 0.6 * decay(F.col("latest_release_at"), now, 540.0)),
        "governance": F.when(F.col("archived"), 0.0).when(F.col("license").isNotNull(), 1.0).otherwise(0.4),
        "longevity": F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), years / 5.0)), F.lit(0.0)),
        "adoption": F.when(F.col("stars") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log10(F.col("stars") + 1) / F.log10(F.lit(20000.0)))),
    }
    # governance is one of three constants: its weighted value is the double next to the decimal product, so that scores on a band's floor are on it
    exact = lambda x: float(Decimal(str(SIGNALS["governance"])) * Decimal(x))
    weighted = {k: SIGNALS[k] * v for k, v in signals.items()}
    weighted["governance"] = F.when(F.col("archived"), 0.0).when(F.col("license").isNotNull(), exact("1")).otherwise(exact("0.4"))
    score = 100.0 * sum(weighted.values(), F.lit(0.0))
    bad = F.col("error").isNotNull()
    return facts.select("repo", F.when(bad, 0.0).otherwise(F.round(score, 1)).alias("score"), F.when(bad, "Unknown").otherwise(banded(score, BANDS)).alias("band"))


def ax_score(telemetry: DataFrame, by: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """.4 DAI + .3 (1 - IFI) + .3 CIM of summed counters; passes from the threshold without an AX001 finding.
    telemetry: dai_good, dai_all, ifi_bad, ifi_all, cim_good, cim_all, rule_id."""
    ratio = lambda a, b, default: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(default))
    g = telemetry.groupBy(*by).agg(ratio("dai_good", "dai_all", 1.0).alias("dai"), ratio("ifi_bad", "ifi_all", 0.0).alias("ifi"), ratio("cim_good", "cim_all", 1.0).alias("cim"), F.coalesce(F.bool_or(F.col("rule_id") == "AX001"), F.lit(False)).alias("hard"))
    g = g.withColumn("ax", 0.4 * F.col("dai") + 0.3 * (1 - F.col("ifi")) + 0.3 * F.col("cim"))
    return g.withColumn("passes", (F.col("ax") >= threshold) & ~F.col("hard"))


def certify(pillars: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: certified iff every pillar was evaluated without findings; score is the mean of 100 and 0; digest names the result.
    pillars: pillar; runs: pillar, findings."""
    each = pillars.join(runs.groupBy("pillar").agg(F.sum("findings").alias("findings")), "pillar", "left").withColumn("ok", F.coalesce(F.col("findings") == 0, F.lit(False)))
    return each.agg(F.bool_and("ok").alias("certified"), F.avg(F.when(F.col("ok"), 100.0).otherwise(0.0)).alias("score"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "pillar", F.col("ok").cast("string")))), ","), 256).alias("digest"))


def quality(rows: DataFrame) -> DataFrame:
    """score 100 - 20 complexity - 15 sanitisation - max(25 failures, 30 if any) - 5 warnings, within 0 to 100, and health.
    rows: key, complexity, sanitisation, failures, warnings, baseline."""
    failed = F.when(F.col("failures") > 0, F.greatest(25.0 * F.col("failures"), F.lit(30.0))).otherwise(0.0)
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - 20.0 * F.col("complexity") - 15.0 * F.col("sanitisation") - failed - 5.0 * F.col("warnings")))
    health = F.when((F.col("failures") > 0) | (score < 50), "CRITICAL").when(score < 90, "NEEDS_REMEDIATION").otherwise("HEALTHY")
    return rows.select("key", score.alias("score"), health.alias("health"), (score - F.col("baseline")).alias("delta"))


def feedback(scored: DataFrame) -> DataFrame:
    """Prioritised feedback rows of quality() results with the counts that led to them: key, priority, category, ordered by rank then key."""
    rows = F.array(
        F.when(F.col("failures") > 0, F.struct(F.lit(0).alias("rank"), F.lit("HIGH").alias("priority"), F.lit("tests").alias("category"))),
        F.when(F.col("sanitisation") > 0, F.struct(F.lit(0).alias("rank"), F.lit("HIGH").alias("priority"), F.lit("sanitisation").alias("category"))),
        F.when(F.col("complexity") > 0, F.struct(F.lit(1).alias("rank"), F.lit("MEDIUM").alias("priority"), F.lit("complexity").alias("category"))),
        F.when(F.col("warnings") > 0, F.struct(F.lit(2).alias("rank"), F.lit("LOW").alias("priority"), F.lit("headroom").alias("category"))),
        F.when((F.col("failures") + F.col("sanitisation") + F.col("complexity") + F.col("warnings")) == 0, F.struct(F.lit(3).alias("rank"), F.lit("INFO").alias("priority"), F.lit("elevate").alias("category"))),
    )
    return scored.select("key", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f")).select("key", "f.rank", "f.priority", "f.category").orderBy("rank", "key", "category")


def trace_rollup(spans: DataFrame, in_key: str = "gen_ai.usage.input_tokens", out_key: str = "gen_ai.usage.output_tokens") -> DataFrame:
    """Duration and tokens of each trace. spans: trace_id, start_ms, end_ms, attributes map<string,string>."""
    number = lambda k: F.coalesce(F.element_at("attributes", F.lit(k)).try_cast("bigint"), F.lit(0))
    g = spans.groupBy("trace_id").agg((F.max("end_ms") - F.min("start_ms")).alias("duration_ms"), F.sum(number(in_key)).alias("tokens_in"), F.sum(number(out_key)).alias("tokens_out"), F.count("*").alias("spans"))
    return g.withColumn("tokens", F.col("tokens_in") + F.col("tokens_out"))


def containment(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share blocked, and whether all were. verdicts: blocked."""
    return verdicts.groupBy(*by).agg(F.avg(F.col("blocked").cast("double")).alias("rate"), F.bool_and("blocked").alias("contained"))


def resilience(evaluations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Clean over total, and violations. evaluations: violations (count)."""
    return evaluations.groupBy(*by).agg((F.count_if(F.col("violations") == 0) / F.count("*")).alias("resilience"), F.sum("violations").alias("violations"))


def handshake(pairs: DataFrame) -> DataFrame:
    """Loss of a handshake: preconditions dropped and arguments undeclared, over those declared, at most 1. pairs: id, declared, returned, arguments, allowed (arrays), sent_hash, content."""
    dropped, extra = F.size(F.array_except("declared", "returned")), F.size(F.array_except("arguments", "allowed"))
    loss = F.least(F.lit(1.0), (dropped + extra) / F.greatest(F.size("declared"), F.lit(1)))
    return pairs.select("id", F.round(loss, 4).alias("loss"), (F.col("sent_hash") != F.sha2("content", 256)).alias("tampered"))


# ---- service levels


def measure(rows: DataFrame, by: Sequence[str], indicators: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Good and valid events of each indicator, long form: by, sli, good, valid. indicators: name -> (good, valid) conditions."""
    counted = rows.groupBy(*by).agg(*[F.struct(F.lit(k).alias("sli"), F.count_if(g).alias("good"), F.count_if(v).alias("valid")).alias(f"__{i}") for i, (k, (g, v)) in enumerate(indicators.items())])
    return counted.select(*by, F.explode(F.array(*[f"__{i}" for i in range(len(indicators))])).alias("m")).select(*by, "m.sli", "m.good", "m.valid")


def retain(ledger: DataFrame, order: str, keep: int = 100) -> DataFrame:
    """The newest `keep` entries. Ranks only the kept prefix in each task before the last step."""
    newest = ledger.select(order).distinct().orderBy(F.desc(order)).limit(keep)
    return ledger.join(F.broadcast(newest), order, "left_semi")


def slo_state(history: DataFrame, objectives: DataFrame, critical_burn: float = 2.0, min_iterations: int = 3, slack: float = 0.05) -> DataFrame:
    """Error-budget state of each objective over its last iterations. history: iteration, sli, good, valid; objectives: sli, target, window, min_valid."""
    iterations = history.select("iteration").distinct()
    n = iterations.agg(F.count("*").alias("n_all"))
    longest = objectives.agg(F.coalesce(F.max("window"), F.lit(0))).first()[0]
    newest = iterations.orderBy(F.desc("iteration")).limit(int(longest))  # as many as the longest window, whatever the history
    steps = newest.withColumn("age", F.row_number().over(Window.orderBy(F.desc("iteration"))))
    inside = history.join(steps, "iteration").join(objectives, "sli").filter("age <= window")
    sums = inside.groupBy("sli").agg(F.sum("good").alias("good"), F.sum("valid").alias("valid"))
    s = objectives.join(sums, "sli", "left").crossJoin(F.broadcast(n)).withColumn("n", F.least("n_all", "window")).fillna(0, ["good", "valid"])
    s = s.withColumn("observed", F.when(F.col("valid") == 0, 1.0).otherwise(F.col("good") / F.col("valid")))
    s = s.withColumn("burn", F.when(F.col("target") >= 1.0, F.when(F.col("observed") < 1.0, F.lit(float("inf"))).otherwise(0.0)).otherwise((1.0 - F.col("observed")) / (1.0 - F.col("target"))))
    s = s.withColumn("consumed", F.col("burn") * F.col("n") / F.col("window"))
    status = F.when(F.col("valid") < F.col("min_valid"), "INSUFFICIENT_DATA").when(F.col("consumed") >= 1.0, "EXHAUSTED").when((F.col("burn") > critical_burn) & (F.col("n") >= min_iterations), "BURNING").when((F.col("n") >= F.col("window")) & (F.col("consumed") <= slack), "UNSPENT").otherwise("HEALTHY")
    return s.withColumn("status", status).select("sli", "n", "observed", "burn", "consumed", "status")


PRECEDENCE = ("EXHAUSTED", "BURNING", "HEALTHY", "INSUFFICIENT_DATA", "UNSPENT")
PHASES = {"EXHAUSTED": "REACTIVE_REMEDIATION", "BURNING": "REACTIVE_REMEDIATION", "UNSPENT": "OBJECTIVE_REVIEW", "HEALTHY": "PROACTIVE_ELEVATION", "INSUFFICIENT_DATA": "PROACTIVE_ELEVATION"}


def decide_phase(states: DataFrame) -> DataFrame:
    """One row: the phase and the objective that drives it. All unspent is a case of its own."""
    rank = case_map(F.col("status"), {s: float(i) for i, s in enumerate(PRECEDENCE)}, 9.0)
    worst = states.agg(F.min(F.struct(rank.alias("r"), (-F.col("burn")).alias("b"), "sli", "status")).alias("w"), F.bool_and(F.col("status") == "UNSPENT").alias("all_unspent"))
    phase = F.lit(None).cast("string")
    for s, p in PHASES.items():
        phase = F.when(F.col("w.status") == s, p).otherwise(phase)
    return worst.select(F.when(F.col("w.sli").isNull(), "PROACTIVE_ELEVATION").otherwise(phase).alias("phase"), F.when(F.col("w.sli").isNull(), "none").when(F.col("all_unspent"), "all objectives").otherwise(F.col("w.sli")).alias("driver"))
