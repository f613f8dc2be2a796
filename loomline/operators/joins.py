"""Joins that decide: merges, matches, policies and contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compat_series, normal_path, semver
from .findings import canary_leaks


def classify_paths(paths: DataFrame, key: str, path: str, prefixes: DataFrame, default: Column) -> DataFrame:
    """kind and provenance of each path: the longest prefix (whole components) wins, else the default. prefixes: prefix, kind.
    Every path is exploded into its own prefixes, so the match is an equality."""
    parts = F.split(F.col(path), "/")
    own = paths.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    best = own.join(prefixes.select("prefix", "kind"), "prefix").groupBy(key).agg(F.max(F.struct(F.length("prefix").alias("l"), "kind", "prefix")).alias("b"))
    return paths.join(best, key, "left").select(key, F.coalesce("b.kind", default).alias("kind"), F.when(F.col("b").isNotNull(), F.concat(F.lit("declared:"), F.col("b.prefix"))).otherwise("location").alias("provenance"))


def match_titles(items: DataFrame, key: str, title: str, matrix: DataFrame) -> DataFrame:
    """Sizing of each item from matrix (name, size): by the normalised title, else by containment either way where exactly one name fits.
    Containment is an equi-join on pieces of the names and titles, then verified; neither side has a limit."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    a, m = items.select(key, norm(F.col(title)).alias("__t")), matrix.select(norm(F.col("name")).alias("__n"), "size")
    exact = a.join(m, F.col("__t") == F.col("__n")).select(key, "size", F.lit("exact").alias("how"))
    rest = a.join(exact.select(key), key, "left_anti").filter("__t <> ''")
    titles, names = rest.select(F.col("__t").alias("title")).distinct(), m.filter("__n <> ''").select(F.col("__n").alias("name")).distinct()
    inside = canary_leaks(titles, "title", "title", names, "name", "name").unionByName(canary_leaks(names, "name", "name", titles, "title", "title")).distinct()
    near = rest.join(inside, F.col("__t") == F.col("title")).join(m, F.col("name") == F.col("__n"))
    return exact.unionByName(near.groupBy(key).agg(F.count("*").alias("c"), F.max("size").alias("size")).filter("c = 1").select(key, "size", F.lit("contained").alias("how")))


def reconcile_board(existing: DataFrame, current: DataFrame) -> DataFrame:
    """Cards by trimmed title. A defect that the scan no longer has is DONE, or dropped if it was; a roadmap card is judged only if the scan carries any;
    declared fields are refreshed, states kept, new cards appended. existing: title, kind, state, points; current: title, kind, points."""
    has_roadmap = current.agg(F.coalesce(F.bool_or(F.col("kind") == "roadmap"), F.lit(False)).alias("has_roadmap"))
    e = existing.select(F.trim("title").alias("title"), F.col("kind").alias("ek"), F.col("state").alias("es"), F.col("points").alias("ep"))
    c = current.select(F.trim("title").alias("title"), F.col("kind").alias("ck"), F.col("points").alias("cp"))
    j = e.join(c, "title", "full_outer").crossJoin(F.broadcast(has_roadmap))
    gone = F.col("ck").isNull() & ((F.col("ek") == "defect") | ((F.col("ek") == "roadmap") & F.col("has_roadmap")))
    change = F.when(F.col("ek").isNull(), "opened").when(gone & (F.col("es") == "DONE"), "dropped").when(gone, "closed").when(F.col("ck").isNotNull() & ~F.col("cp").eqNullSafe(F.col("ep")), "refreshed").otherwise("unchanged")
    state = F.when(F.col("ek").isNull(), "BACKLOG").when(gone, "DONE").otherwise(F.col("es"))
    return j.select("title", F.coalesce("ck", "ek").alias("kind"), state.alias("state"), F.coalesce("cp", "ep").alias("points"), change.alias("change")).filter("change <> 'dropped'")


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Three-way merge by key: key, outcome (ours, theirs, same, deleted, collision) and side (whose row to take). A missing row is a deletion."""
    mark = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != key])), 256).alias(n))
    j = mark(base, "b").join(mark(ours, "o"), key, "full_outer").join(mark(theirs, "t"), key, "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    side = F.when(o.eqNullSafe(t) | t.eqNullSafe(b), "ours").when(o.eqNullSafe(b), "theirs").otherwise("collision")
    value = F.when(side == "ours", o).when(side == "theirs", t)
    return j.select(key, side.alias("side"), F.when(side == "collision", "collision").when(value.isNull(), "deleted").when(value.eqNullSafe(b), "same").otherwise("changed").alias("outcome"))


def dangling(edges: DataFrame, nodes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Edges of the kinds whose target is no node. edges: src, dst, kind; nodes: id."""
    return edges.filter(F.col("kind").isin(*kinds)).join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


def arity_mismatch(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls with too few or too many arguments. The callee is found by id, else by its name if only one node has it.
    calls: call_id, target, args; nodes: id, name, required, total, varargs."""
    unique = nodes.withColumn("__c", F.count("*").over(Window.partitionBy("name"))).filter("__c = 1")
    by_id = calls.join(nodes.select(F.col("id").alias("target"), "required", "total", "varargs"), "target")
    rest = calls.join(nodes.select(F.col("id").alias("target")), "target", "left_anti")
    by_name = rest.join(unique.select(F.col("name").alias("target"), "required", "total", "varargs"), "target")
    return by_id.unionByName(by_name).filter("args < required or (args > total and not varargs)").select("call_id", "target", F.when(F.col("args") < F.col("required"), "too_few").otherwise("too_many").alias("issue"))


def invalidated(leashes: DataFrame, modified: DataFrame) -> DataFrame:
    """Defects whose perimeter holds a modified file. leashes: defect, files; modified: file."""
    return leashes.select("defect", F.explode("files").alias("file")).join(modified.select("file"), "file", "left_semi").select("defect").distinct()


def find_gaps(ours: DataFrame, others: DataFrame) -> DataFrame:
    """Features that others cite and ours lacks: holders, evidence and the cheapest disposition, best first.
    ours: feature; others: holder, feature, evidence, disposition (integrate, adopt, build)."""
    rank = F.when(F.col("disposition") == "integrate", 0).when(F.col("disposition") == "adopt", 1).otherwise(2)
    g = others.join(ours.select("feature"), "feature", "left_anti").groupBy("feature").agg(F.countDistinct("holder").alias("holders"), F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"), F.min(rank).alias("r"))
    return g.select("feature", "holders", "evidence", F.element_at(F.array(F.lit("integrate"), F.lit("adopt"), F.lit("build")), F.col("r") + 1).alias("disposition"), "r").orderBy("r", F.desc("holders"), "feature").drop("r")


def unmigrated(deprecated: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of deprecated symbols outside the file that declares them. deprecated: symbol, file; calls: symbol, caller_file."""
    return calls.join(deprecated.select("symbol", F.col("file").alias("declared_in")), "symbol").filter("caller_file <> declared_in")


def migrate_args(calls: DataFrame, args: str, renames: Mapping[str, str], to_list: Sequence[str] = ()) -> DataFrame:
    """An argument map with legacy keys renamed (a present new key wins), values of to_list keys bracketed, and warnings."""
    a = F.col(args)
    old_keys = F.array(*map(F.lit, renames))
    name = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in renames.items() for x in p]), k), k)
    keep = F.filter(F.map_entries(a), lambda e: ~(F.array_contains(old_keys, e["key"]) & F.map_contains_key(a, name(e["key"]))))
    value = lambda e: F.when(name(e["key"]).isin(*to_list), F.concat(F.lit("["), e["value"], F.lit("]"))).otherwise(e["value"]) if to_list else e["value"]
    moved = F.map_from_entries(F.transform(keep, lambda e: F.struct(name(e["key"]).alias("key"), value(e).alias("value"))))
    return calls.withColumn("warnings", F.transform(F.filter(F.map_keys(a), lambda k: F.array_contains(old_keys, k)), lambda k: F.concat(F.lit("renamed "), k, F.lit(" to "), name(k)))).withColumn(args, moved)


def validate_spans(spans: DataFrame, types: DataFrame, attributes: DataFrame) -> DataFrame:
    """Findings on attribute maps: span_id, issue, subject. spans: span_id, span_type, kind, attributes; types: span_type, kind, required (array);
    attributes: name, type (string, int, bool), replaced_by (null if current), allowed (array, null for any)."""
    s = spans.join(types.withColumnRenamed("kind", "want"), "span_type", "left")
    of_span = F.array(
        F.when(F.col("want").isNull(), F.struct(F.lit("unknown_type").alias("issue"), F.col("span_type").alias("subject"))),
        F.when(F.col("want") != F.col("kind"), F.struct(F.lit("wrong_kind").alias("issue"), F.col("kind").alias("subject"))),
    )
    missing = F.transform(F.filter(F.coalesce("required", F.array().cast("array<string>")), lambda r: ~F.map_contains_key("attributes", r)), lambda r: F.struct(F.lit("missing").alias("issue"), r.alias("subject")))
    first = s.select("span_id", F.explode(F.concat(F.filter(of_span, lambda x: x.isNotNull()), missing)).alias("f")).select("span_id", "f.*")
    each = spans.select("span_id", F.explode("attributes").alias("name", "value")).join(attributes, "name", "left")
    bad_type = ((F.col("type") == "int") & ~F.col("value").rlike(r"^-?\d+$")) | ((F.col("type") == "bool") & ~F.col("value").isin("true", "false"))
    issue = F.when(F.col("type").isNull(), "unknown_attribute").when(F.col("replaced_by").isNotNull(), "deprecated").when(bad_type, "wrong_type").when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("value")), "undeclared_value")
    return first.unionByName(each.select("span_id", issue.alias("issue"), F.col("name").alias("subject")).filter("issue is not null"))


def validate_calls(calls: DataFrame, contract: DataFrame) -> DataFrame:
    """Findings on call arguments: call_id, issue, param. calls: call_id, tool, args map<string,string>;
    contract: tool, param, type, required, max_len, low, high. A wrong type stops further checks of that parameter."""
    tools = contract.select("tool").distinct()
    unknown = calls.join(tools, "tool", "left_anti").select("call_id", F.lit("unknown_tool").alias("issue"), F.col("tool").alias("param"))
    known = calls.join(tools, "tool", "left_semi")
    given = known.select("call_id", "tool", F.explode("args").alias("param", "value"))
    wrong = (F.col("type") == "int") & ~F.col("value").rlike(r"^-?\d+$")
    number = F.col("value").try_cast("double")
    issue = F.when(F.col("type").isNull(), "extra").when(wrong, "type").when(F.length("value") > F.col("max_len"), "too_long").when((F.col("type") == "int") & ((number < F.col("low")) | (number > F.col("high"))), "range")
    judged = given.join(contract, ["tool", "param"], "left").select("call_id", issue.alias("issue"), "param").filter("issue is not null")
    missing = known.select("call_id", "tool").join(contract.filter("required").select("tool", "param"), "tool").join(given.select("call_id", "param"), ["call_id", "param"], "left_anti").select("call_id", F.lit("missing").alias("issue"), "param")
    return unknown.unionByName(judged).unionByName(missing)


def audit_inventory(deps: DataFrame, facts: DataFrame) -> DataFrame:
    """Drift of declared dependencies: name, risk, severity. deps: name, floor, ref, url; facts: name, latest, archived, band."""
    j = deps.join(facts, "name", "left")
    rules = F.array(
        F.when(compat_series(F.col("floor")) != compat_series(F.col("latest")), F.struct(F.lit("stale_floor").alias("risk"), F.lit("medium").alias("severity"))),
        F.when(F.col("ref").isin("main", "master", "latest"), F.struct(F.lit("mutable_ref").alias("risk"), F.lit("high").alias("severity"))),
        F.when(F.col("floor").isNull(), F.struct(F.lit("unpinned").alias("risk"), F.lit("medium").alias("severity"))),
        F.when(F.col("url").startswith("http://"), F.struct(F.lit("plaintext").alias("risk"), F.lit("high").alias("severity"))),
        F.when(F.col("archived"), F.struct(F.lit("archived").alias("risk"), F.lit("high").alias("severity"))).when(F.col("band") == "Dormant", F.struct(F.lit("dormant").alias("risk"), F.lit("medium").alias("severity"))),
    )
    return j.select("name", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("name", "r.risk", "r.severity")


def untested(modules: DataFrame, tests: DataFrame, reachable: DataFrame) -> DataFrame:
    """Modules with neither a test of their name nor a way from a test. modules: name; tests: name (without test_); reachable: name."""
    return modules.join(tests.select("name"), "name", "left_anti").join(reachable.select("name"), "name", "left_anti")


def expand_groups(spans: DataFrame, groups: DataFrame) -> DataFrame:
    """Attributes of each span with referenced groups inlined: span, attribute, level. A later direct entry overrides only if it states a level; unknown groups give an 'unknown group' row.
    spans: span, pos, ref (group or null), attribute, level; groups: ref, gpos, attribute, level."""
    g = groups.select("ref", "gpos", F.col("attribute").alias("ga"), F.col("level").alias("gl"))
    direct = spans.filter("ref is null").select("span", "pos", F.lit(0).alias("gpos"), "attribute", "level")
    inlined = spans.filter("ref is not null").join(g, "ref").select("span", "pos", "gpos", F.col("ga").alias("attribute"), F.col("gl").alias("level"))
    lost = spans.filter("ref is not null").join(g.select("ref").distinct(), "ref", "left_anti").select("span", F.col("ref").alias("attribute"), F.lit("unknown group").alias("level"))
    last = direct.unionByName(inlined).groupBy("span", "attribute").agg(F.max_by("level", F.when(F.col("level").isNotNull(), F.struct("pos", "gpos"))).alias("level"))
    return last.unionByName(lost)


def audit_lifecycle(records: DataFrame, version: str) -> DataFrame:
    """Findings on deprecations and flags: name, issue. records: name, since, removal, warns, state, flag_expires."""
    now = semver(F.lit(version))
    gone = F.col("state") == "REMOVED"
    rules = F.array(
        F.when(F.col("since").isNull() | F.col("removal").isNull(), "missing_metadata"),
        F.when(~gone & (semver(F.col("removal")) <= now), "overdue"),
        F.when((semver(F.col("removal"))["minor"] != 0) | (semver(F.col("removal"))["patch"] != 0), "non_major_removal"),
        F.when(~gone & ~F.col("warns"), "silent"),
        F.when(~gone & (semver(F.col("flag_expires")) <= now), "expired_flag"),
    )
    return records.select("name", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("issue"))


def reconcile(left: DataFrame, right: DataFrame, key: str, tolerance: float, unit: str = "currency") -> DataFrame:
    """Discrepancy of invoices (key, period, amount) and payments (key, paid): key, period, amount, paid, difference, resolved."""
    j = left.join(right, key, "full_outer")
    diff = F.coalesce("amount", F.lit(0.0)) - F.coalesce("paid", F.lit(0.0))
    bound = F.lit(tolerance) if unit == "currency" else F.lit(tolerance / 100.0) * F.abs(F.coalesce("amount", F.lit(0.0)))
    return j.select(key, "period", "amount", "paid", diff.alias("difference"), (F.abs(diff) <= bound).alias("resolved"))


def summarise(reconciled: DataFrame, include_resolved: bool = True) -> DataFrame:
    """Invoices and net difference of each period."""
    rows = reconciled if include_resolved else reconciled.filter("not resolved")
    return rows.groupBy("period").agg(F.count("*").alias("n"), F.sum("difference").alias("difference"), F.count_if("resolved").alias("resolved"))


def outside_address(target: Column, loopback_only: bool) -> Column:
    """Is the target an address that egress may not reach? IPv4 with or without a port, IPv6 with or without brackets; names are no addresses."""
    t = F.trim(target)
    host = F.when(t.rlike(r"^\[[^\]]*\]"), F.regexp_extract(t, r"^\[([^\]]*)\]", 1)).when(F.regexp_count(t, F.lit(":")) == 1, F.split_part(t, F.lit(":"), F.lit(1))).otherwise(t)
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4, v6 = host.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), host.rlike(r"^(?=.*:.*:)[0-9A-Fa-f:.]+$")
    loopback = host.rlike(r"^127\.") | (host == "::1")
    inner = host.rlike(r"^(?:10|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|0)\.|^(?i:f[cd]|fe[89ab])")
    return (v4 | v6) & ~loopback & (F.lit(True) if loopback_only else inner)


def apply_policy(events: DataFrame, allow: Sequence[str], deny: Sequence[str], paths: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None, homes: Sequence[str] = (), loopback_only: bool = True, capabilities: Sequence[str] = ("root", "cap_sys_admin", "cap_net_admin")) -> DataFrame:
    """Verdict of each event, first rule wins: evasion (negative flags, null bytes, climbing paths), then by hook: exec against the deny list with its aliases and the allow list,
    connect against loopback or private addresses, open against sensitive paths by whole components (`~` stands for each home, a relative path matches at any depth),
    setuid and capset against user 0 and capabilities. events: event_id, hook, target and, if there are any, flags and uid."""
    target, names = F.col("target"), set(deny).union(*[(aliases or {}).get(x, ()) for x in deny])
    evasive = target.contains("..//") | target.contains(".../") | target.contains("/..") | target.contains("\\..") | target.contains("../") | target.contains("\u0000") | target.contains("\\0")
    if "flags" in events.columns:
        evasive = evasive | F.coalesce(F.col("flags") < 0, F.lit(False))
    root = F.coalesce(F.col("uid") == 0, F.lit(False)) if "uid" in events.columns else F.lit(False)
    path, sensitive = normal_path(target), F.lit(False)
    for p in dict.fromkeys(x for entry in paths for x in ([h + entry[1:] for h in homes] if entry == "~" or entry.startswith("~/") else [entry])):
        sensitive = sensitive | ((path == p) | path.startswith(p + "/") if p.startswith("/") else F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{p.strip('/')}/"))
    by_hook = {
        "exec": F.when(target.isin(*names), "denied").when((F.trim(target) != "") & ~target.isin(*allow), "not_allowed"),
        "connect": F.when(outside_address(target, loopback_only), "egress"),
        "open": F.when(sensitive, "sensitive_path"),
        "setuid": F.when(root | F.lower(target).isin(*capabilities), "privilege"),
        "capset": F.when(root | F.lower(target).isin(*capabilities), "privilege"),
    }
    rule = F.when(evasive, "evasion")
    for hook, verdict in by_hook.items():
        rule = rule.when((F.col("hook") == hook) & verdict.isNotNull(), verdict)
    rule = rule.otherwise("allow")
    return events.select("event_id", rule.alias("rule"), (rule != "allow").alias("blocked"))
