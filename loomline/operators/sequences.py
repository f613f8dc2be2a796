"""Windows over ordered rows, set comparisons and snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import number_rows


def convergence(steps: DataFrame, by: str, order: str) -> DataFrame:
    """Per step: repeat_of (order of the first step with that state), new_rules (against the step before, only if that had any), rising (violations rose twice running).
    steps: by, order, state, rules (array), violations."""
    w = Window.partitionBy(by).orderBy(order)
    first = F.min(order).over(Window.partitionBy(by, "state"))
    before = F.lag("rules").over(w)
    fresh = F.when(F.size(before) > 0, F.array_sort(F.array_except("rules", before))).otherwise(F.array().cast("array<string>"))
    v1, v2 = F.lag("violations", 1).over(w), F.lag("violations", 2).over(w)
    rising = F.coalesce((F.col("violations") > v1) & (v1 > v2), F.lit(False))
    return steps.select(by, order, F.when(first < F.col(order), first).alias("repeat_of"), fresh.alias("new_rules"), rising.alias("rising"))


def trajectory_status(judged: DataFrame, steps: DataFrame, by: str, order: str) -> DataFrame:
    """CONVERGED if the last step has no violation, else DIVERGING, OSCILLATING, REGRESSING or PROGRESSING, the first that holds."""
    last = steps.groupBy(by).agg(F.max_by("violations", order).alias("left"))
    g = judged.groupBy(by).agg(F.bool_or("rising").alias("d"), F.bool_or(F.col("repeat_of").isNotNull()).alias("o"), F.bool_or(F.size("new_rules") > 0).alias("r"))
    return last.join(g, by).select(by, F.when(F.col("left") == 0, "CONVERGED").when(F.col("d"), "DIVERGING").when(F.col("o"), "OSCILLATING").when(F.col("r"), "REGRESSING").otherwise("PROGRESSING").alias("status"))


def accumulate(items: DataFrame, value: str, order: Sequence[str], by: str | None = None) -> DataFrame:
    """Distinct values numbered by first appearance (within `by`), and later recurrences: adds number and repeat."""
    if not order:
        raise ValueError("first appearance needs an order")
    at = F.struct(*order)
    keys = [by] if by else []
    first = items.groupBy(*keys, value).agg(F.min(at).alias("__first"))
    number = first.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("__first", value))) if by else number_rows(first, ["__first", value], "number")
    return items.join(number, [*keys, value]).withColumn("repeat", at > F.col("__first")).drop("__first")


def trend(revisions: DataFrame, by: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Change of each column against the revision before; the first has 0."""
    w = Window.partitionBy(by).orderBy(order)
    return revisions.select(by, order, *[F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0)).alias(f"d_{c}") for c in columns])


def waterfall(spans: DataFrame, width: int = 40) -> DataFrame:
    """Offset and width of each span as fractions of its trace and as characters (1 at least); children are indented. spans: trace, span, parent, start_ms, end_ms."""
    t = Window.partitionBy("trace")
    low = F.min("start_ms").over(t)
    whole = F.max("end_ms").over(t) - low
    offset = F.when(whole > 0, (F.col("start_ms") - low) / whole).otherwise(0.0)
    share = F.when(whole > 0, (F.col("end_ms") - F.col("start_ms")) / whole).otherwise(1.0)
    return spans.select("trace", "span", offset.alias("offset"), share.alias("share"), F.floor(offset * width).cast("int").alias("pad"), F.greatest(F.lit(1), F.floor(share * width).cast("int")).alias("bar"), F.when(F.col("parent").isNotNull(), 2).otherwise(0).alias("indent"))


def dedup_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    if not order:
        raise ValueError("keeping the first needs an order")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def synthesise_allowlist(trace: DataFrame, baseline: Sequence[str], extra: Sequence[str], deny: Sequence[str]) -> DataFrame:
    """Names of (baseline, seen in the trace, extra) without the denied: deny wins. trace: name."""
    fixed = trace.sparkSession.createDataFrame([(x,) for x in (*baseline, *extra)], "name string")
    return trace.select("name").unionByName(fixed).distinct().filter(~F.col("name").isin(*deny))


def diff_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """name and change (added, removed, action) between profiles (name, action)."""
    j = old.select("name", F.col("action").alias("o")).join(new.select("name", F.col("action").alias("n")), "name", "full_outer")
    return j.select("name", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "action").alias("change")).filter("change is not null")


def diff_schemas(old: DataFrame, new: DataFrame, migrated: Sequence[str]) -> DataFrame:
    """Parameters dropped without a migration, and newly required ones: tool, param, issue. old, new: tool, param, required."""
    dropped = old.join(new.select("tool", "param"), ["tool", "param"], "left_anti").filter(~F.col("param").isin(*migrated)).select("tool", "param", F.lit("dropped").alias("issue"))
    demanded = new.filter("required").join(old.filter("required").select("tool", "param"), ["tool", "param"], "left_anti").select("tool", "param", F.lit("newly_required").alias("issue"))
    return dropped.unionByName(demanded)


def merge_sets(base: Column, ours: Column, theirs: Column) -> Column:
    """Three-way merge of arrays as sets: what all three have, and what either side added."""
    return F.array_sort(F.array_union(F.array_intersect(F.array_intersect(base, ours), theirs), F.array_union(F.array_except(ours, base), F.array_except(theirs, base))))


def set_drift(before: Column, after: Column) -> Column:
    """struct(added, removed, retained)."""
    return F.struct(F.array_sort(F.array_except(after, before)).alias("added"), F.array_sort(F.array_except(before, after)).alias("removed"), F.array_sort(F.array_intersect(before, after)).alias("retained"))


def changed(previous: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """key and change: created, modified (another version), deleted."""
    j = previous.select(key, F.col(version).alias("p"), F.lit(1).alias("hp")).join(current.select(key, F.col(version).alias("c"), F.lit(1).alias("hc")), key, "full_outer")
    return j.select(key, F.when(F.col("hp").isNull(), "created").when(F.col("hc").isNull(), "deleted").when(~F.col("p").eqNullSafe(F.col("c")), "modified").alias("change")).filter("change is not null")


def incremental(current: DataFrame, index: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of the current snapshot whose content hash the index (key, hash) lacks: what must be indexed again; adds hash."""
    hashed = current.withColumn("hash", F.sha2(content, 256))
    return hashed.join(index.select(key, "hash"), [key, "hash"], "left_anti")


def merge_backlog(items: DataFrame, backlog: DataFrame, order: str, start: int = 2001) -> DataFrame:
    """The backlog with its roadmap rows replaced by the items, numbered from `start`. items: title; backlog: number, title, kind."""
    fresh = number_rows(items.select("title", order) if order != "title" else items.select("title"), [order], "number", start).select(F.col("number").cast("long").alias("number"), "title", F.lit("roadmap").alias("kind"))
    return backlog.filter("kind <> 'roadmap'").select(F.col("number").cast("long").alias("number"), "title", "kind").unionByName(fresh)


def insert_new(existing: DataFrame, proposals: DataFrame, marker: str) -> DataFrame:
    """Proposals with what happened to them: added, or skipped because the marker exists."""
    known = existing.select(marker).distinct()
    return proposals.join(known, marker, "left_anti").withColumn("outcome", F.lit("added")).unionByName(proposals.join(known, marker, "left_semi").withColumn("outcome", F.lit("skipped")))


def structural_filter(spec: str, columns: Mapping[str, str]) -> Column:
    """A predicate from `kind:` `name:` `scope:` `lang:` `min_line:` `max_line:` terms; a bare token is a pattern for the name. columns maps terms to columns."""
    out = F.lit(True)
    for token in spec.split():
        term, _, value = token.rpartition(":")
        if term in ("min_line", "max_line"):
            line = F.col(columns["line"])
            out = out & (line >= int(value) if term == "min_line" else line <= int(value))
        elif term in ("", "name"):
            out = out & F.col(columns["name"]).rlike(value)
        else:
            out = out & (F.col(columns[term]) == value)
    return out


def edit_script(before: list, after: list) -> list[tuple[str, int, int]]:
    """A shortest edit script: ('-', i, j) for an element i of before that goes, ('+', i, j) for an element j of after that comes, in order; i and j say where both texts stand.

    Greedy by furthest-reaching paths, in linear space: the middle of a shortest path is found from both ends, and the halves are solved alone."""
    out, stack = [], [(0, len(before), 0, len(after))]
    while stack:
        lo, hi, left, right = stack.pop()
        while lo < hi and left < right and before[lo] == after[left]:
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and before[hi - 1] == after[right - 1]:
            hi, right = hi - 1, right - 1
        if lo == hi or left == right:
            out += [("-", i, left) for i in range(lo, hi)] + [("+", lo, j) for j in range(left, right)]
            continue
        x, y = _middle(before, after, lo, hi, left, right)
        stack += [(x, hi, y, right), (lo, x, left, y)]
    return out


def _middle(a: list, b: list, lo: int, hi: int, left: int, right: int) -> tuple[int, int]:
    """A point on a shortest edit path of a[lo:hi] to b[left:right], which begin and end differently, other than its two ends."""
    n, m = hi - lo, right - left
    odd = (n - m) % 2
    ahead, back = {1: 0}, {1: 0}  # furthest x on each diagonal x - y, from the beginning and, mirrored, from the end
    for d in range((n + m + 1) // 2 + 1):
        for own, other, mirrored in ((ahead, back, False), (back, ahead, True)):
            for k in range(-d, d + 1, 2):
                x = own[k + 1] if k == -d or (k != d and own.get(k - 1, -1) < own.get(k + 1, -1)) else own[k - 1] + 1
                y = x - k
                while x < n and y < m and (a[hi - 1 - x] == b[right - 1 - y] if mirrored else a[lo + x] == b[left + y]):
                    x, y = x + 1, y + 1
                own[k] = x
                met = other.get(n - m - k)
                if met is not None and bool(odd) != mirrored and x + met >= n and x <= n and y <= m:
                    return (hi - x, right - y) if mirrored else (lo + x, left + y)
    raise AssertionError("two paths always meet")


def line_diff(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """The shortest line diff of each pair of texts: key, step (0, 1, ...), op (- or +), at_before, at_after (line numbers from 0), line. A moved line goes and comes. Null is empty."""
    change = "array<struct<step:int,op:string,at_before:int,at_after:int,line:string>>"

    @F.pandas_udf(change)
    def changes(old: pd.Series, new: pd.Series) -> pd.Series:
        def of(x, y):
            x, y = x.split("\n") if x else [], y.split("\n") if y else []
            return [{"step": s, "op": op, "at_before": i, "at_after": j, "line": x[i] if op == "-" else y[j]} for s, (op, i, j) in enumerate(edit_script(x, y))]

        return pd.Series([of(x, y) for x, y in zip(old, new, strict=True)])

    return pairs.filter(~F.col(before).eqNullSafe(F.col(after))).select(key, F.explode(changes(F.col(before), F.col(after))).alias("c")).select(key, "c.*")


def patch_minimality(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Share of meaningful changed lines of the shortest diff, less what the churn costs; so a moved line is a change. Texts that are equal but for the white space around them score 1."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    own = pairs.select(key, F.coalesce(before, F.lit("")).alias("__b"), F.coalesce(after, F.lit("")).alias("__a"), F.when(F.coalesce(before, F.lit("")) == "", 0).otherwise(F.size(F.split(before, "\n"))).alias("__size"))
    lines = line_diff(own.filter(bare(F.col("__b")) != bare(F.col("__a"))), key, "__b", "__a")
    noise = (F.trim("line") == "") | F.ltrim("line").startswith("#")
    counted = lines.groupBy(key).agg(F.count("*").alias("churn"), F.count_if(~noise).alias("real"))
    score = F.col("real") / F.col("churn") * (1.0 - 0.5 * F.least(F.lit(1.0), F.col("churn") / (2.0 * F.greatest("__size", F.lit(1)))))
    return own.select(key, "__size").join(counted, key, "left").select(key, F.coalesce(score, F.lit(1.0)).alias("minimality"))


def perturb_truncate(text: Column, intensity: float) -> Column:
    """The first lines of a text, a share of 1 - intensity / 2; two lines or fewer stay."""
    lines = F.split(text, "\n", -1)
    keep = F.greatest(F.lit(1), F.floor(F.size(lines) * (1 - 0.5 * intensity)).cast("int"))
    return F.when(F.size(lines) <= 2, text).otherwise(F.array_join(F.slice(lines, F.lit(1), keep), "\n"))


def perturb_insert(text: Column, key: Column, snippets: Sequence[str], seed: int) -> Column:
    """A snippet inserted as a line at a place that key and seed decide."""
    lines = F.split(text, "\n", -1)
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30))
    at = (h % (F.size(lines) + 1)).cast("int")
    pick = F.element_at(F.array(*map(F.lit, snippets)), ((h / 7).cast("long") % len(snippets) + 1).cast("int"))
    return F.array_join(F.array_insert(lines, at + 1, pick), "\n")


def perturb_dilute(text: Column, key: Column, filler: Sequence[str], intensity: float, seed: int) -> Column:
    """Filler sentences after lines of a text, so that a share of `intensity` of its lines is followed by one; key, seed and line number decide which."""
    lines = F.split(text, "\n", -1)
    h = lambda i: F.pmod(F.xxhash64(key, F.lit(seed), i), F.lit(1 << 30))
    pick = lambda i: F.element_at(F.array(*map(F.lit, filler)), ((h(i) / 1009).cast("long") % len(filler) + 1).cast("int"))
    return F.array_join(F.transform(lines, lambda x, i: F.when(h(i) % 1000 < int(1000 * intensity), F.concat(x, F.lit("\n"), pick(i))).otherwise(x)), "\n")


def perturb_inject(text: Column, key: Column, instructions: Sequence[str], seed: int, fence: str = "<!-- {} -->") -> Column:
    """An instruction that the text should not carry, wrapped and inserted as a line at a place that key and seed decide."""
    return perturb_insert(text, key, [fence.format(x) for x in instructions], seed)


def perturb_trap(text: Column, intensity: float, step: str = "if condition_{}:") -> Column:
    """A complexity trap: a nest of conditions before the text, 1 to 12 levels deep by intensity, with the text's first line inside."""
    depth = max(1, min(12, round(12 * intensity)))
    nest = "\n".join("    " * i + step.format(i) for i in range(depth))
    lines = F.split(text, "\n", -1)
    return F.concat_ws("\n", F.lit(nest), F.concat(F.lit("    " * depth), F.get(lines, F.lit(0))), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), "\n"))


def classify_notes(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classified, rejects): renamed with its replacement, moved, removed; what can't be read is a reject. notes: key, note."""
    n = F.col("note")
    to = F.regexp_extract(n, r"(?i)^replaced by `?([\w.]+)`?", 1)
    kind = F.when(to != "", "renamed").when(n.rlike("(?i)^moved"), "moved").when(n.rlike("(?i)^(removed|no replacement|deprecated, no)"), "removed")
    out = notes.select("key", kind.alias("kind"), F.when(to != "", to).alias("replacement"))
    return out.filter("kind is not null"), out.filter("kind is null").select("key")


def hash_features(rows: DataFrame, key: str, column: str, n: int = 64) -> DataFrame:
    """Unit vector of n hash-bucket counts of a key's names; a key without names (null or empty ones alone) has zeros, and null is a key."""
    name = F.when(F.col(column) != "", F.col(column))
    counts = rows.groupBy(key, F.pmod(F.crc32(name.cast("binary")), F.lit(n)).cast("int").alias("b")).agg(F.count("*").alias("c"))
    named = F.col("b").isNotNull()
    maps = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(named, F.struct("b", "c")))).alias("m"), F.sqrt(F.sum(F.when(named, F.col("c") * F.col("c")))).alias("norm"))
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_divide(F.element_at(m, i), "norm"), F.lit(0.0)))
    return maps.select(key, F.transform(F.array("m"), dense)[0].alias("vector"))  # as an element, a map is made once and not for each bucket


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if they are empty, of other lengths or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


def drift(before: DataFrame, after: DataFrame, key: str, vector: str) -> DataFrame:
    """distance and class of each key's vectors: preserved up to .05, slight up to .15, else significant."""
    j = before.select(key, F.col(vector).alias("a")).join(after.select(key, F.col(vector).alias("b")), key)
    d = F.round(F.greatest(F.lit(0.0), 1.0 - cosine(F.col("a"), F.col("b"))), 6)
    return j.select(key, d.alias("distance"), F.when(d <= 0.05, "preserved").when(d <= 0.15, "slight").otherwise("significant").alias("class"))
