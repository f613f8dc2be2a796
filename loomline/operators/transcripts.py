"""Conversations: parsing, pseudonyms, telemetry, attention and compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import QUAD, is_private_ipv4
from ..functions.text import lines_of, token_count

# Words that mark a message as carrying an invariant.
INVARIANT_WORDS = ("invariant", "constraint", "mccabe", "cyclomatic", "complexity", "depth", "zero-trust", "rfc 1918", "assertion", "tuple equality", "no private ip")
STEP = "step_index int, source string, type string, status string, created_at string, content string, thinking string, tool_calls array<struct<name:string,args:map<string,string>>>"


def parse_steps(lines: DataFrame, column: str, *keep: str) -> DataFrame:
    """Transcript steps from one JSON object a line. Lines that are blank, malformed or no object are dropped; fields have defaults;
    a <think> block moves to thinking where that is empty (the first one is kept, all are removed)."""
    ok = lines.filter(F.col(column).rlike(r"^\s*\{")).select(*keep, F.from_json(column, STEP, {"mode": "PERMISSIVE"}).alias("s"), F.try_parse_json(column).alias("__v"))
    ok = ok.filter(F.col("__v").isNotNull()).select(*keep, "s.*")
    think = r"(?is)<think>(.*?)</think>"
    empty = F.coalesce(F.col("thinking"), F.lit("")) == ""
    return ok.select(
        *keep,
        F.coalesce("step_index", F.lit(0)).alias("step_index"),
        F.coalesce("source", F.lit("UNKNOWN")).alias("source"),
        F.coalesce("type", F.lit("UNKNOWN")).alias("type"),
        F.coalesce("status", F.lit("DONE")).alias("status"),
        "created_at",
        F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), think, "")).alias("content"),
        F.when(empty & F.col("content").rlike(think), F.trim(F.regexp_extract("content", think, 1))).otherwise(F.col("thinking")).alias("thinking"),
        "tool_calls",
    )


def role_of(name: Column) -> Column:
    """A role by what its name contains: system, then assistant, then tool, else user."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(n.contains("system"), "system").when(n.contains("assistant") | n.contains("model"), "assistant").when(n.contains("tool") | n.contains("observation"), "tool").otherwise("user")


def parse_messages(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Messages of whole texts: key, turn, role, content. A JSON array if the text is one; else JSON lines if any line is a message; else blocks
    that begin with a word and a colon. Empty contents are dropped and leave a gap in the turns."""
    message = "array<struct<role:string,content:string,text:string,message:string>>"
    body = F.trim(F.col(column))
    as_array = F.when(body.startswith("[") & body.endswith("]"), F.from_json(body, message))
    as_lines = F.filter(F.transform(lines_of(F.col(column)), lambda x: F.from_json(F.when(x.rlike(r"^\s*\{"), x), message[6:-1])), lambda m: m.isNotNull() & (m["role"].isNotNull() | m["content"].isNotNull()))
    blocks = F.transform(
        F.filter(F.split(F.col(column), r"\n(?=[A-Za-z]+: )"), lambda b: F.trim(b) != ""),
        lambda b: F.struct(F.regexp_extract(b, r"^([A-Za-z]+): ", 1).alias("role"), b.alias("content"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("message")),
    )
    chosen = F.when(as_array.isNotNull(), as_array).when(F.size(as_lines) > 0, as_lines).otherwise(blocks)
    content = F.coalesce(*[F.when(F.col(f"m.{c}") != "", F.col(f"m.{c}")) for c in ("content", "text", "message")])
    return texts.select(key, F.posexplode(chosen).alias("turn", "m")).select(key, "turn", role_of(F.col("m.role")).alias("role"), content.alias("content")).filter("content is not null")


def pseudonymise_ips(messages: DataFrame, scope: str, order: Sequence[str], text: str) -> DataFrame:
    """Each private IPv4 address of a scope becomes 192.0.2.n, n by first appearance in the given order: scope, order..., text."""
    if not order:
        raise ValueError("first appearance needs an order")
    hosts = messages.select(scope, *order, F.posexplode(F.filter(F.regexp_extract_all(text, F.lit(QUAD), F.lit(0)), is_private_ipv4)).alias("__p", "host"))
    first = hosts.groupBy(scope, "host").agg(F.min(F.struct(*order, "__p")).alias("at"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy(scope).orderBy("at")))
    maps = numbered.groupBy(scope).agg(F.map_from_entries(F.collect_list(F.struct("host", F.concat(F.lit("192.0.2."), F.col("n").cast("string"))))).alias("__map"))
    pieces = F.split(F.col(text), QUAD, -1)
    found = F.regexp_extract_all(text, F.lit(QUAD), F.lit(0))
    swapped = F.array_join(F.transform(pieces, lambda g, i: F.concat(g, F.coalesce(F.element_at("__map", F.get(found, i)), F.get(found, i), F.lit("")))), "")
    return messages.join(maps, scope, "left").select(*[swapped.alias(c) if c == text else F.col(c) for c in messages.columns])


def transcript_telemetry(steps: DataFrame, by: str, order: str) -> DataFrame:
    """Steps, failures, tokens in, out and in thought, tool calls, code snippets and duration of each conversation.
    steps: by, source, status, content, thinking, n_tools, created_at (timestamp)."""
    tokens = lambda cond, c: F.floor((F.sum(F.when(cond, F.length(c)).otherwise(0)) + 3) / 4).cast("long")
    user = F.col("source") == "user"
    span = F.max(F.struct(order, "created_at"))["created_at"].cast("timestamp").cast("double") - F.min(F.struct(order, "created_at"))["created_at"].cast("timestamp").cast("double")
    g = steps.groupBy(by).agg(
        F.count("*").alias("steps"),
        F.count_if(F.col("status") != "DONE").alias("failed"),
        tokens(user, "content").alias("tokens_in"),
        tokens(~user, "content").alias("tokens_out"),
        tokens(F.lit(True), F.coalesce("thinking", F.lit(""))).alias("tokens_thinking"),
        F.sum("n_tools").alias("tools"),
        F.sum(F.regexp_count("content", F.lit("```python"))).alias("snippets"),
        F.coalesce(F.greatest(F.lit(0.0), span), F.lit(0.0)).alias("duration_s"),
    )
    return g.withColumn("error_rate", F.col("failed") / F.col("steps"))


def annotate(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds tokens, bears (an invariant word) and observation (tool output)."""
    low = F.lower(F.col(text))
    bears = F.lit(False)
    for w in INVARIANT_WORDS:
        bears = bears | low.contains(w)
    seen = F.col("role").isin("tool", "observation") | low.contains("stdout:") | low.contains("command exited") | low.contains("tool output")
    return messages.withColumn("tokens", token_count(F.col(text))).withColumn("bears", bears).withColumn("observation", seen)


def position_ratio(annotated: DataFrame, by: str, order: str) -> DataFrame:
    """Adds position: tokens before the message over all tokens of the conversation, four decimals."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("tokens").over(Window.partitionBy(by))
    return annotated.withColumn("total", total).withColumn("position", F.when(total > 0, F.round(before / total, 4)).otherwise(0.0))


def attention(annotated: DataFrame, by: str) -> DataFrame:
    """Signal over all tokens, and dilution. Signal is what bears an invariant or comes from the system or user."""
    signal = F.sum(F.when(F.col("bears") | F.col("role").isin("system", "user"), F.col("tokens")).otherwise(0))
    g = annotated.groupBy(by).agg(signal.alias("signal"), F.sum("tokens").alias("total"))
    noise = F.col("total") - F.col("signal")
    return g.select(by, "signal", "total", F.round(F.when(F.col("total") > 0, F.col("signal") / F.col("total")).otherwise(1.0), 4).alias("effective"), F.round(noise / F.greatest(F.lit(1), F.col("signal")) * (F.col("total") / 10000), 4).alias("dilution"))


def rot_findings(placed: DataFrame, by: str, order: str, max_tokens: int = 32_000, valley: tuple[float, float] = (0.2, 0.8), max_observation: int = 2_000, max_share: float = 0.25, min_ratio: float = 0.15, text: str = "text") -> DataFrame:
    """Context-rot findings: by, rule_id, turn (null for whole conversations). placed: position_ratio() rows."""
    low = F.lower(F.col(text))
    trouble = low.contains("traceback") | low.contains("error:")
    key = F.when(trouble, F.sha2(F.left(text, F.lit(300)), 256))
    rows = placed.withColumn("__repeat", F.when(trouble, F.row_number().over(Window.partitionBy(by, key).orderBy(order))))
    share = F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0)
    fired = F.array(
        F.when(F.col("bears") & F.col("position").between(*valley), "ROT002"),
        F.when(F.col("observation") & ((F.col("tokens") > max_observation) | (share > max_share)), "ROT003"),
        F.when(F.col("__repeat") > 1, "ROT004"),
    )
    one = rows.select(by, F.explode(F.filter(fired, lambda r: r.isNotNull())).alias("rule_id"), F.col(order).cast("long").alias("turn"))
    a = attention(placed, by)
    none = F.lit(None).cast("long").alias("turn")
    deep = a.filter(F.col("total") > max_tokens).select(by, F.lit("ROT001").alias("rule_id"), none)
    thin = a.filter((F.col("effective") < min_ratio) & (F.col("total") > 2000)).select(by, F.lit("ROT005").alias("rule_id"), none)
    return one.unionByName(deep).unionByName(thin)


def compact(annotated: DataFrame, by: str, order: str, max_lines: int = 10, mask_from: int = 300, text: str = "text") -> DataFrame:
    """Compacted conversations: by, turn, role, content, tokens, masked, deduped. Long tool output keeps three lines at each end; otherwise a traceback seen
    before (in rows not masked) becomes a placeholder of 10 tokens; the last three invariants outside system messages are pinned at the end."""
    masked = F.col("observation") & (F.col("tokens") > mask_from)
    lines = lines_of(F.col(text))
    digest = F.concat(F.array_join(F.slice(lines, 1, 3), "\n"), F.lit("\n... ["), (F.size(lines) - 6).cast("string"), F.lit(" lines omitted] ...\n"), F.array_join(F.slice(lines, -3, 3), "\n"))
    error = F.when(~masked & F.lower(F.col(text)).contains("traceback"), F.sha2(F.left(text, F.lit(300)), 256))
    rows = annotated.withColumn("masked", masked).withColumn("__e", error)
    again = F.col("__e").isNotNull() & (F.row_number().over(Window.partitionBy(by, "__e").orderBy(order)) > 1)
    rows = rows.withColumn("deduped", again)
    content = F.when(F.col("masked") & (F.size(lines) > max_lines), digest).when(F.col("deduped"), F.concat(F.lit("[Repeated traceback suppressed: "), F.left("__e", F.lit(8)), F.lit("]"))).otherwise(F.col(text))
    kept = rows.select(by, F.col(order).cast("long").alias("turn"), "role", content.alias("content"), "masked", "deduped").withColumn("tokens", F.when(F.col("deduped"), F.lit(10).cast("long")).otherwise(token_count(F.col("content"))))
    pins = annotated.filter(F.col("bears") & (F.col("role") != "system")).withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter("__k <= 3")
    pinned = pins.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.trim(F.col(text)).alias("t")))).alias("p"))
    ends = kept.groupBy(by).agg(F.count("*").alias("turn"))
    envelope = pinned.join(ends, by).select(by, "turn", F.lit("system").alias("role"), F.concat(F.lit("### PINNED INVARIANTS\n"), F.array_join(F.transform("p.t", lambda t: F.concat(F.lit("- "), t)), "\n")).alias("content"), F.lit(False).alias("masked"), F.lit(False).alias("deduped"))
    return kept.unionByName(envelope.withColumn("tokens", token_count(F.col("content"))))


def extract_fences(texts: DataFrame, key: Sequence[str], text: str, language: str) -> DataFrame:
    """Code blocks of a language: key, n, code."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)```(?:{language})\n(.*?)```"), F.lit(1))
    return texts.select(*key, F.posexplode(found).alias("n", "code"))


def sanitise_nested(value: Column, rule) -> Column:
    """A map of strings with a text rule (Column -> Column) applied to every value; keys and nulls stay."""
    return F.transform_values(value, lambda k, v: rule(v))
