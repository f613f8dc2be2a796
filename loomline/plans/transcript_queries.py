"""Queries over conversations: parsing, pseudonyms, telemetry, attention, rot findings, compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import redact_hosts_paths, redact_secrets
from ..operators import transcripts as tr
from .registry import register
from .tables import table

#: Conversations with planted observations, invariants, errors and addresses; valid in Spark and DuckDB.
TALK = """CASE (conv_id + turn) % 7 WHEN 0 THEN concat(text, ' keep this invariant') WHEN 1 THEN concat('stdout: ', text) WHEN 2 THEN concat('Traceback here error: ', conv_id % 5, ' ', text[1:1]) WHEN 3 THEN concat(text, ' at 10.0.', turn % 3, '.', conv_id % 4, ' and 192.168.1.1') ELSE text END"""
TALK_SPARK = TALK.replace("text[1:1]", "substr(text, 1, 1)")


def talk(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.expr(TALK_SPARK).alias("text"))


_TALK = f"WITH c0 AS (SELECT conv_id, turn, role, {TALK} AS text FROM conversations)"


def s1(spark, d):
    c = talk(spark, d)
    line = F.when(F.col("turn") % 9 == 8, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("turn").alias("step_index"), F.col("role").alias("source"), F.concat(F.lit("<think>hm</think>"), F.col("text")).alias("content"))))
    return tr.parse_steps(c.select("conv_id", line.alias("value")), "value", "conv_id").select("conv_id", "step_index", "source", "type", "status", F.md5("content").alias("digest"), "thinking")


register("s1_transcript", s1, f"{_TALK} SELECT conv_id, turn::INT AS step_index, role AS source, 'UNKNOWN' AS type, 'DONE' AS status, md5(trim(text)) AS digest, 'hm' AS thinking FROM c0 WHERE turn % 9 <> 8")


def s2(spark, d):
    c = table(spark, d, "conversations")
    arr = c.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("body"))
    return tr.parse_messages(arr, "conv_id", "body").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "assistant").alias("assistant"), F.sum(F.length("content")).alias("chars"))


register("s2_messages", s2, "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS assistant, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")


def p4(spark, d):
    return tr.pseudonymise_ips(talk(spark, d), "conv_id", ["turn"], "text").filter("text like '%192.0.2.%'").select("conv_id", "turn", F.regexp_extract("text", r"192\.0\.2\.\d+", 0).alias("first"))


_HOSTS = f"""{_TALK}, h AS (SELECT conv_id, turn, unnest([concat('10.0.', turn % 3, '.', conv_id % 4), '192.168.1.1']) AS host, unnest([0, 1]) AS p FROM c0 WHERE (conv_id + turn) % 7 = 3),
f AS (SELECT conv_id, host, min(turn * 10 + p) AS seen FROM h GROUP BY 1, 2), n AS (SELECT conv_id, host, row_number() OVER (PARTITION BY conv_id ORDER BY seen) AS n FROM f)"""
register("p4_pseudonyms", p4, f"{_HOSTS} SELECT h.conv_id, turn, concat('192.0.2.', n) AS first FROM h JOIN n USING (conv_id, host) WHERE p = 0")


def p6(spark, d):
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("note"), F.concat(F.lit("login at db"), (F.col("event_id") % 5).cast("string"), F.lit(".internal")), F.lit("k"), F.get_json_object("props", "$.k")).alias("m"))
    return e.select("event_id", tr.sanitise_nested(F.col("m"), lambda v: redact_hosts_paths(redact_secrets(v)["text"])["text"]).alias("m")).select("event_id", F.col("m")["note"].alias("note"), F.col("m")["k"].alias("k"))


register("p6_nested", p6, "SELECT event_id, 'login at example.com' AS note, props->>'k' AS k FROM events")


def steps(spark, d):
    return talk(spark, d).select("conv_id", "turn", F.col("role").alias("source"), F.when(F.col("text").contains("error:"), "ERROR").otherwise("DONE").alias("status"), F.col("text").alias("content"), F.lit(None).cast("string").alias("thinking"), F.when(F.col("role") == "assistant", 1).otherwise(0).alias("n_tools"), F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(turn * 3 AS INT))").alias("created_at"))


def a1(spark, d):
    return tr.transcript_telemetry(steps(spark, d), "conv_id", "turn").select("conv_id", "steps", "failed", "tokens_in", "tokens_out", "tokens_thinking", "tools", "snippets", "duration_s", F.round("error_rate", 6).alias("error_rate"))


register(
    "a1_telemetry",
    a1,
    f"""{_TALK} SELECT conv_id, count(*) AS steps, count(*) FILTER (contains(text, 'error:')) AS failed, ((sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) + 3) // 4)::BIGINT AS tokens_in, ((sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END) + 3) // 4)::BIGINT AS tokens_out, 0::BIGINT AS tokens_thinking,
count(*) FILTER (role = 'assistant') AS tools, 0::BIGINT AS snippets, ((max(turn) - min(turn)) * 180.0)::DOUBLE AS duration_s, round(count(*) FILTER (contains(text, 'error:')) / count(*), 6) AS error_rate FROM c0 GROUP BY 1""",
)


def a2(spark, d):
    r = talk(spark, d).select("conv_id", redact_secrets(F.col("text"))["n"].alias("s"), redact_hosts_paths(F.col("text"))["hosts"].alias("h"), F.explode_outer(F.regexp_extract_all("text", F.lit(tr.QUAD), F.lit(0))).alias("ip"))
    return r.groupBy("conv_id").agg(F.sum("s").alias("secrets"), F.sum("h").alias("hosts"), F.countDistinct("ip").alias("addresses"))


register("a2_redaction_stats", a2, f"{_HOSTS}, k AS (SELECT conv_id, count(DISTINCT host) AS addresses FROM h GROUP BY 1) SELECT DISTINCT conv_id, 0::BIGINT AS secrets, 0::BIGINT AS hosts, coalesce(addresses, 0) AS addresses FROM conversations LEFT JOIN k USING (conv_id)")

_INV = " OR ".join(f"contains(lower(text), '{w}')" for w in tr.INVARIANT_WORDS)
_ANN = f"""{_TALK}, a AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(length(text) / 3.8)::BIGINT) END::BIGINT AS tokens, ({_INV}) AS bears, role IN ('tool', 'observation') OR contains(lower(text), 'stdout:') OR contains(lower(text), 'command exited') OR contains(lower(text), 'tool output') AS observation FROM c0),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, round(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(tokens) OVER (PARTITION BY conv_id), 4) AS position FROM a),
att AS (SELECT conv_id, sum(CASE WHEN bears OR role IN ('system', 'user') THEN tokens ELSE 0 END)::BIGINT AS signal, sum(tokens)::BIGINT AS total FROM a GROUP BY 1)"""


def n1(spark, d):
    return tr.position_ratio(tr.annotate(talk(spark, d)), "conv_id", "turn").select("conv_id", "turn", "tokens", "position")


register("n1_position", n1, f"{_ANN} SELECT conv_id, turn, tokens, position FROM p")


def a8(spark, d):
    return tr.attention(tr.annotate(talk(spark, d)), "conv_id")


register("a8_attention", a8, f"{_ANN} SELECT conv_id, signal, total, round(signal / total, 4) AS effective, round((total - signal) / greatest(1, signal) * (total / 10000), 4) AS dilution FROM att")


def n2(spark, d):
    placed = tr.position_ratio(tr.annotate(talk(spark, d)), "conv_id", "turn")
    return tr.rot_findings(placed, "conv_id", "turn", max_tokens=3000, max_observation=300, min_ratio=0.3)


register(
    "n2_rot_findings",
    n2,
    f"""{_ANN}, e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, sha256(text[1:300]) ORDER BY turn) AS k FROM a WHERE contains(lower(text), 'traceback') OR contains(lower(text), 'error:'))
SELECT conv_id, 'ROT002' AS rule_id, turn FROM p WHERE bears AND position BETWEEN 0.2 AND 0.8 UNION ALL SELECT conv_id, 'ROT003', turn FROM p WHERE observation AND (tokens > 300 OR tokens / total > 0.25) UNION ALL SELECT conv_id, 'ROT004', turn FROM e WHERE k > 1
UNION ALL SELECT conv_id, 'ROT001', NULL FROM att WHERE total > 3000 UNION ALL SELECT conv_id, 'ROT005', NULL FROM att WHERE round(signal / total, 4) < 0.3 AND total > 2000""",
)


def n3(spark, d):
    c = tr.compact(tr.annotate(talk(spark, d)), "conv_id", "turn", mask_from=20)
    return c.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count_if("masked").alias("masked"), F.count_if("deduped").alias("deduped"), F.count("*").alias("rows"))


register(
    "n3_compaction",
    n3,
    f"""{_ANN}, m AS (SELECT *, observation AND tokens > 20 AS masked, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS ls FROM a), e AS (SELECT *, NOT masked AND contains(lower(text), 'traceback') AS err FROM m),
r AS (SELECT *, err AND row_number() OVER (PARTITION BY conv_id, err, CASE WHEN err THEN sha256(text[1:300]) END ORDER BY turn) > 1 AS deduped FROM e),
k AS (SELECT conv_id, masked, deduped, CASE WHEN deduped THEN 10 WHEN masked AND len(ls) > 10 THEN greatest(1, floor(length(concat(array_to_string(ls[1:3], chr(10)), chr(10), '... [', len(ls) - 6, ' lines omitted] ...', chr(10), array_to_string(ls[-3:], chr(10)))) / 3.8)::BIGINT) ELSE tokens END AS tokens FROM r),
pin AS (SELECT conv_id, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM a WHERE bears AND role <> 'system'),
env AS (SELECT conv_id, false, false, greatest(1, floor(length(concat('### PINNED INVARIANTS', chr(10), string_agg(concat('- ', trim(text)), chr(10) ORDER BY turn))) / 3.8)::BIGINT) FROM pin WHERE i <= 3 GROUP BY 1)
SELECT conv_id, sum(tokens)::BIGINT AS tokens, count(*) FILTER (masked) AS masked, count(*) FILTER (deduped) AS deduped, count(*) AS rows FROM (SELECT * FROM k UNION ALL SELECT * FROM env) GROUP BY 1""",
)


def f6(spark, d):
    c = talk(spark, d).select("conv_id", "turn", F.concat(F.lit("run\n```python\nx = "), F.col("turn").cast("string"), F.lit("\n```\nthen\n```js\ny\n```\n```py\nz\n```")).alias("text"))
    return tr.extract_fences(c, ["conv_id", "turn"], "text", "python|py")


register("f6_fences", f6, "SELECT conv_id, turn, 0 AS n, concat('x = ', turn, chr(10)) AS code FROM conversations UNION ALL SELECT conv_id, turn, 1, concat('z', chr(10)) FROM conversations")
