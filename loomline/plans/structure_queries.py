"""Queries of document structure and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as fi
from ..operators import lexer as lx
from ..operators import pages as pg
from ..operators import structure as st
from .registry import register
from .tables import table

#: Documents with planted Markdown; valid in Spark and DuckDB.
MARK = """CASE doc_id % 6 WHEN 0 THEN concat('intro', chr(10), '# 1 Goals', chr(10), 'one two', chr(10), '```py', chr(10), '# 2 hidden', chr(10), '```', chr(10), '## 3 Scope', chr(10), text) WHEN 1 THEN concat('| a | b |', chr(10), '|---|:-:|', chr(10), '| 1 | 2 |', chr(10), '| 1 | `x|y` | 3 |', chr(10), 'end', chr(10), '| 9 |')
WHEN 2 THEN concat('# Plan', chr(10), '- [ ] first', chr(10), '  - why', chr(10), '  - more', chr(10), '- [x] done', chr(10), '# Rejected ideas', chr(10), '- [ ] never', chr(10), '# Later', chr(10), '- [ ] second ', doc_id) WHEN 3 THEN concat('see the blacklist', chr(10), '`the the` TODO', chr(10), 'and and so', chr(10), '```', chr(10), 'whitelist') ELSE text END"""


def marked(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(MARK).alias("t"))


#: Real texts of all documents, some with planted lines before or after.
MARK_WHOLE = """CASE doc_id % 6 WHEN 0 THEN concat('intro', chr(10), '# 1 Goals', chr(10), 'one two', chr(10), '```py', chr(10), '# 2 hidden', chr(10), '```', chr(10), '## 3 Scope', chr(10), text) WHEN 1 THEN concat(text, chr(10), '| a | b |', chr(10), '|---|:-:|', chr(10), '| 1 | 2 |', chr(10), '| 1 | `x|y` | 3 |', chr(10), 'end', chr(10), '| 9 |')
WHEN 3 THEN concat(text, chr(10), 'see the blacklist', chr(10), '`the the` TODO', chr(10), 'and and so', chr(10), '```', chr(10), 'whitelist') ELSE text END"""


def marked_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(MARK_WHOLE).alias("t"))


_L = rf"WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE string_split(regexp_replace(t, '\n$', ''), chr(10)) END AS ls FROM (SELECT doc_id, {MARK} AS t FROM documents))), m AS (SELECT *, regexp_matches(line, '^ {{0,3}}```') AS mk FROM l), f AS (SELECT *, mk OR sum(mk::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS fenced FROM m)"


#: The same over the texts of MARK_WHOLE.
_LW = _L.replace(MARK, MARK_WHOLE)


def f3(spark, d):
    return st.lint_prose(marked_whole(spark, d), "doc_id", "t")


_TERMS = " UNION ALL ".join(f"SELECT doc_id, line_no, 'TERM{i}' AS rule_id FROM c WHERE regexp_matches(clean, '{t}')" for i, t in enumerate(st.TERMS))
_F3 = rf"""{_LW}, c AS (SELECT doc_id, line_no, regexp_replace(line, '`[^`]*`', ' __code__ ', 'g') AS clean FROM f WHERE NOT fenced), w AS (SELECT doc_id, line_no, regexp_split_to_array(lower(clean), '[^a-z]+') AS ws FROM c)
{_TERMS} UNION ALL SELECT doc_id, line_no, 'PLACEHOLDER' FROM c WHERE regexp_matches(clean, '{st.PLACEHOLDER}')
UNION ALL SELECT doc_id, line_no, 'DOUBLED' FROM w WHERE len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1] AND len(ws[i]) > 1)) > 0"""
for _name in ("f3_prose", "f3_prose_whole"):
    register(_name, f3, _F3)


def f4(spark, d):
    return st.flagged_lines(marked(spark, d), "doc_id", "t").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("fenced").alias("fenced")).join(st.unclosed_fences(marked(spark, d), "doc_id", "t").withColumn("unclosed", F.lit(True)), "doc_id", "left").fillna(False, ["unclosed"])


register("f4_fences", f4, f"{_L} SELECT doc_id, count(*) AS lines, count(*) FILTER (fenced) AS fenced, count(*) FILTER (mk) % 2 = 1 AS unclosed FROM f GROUP BY 1")


def f5(spark, d):
    return st.check_tables(marked_whole(spark, d), "doc_id", "t")


_F5 = rf"""{_LW}, c AS (SELECT doc_id, line_no, len(string_split(regexp_replace(regexp_replace(regexp_replace(line, '`[^`]*`', 'c', 'g'), '\\\|', 'c', 'g'), '^\s*\||\|\s*$', '', 'g'), '|')) AS cells,
fenced OR NOT contains(line, '|') AS e, NOT fenced AND contains(line, '|') AND regexp_matches(line, '^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$') AS dl FROM f),
w AS (SELECT *, last_value(CASE WHEN e THEN 0 WHEN dl THEN cells END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS want FROM c)
SELECT doc_id, line_no, want, cells AS got FROM w WHERE want > 0 AND NOT dl AND NOT e AND cells <> want"""
for _name in ("f5_tables", "f5_tables_whole"):
    register(_name, f5, _F5)


def f7_rows(spark, d):
    return st.split_sections(marked(spark, d), "doc_id", "t")


def f7(spark, d):
    return f7_rows(spark, d).select("doc_id", "section", "level", "heading", "first_line", "last_line", "tokens")


_SEC = rf"""{_L}, h AS (SELECT *, NOT fenced AND regexp_matches(line, '^#{{1,6}} +\S') AS hd FROM f), s AS (SELECT *, sum(hd::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS section FROM h),
sec AS (SELECT doc_id, section, min(line_no) AS first_line, max(line_no) AS last_line, max(CASE WHEN hd THEN line END) AS hl, sum(len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')))::BIGINT AS tokens FROM s GROUP BY 1, 2),
sections AS (SELECT doc_id, section, coalesce(length(regexp_extract(hl, '^(#+)', 1)), 0) AS level, coalesce(trim(regexp_replace(hl, '^#+', '')), '') AS heading, first_line, last_line, tokens FROM sec)"""
register("f7_sections", f7, f"{_SEC} SELECT * FROM sections")


def f8(spark, d):
    gates = spark.createDataFrame([("g1", "Goals", ["aim"]), ("g2", "ZZ", ["scope", "the"]), ("g3", "QQ", ["plan"])], "gate string, code string, keywords array<string>")
    return st.attribute_gates(gates, f7_rows(spark, d), "doc_id").groupBy("gate", "heading").agg(F.count("*").alias("n"))


register(
    "f8_gates",
    f8,
    f"{_SEC}, g AS (SELECT * FROM (VALUES ('g1', 'Goals', 'zzzz'), ('g2', 'ZZ', 'scope'), ('g3', 'QQ', 'plan')) g(gate, code, kw)), b AS (SELECT doc_id, gate, arg_min(heading, CASE WHEN contains(heading, code) THEN 0 ELSE 1000000 END + section) AS heading FROM sections, g WHERE contains(heading, code) OR contains(lower(heading), kw) GROUP BY 1, 2) SELECT gate, coalesce(heading, 'unattributed') AS heading, count(*) AS n FROM (SELECT d.doc_id, g.gate, b.heading FROM (SELECT DISTINCT doc_id FROM sections) d CROSS JOIN g LEFT JOIN b ON b.doc_id = d.doc_id AND b.gate = g.gate) GROUP BY 1, 2",
)


def f9(spark, d):
    s = f7_rows(spark, d).withColumn("critical", F.col("heading").contains("Goals")).withColumn("gated", F.col("level") == 2)
    return st.ablation(s).groupBy("action").agg(F.count("*").alias("n"), F.sum("saved").alias("saved"))


register("f9_ablation", f9, f"{_SEC}, a AS (SELECT tokens, CASE WHEN contains(heading, 'Goals') THEN 'critical' WHEN level = 2 AND tokens > 500 THEN 'compress' WHEN tokens > 1000 THEN 'prune' ELSE 'keep' END AS action FROM sections) SELECT action, count(*) AS n, sum(CASE action WHEN 'compress' THEN tokens - 500 WHEN 'prune' THEN tokens ELSE 0 END)::BIGINT AS saved FROM a GROUP BY 1")


def f10(spark, d):
    lines = fi.exploded_lines(table(spark, d, "documents"), "doc_id", "text")
    return lines.groupBy(st.normalise_line(F.col("line")).alias("shape")).agg(F.count("*").alias("n"))


register("f10_token_classes", f10)


#: All documents, with comment marks in place of two letters, so that comments go over lines.
CODE = "replace(replace(text, 'q', '/*'), 'z', '*/')"
_INK = "'[ \\t\\r\\n]'"


def f10_lexed(spark, d):
    rows = lx.lexed_lines(table(spark, d, "documents").select("doc_id", F.expr(CODE).alias("t")), "doc_id", "t", "go")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length(F.regexp_replace("comment", "[ \t\r\n]", ""))).alias("comment_chars"))


register(
    "f10_lexed",
    f10_lexed,
    rf"""WITH t AS (SELECT doc_id, {CODE} AS t FROM documents WHERE text <> ''),
c AS (SELECT doc_id, t, list_filter(regexp_extract_all(t, '(?s)/\*.*?(?:\*/|\z)|//[^\n]*|`[^`]*(?:`|\z)|"(?:\\[^\n]|[^"\\\n])*"?|''(?:\\[^\n]|[^''\\\n])*''?'), lambda x: x[1] = '/') AS cs FROM t)
SELECT doc_id, (length(t) - length(replace(t, chr(10), '')) + CASE WHEN t LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS n_lines, length(regexp_replace(array_to_string(cs, ''), {_INK}, '', 'g'))::BIGINT AS comment_chars FROM c""",
)


def f10_pages(spark, d):
    ink = lambda c: F.sum(F.length(F.regexp_replace(c, "[ \t\r\n]", "")))
    return lx.lexed_lines(table(spark, d, "pages"), "page_id", "html", "html").groupBy("page_id").agg(ink("comment").alias("comment_chars"), ink("code").alias("code_chars"))


register(
    "f10_page_comments",
    f10_pages,
    rf"""WITH c AS (SELECT page_id, length(regexp_replace(html, {_INK}, '', 'g')) AS ink, length(regexp_replace(array_to_string(regexp_extract_all(html, '(?s)<!--.*?(?:-->|\z)'), ''), {_INK}, '', 'g')) AS comment FROM pages WHERE html <> '')
SELECT page_id, comment::BIGINT AS comment_chars, (ink - comment)::BIGINT AS code_chars FROM c""",
)


def f11(spark, d):
    return st.clone_groups(table(spark, d, "documents"), "doc_id", "text", 3).groupBy("fingerprint").agg(F.count("*").alias("sites"))


_CL = r"WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS ls FROM documents)), n AS (SELECT doc_id, line_no, trim(line) AS line FROM l WHERE trim(line) <> '')"
register("f11_clones", f11, f"{_CL}, w AS (SELECT list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ls FROM n) SELECT sha256(array_to_string(ls, chr(10))) AS fingerprint, count(*) AS sites FROM w WHERE len(ls) = 3 GROUP BY 1 HAVING count(*) >= 2")


def f11m(spark, d):
    return st.merge_clones(st.clone_groups(table(spark, d, "documents"), "doc_id", "text", 3), "doc_id").select("doc_id", "line_no", "fingerprint")


register(
    "f11_merged_clones",
    f11m,
    f"""{_CL.replace("WITH", "WITH RECURSIVE", 1)}, w AS (SELECT doc_id, line_no, list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ls FROM n),
s AS (SELECT doc_id, line_no, sha256(array_to_string(ls, chr(10))) AS fingerprint FROM w WHERE len(ls) = 3), g AS (SELECT fingerprint FROM s GROUP BY 1 HAVING count(*) >= 2),
t AS (SELECT doc_id, line_no, fingerprint, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM s JOIN g USING (fingerprint)),
r AS (SELECT *, true AS kept, line_no AS last FROM t WHERE k = 1 UNION ALL SELECT t.*, t.line_no - last >= 6, CASE WHEN t.line_no - last >= 6 THEN t.line_no ELSE last END FROM r JOIN t ON t.doc_id = r.doc_id AND t.k = r.k + 1)
SELECT doc_id, line_no, fingerprint FROM r WHERE kept""",
)


def f12(spark, d):
    m = st.text_metrics(table(spark, d, "documents"), "doc_id", "text")
    return m.select("doc_id", F.round("volume", 3).alias("volume"), "branches", F.round("maintainability", 3).alias("maintainability"))


register(
    "f12_text_metrics",
    f12,
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws, greatest(CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\n$', ''), chr(10))) END, 1) AS lines FROM documents),
v AS (SELECT doc_id, lines, len(ws) * log2(greatest(len(list_distinct(ws)), 2)) AS volume, len(list_filter(ws, lambda x: x IN ('if', 'for', 'while', 'or', 'and', 'on', 'in'))) AS branches FROM w)
SELECT doc_id, round(volume, 3) AS volume, branches::INT AS branches, round(greatest(0, least(100, (171.0 - 5.2 * ln(greatest(volume, 1)) - 0.23 * branches - 16.2 * ln(lines)) * 100 / 171.0)), 3) AS maintainability FROM v""",
)


def f14(spark, d):
    return st.parse_checklist(marked(spark, d), "doc_id", "t")


register("f14_checklist", f14, "SELECT doc_id, unnest([2, 9]) AS line_no, unnest(['Plan', 'Later']) AS heading, unnest(['first', concat('second ', doc_id)]) AS item, unnest(['why', NULL]) AS context, 'Medium' AS size FROM documents WHERE doc_id % 6 = 2")


def f15(spark, d):
    return st.missing_sections(marked_whole(spark, d), "doc_id", "t", 5)


_F15 = rf"""{_LW} SELECT doc_id, missing FROM (SELECT DISTINCT doc_id, unnest([1, 2, 3, 4, 5]) AS missing FROM f) EXCEPT SELECT doc_id, try_cast(regexp_extract(line, '^#+ *(\d+)\b', 1) AS INT) FROM f WHERE NOT fenced"""
for _name in ("f15_missing_sections", "f15_missing_sections_whole"):
    register(_name, f15, _F15)


def f17(spark, d):
    u = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(F.expr("concat(html, ' see http://ext', page_id % 9, '.net/a. and ', url, ';')"), F.lit(r"https?://[A-Za-z0-9./_-]+"), F.lit(0))).alias("u")).select("page_id", F.regexp_replace("u", r"[.,;:]+$", "").alias("url"))
    u = u.withColumn("host", F.regexp_extract("url", r"^https?://([^/]+)", 1))
    return u.groupBy("host", "url").agg(F.min("page_id").alias("first_page"), F.first(F.col("url").startswith("http://")).alias("plain"))


register("f17_endpoints", f17, r"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url, min(page_id) AS first_page, bool_or(url LIKE 'http://%') AS plain FROM (SELECT page_id, regexp_replace(unnest(regexp_extract_all(concat(html, ' see http://ext', page_id % 9, '.net/a. and ', url, ';'), 'https?://[A-Za-z0-9./_-]+')), '[.,;:]+$', '') AS url FROM pages) GROUP BY 1, 2")


def w1(spark, d):
    return pg.extract_pages(table(spark, d, "pages"), "page_id", "url", "html")


register("w1_markdown", w1)


def w2(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat(F.left("text", F.lit(100)), F.lit("\n\n"), F.col("text")).alias("t"))
    return t.select("doc_id", st.truncate_blocks(F.col("t"), 400).alias("r")).select("doc_id", F.md5("r.text").alias("digest"), "r.truncated")


register("w2_truncate", w2, r"WITH t AS (SELECT doc_id, concat(text[1:100], chr(10), chr(10), text) AS t FROM documents), h AS (SELECT doc_id, t, t[1:400] AS h FROM t), p AS (SELECT *, strpos(reverse(h), concat(chr(10), chr(10))) AS p FROM h) SELECT doc_id, md5(CASE WHEN length(t) > 400 THEN concat(rtrim(CASE WHEN p > 0 THEN h[1:length(h) - p - 1] ELSE h END), chr(10), chr(10), '[truncated]') ELSE t END) AS digest, length(t) > 400 AS truncated FROM p")

_HTML = "CASE page_id % 5 WHEN 0 THEN concat('<div id=\"root\"></div>') WHEN 1 THEN '<p>short</p>' WHEN 2 THEN concat(html, 'Please solve the CAPTCHA') ELSE html END"


def w3(spark, d):
    return table(spark, d, "pages").select("page_id", pg.page_quality(F.expr(_HTML)).alias("quality"))


register("w3_page_quality", w3, "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'EMPTY_SHELL' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'BLOCKED' ELSE 'HIGH' END AS quality FROM pages")


def w4(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(pg.page_links(F.col("html"), F.col("url"))).alias("n", "link"))


register(
    "w4_links",
    w4,
    r"""WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS root, regexp_extract(url, '^(https?://[^/]+(?:/[^/?#]*)*/)', 1) AS folder, list_filter(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1), lambda x: x <> '' AND NOT starts_with(x, '#'))[1:50] AS hs FROM pages)
SELECT page_id, unnest(range(len(hs)))::INT AS n, unnest(list_transform(hs, lambda x: CASE WHEN regexp_matches(x, '^[a-z][a-z0-9+.-]*:') THEN x WHEN starts_with(x, '/') THEN concat(root, x) ELSE concat(CASE WHEN folder = '' THEN concat(root, '/') ELSE folder END, x) END)) AS link FROM h""",
)


def w5(spark, d):
    o = table(spark, d, "events").selectExpr("concat('d', user_id % 20) AS domain", "event_id AS ts", "CASE WHEN event_id % 3 = 0 THEN 'headless' ELSE 'static' END AS tier", "CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'signup' THEN 'shell' ELSE 'ok' END AS outcome")
    return pg.domain_strategy(o)


_W5 = "WITH o AS (SELECT concat('d', user_id % 20) AS domain, event_id AS ts, CASE WHEN event_id % 3 = 0 THEN 'headless' ELSE 'static' END AS tier, CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'signup' THEN 'shell' ELSE 'ok' END AS outcome FROM events) SELECT domain, arg_max(tier, ts) FILTER (outcome = 'ok') AS tier, count(*) FILTER (outcome = 'ok') AS successes, bool_or(outcome = 'shell' OR (outcome = 'ok' AND tier = 'headless')) AS requires_js, least(0.5 * pow(2.0, least(count(*) FILTER (outcome = 'rate_limited'), 10)), 10.0) AS delay FROM o GROUP BY 1"
for _name in ("w5_domain_strategy", "w5_domain_strategy_whole"):
    register(_name, w5, _W5)


def w6(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 4 * 129 + 200).alias("s"))
    return e.groupBy(pg.status_outcome(F.col("s")).alias("outcome")).agg(F.count("*").alias("n"))


register("w6_status", w6, "SELECT CASE WHEN s = 429 THEN 'rate_limited' WHEN s >= 400 THEN 'http_error' ELSE 'ok' END AS outcome, count(*) AS n FROM (SELECT event_id % 4 * 129 + 200 AS s FROM events) GROUP BY 1")


def w7(spark, d):
    p = table(spark, d, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href")).select("page_id", F.regexp_replace("href", "#.*$", "").alias("target"), F.regexp_extract("href", "#(.*)$", 1).alias("anchor"))
    anchors = p.filter("page_id % 2 = 0").select(F.col("url").alias("target"), F.lit("").alias("anchor"))
    return pg.broken_links(links, anchors).groupBy("page_id").agg(F.count("*").alias("n"))


register("w7_broken_links", w7, r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS n FROM l WHERE NOT (regexp_extract(href, '#(.*)$', 1) = '' AND regexp_replace(href, '#.*$', '') IN (SELECT url FROM pages WHERE page_id % 2 = 0)) GROUP BY 1""")


def k4(spark, d):
    t = table(spark, d, "documents").select("source", "doc_id", F.col("text").alias("full_text"), F.left("text", F.lit(200)).alias("brief"), F.left("text", F.lit(40)).alias("line"))
    return st.pack_prefix(t, "source", "doc_id", ["full_text", "brief", "line"], 400)


register(
    "k4_prefix_pack",
    k4,
    """WITH t AS (SELECT source, doc_id, ceil((sum(strlen(text) + 2) OVER w - 2) / 4.0) <= 400 AS a, ceil((sum(strlen(text[1:200]) + 2) OVER w - 2) / 4.0) <= 400 AS b, ceil((sum(strlen(text[1:40]) + 2) OVER w - 2) / 4.0) <= 400 AS c FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
l AS (SELECT *, CASE WHEN bool_and(a) OVER (PARTITION BY source) THEN 'full_text' WHEN bool_and(b) OVER (PARTITION BY source) THEN 'brief' ELSE 'line' END AS level FROM t) SELECT source, doc_id, level FROM l WHERE CASE level WHEN 'full_text' THEN a WHEN 'brief' THEN b ELSE c END""",
)


def k5(spark, d):
    t = table(spark, d, "documents").select("source", F.col("doc_id").alias("rank"), F.ceil(F.length("text") / 4).cast("long").alias("tokens"))
    return st.pack_greedy(t, "source", 3000).filter("packed")


register(
    "k5_greedy_pack",
    k5,
    """WITH RECURSIVE t AS (SELECT source, doc_id AS rank, ceil(length(text) / 4.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT source, rank, tokens, k, coalesce(tokens + 5 <= 3000, false) AS packed, 3000 - CASE WHEN tokens + 5 <= 3000 THEN tokens + 5 ELSE 0 END AS room FROM t WHERE k = 1
UNION ALL SELECT t.source, t.rank, t.tokens, t.k, coalesce(t.tokens + 5 <= room, false), room - CASE WHEN t.tokens + 5 <= room THEN t.tokens + 5 ELSE 0 END FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source AND t.k = r.k + 1)
SELECT source, rank, tokens, packed FROM r WHERE packed""",
)
