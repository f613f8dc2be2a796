"""Structure of documents: fences, tables, sections, checklists, clones and text metrics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of, token_count
from .findings import exploded_lines
from .graph import settled
from .lexer import lexed_lines, states_before

# Terms that prose should not use, placeholders.
TERMS = (r"(?i)\bblacklist(?:ed|ing|s)?\b", r"(?i)\bwhitelist(?:ed|ing|s)?\b", r"(?i)\bmaster[-/]slave\b", r"(?i)\bsanity[- ]check(?:ed|ing|s)?\b")
PLACEHOLDER = r"(?i)\b(?:TODO|FIXME|TBD|LOREM IPSUM)\b"


def fence_flags(lines: Column) -> Column:
    """array<struct(line, fenced, marker)> of an array of lines: a fence closes with the same character, as long at least, and nothing after it.
    Fence lines themselves count as fenced. A document's fence state is sequential, so it is one fold over its lines."""
    mark = lambda x: F.regexp_extract(x, r"^ {0,3}(`{3,}|~{3,})", 1)
    state = "struct<open:string,out:array<boolean>>"
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("out")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        m = mark(x)
        closes = (acc["open"] != "") & (m != "") & (F.left(m, F.lit(1)) == F.left(acc["open"], F.lit(1))) & (F.length(m) >= F.length(acc["open"])) & (F.trim(F.regexp_replace(x, r"^ {0,3}[`~]+", "")) == "")
        opened = F.when(acc["open"] == "", m).when(closes, "").otherwise(acc["open"])
        return F.struct(opened.alias("open"), F.array_append(acc["out"], (acc["open"] != "") | (m != "")).alias("out")).cast(state)

    return F.arrays_zip(lines.alias("line"), F.aggregate(lines, start, step, lambda a: a["out"]).alias("fenced"))


def flagged_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line, fenced."""
    lines = docs.select(key, lines_of(F.col(text)).alias("__l"), F.col(text).rlike(r"(?m)^ {0,3}(?:`{3}|~{3})").alias("__any"))
    plain = F.transform("__l", lambda x: F.struct(x.alias("line"), F.lit(False).alias("fenced")))  # without a fence there is no state to fold
    zipped = lines.select(key, F.when(F.col("__any"), fence_flags(F.col("__l"))).otherwise(plain).alias("z"))
    return zipped.select(key, F.posexplode("z").alias("p", "z")).select(key, (F.col("p") + 1).alias("line_no"), F.col("z.line").alias("line"), F.col("z.fenced").alias("fenced"))


def unclosed_fences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents whose last line is inside a fence that nothing closed (parity of plain ``` lines)."""
    f = exploded_lines(docs, key, text).groupBy(key).agg(F.count_if(F.col("line").rlike(r"^ {0,3}```")).alias("n"))
    return f.filter("n % 2 = 1").select(key)


def lint_prose(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Prose findings outside fences and inline code, at most one a rule and line: key, line_no, rule_id."""
    clean = F.regexp_replace("line", r"`[^`]*`", " __code__ ")
    doubled = F.lower(clean).rlike(r"(?<![a-z])([a-z]{2,})[^a-z]+\1(?![a-z])")
    rules = F.array(*[F.when(clean.rlike(t), f"TERM{i}") for i, t in enumerate(TERMS)], F.when(doubled, "DOUBLED"), F.when(clean.rlike(PLACEHOLDER), "PLACEHOLDER"))
    rows = flagged_lines(docs, key, text).filter("not fenced")
    return rows.select(key, "line_no", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule_id"))


def check_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose cells differ from the delimiter row that opened their table: key, line_no, want, got. The header row is not checked."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"`[^`]*`", "c"), r"\\\|", "c"), r"^\s*\||\|\s*$", "")
    rows = flagged_lines(docs, key, text).withColumn("cells", F.size(F.split(bare, r"\|", -1)))
    delimiter = ~F.col("fenced") & F.col("line").contains("|") & F.col("line").rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
    ends = F.col("fenced") | ~F.col("line").contains("|")
    by = Window.partitionBy(key).orderBy("line_no")
    mark = F.when(ends, F.lit(0)).when(delimiter, F.col("cells"))
    width = F.last(mark, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("want", width).withColumn("d", delimiter).withColumn("e", ends).filter("want > 0 and not d and not e and cells <> want").select(key, "line_no", "want", F.col("cells").alias("got"))


def split_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sections by heading: key, section (from 1; 0 is what stands before the first heading), level, heading, first_line, last_line, tokens."""
    rows = flagged_lines(docs, key, text)
    head = ~F.col("fenced") & F.col("line").rlike(r"^#{1,6} +\S")
    rows = rows.withColumn("h", head).withColumn("section", F.sum(F.col("h").cast("int")).over(Window.partitionBy(key).orderBy("line_no")))
    g = rows.groupBy(key, "section").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.max(F.when(F.col("h"), F.col("line"))).alias("head"), F.sum(token_count(F.col("line"), "words")).alias("tokens"))
    return g.select(key, "section", F.coalesce(F.length(F.regexp_extract("head", r"^(#+)", 1)), F.lit(0)).alias("level"), F.coalesce(F.trim(F.regexp_replace("head", r"^#+", "")), F.lit("")).alias("heading"), "first_line", "last_line", "tokens")


def attribute_gates(gates: DataFrame, sections: DataFrame, key: str, default: str = "unattributed", max_gates: int = 1_000) -> DataFrame:
    """The first section of each document that names a gate's code, or else one of its keywords of over 3 letters, in its heading. gates: gate, code, keywords
    (declared rules: the result has a row for each document and gate, so more than max_gates are refused)."""
    if gates.limit(max_gates + 1).count() > max_gates:
        raise ValueError(f"more than {max_gates} gates")
    words = F.filter("keywords", lambda w: F.length(w) > 3)
    hit = F.col("heading").contains(F.col("code")) | F.exists(words, lambda w: F.lower("heading").contains(F.lower(w)))
    pairs = sections.select(key, "section", "heading").crossJoin(F.broadcast(gates)).filter(hit)
    best = pairs.groupBy(key, "gate").agg(F.min_by("heading", F.struct(F.when(F.col("heading").contains(F.col("code")), 0).otherwise(1), "section")).alias("heading"))
    all_ = sections.select(key).distinct().crossJoin(F.broadcast(gates.select("gate")))
    return all_.join(best, [key, "gate"], "left").select(key, "gate", F.coalesce("heading", F.lit(default)).alias("heading"))


def ablation(sections: DataFrame) -> DataFrame:
    """What to do with each section: critical stays, gated ones over 500 tokens shrink, others over 1000 are cut, the rest stays. sections with tokens, critical, gated."""
    action = F.when(F.col("critical"), "critical").when(F.col("gated") & (F.col("tokens") > 500), "compress").when(F.col("tokens") > 1000, "prune").otherwise("keep")
    saved = F.when(action == "compress", F.col("tokens") - 500).when(action == "prune", F.col("tokens")).otherwise(0)
    return sections.withColumn("action", action).withColumn("saved", saved)


# Keywords that normalisation keeps, by language.
KEYWORDS = {
    "any": "if|else|for|while|return|def|class|import|from|in|and|or|not|the",
    "python": "if|elif|else|for|while|return|def|class|import|from|as|in|is|and|or|not|with|try|except|finally|raise|lambda|yield|pass|break|continue|None|True|False",
    "javascript": "if|else|for|while|do|return|function|class|import|from|export|const|let|var|new|this|try|catch|finally|throw|switch|case|break|continue|null|true|false",
    "java": "if|else|for|while|do|return|class|interface|import|package|public|private|protected|static|final|void|new|this|try|catch|finally|throw|switch|case|break|continue|null|true|false",
    "go": "if|else|for|range|return|func|package|import|type|struct|interface|var|const|go|defer|switch|case|break|continue|nil|true|false",
    "rust": "if|else|for|while|loop|return|fn|struct|enum|impl|trait|use|mod|pub|let|mut|match|break|continue|true|false",
}
COMMENTS = {"python": r"^#", "any": r"^(#|//)"}


def normalise_line(line: Column, language: str = "any", lexed: bool = False) -> Column:
    """Identifiers to <ID>, numbers and strings to <LIT>, the language's keywords kept, white space single; comment lines are empty. lexed: the line is code of lexed_lines(), which has
    neither comments nor strings left, so whatever looks like one is code."""
    keywords = KEYWORDS.get(language, KEYWORDS["any"]) if lexed else KEYWORDS[language]
    lits = F.regexp_replace(line if lexed else F.regexp_replace(line, r"\"[^\"]*\"|'[^']*'", "0"), r"\b[0-9]+(?:\.[0-9]+)?\b", "<LIT>")
    ids = F.regexp_replace(lits, rf"(?<![<\w])(?!(?:{keywords})\b)[A-Za-z_]\w*(?!\w*>)", "<ID>")
    shape = F.trim(F.regexp_replace(F.regexp_replace(ids, r"\b0\b", "<LIT>"), r"\s+", " "))
    return shape if lexed else F.when(F.trim(line).rlike(COMMENTS.get(language, r"^(//|/\*|\*)")), "").otherwise(shape)


def clone_groups(docs: DataFrame, key: str, text: str, size: int = 6, minimum: int = 2, language: str | None = None, lexed: bool = False) -> DataFrame:
    """Windows of `size` consecutive non-empty lines that stand at `minimum` places or more: fingerprint, sites. With a language, lines are compared as normalise_line() leaves them,
    so copies with other names and literals are clones too, and comment lines don't count. lexed: comments and strings that go over lines count as such (lexed_lines()), at the price of Python tasks."""
    if lexed:
        rows = lexed_lines(docs, key, text, language).select(key, "line_no", normalise_line(F.col("code"), language, True).alias("line")).filter("line <> ''")
    else:
        shape = F.trim("line") if language is None else normalise_line(F.col("line"), language)
        rows = exploded_lines(docs, key, text).withColumn("line", shape).filter("line <> ''")
    ahead = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, size - 1)
    w = rows.select(key, "line_no", F.collect_list("line").over(ahead).alias("ls")).filter(F.size("ls") == size)
    w = w.select(key, "line_no", F.sha2(F.array_join("ls", "\n"), 256).alias("fingerprint"))
    good = w.groupBy("fingerprint").agg(F.count("*").alias("sites")).filter(F.col("sites") >= minimum)
    return w.join(good, "fingerprint")


def merge_clones(sites: DataFrame, key: str, apart: int = 6, block: int = 256, fan: int = 256) -> DataFrame:
    """Findings of one file less than `apart` lines after the last one kept are dropped, in line order; of several on a line the one with the smallest fingerprint stays.

    Which lines stay depends on the lines before only by how many of the next ones are still barred: fewer than `apart`. So a block of lines is a function on that number,
    and functions compose (states_before()): no task reads a whole file. Null keys are one file; rows without a line go.
    """
    block, apart = max(block, apart), max(apart, 1)
    firsts = sites.filter("line_no is not null").groupBy(F.struct(F.col(key).alias("k")).alias("file"), F.col("line_no").cast("long").alias("l")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in sites.columns]), "fingerprint").alias("row"))
    firsts = settled(firsts)
    blocks = settled(firsts.groupBy("file", F.expr(f"l div {block}").alias("at")).agg(F.sort_array(F.collect_list("l")).alias("ls")))
    follows = blocks.select("file", (F.col("at") + 1).alias("at"), F.lit(True).alias("follows"))  # blocks right after another; before all others nothing is barred
    blocks = blocks.join(follows, ["file", "at"], "left").withColumn("follows", F.coalesce("follows", F.lit(False)))
    begin = F.col("at") * block
    none = F.array().cast("array<bigint>")

    def walk(barred: Column) -> Column:
        """struct(free: the first line that may stay, kept) after the block's lines."""
        step = lambda acc, x: F.when(x >= acc["free"], F.struct((x + apart).alias("free"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
        return F.aggregate("ls", F.struct((begin + barred).alias("free"), none.alias("kept")), step)

    after = lambda s: F.greatest(walk(F.when(F.col("follows"), s).otherwise(0).cast("long"))["free"] - begin - block, F.lit(0)).cast("int")
    functions = settled(blocks.select("file", "at", F.transform(F.sequence(F.lit(0), F.lit(apart - 1)), after).alias("f")))
    barred = states_before(functions, "file", fan, False).filter("state > 0")
    open_blocks = blocks.join(barred, ["file", "at"], "left").withColumn("state", F.when(F.col("follows"), F.coalesce("state", F.lit(0))).otherwise(0).cast("long"))
    kept = open_blocks.select("file", F.explode(walk(F.col("state"))["kept"]).alias("l"))
    return firsts.join(kept, ["file", "l"], "left_semi").select("row.*")


def text_metrics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """volume, branches and maintainability of each text from its token counts."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"[^a-z]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    branches = F.size(F.filter(words, lambda w: w.isin("if", "for", "while", "or", "and", "on", "in")))
    lines = F.greatest(F.size(lines_of(F.col(text))), F.lit(1))
    volume = n * F.log2(F.greatest(distinct, F.lit(2)))
    mi = (171.0 - 5.2 * F.ln(F.greatest(volume, F.lit(1.0))) - 0.23 * branches - 16.2 * F.ln(lines)) * 100.0 / 171.0
    return docs.select(key, volume.alias("volume"), branches.alias("branches"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), mi)).alias("maintainability"))


def parse_checklist(docs: DataFrame, key: str, text: str, default_size: str = "Medium") -> DataFrame:
    """Open items under the latest heading: key, line_no, heading, item, context (the first bullet that follows), size. Items in rejected sections are skipped."""
    rows = flagged_lines(docs, key, text).filter("not fenced")
    by = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("heading", F.last(F.when(F.col("line").rlike(r"^#+ "), F.trim(F.regexp_replace("line", r"^#+", ""))), ignorenulls=True).over(by))
    item = F.regexp_extract("line", r"^- \[ \] (.+)$", 1)
    rows = rows.withColumn("item", F.when(item != "", item)).withColumn("n", F.count("item").over(by))
    bullet = rows.filter(F.col("line").rlike(r"^ +- ") & (F.col("n") > 0)).groupBy(key, "n").agg(F.min_by(F.trim(F.regexp_replace("line", r"^ +- ", "")), "line_no").alias("context"))
    items = rows.filter("item is not null").filter(~F.coalesce(F.lower("heading").contains("rejected"), F.lit(False)))
    return items.join(bullet, [key, "n"], "left").select(key, "line_no", "heading", "item", "context", F.coalesce(F.when(F.col("context").rlike("(?i)size: *large"), "Large"), F.lit(default_size)).alias("size"))


def missing_sections(docs: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """Numbers of required sections (1 to n) without a heading outside fences: key, missing."""
    rows = flagged_lines(docs, key, text)
    found = F.collect_set(F.when(~F.col("fenced"), F.regexp_extract("line", r"^#+ *(\d+)\b", 1).try_cast("int")))
    return rows.groupBy(key).agg(found.alias("f")).select(key, F.explode(F.array_except(F.sequence(F.lit(1), F.lit(n)), "f")).alias("missing"))


def truncate_blocks(text: Column, budget: int, marker: str = "\n\n[truncated]") -> Column:
    """struct(text, truncated): text within the budget as it is, else cut at the last blank line inside it, with a marker."""
    head = F.left(text, F.lit(budget))
    at = F.locate("\n\n", F.reverse(head))
    cut = F.when(at > 0, F.left(head, F.length(head) - at - 1)).otherwise(head)
    long = F.length(text) > budget
    return F.struct(F.when(long, F.concat(F.rtrim(cut), F.lit(marker))).otherwise(text).alias("text"), long.alias("truncated"))


def pack_prefix(docs: DataFrame, by: str, order: str, levels: list[str], budget: int) -> DataFrame:
    """The largest prefix of each group, in order, whose texts joined by blank lines fit the budget (4 bytes a token): first level where all fit, else the last level's prefix."""
    w = Window.partitionBy(by).orderBy(order)
    fits, rows = [], docs
    for level in levels:
        running = F.sum(F.octet_length(level) + 2).over(w) - 2
        rows = rows.withColumn(f"__{level}", F.ceil(running / 4.0) <= budget)
        fits.append(F.min(F.col(f"__{level}").cast("int")).over(Window.partitionBy(by)) == 1)
    chosen = F.lit(levels[-1])
    for level, ok in reversed(list(zip(levels, fits, strict=True))):
        chosen = F.when(ok, level).otherwise(chosen)
    rows = rows.withColumn("level", chosen)
    keep = F.lit(False)
    for level in levels:
        keep = keep | ((F.col("level") == level) & F.col(f"__{level}"))
    return rows.filter(keep & F.lit(budget > 0)).select(by, order, "level")


def pack_greedy(docs: DataFrame, by: str, budget: int) -> DataFrame:
    """Greedy packing in order of rank and tokens with skips: cost is tokens + 5, what doesn't fit is skipped. docs: by, rank, tokens. Order-dependent, one pass a group:
    its rows come sorted in batches, and only what is left of the budget is carried on, so a group may have any size."""
    rows = docs.select(by, F.col("rank").cast("long").alias("rank"), F.col("tokens").cast("long").alias("tokens"))
    ordered = rows.repartition(by).sortWithinPartitions(by, F.asc_nulls_last("rank"), "tokens")

    def pack(batches):
        group, left, first = None, budget, True
        for batch in batches:
            taken = []
            for key, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if first or key != group:
                    group, left, first = key, budget, False
                ok = tokens is not None and tokens + 5 <= left
                left -= (tokens + 5) if ok else 0
                taken.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], [by, "rank", "tokens", "packed"])

    return ordered.mapInArrow(pack, f"`{by}` {docs.schema[by].dataType.simpleString()}, rank long, tokens long, packed boolean")
