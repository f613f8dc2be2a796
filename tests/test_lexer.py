"""Lexed lines against a scan of whole texts, character by character."""

import random

import pytest

from loomline.operators import lexer, structure

rng = random.Random(5)
PIECES = {
    "rust": ["/*", "*/", "//", '"', "\\", "\n", "\n", "'\"'", "'\\''", "a", "1", " ", "/*/"],
    "go": ["/*", "*/", "//", '"', "`", "'", "\\", "\n", "\n", "a", " "],
    "java": ["/*", "*/", "//", '"', '"""', "'", "\\", "\n", "\n", "a", " "],
    "python": ["#", '"', "'", '"""', "'''", "\\", "\n", "\n", "a", " "],
    "html": ["<!--", "-->", "<b>", "\n", "-", "a"],
}
NULLS_TEXT = {k: "".join(rng.choices(v, k=60)) + "x" for k, v in PIECES.items()}


def character(line, i):
    """The character literal that begins there: one character, an escaped quote, or a backslash and what comes before the next quote."""
    if line[i] != "'":
        return None
    if line[i + 1 : i + 2] == "\\":
        end = line.find("'", i + 2)
        end = i + 3 if end == i + 2 and line[i + 3 : i + 4] == "'" else end
        return line[i : end + 1] if end > i + 2 else None
    return line[i : i + 3] if line[i + 2 : i + 3] == "'" and line[i + 1] != "'" else None


def scanned(text, language):
    """[(code, comment)] of each line, by one walk over the whole text with the mode carried along."""
    lx = lexer.LANGUAGES[language]
    lines, code, comment, mode, depth, i = [], "", "", "code", 0, 0
    while i <= len(text):
        if i == len(text) or text[i] == "\n":
            lines.append((code, comment))
            mode = "code" if mode == "line" or mode in lx.short_strings else mode
            code, comment, i = "<LIT>" if mode in lx.long_strings else "", "", i + 1
            continue
        here = lambda *marks: next((m for m in sorted(marks, key=len, reverse=True) if text.startswith(m, i)), None)  # noqa: B023, E731
        step = 1
        if mode == "code":
            atom = character(text.split("\n", text.count("\n", 0, i) + 1)[text.count("\n", 0, i)], i - text.rfind("\n", 0, i) - 1) if language == "rust" else None
            mark = here(*lx.line, *(lx.block or ())[:1], *lx.long_strings, *lx.short_strings)
            if atom or mark:
                step = len(atom or mark)
            if atom:
                code += "<LIT>"
            elif mark in lx.line:
                mode, comment = "line", comment + mark
            elif lx.block and mark == lx.block[0]:
                mode, depth, comment = "block", 1, comment + mark
            elif mark:
                mode, code = mark, code + "<LIT>"
            else:
                code += text[i]
        elif mode == "line":
            comment += text[i]
        elif mode == "block":
            mark = here(*lx.block) if lx.nested else here(lx.block[1])
            step = len(mark or " ")
            comment += text[i : i + step]
            depth += {None: 0, lx.block[0]: 1, lx.block[1]: -1}[mark]
            mode = mode if depth else "code"
        elif text.startswith(mode, i):
            step, mode = len(mode), "code"
        elif text[i] == "\\" and mode not in lx.raw and text[i + 1 : i + 2] not in ("", "\n"):
            step = 2
        i += step
    return lines


@pytest.mark.parametrize("language", sorted(PIECES))
def test_lexed_lines_equal_a_scan(spark, language):
    """Blocks of three lines in groups of two, so that states come down several levels."""
    texts = {k: "".join(rng.choices(PIECES[language], k=rng.choice((3, 30, 150)))) + "x" for k in range(60)}
    df = spark.createDataFrame([*texts.items(), (97, None), (98, ""), (None, NULLS_TEXT[language])], "k long, t string")
    got = {}
    for r in lexer.lexed_lines(df, "k", "t", language, block=3, fan=2).collect():
        got.setdefault(r["k"], []).append((r["line_no"], r["code"], r["comment"]))
    texts[None] = NULLS_TEXT[language]
    assert set(got) == set(texts)
    for k, text in texts.items():
        assert [x[1:] for x in sorted(got[k])] == scanned(text, language), (k, text)


def test_nested_comments_close_at_their_depth(spark):
    text = "a\n/* one /* two\nb\n*/ still\n*/ c // d\n" + "/* " * 40 + "\n" + "e\n" * 30 + "*/ " * 39 + "\nf\n*/ g"
    rows = sorted(lexer.lexed_lines(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", "rust", block=4, fan=3).collect(), key=lambda r: r["line_no"])
    code = {r["line_no"]: r["code"].strip() for r in rows if r["code"].strip()}
    assert code == {1: "a", 5: "c", len(rows): "g"}
    assert max(r["state"] for r in rows) == 41  # one string state, depth 40


def test_clones_of_lexed_code(spark):
    """Comments over lines don't keep copies apart, and code inside them is no clone."""
    one = "fn a() {\n  let x = 1;\n/* note\n let y = 2;\n*/\n  go(x);\n}"
    two = "fn b() {\n  let z = 7;\n  run(z);\n}\n/*\nfn a() {\nlet q = 1;\ngo(q);\n}\n*/"
    df = spark.createDataFrame([(1, one), (2, two)], "k long, t string")
    sites = structure.clone_groups(df, "k", "t", size=4, language="rust", lexed=True).collect()
    assert sorted((r["k"], r["line_no"]) for r in sites) == [(1, 1), (2, 1)]
    star = structure.clone_groups(spark.createDataFrame([(1, "*p = 1\n*q = 2"), (2, "*a = 5\n*b = 6")], "k long, t string"), "k", "t", size=2, language="go", lexed=True)
    assert star.count() == 2


def test_merged_clones_equal_one_walk_a_file(spark):
    """Dense, sparse and repeated lines over many blocks, in groups of two and three; a null key; other columns stay with their row."""
    rows = []
    for k in [*range(12), None]:
        line = 0
        for _ in range(rng.choice((1, 5, 80))):
            line += rng.choice((0, 1, 1, 2, 5, 6, 7, 40)) if k != 3 else 1
            rows.append((k, line, f"f{rng.random()}", f"x{len(rows)}"))
    want, last = [], {}
    for k, line, fingerprint, x in sorted(rows, key=lambda r: (repr(r[0]), r[1], r[2])):
        if k not in last or line - last[k] >= 6:
            want.append((k, line, fingerprint, x))
            last[k] = line
    df = spark.createDataFrame(rows, "k long, line_no int, fingerprint string, `a.b` string")
    for block, fan in ((6, 2), (7, 3), (256, 256)):
        got = structure.merge_clones(df, "k", 6, block, fan)
        assert got.schema == df.schema
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), (block, fan)
    assert structure.merge_clones(df.limit(0), "k").count() == 0
