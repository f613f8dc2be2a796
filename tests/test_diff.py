"""Shortest line diffs against a whole-table longest common subsequence."""

import random

import pytest

from loomline.operators import sequences


def common(a, b):
    """Length of the longest common subsequence, by the whole table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def applied(script, a, b):
    """What a becomes by the script, which must go through both texts in order."""
    out, at = [], 0
    for op, i, j in script:
        out += a[at:i]
        at = i
        assert len(out) == j
        if op == "-":
            at += 1
        else:
            out.append(b[j])
    return out + a[at:]


@pytest.mark.parametrize("seed", range(8))
def test_scripts_are_shortest(seed):
    r = random.Random(seed)
    for _ in range(150):
        a = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 14))]
        b = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 14))] if r.random() < 0.5 else [x for x in a if r.random() < 0.8]
        script = sequences.edit_script(a, b)
        assert applied(script, a, b) == b
        assert len(script) == len(a) + len(b) - 2 * common(a, b)


def test_long_texts_with_few_changes():
    r = random.Random(1)
    a = [str(r.randint(0, 50)) for _ in range(20_000)]
    b = [x for k, x in enumerate(a) if k % 997] + ["end"]
    script = sequences.edit_script(a, b)
    assert applied(script, a, b) == b and len(script) <= 22


def test_line_diff_and_minimality(spark):
    moved = ("a\nb\nc\nd", "b\nc\nd\na")
    rows = [(1, *moved), (2, "x\ny", "x\n# note\n\nz"), (3, "same", "  same\n"), (4, None, "new"), (5, None, None), (6, "gone", "")]
    df = spark.createDataFrame(rows, "k int, old string, new string")
    diff = {}
    for r in sorted(sequences.line_diff(df, "k", "old", "new").collect(), key=lambda r: (r["k"], r["step"])):
        diff.setdefault(r["k"], []).append((r["op"], r["at_before"], r["at_after"], r["line"]))
    assert diff[1] == [("-", 0, 0, "a"), ("+", 4, 3, "a")]  # a moved line is a change
    assert diff[2] == [("-", 1, 1, "y"), ("+", 2, 1, "# note"), ("+", 2, 2, ""), ("+", 2, 3, "z")] and diff[4] == [("+", 0, 0, "new")] and 5 not in diff and diff[6] == [("-", 0, 0, "gone")]
    score = {r["k"]: r["minimality"] for r in sequences.patch_minimality(df, "k", "old", "new").collect()}
    assert score == pytest.approx({1: 1 - 0.5 * 2 / 8, 2: 0.5 * 0.5, 3: 1.0, 4: 0.75, 5: 1.0, 6: 1 - 0.5 * 1 / 2})
