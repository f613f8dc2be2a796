"""Findings of the third round in the corpus operators: each of these failed before its mend."""

import random
import re
from pathlib import Path

from loomline.llm import common, substring


def resident():
    return int(re.search(r"\nPrivate_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_python_tasks_give_memory_back():
    """pipeline, in pii: workers of the stages before it held what they once needed."""
    pins = []

    def task(batches):
        held = [b"x" * 100_000 for _ in range(2_000)]
        pins.extend(held[::20])
        yield from batches

    before = resident()
    assert list(common.tidy(task)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60


def python_steps(plan, above=0):
    """The most Python steps that one task of a plan has running at a time."""
    name = plan.nodeName()
    above = 0 if "Exchange" in name else above + name.startswith("MapInArrow")
    return max([above, *[python_steps(plan.children().apply(i), above) for i in range(plan.children().size())]])


def test_stripping_is_one_python_step(spark):
    """pipeline, in substring: texts that lose nothing went through two Python workers in one task."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    shared = " ".join(r.choices(words, k=40))
    texts = [(k, f"{' '.join(r.choices(words, k=30))} a{k} {shared if k % 3 == 0 else ''} z{k} {' '.join(r.choices(words, k=30))}") for k in range(30)]
    rows = [*texts, (None, texts[0][1]), (None, None), (31, None), (32, ""), (5, "another text of the same id"), (7, texts[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    done = substring.remove_substrings(df)
    plan = done._jdf.queryExecution().executedPlan()
    assert python_steps(plan.initialPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan) == 1
    got = [(x["doc_id"], x["n_words"], x["n_removed"]) for x in done.collect()]
    counted = lambda k, t: (k, len((t or "").split()), 40 if t and k and k % 3 == 0 and k < 30 else 0)
    want = [counted(*x) for x in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
