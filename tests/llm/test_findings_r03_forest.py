"""op13_forest, the only finding of CHECK_r03.txt (unnumbered): rows and pairs that grew faster than the input."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from loomline.llm import forest  # noqa: E402

WORDS = [f"w{k}" for k in range(900)]


def test_long_unlike_texts_are_no_candidates(spark):
    """Bitmaps of 256 bits say nothing of sets of more than some 600 shingles: all long texts of a region were candidates of each other."""
    r = random.Random(3)
    common = " ".join(r.choices(WORDS, k=60))
    texts = {k: common + " " + " ".join(r.choices(WORDS, k=900)) for k in range(40)}
    texts |= {100 + k: texts[k].replace(f" {texts[k].split()[700]} ", " other ", 1) for k in range(10)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = forest.forest_table(df, 2, 64)
    rows = forest.orders(table.selectExpr("*", "doc_id as root"), 16, 4).coalesce(1).sortWithinPartitions("tree", "key", "doc_id")
    found = {(x["a"], x["b"]) for x in rows.mapInArrow(forest.neighbours(4, 256, 80), "a long, b long, depth long").collect() if x["b"] is not None}
    assert found >= {(k, 100 + k) for k in range(10)} and len(found) < 20  # a sketch may pass a few more


@pytest.mark.parametrize(("far", "exact"), [(1000, 0), (24, 1)])
def test_crowds_within_far_need_no_exact_join(spark, monkeypatch, far, exact):
    """Groups of near copies beyond the reach went to the exact join, whose index rows grew with their square; those beyond `far` still do, whole."""
    r, texts = random.Random(4), {}
    for g in range(4):
        base = r.choices(WORDS, k=60)
        for k in range(70):
            words = list(base)
            for _ in range(k % 7):
                words[r.randrange(60)] = r.choice(WORDS)
            texts[100 * g + k] = " ".join(words)
    calls, join = [], forest.exactly_linked
    monkeypatch.setattr(forest, "exactly_linked", lambda *a, **b: calls.append(1) or join(*a, **b))
    got = {x["doc_id"]: x["component_id"] for x in forest.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), reach=10, far=far, rounds=1).collect()}
    assert got == {i: c for i, (_, c) in brute.jaccard_components(texts, 2).items()}
    assert len(calls) == exact
