"""Strongly connected components and cycles against plain Python."""

import random

import pytest

from loomline.operators import graph


def closure(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {d for s, d in edges if s == n} for n in nodes}
    while True:
        more = {n: reach[n].union(*[reach[m] for m in reach[n]]) for n in nodes}
        if more == reach:
            return reach
        reach = more


def elementary(edges):
    out, after = set(), {}
    for s, d in set(edges):
        after.setdefault(s, []).append(d)

    def walk(path):
        for d in after.get(path[-1], []):
            if d == path[0]:
                out.add(tuple(path))
            elif d > path[0] and d not in path:
                walk([*path, d])

    for n in after:
        walk([n])
    return out


@pytest.mark.parametrize("seed", [2])
def test_components_and_cycles(spark, seed):
    r = random.Random(seed)
    ring = [(100 + k, 100 + (k + 1) % 10) for k in range(10)]  # a cycle of ten nodes
    edges = ring + [(200, 201), (201, 200), (201, 202), (202, 203), (203, 202), (5, 5), (110, 100)] + [(r.randint(0, 24), r.randint(0, 24)) for _ in range(18)]
    df = spark.createDataFrame(edges, "src long, dst long")
    reach = closure(edges)
    want = {n: min(m for m in reach[n] | {n} if n in reach.get(m, ()) or m == n) for n in reach if any(n in reach[m] and m != n for m in reach[n])}
    assert {x["node"]: x["component"] for x in graph.strong_components(df).collect()} == want
    own = elementary(edges)
    assert {tuple(x["cycle"]) for x in graph.cycles(df, None).collect()} == own and tuple(range(100, 110)) in own
    assert {tuple(x["cycle"]) for x in graph.cycles(df, 3).collect()} == {c for c in own if len(c) <= 3}
    found = {x["component"]: x["cycle"] for x in graph.witness_cycles(df).collect()}
    assert set(found) == set(want.values())
    for c, cycle in found.items():
        assert cycle[0] == cycle[-1] == c and all(p in set(edges) for p in zip(cycle, cycle[1:], strict=False))
        assert len(cycle) - 1 == min(len(x) for x in own if x[0] == c and len(x) > 1)


def test_graphs_without_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 4)], "src long, dst long")
    assert graph.strong_components(df).count() == 0 and graph.witness_cycles(df).count() == 0
    assert [tuple(r["cycle"]) for r in graph.cycles(df, None).collect()] == [(4,)]
