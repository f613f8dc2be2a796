"""Queries over all rows of the tables, on small tables made for the purpose."""

from collections import defaultdict

import pytest

from loomline.operators import findings, structure
from loomline.plans import registry


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def run(spark, name, folder):
    return registry.queries()[name](spark, folder)


@pytest.fixture(scope="module")
def graph_tables(spark, tmp_path_factory):
    """Keys beyond every former fold: a ring 1001 -> 2003 -> 3005 -> 1001, a pair, a hub, two orders of one supplier that share a part."""
    edges = [(1001, 2003), (2003, 3005), (3005, 1001), (500, 700), (700, 500), *[(900, 4000 + k) for k in range(40)], (7, 7)]
    items = [(k + 1, p, s) for k, (s, p) in enumerate(edges)] + [(9001, 2003, 1001), (9003, 2004, 1001)]
    orders = [(k, 1 + k * 7 % 13, ) for k in range(1, 400)]
    return write(
        spark, tmp_path_factory.mktemp("graphs") / "t",
        lineitem=(items, "l_orderkey long, l_partkey long, l_suppkey long"),
        part=([(k,) for k in (7, 2003, 3005, 8888)], "p_partkey long"),
        orders=(orders, "o_orderkey long, o_custkey long"),
        customer=([(k,) for k in range(1, 400, 9)], "c_custkey long"),
    )


def test_graph_findings_of_whole_keys(spark, graph_tables):
    assert {r["cycle"] for r in run(spark, "g6_cycles_whole", graph_tables).collect()} == {"500,700", "1001,2003,3005"}
    found = {(r["id"], r["what"]) for r in run(spark, "g3_graph_findings_whole", graph_tables).collect()}
    assert found == {(900, "hub"), (7, "orphan"), (8888, "orphan"), (500, "mutual")}
    assert {r["which"]: r["cyclic"] for r in run(spark, "g5_has_cycle_whole", graph_tables).collect()} == {"dag": False, "graph": True}
    clusters = {r["grp"]: r["clusters"] for r in run(spark, "g8_clusters_whole", graph_tables).collect()}
    assert clusters[1001] == 2 and clusters[900] == 40


def test_ranks_of_whole_keys(spark, graph_tables):
    ranks = {r["id"]: r["rank"] for r in run(spark, "g2_converged", graph_tables).collect()}
    assert set(ranks) == {7, 8888, 500, 700, 900, 1001, 2003, 2004, 3005, *range(4000, 4040)} and abs(sum(ranks.values()) - 1) < 1e-6
    out = defaultdict(set)
    for s, p in [(1001, 2003), (1001, 2004), (2003, 3005), (3005, 1001), (500, 700), (700, 500), *[(900, 4000 + k) for k in range(40)]]:
        out[s].add(p)
    want = dict.fromkeys(ranks, 1 / len(ranks))
    for _ in range(60):
        lost = sum(want[k] for k in want if k not in out)
        want = {k: 0.15 / len(ranks) + 0.85 * (sum(want[s] / len(out[s]) for s in out if k in out[s]) + lost / len(ranks)) for k in want}
    assert all(abs(ranks[k] - want[k]) < 2e-3 for k in ranks)


def test_blast_radius_of_whole_keys(spark, graph_tables):
    before = defaultdict(set)
    for k in range(1, 400):
        if k % 11:
            before[k + 2 + k * 7 % 13].add(k)
    want = set()
    for seed in range(1, 400, 9):
        seen, todo = set(), [seed]
        while todo:
            for x in before[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want |= {(seed, x) for x in seen}
    assert {tuple(r) for r in run(spark, "g4_blast_radius_whole", graph_tables).select("seed", "id").collect()} == want


def test_domain_strategy_sees_late_events(spark, tmp_path):
    rows = [(3, 1, "click"), (4, 1, "error"), (700, 1, "click"), (900, 1, "error"), (90_001, 2, "signup")]
    folder = write(spark, tmp_path / "t", events=(rows, "event_id long, user_id long, event_type string"))
    got = {r["domain"]: (r["tier"], r["successes"], r["requires_js"], r["delay"]) for r in run(spark, "w5_domain_strategy_whole", folder).collect()}
    assert got == {"d1": ("static", 2, True, 2.0), "d2": (None, 0, True, 0.5)}


REAL = {1: "so so it is\n`a a` ok", 2: "fixme now\n# 4 Last\n| a |\n|---|\n| 1 | 2 |", 3: "whitelisted", 4: "x \U000e0041y", 6: "it it"}


@pytest.fixture(scope="module")
def real_tables(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("real") / "t", documents=(list(REAL.items()), "doc_id long, text string"))


def test_real_texts_of_all_documents_are_looked_at(spark, real_tables):
    got = lambda name: {tuple(r) for r in run(spark, name, real_tables).collect()}
    assert got("f3_prose_whole") == {(1, 1, "DOUBLED"), (2, 1, "PLACEHOLDER"), (3, 1, "TERM1"), (3, 2, "TERM0"), (3, 3, "PLACEHOLDER"), (3, 4, "DOUBLED"), (6, 8, "DOUBLED")}
    assert got("f5_tables_whole") == {(1, 6, 2, 3), (2, 5, 1, 2)}
    assert got("f15_missing_sections_whole") == {(k, n) for k in REAL for n in range(1, 6)} - {(2, 4), (6, 1), (6, 3)}
    assert got("p7_unicode_tags_whole") == {(k, "AHi" if k == 4 else "Hi", 4 if k == 4 else 3) for k in REAL}


def test_doubled_word_late_in_a_long_line(spark):
    line = "ab cd " * 50_010 + "and and so"
    rows = structure.lint_prose(spark.createDataFrame([(1, line)], "k long, t string"), "k", "t").collect()
    assert [(r["line_no"], r["rule_id"]) for r in rows] == [(1, "DOUBLED")]


def test_canaries_of_any_length_and_number(spark):
    marks = [(0, "one two three four five six seven"), (1, "x y"), (2, "é"), (3, "wo three four five six sev"), (4, " two  three four\nfive six "), (5, "absent words are not in any text"), (6, ""), (7, None), (8, "a rather short one"), (8, "one"), (None, "six seven")]
    texts = [(1, "zone two three four five six sevenfold"), (1, "x y"), (2, "pre two  three four\nfive six x"), (3, None), (4, ""), (5, "caf\u00e9 a rather short one x"), (None, "one two three four five six seven")]
    marks += [(k, f"marker number {k} of so many markers that no limit holds") for k in range(100, 10_200)]
    texts.append((6, "see marker number 10150 of so many markers that no limit holds."))
    got = findings.canary_leaks(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame(marks, "c long, m string"), "c", "m").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, c) for k, t in texts for c, m in marks if t and m and m in t), key=str)


def test_rare_line_shapes_are_kept(spark, tmp_path):
    folder = write(spark, tmp_path / "t", documents=([(1, "return 5\nx = 1"), (2, "return 7")], "doc_id long, text string"))
    assert {tuple(r) for r in run(spark, "f10_token_classes", folder).collect()} == {("return <LIT>", 2), ("<ID> = <LIT>", 1)}


def test_greedy_pack_of_large_and_null_groups(spark):
    rows = spark.range(250_000).selectExpr("'big' AS k", "250000 - id AS rank", "id % 50 AS tokens").union(spark.createDataFrame([(None, 1, 5), (None, 2, 900), (None, 3, 7), ("a", 1, None), ("a", 2, 94), ("a", 3, 1)], "k string, rank long, tokens long"))
    got = defaultdict(list)
    for r in structure.pack_greedy(rows, "k", 100).filter("packed").collect():
        got[r["k"]].append(r["rank"])
    left, want = 100, []
    for rank in range(1, 250_001):
        if (cost := (250_000 - rank) % 50 + 5) <= left:
            left -= cost
            want.append(rank)
    assert {k: sorted(v) for k, v in got.items()} == {"big": want, None: [1, 3], "a": [2]}


def test_each_customer_has_its_tree(spark, tmp_path):
    folder = write(spark, tmp_path / "t", orders=([(k, k % 64 + 1) for k in range(1, 400)], "o_orderkey long, o_custkey long"))
    assert {r["tree"] for r in run(spark, "g9_tree", folder).collect()} == set(range(1, 65))
