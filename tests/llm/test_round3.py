"""Whitening, resampling and the LSH forest against plain Python, and rows that once broke earlier operators."""

import random
import sys
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from loomline.llm import forest, near, pii, quality, resampling, substring, whitening  # noqa: E402

rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdeéñ", k=rng.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def edited(text, seed, changes):
    r, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = r.choice(WORDS) + "x"
    return " ".join(words)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def near_texts():
    base, small = prose(100, 1), "alpha beta gamma delta epsilon zeta"
    out = {0: base, 1: base, 2: None, 3: "", 4: " \n\t ", 5: "One", 6: "one", 7: "one two", 8: "ONE  two"}
    out |= {10 + k: edited(base, k, k % 9) for k in range(40)}
    out |= {60 + k: prose(30, 100 + k) for k in range(60)}
    out |= {130: small, 131: small + " eta", 132: small + " eta theta", 133: "Zeta " + small}
    hot = "terms apply "  # a frequent pair of words in many short texts
    out |= {200 + k: hot + " ".join(random.Random(k).choices(WORDS, k=4)) for k in range(150)}
    out |= {400 + k: edited(prose(60, 300 + k // 3), 900 + k, k % 3 * 2) for k in range(90)}
    out |= {600: "word " * 30_000 + base, 601: "word " * 20_000 + base, 602: prose(20_000, 77)}
    return out


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, "z") for k, t in texts.items()], "doc_id long, text string, `a.b` int, keys string")


def test_forest_equals_all_pairs(spark):
    texts = near_texts()
    want = sorted(((i, n, c, i == c) for i, (n, c) in brute.jaccard_components(texts, 2).items()), key=repr)
    got = forest.near_duplicates(frame(spark, texts))
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == want


@pytest.mark.parametrize("reach", [3, 40])
def test_forest_of_crowds(spark, reach):
    """Groups of near copies larger than the reach, each linked mostly with its own original; ranges of few rows."""
    texts = {k: edited(prose(40, k // 50), k, k % 4) for k in range(600)}
    want = {i: c for i, (_, c) in brute.jaccard_components(texts, 3, 60).items()}
    got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(frame(spark, texts), 3, 60, trees=16, depth=6, reach=reach, rounds=1).collect()}
    assert got == want


def test_forest_candidates_and_flags(spark):
    """A sorted region over several ranges: rows within reach meet, unless a range ends between them, and rows with unseen ones around them are reported."""
    n, reach = 30, 4
    table = spark.createDataFrame([(0, b"\0\0\0\1" * 2, i, i, 5, b"\0" * 8 * forest.LONGS) for i in range(n)] + [(1, bytes([i] * 8), i, i, 5, b"\0" * 8 * forest.LONGS) for i in range(n)], forest.ROW)
    for parts in (1, 3):
        found = table.repartitionByRange(parts, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id").mapInArrow(forest.neighbours(2, reach, 80), "a long, b long, depth long").collect()
        pairs = {(r["a"], r["b"]) for r in found if r["b"] is not None}
        lost = {r["a"] for r in found if r["b"] is None}
        close = {(i, j) for i in range(n) for j in range(i + 1, min(n, i + reach + 1))}
        assert pairs <= close and (parts > 1 or pairs == close)
        assert all(x in lost for p in close - pairs for x in p)
        assert lost == set(range(n))  # all of them see only a part of the region
    apart = table.filter("tree = 1").coalesce(1).sortWithinPartitions("key").mapInArrow(forest.neighbours(2, reach, 80), "a long, b long, depth long").collect()
    assert {r["a"] for r in apart} == {0, n - 1}


def test_forest_ids_shared_null_repeated_and_empty(spark):
    base = prose(30, 5)
    df = spark.createDataFrame([(1, base), (1, base), (2, base), (3, "x y z"), (3, "another text"), (None, base), (None, None), (9, "")], "doc_id long, text string")
    got = rows(forest.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")
    assert len(got) == 8
    assert got.count((1, 29, 1, True)) == 2 and (2, 29, 1, False) in got and (9, 0, 9, True) in got
    assert forest.near_duplicates(df.limit(0)).count() == 0
    only = forest.near_duplicates(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string").coalesce(1))
    assert rows(only, "doc_id", "component_id") == [(1, 1), (2, 2)]


def resample_texts():
    target = [prose(40, 500 + k) + " aims here" for k in range(8)] + [None, ""]
    docs = [(k, prose(10 + k, k)) for k in range(60)] + [(70 + k, target[k % 8] + " " + prose(5, k)) for k in range(20)]
    docs += [(100, None), (101, ""), (102, "--- !!! \x00"), (103, "A-B_c.d É9 ñ"), (104, "Ünï code " * 30), (104, "Ünï code " * 30), (104, "other words of the same id " * 9), (None, "no id " * 20), (None, "no id but longer " * 20), (105, "a b " * 40_000)]
    return docs, target


def test_resampling_equals_plain_python(spark):
    docs, target = resample_texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, buckets string, `n.words` int")
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (25, 100, 0, 1):
        got = rows(resampling.resample(df, aims, percent), "doc_id", "n_features", "weight", "score", "rank")
        assert got == sorted(brute.resampled(docs, target, percent), key=repr)
    drawn = resampling.draw_documents(df, aims)
    assert drawn.columns == df.columns
    assert drawn.count() == sum(r[4] is not None for r in brute.resampled(docs, target))


def test_resampling_of_empty_tables(spark):
    docs, target = resample_texts()
    df, aims = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    assert resampling.resample(df.limit(0), aims).count() == 0
    assert rows(resampling.resample(df, aims.limit(0)), "doc_id", "n_features", "weight", "score", "rank") == sorted(brute.resampled(docs, []), key=repr)


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_scanner_emits_all_ngrams(orders):
    text = resampling.collapsed("One, two;  THREE-vier é".encode())
    assert text == "one two three vier é".encode()
    words = text.split(b" ")
    want = sorted(b" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1))
    import zlib

    assert sorted(resampling.feature_buckets(text, resampling.scanner(orders), 65_536).tolist()) == sorted(zlib.crc32(g) % 65_536 for g in want)
    assert not len(resampling.feature_buckets(b"", resampling.scanner(orders), 100))


def test_whitening_equals_whole_matrices(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] + 5
    good = base.astype(np.float32).tolist() + [base[0].astype(np.float32).tolist()] * 40
    bad = [None, [], [1.0, None, 0, 0, 0, 0], [float("nan")] * 6, [float("inf"), 0, 0, 0, 0, 0], [1.0, 2.0]]
    df = spark.createDataFrame([(k, [float(c) if c is not None else None for c in v] if v is not None else None, 1) for k, v in enumerate(good + bad)], "vec_id long, embedding array<float>, x int")
    got = whitening.whiten(df).toPandas()
    n, sums, deviation, values, vectors = brute.whitened(good)
    assert len(got) == 4 * len(good) and set(got["n"]) == {n} and n == 300
    assert set(got["identity_error"]) == {got["identity_error"][0]} and got["identity_error"][0] < 1e-12
    x = np.floor(256 * np.array(good, np.float64)) - np.array(sums) / n
    for c in range(4):
        own = got[got["component"] == c + 1].sort_values("vec_id")
        assert own["deviation"].tolist() == deviation
        want = x @ np.array(vectors[c]) / np.sqrt(values[c])
        sign = np.sign(want[0] * own["whitened"].iloc[0])
        assert np.allclose(sign * own["whitened"], want, rtol=0, atol=1e-11)
        assert np.isclose(own["explained"].iloc[0], values[c] / sum(values), rtol=1e-12)


def test_whitening_of_few_equal_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    whiten = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema))
    assert whiten([(1, None)]).count() == 0
    assert whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    line = whiten([(1, [0.0, 0.0]), (1, [1.0, 1.0]), (None, [2.0, 2.0])]).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 3
    assert sorted(round(abs(r["whitened"]), 6) for r in line) == [0.0, 1.224745, 1.224745]
    huge = {(r["vec_id"], r["component"]): r for r in whiten([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1e5])]).collect()}
    assert len(huge) == 6 and huge[1, 1]["deviation"] is None and huge[3, 1]["deviation"] == (2 * 256 * 10**5) ** 2
    assert max(r["identity_error"] for r in huge.values()) < 1e-9
    # what is below the precision of the largest eigenvalue is no component
    assert {r["component"] for r in whiten([(1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [7.0, 1.0])]).collect()} == {1}


def residual(square, values, vectors):
    """The largest |A v - e v|, in fractions of the largest eigenvalue, computed exactly."""
    worst = Fraction(0)
    for e, v in zip(values, vectors.T, strict=True):
        v, e = [Fraction(float(c)) for c in v], Fraction(float(e))
        worst = max(worst, max(abs(sum(a * c for a, c in zip(row, v, strict=True)) - e * x) for row, x in zip(square, v, strict=True)))
    return float(worst / Fraction(float(values[0])))


@pytest.mark.parametrize("spectrum", [(9, 4, 2, 1, 0.5), (1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.25), (3, 3, 3, 1, 1), (1, 1e-3, 1e-6, 1e-9, 1e-12), (2 + 1e-13, 2, 1, 0.1, 0)])
def test_eigenvectors_of_close_and_far_eigenvalues(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(5, 5)))
    square = [[sum(Fraction(float(q[i, k])) * Fraction(s) * Fraction(float(q[j, k])) for k, s in enumerate(spectrum)) for j in range(5)] for i in range(5)]
    values, vectors = whitening.eigen(square, 5)
    assert len(values) == sum(s > 1e-15 for s in spectrum)
    assert residual(square, values, vectors) < 4e-16
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-15
    assert np.allclose(values, [s for s in spectrum if s > 1e-15], rtol=1e-12)
    if spectrum[0] == 1 + 1e-9:  # a cluster that float32 and float64 starts cannot tell apart: single vectors are still right
        off = [1 - abs(float(q[:, k] @ vectors[:, k])) for k in range(3)]
        assert max(off) < 1e-12


EMPTY = [(1, None), (2, ""), (3, " \n "), (4, "...")]


@pytest.mark.parametrize("texts", [[(1, ""), (2, None)], [(1, ". . ."), (2, ", ;")], [(1, "same text"), (2, "same text"), (3, None), (4, "")]])
def test_tasks_without_words(spark, texts):
    """All rows in one task, none of them or only some with words."""
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en")).coalesce(1)
    assert near.near_components(df).count() == len(texts)
    want = {r[0] for r in texts} - ({2} if texts[0][1] == "same text" else set())
    assert {r["doc_id"] for r in near.keep_one(df).collect()} == want
    assert quality.quality_verdicts(df).filter("kept").count() == 0
    dots = df.withColumn("text", F.lit(". , ! " * 40))
    assert quality.quality_verdicts(dots).count() == len(texts)


def test_names_with_dots_and_clashes(spark):
    passage = prose(60, 9)
    df = spark.createDataFrame(
        [(k, f"{passage} {prose(80, k)} mail a{k}@b.co", "en", "s", 9, k, "doc", "row", "items", "kept") for k in range(6)],
        "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, doc string, row string, items string, text_ string",
    )
    for stage in (quality.keep_good, near.keep_one, substring.strip_text, pii.redact):
        out = stage(df)
        assert out.columns == df.columns
        assert {(r["a.b"], r["doc"], r["row"], r["items"], r["text_"]) for r in out.collect()} == {(k, "doc", "row", "items", "kept") for k in range(6)}


def test_personal_data_in_very_long_texts(spark):
    """One match of a million characters, many thousands of short ones, and long runs that are none; marks that the text has itself."""
    texts = {
        0: "a@" + "b." * 500_000,
        1: " ".join(f"u{i}@x.co" for i in range(30_000)),
        2: "7" * 4_000 + " x 4111 1111-1111 1111",
        3: "a@b..c@d.e a@.b.c a@b.c. a@b.c_d@e.f xy@z.co 12 a@bc  qr@s.t 41111111 1111 1111",
        4: "+1" + "(" * 200_000,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")) for r in pii.pii_spans(df).collect()}
    assert got == {k: brute.pii(t) for k, t in texts.items()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[1] == " ".join(["[EMAIL]"] * 30_000) and clean[0] == "[EMAIL]." and clean[2].endswith("7 x [CARD]")
    names = {0: "Dr. Ab" + "-Cd" * 100_000, 1: "Mr. Jo" + "o" * 300_000, 2: "Ms. Anna Maria-Luisa Meyer wrote"}
    found = {r["doc_id"]: r["spans"] for r in pii.pii_spans(spark.createDataFrame(list(names.items()), "doc_id long, text string")).collect()}
    assert all(len(s) < 100 for s in found.values())


def test_running_values_and_overlaps(spark):
    from loomline.llm import spans

    r = random.Random(2)
    lists = [[], [5], [0, 0], [r.randint(0, 9) for _ in range(97)], [r.randint(0, 9) for _ in range(100)]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<int>").select("k", "v", spans.running_sums(F.col("v")).alias("s"), spans.running_maxima(F.col("v")).alias("m"))
    for row in df.collect():
        assert row["s"] == [sum(row["v"][:i]) for i in range(len(row["v"]))]
        assert row["m"] == [max([0, *row["v"][:i]]) for i in range(len(row["v"]))]
    own = [(3 * i, 3 * i + r.randint(1, 3)) for i in range(1, 50)]
    asked = [(a, a + n) for a in range(160) for n in (1, 2, 5)]
    table = spark.createDataFrame([(own, asked), ([], asked)], "own array<struct<start:int,end:int>>, asked array<struct<start:int,end:int>>")
    got = table.select(F.transform("asked", lambda s: spans.touched(F.col("own"), s["start"], s["end"])).alias("hit")).collect()
    assert got[0]["hit"] == [any(a < e and s < b for s, e in own) for a, b in asked] and not any(got[1]["hit"])
