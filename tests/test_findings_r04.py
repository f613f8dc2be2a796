"""Findings of the fourth round: each of these failed before its mend."""

import math
import zlib

import duckdb

from loomline.operators import sequences
from loomline.plans import registry

ODD = [(1, "a b  a"), (2, None), (3, ""), (4, " \n\t"), (5, "　"), (6, " x"), (7, "y"), (7, "y"), (8, "z"), (8, None), (9, None), (9, ""), (None, "w"), (None, None)]


def test_every_document_has_its_row_in_feature_hash(spark, tmp_path):
    """documents of null text or null or repeated doc_id lost rows, and texts without words had norm 0."""
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", ODD)
    con.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    got = registry.queries()["p17_feature_hash"](spark, str(tmp_path)).select("doc_id", "norm", "size").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(registry.oracles()["p17_feature_hash"]).fetchall(), key=repr)


def test_hashed_features_against_a_plain_count(spark):
    """a null key's vector was zeros; keys without names keep theirs."""
    rows = [(1, "a"), (1, "b"), (1, "a"), (1, ""), (1, None), (2, ""), (3, None), (None, "é"), (None, "c")]
    got = {r["k"]: r["vector"] for r in sequences.hash_features(spark.createDataFrame(rows, "k int, name string"), "k", "name", 8).collect()}
    assert set(got) == {1, 2, 3, None}
    for key, vector in got.items():
        want = [0] * 8
        for k, name in rows:
            if k == key and name:
                want[zlib.crc32(name.encode()) % 8] += 1
        assert all(math.isclose(x, y / (math.hypot(*want) or 1)) for x, y in zip(vector, want, strict=True))
