"""SQL names for text functions, and registries of rules and indicators."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from ..operators.findings import Rule

RULES: dict[str, Rule] = {}
INDICATORS: dict[str, tuple[Column, Column]] = {}


def register_rule(rule_id: str, severity: str, *patterns: str, test=None, family: str = "custom") -> Rule:
    """Add a line rule for scan_text (pass RULES.values())."""
    RULES[rule_id] = Rule(rule_id, severity, patterns, test, family)
    return RULES[rule_id]


def register_sli(name: str, good: Column, valid: Column) -> None:
    """Add an indicator for measure (pass INDICATORS)."""
    INDICATORS[name] = (good, valid)


FUNCTIONS = {
    "token_count38": "(t STRING) RETURNS BIGINT RETURN CASE WHEN coalesce(t, '') = '' THEN 0 ELSE greatest(1, cast(floor(length(t) / 3.8) AS BIGINT)) END",
    "token_words": r"(t STRING) RETURNS BIGINT RETURN size(filter(split(coalesce(t, ''), '\\s+'), w -> w <> ''))",
    "compat_series": r"(v STRING) RETURNS STRING RETURN CASE WHEN try_cast(regexp_extract(v, '^v?(\\d+)', 1) AS INT) > 0 THEN regexp_extract(v, '^v?(\\d+)', 1) ELSE concat('0.', regexp_extract(v, '^v?\\d+\\.(\\d+)', 1)) END",
}


def register_sql(spark: SparkSession) -> None:
    """Temporary SQL functions that inline into plans, and find_lines as a table function."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("find_lines", FindLines)


@udtf(returnType=StructType().add("line_no", IntegerType()).add("line", StringType()))
class FindLines:
    """find_lines(text, pattern): the lines of a text in which a pattern occurs, for LATERAL joins."""

    def eval(self, text: str, pattern: str):
        import re

        for n, line in enumerate((text or "").split("\n"), 1):
            if re.search(pattern, line):
                yield n, line
