"""Secret scans with corpus-wide ownership frequency (operator 7), DataFrame functions only.

Candidates are found in every text. Each candidate value's hash is counted by distinct repositories
and owners over the whole corpus: one found with many owners is a copied example, one that stays with
one owner and looks random is live. Provider-shaped candidates outside the base kinds are added as spans
only if they are live.

Edge cases: null text is empty; a null repository is one repository ''. Repeated rows are scanned each, and
count once for a repository. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import settle, sha_hex

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of AKIA[A-Z0-9]+ or [0-9a-f]+ that is long enough: the same spans as filtering all matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Shapes of provider credentials outside the base kinds.
PROVIDER = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{12,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+)?|AIza[A-Za-z0-9_-]{30,})"
KINDS = ("assign", "access", "hex", "provider")


def entropy(value: Column) -> Column:
    """Shannon entropy of a string's characters, in bits a character. Equal characters stand together once sorted, so one fold counts them."""
    chars = F.split(value, "")
    n = F.size(chars).cast("double")
    state = "struct<last:string,run:double,bits:double>"
    closed = lambda acc: acc["bits"] + F.when(acc["run"] > 0, acc["run"] / n * F.log2(acc["run"] / n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("bits")).cast(state)

    def step(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        return F.struct(c.alias("last"), F.when(same, acc["run"] + 1).otherwise(1.0).alias("run"), F.when(same, acc["bits"]).otherwise(closed(acc)).alias("bits")).cast(state)

    return -F.aggregate(F.array_sort(chars), start, step, closed)


def candidates(docs: DataFrame, repository: str = "source", owner: Column | None = None) -> DataFrame:
    """One row a document: __row, doc_id, repo, owner, and found: array of (start, rank, kind, end, value)."""
    owner = owner if owner is not None else F.split_part(F.coalesce(F.col(repository).cast("string"), F.lit("")), F.lit("/"), F.lit(1))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repo"), owner.alias("owner"))
    text = F.col("text")
    scanned = base.select(
        "doc_id",
        "repo",
        "owner",
        S.pieces(text, ASSIGN, text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), 2).alias("assign"),
        S.pieces(text, ACCESS, text.contains("AKIA")).alias("access"),
        S.pieces(text, HEX, text.rlike(HEX)).alias("hex"),
        S.pieces(text, PROVIDER, text.rlike(PROVIDER)).alias("provider"),
    )
    kept = scanned.select("doc_id", "repo", "owner", *[S.located(F.col(k), 0).alias(k) for k in KINDS])
    tagged = lambda k, r: F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(r).alias("rank"), F.lit(KINDS[r]).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    long_enough = F.filter(F.col("assign"), lambda s: F.length(s["value"]) >= 12)
    found = F.array_sort(F.concat(tagged(long_enough, 0), *[tagged(F.col(k), r) for r, k in list(enumerate(KINDS))[1:]]))
    return kept.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "repo", "owner", found.alias("found"))


def ownership(exploded: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners, n_docs. Pre-aggregated by hash, owner and repository, so a hot value shrinks before each shuffle."""
    each = exploded.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_docs"))


def scan_secrets(docs: DataFrame, repository: str = "source", owner: Column | None = None, copied_from: int = 3, min_entropy: float = 3.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, verdicts (one for each span).

    A value with copied_from owners or more is 'copied'; one with a single owner and at least min_entropy bits a character
    is 'live'; the others are 'unclear'.
    """
    table = settle(candidates(docs, repository, owner), "secret-candidates")
    exploded = table.select("__row", "repo", "owner", F.explode("found").alias("s")).select("__row", "repo", "owner", "s", F.sha2(F.col("s.value").cast("binary"), 256).alias("hash"))
    owned = ownership(exploded.select("hash", "owner", "repo"))
    verdict = F.when(F.col("n_owners") >= copied_from, "copied").when((F.col("n_owners") == 1) & (entropy(F.col("s.value")) >= min_entropy), "live").otherwise("unclear")
    judged = exploded.join(owned, "hash").select("__row", F.struct("s.start", "s.rank", "s.kind", "s.end", verdict.alias("verdict")).alias("s"))
    by_row = judged.groupBy("__row").agg(F.array_sort(F.collect_list("s")).alias("judged"))
    joined = table.select("__row", "doc_id", "found").join(by_row, "__row", "left")
    base = F.filter("found", lambda s: s["rank"] < 3)
    stay = F.coalesce(F.filter("judged", lambda s: (s["rank"] < 3) | (s["verdict"] == "live")), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,verdict:string>>"))
    rows = joined.select("doc_id", base.alias("base"), stay.alias("all"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    verdicts = lambda v: F.size(F.filter("all", lambda s: s["verdict"] == v)).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        sha_hex(S.joined(F.col("base"))).alias("base_sha256"),
        S.joined(F.col("all")).alias("spans"),
        verdicts("live").alias("n_live"),
        verdicts("copied").alias("n_copied"),
        F.array_join(F.transform("all", lambda s: s["verdict"]), ",").alias("verdicts"),
    )
