"""Column functions over text: lines, token estimates, redaction, classification, versions, small scores."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The credential shapes that redaction replaces, in order.
SECRET_SHAPES = (
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bghp_[a-zA-Z0-9]{36}\b",
    r"\bgithub_pat_[a-zA-Z0-9_]{50,}\b",
    r"\bsk-[a-zA-Z0-9]{20,}\b",
    r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----",
    r"\bBearer\s+[a-zA-Z0-9_\-\.]{20,}\b",
    r"""(?i)\b(?:api_key|auth_token|secret_key|password)\s*[:=]\s*['"][^'"]{8,}['"]""",
)
#: What a lower-cased text must hold for one of these shapes to be in it: texts without any are left as they are.
SHAPE_NEEDS = ("akia", "ghp_", "github_pat_", "sk-", "private key-----", "bearer", "api_key", "auth_token", "secret_key", "password")
# Internal host names and home folders.
INTERNAL_HOST = r"(?i)\b[a-zA-Z0-9_\-\.]+\.(?:lan|local|internal|corp|home|priv)\b"
HOME_PATH = r"/(?:home|Users)/[a-zA-Z0-9_\-]+"


def lines_of(text: Column) -> Column:
    """Lines without their ends; one trailing end adds no empty line; no lines for an empty or null text."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def token_count(text: Column, method: str = "chars38", ratio: float = 4.0) -> Column:
    """Estimated tokens: chars38 = characters / 3.8 rounded down, at least 1; bytes = UTF-8 bytes / ratio rounded up, at least 1;
    chars4 = characters / 4 rounded up, at least 1 even if blank; words = white-space separated words."""
    text = F.coalesce(text, F.lit(""))
    if method == "chars38":
        return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 3.8))).cast("long")
    if method == "bytes":
        return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(ratio)))).cast("long")
    if method == "chars4":
        return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")
    if method == "words":
        return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")
    raise ValueError(f"no token estimate named {method}")


def redact_secrets(text: Column, shapes: Iterable[str] = SECRET_SHAPES, mark: str = "[REDACTED_SECRET]") -> Column:
    """struct(text, n): every shape replaced in turn, each seeing the result of the one before; n counts replacements."""
    out, n, shapes = text, F.lit(0), tuple(shapes)
    for shape in shapes:
        n = n + F.coalesce(F.regexp_count(out, F.lit(shape)), F.lit(0))
        out = F.regexp_replace(out, shape, mark.replace("$", r"\$"))
    done = F.struct(out.alias("text"), n.cast("long").alias("n"))
    if shapes != SECRET_SHAPES:
        return done
    low = F.lower(text)
    return F.when(reduce(or_, [low.contains(x) for x in SHAPE_NEEDS]), done).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))


def redact_hosts_paths(text: Column) -> Column:
    """struct(text, hosts, paths): internal host names become example.com, home folders /home/user."""
    hidden = F.regexp_replace(text, INTERNAL_HOST, "example.com")
    path = HOME_PATH + r"(?=/|$)"
    return F.struct(
        F.regexp_replace(hidden, path, "/home/user").alias("text"),
        F.coalesce(F.regexp_count(text, F.lit(INTERNAL_HOST)), F.lit(0)).cast("long").alias("hosts"),
        F.coalesce(F.regexp_count(hidden, F.lit(path)), F.lit(0)).cast("long").alias("paths"),
    )


def decode_tags(text: Column) -> Column:
    """struct(decoded, n): Unicode tag characters (U+E0000 to U+E007F) and the ASCII that the printable ones spell."""
    tags = F.regexp_extract_all(text, F.lit(r"[\x{E0000}-\x{E007F}]"), F.lit(0))
    shown = F.filter(tags, lambda c: c.rlike(r"[\x{E0020}-\x{E007E}]"))
    # the last UTF-8 byte and the low bits of the one before give the ASCII code
    code = lambda c: (F.conv(F.substring(F.hex(F.encode(c, "UTF-8")), 5, 2), 16, 10).cast("int") % 64) * 64 + F.conv(F.substring(F.hex(F.encode(c, "UTF-8")), 7, 2), 16, 10).cast("int") % 64
    return F.struct(F.array_join(F.transform(shown, lambda c: F.char((code(c) % 128).cast("long"))), "").alias("decoded"), F.size(tags).cast("long").alias("n"))


def first_match(text: Column, rules: Iterable[tuple[str, str]], default: str | None) -> Column:
    """The label of the first pattern found, else the default."""
    out = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(default)


def semver(version: Column) -> Column:
    """struct(major, minor, patch) of a version, a leading v allowed; null where it is none. Structs compare in order."""
    number = lambda k: F.coalesce(F.regexp_extract(version, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", k).try_cast("int"), F.lit(0))
    return F.when(version.rlike(r"^v?\d+"), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")))


def compat_series(version: Column) -> Column:
    """The series within which upgrades are compatible: the major number, or 0.minor."""
    v = semver(version)
    return F.when(v["major"] > 0, v["major"].cast("string")).otherwise(F.concat(F.lit("0."), v["minor"].cast("string")))


def entropy(shares: Column, tau: float = 0.45) -> Column:
    """struct(raw, normalised, high) of an array of probabilities: Shannon bits, over log2 of at least two outcomes, flagged from tau."""
    some = F.filter(shares, lambda p: p > 0)
    raw = F.aggregate(some, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    norm = F.when(F.size(some) == 0, 0.0).otherwise(raw / F.log2(F.greatest(F.size(some), F.lit(2))))
    return F.struct(raw.alias("raw"), norm.alias("normalised"), (norm >= tau).alias("high"))


def slugify(heading: Column) -> Column:
    """A heading's anchor: markup and punctuation go, spaces become hyphens one by one."""
    plain = F.regexp_replace(F.regexp_replace(heading, r"`([^`]*)`", "$1"), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(plain)), r"[^\w\s-]", ""), r"\s", "-")


def md_escape(text: Column) -> Column:
    """Backslashes before Markdown's special characters."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>])", r"\\$1")


def md_fence(text: Column) -> Column:
    """A fence of backticks longer than any run in the text, three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def backoff(attempt: Column, retry_after: Column, base: float = 0.5, cap: float = 30.0) -> Column:
    """Seconds to wait at most: what the server asked for, else base doubled by each attempt, up to the cap."""
    return F.coalesce(retry_after.cast("double"), F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt)))


def jitter(key: Column, upper: Column, lower: float = 0.1) -> Column:
    """A wait between lower and upper that depends on the key alone."""
    return F.lit(lower) + (F.greatest(upper, F.lit(lower)) - F.lit(lower)) * (F.pmod(F.xxhash64(key), F.lit(1_000_000)) / F.lit(1_000_000.0))


def coerce(value: Column, kind: str, choices: Iterable[str] = ()) -> Column:
    """struct(value, error): a typed answer as text; an error message where it is not one."""
    word = F.lower(F.trim(value))
    if kind == "bool":
        got = F.when(word.isin("true", "yes", "on", "1"), "true").when(word.isin("false", "no", "off", "0"), "false")
    elif kind == "int":
        got = F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("bigint").cast("string"))
    elif kind == "number":
        got = F.when(F.trim(value).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(value).try_cast("double").cast("string"))
    elif kind == "choice":
        got = F.when(value.isin(*choices), value)
    else:
        got = value
    return F.struct(got.alias("value"), F.when(got.isNull(), F.concat(F.lit(f"not a {kind}: "), F.coalesce(value, F.lit("null")))).alias("error"))


def placeholders(template: Column) -> Column:
    """Names in double braces, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1)))


def render(template: Column, answers: Column) -> Column:
    """The template with each double-brace name replaced by its answer; names without an answer stay."""
    return F.aggregate(F.map_entries(answers), template, lambda out, e: F.regexp_replace(out, F.concat(F.lit(r"\{\{\s*"), e["key"], F.lit(r"\s*\}\}")), F.coalesce(e["value"], F.lit(""))))


def normal_path(path: Column) -> Column:
    """A path with `.`, `..` and repeated slashes resolved by its text; links are not followed."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x != "..", F.array_append(acc, x)).when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(F.trim(path).startswith("/"), acc).otherwise(F.array_append(acc, x))
    parts = F.aggregate(F.split(F.trim(path), "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when(F.trim(path).startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)
