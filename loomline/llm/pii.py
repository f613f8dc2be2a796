"""Personal data by weak supervision (operator 1), DataFrame functions only.

Regular expressions propose candidate spans; regex, gazetteer, context and check labelers vote on each (+1, 0, -1).
The votes of the whole corpus are counted by pattern; expectation-maximisation over that bounded table
(kinds x vote patterns x span features) estimates how reliable each labeler is for each kind and how likely each pattern is personal data, and a logistic
span classifier on votes, kind and span features is trained on those likelihoods. Base spans always stay; the classifier decides on the other candidates.

Kinds with few candidates lean on what all kinds together show, and that on a stated prior (VOTE_PRIOR): the form of a span is weak evidence, its context
strong. A kind never seen in training is admitted when its votes outweigh PRIOR_BIAS, each by its log likelihood ratio in VOTE_PRIOR.

Edge cases: null text is empty; texts without candidates get empty spans; a corpus without candidates trains nothing and leaves the
prior. Repeated rows are handled each. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import named, settle, sha_hex

#: Java's regular expressions recurse into a repeated group, once for each repetition, so a long text would run out of stack. Repeated groups are single characters here: in a
#: copy of the text, dots between domain characters, and blanks and hyphens between digits, are these marks. A mark that the text itself has is another character that no pattern knows.
DOT, BLANK, HYPHEN, FOREIGN = "\ue000", "\ue001", "\ue002", "\ue003"
MARKS = (DOT + BLANK + HYPHEN, ".\x20-")
#: Possessive quantifiers and the look-behind keep matching linear; \G lets a match begin right after another one.
EMAIL = rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{BLANK}{HYPHEN}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates that only the classifier can admit.
LOCAL = r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: A part of a name has at most 40 letters after its capital, and at most nine parts are joined by hyphens: bounds that keep the recursion flat and votes quick.
_NAME = r"\p{Lu}\p{Ll}{1,40}+(?!\p{Ll})"
_NAMES = rf"{_NAME}(?:[-'’]{_NAME}){{0,8}}+"
PERSON = rf"(?<![\p{{L}}])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20{_NAMES}(?:\x20{_NAMES})?"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

KINDS = ("email", "ip", "card", "phone", "local", "social", "person")
N_BASE = 4
LABELERS = ("regex", "gazetteer", "context", "check")
#: Features of a span besides its votes: a cue stands right before it, it is written in groups, its characters vary.
FEATURES = ("close", "grouped", "varied")
#: Cue words near a span, for and against, by kind.
CUES = {
    "email": ("mail|contact|write|reply|inbox|cc", "example|noreply|no-reply|sample"),
    "ip": ("ip|host|server|address|login|client|addr", "version|release|section|chapter|build|v"),
    "card": ("card|visa|master|amex|pay|credit|debit|cc", "isbn|order|serial|sku|tracking|invoice"),
    "phone": ("phone|tel|call|mobile|cell|fax|ring|whatsapp|contact", "isbn|order|serial|version|part"),
    "local": ("phone|tel|call|mobile|cell|fax|ring|dial|contact", "isbn|order|serial|version|part|sku|invoice"),
    "social": ("ssn|social|security|tax|insurance|taxpayer", "isbn|part|serial|sku|model|order|invoice"),
    "person": ("contact|dear|regards|patient|client|by|from|wrote|said|signed|met|asked", "street|hospital|university|award|avenue|prize|institute|road"),
}
#: Gazetteers: endings of common mail domains, dialling codes, first digits of card issuers, common given and family names.
DOMAINS = r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|it|nl|ch|at|be|se|no|dk|fi|pl|pt|br|mx|ca|au|jp|in|us|co)$"
DIALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kenneth "
    "Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy "
    "Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Anna Maria Emma Laura Julia Peter Hans Klaus Jürgen Wolfgang Stefan Andreas Markus Sabine Petra "
    "Monika Ursula Heike Pierre Jean Jacques Michel Philippe François Marie Nathalie Isabelle Sophie Camille Carlos Jose José Juan Luis Miguel Pedro Javier Carmen Ana Lucía Elena"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Martin Lee Perez Thompson White Harris "
    "Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Nelson Baker Hall Campbell Mitchell Carter Roberts Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker "
    "Schulz Hoffmann Bernard Dubois Durand Petit Moreau Laurent Simon Lefebvre García Martínez López Sánchez Pérez Gómez Fernández Ruiz"
).split()
NAMES = rf"(?:^|[\x20'’-])(?:{'|'.join([*GIVEN, *FAMILY])})(?:$|[\x20'’-])"
#: Words that follow a title without naming a person.
PLACES = r"\x20(?:Street|Hospital|University|Award|Avenue|Road|Institute|Clinic|School|Museum|Square|Park)$"
PRIVATE = r"^(?:0*10|0*127|0*0|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254)\."
#: P(vote -1, 0, +1) of each labeler for other and for personal spans before any data, and how many votes that counts for.
_FORM = ((0.3, 0.3, 0.4), (0.1, 0.2, 0.7))
VOTE_PRIOR = (_FORM, _FORM, ((0.5, 0.4, 0.1), (0.03, 0.47, 0.5)), _FORM)
PRIOR_VOTES = 20.0
#: How much of a labeler's evidence counts: three of them look at the same characters, so each counts by half.
EVIDENCE = (0.5, 0.5, 1.0, 0.5)
PRIOR_BIAS = -0.5


def weight_prior() -> list[float]:
    """What the classifier's weights are drawn to: the bias, each labeler's log likelihood ratios for and against; nothing for span features and kinds."""
    ratio = lambda i, x: EVIDENCE[i] * math.log(VOTE_PRIOR[i][1][x] / VOTE_PRIOR[i][0][x])
    return [PRIOR_BIAS, *[ratio(i, x) for i in range(len(LABELERS)) for x in (2, 0)], *[0.0] * (len(FEATURES) + len(KINDS))]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    """Does the number's check digit hold?"""
    doubled = F.transform(F.split(F.reverse(digits(value)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The base kinds' test of a match."""
    n = F.length(digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": F.when(n.between(13, 19), luhn(value)).otherwise(False),
        "phone": n.between(9, 15),
    }.get(kind, F.lit(True))


def _only(kind: str, test: Callable[[Column, str], Column]) -> Column:
    """The spans of a kind's column that pass a test."""
    return F.filter(F.col(kind), lambda s: test(s, kind))


def candidates(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row a document: doc_id, an array of spans for each kind, and, if wanted, doc: a struct of the document's own columns."""
    own = [F.struct(*[named(c) for c in docs.columns]).alias("doc")] if carry else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"), *own)
    text, more = F.col("__text"), ["doc"] if carry else []
    own = F.translate(text, DOT + BLANK + HYPHEN, FOREIGN * 3)
    marked = {
        "email": F.regexp_replace(own, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT),
        "card": F.regexp_replace(F.regexp_replace(own, r"(?<=[0-9])\x20(?=[0-9])", BLANK), r"(?<=[0-9])-(?=[0-9])", HYPHEN),
    }
    may = {
        "email": (EMAIL, text.contains("@")),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "phone": (PHONE, text.contains("+")),
        "local": (LOCAL, text.rlike(r"[0-9]{3}[.-][0-9]{4}")),
        "social": (SOCIAL, text.rlike(r"[0-9]-[0-9]{2}-[0-9]{4}")),
        "person": (PERSON, text.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}")),
    }
    scanned = base.select("doc_id", *more, *[S.pieces(marked.get(k, text), *may[k]).alias(k) for k in KINDS])
    spans = scanned.select("doc_id", *more, *[S.located(F.col(k), marks=MARKS if k in marked else ("", "")).alias(k) for k in KINDS])
    kept = [_only(k, lambda s, kind: holds(kind, s["value"])).alias(k) for k in KINDS[:N_BASE]]
    return spans.select("doc_id", *more, *kept, *KINDS[N_BASE:])


def _vote(good: Column, bad: Column) -> Column:
    """+1, -1 or 0; what speaks against counts first."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _same_digits(value: Column) -> Column:
    """One digit repeated, or digits that only count up."""
    d = digits(value)
    return d.rlike(r"^([0-9])\1*$") | F.lit("01234567890123456789").contains(d)


def votes(kind: str, s: Column) -> list[Column]:
    """The labelers' votes on a span, as small integers in the order of LABELERS."""
    v, around = s["value"], F.lower(F.concat_ws(" ", s["before"], s["after"]))
    d, n = digits(v), F.length(digits(v))
    shape = {
        "email": _vote(v.rlike(r"\.[A-Za-z]{2,10}$"), v.rlike(r"\.[0-9]+$|^[.%-]")),
        "ip": _vote(~v.rlike(r"(?:^|\.)0[0-9]"), v.rlike(r"(?:^|\.)0[0-9]")),
        "card": _vote(v.rlike(r"^[0-9]{4}([\x20-])[0-9]{4,6}\1|^[0-9]{14,16}$"), v.rlike(r"[\x20-][0-9]{1,2}[\x20-]")),
        "phone": _vote(n.between(10, 13), v.rlike(r"\([^)]*\(|\.\.|--")),
        "local": _vote(v.rlike(r"^\([0-9]{3}\)|^[0-9]{3}([.-])[0-9]{3}\1"), v.rlike(r"^\([0-9]{3}[^)0-9]")),
        "social": _vote(~v.rlike(r"^(?:000|666|9)|-00-|-0000$"), v.rlike(r"^(?:000|666|9)|-00-|-0000$")),
        "person": _vote(v.rlike(r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}"), v.rlike(PLACES)),
    }[kind]
    known = {
        "email": _vote(v.rlike(DOMAINS), v.rlike(r"(?i)\.(?:invalid|local|png|jpg|gif)$|^(?:noreply|no-reply|donotreply|example|test|user)@|@example\.")),
        "ip": _vote(~v.rlike(PRIVATE), v.rlike(PRIVATE)),
        "card": _vote(d.rlike(ISSUERS), ~d.rlike(ISSUERS)),
        "phone": _vote(v.rlike(DIALLING), ~v.rlike(DIALLING)),
        "local": _vote(d.rlike(r"^[2-9][0-8][0-9]"), ~d.rlike(r"^[2-9][0-8][0-9]")),
        "social": _vote(v.rlike(r"^(?:[0-6][0-9]{2}|7[0-6][0-9]|77[0-2])-"), v.rlike(r"^(?:078-05-1120|219-09-9999)$")),
        "person": _vote(v.rlike(NAMES), v.rlike(PLACES)),
    }[kind]
    cue = _vote(around.rlike(rf"(?<![a-z])(?:{CUES[kind][0]})(?![a-z])"), around.rlike(rf"(?<![a-z])(?:{CUES[kind][1]})(?![a-z])"))
    check = {
        "email": _vote(v.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*[A-Za-z][A-Za-z0-9._%+-]*@"), v.rlike(r"\.\.|\.@|@-|-\.|^[0-9]+@")),
        "ip": _vote(v.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), v.rlike(r"\.(?:0|255)$|^(?:22[4-9]|2[3-5][0-9]|0+)\.")),
        "card": _vote(luhn(v) & (d.rlike(r"^4") & n.isin(13, 16, 19) | d.rlike(r"^3[47]") & (n == 15) | d.rlike(r"^(?:5[1-5]|2[2-7]|6)") & (n == 16)), ~luhn(v) | d.rlike(r"^([0-9])\1*$")),
        "phone": _vote(n.between(9, 15) & ~_same_digits(v), ~n.between(9, 15) | d.rlike(r"([0-9])\1{6}")),
        "local": _vote(d.rlike(r"^[0-9]{3}[2-9](?!11)[0-9]{6}$"), ~d.rlike(r"^[0-9]{3}[2-9](?!11)[0-9]{6}$") | _same_digits(v)),
        "social": _vote(~_same_digits(v), d.rlike(r"^([0-9])\1*$")),
        "person": _vote(v.rlike(r"(?i)\p{Lu}[\p{L}'’-]*[aeiouyäéíóöü][\p{L}'’-]+$"), v.rlike(r"\x20\p{Lu}\p{Ll}?$")),
    }[kind]
    return [shape, known, cue, check]


def span_features(kind: str, s: Column) -> list[Column]:
    """0 or 1 in the order of FEATURES."""
    v = s["value"]
    close = F.lower(F.right(s["before"], F.lit(14))).rlike(rf"(?<![a-z])(?:{CUES[kind][0]})[^a-z]*$")
    varied = F.size(F.array_distinct(F.split(v, ""))) >= 6
    return [x.cast("int") for x in (close, v.rlike(r"[0-9]\)?[\x20.-]+\(?[0-9]|\p{Ll}\x20\p{Lu}"), varied)]


def em(counts: list[tuple[tuple[int, ...], int, int]], rounds: int = 50) -> tuple[dict, list[list[list[float]]]]:
    """Dawid-Skene over counted vote patterns (votes, kind, n): P(personal | votes, kind), and P(vote | class) of each labeler over all kinds.

    A kind's reliabilities are its own votes and PRIOR_VOTES of all kinds together; those are all votes and PRIOR_VOTES of VOTE_PRIOR, which also says which class
    is the personal one.
    """
    post = {(v, k): min(0.95, max(0.05, 0.4 + 0.15 * sum(v))) for v, k, _ in counts}
    table: list[list[list[float]]] = [[list(row) for row in own] for own in VOTE_PRIOR]
    kinds = sorted({k for _, k, _ in counts})
    for _ in range(rounds if counts else 0):
        seen = {k: [[[0.0] * 3, [0.0] * 3] for _ in LABELERS] for k in kinds}
        prior = {k: [1.0, 1.0] for k in kinds}
        for v, k, n in counts:
            p = post[v, k]
            for i, x in enumerate(v):
                seen[k][i][1][x + 1] += n * p
                seen[k][i][0][x + 1] += n * (1 - p)
            prior[k][1] += n * p
            prior[k][0] += n * (1 - p)
        mixed = lambda votes, drawn: [(a + PRIOR_VOTES * b) / (sum(votes) + PRIOR_VOTES) for a, b in zip(votes, drawn, strict=True)]
        table = [[mixed([sum(seen[k][i][c][x] for k in kinds) for x in range(3)], VOTE_PRIOR[i][c]) for c in (0, 1)] for i in range(len(LABELERS))]
        own = {k: [[mixed(seen[k][i][c], table[i][c]) for c in (0, 1)] for i in range(len(LABELERS))] for k in kinds}
        for v, k, _ in counts:
            log = [math.log(prior[k][c]) + sum(EVIDENCE[i] * math.log(own[k][i][c][x + 1]) for i, x in enumerate(v)) for c in (0, 1)]
            post[v, k] = 1 / (1 + math.exp(max(-50, min(50, log[0] - log[1]))))
    return post, table


def features(v: tuple[int, ...], kind: int, more: tuple[int, ...] = (0,) * len(FEATURES)) -> list[float]:
    """Bias, each labeler for and against, the span features, and the kind."""
    return [1.0, *[float(x == s) for x in v for s in (1, -1)], *map(float, more), *[float(kind == k) for k in range(len(KINDS))]]


def train(counts: list[tuple[tuple[int, ...], int, int]], post: dict, more: list[tuple[int, ...]] | None = None, steps: int = 300, rate: float = 0.5, l2: float = 0.02) -> list[float]:
    """Logistic regression on the likelihoods, each pattern weighted by its count (damped, so that no kind drowns the others), with a ridge around weight_prior().

    more: the span features of each count."""
    more = more or [(0,) * len(FEATURES)] * len(counts)
    rows = [(features(v, k, f), post[v, k], math.sqrt(n)) for (v, k, n), f in zip(counts, more, strict=True)]
    total = sum(r[2] for r in rows) or 1.0
    drawn = weight_prior()
    w = list(drawn)
    for _ in range(steps if rows else 0):
        grad = [l2 * (x - y) for x, y in zip(w, drawn, strict=True)]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, xi in enumerate(x):
                if xi:
                    grad[i] += n / total * (p - y) * xi
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def admitted(w: list[float], kind: str, s: Column, from_: float) -> Column:
    """The span classifier's decision, as a column."""
    at = 1 + 2 * len(LABELERS)
    score = F.lit(w[0] + w[at + len(FEATURES) + KINDS.index(kind)])
    for i, vote in enumerate(votes(kind, s)):
        score = score + F.when(vote == 1, w[1 + 2 * i]).when(vote == -1, w[2 + 2 * i]).otherwise(0.0)
    for i, feature in enumerate(span_features(kind, s)):
        score = score + feature * F.lit(w[at + i])
    return score >= math.log(from_ / (1 - from_))


def model_of(table: DataFrame) -> tuple[list[float], list]:
    """Vote patterns counted over all candidates (at most kinds * 3^labelers * 2^features rows), then EM and the classifier."""
    voted = None
    for k, kind in enumerate(KINDS):
        own = table.select(F.explode(kind).alias("s"))
        own = own.select(F.lit(k).alias("kind"), *[x.cast("int").alias(n) for n, x in zip((*LABELERS, *FEATURES), (*votes(kind, F.col("s")), *span_features(kind, F.col("s"))), strict=True)])
        voted = own if voted is None else voted.unionAll(own)
    rows = voted.groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n")).collect()
    rows = sorted((tuple(r[x] for x in LABELERS), r["kind"], tuple(r[x] for x in FEATURES), r["n"]) for r in rows)
    by_votes: dict[tuple, int] = {}
    for v, k, _, n in rows:
        by_votes[v, k] = by_votes.get((v, k), 0) + n
    post, reliabilities = em([(v, k, n) for (v, k), n in by_votes.items()])
    return train([(v, k, n) for v, k, _, n in rows], post, [f for _, _, f, _ in rows]), reliabilities


def find_pii(docs: DataFrame, admit_from: float = 0.5, carry: bool = False) -> DataFrame:
    """doc_id, base and all: arrays of (rank, start, end, kind); pii_spans() derives digests from them."""
    table = settle(candidates(docs, carry), "pii-candidates")
    own = ["doc"] if carry else []
    w, _ = model_of(table)
    tag = lambda k, spans: F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(k)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    base = F.concat(*[tag(k, F.col(k)) for k in KINDS[:N_BASE]])
    free = lambda s: ~reduce(or_, [S.touched(F.col(k), s["start"], s["end"]) for k in KINDS[:N_BASE]])
    more = F.concat(*[tag(k, _only(k, lambda s, kind: free(s) & admitted(w, kind, s, admit_from))) for k in KINDS[N_BASE:]])
    return table.select("doc_id", *own, base.alias("base"), more.alias("more")).select("doc_id", *own, "base", F.array_sort(F.concat("base", "more")).alias("all"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (how many), for every document."""
    found = find_pii(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:N_BASE]], sha_hex(S.joined(F.array_sort("base"))).alias("base_sha256"), S.joined(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))


def replaced(text: Column, spans: Column, seen: Column, many: int = 64) -> Column:
    """text with each span that begins at or after seen (how far the spans before it reach) replaced by its kind in brackets.

    A piece of a string is found by counting from its beginning, so texts with many spans are taken apart into characters first.
    """
    ends = F.array_append(F.transform(F.arrays_zip(spans.alias("s"), seen.alias("f")), lambda x: F.struct(x["f"].alias("from"), x["s"]["start"].alias("to"), x["s"]["kind"].alias("kind"))), F.struct(F.greatest(F.array_max(seen), F.array_max(F.transform(spans, lambda s: s["end"]))).alias("from"), F.length(text).alias("to"), F.lit(None).cast("string").alias("kind")))

    def joined(piece: Callable[[Column, Column], Column]) -> Column:
        """Each stretch between the spans that count, and the kind of the one after it."""
        return F.array_join(F.transform(F.filter(ends, lambda e: e["to"] >= e["from"]), lambda e: F.concat(piece(e["from"], e["to"] - e["from"]), F.coalesce(F.concat(F.lit("["), F.upper(e["kind"]), F.lit("]")), F.lit("")))), "")

    letters = F.transform(F.array(F.split(text, "")), lambda chars: joined(lambda at, n: F.array_join(F.slice(chars, at + 1, n), "")))
    return F.when(F.size(spans) > many, F.element_at(letters, 1)).otherwise(joined(lambda at, n: F.substring(text, at + 1, n)))


def redact(docs: DataFrame, admit_from: float = 0.5) -> DataFrame:
    """The documents, all columns and rows, with each span of personal data in text replaced by its kind in brackets (and n_chars brought up to date)."""
    found = find_pii(docs, admit_from, carry=True)
    # of spans that overlap, the first one goes in; what begins before the end of one before it is covered by it
    spans = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marked = found.select("doc", spans.alias("__spans")).withColumn("__from", S.running_maxima(F.transform("__spans", lambda s: s["end"])))
    done = marked.select("doc", F.when(F.size("__spans") > 0, replaced(F.col("doc.text"), F.col("__spans"), F.col("__from"))).otherwise(F.col("doc.text")).alias("__clean"))
    fresh = {"text": F.col("__clean"), "n_chars": F.length("__clean").cast("long")}
    return done.select(*[fresh[c].alias(c) if c in fresh else named(c, "doc") for c in docs.columns])
