"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text: str | None) -> tuple:
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    found = {k: [m for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}
    return (*[len(x) for x in found.values()], sha(",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in found.items() for m in ms)))


def secrets(text: str | None) -> tuple:
    text = text or ""
    kinds = {
        "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    found = {k: [m for m in re.finditer(p, text) if ok(m)] for k, (p, ok) in kinds.items()}
    order = sorted((m.start(), r, k, m.end()) for r, (k, ms) in enumerate(found.items()) for m in ms)
    return (*[len(x) for x in found.values()], sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in order)))


def quality(text: str | None) -> tuple:
    text = text or ""
    words = SPACE.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = set()
    for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if grams[g] > 1:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n


def js(p: list[float], q: list[float]) -> float:
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return math.sqrt(max(0.0, sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x) / 2 + sum(y * math.log2(2 * y / (x + y)) for x, y in zip(a, b, strict=True) if y) / 2))


def verdicts(rows: dict[int, tuple[str | None, str]]) -> dict[int, tuple]:
    """Distances and verdicts of (text, language) rows."""

    def histogram(t: str) -> list[int]:
        kind = lambda c: 5 if ord(c) > 127 else 3 if c in " \t\n\r\x0b\x0c" else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in ".,;:!?'\"()-" else 6
        n = Counter(map(kind, t))
        return [n[k] for k in range(7)]

    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t if c not in ".,;:!?'\"()")
    words = lambda t: SPACE.findall(lower(t))
    good = {k: (t, lang) for k, (t, lang) in rows.items() if not quality(t)[5]}
    reference = {}
    for lang in {lang for _, lang in good.values()}:
        own = [t for t, x in good.values() if x == lang]
        n = Counter(w for t in own for w in words(t))
        top = sorted(n, key=lambda w: (-n[w], w))[:40]
        if n.total() >= 5000:
            reference[lang] = ([sum(x) for x in zip(*map(histogram, own), strict=True)], top, [*[n[w] for w in top], n.total() - sum(n[w] for w in top)])
    out = {}
    for k, (t, lang) in rows.items():
        by_class = by_word = None
        if k in good and lang in reference:
            classes, top, common = reference[lang]
            by_class = js(histogram(t), classes) if len(t) >= 200 else None
            if quality(t)[0] >= 100:
                n = Counter(words(t))
                by_word = js([*[n[w] for w in top], n.total() - sum(n[w] for w in top)], common)
        kept = k in good and (by_class is None or by_class <= 0.30) and (by_word is None or by_word <= 0.36 + 0.6 / quality(t)[0] ** 0.5)
        out[k] = (by_class, by_word, kept)
    return out


def substring(texts: dict[int, str | None], width: int = 20) -> dict[int, tuple]:
    words = {k: SPACE.findall(t or "") for k, t in texts.items()}
    first: dict = {}
    for k in sorted(words):
        for i in range(len(words[k]) - width + 1):
            first.setdefault(tuple(words[k][i : i + width]), (k, i))
    out = {}
    for k, ws in words.items():
        gone = set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] != (k, i):
                gone |= set(range(i, i + width))
        out[k] = (len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def suffixes(texts: dict[int, str | None], width: int = 400) -> dict[int, tuple]:
    raw = {k: (t or "").encode() for k, t in texts.items()}
    n = Counter(b[i : i + width] for b in raw.values() for i in range(len(b) - width + 1))
    out = {}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if n[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def shingles(text: str | None) -> frozenset:
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near(texts: dict[int, str | None]) -> dict[int, tuple]:
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    holders = defaultdict(set)
    for k in ids:
        for s in sets[k]:
            holders[s].add(k)
    for a in ids:
        for b in {b for s in sets[a] for b in holders[s] if b > a}:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


LETTERS = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def resampled(docs: list[tuple], targets: list, percent: int = 25, least: int = 20, seed: int = 7, buckets: int = 10_000) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) of each document."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))
        return len(words), [zlib.crc32(g.encode()) % buckets for g in [*words, *map(" ".join, zip(words, words[1:], strict=False))]]

    own, aims = [(i, *features(t)) for i, t in docs], [features(t)[1] for t in targets]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for f in aims for b in f)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((k for k, r in enumerate(rows) if r[4] >= least), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    rank = {k: j + 1 for j, k in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(rows)]


def jaccard_components(docs: dict, width: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest doc_id reachable), from all pairs."""
    sets = {}
    for i, t in docs.items():
        words = [w.translate(LETTERS) for w in SPACE.findall(t or "")]
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in docs}


def whitened(vectors: list) -> tuple[int, list[int], list[int | None], list[float], list[list[float]]]:
    """(n, S, deviations of the rows, eigenvalues, eigenvectors as rows) by whole-matrix doubles on exact sums; vectors that stay only."""
    import numpy as np

    rows = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    distinct = sorted({tuple(r) for r in rows})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    deviation = [sum((n * x - s) ** 2 for x, s in zip(r, sums, strict=True)) for r in rows]
    far = np.array([[float(n * x - s) for x, s in zip(r, sums, strict=True)] for r in distinct]) / n
    values, vectors = np.linalg.eigh(far.T @ far / n)
    return n, sums, deviation, values[::-1].tolist(), vectors.T[::-1].tolist()
