"""Quality rules by distribution divergence (operator 8).

Every document gets word, symbol and repetition counts, and two histograms: its character classes
and its use of its language's commonest words. References for each language are summed over all
documents that pass the base rules. A document whose Jensen-Shannon distance (base 2) to its
language's reference is too large is rejected; documents too short for a stable histogram are not
judged on it.

Edge cases: null text counts as empty (no words: base_failed). Null lang is a language of its own.
A language whose reference holds too few words judges nothing. Rows are judged one by one, whatever their doc_id: a row that repeats a
doc_id, or has none, stays or goes by its own text. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from .common import U64, WordHashes, forget, id_and_text, mix, named, raw_texts, settle, slices, tidy

CLASSES = ("lower", "upper", "digit", "space", "sentence", "wide", "symbol")
SENTENCE = b".,;:!?'\"()-"
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
#: Plain words: ASCII capitals lowered, sentence punctuation deleted.
LOWER = bytes(range(256)).lower()
DROP = b".,;:!?'\"()"


def _class(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return 7 if b < 0xC0 else 5  # a character counts by its first byte
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if b in SPACE else 4 if b in SENTENCE else 6


_CLASS_OF = np.array([_class(b) for b in range(256)], np.int64)
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text's part."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def repeated_words(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text inside 3-word windows that occur twice or more in it. h: word hashes of all texts."""
    cover = np.zeros(len(h), bool)
    if len(h) >= 3:
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.flatnonzero(text[:-2] == text[2:])
        key = h[:-2] * U64(0x9E3779B97F4A7C15) + h[1:-1] * U64(0xC2B2AE3D27D4EB4F) + h[2:]
        key = mix(key[at]) + text[at].astype(U64) * U64(0xD6E8FEB86659FD93)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            cover[at[twice] + k] = True
    return per_text(cover, offsets)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def classes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the character classes of each text; code points from 128 on are 'wide'."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(8 * text + _CLASS_OF[data], minlength=8 * n).reshape(n, 8)[:, : len(CLASSES)]


class Measured:
    """What the rules need to know of each of some texts."""

    def __init__(self, texts: list[bytes], hashes: WordHashes):
        data = np.frombuffer(b"".join(texts), np.uint8)
        places = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        h, offsets = hashes.of_texts(texts)
        self.data, self.classes = data, classes_of(data, places)
        self.chars = self.classes.sum(1)
        self.n_words, self.n_repeat = np.diff(offsets), repeated_words(h, offsets)
        self.word_chars = self.chars - self.classes[:, CLASSES.index("space")]
        self.n_symbols = per_text(_SYMBOL[data], places)
        self.failed = (self.n_words < 50) | (100 * self.n_repeat > 50 * self.n_words)


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case words without sentence punctuation."""
    return text.translate(LOWER, DROP).split()


def js_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to one vector of counts, 0 to 1; 0 where either is empty."""
    total = p.sum(1, keepdims=True)
    if not q.sum():
        return np.zeros(len(p))
    p, q = p / np.maximum(total, 1), np.broadcast_to(q / q.sum(), p.shape)
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(0.0, (part(p) + part(q)) / 2)), 0.0)


def _rows(docs: DataFrame, *more) -> DataFrame:
    return id_and_text(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), *more)


def language_references(docs: DataFrame, common: int = 40, held: int = 50_000) -> DataFrame:
    """One row per language: class counts, the commonest words, their counts, and the count of all words.

    Each task sums its own texts first and sends what it has once it holds `held` words, so its memory is bounded and a common word is a few rows a task.
    """
    names = ["lang", "word", "n", "is_class"]

    def partial(batches):
        hashes, words, classes = WordHashes(), {}, {}

        def sent():
            for lang, counted in words.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counted), pa.string()), pa.array(list(counted), pa.binary()).cast(pa.string()), pa.array(list(counted.values()), pa.int64()), pa.array([False] * len(counted), pa.bool_())], names)
            for lang, counts in classes.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(CLASSES)), pa.array(CLASSES), pa.array(counts, pa.int64()), pa.array([True] * len(CLASSES))], names)
            words.clear(), classes.clear()

        for batch in batches:
            for part in slices(batch):
                texts, langs = raw_texts(part), part.column("lang").to_pylist()
                m = Measured(texts, hashes)
                good = np.flatnonzero(~m.failed).tolist()
                for lang in dict.fromkeys(langs[i] for i in good):
                    own = [i for i in good if langs[i] == lang]
                    words.setdefault(lang, Counter()).update(plain_words(b" ".join([texts[i] for i in own])))
                    classes[lang] = classes.get(lang, 0) + m.classes[own].sum(0)
                if sum(map(len, words.values())) > held:
                    yield from sent()
        yield from sent()

    counted = _rows(docs).mapInArrow(tidy(partial), "lang string, word string, n long, is_class boolean").groupBy("lang", "is_class", "word").agg(F.sum("n").alias("n"))
    counted = settle(counted, "language-words")
    classes = counted.filter("is_class").groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("m"))
    words = counted.filter("not is_class")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n_words"))
    first = words.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= common)
    first = first.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "word"))).alias("top"))
    found = settle(
        classes.join(totals, "lang")
        .join(first, "lang")
        .select(
            "lang",
            F.array(*[F.coalesce(F.col("m")[c], F.lit(0)) for c in CLASSES]).alias("ref_classes"),
            F.col("top.word").alias("ref_words"),
            F.transform("top", lambda x: -x["minus"]).alias("ref_counts"),
            F.col("n_words").alias("ref_total"),
        ),
        "language-references",
    )
    forget(counted)
    return found


VERDICT = {"n_words": LongType(), "word_chars": LongType(), "n_symbols": LongType(), "n_dup_lines": LongType(), "n_repeat_words": LongType(), "base_failed": BooleanType(), "class_distance": DoubleType(), "word_distance": DoubleType(), "kept": BooleanType()}


def quality_verdicts(
    docs: DataFrame,
    references: DataFrame | None = None,
    class_limit: float = 0.30,
    word_limit: float = 0.36,
    word_noise: float = 0.6,
    min_chars: int = 200,
    min_words: int = 100,
    min_reference_words: int = 5_000,
    shared_languages: int = 4_096,
    carry: bool = False,
) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances (null where not judged) and kept; if wanted, doc: a struct of the row's columns but text, and text.

    The word limit is word_limit + word_noise / sqrt(n): short texts stray further by chance.
    Up to shared_languages references (a hundred numbers each) go to the tasks as one table; beyond that they are joined to the rows.
    """
    references = references if references is not None else language_references(docs)
    columns = ("ref_classes", "ref_words", "ref_counts", "ref_total")
    few = references.limit(shared_languages + 1).collect()
    more = ["doc", "text"] if carry else []
    rows = _rows(docs, *([F.struct(*[named(c) for c in docs.columns if c != "text"]).alias("doc")] if carry else []))
    if len(few) <= shared_languages:
        table = {r["lang"]: tuple(r[c] for c in columns) for r in few}
    else:
        table, rows = None, rows.join(references, "lang", "left")

    def reference(total, classes, words, counts):
        if not total or total < min_reference_words:
            return None
        return np.array(classes, float), {w.encode(): k for k, w in enumerate(words)}, np.array([*counts, total - sum(counts)], float)

    def judge(batches):
        hashes = WordHashes()
        shared = {lang: reference(total, classes, words, counts) for lang, (classes, words, counts, total) in (table or {}).items()}
        for batch in batches:
            for part in slices(batch):
                texts, langs = raw_texts(part), part.column("lang").to_pylist()
                known, m = dict(shared), Measured(texts, hashes)
                by_class, by_word, kept = np.full(len(texts), np.nan), np.full(len(texts), np.nan), ~m.failed
                for lang in dict.fromkeys(langs):
                    own = np.flatnonzero(np.array([x == lang for x in langs]) & ~m.failed)
                    if table is None:
                        i = langs.index(lang)
                        known[lang] = reference(*(part.column(c)[i].as_py() for c in ("ref_total", "ref_classes", "ref_words", "ref_counts")))
                    if not len(own) or known.get(lang) is None:
                        continue
                    classes, place, common = known[lang]
                    far = own[m.chars[own] >= min_chars]
                    by_class[far] = js_distances(m.classes[far], classes)
                    kept[far] &= by_class[far] <= class_limit
                    far = own[m.n_words[own] >= min_words]
                    counts = np.zeros((len(far), len(common)))
                    for row, i in zip(counts, far.tolist(), strict=True):
                        found = Counter(map(place.get, plain_words(texts[i])))
                        row[-1] = found.pop(None, 0)
                        row[list(found)] = list(found.values())
                    by_word[far] = js_distances(counts, common)
                    kept[far] &= by_word[far] <= word_limit + word_noise / np.sqrt(m.n_words[far])
                lines = pa.array(list(map(duplicate_lines, texts)), pa.int64())
                judged = [pa.array(x, mask=np.isnan(x)) for x in (by_class, by_word)]
                made = [pa.array(m.n_words), pa.array(m.word_chars), pa.array(m.n_symbols), lines, pa.array(m.n_repeat), pa.array(m.failed), *judged, pa.array(kept)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(part.column, more), *made], names=["doc_id", *more, *VERDICT])

    schema = StructType([rows.schema[c] for c in ("doc_id", *more)])
    for name, kind in VERDICT.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(tidy(judge), schema)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows that pass, with all their columns: each row by its own text."""
    good = quality_verdicts(docs, carry=True, **limits).filter("kept")
    return good.select(*[F.col("text") if c == "text" else named(c, "doc") for c in docs.columns])
