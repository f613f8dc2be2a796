"""Toxicity by cumulative-link ordinal regression (operator 5).

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all ordered thresholds, x the damped counts of a text's
features: words, and stretches of 5 to 7 characters inside words, so that words never seen in training still tell.

The labels only say clean or toxic. Grades between come from held-out scores: half of the labelled rows score the other half by the two-grade
model, and toxic rows are graded 1..grades-1 by their place among those scores. A row is never graded by a model that saw it, and every
sampled row is fitted. The model is fitted on at most `max_labelled` labelled rows, chosen by hash; it then scores every whole text.

Features are screened: far likelier in toxic than in clean rows, and so often that of all features tried about one would be by chance. If
a small sample leaves fewer than `least` features, the likeliest ones that lean to toxic rows make up the number.

Edge cases: null or empty text has no features and scores the clean end; labels without a text, null labels and repeated rows of a doc_id are
allowed (a labelled doc_id counts once a label, with the smallest of its texts). Without both classes every severity is 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices

STRIP = str.maketrans(dict.fromkeys(".,;:!?\"'()[]{}*#$%&|<>", " "))
STRETCH = range(5, 8)


def words_of(text: str) -> list[str]:
    return text.lower().translate(STRIP).split()


def word_features(word: str) -> list[str]:
    """The word itself (marked) and its distinct stretches of characters."""
    return ["=" + word, *{word[i : i + n] for n in STRETCH for i in range(len(word) - n + 1)}]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: np.ndarray

    def scorer(self, bound: int = 100_000):
        """A function from a text to its score; what it has learnt of words is kept up to a bound."""
        get, known = self.weights.get, {}

        def features(word: str) -> tuple[str, ...]:
            if len(known) >= bound:
                known.clear()
            found = known[word] = tuple(f for f in word_features(word) if get(f) is not None)
            return found

        def score(text: str) -> float:
            if not self.weights:
                return 0.0
            found: Counter[str] = Counter()
            for w in words_of(text):
                own = known.get(w)
                if own is None:
                    own = features(w)
                for f in own:
                    found[f] += 1
            return float(sum(get(f) * np.log1p(n) for f, n in sorted(found.items())))

        return score

    def score(self, text: str) -> float:
        return self.scorer()(text)

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold: rows by thresholds."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def chance(hits: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """An upper bound on the probability of `hits` or more toxic rows among n, if each is toxic with probability `share` (Chernoff)."""
    p = np.clip(hits / n, 1e-12, 1 - 1e-12)
    apart = p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share))
    return np.where(p > share, np.exp(-n * apart), 1.0)


def telling_features(texts: list[list[str]], toxic: np.ndarray, min_documents: int, min_share: float, min_log_odds: float, least: int) -> list[str]:
    """The screened features."""
    df = [Counter(), Counter()]
    for words, label in zip(texts, toxic.tolist(), strict=True):
        df[label].update({f for w in set(words) for f in word_features(w)})
    # copies of one text repeat a feature with its neighbours: it counts at most once for each word with its pair of neighbours
    contexts: Counter[str] = Counter()
    for _, w, _ in {x for words, label in zip(texts, toxic.tolist(), strict=True) if label == 1 for x in zip(["", *words], words, [*words[1:], ""], strict=False)}:
        contexts.update(word_features(w))
    names = sorted(f for f, n in df[1].items() if n >= 2)
    if not names:
        return []
    a = np.array([df[0][f] for f in names], float)
    b = np.array([min(df[1][f], contexts[f]) for f in names], float)
    n = [len(toxic) - int(toxic.sum()), int(toxic.sum())]
    odds = np.log((b + 0.5) * (n[0] - a + 0.5) / ((a + 0.5) * (n[1] - b + 0.5)))
    luck = chance(b, a + b, n[1] / (n[0] + n[1]))
    enough = b >= max(min_documents, min_share * n[1])
    good = enough & (odds >= min_log_odds) & (luck * enough.sum() <= 1)
    if good.sum() < least:
        lean = np.flatnonzero((odds > 0) & (b >= 2))
        good[lean[np.argsort(luck[lean], kind="stable")[:least]]] = True
    return [f for f, g in zip(names, good.tolist(), strict=True) if g]


@dataclass
class Rows:
    """Sparse feature values of some texts."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int
    d: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], self.d)


def sparse_rows(texts: list[list[str]], names: list[str]) -> Rows:
    place = {f: i for i, f in enumerate(names)}
    row, column, value = [], [], []
    for r, words in enumerate(texts):
        found: Counter[int] = Counter()
        for w, n in Counter(words).items():
            for f in word_features(w):
                if (c := place.get(f)) is not None:
                    found[c] += n
        for c, n in found.items():
            row.append(r), column.append(c), value.append(np.log1p(n))
    return Rows(np.array(row, np.int64), np.array(column, np.int64), np.array(value, float), len(texts), len(names))


def thresholds_of(first: float, gaps: np.ndarray) -> np.ndarray:
    """Ordered thresholds as sums of positive gaps."""
    return first + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])


def loss_and_gradient(x: Rows, y: np.ndarray, weight: np.ndarray, w: np.ndarray, first: float, gaps: np.ndarray, l2: float) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Weighted negative log likelihood with a ridge, and its gradient by w, first and gaps."""
    k, n = len(gaps) + 1, len(y)
    p = sigmoid(x.dot(w)[:, None] - thresholds_of(first, gaps)[None, :])
    # likelihood of y: difference of neighbouring cumulative probabilities
    upper = np.concatenate([np.ones((n, 1)), p], 1)[np.arange(n), y]
    lower = np.concatenate([p, np.zeros((n, 1))], 1)[np.arange(n), y]
    likely = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / likely, lower * (1 - lower) / likely
    by_threshold = np.zeros(k + 2)
    np.add.at(by_threshold, y, (du * weight / n) * (y > 0))
    np.add.at(by_threshold, y + 1, (-dl * weight / n) * (y < k))
    by_threshold = by_threshold[1 : k + 1]
    tail = np.cumsum(by_threshold[::-1])[::-1]
    loss = float(-(weight * np.log(likely)).sum() / n + 0.5 * l2 * (w @ w))
    return loss, x.back(-(du - dl) * weight / n) + l2 * w, float(by_threshold.sum()), tail[1:] * sigmoid(gaps)


def fit_grades(x: Rows, y: np.ndarray, grades: int, l2: float, steps: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on all rows; toxic and clean rows weigh the same in sum."""
    toxic = y > 0
    weight = np.where(toxic, 0.5 * x.n / max(1, toxic.sum()), 0.5 * x.n / max(1, x.n - toxic.sum()))
    at = [np.zeros(x.d), np.zeros(1), np.zeros(grades - 2)]
    m, v = [np.zeros_like(a) for a in at], [np.zeros_like(a) for a in at]
    for t in range(1, steps + 1):
        _, *gradient = loss_and_gradient(x, y, weight, at[0], float(at[1][0]), at[2], l2)
        for i, g in enumerate(gradient):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * np.square(g)
            at[i] = at[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return at[0], thresholds_of(float(at[1][0]), at[2])


def held_out_scores(split: list[list[str]], toxic: np.ndarray, screen: tuple, fitting: tuple) -> np.ndarray:
    """Each row's score by the two-grade model of the other half."""
    half, scores = np.arange(len(toxic)) % 2, np.zeros(len(toxic))
    # halves of each class, so that both have both
    for label in (0, 1):
        half[toxic == label] = np.arange((toxic == label).sum()) % 2
    for side in (0, 1):
        seen, held = np.flatnonzero(half != side), np.flatnonzero(half == side)
        names = telling_features([split[i] for i in seen], toxic[seen], *screen) if toxic[seen].any() and not toxic[seen].all() else []
        if names:
            w, _ = fit_grades(sparse_rows([split[i] for i in seen], names), toxic[seen], 2, *fitting)
            scores[held] = sparse_rows([split[i] for i in held], names).dot(w)
    return scores


def fit_ordinal(texts: list[str], toxic: np.ndarray, grades: int = 4, min_documents: int = 4, min_share: float = 0.01, min_log_odds: float = 3.0, least: int = 12, l2: float = 1e-3, steps: int = 300, rate: float = 0.1) -> OrdinalModel:
    """Screen, grade by held-out scores, fit."""
    toxic = np.asarray(toxic, int)
    nothing = OrdinalModel({}, np.full(grades - 1, 30.0))
    if not len(toxic) or toxic.min() == toxic.max():
        return nothing
    split, screen, fitting = [words_of(t) for t in texts], (min_documents, min_share, min_log_odds, least), (l2, steps, rate)
    names = telling_features(split, toxic, *screen)
    if not names:
        return nothing
    y = toxic.copy()
    if grades > 2:
        scores = held_out_scores(split, toxic, screen, fitting)
        cuts = np.quantile(scores[toxic == 1], np.arange(1, grades - 1) / (grades - 1))
        y[toxic == 1] += np.searchsorted(cuts, scores[toxic == 1], "left")
    w, theta = fit_grades(sparse_rows(split, names), y, grades, *fitting)
    return OrdinalModel({f: float(x) for f, x in zip(names, w, strict=True) if x}, theta)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[list[str], np.ndarray]:
    """At most max_labelled labelled texts, those with the smallest hash of their id."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = texts.orderBy("doc_id", "toxic").toPandas()
    return got["text"].tolist(), got["toxic"].to_numpy()


def score_toxicity(docs: DataFrame, labels: DataFrame, grades: int = 4, max_labelled: int = 4_000, toxic_from: float = 0.5, model: OrdinalModel | None = None) -> DataFrame:
    """doc_id, expected_severity (0 to grades-1), severity (most likely grade) and toxic (P(grade > 0) >= toxic_from)."""
    model = model or fit_ordinal(*labelled_sample(docs, labels, max_labelled), grades)

    def run(batches):
        score_of = model.scorer()
        for part in (part for batch in batches for part in slices(batch)):
            score = np.array([score_of(t) for t in part.column("text").to_pylist()], float)
            above = model.grades(score)
            each = np.concatenate([np.ones((len(score), 1)), above], 1) - np.concatenate([above, np.zeros((len(score), 1))], 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(above.sum(1), 6)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= toxic_from)], ["doc_id", "expected_severity", "severity", "toxic"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, expected_severity double, severity int, toxic boolean")
