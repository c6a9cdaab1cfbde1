"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; unlabelled text is drawn from all documents. A linear
model over text statistics (and their squares) minimises the non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),    l = logistic loss,

with the class prior estimated from positives and unlabelled text alone: two rankers, each fitted on half of
the rows, score the other half, and the prior is the least ratio over score thresholds of the unlabelled share
above to the positive share above (unlabelled text above a threshold is at least the prior times the
positives' share, and nearly no more where only positives score that high), each with its margin of error.
Where the second term is negative, its gradient is stepped against, as the estimator's authors propose. The score is the
logistic of g, an estimate of the probability of label 1. Labels of value 0 are used for nothing.

Bounds. Learning takes at most ``POSITIVES`` and ``UNLABELLED`` rows, the first of a seeded order over all
rows, and only their statistics reach the driver, where the prior is estimated as well; the scores cover all rows. Rows whose
crc32(doc_id) mod 5 is 0 are never learnt from. Scoring is one narrow pass without a shuffle.

Nulls and odd rows: null or empty text has all-zero statistics and a score like any other; null doc_ids
count as the text '' in the fold rule; repeated rows stay; labels that are null or of unknown documents
are left out. Without positives every score is 0.5. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import seeded

POSITIVES, UNLABELLED = 6000, 12000
THRESHOLD = 0.3
FOLDS = 5

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_LOWER = bytes(range(97, 123))
_SYMBOLS = b"#$%&*@^~<>{}[]\\=+_/"


def statistics(text: str | None) -> list[float]:
    """Numbers that describe the form of a text; none of them names words of one language."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [0.0] * N_STATISTICS
    n, m = len(raw), len(words)
    without = lambda drop: n - len(raw.translate(None, drop))
    upper, digit, symbol = without(_UPPER), without(_DIGIT), without(_SYMBOLS)
    letters = upper + without(_LOWER)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    low = Counter(w.lower().strip(".,;:!?") for w in counts)
    top = sum(c for _, c in counts.most_common(20))
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    per = lambda c: raw.count(c) / m
    longest = max(map(len, counts))
    once = sum(1 for c in counts.values() if c == 1)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
    return [
        np.log1p(m), np.log1p(len(lines)), len(text) / m, longest / 30, upper / max(1, letters), digit / n, symbol / n, np.sqrt(symbol / n),
        per(b"!"), per(b"|"), per(b","), per(b"."), per(b"?"), per(b'"'), per(b"-"), per(b"\n"), ends / m, np.log1p(m / max(1, ends)),
        len(counts) / m, len(counts) / m**0.8, len(low) / len(counts), top / m, top / m * np.log1p(m), counts.most_common(1)[0][1] / m, once / m,
        len(set(lines)) / len(lines), pairs, sum(c for w, c in counts.items() if len(w) <= 3) / m, sum(c for w, c in counts.items() if len(w) >= 10) / m,
        sum(c for w, c in counts.items() if not w[-1].isalnum()) / m, sum(c for w, c in counts.items() if w.isupper()) / m, sum(c for w, c in counts.items() if w[0].isupper()) / m,
    ]


N_STATISTICS = 0
N_STATISTICS = len(statistics("a"))


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, N_STATISTICS)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Model:
    """Weights over standardised statistics and their squares; small enough for any task closure."""

    def __init__(self, prior: float):
        self.prior, self.mean, self.scale, self.w = prior, np.zeros(N_STATISTICS), np.ones(N_STATISTICS), None

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack((z, z * z, np.ones((len(x), 1))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._inputs(x) @ self.w, -30, 30)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1200, rate: float = 0.02, decay: float = 1e-4) -> Model:
        """Adam on the non-negative risk, all rows in each step."""
        self.mean, self.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
        p, u, prior = self._inputs(positive), self._inputs(unlabelled), self.prior
        w = np.zeros(p.shape[1])
        w[-1] = np.log(prior / (1 - prior))
        first, second = np.zeros_like(w), np.zeros_like(w)
        sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        for t in range(1, steps + 1):
            gp, gu = p @ w, u @ w
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            rest = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
            step = -prior * (p.T @ sigmoid(-gp)) / len(p) + rest if negative >= 0 else -rest
            step = step + decay * np.append(w[:-1], 0)
            first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
            w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        self.w = w
        return self


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1, risk: float = 0.1) -> float:
    """The share of positives in unlabelled rows: the least ratio of tails over out-of-fold scores.

    Thresholds leave at least ``least`` of the positives above; tails carry their margins of error at ``risk``.
    """
    p, u = [], []
    for k in (0, 1):
        if not (len(positive[k::2]) and len(unlabelled[k::2]) and len(positive[1 - k :: 2])):
            return 0.5
        model = Model(0.5).fit(positive[k::2], unlabelled[k::2], steps=300)
        p.append(model.score(positive[1 - k :: 2]))
        u.append(model.score(unlabelled[1 - k :: 2]))
    p, u = np.sort(np.concatenate(p)), np.sort(np.concatenate(u))
    cuts = np.unique(np.quantile(p, np.linspace(0, 1 - least, 200)))
    above = lambda x: 1 - np.searchsorted(x, cuts) / len(x)
    margin = np.sqrt(np.log(4 / risk) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((above(u) + margin) / above(p)))
    return float(np.clip(above(u)[best] / above(p)[best], 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 1) -> Model:
    """Fit on the training folds of ``labels`` (doc_id, quality) and on ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out())
    draw = lambda rows, n: [r[0] for r in rows.select("doc_id").distinct().orderBy(seeded("doc_id", seed)).limit(n).collect()]
    good = known.where("quality = 1").join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = [(i, True) for i in draw(good, positives)]
    chosen += [(i, False) for i in draw(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(~held_out()), unlabelled)]
    if not chosen or not chosen[0][1]:
        return Model(0.5)
    picked = spark.createDataFrame(chosen, "id long, trusted boolean")  # bounded by the parameters
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    @F.pandas_udf("array<double>")
    def numbers(text: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(text)))

    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("id", "trusted", numbers("text").alias("x"))
    rows = sorted(rows.collect(), key=lambda r: (r["trusted"], r["id"], r["x"]))  # one order, so that reruns agree
    x = lambda trusted: np.array([r["x"] for r in rows if r["trusted"] == trusted]).reshape(-1, N_STATISTICS)
    good, drawn = x(True), x(False)
    return Model(class_prior(good, drawn)).fit(good, drawn) if len(drawn) else Model(0.5)


def scored(model: Model) -> Column:
    """The score of each row's whole text."""

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(text)))

    return run(F.col("text").cast("string"))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Add the score; a column of that name is replaced."""
    return docs.withColumn(name, scored(model))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    model = train(docs, labels)
    return docs.where(scored(model) >= threshold)
