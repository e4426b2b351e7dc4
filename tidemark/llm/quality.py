"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class is a Gaussian over the statistics. Its covariance is shrunk towards the pooled covariance and then towards a
multiple of the identity; scores come from the difference of the two log densities, with Mahalanobis distances by
Cholesky factors that are computed once per fit. Moments are summed by Spark over all labelled rows that may be learnt
from; only 2 x (1 + d + d^2) sums reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, release, texts, with_columns, with_field

STATISTICS = ("words", "word_length", "variety", "upper", "symbols", "digits", "marked_words", "short_words", "line_rate", "repeated_lines", "commonest_byte", "non_ascii", "echoes")
#: Shares of the pooled covariance and of the scaled identity in each class covariance.
POOLED, IDENTITY = 0.35, 0.02

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = ~(_LETTER | _DIGIT)
_SYMBOL[[9, 10, 11, 12, 13, 32, 39, 44, 46]] = False


def document_statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text, in the order of STATISTICS; an empty text has defined values too."""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    lines = text.split("\n")
    letters, size = int(count[_LETTER].sum()), max(1, len(raw))
    filled = [x for x in lines if x]
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,")
    short = sum(1 for w in words if len(w) <= 3)
    share = lambda x, least: float(np.log(x + least))
    return [
        float(np.log1p(n)),
        float(np.log1p(len(text) / max(1, n))),
        float(np.log(len(set(words)) + 1) / np.log(n + 2)),
        share(count[_UPPER].sum() / max(1, letters), 0.02),
        share(count[_SYMBOL].sum() / size, 0.02),
        share(count[_DIGIT].sum() / size, 0.02),
        share(marked / max(1, n), 0.05),
        short / max(1, n),
        share(len(lines) / max(1, n), 0.02),
        share(1 - len(set(filled)) / max(1, len(filled)), 0.05),
        share(count.max() / size, 0.02),
        share(count[128:].sum() / size, 0.02),
        share(sum(map(str.__eq__, words, words[1:])) / max(1, n), 0.02),
    ]


def statistics(df: DataFrame, text: str = "text", out: str = "statistics", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the array of statistics of each whole text; null counts as empty. One row for each row."""
    col = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [document_statistics(x) for x in texts(part.column(col))]
                yield with_columns(part, {out: pa.array(rows, pa.list_(pa.float64()))}, drop)
        release()

    return df.mapInArrow(run, with_field(df, (out, "array<double>"), drop=drop))


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance, log determinant. None: nothing was learnt."""

    classes: tuple[tuple[float, np.ndarray, np.ndarray, float], ...] | None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if self.classes is None:
            return np.full(len(x), self.constant)
        log = []
        for prior, mean, factor, determinant in self.classes:
            z = (x - mean) @ factor.T
            log.append(prior - 0.5 * (determinant + (z * z).sum(axis=1)))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(features: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Learns from (doc_id, statistics) and (doc_id, label): rows whose fold is not 0, of label 0 or 1.

    A document with several labels counts once for each. Null ids and labels teach nothing. With one class alone the
    score is that label for all; with none it is 0.5.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col(label).cast("int").alias("label"))
    rows = features.select("doc_id", "statistics").join(known, "doc_id").select("label", "statistics")

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label_of = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(label_of), -1)
            for c in (0, 1):
                own = np.hstack([np.ones((int((label_of == c).sum()), 1)), x[label_of == c]])
                total[c] = total.get(c, 0) + own.T @ own
        for c, m in total.items():
            if np.ndim(m):
                yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], names=["label", "at", "value"])

    sums = rows.mapInArrow(moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    if not sums:
        return Discriminant(None)
    size = int(round((max(r["at"] for r in sums) + 1) ** 0.5))
    m = np.zeros((2, size, size))
    for r in sums:
        m[r["label"]].flat[r["at"]] = r["value"]
    n = m[:, 0, 0]
    if not n.all():
        return Discriminant(None, float(n[1] > 0))
    mean = m[:, 0, 1:] / n[:, None]
    own = [m[c, 1:, 1:] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    classes = []
    for c in (0, 1):
        s = (1 - POOLED) * own[c] + POOLED * pooled
        s = (1 - IDENTITY) * s + IDENTITY * (np.trace(s) / len(s) + 1e-9) * np.eye(len(s))
        lower = np.linalg.cholesky(s)
        classes.append((float(np.log(n[c] / n.sum())), mean[c], np.linalg.inv(lower), float(2 * np.log(np.diag(lower)).sum())))
    return Discriminant(tuple(classes))


def score(df: DataFrame, model: Discriminant, statistics: str = "statistics", out: str = "score") -> DataFrame:
    """df with the score of each row's statistics."""
    col = df.columns.index(statistics)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(col).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
            yield with_columns(batch, {out: pa.array(model.score(x), pa.float64())})

    return df.mapInArrow(run, with_field(df, (out, "double")))


def score_texts(df: DataFrame, model: Discriminant, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of each whole text, in one Python stage; null counts as empty."""
    col = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = np.array([document_statistics(t) for t in texts(part.column(col))])
                yield with_columns(part, {out: pa.array(model.score(x), pa.float64())})
        release()

    return df.mapInArrow(run, with_field(df, (out, "double")))


def keep(score: Column, least: float = 0.3) -> Column:
    return score >= least
