"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a dozen transformed statistics.  The two classes get a mean
and a covariance, shrunk towards the pooled covariance and its diagonal; the
score of a text is the logistic of the difference of its log densities
(Mahalanobis distances by cached Cholesky factors) plus the log prior ratio.

The fit takes the labelled rows of training documents, or where they are more
than ``SAMPLE`` a part of about that many, chosen by a hash of doc_id.  Their
documents are found by a broadcast of the sample, so statistics are computed
for these and, once each, for the documents to score.  Each partition sends
sums of the statistics and of their products (fixed size), which Spark adds up;
only those sums, some three hundred numbers a class, reach the driver.

* null text counts as empty; an empty text has all-zero statistics and a score
  like any other; very long texts are read whole;
* labels that are null are left out; repeated label rows, and rows that repeat a
  labelled doc_id, count repeatedly;
* a null doc_id is never a training row and is not held out;
* with labels of one class only, or none, every score is that class (or 0.5);
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, arrow_filter, arrow_scan, crc_mod
from .tokens import SPACED, as_bytes, word_hashes

SHRINK_POOLED = 0.2  # share of the pooled covariance in a class covariance
SHRINK_DIAGONAL = 0.1  # share of the diagonal in the result
FLOOR = 1e-4  # added to the variances
TEMPER = 0.15  # log-density differences are scaled by it: the statistics are not independent
FOLDS, HELD_OUT = 3, 1
#: Labelled rows that the fit takes, about; below the bound on what is broadcast.
SAMPLE = BROADCAST_ROWS // 2

# Classes of bytes: lower, upper, digit, white space, plain punctuation, other symbol, non-ASCII.
_KIND = np.array(
    [
        0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c == 32 or 9 <= c <= 13
        else 4 if c in b".,;:'\"-()?" else 6 if c >= 128 else 5
        for c in range(256)
    ],
    np.uint8,
)
FEATURES = (
    "length", "upper", "digit", "space", "punctuation", "symbol", "non_ascii", "word_length",
    "distinct_words", "top_word", "repeated_next", "distinct_pairs", "no_letter",
)


_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_LETTER = np.isin(_KIND, (0, 1, 2, 6))


def _without_letter(data: np.ndarray) -> int:
    """Words without any letter or digit."""
    space = np.concatenate([[True], _SPACE[data], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    return int((seen[ends] == seen[starts]).sum())


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of transformed statistics per text.  Ratios are taken to the
    power 1/2, which spreads the values near 0 where clean text lies."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        raw = as_bytes(text)
        if not raw:
            continue
        data = np.frombuffer(raw, np.uint8)
        kinds = np.bincount(_KIND[data], minlength=7)
        words, _ = word_hashes([text], SPACED)
        n = len(words)
        out[i, 0] = np.log1p(n) / 4
        out[i, 1:7] = np.sqrt(kinds[1:] / len(data))
        if n:
            _, counts = np.unique(words, return_counts=True)
            out[i, 7] = np.log1p((len(data) - kinds[3]) / n)
            out[i, 8] = len(counts) / n**0.85
            out[i, 9] = np.sqrt(counts.max() / n)
            if n > 1:
                out[i, 10] = np.sqrt(np.mean(words[1:] == words[:-1]))
                out[i, 11] = len(np.unique(words[1:] * np.uint64(31) + words[:-1])) / (n - 1)
            out[i, 12] = np.sqrt(_without_letter(data) / n)
    return out


class Discriminant:
    """Class densities from sums: n, sum of x, sum of x x' for each class."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.classes = {k: v for k, v in sums.items() if v[0] > 0}
        self.factors = {}
        if len(self.classes) < 2:
            return
        means = {k: s / n for k, (n, s, _) in self.classes.items()}
        covs = {k: ss / n - np.outer(means[k], means[k]) for k, (n, _, ss) in self.classes.items()}
        total = sum(n for n, _, _ in self.classes.values())
        pooled = sum(n * covs[k] for k, (n, _, _) in self.classes.items()) / total
        for k, (n, _, _) in self.classes.items():
            cov = (1 - SHRINK_POOLED) * covs[k] + SHRINK_POOLED * pooled
            cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov))
            factor = np.linalg.cholesky(cov + FLOOR * np.eye(len(cov)))
            constant = np.log(n / total) / TEMPER - np.log(np.diag(factor)).sum()
            self.factors[k] = (means[k], np.linalg.inv(factor), constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if not self.factors:
            return np.full(len(x), float(next(iter(self.classes), 0.5)))
        logs = [
            constant - 0.5 * np.square((x - mean) @ inverse.T).sum(axis=1)
            for mean, inverse, constant in (self.factors[0], self.factors[1])
        ]
        return 1 / (1 + np.exp(-np.clip(TEMPER * (logs[1] - logs[0]), -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str, training) -> Discriminant:
    """Fit on the documents whose label is 0 or 1 and whose doc_id fulfils the
    ``training`` condition, or on a part of about ``SAMPLE`` of those labels."""
    d = len(FEATURES)
    usable = labels.where(training(F.col("doc_id")) & F.col(label).isin(0, 1))
    known = usable.groupBy("doc_id", F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("times"))
    parts = 1 << 20
    share = parts * SAMPLE // max(known.count(), SAMPLE)
    sample = known.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(parts)) < share)

    def sums(c):
        if not c["y"]:
            return {"y": [], "i": [], "v": []}
        x, y, times = statistics(c["text"]), np.array(c["y"]), np.array(c["times"], float)
        out_y, out_i, out_v = [], [], []
        for k in (0, 1):
            own, n = x[y == k], times[y == k]
            values = np.concatenate([[n.sum()], n @ own, ((own.T * n) @ own).ravel()])
            out_y += [k] * len(values)
            out_i += range(len(values))
            out_v += values.tolist()
        return {"y": out_y, "i": out_i, "v": out_v}

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y", "times")
    added = arrow_scan(rows, sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in added.toLocalIterator():
        total[r.y][r.i] = r.v
    return Discriminant({k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in total.items()})


def _fitted(docs: DataFrame, labels: DataFrame, label: str) -> Discriminant:
    return fit(docs, labels, label, lambda i: crc_mod(i, FOLDS) != HELD_OUT)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted per row; learnt from training labels only."""
    model = _fitted(docs, labels, label)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = arrow_scan(
        docs.select("doc_id", "text"),
        lambda c: {"doc_id": c["doc_id"], "score": model.score(statistics(c["text"]))},
        f"doc_id {kind}, score double",
    )
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The documents that are not predicted to be of low quality, columns as they
    came.  Each row is judged where it is, by its own text, so none is shuffled."""
    model = _fitted(docs, labels, label)
    return arrow_filter(docs, lambda texts: (model.score(statistics(texts)) >= 0.5).tolist())
