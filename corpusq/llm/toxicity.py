"""Toxicity: subsequence string-kernel SVM with Nystroem landmarks.

A sentence is scored by its words.  The kernel of two words is the
gap-weighted subsequence kernel (Lodhi et al. 2002) over subsequences of three
and four letters that span at most six, each weighing ``DECAY`` to the power of
its span, scaled by a norm that depends on the length.  A letter put into an
insult, or left out of it, changes some of its subsequences only.  Before that,
punctuation inside words is removed, digits that stand for letters are read as
letters, and runs of pieces of one or two letters are joined, so that spelt-out
insults become words.

Landmark words give Nystroem features, on which a linear SVM is trained by
dual coordinate descent.  Landmarks times weights collapse to one weight per
subsequence, a table of fixed size, so scoring costs one look-up per
subsequence and no work per landmark.  A document scores by its worst words:
a logistic of the largest decision value and the number of positive ones.

The training rows are words of the labelled documents' sentences.  Positive are
the words that toxic documents share and clean ones lack, by the number of
different neighbours they stand between, and in a toxic document without any the
word that a first model finds worst (multiple-instance learning); negative are
words of clean documents.  The model has fixed sizes: ``MOST_WORDS`` rows of a
sign at the start (the most widespread positive words, the most frequent clean
ones, and in each round as many clean words that the model takes for worst),
``INSERTED_WORDS`` of the positive ones again with letters put in, and
``LANDMARKS`` landmarks.  They bound the fit, not what is scored.

The fit takes a bounded sample of labelled rows: ``SAMPLE`` documents of each label
in order of a hash of doc_id and, along that order, the whole ones that together
keep within half of ``SAMPLE_CHARS`` characters and of ``SAMPLE_ROWS`` rows; only
these leave the executors.  A document that does not fit is passed over, and where
none of a label fits its shortest is taken, so no label is lost.  All documents are
scored whole.

* null text counts as empty; texts without words score as the lowest margin; very
  long texts score by their worst words like others;
* of words equal in number those first in order of their letters count as more
  frequent, so reruns agree;
* labels that are null are left out; a document with several labels has the
  largest; rows of a labelled doc_id with different texts all train, equal rows
  train once; a null doc_id never trains, is not held out;
* with labels of one class only, or none, every score is that class (or 0.0);
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_scan, crc_mod, cut
from .tokens import as_bytes, chunks

FOLDS, HELD_OUT = 5, 0
SAMPLE = 6_000
SAMPLE_CHARS = 24_000_000
#: Rows of the sample: documents count as one each unless ids repeat.
SAMPLE_ROWS = 48_000
LANDMARKS = 300
MOST_WORDS = 1_500
INSERTED_WORDS, INSERTIONS = 100, 6
DECAY = 0.8
REACH = 6
LETTERS = 32
C = 2.0
NEWTON_STEPS = 25
ROUNDS = 5
#: A marked word has so many different pairs of neighbours in toxic documents,
#: and so many times the rate of clean ones.
CONTEXTS, LIFT = 4, 12

_LOOKALIKE = dict(zip(b"0134578@", b"oleastba"))
# 0 ends a word; 1-26 letters; 27-31 other letters by their first byte.
_CODE = np.zeros(256, np.uint8)
for _c in range(256):
    if 97 <= _c <= 122:
        _CODE[_c] = _c - 96
    elif 65 <= _c <= 90:
        _CODE[_c] = _c - 64
    elif _c in _LOOKALIKE:
        _CODE[_c] = _LOOKALIKE[_c] - 96
    elif 48 <= _c <= 57:
        _CODE[_c] = 27
    elif _c >= 0xC0:
        _CODE[_c] = 28 + _c % 4
_CODE[1] = 31  # stands between sentences
_BREAK = bytes([31] * 5)
#: Punctuation goes; the later bytes of a letter outside ASCII choose its letter with the first.
_GONE = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 64)
_SENTENCE_END = re.compile(rb"(?<=[.!?])\s+|\n")

#: Offsets of the later letters of a subsequence from its first.
_SHAPES = [o for size in (3, 4) for o in combinations(range(1, REACH), size - 1)]


def letter_codes(text: bytes) -> np.ndarray:
    """Codes of a text's letters, one 0 before, between and after words."""
    data = np.frombuffer(b" " + text.translate(None, _GONE) + b" ", np.uint8)
    codes = _CODE[data].astype(np.int32)
    later = (data >= 0x80) & (data < 0xC0)
    if later.any():  # fold the second byte of a letter into its first
        at = np.flatnonzero(later)
        first = at - 1
        codes[first] = np.where(codes[first] >= 27, 27 + (codes[first] * 3 + data[at]) % 5, codes[first])
        codes = codes[~later]
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    zeros = np.flatnonzero(codes == 0)
    if len(zeros) > 2:
        short = np.diff(zeros) <= 3  # words of one or two letters
        join = zeros[1:-1][short[1:] & short[:-1]]
        if len(join):
            keep = np.ones(len(codes), bool)
            keep[join] = False
            codes = codes[keep]
    return codes


def norm_of_length(n: np.ndarray) -> np.ndarray:
    """Square root of the sum of squared weights of a word's subsequences."""
    total = np.zeros(len(n))
    for shape in _SHAPES:
        total += DECAY ** (2 * (shape[-1] + 1)) * np.maximum(n - shape[-1], 0)
    return np.sqrt(np.maximum(total, 1e-9))


def word_limits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    zeros = np.flatnonzero(codes == 0)
    return zeros[:-1] + 1, zeros[1:]


def subsequences(codes: np.ndarray):
    """(first positions, subsequence numbers, weight) for every shape, within words."""
    zeros = np.flatnonzero(codes == 0)
    room = zeros[np.searchsorted(zeros, np.arange(len(codes)), "left")] - np.arange(len(codes))
    at_of_room = {r: np.flatnonzero(room > r) for r in range(2, REACH)}
    for shape in _SHAPES:
        at = at_of_room[shape[-1]]
        number = codes[at]
        for o in shape:
            number = number * LETTERS + codes[at + o]
        yield at, number, DECAY ** (shape[-1] + 1)


def word_values(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, scaled sum of the table's weights) of every word."""
    starts, ends = word_limits(codes)
    sums = np.zeros(len(codes))
    for at, number, weight in subsequences(codes):
        sums[at] += weight * table[number]
    if not len(starts):
        return starts, ends, np.empty(0)
    totals = np.add.reduceat(sums, starts)
    return starts, ends, totals / norm_of_length(ends - starts)


def _joined(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.int32)


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, scaled weight) of every occurrence."""
    codes = _joined(words)
    starts, ends = word_limits(codes)
    norms = norm_of_length(ends - starts)
    found = [
        (np.searchsorted(starts, at, "right") - 1, number, np.full(len(at), weight))
        for at, number, weight in subsequences(codes)
    ]
    rows, numbers, values = (np.concatenate(x) for x in zip(*found))
    return rows, numbers, values / norms[rows]


def kernel(words: list[bytes], others: list[bytes]) -> np.ndarray:
    """Kernel matrix of two lists of words given as letter codes."""
    rows, numbers, values = _features(others)
    known, columns = np.unique(numbers, return_inverse=True)
    size = len(known)
    weights = np.bincount(columns * len(others) + rows, values, size * len(others)).reshape(size, -1)
    place = np.full(LETTERS**4, -1, np.int32)
    place[known] = np.arange(size)
    out = np.empty((len(words), len(others)))
    for begin in range(0, len(words), 512):
        part = words[begin : begin + 512]
        rows, numbers, values = _features(part)
        at = place[numbers]
        hit = at >= 0
        dense = np.bincount(rows[hit] * size + at[hit], values[hit], len(part) * size).reshape(len(part), size)
        out[begin : begin + len(part)] = dense.astype(np.float32) @ weights.astype(np.float32)
    return out


def with_insertions(words: list[bytes]) -> list[bytes]:
    """Each word with one letter put in, at a few drawn places."""
    draw = np.random.default_rng(5)
    out = []
    for w in words:
        for _ in range(INSERTIONS):
            at, letter = int(draw.integers(1, len(w))), int(draw.integers(1, 27))
            out.append(w[:at] + bytes([letter]) + w[at:])
    return out


def train_svm(x: np.ndarray, y: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by Newton steps on the primal:
    each solves the least squares of the rows inside the margin."""
    w = np.zeros(x.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(NEWTON_STEPS):
        own = x[active] * costs[active, None]
        w = np.linalg.solve(np.eye(len(w)) + x[active].T @ own, own.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


class Toxicity:
    """Table of subsequence weights, bias, and the document logistic."""

    def __init__(self, table: np.ndarray | None, bias: float, logistic: tuple[float, float, float], only: float = 0.0):
        self.table, self.bias, self.logistic, self.only = table, bias, logistic, only

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """(largest decision value, log of 1 + positive words) per text."""
        out = np.tile([-3.0, 0.0], (len(texts), 1))
        for part in chunks(texts):
            parts = [letter_codes(as_bytes(t)) for t in texts[part]]
            joined = np.concatenate(parts)
            starts, ends, values = word_values(joined, self.table)
            values = np.maximum(values + self.bias, -3.0)
            values[ends <= starts] = -3.0
            limits = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
            for i, (a, b) in enumerate(zip(limits, limits[1:])):
                if b > a:
                    own = values[a:b]
                    out[part.start + i] = own.max(), np.log1p((own > 0).sum())
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.only)
        m = self.margins(texts)
        a, b, c = self.logistic
        return 1 / (1 + np.exp(-np.clip(a * m[:, 0] + b * m[:, 1] + c, -35, 35)))


def _words(codes: np.ndarray) -> list[bytes]:
    return [w for w in codes.astype(np.uint8).tobytes().split(b"\0") if len(w) >= 3]


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence; a sentence ends at . ! ? before white space, or at a line end."""
    out: list[list[bytes]] = [[]]
    for word in _words(letter_codes(_SENTENCE_END.sub(b" \1\1\1\1\1 ", as_bytes(text)))):
        if word == _BREAK:
            out.append([])
        else:
            out[-1].append(word)
    return [s for s in out if s]


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression; a feature whose weight turns out negative is left out."""
    used = [0, 1]
    while True:
        x = np.column_stack([m[:, used], np.ones(len(m))])
        w = np.zeros(x.shape[1])
        ridge = np.diag([1e-2] * len(used) + [1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
            step = np.linalg.solve(hessian, x.T @ (y - p) - ridge @ w)
            w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        worst = int(np.argmin(w[:-1])) if len(used) > 1 else 0
        if len(used) < 2 or w[worst] >= 0:
            out = [0.0, 0.0, float(w[-1])]
            for k, v in zip(used, w):
                out[k] = float(v)
            return tuple(out)
        used.pop(worst)


def _contexts(bags: list[list[list[bytes]]], y: np.ndarray, label: int) -> Counter:
    """Distinct pairs of neighbours of each word in the documents of a label:
    copies of a passage count once."""
    found: dict[bytes, set] = defaultdict(set)
    for bag, own in zip(bags, y):
        if own == label:
            for s in bag:
                for before, word, after in zip([b"", *s[:-1]], s, [*s[1:], b""]):
                    found[word].add(hash((before, after)))
    return Counter({w: len(c) for w, c in found.items()})


def fit(texts: list[str | None], labels: list[int]) -> Toxicity:
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Toxicity(None, 0.0, (0, 0, 0), float(y[0]) if len(y) else 0.0)
    bags = [sentences(t) for t in texts]
    toxic, clean = _contexts(bags, y, 1), _contexts(bags, y, 0)
    rate = max(int(y.sum()), 1) / max(int(len(y) - y.sum()), 1)
    for enough in (CONTEXTS, 2, 1):
        marked = {w for w, n in toxic.items() if n >= enough and n > LIFT * rate * clean[w]}
        if marked:
            break

    positives = sorted(marked, key=lambda w: (-toxic[w], w))[:MOST_WORDS]
    if not positives:
        return Toxicity(None, 0.0, (0, 0, 0), 0.0)
    if len(positives) > 1:
        positives += with_insertions(positives[:INSERTED_WORDS])
    vocabulary = sorted(set(clean) - set(positives))
    joined = _joined(vocabulary)
    common = [w for w in sorted(clean, key=lambda w: (-clean[w], w))[:MOST_WORDS] if w not in marked]
    order = np.random.default_rng(11)
    drawn = [vocabulary[i] for i in order.permutation(len(vocabulary))[: 2 * MOST_WORDS]]
    negatives, hard = list(dict.fromkeys(common + drawn)), []
    for turn in range(ROUNDS):
        # landmarks: marked words, the clean words most like them, and other clean words
        part = LANDMARKS // 3
        landmarks = list(dict.fromkeys(positives[: 2 * part] + hard[:part] + drawn))[:LANDMARKS]
        k_mm = kernel(landmarks, landmarks).astype(np.float64)
        value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
        keep = value > 1e-5 * value.max()
        whiten = vector[:, keep] / np.sqrt(value[keep])
        words = positives + negatives
        x = kernel(words, landmarks).astype(np.float64) @ whiten
        x = np.column_stack([x, np.ones(len(x))])
        sign = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        w = train_svm(x, sign, np.where(sign > 0, C * max(1.0, 0.1 * len(negatives) / len(positives)), C))
        model = Toxicity(_collapse(landmarks, whiten @ w[:-1]), float(w[-1]), (1, 0, 0))
        if turn == ROUNDS - 1:
            break
        # clean words on the wrong side or near it join the negatives
        values = word_values(joined, model.table)[2] + model.bias
        worst = np.argsort(-values, kind="stable")[:MOST_WORDS]
        hard = [vocabulary[i] for i in worst if values[i] > -0.7]
        negatives = list(dict.fromkeys(negatives + hard))
        if turn >= 2:  # toxic documents without a positive word: their worst word, if it is positive
            found = set(positives)
            for bag, label in zip(bags, y):
                if label and not any(word in found for s in bag for word in s):
                    own = sorted({word for s in bag for word in s if clean[word] == 0})
                    if own:
                        values = word_values(_joined(own), model.table)[2] + model.bias
                        if values.max() > 0:
                            positives.append(own[int(values.argmax())])
            positives = list(dict.fromkeys(positives))
    model.logistic = _logistic(model.margins(texts), y.astype(np.float64))
    return model


def _collapse(landmarks: list[bytes], weights: np.ndarray) -> np.ndarray:
    """One weight per subsequence: those of the landmarks that hold it, summed."""
    table = np.zeros(LETTERS**4, np.float64)
    norms = norm_of_length(np.array([len(w) for w in landmarks]))
    for word, weight, norm in zip(landmarks, weights, norms):
        for _, number, value in subsequences(_joined([word])):
            np.add.at(table, number, weight * value / norm)
    return table.astype(np.float32)


def training_sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded training sample, in a fixed order."""
    usable = labels.where(F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    once = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    turn = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    ids = once.where("y = 0").orderBy(turn, "doc_id").limit(SAMPLE).unionAll(
        once.where("y = 1").orderBy(turn, "doc_id").limit(SAMPLE)
    )
    sample = F.broadcast(cut(ids, "toxicity-ids"))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").distinct()
    figures = rows.groupBy("y", "doc_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("k"))
    # a narrow row for each sampled document, 2 * SAMPLE at most, says how long it is
    sizes = [(r.doc_id, r.y, r.n, r.k) for r in figures.orderBy(turn, "doc_id").toLocalIterator()]
    fits = docs.sparkSession.createDataFrame(fitting(sizes, SAMPLE_CHARS // 2, SAMPLE_ROWS // 2), ids.schema)
    chosen = docs.select("doc_id", "text").join(F.broadcast(fits), "doc_id").distinct().orderBy(turn, "doc_id", F.md5("text"))
    found = [(r.text, r.y) for r in chosen.select("text", "y").toLocalIterator()]
    return [t for t, _ in found], [y for _, y in found]


def fitting(sizes: list[tuple], most_chars: int, most_rows: int) -> list[tuple]:
    """(doc_id, y) of the documents (doc_id, y, characters, rows) of each label that
    stay within both bounds together, in order; one that does not fit is passed
    over.  Where none of a label fits its shortest is taken, so no label is lost."""
    out = []
    for label in (0, 1):
        own = [s for s in sizes if s[1] == label]
        chars = rows = 0
        fits = []
        for doc_id, y, n, k in own:
            if chars + n <= most_chars and rows + k <= most_rows:
                chars, rows = chars + n, rows + k
                fits.append((doc_id, y))
        out += fits or [s[:2] for s in sorted(own, key=lambda s: (s[2], s[3]))[:1]]
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    model = fit(*training_sample(docs, labels, label))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = arrow_scan(
        docs.select("doc_id", "text"),
        lambda c: {"doc_id": c["doc_id"], "score": sent.value.score(c["text"])},
        f"doc_id {kind}, score double",
    )
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
