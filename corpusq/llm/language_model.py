"""Language-model scoring: hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class given the tokens before it,
times that of the token within its class.  The class factor is a maximum-
entropy model: the logits are the sums of a bias row and of the rows of three
hashed features: the token before, the token before the last (skip), and the
classes by spelling of the three before.  The factor within a class is add-one
smoothed counts.  The ``SINGLES`` most frequent tokens are classes of their
own; the others fall into ``TAILS`` classes by how they begin and end, so the
class of any token, known or not, follows from its bytes.

Training runs over all training documents, dealt by a hash of id and text into
shares of about ``SHARE`` tokens, in a fixed order in each, however the input is
split.  (From ``MOST_SHARES`` on the shares grow instead of their number.)  A task
takes AdaGrad steps on minibatches of its share from the weights it was sent; its
changes, in half precision and weighed row by row by how often each row was used,
are averaged in two levels of groups of bounded size, once for a quarter of the
documents and again for the rest.  The weights have a fixed size (``BUCKETS`` x
``CLASSES`` floats) whatever the corpus.

Token counts are exact over all training documents.  A token is represented by
a 64-bit hash of its bytes.  The counts of up to ``FREQUENT`` most frequent
tokens are sent to the tasks; all other tokens of a document become rows
that meet the counts in a join and are added up by document.

* null text counts as empty: one end token; very long texts are learnt and scored
  whole, minibatch by minibatch;
* of tokens that are equally frequent those with the smaller hash are classes of
  their own; shares and their order follow from ids and texts alone, so the
  scores are those of any other split of the input;
* a null doc_id is a training row; held_out is then false;
* repeated rows are counted and scored each; a doc_id that repeats is joined by
  doc_id and a hash of its text;
* with no training documents every count is 0 and the model is uniform over
  its classes; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import arrow_scan, crc_mod, cut
from .tokens import SPACED, as_bytes, chunks, mix, word_hashes

FOLDS, HELD_OUT = 7, 2
SINGLES, TAILS = 16, 32
CLASSES = SINGLES + TAILS
BUCKETS = 1 << 14
FREQUENT = 250_000
MINIBATCH = 16_384
RATE, SMOOTH = 0.2, 8.0
SLAB = 128  # rows of weights that are added up together
SAFE = 60.0  # logits whose exponentials neither overflow nor vanish
RUN = 6  # equal rows that are added up side by side
GROUP = 64  # tasks whose changes are added up together first
SHARE = 1 << 20  # training tokens that one task learns from
MOST_SHARES = 1 << 14

END = int(mix(np.array([0xE0D], np.uint64))[0])
_START = np.uint64(0x5157415254)
_SALTS = mix(np.arange(1, 4, dtype=np.uint64))

_LETTERS = 24  # tail classes of words without a final stop or comma
_STOPS = 4  # of words with either


def tail_classes(texts: list[str | None]) -> np.ndarray:
    """Tail class of every word: by its first two bytes, and whether it ends a
    sentence, ends with a comma or does neither."""
    data = np.frombuffer((b" ".join(as_bytes(t) for t in texts) + b"  ").translate(SPACED), np.uint8)
    solid = np.concatenate([[False], data != 32])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    first, second, last = data[starts].astype(np.int64), data[starts + 1].astype(np.int64), data[ends - 1]
    begin = (first * 37 + second * 11) % 509
    stop = np.isin(last, np.frombuffer(b".!?", np.uint8))
    out = begin % _LETTERS
    out = np.where(stop, _LETTERS + begin % _STOPS, out)
    return np.where(last == 44, _LETTERS + _STOPS + begin % _STOPS, out).astype(np.uint8)


def token_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, tail classes, offsets) of the tokens, an end token after each text."""
    words, offsets = word_hashes(texts, SPACED)
    tails = tail_classes(texts)
    stops = offsets[1:]
    hashes = np.insert(words, stops, np.uint64(END))
    tails = np.insert(tails, stops, 0)
    return hashes, tails, offsets + np.arange(len(offsets))


def _before(values: np.ndarray, offsets: np.ndarray, start) -> np.ndarray:
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[offsets[:-1]] = start
    return out


def features(hashes: np.ndarray, tails: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of the weights for every token: token before, token before the last, classes of the three before."""
    before = _before(hashes, offsets, _START)
    second = _before(before, offsets, _START)
    near = _before(tails.astype(np.uint64), offsets, np.uint64(TAILS))
    middle = _before(near, offsets, np.uint64(TAILS))
    far = _before(middle, offsets, np.uint64(TAILS))
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.stack(
        [
            mix(before ^ _SALTS[0]) >> shift,
            mix(second ^ _SALTS[1]) >> shift,
            mix((near * np.uint64(64) + middle) * np.uint64(64) + far ^ _SALTS[2]) >> shift,
        ]
    ).astype(np.int64)


def row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, sums of the values of each, how often each stands): short
    runs of equal rows are added up side by side, long ones one by one."""
    keys = rows.astype(np.uint16)  # sixteen bits are sorted by radix
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(starts, len(keys)))
    values = values.take(order, axis=0, mode="clip")
    sums = values.take(starts, axis=0, mode="clip")
    for j in range(1, RUN):
        more = np.flatnonzero((n > j) & (n <= RUN))
        sums[more] += values.take(starts[more] + j, axis=0, mode="clip")
    for i in np.flatnonzero(n > RUN):
        values[starts[i] : starts[i] + n[i]].sum(axis=0, out=sums[i])
    return rows[order[starts]], sums, n


class Model:
    """Weights of the class factor and the sizes of the classes."""

    def __init__(self, singles: np.ndarray):
        self.singles = np.sort(singles.astype(np.uint64))
        self.weights = np.zeros((BUCKETS, CLASSES), np.float32)
        self.bias = np.zeros(CLASSES, np.float32)
        self.log_sizes = np.zeros(CLASSES)

    def classes(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        if not len(self.singles):
            return tails.astype(np.int64) + SINGLES
        at = np.minimum(np.searchsorted(self.singles, hashes), len(self.singles) - 1)
        return np.where(self.singles[at] == hashes, at, tails.astype(np.int64) + SINGLES)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        logits = self.weights.take(rows[0], axis=0, mode="clip")
        logits += self.weights.take(rows[1], axis=0, mode="clip")
        logits += self.weights.take(rows[2], axis=0, mode="clip")
        logits += self.bias
        if len(logits) and max(logits.max(), -logits.min()) > SAFE:
            logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (1 / np.einsum("ij->i", logits))[:, None]
        return logits

    def log10_classes(self, hashes: np.ndarray, tails: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per token: log10 of its class's probability, less the log10 of the class's size."""
        rows, classes = features(hashes, tails, offsets), self.classes(hashes, tails)
        out = np.empty(len(hashes))
        for begin in range(0, len(hashes), MINIBATCH):
            part = slice(begin, begin + MINIBATCH)
            p = self.probabilities(rows[:, part])
            out[part] = np.log10(np.maximum(p[np.arange(len(p)), classes[part]], 1e-30))
        return out - self.log_sizes[classes]

    def learn(self, hashes, tails, offsets, squares: np.ndarray, uses: np.ndarray) -> None:
        """AdaGrad steps on minibatches, one rate per row."""
        rows, classes = features(hashes, tails, offsets), self.classes(hashes, tails)
        for begin in range(0, len(hashes), MINIBATCH):
            part = slice(begin, begin + MINIBATCH)
            own = rows[:, part]
            gradient = self.probabilities(own)
            gradient[np.arange(len(gradient)), classes[part]] -= 1
            for k in range(3):
                touched, sums, n = row_sums(own[k], gradient)
                squares[touched] += np.einsum("ij,ij->i", sums, sums) / CLASSES
                self.weights[touched] -= sums * (RATE / np.sqrt(squares[touched] + SMOOTH)).astype(np.float32)[:, None]
                uses[touched] += n


def _training_turn(rounds: int):
    """Round of a document: the first takes a quarter, the second the rest."""
    return F.when(F.pmod(F.xxhash64(F.lit("round"), F.col("doc_id")), F.lit(4)) == 0, 0).otherwise(rounds - 1)


def _changes(texts: DataFrame, model: Model) -> DataFrame:
    """(slab, task, changes in half precision, uses) from each task's steps over its documents."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = StructType.fromDDL("slab int, task long, change binary, uses binary")
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        start = sent.value
        own = Model(start.singles)
        own.weights, own.bias = start.weights.copy(), start.bias
        squares, uses = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in chunks(texts):
                own.learn(*token_stream(texts[part]), squares, uses)
        change = (own.weights - start.weights).astype(np.float16)
        task = TaskContext.get().partitionId()
        slabs = [k for k in range(BUCKETS // SLAB) if uses[k * SLAB : (k + 1) * SLAB].any()]
        cuts = [slice(k * SLAB, (k + 1) * SLAB) for k in slabs]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slabs, pa.int32()),
                pa.array([task] * len(slabs), pa.int64()),
                pa.array([change[c].tobytes() for c in cuts], pa.binary()),
                pa.array([uses[c].astype(np.float32).tobytes() for c in cuts], pa.binary()),
            ],
            schema=out_schema,
        )

    return texts.select("text").mapInArrow(run, schema)


def _averaged(changes: DataFrame, size: int, kind: type) -> DataFrame:
    """Changes averaged by slab over their uses, of so many tasks at a time; 0: of all."""

    def add(frame):
        change, uses = np.zeros((SLAB, CLASSES)), np.zeros(SLAB)
        frame = frame.sort_values("task")  # sums do not depend on the order of arrival
        for c, u in zip(frame["change"], frame["uses"]):
            used = np.frombuffer(u, np.float32)
            change += np.frombuffer(c, kind).reshape(SLAB, CLASSES) * used[:, None]
            uses += used
        mean = (change / np.maximum(uses, 1)[:, None]).astype(np.float32)
        return frame.iloc[:1].assign(change=[mean.tobytes()], uses=[uses.astype(np.float32).tobytes()])

    grouped = changes.groupBy("slab", (F.col("task") / size).cast("long").alias("of")) if size else changes.groupBy("slab")
    return grouped.applyInPandas(add, "slab int, task long, change binary, uses binary")


def _shares(documents: DataFrame, tokens: int) -> DataFrame:
    """The documents in shares of about ``SHARE`` of the tokens, in a fixed order in each."""
    n = min(max(-(-tokens // SHARE), 1), MOST_SHARES)
    keyed = documents.select("text", F.xxhash64(F.lit("share"), F.col("doc_id"), F.col("text")).alias("key"))
    return keyed.repartition(n, "key").sortWithinPartitions("key")


def train(documents: DataFrame, model: Model, tokens: int) -> None:
    """Two rounds of averaged gradient steps over the training documents, which hold so many tokens."""
    turns = _training_turn(2)
    for turn, part in ((0, tokens // 4), (1, tokens - tokens // 4)):
        changes = _changes(_shares(documents.where(turns == turn), part), model)
        total = _averaged(_averaged(changes, GROUP, np.float16), 0, np.float32)
        for row in total.toLocalIterator():
            part = slice(row.slab * SLAB, (row.slab + 1) * SLAB)
            model.weights[part] += np.frombuffer(row.change, np.float32).reshape(SLAB, CLASSES)


def token_counts(training: DataFrame) -> DataFrame:
    """(token, tail, n): exact counts of the tokens of all training documents."""

    def step(c):
        found = [token_stream(c["text"][part])[:2] for part in chunks(c["text"])]
        if not found:
            return {"token": [], "tail": [], "n": []}
        hashes, tails = (np.concatenate(x) for x in zip(*found))
        unique, first, n = np.unique(hashes, return_index=True, return_counts=True)
        return {"token": unique.view(np.int64), "tail": tails[first].astype(np.int32), "n": n}

    parts = arrow_scan(training.select("text"), step, "token long, tail int, n long")
    return parts.groupBy("token").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def _frequent(counts: DataFrame) -> DataFrame:
    """The tokens above a count that at most ``FREQUENT`` tokens exceed, by the
    sizes of the sixteenths of octaves of counts (a few hundred rows): no task
    sends more than its share of them."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).collect()
    taken, lowest = 0, 1 << 30
    for r in sorted(sizes, key=lambda r: -r.step):
        taken += r.v
        if taken > FREQUENT:
            break
        lowest = r.step
    return counts.where(step >= lowest)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", "text")
    training = rows.where(~held_out)

    counts = cut(token_counts(training), "lm-counts")
    top = counts.orderBy(F.desc("n"), "token").limit(SINGLES).collect()
    model = Model(np.array([r.token for r in top], np.int64).view(np.uint64))
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, vocabulary = int(totals.n or 0), int(totals.v)

    # sizes of the classes: tokens and distinct tokens in training, and one unseen
    sizes = np.ones(CLASSES)
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        sizes[SINGLES + r.tail] += r.n + r.v
    for r in top:
        sizes[SINGLES + r.tail] -= r.n + 1
        sizes[int(np.searchsorted(model.singles, np.array([r.token]).view(np.uint64)[0]))] += r.n + 1
    model.log_sizes = np.log10(sizes)
    model.bias = np.log(sizes / sizes.sum()).astype(np.float32)
    train(training, model, n_train)

    frequent = _frequent(counts).select("token", "n").toPandas().sort_values("token")
    tables = (model, frequent["token"].to_numpy(), np.log10(frequent["n"].to_numpy() + 1.0))
    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def step(c):
        model, tokens, logs = sent.value
        n = len(c["text"])
        out = {k: np.zeros(n) for k in ("counted", "factor")}
        out |= {k: np.zeros(n, np.int64) for k in ("n_tokens", "n_known")}
        rare: list = [None] * n
        for part in chunks(c["text"]):
            hashes, tails, offsets = token_stream(c["text"][part])
            factor = model.log10_classes(hashes, tails, offsets)
            signed = hashes.view(np.int64)
            at = np.minimum(np.searchsorted(tokens, signed), max(len(tokens) - 1, 0))
            hit = tokens[at] == signed if len(tokens) else np.zeros(len(signed), bool)
            counted = np.where(hit, logs[at] if len(tokens) else 0.0, 0.0)
            begin, own = offsets[:-1], slice(part.start, part.stop)
            out["n_tokens"][own] = np.diff(offsets)
            out["factor"][own] = np.add.reduceat(factor, begin)
            out["counted"][own] = np.add.reduceat(counted, begin)
            out["n_known"][own] = np.add.reduceat(hit.astype(np.int64), begin)
            for i, (a, b) in enumerate(zip(begin, offsets[1:])):
                rare[part.start + i] = signed[a:b][~hit[a:b]]
        return out | {"doc_id": c["doc_id"], "place": c["place"], "rare": rare}

    # one row per document, with its rare tokens; the place tells apart rows that repeat a doc_id
    placed = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("place"), "text")
    partial = cut(
        arrow_scan(
            placed,
            step,
            f"doc_id {kind}, place long, n_tokens long, n_known long, counted double, factor double, rare array<long>",
        ),
        "lm-partial",
    )
    wanted = partial.where("size(rare) > 0").dropDuplicates(["place"]).select("place", F.explode("rare").alias("token"))
    known = wanted.join(counts.select("token", "n"), "token")
    added = known.groupBy("place").agg(
        F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("more_known")
    )
    joined = partial.drop("rare").join(added, "place", "left")
    counted = F.col("counted") + F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * float(np.log10(n_train + vocabulary + 1.0))).alias("base_score"),
        (counted + F.col("factor")).alias("score"),
    )
