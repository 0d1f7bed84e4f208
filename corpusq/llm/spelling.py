"""Spelling variants grouped by a bit-sliced position index.

The vocabulary is every run of Latin letters of the texts, with the letters that
the contract's hash takes out of some of them, of at least ``LETTERS`` code points
and ``LEAST`` occurrences.  Two words are near if one inserted, deleted or
replaced code point leads from one to the other.

1. Runs are counted by document inside each Arrow batch, words summed by Spark.
2. Words that one error parts agree in their first or in their last h letters, h
   being half of the shorter one's length.  So each word stands in a bucket for
   its first and one for its last h letters, for each h that it may need.  A pair
   counts in the bucket of the first letters, and in that of the last only where
   the first differ, so once.
3. In a bucket the words are bits of whole numbers of any length: a bitset for
   each (position, letter).  A query word goes through the bitsets letter by
   letter, with four sets carried on at once: no error so far, one letter
   replaced, one deleted (positions shifted back), one inserted (shifted on).
   Bits are numbered by falling count, so the lowest bit of the result is the
   word's form; the number of set bits is its number of near words.
4. A bucket of over ``BLOCK`` words is dealt in blocks, each block of queries
   meeting each block of the index in a group of its own.  No pair of words is
   ever made a row.
5. Forms are followed to the root by joins of the words with themselves, twice as
   far each time; counts at least double along the way, so it ends.

* null and empty texts have no runs; very long texts are read whole; a null
  doc_id counts as the empty text in the hash; repeated rows are counted as often
  as they come; an empty table gives an empty result; further columns are ignored;
* of near words with equal counts the smallest in code-point order is the form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_scan, cut, join_sized, keep, scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = 5
LEAST = 3
#: A run whose hash this number divides loses a letter.
EVERY = 97
#: A form has at least so many times its word's occurrences.
TIMES = 2
#: Words of a bucket that are handled at once.
BLOCK = 2048

_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(doc_id: object, text: str | None) -> Counter[str]:
    """The words of a text with their counts, of any length."""
    runs: Counter[str] = Counter()
    for run, n in Counter(RUN.findall(text or "")).items():
        runs[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    prefix = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter[str] = Counter()
    for run, n in runs.items():
        h = crc32(run.encode(), prefix)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def step(c):
        total: Counter[str] = Counter()
        for doc_id, text in zip(c["doc_id"], c["text"]):
            total.update(words_of(doc_id, text))
        words = [w for w in total if len(w) >= LETTERS]
        return {"word": words, "n": [total[w] for w in words]}

    counted = arrow_scan(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), step, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


class Index:
    """Bitsets of words, most frequent first, by (position, letter) and by length."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words = sorted(words, key=lambda w: (-w[1], w[0]))
        size = len(self.words) // 8 + 1
        at: dict[tuple[int, str], bytearray] = {}
        lengths: dict[int, bytearray] = {}
        for k, (word, _) in enumerate(self.words):
            byte, bit = k >> 3, 1 << (k & 7)
            for bits, place in ((lengths, len(word)), *((at, place) for place in enumerate(word))):
                if place not in bits:
                    bits[place] = bytearray(size)
                bits[place][byte] |= bit
        self.at = {k: int.from_bytes(v, "little") for k, v in at.items()}
        self.lengths = {k: int.from_bytes(v, "little") for k, v in lengths.items()}
        self.all = (1 << len(self.words)) - 1

    def near(self, word: str, half: int | None = None, first: bool = True) -> int:
        """The bitset of the words one error away.  With ``half`` only pairs whose
        shorter word has that half, and of these the pairs that agree in their
        first ``half`` letters (``first``) or those that do not."""
        at = self.at
        exact, replaced, deleted, inserted = self.all, 0, 0, 0
        agreed = exact
        for k, letter in enumerate(word):
            here = at.get((k, letter), 0)
            inserted = (inserted | exact) & at.get((k + 1, letter), 0)
            deleted = (deleted & at.get((k - 1, letter), 0)) | exact
            replaced = (replaced & here) | (exact & ~here)
            exact &= here
            if k + 1 == half:
                agreed = exact
        m = len(word)
        same, shorter, longer = (self.lengths.get(m + d, 0) for d in (0, -1, 1))
        if half is not None:
            if m // 2 != half:
                same = longer = 0
            if (m - 1) // 2 != half:
                shorter = 0
        found = (replaced & same) | (deleted & shorter) | ((inserted | exact) & longer)
        if half is not None:
            found &= agreed if first else ~agreed
        return found

    def best(self, found: int) -> tuple[str, int]:
        """The most frequent word of a bitset that is not empty."""
        return self.words[(found & -found).bit_length() - 1]


def _grouped(words: DataFrame) -> DataFrame:
    """first, half, key, i, j, role, word, n: each word in its buckets' blocks;
    role 1 is a query, 2 a word of the index, 3 both."""
    m = F.length("word")
    halves = F.expr("array_distinct(array(int(length(word) div 2), int((length(word) - 1) div 2)))")
    one = words.select("word", "n", m.alias("m"), F.explode(halves).alias("half"))
    both = F.array(
        F.struct(F.lit(True).alias("first"), F.expr("substring(word, 1, half)").alias("part")),
        F.struct(F.lit(False).alias("first"), F.expr("substring(word, m - half + 1, half)").alias("part")),
    )
    placed = one.select("word", "n", "half", F.explode(both).alias("e")).select(
        "word", "n", "half", "e.first", F.xxhash64("e.part").alias("key")
    )
    bucket = ["first", "half", "key"]
    placed = cut(placed, "placed")
    sizes = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = cut(sizes.select(*bucket, F.ceil(F.col("size") / BLOCK).cast("int").alias("k")), "bucket-sizes")
    met = join_sized(placed, sizes, bucket, "inner").withColumn("own", F.pmod(F.xxhash64("word"), "k").cast("int"))
    roles = F.expr(
        "flatten(transform(sequence(0, k - 1), q -> if(q = own, array(struct(own as i, own as j, 3 as role)), "
        "array(struct(own as i, q as j, 1 as role), struct(q as i, own as j, 2 as role)))))"
    )
    return met.select(*bucket, "word", "n", F.explode(roles).alias("e")).select(*bucket, "e.i", "e.j", "e.role", "word", "n")


def _found(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n of every group that has near words of a word."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])
    group = ["first", "half", "key", "i", "j"]

    def matches(first: bool, half: int, rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
        indexed = [(w, n) for role, w, n in rows if role & 2]
        asked = [w for role, w, _ in rows if role & 1]
        if not indexed or not asked or len(indexed) == len(rows) == 1:
            return
        index = Index(indexed)
        for word in asked:
            found = index.near(word, half, first)
            if found:
                yield word, found.bit_count(), *index.best(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, out = None, [], []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for part in batches:
            columns = [part.column(k).to_pylist() for k in range(8)]
            for first, half, key, i, j, role, word, n in zip(*columns):
                if current != (first, half, key, i, j):
                    if rows:
                        out += matches(*current[:2], rows)
                    current, rows = (first, half, key, i, j), []
                rows.append((role, word, n))
            if out:
                yield batch()
                out = []
        if rows:
            out += matches(*current[:2], rows)
        yield batch()

    sorted_groups = _grouped(words).repartition(*group).sortWithinPartitions(*group)
    return sorted_groups.mapInArrow(run, "word string, n_near long, best string, best_n long")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the way from each word of (word, form)."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        now = cut(moved, "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of the vocabulary."""
    with scratch(docs.sparkSession) as own:
        words = cut(vocabulary(docs), "vocabulary")
        best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))  # of the largest n the smallest word
        near = _found(words).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
        taken = F.coalesce(-F.col("b.minus") >= TIMES * F.col("n"), F.lit(False))
        formed = cut(
            words.join(near, "word", "left").select(
                "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(taken, F.col("b.best")).alias("form"), F.when(taken, -F.col("b.minus")).alias("form_n"),
            ),
            "formed",
        )
        roots = followed(formed.where("form is not null").select("word", "form"))
        out = formed.join(roots, "word", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
        )
        out = cut(out, "spelling")
        keep(own)
        return out
