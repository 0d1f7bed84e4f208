"""Mixing sources to target weights by systematic sampling.

The expected copies of a document are its source's target over its source's
size.  Within a source the documents stand in order of size, the expected
copies are summed along that order, one random offset per source is added, and
a document is emitted once for each whole number that its stretch crosses.  As
sizes only rise along the order, what a source takes differs from its target
by about its largest document at most.

The prefix sum has two levels, so that a source with any share of the rows is
spread out: rows are numbered within small blocks of (source, size class, id
hash), and block counts, one row per block, are summed along the source.  The
order is (size class, id hash, size, doc_id, hash of the text).

* null text has size 0; the null source is a source of its own, last in order;
* documents without words are never taken; sources without words get target 0;
* very long texts count whole; repeated rows are numbered apart; an empty table
  gives an empty result;
* the offset is a hash of seed and source, so reruns agree.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, fresh

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix-1"
#: Blocks of a source and size class; a power of 16.
ID_HASHES = 256
#: Parts in which equal rows are numbered.
SALTS = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Binary order of magnitude and the next three bits: sizes of a class differ by an eighth."""
    bits = F.length(F.bin(size))
    eighth = F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0)) & 7")
    return (bits * 8 + eighth).cast("int")


def offset_of(source: Column, seed: str) -> Column:
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 5), 16, 10).cast("double") / float(1 << 20)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target from one row per source.

    The shares are those of a common level: target = least(weight * level,
    most * size), where the level makes the targets add up to all words.
    Sources are ordered by the level at which they stop, and the level follows
    from running sums: the first k stop, the rest share what is left.  The
    table has one row per source, whatever the number of documents, and its
    windows take all of these together: sources are sites or collections, not
    single documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("stop", most * F.col("source_size") / F.col("weight"))
    along = W.orderBy("stop", F.col("source").asc_nulls_last())
    before = along.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (
        F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("level_here", level)
    # the level rises while the sources before it do stop, and falls where they would not
    chosen = levelled.withColumn("level", F.max("level_here").over(everything))
    cap = most * F.col("source_size").cast("double")
    return chosen.select(
        "source", "source_size", F.least(F.coalesce(F.col("weight") * F.col("level"), cap), cap).alias("target")
    )


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, place (a hash of the text), class and id_hash of every row, written."""
    text_hash = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    sized = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("place"),
        F.conv(F.substring(text_hash, 1, 2), 16, 10).cast("int").alias("id_hash"),
    )
    return cut(sized.withColumn("class", size_class(F.col("size"))), "mix-sizes")


def plan_groups(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, place, size, source_size, target, times: one row for all
    rows of ``sizes`` equal in the first three.  ``times`` says how many of these
    are taken 0, 1, ... ``most_copies`` times: expected copies are the same along
    the source, so a stretch of n rows has two numbers of copies at most."""
    equal = cut(
        sized.groupBy("source", "class", "id_hash", "size", "doc_id", "place").agg(F.count(F.lit(1)).alias("n")), "mix-equal"
    )

    blocks = cut(
        equal.groupBy("source", "class", "id_hash").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("words")),
        "mix-blocks",
    )
    targets = source_targets(
        blocks.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), weights, most_copies
    ).withColumn("offset", offset_of(F.col("source"), seed))
    along = W.partitionBy("source").orderBy("class", "id_hash").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(
        "source", "class", "id_hash", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before")
    )
    t, s = targets.alias("t"), starts.alias("s")
    placed = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("b_source"), F.col("class").alias("b_class"), F.col("id_hash").alias("b_hash"),
        "before", "source_size", "target", "offset",
    )

    inside = W.partitionBy("source", "class", "id_hash").orderBy("size", "doc_id", "place").rowsBetween(W.unboundedPreceding, 0)
    numbered = equal.withColumn("rank", F.sum("n").over(inside))
    joined = numbered.join(
        placed,
        numbered["source"].eqNullSafe(placed["b_source"])
        & (numbered["class"] == placed["b_class"])
        & (numbered["id_hash"] == placed["b_hash"]),
    )
    expected = F.col("target") / F.col("source_size")
    upto = F.col("before") + F.col("rank")
    crossed = F.floor(expected * upto + F.col("offset")) - F.floor(expected * (upto - F.col("n")) + F.col("offset"))
    low = F.least(F.when(F.col("n") == 1, crossed).otherwise(F.floor(expected)), F.lit(most_copies))
    more = F.greatest(F.lit(0), F.least(F.col("n"), crossed - F.col("n") * low))
    more = F.when(low < most_copies, more).otherwise(F.lit(0))
    taken = [
        F.when(low == c, F.col("n") - more).when(low + 1 == c, more).otherwise(F.lit(0)) for c in range(most_copies + 1)
    ]
    nothing = F.array(F.col("n"), *[F.lit(0).cast("long")] * most_copies)
    times = F.when(F.col("size") > 0, F.array(*[x.cast("long") for x in taken])).otherwise(nothing)
    return joined.select("doc_id", "source", "place", "size", "source_size", "target", times.alias("times"))


def _dealt(rows: DataFrame, place: Column, groups: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows, ``place`` being the hash of their text, with the columns of their group (named by ``names``) and the number
    of ``copies`` of each.  Where it differs within a group, the group's rows are
    numbered in salted parts, so that one of any size is spread out, and are
    dealt the counts in order."""
    most = F.size(names["times"]) - 1
    key = [names[n] for n in ("doc_id", "source", "place")]
    named = groups.select(*[F.col(c).alias(names[c]) for c in groups.columns])
    same = (
        rows["doc_id"].eqNullSafe(named[key[0]])
        & rows["source"].cast("string").eqNullSafe(named[key[1]])
        & (place == named[key[2]])
    )
    joined = rows.join(named, same)
    kinds = F.size(F.filter(names["times"], lambda n: n > 0))
    only = F.array_position(F.transform(names["times"], lambda n: n > 0), True) - 1
    out = joined.where(kinds == 1).withColumn(names["copies"], only)
    if named.where(kinds > 1).isEmpty():
        return out
    salt, before, number = names["salt"], names["before"], names["number"]
    several = cut(
        joined.where(kinds > 1).withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))), "mix-several"
    )
    along = W.partitionBy(*key).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    parts = several.groupBy(*key, salt).agg(F.count(F.lit(1)).alias(number))
    starts = parts.select(*key, salt, F.coalesce(F.sum(number).over(along), F.lit(0)).alias(before)).alias("s")
    inside = W.partitionBy(*key, salt).orderBy(F.lit(0))
    m = several.withColumn(number, F.row_number().over(inside)).alias("m")
    met = m.join(starts, reduce(and_, (F.col(f"m.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in [*key, salt])))
    # the first copies value whose rows, with those of smaller ones, reach the row's number
    reach = lambda c: F.aggregate(F.slice(names["times"], 1, c + 1), F.lit(0).cast("long"), lambda a, n: a + n)
    nth = F.col(before) + F.col(number)
    copies = F.element_at(F.filter(F.sequence(F.lit(0), most), lambda c: reach(c) >= nth), 1).cast("long")
    columns = [F.col(f"m.`{c}`") for c in joined.columns]
    return out.unionAll(met.select(*columns, copies.alias(names["copies"])))


_OF_GROUP = ("doc_id", "source", "place", "size", "source_size", "target", "times", "copies", "salt", "before", "number")


def mix_plan(docs: DataFrame, **params) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per input row."""
    sized = sizes(docs)
    rows = sized.select("doc_id", "source", F.col("place").alias("row_place"))
    names = {n: fresh(rows, f"__{n}") for n in _OF_GROUP}
    dealt = _dealt(rows, F.col("row_place"), cut(plan_groups(sized, **params), "mix-plan"), names)
    own = [F.col(names[c]).alias(c) for c in ("source", "size", "source_size", "target", "copies")]
    return dealt.select("doc_id", *own)


def mix(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mix: all columns, each row as often as ``mix_plan``
    takes it, with its number among the copies in ``copy_no``."""
    names = {n: fresh(docs, f"__{n}") for n in _OF_GROUP}
    taken = F.exists(F.slice("times", 2, F.size("times")), lambda n: n > 0)
    groups = cut(plan_groups(sizes(docs), **params).where(taken).select("doc_id", "source", "place", "times"), "mix-plan")
    dealt = _dealt(docs, F.xxhash64(docs["text"]), groups, names).where(F.col(names["copies"]) > 0)
    copy_no = F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int"))).alias(fresh(docs, "copy_no"))
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns], copy_no)
