"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

One scan writes each row's length and prefix hash, a narrow table.  From it come
the lengths, and of these the pairs of length and prefix, that two or more rows
share.  The surviving pairs go to the scans of the texts as a bitmap of fixed
size: a row whose bit is not set has no copy, and its text is not hashed.  A
pair that shares its bit with a surviving one only costs a hash; groups are those
of equal full hashes.  The bitmap is the same for few and for many survivors.
Everything is a built-in expression.

* null text counts as empty; runs of ASCII white space count as one space; very
  long texts are hashed whole;
* rows that repeat a ``doc_id`` with equal text are one document and share its
  decision; a group whose ids are all null keeps all its rows (``keep_id`` null);
* an empty table gives an empty result; further columns are ignored.

No step needs all rows of a group in one task: groups are aggregated with
map-side combining, and the joins are plain equi-joins against one row per
group, whose hot side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, cut, fresh, join_sized, small, with_bit

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _size(norm: Column) -> Column:
    return F.octet_length(norm)


def _prefix(norm: Column, chars: int) -> Column:
    return F.xxhash64(F.substring(norm, 1, chars))


def surviving_bits(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Bitmap of the lengths and prefixes that two or more rows share."""
    norm = normalised(F.col("text"))
    rows = cut(docs.select(_size(norm).alias("size"), _prefix(norm, prefix_chars).alias("prefix")), "dedup-prefixes")
    sizes = cut(rows.groupBy("size").count().where("count > 1").select("size"), "dedup-sizes")
    pairs = join_sized(rows, sizes, ["size"], "left_semi").groupBy("size", "prefix").count().where("count > 1")
    return bitmap(pairs, F.struct("size", "prefix"), "dedup-bits")


def _hashed(docs: DataFrame, bits: DataFrame, prefix_chars: int, names: dict[str, str]) -> DataFrame:
    """The rows with their normalised text, whether their bit is set, and the
    text's hash where it is, else null."""
    norm = normalised(F.col("text"))
    key = F.struct(_size(norm).alias("size"), _prefix(norm, prefix_chars).alias("prefix"))
    marked = with_bit(docs.withColumn(names["norm"], norm), bits, key, names["set"])
    return marked.withColumn(names["sha"], F.when(F.col(names["set"]), F.sha2(names["norm"], 256)))


def _groups(hashed: DataFrame, sha: str) -> DataFrame:
    """(sha, keep_id, group_size) of the texts that occur twice or more."""
    found = hashed.groupBy(F.col(sha).alias("sha")).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return found.where("group_size > 1")


_NAMES = ("norm", "set", "sha")


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    The result shows every text's hash, so here all texts are hashed, once; the
    groups are looked for among the survivors only."""
    docs = docs.select("doc_id", "text")
    names = {n: fresh(docs, f"__{n}") for n in _NAMES}
    marked = _hashed(docs, surviving_bits(docs, prefix_chars), prefix_chars, names)
    rows = cut(
        marked.select(
            "doc_id",
            F.sha2(names["norm"], 256).alias("text_sha256"),
            F.col(names["set"]).alias("survives"),
        ),
        "dedup-hashed",
    )
    groups = cut(_groups(rows.where("survives"), "text_sha256"), "dedup-groups")
    joined = rows.join(groups, F.col("text_sha256") == F.col("sha"), "left_outer")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The documents without exact copies, all columns as they came.

    Only survivors are hashed.  While the groups are few enough to send to every
    executor the texts stay where they are; beyond that the survivors' rows meet
    the groups in a shuffle, and all other rows pass by it."""
    names = {n: fresh(docs, f"__{n}") for n in _NAMES}
    group, keep = fresh(docs, "__group"), fresh(docs, "__keep")
    hashed = _hashed(docs, surviving_bits(docs, prefix_chars), prefix_chars, names)
    sha = names["sha"]
    groups = cut(_groups(hashed.where(names["set"]).select("doc_id", sha), sha), "dedup-groups").select(
        F.col("sha").alias(group), F.col("keep_id").alias(keep)
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = hashed.select(*columns, sha, names["set"])
    stays = F.col(keep).isNull() | F.col("doc_id").eqNullSafe(F.col(keep))
    if small(groups):
        return rows.join(F.broadcast(groups), F.col(sha) == F.col(group), "left").where(stays).select(*columns)
    met = rows.where(names["set"]).join(groups, F.col(sha) == F.col(group), "left").where(stays)
    return rows.where(~F.col(names["set"])).select(*columns).unionAll(met.select(*columns))
