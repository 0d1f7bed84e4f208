"""Tables in the shared folder, size-checked joins and Arrow scans."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (a few longs) that may be sent to every executor.
BROADCAST_ROWS = 200_000
#: Bits of the bitmaps of keys: 16 MB.
BITS = 1 << 27


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see.

    Where a local session has none a temporary one is set; on a cluster, where
    executors would not see such a folder, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_local = threading.local()


def _blocks() -> list[list[str]]:
    """Folders of the tables that this thread's ``scratch`` blocks have written, innermost last."""
    if not hasattr(_local, "blocks"):
        _local.blocks = []
    return _local.blocks


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs start
    from the files, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if _blocks():
        _blocks()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``cut`` writes in the block are deleted at its end.  A result
    that outlives the block is written in it and taken out of the yielded list
    by ``keep``."""
    _blocks().append([])
    try:
        yield _blocks()[-1]
    finally:
        for path in _blocks().pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keep(written: list[str]) -> None:
    """Hand the last table that was written in a ``scratch`` block to the block around it."""
    path = written.pop()
    if len(_blocks()) > 1:
        _blocks()[-2].append(path)


def small(df: DataFrame) -> bool:
    """Whether a written table has few enough rows to broadcast."""
    return df.count() <= BROADCAST_ROWS


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a written table: broadcast when its row count is within the
    bound, else a shuffled join that Spark may split where keys are hot."""
    return left.join(F.broadcast(right) if small(right) else right, on, how)


def bitmap(keys: DataFrame, key: Column, name: str) -> DataFrame:
    """(bucket, bitmap) of the hashes of a table's keys, written: one bit of
    ``BITS`` for each, in at most BITS / 32768 rows of 4 KB."""
    bit = keys.select((F.pmod(F.xxhash64(key), F.lit(BITS)) + 1).alias("bit"))
    made = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap")
    )
    return cut(made, name)


def with_bit(df: DataFrame, bits: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows with a column that is false where the bitmap does not hold their key;
    where it is true the key may be one that shares its bit with another.  The
    bitmap has a fixed size and goes to every executor."""
    bit, bucket, held = (fresh(df, f"{name}_{n}") for n in ("bit", "bucket", "held"))
    placed = df.withColumn(bit, F.pmod(F.xxhash64(key), F.lit(BITS)) + 1)
    sent = F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(held)))
    joined = placed.join(sent, F.bitmap_bucket_number(bit) == F.col(bucket), "left")
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(held, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn(name, is_set).drop(bit, bucket, held)


def meet(df: DataFrame, keys: DataFrame, on: dict[str, Column], how: str) -> DataFrame:
    """Join wide rows with a written narrow table of distinct keys: ``on`` maps
    the table's columns to the rows' expressions, ``how`` is inner or left_anti.

    A table within the bound is broadcast.  A larger one first sends a bitmap,
    and only rows that may have a partner are shuffled."""
    equal = reduce(and_, (F.col(f"`{c}`") == value for c, value in on.items()))
    if small(keys):
        return df.join(F.broadcast(keys), equal, how)
    name, key = fresh(df, "__may"), F.struct(*[value.alias(c) for c, value in on.items()])
    of_keys = F.struct(*[F.col(f"`{c}`").alias(c) for c in on])
    marked = with_bit(df, bitmap(keys, of_keys, "keys-bits"), key, name)
    met = marked.where(name).drop(name).join(keys, equal, how)
    if how == "inner":
        return met
    return met.unionAll(marked.where(~F.col(name)).drop(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_scan(
    df: DataFrame, step: Callable[[dict[str, list]], dict[str, list]], schema: str | object
) -> DataFrame:
    """Apply ``step`` (columns as lists in, columns as lists or arrays out) to
    every Arrow batch; nothing outlives a batch."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    typed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    out_schema = to_arrow_schema(typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = step(columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in out_schema], schema=out_schema
            )

    return df.mapInArrow(run, typed)


def arrow_filter(df: DataFrame, keep: Callable[[list], list], column: str = "text") -> DataFrame:
    """The rows whose value of a column ``keep`` accepts, all columns as they
    came: decided where the rows are, without a join or a shuffle."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(list(keep(batch.column(at).to_pylist())), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n (null ids give null)."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))
