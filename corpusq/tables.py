"""Intermediate tables in the shared folder, and broadcasts with a checked bound."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a narrow table that may be sent to every executor.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.
    A local session without one gets a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: it is computed once
    for all that follows, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def planned(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the planner (dots written as __) for what is written in the block."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sized(table: DataFrame) -> DataFrame:
    """A written table as a broadcast side where its row count is within the bound."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def positions(df: DataFrame, group: str, order: str) -> DataFrame:
    """Rows with ``position``, counted from 1 in a group by an order that has no
    ties.  The table is sorted by range and numbered within its parts, so a group
    of any size spreads out; only the counts of the parts are summed in one place."""
    name = f"{group}-{order}"
    ranged = df.repartitionByRange(group, order).sortWithinPartitions(group, order)
    place = F.monotonically_increasing_id()
    rows = written(ranged.select("*", F.shiftright(place, 33).alias("part"), place.alias("place")), name)
    counts = rows.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = written(counts.select(group, "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), name)
    joined = rows.join(sized(starts), [group, "part"])
    return joined.withColumn("position", F.col("before") + F.col("place") - F.col("first") + 1).drop("part", "place", "first", "before")
