"""A vector index on files that is rebuilt batch by batch and switched at once.

Under the index's folder every version has its own folder of vectors, partitioned
by batch, and a manifest of the batches that are finished; the file ``CURRENT``
names the version that readers see.  Files that say something are written aside
and renamed over the old ones, so a reader finds the old or the new state, whole.

A rebuild writes a wave of batches, then the manifest.  If it is stopped, the next
one with the same model goes on with the same version: batches in the manifest
whose rows are still the same are left, all others are written (again).  A batch is
a hash of the id, so it holds the same rows each time, and a batch from which rows
have gone or in which a text has changed is not the same.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: Texts of a tenant in one call of the model.
CALL = 32

#: A function from a tenant and its texts to as many vectors.
Embed = Callable[[object, list[str]], list]


class Store:
    """Small files in a folder that driver and executors share, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.jvm = spark, folder.rstrip("/"), spark._jvm
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def read(self, name: str) -> dict:
        """What a file says; nothing if there is none."""
        if not self.exists(name):
            return {}
        stream = self.files.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        aside = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = self.files.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        folder = self._path("").toUri()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder, self.spark._jsc.hadoopConfiguration())
        context.rename(aside, self._path(name), over)

    def exists(self, name: str) -> bool:
        return self.files.exists(self._path(name))

    def delete(self, name: str) -> None:
        self.files.delete(self._path(name), True)


def state(spark: SparkSession, folder: str) -> dict:
    """status (ready or needs_rebuild), signature and reason; ready without a
    signature where nothing was ever indexed."""
    return {"status": "ready", "signature": "", "reason": ""} | Store(spark, folder).read("STATE")


def needs_rebuild(spark: SparkSession, folder: str, reason: str) -> None:
    Store(spark, folder).write("STATE", state(spark, folder) | {"status": "needs_rebuild", "reason": reason})


def model_changed(spark: SparkSession, folder: str, signature: str, has_chunks: bool) -> bool:
    """Whether an index has to be rebuilt for the model of this signature; if so its
    state says so.  Without a model nothing changes; an index that never had rows
    just takes the signature."""
    now = state(spark, folder)
    if not signature or (now["status"] == "ready" and now["signature"] == signature):
        return now["status"] != "ready"
    if now["status"] == "ready" and not now["signature"] and not has_chunks:
        Store(spark, folder).write("STATE", now | {"signature": signature})
        return False
    needs_rebuild(spark, folder, "embedding_model_changed")
    return True


def read(spark: SparkSession, folder: str) -> DataFrame:
    """id, tenant_id, vector of the version that is current."""
    current = Store(spark, folder).read("CURRENT")
    if not current:
        raise ValueError(f"{folder} has no finished index")
    return spark.read.parquet(f"{folder.rstrip('/')}/{current['version']}/vectors").drop("batch")


def _vectors(embed: Embed):
    """Vectors of (tenant, text) rows, ``CALL`` texts of a tenant to a call; null where
    a call fails or gives another number of vectors."""

    @pandas_udf("array<double>")
    def vectors(tenants: pd.Series, texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        for tenant, own in texts.fillna("").groupby(tenants, dropna=False, sort=False):
            places = texts.index.get_indexer(own.index)
            for k in range(0, len(own), CALL):
                try:
                    made = list(embed(tenant, own.iloc[k : k + CALL].tolist()))
                except Exception:  # contained: these texts are counted as errors
                    continue
                if len(made) == len(places[k : k + CALL]):
                    for at, vector in zip(places[k : k + CALL], made):
                        out[at] = vector
        return pd.Series(out)

    return vectors.asNondeterministic()  # so a call is made once for each text


def rebuild(
    chunks: DataFrame, folder: str, embed: Embed, signature: str,
    n_batches: int = 64, at_once: int = 16, cancelled: Callable[[], bool] = lambda: False,
) -> dict:
    """Index chunks (id, tenant_id, content) and switch to the new version.

    Gives indexed, errors (rows without a vector, which are not in the index),
    batches (written by this call), reused (finished before) and cancelled.  A
    cancelled rebuild leaves readers what they had.  If no row could be indexed the
    index stays in need of a rebuild and that is an error."""
    spark, store = chunks.sparkSession, Store(chunks.sparkSession, folder)
    root = store.folder
    batch = F.pmod(F.xxhash64("id"), F.lit(n_batches)).cast("int")
    placed = chunks.select("id", "tenant_id", "content", batch.alias("batch"))
    mark = F.sum(F.xxhash64("id", "tenant_id", "content").cast("decimal(38,0)")).cast("string")
    prints = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), mark.alias("mark")).collect()  # n_batches rows
    wanted = {str(r.batch): {"n": r.n, "mark": r.mark} for r in prints}

    begun = store.read("BUILDING")
    if begun.get("signature") != signature or begun.get("n_batches") != n_batches:
        if begun:
            store.delete(begun["version"])
        begun = {"version": f"v-{uuid.uuid4().hex}", "signature": signature, "n_batches": n_batches}
        store.write("BUILDING", begun)
    version = begun["version"]
    finished = {k: v for k, v in store.read(f"{version}/MANIFEST").items() if v["of"] == wanted.get(k)}
    open_batches = sorted(int(k) for k in wanted if k not in finished)
    result = {"batches": 0, "reused": len(finished), "cancelled": False}

    staged = f"{root}/{version}/texts-{uuid.uuid4().hex}"
    if open_batches and not cancelled():
        left = placed.where(F.col("batch").isin(open_batches)).repartition("batch", F.xxhash64("id") % 64)
        left.write.partitionBy("batch").parquet(staged)
        vector = _vectors(embed)
    for k in range(0, len(open_batches), at_once):
        if cancelled():
            result["cancelled"] = True
            break
        wave = open_batches[k : k + at_once]
        texts = spark.read.schema(placed.schema).parquet(staged).where(F.col("batch").isin(wave))
        made = texts.select("id", "tenant_id", vector("tenant_id", "content").alias("vector"), "batch").where("vector is not null")
        target = f"{root}/{version}/vectors"
        for b in wave:  # what a wave that was stopped has left
            store.delete(f"{version}/vectors/batch={b}")
        made.write.mode("append").partitionBy("batch").parquet(target)
        counts = spark.read.schema(made.schema).parquet(target).where(F.col("batch").isin(wave))
        found = {r.batch: r["n"] for r in counts.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
        finished |= {str(b): {"of": wanted[str(b)], "indexed": found.get(b, 0)} for b in wave}
        store.write(f"{version}/MANIFEST", finished)
        result["batches"] += len(wave)
    store.delete(staged[len(root) + 1 :])
    indexed = sum(f["indexed"] for f in finished.values())
    result |= {"indexed": indexed, "errors": sum(f["of"]["n"] for f in finished.values()) - indexed}
    if result["cancelled"]:
        return result
    if wanted and not indexed:
        needs_rebuild(spark, folder, "no_vectors")
        raise ValueError(f"no vector could be made for {result['errors']} chunks")
    _tidy(store, version, placed, wanted)
    before = store.read("CURRENT").get("version")
    store.write("CURRENT", {"version": version, "signature": signature})
    store.write("STATE", {"status": "ready", "signature": signature, "reason": ""})
    store.delete("BUILDING")
    if before and before != version:
        store.delete(before)
    return result


def _tidy(store: Store, version: str, placed: DataFrame, wanted: dict) -> None:
    """Take away batches that the chunks no longer have; an index of no chunks is an empty table."""
    target = f"{store.folder}/{version}/vectors"
    if store.exists(f"{version}/vectors"):
        for r in store.spark.read.parquet(target).select("batch").distinct().collect():
            if str(r.batch) not in wanted:
                store.delete(f"{version}/vectors/batch={r.batch}")
    if not wanted:
        store.delete(f"{version}/vectors")
        placed.select("id", "tenant_id", F.array().cast("array<double>").alias("vector")).limit(0).write.parquet(target)
