"""Shared helpers: shared-folder scratch tables, Arrow text access, hashing, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Freed batches go back to the system at once: executors hold few workers' worth of memory.
pa.set_memory_pool(pa.system_memory_pool())

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local folder in local mode, an error on
    a cluster: there every executor would write its own part."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root or "/tmp/checkpoints/loomstone"


class Scratch:
    """Intermediate tables in the shared folder, so that lost executors cost no recomputation.

    Tables dropped explicitly go at once, the rest when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/loomstone-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.base))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it reread: the lineage ends here."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._fs.delete(self._path(df._scratch_path), True)


def flush_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, which lets Spark remove shuffle files nobody can read any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array and the offsets of each; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int):
    """Ranges of whole texts of about ``most`` bytes; a longer text makes its own range."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            up, down = np.full(n, BASE, U64), np.full(n, INV, U64)
            up[0] = down[0] = U64(1)
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


def fold_shares(df: DataFrame, mod: int, alias: str) -> DataFrame:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return df.withColumn(alias, F.expr(f"crc32(encode(coalesce(cast(doc_id as string), ''), 'UTF-8')) % {mod}"))


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that executors exchange with Python by rows and, where Spark can, by bytes: whole texts are long."""
    for key, most in BATCH.items():
        try:
            now = spark.conf.get(key).lower()
        except Exception as e:
            if "SQL_CONF_NOT_FOUND" not in str(e):
                raise
            continue  # a Spark without this setting
        number = now.rstrip("bkmg")
        now = int(number) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[len(number) : len(number) + 1], 1)
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(scratch: Scratch, edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, comp) of every node in ``edges`` (a, b): comp is the smallest node it can reach.

    Alternating large-star and small-star rounds; every round is cut in the shared folder. Per node only
    a minimum is gathered, so hubs pre-aggregate before the shuffle.
    """
    cur, before = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    for _ in range(most):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.keep(small.union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        # Equal digests of two rounds: nothing moves any more, every node hangs on its smallest reachable node.
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(cur)
        cur = nxt
        if now == before:
            return nodes.join(cur.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("comp"))
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")
