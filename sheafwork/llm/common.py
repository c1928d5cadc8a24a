"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, in the spelling of Java's and RE2's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A key is hot if it has more than one row in so many; so many keys are hot at most.
HOT_KEYS = 1000
#: Lookup tables of so many rows at most (they are counted first) are broadcast whole.
BROADCAST_ROWS = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return "/tmp/checkpoints"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows and bytes of the batches that go to Python workers, where the session has Spark's own numbers: texts are long.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, which the JVM and a worker each hold."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint in the shared folder: lost executors don't cost them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hot_safe_lookup(facts: DataFrame, dims: DataFrame, keys: Sequence[str], weight: str, spread: Column, most: int | None = None) -> DataFrame:
    """Left join of facts to dims, which has one row a key (no null keys) and in ``weight`` the key's rows among facts.

    A table of BROADCAST_ROWS or fewer is broadcast; ``most`` is a number that dims is known not to exceed, if there is
    one. Beyond that, keys with more than one row in HOT_KEYS, at most HOT_KEYS of them, come from a broadcast table;
    their rows are dealt out over the other join's partitions by ``spread``, so that no task gathers a hot key. Both
    sides of that join are plain exchanges, so AQE splits what partitions of lesser keys still weigh too much. dims is
    read three times and should be a checkpoint.
    """
    rest = [c for c in dims.columns if c not in keys]
    if most is not None and most <= BROADCAST_ROWS:
        return facts.join(F.broadcast(dims), list(keys), "left").select(*facts.columns, *rest)
    rows, total = dims.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if rows <= BROADCAST_ROWS:
        return facts.join(F.broadcast(dims), list(keys), "left").select(*facts.columns, *rest)
    hot = F.col(weight) * F.lit(HOT_KEYS) > F.lit(total)
    few = dims.filter(hot).select(*keys, F.struct(*rest).alias("_hot"))
    many = dims.filter(~hot).select(*keys, F.lit(0).alias("_deal"), F.struct(*rest).alias("_cold"))
    out = facts.join(F.broadcast(few), list(keys), "left")
    out = out.withColumn("_deal", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int") + 1).otherwise(0))
    out = out.join(many, [*keys, "_deal"], "left")
    return out.select(*facts.columns, *(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in rest))


def write_shared(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, and the path for drop_shared.

    For loops: unlike a checkpoint, whose size is the planner's estimate (a product of sizes for each join, so that its
    digits double with each round), a file has the size that it has.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_finished(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished phases now rather than when the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
