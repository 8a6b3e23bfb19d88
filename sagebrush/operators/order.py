"""Numbers along a global order, without bringing all rows into one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which driver and executors share.

    ``spark.checkpoint.dir`` names it; a local session without it gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base and (not sc.master.startswith("local") or "cluster" in sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def until_exit(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the session ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as written to the shared folder and read again: what is random in it stays as it is, also where a lost
    executor's work is done again. The folder goes when the session ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    until_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parted(rows: DataFrame, weight: Column, *order: Column) -> DataFrame:
    """``rows`` with _weight and _part, the number of the part of the order's range that a row is in."""
    dealt = rows.withColumn("_weight", weight.cast("long")).repartitionByRange(*order)
    return written(dealt.withColumn("_part", F.spark_partition_id()), "parts")


def running_total(rows: DataFrame, name: str, weight: Column, *order: Column) -> DataFrame:
    """``name``: the sum of ``weight`` over all rows up to each, in ``order``, which must have no ties.

    Rows are parted by range; each part sums its own rows, and the sums of the parts before it, one number a part, are added.
    """
    return running_within(rows, name, weight, [], *order)


def running_within(rows: DataFrame, name: str, weight: Column, keys: list[str], *order: Column) -> DataFrame:
    """``name``: the sum of ``weight`` over the rows of the same ``keys`` up to each, in ``order``. Null keys are values.

    The order's range is parted by keys first, so a hot key has many parts, and of the keys in a part only the first
    one's rows may have others in earlier parts. What those sum to, one row a part, is carried over.
    """
    dealt = parted(rows, weight, *(F.col(f"`{k}`") for k in keys), *order)
    within = F.sum("_weight").over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = dealt.groupBy("_part", *keys).agg(F.sum("_weight").alias("_size"))
    # Keys that stand in several parts; each part holds two of them at most, its first and its last.
    several = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_parts")).filter("_parts > 1") if keys else None
    spread = sizes
    if several is not None:
        same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
        spread = sizes.alias("s").join(several.alias("t"), same, "left_semi")
    before = spread.withColumn("_before", F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).filter("_before is not null")
    before = before.select(F.col("_part").alias("_in"), "_before", *(F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)))
    here = [F.col("_part") == F.col("_in"), *(F.col(f"`{k}`").eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys))]
    found = dealt.withColumn("_within", within).join(F.broadcast(before), here, "left")
    return found.withColumn(name, F.col("_within") + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def ranked(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """1..n in ``order``, which must have no ties."""
    return running_total(rows, name, F.lit(1), *order)


def rank_within(rows: DataFrame, name: str, keys: list[str], *order: Column) -> DataFrame:
    """1..n in ``order`` within each value of ``keys``; a hot value's rows are parted too. Null keys are values."""
    return running_within(rows, name, F.lit(1), keys, *order)
