"""What operators over tables of any size share: kept tables, a shared folder, running sums over a whole order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one if everything runs on this machine; else it raises."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that it is worked out once and its lineage ends there.

    A checkpoint would hand on the constraints that the optimiser inferred, which multiply from round to round of an iteration.
    """
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kept-{spark.sparkContext.applicationId}"


def drop_kept(spark: SparkSession) -> None:
    """Deletes all tables that kept() wrote for this application; results that still read them must have been written before."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def met(asked: DataFrame, points: DataFrame, answer: Callable[[pa.Table, pa.Table], pa.Table], shape: str, most: int, salt: list[str]) -> DataFrame:
    """asked and points, leaf by leaf, through answer. A leaf that more than `most` rows ask for is dealt, by a hash of the salt
    columns, over several tasks, each with the leaf's points; leaves of points are bounded already."""
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own, also where both are of one table
    crowded = asked.groupBy("leaf").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    if crowded.isEmpty():
        return asked.groupBy("leaf").cogroup(points.groupBy("leaf")).applyInArrow(answer, shape)
    crowded = F.broadcast(kept(crowded))  # at most one row for each `most` rows that ask
    part = F.pmod(F.xxhash64(*salt), F.coalesce("parts", F.lit(1))).cast("int")
    left = asked.join(crowded, "leaf", "left").select(*asked.columns, part.alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    right = points.join(crowded, "leaf", "left").withColumn("part", every).drop("parts")
    return left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(answer, shape)


def running(df: DataFrame, order: list[Column | str], value: Column | str, name: str = "before") -> DataFrame:
    """df with the sum of value over all rows before each in the given order, which no two rows should share.

    Rows are sorted in ranges, one a task; a range adds the sums of the ranges before it, one number each.
    """
    value = F.col(value) if isinstance(value, str) else value
    cut = kept(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sums = cut.groupBy("__p").agg(F.sum("__v").alias("__s"))
    starts = sums.withColumn("__start", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")  # a row a range
    inside = F.coalesce(F.sum("__v").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + inside).drop("__p", "__v", "__start")
