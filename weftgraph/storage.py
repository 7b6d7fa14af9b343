"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
    return spark.sparkContext.getCheckpointDir()


_written: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared folder as Parquet and read from there.

    A lost executor costs nothing that was written, and every later use reads instead of computing again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def sized(df: DataFrame) -> DataFrame:
    """The frame, which no join broadcasts by its size if its rows take more than autoBroadcastJoinThreshold in memory.

    Spark takes the size of the files for that of the rows. Keys in order shrink to a tenth and less in Parquet, and a
    table that is broadcast passes the driver whole.
    """
    spark = df.sparkSession
    jvm, most = spark._jvm, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if df.count() * 8 * (2 + len(df.columns)) <= max(most, 0):  # a count of Parquet reads footers only
        return df
    plans = jvm.org.apache.spark.sql.catalyst.plans.logical
    hint = plans.HintInfo(jvm.scala.Some(getattr(getattr(plans, "NO_BROADCAST_HASH$"), "MODULE$")))
    plan = plans.ResolvedHint(df._jdf.logicalPlan(), hint)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def release(df: DataFrame) -> None:
    """Deletes what materialise() has written for this very frame, if it is one of those."""
    name = getattr(df, "__dict__", {}).get("_weft_path")
    if name in _written:
        _written.remove(name)
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> int:
    """Deletes what this process has written by materialise(); frames read from there can't be used any more."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
