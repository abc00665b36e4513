"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt to all of them: such a file is often one row group,
    which a single task reads and all that follows would stay in. Tables of more files, or of
    more bytes than the cores' first splits, are left as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if size >= cores * split or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
