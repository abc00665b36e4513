"""Files as they arrive: the batch pipeline on each micro-batch. The engine needs no state of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources import pages
from quire.sources.files import documents_in


def watch(
    spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*.pdf"
) -> StreamingQuery:
    """Runs ``handle`` over each batch of new files until there are none."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return (
        files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def watch_blocks(
    spark: SparkSession, path: str, checkpoint: str, target: str, make_decoder: Callable,
    make_engine: Callable | None = None, glob: str = "*.pdf", **options
) -> StreamingQuery:
    """The canonical blocks of new files, as Parquet in ``target``, a folder for each batch: a batch that is run
    again after a failure replaces what it wrote."""

    def handle(files: DataFrame, batch: int) -> None:
        blocks = pages.page_blocks(pages.read_pages(documents_in(files), make_decoder, make_engine, **options))
        blocks.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return watch(spark, path, checkpoint, handle, glob)
