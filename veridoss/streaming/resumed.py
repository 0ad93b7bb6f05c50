"""Inference over a growing folder as a stream: each batch is done once, however often the run is stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def infer_stream(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, files_a_batch: int = 16) -> DataFrame:
    """Results of work on every row of the Parquet files below source, old and new, each in the part of its batch.

    The checkpoint below ``out`` says which files a batch has, so a batch that is tried again has the same rows. Its
    part is written whole, under the batch's number; one that was finished before a stop is left as it is, so no
    row's work is done twice once its part is there. Ends when there are no further files; call again for later ones.
    """

    def each(batch: DataFrame, number: int) -> None:
        part = f"{out}/parts/batch_no={number}"
        if not _exists(spark, f"{part}/_SUCCESS"):
            work(batch).write.mode("overwrite").parquet(part)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{out}/parts").parquet(f"{out}/parts").withColumn("batch_no", F.col("batch_no").cast("long"))
