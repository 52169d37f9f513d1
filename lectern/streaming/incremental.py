"""A file stream into an idempotent table: natural keys are written once, late rows by choice.

Each micro-batch drops its own repeats and, by an anti-join, what the sink already
holds; it is written to a folder named by its batch id, so a batch that is repeated
after a failure replaces itself instead of doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lectern.operators.ingest import since_watermark


def _written(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame:
    """What earlier batches wrote; this batch's own folder, if it is a repeat, does not count."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], schema)
    if not any(s.isDirectory() and s.getPath().getName().startswith("batch=") for s in fs.listStatus(hadoop)):
        return spark.createDataFrame([], schema)
    done = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    return done.where(F.col("batch") < batch_id).drop("batch")


def ingest_stream(source: DataFrame, sink: str, checkpoint: str, keys: list[str], date_col: str | None = None, allow_late: bool = True, interval: str | None = None) -> StreamingQuery:
    """Start the query; without ``interval`` it takes what is there and ends."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = _written(spark, sink, batch.schema, batch_id)
        rows = batch.dropDuplicates(keys)
        if date_col and not allow_late:
            mark = old.agg(F.max(F.col(date_col).cast("string")).alias("m")).first()["m"]
            rows = since_watermark(rows.withColumn("_d", F.col(date_col).cast("string")), mark, "_d").drop("_d")
        rows.join(old.select(*keys).distinct(), keys, "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts per window and key; rows later than the delay are not waited for. Works on streams and tables."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
