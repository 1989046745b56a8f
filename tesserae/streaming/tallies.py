"""Events as a stream: counts and sums of windows of event time, with a watermark after which late rows are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_dir


def windowed(events: DataFrame, length: str = "6 hours", lateness: str = "1 day", time_col: str = "ts", kind_col: str = "event_type", value_col: str = "value") -> DataFrame:
    """(start, kind, n, total, largest) of each window of `length` and kind. events is a stream or a table; in a stream a window is
    done, and given out, once the watermark (the latest time less `lateness`) has passed its end, and rows older than that are
    left out. Rows without a time are in no window. Its state is a row for each open window and kind."""
    at = F.window(time_col, length)
    rows = events.where(F.col(time_col).isNotNull()).withWatermark(time_col, lateness)
    out = rows.groupBy(at.alias("w"), F.col(kind_col).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.round(value_col, 2)).alias("total"), F.max(value_col).alias("largest"))
    return out.select(F.col("w.start").alias("start"), "kind", "n", "total", "largest")


def tally(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """All windows of the files at `path`, read as a stream to its end; state and offsets stand in the shared folder."""
    base = shared_dir(spark)
    stream = spark.readStream.schema(schema).parquet(path)
    for f in schema.fields:  # watermarks are of instants; times without a zone are taken for UTC
        if isinstance(f.dataType, T.TimestampNTZType):
            stream = stream.withColumn(f.name, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{f.name}`))"))
    # the table is complete after each batch, so the last batch's is the result
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")
    done = windowed(stream, **options).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{base}/out")
