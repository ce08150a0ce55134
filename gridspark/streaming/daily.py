"""Arriving files as a stream: idempotent growth of a cube, and windowed totals that wait for late rows.

These go beyond the batch pipeline: its incremental append by time becomes a Structured Streaming query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridspark.sources.cube import append_cube


def read_arrivals(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def grow_cube(arrivals: DataFrame, cube: str, checkpoint: str) -> StreamingQuery:
    """Append every arriving cell (time, iy, ix) once, also where a time step is split over batches or completed late; a
    batch that is run again, or a cell that comes again, changes nothing."""
    def take(batch: DataFrame, _: int) -> None:
        append_cube(batch.dropDuplicates(["time", "iy", "ix"]), cube, by_cell=True)

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(arrivals: DataFrame, time: str, keys: list[str], value: str, window: str = "1 day", late: str = "3 days") -> DataFrame:
    """Totals and means per key and window; rows later than ``late`` behind the newest one are no longer counted.

    Works alike on a stream and on a table.
    """
    d = arrivals.withWatermark(time, late) if arrivals.isStreaming else arrivals
    g = d.groupBy(F.window(F.col(time), window).alias("w"), *keys).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "total", "mean", "n")
