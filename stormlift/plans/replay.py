"""A strike table replayed as a stream, for the streaming queries and tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlift.functions.scalars import HOUR, micros
from stormlift.workspace import materialise, new_path

FILE_ROWS = 100_000


def feed(strikes: DataFrame, slices: int = 3, copies: int = 1) -> tuple[str, int]:
    """Write a strike table as a stream source: slices of equal time in order, then one far-off strike.

    Every slice has the same number of files of bounded size, so that this many files a batch bring one
    slice; both are returned. The far-off strike moves the watermark past everything before it, so a
    replay ends with all windows and states closed. ``copies`` delivers every slice that often.
    """
    spark = strikes.sparkSession
    us = micros("date")
    strikes = materialise(strikes, "replayed")
    lo, hi = strikes.agg(F.min(us), F.max(us)).first()
    if lo is None:
        raise ValueError("nothing to replay")
    path, span = new_path(spark, "feed"), (hi - lo) // slices + 1
    slice_no = F.floor((us - lo) / span)
    sizes = {r["no"]: r["n"] for r in strikes.groupBy(slice_no.alias("no")).agg(F.count("*").alias("n")).collect()}  # a row a slice
    files = max(1, min(min(sizes.get(i, 0) for i in range(slices)), -(-max(sizes.values()) // FILE_ROWS)))
    for i in range(slices):
        for _ in range(copies):
            strikes.filter(slice_no == i).repartition(files).write.mode("append").parquet(path)
    far = {"lightning_id": F.lit(-1), "date": F.timestamp_micros(F.lit(hi + 48 * HOUR)), "airport": F.lit(""),
           "icloud": F.lit(True), "user_id": F.lit(-1), "airport_alert_id": F.lit(-1)}
    closing = spark.range(1).select(*[far.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in strikes.schema.fields])
    closing.write.mode("append").parquet(path)
    return path, files


def source(path: str, strikes: DataFrame, files: int = 1) -> DataFrame:
    """The fed folder as a stream of ``files`` files a batch."""
    return strikes.sparkSession.readStream.schema(strikes.schema).option("maxFilesPerTrigger", files).parquet(path)


def play(path: str, strikes: DataFrame, flow: Callable[[DataFrame], DataFrame], files: int = 1) -> DataFrame:
    """Run ``flow`` over a fed folder to the end of its data, into a table, and return the table."""
    spark = strikes.sparkSession
    out = flow(source(path, strikes, files))
    sink = new_path(spark, "sink")
    run = (
        out.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", new_path(spark, "progress"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def replay(strikes: DataFrame, flow: Callable[[DataFrame], DataFrame], **kw) -> DataFrame:
    path, files = feed(strikes, **kw)
    return play(path, strikes, flow, files)
