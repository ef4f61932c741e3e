"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stormlift.functions.scalars import utc_time
from stormlift.sources.schema import PREDICTIONS, STRIKES, check_contract, normalize, text_schema

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"  # the default text format drops microseconds


def read_strikes(spark: SparkSession, path: str, fmt: str = "csv", rows: int | None = None) -> DataFrame:
    """Strike table from CSV (header, text patched by ``normalize``), JSON, ORC or parquet.

    ``rows`` takes a sample of that many rows; by default the whole input is read.
    """
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        raw = spark.read.schema(text_schema(header)).option("header", True).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    check_contract(raw.columns)
    strikes = normalize(raw)
    return strikes if rows is None else strikes.limit(rows)


CORRUPT = "_corrupt_record"


def read_csv_checked(spark: SparkSession, path: str) -> DataFrame:
    """CSV under the full declared schema; lines that do not fit land whole in ``_corrupt_record``."""
    schema = StructType([*STRIKES.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_strikes_checked(spark: SparkSession, path: str, columns: list[str] | None = None, counts: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """A CSV upload as strikes, and the rows that are none with their ``reason``; no row is lost.

    ``columns`` names the fields of files without a header. A line with too few or too many fields is
    ``malformed``, one without a readable time ``date``, one without an airport ``airport``; rejected rows
    keep their fields as text and, if malformed, the line. ``counts`` observes n and rejected when the
    strikes are first read through.
    """
    header = columns or spark.read.option("header", True).csv(path).columns
    check_contract(header)
    schema = StructType([*text_schema(header).fields, StructField(CORRUPT, StringType())])
    raw = spark.read.schema(schema).option("header", columns is None).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)  # else the fields a query reads decide what is malformed
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "malformed")
        .when(utc_time(F.col("date"), "string").isNull(), "date")
        .when(F.col("airport").isNull(), "airport")
    )
    tagged = raw.withColumn("reason", reason)
    seen = tagged if counts is None else tagged.observe(counts, F.count(F.lit(1)).alias("n"), F.count("reason").alias("rejected"))
    return normalize(seen.filter(F.col("reason").isNull()).select(*header)), tagged.filter(F.col("reason").isNotNull())


def stream_strikes(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """The same table as a file stream."""
    reader = spark.readStream.schema(STRIKES).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_predictions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(PREDICTIONS).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    writer = df.write.format(fmt)
    if fmt in ("csv", "json"):
        writer = writer.option("timestampFormat", MICROS)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)
