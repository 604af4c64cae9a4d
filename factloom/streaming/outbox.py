"""Streams: a polled folder of fixed-width records, and obligations that wait for receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.records import RECORD_LENGTH, parse_records


def outbox_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Every record of the ``.dat`` files that appear in a folder; the checkpoint remembers which were processed.

    A wrong checksum is flagged (``checksum_ok``) and repeated correlation ids stay. Lines of a wrong length are no
    records; ``outbox_rejects`` has them.
    """
    return parse_records(_lines(spark, path, per_trigger)).where("length_ok")


def outbox_rejects(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The lines that ``outbox_stream`` can't parse, as they are, with their file."""
    return _lines(spark, path, per_trigger).where(F.length("value") != RECORD_LENGTH).select("value", F.col("_metadata.file_path").alias("path"))


def _lines(spark: SparkSession, path: str, per_trigger: int) -> DataFrame:
    return spark.readStream.option("pathGlobFilter", "*.dat").option("maxFilesPerTrigger", per_trigger).text(path)


def resumed(receipts: DataFrame, waiting: DataFrame) -> DataFrame:
    """Steps whose obligation a newly arrived receipt meets (stream joined with a static table)."""
    return receipts.join(waiting, "request_hash").select("step", "request_hash", F.lit("continue").alias("control"))
