"""Ledgers that grow: each trigger's events are chained behind what the ledgers hold, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import identity as I
from factloom.operators import relational as R


def ledger_sink(path: str, ledger: str, order: list[str], event: str) -> Callable:
    """A function for ``foreachBatch`` that appends a trigger's events to the ledgers under ``path``.

    Every trigger writes a folder of its own, named by its number, over the heads of the earlier ones: a trigger that is
    run again writes the same entries again and none twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        heads = None
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            before = spark.read.parquet(path).where(F.col("trigger") < number)
            heads = R.chain_head(before, ledger, "sequence", "event_hash")
        entries = I.build_ledger(batch, ledger, order, event, heads)
        entries.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    return write


def replayed(entries: DataFrame, ledger: str, order: list[str], event: str) -> DataFrame:
    """Whether a ledger built anew from its events has the same hashes, for each ledger."""
    names = [ledger, *order, event]
    again = I.build_ledger(entries.select(*names), ledger, order, event).select(ledger, "sequence", F.col("event_hash").alias("again"))
    both = entries.join(again, [ledger, "sequence"], "full")
    return both.groupBy(ledger).agg(F.bool_and(F.coalesce(F.col("event_hash") == F.col("again"), F.lit(False))).alias("same"), F.count("*").alias("entries"))


def kafka_rows(df: DataFrame, key: str, topic: str) -> DataFrame:
    """Records as the key, value and topic that a Kafka sink takes; the value is canonical JSON of the other columns."""
    rest = {c: F.col(c) for c in df.columns}
    return df.select(F.col(key).cast("string").alias("key"), I.json_object(**rest).alias("value"), F.lit(topic).alias("topic"))


def publish(df: DataFrame, key: str, topic: str, servers: str, checkpoint: str):
    """Starts a stream of records to Kafka (needs Spark's Kafka package)."""
    return kafka_rows(df, key, topic).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()
