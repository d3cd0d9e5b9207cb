"""A durable ledger of item states: incremental, idempotent, last update wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, state string, verdict string, updated_at long"


def latest(entries: DataFrame) -> DataFrame:
    """The last entry of each key; a partially aggregated maximum, so a key with many attempts is no skew."""
    m = F.max(F.struct("updated_at", "state", "verdict"))
    return entries.groupBy("key").agg(m.alias("m")).select("key", "m.state", "m.verdict", "m.updated_at")


def pending(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Items that have no ready, applied or kept entry; failures are retried."""
    done = latest(entries).where(F.col("state").isin("ready", "applied", "kept")).select("key")
    return items.join(done, "key", "left_anti")


def resolved_files(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Paths all of whose ``items(path, key)`` are resolved: a file with any unresolved item isn't changed."""
    state = items.join(latest(entries).select("key", "state"), "key", "left")
    ok = F.coalesce(F.col("state").isin("ready", "applied", "kept"), F.lit(False))
    return state.groupBy("path").agg(F.bool_and(ok).alias("ok")).where("ok").select("path")


def append_stream(spark: SparkSession, source: DataFrame, folder: str, checkpoint: str):
    """Stream entries into the ledger; a batch that runs again replaces its own folder and nothing else."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("key", "state", "verdict", "updated_at").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", batch long").parquet(folder)
