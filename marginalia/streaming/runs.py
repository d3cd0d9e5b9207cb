"""Incremental runs: items keyed by what they depend on, a bucketed ledger of their results, and write checkpoints.

A key covers an item, its source and just those settings that its kind is judged by, so a changed setting gives new
keys, and work, to the items it concerns and to no others. Results are appended in batches, dealt out to buckets of
keys; a run reads only the buckets its keys fall in. ``compact`` rewrites what is there to one row a key; readers take
the newest complete rewrite and the batches behind it, so it may be stopped at any point.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from .ledger import SCHEMA, latest

BUCKETS = 64
READY = ("ready", "applied", "kept")


def settings_fingerprint(settings: dict[str, object], names: list[str]) -> str:
    """SHA-256 over the names and values, each with its length in front; a setting that isn't there differs from an empty one."""
    framed = b""
    for name in sorted(names):
        for part in (name, "" if name not in settings else f"={settings[name]!r}"):
            data = part.encode()
            framed += len(data).to_bytes(8, "little") + data
    return hashlib.sha256(framed).hexdigest()


def keyed(items: DataFrame, settings: dict[str, object], concerns: dict[str, list[str]], parts: list[str], kind: str = "kind") -> DataFrame:
    """``items`` with ``key``: a fingerprint of ``parts`` and of the settings that concern the item's kind.

    ``concerns`` maps a kind to names of settings; those under ``*`` concern every kind, and unknown kinds depend on
    them alone. Null parts count as empty.
    """
    everyone = concerns.get("*", [])
    of = F.lit(settings_fingerprint(settings, everyone))
    for k, names in concerns.items():
        if k != "*":
            of = F.when(F.col(kind) == k, F.lit(settings_fingerprint(settings, [*everyone, *names]))).otherwise(of)
    return items.withColumn("key", fingerprint(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts], of))


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def append(entries: DataFrame, folder: str, batch: int) -> None:
    """Write one batch of ``entries`` (SCHEMA); a batch that runs again replaces its own folder and nothing else."""
    rows = entries.select("key", "state", "verdict", "updated_at").withColumn("bucket", bucket(F.col("key")))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={batch}")


def append_stream(spark: SparkSession, source: DataFrame, folder: str, checkpoint: str):
    """Stream entries into the ledger, exactly once: a restart runs an unfinished batch under its old number."""
    write = lambda rows, batch: append(rows, folder, batch)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the folder's complete sub-folders ``prefix=n``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(prefix + "=")]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def read(spark: SparkSession, folder: str, buckets: list[int] | None = None) -> DataFrame:
    """All entries that count: the newest rewrite and the batches behind it; of ``buckets`` alone if they are given."""
    upto = max(_numbers(spark, folder, "upto"), default=-1)
    paths = [f"{folder}/upto={upto}"] if upto >= 0 else []
    paths += [f"{folder}/batch={b}" for b in _numbers(spark, folder, "batch") if b > upto]
    out = spark.createDataFrame([], SCHEMA)
    for path in paths:
        rows = spark.read.schema(SCHEMA + ", bucket int").parquet(path)
        rows = rows.where(F.col("bucket").isin(buckets)) if buckets is not None else rows
        out = out.unionByName(rows.drop("bucket"))
    return out


def pending(items: DataFrame, folder: str) -> DataFrame:
    """``items(key, ...)`` without a ready, applied or kept entry; only the buckets of their keys are read."""
    spark = items.sparkSession
    needed = [r[0] for r in items.select(bucket(F.col("key"))).distinct().collect()]  # at most BUCKETS
    done = latest(read(spark, folder, needed)).where(F.col("state").isin(*READY)).select("key")
    return items.join(done, "key", "left_anti")


def compact(spark: SparkSession, folder: str) -> int:
    """Rewrite all batches so far to one row a key, then drop what the rewrite covers; the number of the last batch."""
    batches, rewrites = _numbers(spark, folder, "batch"), _numbers(spark, folder, "upto")
    last = max(batches, default=-1)
    if last > max(rewrites, default=-1):
        rows = latest(read(spark, folder)).withColumn("bucket", bucket(F.col("key")))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/upto={last}")
    newest = max(_numbers(spark, folder, "upto"), default=-1)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for old in [f"{folder}/upto={n}" for n in rewrites if n < newest] + [f"{folder}/batch={n}" for n in batches if n <= newest]:
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(conf).delete(path, True)
    return last


def resumed(files: DataFrame, writes: DataFrame, settings: str) -> DataFrame:
    """``files(path, source)`` with ``action`` by the write checkpoints of one settings key.

    ``writes(path, settings, state, before_hash, after_hash, after_source, updated_at)``, states prepared and applied;
    the newest row of a path counts. skip: the text is what was written (``complete`` tells that the checkpoint was
    still prepared and is to be closed). write: a prepared text, in ``text``, goes over an unchanged source. corrupt:
    the prepared text isn't what its hash says. redo: no checkpoint, or the source has changed since.
    """
    newest = Window.partitionBy("path").orderBy(F.col("updated_at").desc())
    rows = writes.where(F.col("settings") == settings).withColumn("__n", F.row_number().over(newest)).where("__n = 1")
    rows = rows.select("path", "state", "before_hash", "after_hash", "after_source")
    now = fingerprint(F.coalesce("source", F.lit("")))
    met = files.join(rows, "path", "left").withColumn("__now", now)
    prepared = F.col("state") == "prepared"
    untouched = prepared & (F.col("__now") == F.col("before_hash"))
    sound = F.coalesce(fingerprint(F.coalesce("after_source", F.lit(""))) == F.col("after_hash"), F.lit(False)) & F.col("after_source").isNotNull()
    action = F.when(F.col("__now") == F.col("after_hash"), "skip").when(untouched & sound, "write").when(untouched, "corrupt").otherwise("redo")
    out = met.withColumn("action", action)
    return out.select(
        *files.columns, "action", F.coalesce((F.col("action") == "skip") & prepared, F.lit(False)).alias("complete"), F.when(F.col("action") == "write", F.col("after_source")).alias("text")
    )
