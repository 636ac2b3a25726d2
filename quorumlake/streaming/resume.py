"""Ingestion that can stop and go on: only files that are not taken yet are read, each
batch is written when it is complete, and late rows are merged by key on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.sources.sinks import exists, merge_by_key, write_atomic


def read_ingested(spark: SparkSession, target: str, key: list[str], order: str) -> DataFrame | None:
    """The rows taken so far, the last by ``order`` for each key, later batches before
    earlier ones on ties; None if there are none."""
    if not exists(spark, target):
        return None
    rows = spark.read.option("recursiveFileLookup", False).parquet(target)
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    best = F.max_by(F.struct(*rest), F.struct(order, "batch"))
    return rows.groupBy(*key).agg(best.alias("__x")).select(*key, "__x.*").select(*[c for c in rows.columns if c != "batch"])


def compact(spark: SparkSession, target: str, table: str, key: list[str], order: str) -> None:
    """The merged rows as a table of their own, switched to at once."""
    write_atomic(read_ingested(spark, target, key, order), table)


def ingest_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str], order: str, files_per_batch: int = 8) -> DataFrame | None:
    """Take what is new under ``source`` into ``target``, then stop.

    Each batch is merged within itself and written once, into a folder of its own number,
    so the work follows what is new. The checkpoint remembers the files taken; a batch
    that is repeated after a failure replaces its folder and changes nothing. Nothing new
    leaves the table as it is.
    """

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            merge_by_key(None, batch, key, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_ingested(spark, target, key, order)
