"""Sinks: atomic tables, version-gated builds, merges by key, manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and put it in place by one renaming, which replaces what is
    there: readers find the old text or the new one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    target, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(part, target, options)


def _current(spark: SparkSession, path: str) -> str | None:
    return f"{path}/{_read_text(spark, f'{path}/_CURRENT')}" if exists(spark, f"{path}/_CURRENT") else None


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of a table, or None if none was ever finished."""
    held = _current(spark, path)
    return spark.read.parquet(held) if held else None


def write_atomic(df: DataFrame, path: str) -> None:
    """Write a new version beside the others and switch to it by one renaming: readers
    and crashes at any time find the old version or the new one. The version before the
    last stays for readers that have begun; older ones go."""
    spark = df.sparkSession
    before = _current(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    _write_text(spark, f"{path}/_CURRENT", name)
    folder, fs = _fs(spark, path)
    keep = {name, before.rsplit("/", 1)[1] if before else name}
    for status in fs.listStatus(folder):
        if status.getPath().getName().startswith("v-") and status.getPath().getName() not in keep:
            fs.delete(status.getPath(), True)


def build_once(spark: SparkSession, path: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was built for ``version``, else build and write it."""
    mark = f"{path}/_VERSION"
    if exists(spark, mark) and _read_text(spark, mark) == version and (held := read_or_none(spark, path)) is not None:
        return held
    write_atomic(build(), path)
    _write_text(spark, mark, version)
    return read_or_none(spark, path)


def merge_by_key(old: DataFrame | None, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Old and new rows, the last by ``order`` for each key; new rows win ties."""
    both = new.withColumn("__new", F.lit(1))
    if old is not None:
        both = both.unionByName(old.withColumn("__new", F.lit(0)))
    rest = [c for c in new.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(order, "__new"))
    return both.groupBy(*key).agg(best.alias("__x")).select(*key, "__x.*").select(*new.columns)


def first_by_priority(sources: list[DataFrame], key: str, allowed: Column | None = None) -> DataFrame:
    """Union of lists in order of priority: the first list that has a key gives its row."""
    out = None
    for n, df in enumerate(sources):
        part = df.withColumn("__source", F.lit(n))
        out = part if out is None else out.unionByName(part)
    out = out.where(allowed) if allowed is not None else out
    rest = [c for c in sources[0].columns if c != key]
    return out.groupBy(key).agg(F.min(F.struct("__source", *rest)).alias("__x")).select(key, *[F.col(f"__x.{c}").alias(c) for c in rest])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, run: dict) -> None:
    """A run's parameters and counts as JSON, keys sorted, wherever tables may live."""
    _write_text(spark, path, json.dumps(run, ensure_ascii=False, sort_keys=True, indent=2, default=str))
