"""Shared plumbing: scratch tables in the cluster's shared folder, grouped streaming over Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is set only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="termlog-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT.pop(path, None)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_LEFT.items()):
        with contextlib.suppress(Exception):
            drop_path(spark, path)


class Scratch:
    """Tables written as Parquet to the shared folder: they cut lineage and outlive a lost executor.

    A table that a returned DataFrame still reads stays until the application ends; others go with drop().
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/termlog-{tag}-{uuid.uuid4().hex}", {}

    def save(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = self.paths[name] = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        _LEFT[path] = self.spark
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, self.paths.pop(name))


_KEPT: dict = {}


def keep(owner, make: Callable):
    """What a Python worker keeps from one task to the next; one thing at a time, as all operators share its memory."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = make()
    return _KEPT[owner]


def release() -> None:
    """Frees what an earlier operator's tasks left in this worker."""
    _KEPT.clear()


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones in the caller's table can't clash with an operator's own."""
    return docs.select(*(F.col(c) for c in columns))


def quoted(column: str) -> str:
    """A column's name as it stands in an expression, dots and all."""
    return f"`{column.replace('`', '``')}`"


def keep_rows(docs: DataFrame, key: Column, gone: DataFrame, column: str) -> DataFrame:
    """The rows of a table whose key is not in gone(column). They travel in a struct, so no name of theirs can clash."""
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), key.alias("key"))
    kept = rows.join(gone.select(F.col(column).alias("gone")), F.col("key") == F.col("gone"), "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `key`; each holds one or more complete groups."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if held and keys[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)

