"""Relations written to the cluster's shared folder: lineage ends there, and a lost executor loses none of them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
            found = own.get() if own.isDefined() else None
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: executors need a shared folder")
            found = "file://" + tempfile.mkdtemp(prefix="termlog-")
            spark.sparkContext.setCheckpointDir(found)
        self.base = f"{found.rstrip('/')}/termlog-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def write(self, df: DataFrame) -> str:
        path = f"{self.base}/{len(self.paths)}"
        self.paths.append(path)
        df.write.parquet(path)
        return path

    def read(self, schema, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def save(self, df: DataFrame) -> DataFrame:
        return self.read(df.schema, self.write(df))

    def clear(self) -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(self.base)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.paths = []
