"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, in local mode only, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="passagework-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Parquet tables under one fresh folder. ``save`` writes and rereads, ``drop`` deletes what is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/passagework-{uuid.uuid4().hex}"
        # results are read from these tables after the caller has them, so what is left goes when the driver ends
        fs, path = self._place("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str, compression: str = "zstd", small: bool = False) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=compression)
        # shuffle files of finished plans stay on disk until the driver has collected the plans
        if not small:
            gc.collect()
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._place(name)
            fs.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
