"""Tables written between two steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session that names none (a test) gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='loamwork-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/loamwork/{tag}-{uuid.uuid4().hex}"


class Stage:
    """A table in the shared folder: ``df`` reads it, ``drop`` deletes it."""

    def __init__(self, df: DataFrame, tag: str) -> None:
        self.spark, self.path = df.sparkSession, new_folder(df.sparkSession, tag)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, tag: str) -> Stage:
    """Write ``df`` and go on from the file: the lineage ends there, and what was computed is not computed again."""
    return Stage(df, tag)
