"""Files in the formats Spark brings along, written and read with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Formats that keep a table's columns, with the options each needs to give the same rows back (fixed values).
FORMATS: dict[str, dict[str, str]] = {
    "parquet": {},
    "orc": {},
    "json": {"ignoreNullFields": "false"},
    "csv": {"header": "true", "nullValue": "\\N", "emptyValue": "", "escape": '"', "multiLine": "true"},
    "xml": {"rowTag": "row", "nullValue": "\\N"},
}


def write_files(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write ``df``; with ``partition_by`` one folder for each value, which later filters skip."""
    writer = df.write.format(kind).options(**FORMATS[kind])
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Text files: value, one row a line, and with ``whole`` one row a file; and the file's path."""
    return spark.read.text(path, wholetext=whole).select("value", "_metadata.file_path")


def write_lines(df: DataFrame, path: str, column: str) -> None:
    """One text column, a line for each row. A text with line breaks comes back as several."""
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as bytes: path, modificationTime, length and content. A file is one row, so it has to fit in a task."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet") -> DataFrame:
    """Read with the schema given; nothing is inferred, so no extra pass is made."""
    return spark.read.format(kind).options(**FORMATS[kind]).schema(schema).load(path)
