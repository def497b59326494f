"""Sources and sinks that need a Spark module of their own; without it Spark says which one is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_stream(spark: SparkSession, servers: str, topics: str, starting: str = "earliest", most_per_trigger: int | None = None) -> DataFrame:
    """key, value (as text), topic, partition, offset and timestamp of the records of topics, as a stream. Needs spark-sql-kafka."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": starting}
    if most_per_trigger:
        options["maxOffsetsPerTrigger"] = str(most_per_trigger)
    records = spark.readStream.format("kafka").options(**options).load()
    return records.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp")


def to_kafka(df: DataFrame, servers: str, topic: str, key: Column, value: Column) -> None:
    """Write each row as a record. Needs spark-sql-kafka."""
    records = df.select(key.cast("string").alias("key"), value.cast("string").alias("value"))
    records.write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """Avro files. Needs spark-avro."""
    return spark.read.format("avro").load(path)


def write_avro(df: DataFrame, path: str) -> None:
    """Needs spark-avro."""
    df.write.format("avro").save(path)
