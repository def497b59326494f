"""A stream run to its end over parts of a table that arrive one after the other, and what it has written.

Each part becomes files in the source's folder, and the stream is started again for
it with the same checkpoint: it takes the new files as one batch, goes on from its
state and watermark, and stops when nothing is left. So a replay also goes through
a restart for each part. It runs in a session of its own: no setting of the caller's
session changes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import new_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append", **settings: str) -> DataFrame:
    """All rows that ``build`` of the stream of ``parts`` puts out, with __batch, the batch that did so.

    ``parts`` have one schema. A batch writes a folder of its own, over what an attempt
    that was lost has left, so each row is there once. ``settings`` are those of the
    stream's session, with _ for the dots of their names.
    """
    first = parts[0]
    spark: SparkSession = first.sparkSession
    folder = new_folder(spark, "stream")
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name, value in settings.items():
        own.conf.set(name.replace("_", "."), value)
    stream = None

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/part-{batch:06d}")

    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/part-{i:06d}")
        if stream is None:
            stream = build(own.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in"))
        running = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    found = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return found.withColumn("__batch", F.regexp_extract(F.input_file_name(), r"/part-(\d{6})/", 1).cast("int"))


def arriving(df: DataFrame, batch: Column, parts: int) -> list[DataFrame]:
    """``df`` cut into the parts that ``batch`` names, 0 to ``parts`` - 1."""
    return [df.where(batch == i) for i in range(parts)]


def last_of_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of what an update stream has put out, each key's last row."""
    rest = [c for c in rows.columns if c not in (*keys, "__batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r"))
    return newest.select(*keys, "r.*")
