import pytest
from pyspark.sql import functions as F

from loamwork.sources import FORMATS, kafka_stream, read_avro, read_binary, read_files, read_lines, read_table, write_avro, write_files, write_lines


@pytest.mark.parametrize("kind", sorted(FORMATS))
def test_formats_give_the_rows_back(spark, sf_dir, tmp_path, kind):
    table = read_table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")))
    write_files(table, str(tmp_path / kind), kind)
    back = read_files(spark, str(tmp_path / kind), table.schema, kind)
    assert back.schema == table.schema and back.exceptAll(table).count() == table.exceptAll(back).count() == 0


def test_folders_of_other_values_are_skipped(spark, sf_dir, tmp_path):
    table = read_table(spark, sf_dir, "customer")
    write_files(table, str(tmp_path / "t"), partition_by=("c_mktsegment",))
    one = spark.read.parquet(str(tmp_path / "t")).where("c_mktsegment = 'BUILDING'")
    assert one.count() == table.where("c_mktsegment = 'BUILDING'").count()
    assert len(one.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(c_mktsegment" in one._jdf.queryExecution().toString()


def test_lines_and_bytes(spark, tmp_path):
    rows = spark.createDataFrame([("b é",), ("a",), ("",)], "t string").coalesce(1)
    write_lines(rows, str(tmp_path / "lines"), "t")
    back = read_lines(spark, str(tmp_path / "lines"))
    assert sorted(r["value"] for r in back.collect()) == ["", "a", "b é"]
    assert [r["value"] for r in read_lines(spark, str(tmp_path / "lines"), whole=True).collect()] == ["b é\na\n\n"]
    found = read_binary(spark, str(tmp_path / "lines"), "*.txt").collect()
    assert [bytes(r["content"]) for r in found] == ["b é\na\n\n".encode()] and found[0]["length"] == 8


def test_missing_connectors_are_named(spark, tmp_path):
    from pyspark.errors import AnalysisException

    for attempt in (lambda: kafka_stream(spark, "none:9092", "t"), lambda: read_avro(spark, str(tmp_path)), lambda: write_avro(spark.range(1), str(tmp_path / "a"))):
        with pytest.raises(AnalysisException, match="kafka|avro|Kafka|Avro"):
            attempt()
