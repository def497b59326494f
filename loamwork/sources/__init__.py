"""Where tables come from and go to."""

from .connectors import kafka_stream, read_avro, to_kafka, write_avro
from .files import FORMATS, read_binary, read_files, read_lines, write_files, write_lines
from .tables import TABLES, read_table, register_views

__all__ = [
    "FORMATS", "TABLES", "kafka_stream", "read_avro", "read_binary", "read_files", "read_lines", "read_table",
    "register_views", "to_kafka", "write_avro", "write_files", "write_lines",
]
