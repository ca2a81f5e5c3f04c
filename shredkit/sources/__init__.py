"""Sources: JSON files, giant JSON arrays and text columns, JDBC queries, hex payloads."""

from shredkit.sources.arrays import read_array_records, read_json_arrays
from shredkit.sources.hex import decode_hex_column, read_hex_files
from shredkit.sources.jdbc import read_jdbc_query
from shredkit.sources.json import parse_json_column, read_json_files

__all__ = [
    "decode_hex_column",
    "parse_json_column",
    "read_array_records",
    "read_hex_files",
    "read_jdbc_query",
    "read_json_arrays",
    "read_json_files",
]
