"""Column-level helpers: all return ``pyspark.sql.Column`` expressions (JVM-side)."""

from shredkit.functions.hashing import content_hash, key_hash, text_of
from shredkit.functions.names import child_name, quote, snake_case, snake_case_str
from shredkit.functions.text import decode_hex, is_json_candidate, parse_date

__all__ = [
    "child_name",
    "content_hash",
    "decode_hex",
    "is_json_candidate",
    "key_hash",
    "parse_date",
    "quote",
    "snake_case",
    "snake_case_str",
    "text_of",
]
