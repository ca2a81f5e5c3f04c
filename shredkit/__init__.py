"""shredkit: flatten nested JSON documents into relational tables on Spark.

Everything is expressed as DataFrame plans: the recursive walk happens over
the *schema* on the driver (no data), and each output table is a lazy
DataFrame that Catalyst optimises and the cluster executes.
"""

from shredkit.config import FlattenOptions, IngestConfig
from shredkit.constants import (
    CONTENT_HASH,
    FILE_KEY,
    ID_HASH,
    PARENT_ID,
    PARENT_ID_HASH,
    ROW_IDX,
    VALUE,
)
from shredkit.plans.flatten import flatten

__all__ = [
    "CONTENT_HASH",
    "FILE_KEY",
    "FlattenOptions",
    "ID_HASH",
    "IngestConfig",
    "PARENT_ID",
    "PARENT_ID_HASH",
    "ROW_IDX",
    "VALUE",
    "flatten",
]
