"""Plan builders: schema walks that return lazy DataFrames (no data on the driver)."""

from shredkit.plans.flatten import (
    dedup_children,
    expand_struct,
    explode_struct_child,
    explode_value_child,
    flatten,
    main_table,
    select_scalars,
    struct_child,
    unwrap_root_array,
)
from shredkit.plans.jsoncols import infer_json_schemas, promote_json_columns
from shredkit.plans.schema import align_schema, missing_fields, project_mapping

__all__ = [
    "align_schema",
    "dedup_children",
    "expand_struct",
    "explode_struct_child",
    "explode_value_child",
    "struct_child",
    "unwrap_root_array",
    "flatten",
    "infer_json_schemas",
    "main_table",
    "missing_fields",
    "project_mapping",
    "promote_json_columns",
    "select_scalars",
]
