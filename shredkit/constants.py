"""Reserved column names and fixed values.

Fixed values: these names and constants must equal the reference's so that
tables written by either side line up column for column.
"""

# --- fixed values (must match the reference) ---------------------------------
CONTENT_HASH = "content_hash_id"
PARENT_ID = "parent_id"
PARENT_ID_HASH = "parent_id_hash_col"
ID_HASH = "id_hash_col"
FILE_KEY = "filekey"
VALUE = "value"
ROW_IDX = "_row_idx"
DEFAULT_FILE_PATH = "default_file_path"
HASH_SEPARATOR = "||"
DEFAULT_BUCKETS = 16
DATE_FORMAT = "yyyyMMdd'T'HHmmss.SSS 'GMT'"
TABLE_PROPERTIES = {
    "write.metadata.delete-enabled": "true",
    "write.delete.mode": "merge-on-read",
    "write.merge.mode": "copy-on-write",
}
# -----------------------------------------------------------------------------

# Our own additions.
ORDINAL = "_ordinal"          # element position, only with keep_ordinal=True
INNER_PARENT_ID = "_parent_id"  # a nested field called parent_id is renamed to this
MANAGED = (PARENT_ID, CONTENT_HASH)
# Columns that child tables get: inner fields of these names are kept with a ``_`` before them.
INNER_MANAGED = (PARENT_ID, CONTENT_HASH, PARENT_ID_HASH, FILE_KEY, ORDINAL)

# Distinct keys of an object path beyond which it is a map in inferred JSON types.
MAP_KEYS = 1000
