"""Identifier helpers: quoting, child-table naming, snake case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(name: str) -> str:
    """Back-tick quote an identifier so names like ``a-b`` or ``x.y`` are safe."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column by its literal name (dots are not paths)."""
    return F.col(quote(name))


def split_name(name: str) -> list[str]:
    """Parts of a table name: dots divide, except inside back-ticks."""
    return [p.strip("`").replace("``", "`") for p in re.findall(r"(?:`(?:[^`]|``)*`|[^`.])+", name)]


def quote_name(name: str) -> str:
    """A table name for SQL with every part quoted."""
    return ".".join(quote(p) for p in split_name(name))


def child_name(parent: str, field: str) -> str:
    """Child table name: ``<parent>_<lower(field)>``."""
    return f"{parent}_{field.lower()}"


def snake_case_str(s: str | None) -> str:
    """Python form of :func:`snake_case` for table names on the driver."""
    if not s:
        return ""
    dot = s.rfind(".")
    if dot > 0:
        s = s[:dot]
    s = re.sub(r"-+", "_", s)
    s = re.sub(r"([A-Z]+)", r"_\1", s).lower()
    return s[1:] if s.startswith("_") else s


def snake_case(c: Column) -> Column:
    """Snake-case a string column.

    Drops the suffix from the last dot (when the dot is not the first char),
    turns runs of ``-`` into ``_``, puts ``_`` before each run of capitals,
    lower-cases, and strips one leading ``_``. Null gives the empty string.
    """
    base = F.regexp_replace(c, r"(?s)^(.+)\.[^.]*$", "$1")
    s = F.regexp_replace(base, "-+", "_")
    s = F.lower(F.regexp_replace(s, "([A-Z]+)", "_$1"))
    s = F.regexp_replace(s, "^_", "")
    return F.coalesce(s, F.lit(""))
