"""Text predicates and parsers kept as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Leading characters a JSON candidate may start with after trimming: anything
# up to and including the space character, as a string trim does.
_LEAD = r"^[\x00-\x20]*"


def is_json_candidate(c: Column) -> Column:
    """Trimmed text starts with ``{`` or ``[`` and contains ``:``.

    Anchored regexes look only at the start of the text, so a long document
    is not copied the way ``trim`` would copy it.
    """
    return c.rlike(_LEAD + r"[\{\[]") & c.contains(":")


def is_json_object(c: Column) -> Column:
    return c.rlike(_LEAD + r"\{") & c.contains(":")


def is_json_array(c: Column) -> Column:
    return c.rlike(_LEAD + r"\[") & c.contains(":")


def parse_date(c: Column, fmt: str) -> Column:
    """Parse text to a timestamp with a Spark datetime pattern; bad text gives null."""
    return F.try_to_timestamp(c, F.lit(fmt))


def decode_hex(c: Column, prefix_len: int = 0, strict: bool = True) -> Column:
    """Hex text to bytes.

    Lines are trimmed and joined (the payload may be wrapped), an optional
    prefix of ``prefix_len`` characters is dropped, then pairs become bytes.
    Odd length or a non-hex digit raises when ``strict`` (``try_to_binary``
    alone would pad odd input instead of failing); otherwise gives null.
    """
    # Control characters and spaces around each line go, as a string trim does.
    joined = F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$|[\x00-\x20]*\n[\x00-\x20]*", "")
    if prefix_len:
        joined = F.substr(joined, F.lit(prefix_len + 1))
    ok = (F.length(joined) % 2 == 0) & joined.rlike("^[0-9A-Fa-f]*$")
    decoded = F.unhex(joined)
    if strict:
        return F.when(joined.isNull(), F.lit(None).cast("binary")).when(
            ok, decoded
        ).otherwise(F.raise_error(F.concat(F.lit("invalid hex payload of length "),
                                           F.length(joined).cast("string"))).cast("binary"))
    return F.when(ok, decoded)
