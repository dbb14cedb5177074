"""Column expressions on object keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_ext(key: Column) -> Column:
    """Suffix from the last dot of the last path element ('' when none)."""
    return F.regexp_extract(key, r"(\.[^./]*)$", 1)


def key_base(key: Column) -> Column:
    return F.regexp_replace(key, r"\.[^./]*$", "")


def page_key(key: Column, page_no: Column) -> Column:
    """``base_NNN.ext`` for one page of a multi-page artifact."""
    return F.format_string("%s_%03d%s", key_base(key), page_no.cast("int"), key_ext(key))
