"""Object ids: 36-character lower-case UUID strings built from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_id(type_no: int, key: Column) -> Column:
    """UUID that carries a type number and a numeric key in its last two groups."""
    prefix = f"00000000-0000-4000-8{type_no:03x}-"
    return F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(key.cast("long"))), 12, "0"))


def name_uuid(name: Column) -> Column:
    """Version 3 UUID of a text: its MD5 digest with the version and variant bits set."""
    h = F.md5(name.cast("binary"))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8),
        F.lit("-"),
        F.substring(h, 9, 4),
        F.lit("-3"),
        F.substring(h, 14, 3),
        F.lit("-"),
        variant,
        F.substring(h, 18, 3),
        F.lit("-"),
        F.substring(h, 21, 12),
    )


def derived_id(row_id: Column, action_index: Column) -> Column:
    """Id of the object an action creates: the same event and action always give the same id."""
    return name_uuid(F.concat(row_id, F.lit(":"), action_index.cast("string")))
