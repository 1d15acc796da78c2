"""Message templates and guard expressions over the object's own columns (``self``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOLE = re.compile(r"\$\{([^}]*)\}")


def _own(expression: str, self_struct: str) -> str:
    return re.sub(r"\bself\.", f"{self_struct}." if self_struct else "", expression)


def value(expression: str, self_struct: str = "") -> Column:
    """A Spark SQL expression in which ``self.x`` reads property x of the object."""
    return F.expr(_own(expression, self_struct))


def guard(expression: str | None, self_struct: str = "") -> Column:
    """A guard holds only when it is true; missing values and non-booleans count as false."""
    if expression is None:
        return F.lit(True)
    cond = F.expr(f"try_cast(cast(({_own(expression, self_struct)}) AS string) AS boolean)")
    kind = F.typeof(value(expression, self_struct))
    return F.when(kind == "boolean", F.coalesce(cond, F.lit(False))).otherwise(F.lit(False))


def render(template: str, self_struct: str = "") -> Column:
    """Text with every ``${expression}`` replaced by its value; a missing value leaves nothing."""
    parts: list[Column] = []
    last = 0
    for hole in _HOLE.finditer(template):
        if hole.start() > last:
            parts.append(F.lit(template[last : hole.start()]))
        parts.append(F.coalesce(value(hole.group(1), self_struct).cast("string"), F.lit("")))
        last = hole.end()
    if last < len(template):
        parts.append(F.lit(template[last:]))
    return F.concat(*parts) if parts else F.lit("")
