"""ISO-8601 durations and timer keys."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = re.compile(
    r"^(?P<sign>-)?P(?:(?P<d>\d+)D)?(?:T(?:(?P<h>\d+)H)?(?:(?P<m>\d+)M)?(?:(?P<s>\d+(?:\.\d+)?)S)?)?$"
)


def parse_duration(text: str) -> timedelta:
    m = _DURATION.match(text)
    if not m or not any(m.group(g) for g in "dhms"):
        raise ValueError(f"not an ISO-8601 duration: '{text}'")
    span = timedelta(
        days=int(m["d"] or 0), hours=int(m["h"] or 0), minutes=int(m["m"] or 0), seconds=float(m["s"] or 0)
    )
    return -span if m["sign"] else span


def plus(ts: Column, duration: str) -> Column:
    micros = int(parse_duration(duration) / timedelta(microseconds=1))
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(micros))


def timer_key(object_id: Column, state: Column, transition: Column) -> Column:
    return F.concat_ws("|", object_id, state, transition)
