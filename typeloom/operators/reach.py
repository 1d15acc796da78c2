"""Transitive reachability over a relationship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..sources.store import ObjectStore


def edges(store: ObjectStore, source: str, via: str) -> DataFrame:
    p = store.schema.lookup(source, via)
    target = F.explode(F.col(via)) if p.is_list else F.col(via)
    return store.scan(source).select(F.col("id").alias("src"), target.alias("dst")).where(F.col("dst").isNotNull()).distinct()


def closure(pairs: DataFrame) -> DataFrame:
    """All (src, dst) with a path from src to dst; cycles are fine.

    Path lengths double every round, so rounds grow with the logarithm of the longest path. Each
    round joins only the pairs the last one found, and is written out so that the plan stays
    short and no executor's loss costs more than one round. The frontier side of the join is
    distinct on (src, dst); a destination many share is split by the adaptive skew join.
    """
    known = materialise(pairs.select("src", "dst").distinct(), "reach")
    fresh = known
    while not fresh.isEmpty():
        a = fresh.select("src", F.col("dst").alias("mid"))
        b = known.select(F.col("src").alias("mid"), "dst")
        longer = a.join(b, "mid").select("src", "dst")
        back = known.select("src", F.col("dst").alias("mid")).join(fresh.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        found = longer.unionByName(back).distinct()
        fresh = materialise(found.join(known, ["src", "dst"], "left_anti"), "reach")
        known = known.unionByName(fresh)
    return known



def reachable(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """(src, dst): what each of ``starts`` (id) reaches; cycles are fine.

    The frontier holds what the last round found first; a round is a join with the edges, so the work is that
    of the paths from the starts, and rounds are as many as the longest of them.
    """
    steps = materialise(pairs.select(F.col("src").alias("mid"), F.col("dst").alias("to")).distinct(), "reach-edges")
    front = materialise(starts.select("id").distinct().join(steps, F.col("id") == F.col("mid")).select(F.col("id").alias("src"), F.col("to").alias("dst")).distinct(), "reach-from")
    known = front
    while not front.isEmpty():
        found = front.join(steps, F.col("dst") == F.col("mid")).select("src", F.col("to").alias("dst")).distinct()
        front = materialise(found.join(known, ["src", "dst"], "left_anti"), "reach-from")
        known = known.unionByName(front)
    return known
