"""Connected components of a graph given as an edge table, by random contraction.

In each round every node names itself after the node of its closed neighbourhood that comes first in a
fresh random order, and edges are rewritten to the new names; a constant share of the nodes goes in each
round, whatever the shape (long chains too). Then the names are traced back round by round.

Each round's tables are written to the shared folder. A node with very many edges is grouped map-side;
joins on it meet one row of a written table, so that adaptive execution can split them.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(edges: DataFrame, seed: int = 7) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b: long); component is the least id reachable."""
    order = random.Random(seed)
    first = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    now, names = first, []
    while not now.isEmpty():
        key = order.getrandbits(63)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mixed = F.least(F.min(F.col("b").bitwiseXOR(F.lit(key))), F.col("a").bitwiseXOR(F.lit(key)))
        name = materialise(both.groupBy("a").agg(mixed.bitwiseXOR(F.lit(key)).alias("to")), "names")
        names.append(name)
        left, right = name.select("a", F.col("to").alias("x")), name.select(F.col("a").alias("b"), F.col("to").alias("y"))
        now = materialise(now.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not names:
        return first.select(F.col("a").alias("id"), F.col("b").alias("component"))
    root = names[-1].select(F.col("a").alias("id"), F.col("to").alias("root"))
    for name in reversed(names[:-1]):
        up = root.select(F.col("id").alias("to"), "root")
        # A name that got no new name in the next round has no edge there: it is a root.
        root = materialise(name.join(up, "to", "left").select(F.col("a").alias("id"), F.coalesce("root", "to").alias("root")), "roots")
    least = materialise(root.groupBy("root").agg(F.min("id").alias("component")), "components")
    return root.join(least, "root").select("id", "component")
