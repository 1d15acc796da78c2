"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` places. Each shard stands at ``nodes`` of them, a text at the place of its hash; it
belongs to the next node clockwise, so that equal texts keep together. No shard takes more than its share
of the rows: shares are equal up to one row, and add up to all rows. A shard keeps the first of its own
rows in ring order; what is over goes on clockwise to the next node whose shard has room. Only the overflow
leaves its own shard, and a ring with one more shard takes arcs only where its new nodes stand.

DataFrame expressions only. Rows of a place are dealt to ``salts`` parts, each numbered on its own; places
have a bounded number, so that their counts alone (at most ``cells`` numbers) are looked at on the driver to
decide which ranges of a place's rows go to which shard. A text that a third of all rows have is numbered in
``salts`` tasks.

Defined results: rows count as many times as they occur; a null text stands where null's hash is and has
size 1 and checksum 0. Slots number each shard's rows without gaps, by place, part, and doc_id.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

RANGES = "array<struct<cell: int, low: long, high: long, shard: int, slot: long>>"


@dataclass(frozen=True)
class Ring:
    shards: int = 8
    nodes: int = 128
    cells: int = 4096
    salts: int = 512

    def stations(self, spark) -> list[tuple[int, int]]:
        """(cell, shard) of all nodes, clockwise."""
        at = F.pmod(F.xxhash64(F.lit("node"), F.col("shard"), F.col("node")), F.lit(self.cells))
        rows = spark.range(self.shards * self.nodes).select((F.col("id") / self.nodes).cast("int").alias("shard"), (F.col("id") % self.nodes).alias("node"))
        rows = rows.select(at.cast("int").alias("cell"), "shard", F.xxhash64("shard", "node").alias("order"))
        return [(r["cell"], r["shard"]) for r in sorted(rows.collect(), key=lambda r: (r["cell"], r["order"], r["shard"]))]


def ranges(counts: dict[int, int], stations: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, low, high, shard, slot): rows low to high - 1 of a cell go to a shard, from a slot on."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    owner: dict[int, int] = {}
    k = 0
    for cell in sorted(counts):
        while k < len(stations) and stations[k][0] < cell:
            k += 1
        owner[cell] = stations[k % len(stations)][1]
    parts: list[tuple[int, int, int, int]] = []
    over: dict[int, tuple[int, int]] = {}
    for cell in sorted(counts):  # each shard's own rows
        shard, n = owner[cell], counts[cell]
        own = min(n, room[shard])
        room[shard] -= own
        if own:
            parts.append((cell, 0, own, shard))
        if own < n:
            over[cell] = (own, n)
    # The rest walks on: a second round meets every shard that has room left.
    waiting: deque[tuple[int, int, int]] = deque()
    cells, k = sorted(over), 0
    for lap in range(2):
        for at, shard in stations:
            while lap == 0 and k < len(cells) and cells[k] <= at:
                waiting.append((cells[k], *over[cells[k]]))
                k += 1
            while waiting and room[shard]:
                cell, low, high = waiting.popleft()
                some = min(high - low, room[shard])
                room[shard] -= some
                parts.append((cell, low, low + some, shard))
                if low + some < high:
                    waiting.appendleft((cell, low + some, high))
        while k < len(cells):  # behind the last node: on from the first one
            waiting.append((cells[k], *over[cells[k]]))
            k += 1
    slots, out = [0] * shards, []
    for cell, low, high, shard in sorted(parts):
        out.append((cell, low, high, shard, slots[shard]))
        slots[shard] += high - low
    return out


def sharded(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.pmod(F.xxhash64("text"), F.lit(ring.cells)).cast("int").alias("cell"),
        F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(ring.salts)).cast("int").alias("salt"),
    )
    rows = materialise(rows, "ring-rows")
    counts = materialise(rows.groupBy("cell", "salt").agg(F.count("*").alias("n")), "ring-counts")
    by_cell = {r["cell"]: r["n"] for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    plan = json.dumps([dict(zip(("cell", "low", "high", "shard", "slot"), r)) for r in ranges(by_cell, ring.stations(spark), ring.shards)])
    placed = spark.range(1).select(F.inline(F.from_json(F.lit(plan), RANGES)))
    before = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cell", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("doc_id", "size", "text_crc32")) - 1
    ranked = rows.withColumn("rank", rank).join(offsets, ["cell", "salt"]).withColumn("at", F.col("offset") + F.col("rank"))
    # At most one range a cell, and one more for each overflow that a shard's room cuts: bounded by the ring.
    held = ranked.join(F.broadcast(placed), "cell").filter((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    return held.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("at") - F.col("low")).alias("slot"))
