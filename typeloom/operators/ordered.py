"""Per-key computations in time order that do not gather a key in one task.

Rows are range-partitioned by (key, order), so a key with very many rows covers several
partitions ("chunks"). What a chunk does to a state is worked out in each chunk on its own and
then carried over the chunk borders, of which there are as many as partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

CHUNK = "_chunk"
EDGE = "_edge"
#: So many border rows are scanned in one task; more are dealt out and scanned like the rows themselves.
BORDERS = 50_000


def _compose(moves: np.ndarray, joined: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """Running composition of state functions within runs of one key.

    ``moves[i, s]`` is the state after row i when it was s before; ``joined[i]`` tells that row i
    continues the key of row i-1. Doubling steps, each one array operation.
    """
    out = moves.copy()
    n = len(out)
    start = np.maximum.accumulate(np.where(joined, 0, np.arange(n)))
    if joined[0]:
        out[0] = moves[0][carry]
    step = 1
    while True:
        at = np.nonzero(np.arange(n) - step >= start)[0]
        if len(at) == 0:
            return out
        out[at] = np.take_along_axis(out[at], out[at - step], axis=1)
        step *= 2


def _scan(key: str, states: int):
    """Arrow batches in order -> the same rows with what came before them inside their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        identity = np.arange(states, dtype=np.int8)
        last_key, carry, first_run, held = None, identity, True, None

        def emit(batch: pa.RecordBatch, before: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            arrays = list(batch.columns) + [pa.array(before[:, s]) for s in range(states)]
            arrays += [pa.array(np.full(len(edge), chunk, dtype=np.int32)), pa.array(edge)]
            names = batch.schema.names + [f"_p{s}" for s in range(states)] + [CHUNK, EDGE]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(key)
            joined = np.zeros(n, dtype=bool)
            joined[0] = last_key is not None and keys[0].as_py() == last_key
            if n > 1:
                joined[1:] = pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            moves = np.stack([batch.column(f"_m{s}").to_numpy(zero_copy_only=False) for s in range(states)], axis=1).astype(np.int8)
            after = _compose(moves, joined, carry)
            before = np.empty_like(after)
            before[0] = carry
            before[1:] = after[:-1]
            before[~joined] = identity
            edge = np.zeros(n, dtype=bool)
            breaks = np.nonzero(~joined)[0] if last_key is not None else np.nonzero(~joined)[0][1:]
            held_edge = False
            if first_run and len(breaks):
                if breaks[0] == 0:
                    held_edge = True
                else:
                    edge[breaks[0] - 1] = True
                first_run = False
            if held is not None:
                yield emit(held[0], held[1], np.array([held_edge]))
            if n > 1:
                yield emit(batch.slice(0, n - 1), before[:-1], edge[:-1])
            held = (batch.slice(n - 1, 1), before[-1:])
            last_key, carry = keys[n - 1].as_py(), after[-1]
        if held is not None:
            yield emit(held[0], held[1], np.array([True]))

    return run


def _chunked(prepared: DataFrame, by: list[str], n: int, partitions: int | None = None) -> DataFrame:
    """Rows in order with ``_p``: where each state leads to before the row, inside its chunk."""
    ranged = prepared.repartitionByRange(partitions, *by) if partitions else prepared.repartitionByRange(*by)
    schema = T.StructType(
        prepared.schema.fields
        + [T.StructField(f"_p{s}", T.ByteType()) for s in range(n)]
        + [T.StructField(CHUNK, T.IntegerType()), T.StructField(EDGE, T.BooleanType())]
    )
    return materialise(ranged.sortWithinPartitions(*by).mapInArrow(_scan(by[0], n), schema), "chunks")


def _through(n: int) -> tuple[Column, Column]:
    """What a row does to each state, and what came before it in its chunk does."""
    return F.array(*[F.col(f"_m{s}").cast("int") for s in range(n)]), F.array(*[F.col(f"_p{s}").cast("int") for s in range(n)])


def _entries(chunked: DataFrame, key: str, n: int, initial: int, most: int) -> DataFrame:
    """(key, chunk, _start): the state in which a chunk's rows of a key begin, for keys at its borders.

    The border rows (two at most for each chunk) are a sequence of the same kind, in the order of the chunks: they go through
    the same scan, and while there are many, their own chunks' borders do so again.
    """
    move, before = _through(n)
    through = [F.get(move, F.col(f"_p{s}").cast("int")).cast("tinyint").alias(f"_m{s}") for s in range(n)]
    edges = chunked.where(EDGE).select(key, F.col(CHUNK).alias("_order"), *through)
    few = chunked.where(EDGE).count() <= most
    scanned = _chunked(edges, [key, "_order"], n, 1 if few else None)
    start = F.lit(initial)
    if not few:
        scanned = scanned.join(_entries(scanned, key, n, initial, most), [key, CHUNK], "left")
        start = F.coalesce(F.col("_start"), start)
    return scanned.select(key, F.col("_order").alias(CHUNK), F.get(before, start).alias("_start"))


def fold_states(
    rows: DataFrame, key: str, order: list[str], states: list[str], moves: list[Column], initial: str, partitions: int | None = None, borders: int = BORDERS
) -> DataFrame:
    """Rows with ``from_state`` and ``to_state``: a state machine run over each key's rows in order.

    ``moves[s]`` is the index of the state a row leads to from state s. The intermediate result is
    written once to the shared folder, so the chunk numbers in it can never change.
    """
    n, first = len(states), states.index(initial)
    prepared = rows.select("*", *[m.cast("tinyint").alias(f"_m{s}") for s, m in enumerate(moves)])
    chunked = _chunked(prepared, [key, *order], n, partitions)
    move, before = _through(n)
    # At most two rows for each chunk.
    starts = _entries(chunked, key, n, first, borders)
    known = chunked.join(F.broadcast(starts), [key, CHUNK], "left")
    start = F.coalesce(F.col("_start"), F.lit(first))
    names = F.array(*[F.lit(s) for s in states])
    out = known.withColumn("_at", F.get(before, start)).withColumn("_to", F.get(move, F.col("_at")))
    return out.select(*rows.columns, F.get(names, F.col("_at")).alias("from_state"), F.get(names, F.col("_to")).alias("to_state"), CHUNK)


def next_in_order(rows: DataFrame, key: str, order: list[str], column: str, alias: str) -> DataFrame:
    """Each row with the value of ``column`` in the key's next row, for rows that carry a chunk.

    Windows are over (key, chunk), never over a whole key; the value behind a chunk's last row is
    the first one of the key's next chunk.
    """
    inside = Window.partitionBy(key, CHUNK).orderBy(*order)
    firsts = rows.groupBy(key, CHUNK).agg(F.min_by(column, F.struct(*order)).alias("_v"))
    after = F.lead("_v").over(Window.partitionBy(key).orderBy(CHUNK))
    border = firsts.select(key, CHUNK, after.alias("_after"))
    led = rows.withColumn("_next", F.lead(column).over(inside))
    return led.join(border, [key, CHUNK]).withColumn(alias, F.coalesce("_next", "_after")).drop("_next", "_after")
