"""Inverted index: one row per (token, object) with its number of occurrences."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_words, token_counts
from ..session import materialise
from ..sources.store import SEARCH_TEXT, ObjectStore

BUCKETS = 256


def postings(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """(id, token, tf).

    Tokens are counted inside each text, so that a task holds the counts of one text at a time and nothing is
    shuffled. Only objects that come in several rows are put together by object *and* token, which spreads even the
    most frequent token over all tasks; their ids are found (and stored) first. The outer generator keeps Spark
    from adding a filter that would split every text a second time.
    """
    col = text if text is not None else F.col(SEARCH_TEXT)

    def counted(part: DataFrame) -> DataFrame:
        return part.select("id", F.inline_outer(token_counts(col))).where(F.col("token").isNotNull())

    several = materialise(rows.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "repeated-ids")
    if several.isEmpty():
        return counted(rows)
    same = F.col("id").eqNullSafe(F.col("_id"))  # objects without an id are one object
    merged = counted(rows.join(several, same, "left_semi")).groupBy("id", "token").agg(F.sum("tf").alias("tf"))
    return counted(rows.join(several, same, "left_anti")).unionByName(merged)


def build_index(store: ObjectStore, *types: str) -> DataFrame:
    return postings(store.scan(*types, with_search_text=True))


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def write_index(index: DataFrame, path: str, files_per_bucket: int = 1) -> None:
    """Partitioned by token bucket, sorted by token, so a query reads only the row groups of its
    tokens. A bucket with a very frequent token is spread over ``files_per_bucket`` files."""
    spread = F.pmod(F.xxhash64("id"), F.lit(files_per_bucket))
    (
        index.withColumn("bucket", bucket_of(F.col("token")))
        .repartition(F.col("bucket"), spread)
        .sortWithinPartitions("bucket", "token", "id")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Postings of the query's tokens; the bucket condition prunes directories."""
    wanted = list(query_words(text))
    rows = spark.read.parquet(path)
    if not wanted:
        return rows.where(F.lit(False))
    buckets = spark.range(1).select(F.array(*[bucket_of(F.lit(w)) for w in wanted])).first()[0]
    return rows.where(F.col("bucket").isin(*buckets) & F.col("token").isin(*wanted))


def lookup(index: DataFrame, text: str) -> DataFrame:
    """(id, score) of objects that hold every query token, found through the index alone."""
    wanted = query_words(text)
    if not wanted:
        return index.select("id", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    weight = reduce(add, [F.when(F.col("token") == w, F.col("tf") * n).otherwise(F.lit(0)) for w, n in wanted.items()])
    return (
        index.where(F.col("token").isin(*wanted))
        .groupBy("id")
        .agg(F.count("*").alias("_found"), F.sum(weight).alias("score"))
        .where(F.col("_found") == len(wanted))
        .select("id", "score")
    )


def ranked(store: ObjectStore, index: DataFrame, text: str, *types: str) -> DataFrame:
    """Live objects that hold every query token, with their score, best first.

    The index finds and scores them, so no text is read.
    """
    hits = store.scan(*types).join(lookup(index, text), "id")
    return hits.orderBy(F.col("score").desc(), F.col("created_at").asc(), F.col("id").asc())


def newest(rows: DataFrame) -> DataFrame:
    """Of several versions of an object in one batch only the last; rows without an id or a version are left out.

    The rows meet a join only if some object has several versions, whose last ones are stored first.
    """
    span = rows.groupBy(F.col("id").alias("_id")).agg(F.min("version").alias("_first"), F.max("version").alias("_last"))
    moved = materialise(span.where("_first < _last").select("_id", "_last"), "moved-ids")
    rows = rows.where(F.col("id").isNotNull() & F.col("version").isNotNull())
    if moved.isEmpty():
        return rows
    return rows.join(moved, (F.col("id") == F.col("_id")) & (F.col("version") < F.col("_last")), "left_anti")


def upsert(index: DataFrame, changed: DataFrame, text: Column | None = None) -> DataFrame:
    """Index after the objects in ``changed`` were rewritten; deleted ones lose their rows."""
    changed = newest(changed)
    live = changed.where(F.col("deleted_at").isNull())
    return index.join(changed.select("id").distinct(), "id", "left_anti").unionByName(postings(live, text))
