"""The corpus operators over the given tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, archives, blob_ledger, bpe, decision_list, decontam, langid, line_chunks, minhash, phrases, ring_shards, site_bayes, token_orc
from ..session import fresh_path, materialise
from .common import documents, ready, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; the models are fitted on those that aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), langid.predicted(model, docs, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


@query
def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of lines that stand in an earlier place already."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = line_chunks.remove_repeats(docs, line_chunks.WHOLE)
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_kept").cast("long"), "text")


@query
def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles are similar by 0.8 or more, transitively."""
    return minhash.near_copies(documents(spark, sf_dir), minhash.MinHash(size=4))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontam.leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to, of every document."""
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), byte_bpe()).drop("text")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, found through a ledger of scanned blobs."""
    ledger = blob_ledger.Ledger(ready(spark))
    rows = ledger.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(blob_ledger.BASE))

    def of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [of(k).alias(f"n_{r.kind}") for k, r in enumerate(blob_ledger.BASE)]
    return ledger.report(rows).select(
        F.col("key").alias("doc_id"),
        *counts,
        F.sha2(blob_ledger.described(base, ledger.rules), 256).alias("base_sha256"),
        blob_ledger.described(F.col("spans"), ledger.rules).alias("spans"),
    )


@query
def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of as many rows, up to one."""
    return ring_shards.sharded(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and what a decision list learned from the labels says."""
    stats = materialise(decision_list.statistics(documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "quality-stats")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = decision_list.learn(stats.filter(~failed).join(labels, "doc_id").withColumn("low", F.col("quality") == 0))
    return stats.select("doc_id", *decision_list.STATS[:5], failed.alias("base_failed"), decision_list.verdict(rules).alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in ORC files of all documents, read from the files."""
    import public_tokenizers

    docs = documents(spark, sf_dir)
    path = fresh_path(spark, "token-files")
    token_orc.write(docs, path, token_orc.TokenFiles(public_tokenizers.path("byte_bpe_50k.json")))
    return token_orc.digests(spark, path)


@query
def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality and toxicity of every document; its source is the host, its language the path."""
    docs = documents(spark, sf_dir)
    evidence = site_bayes.fit(docs, table(spark, sf_dir, "labels"))
    out = site_bayes.judged(docs, evidence, F.col("source"), F.col("lang"))
    return out.withColumn("kept", (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in two tokenizers: groups that end together, overlaps, and what those are worth corpus-wide."""
    import public_tokenizers

    spec = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.aligned(documents(spark, sf_dir).select("doc_id", "text"), spec)


@query
def op12_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of legacy archives that are converted to WARC, read back from there."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url", F.lit("20240101000000").alias("date"), F.col("html").alias("payload"))
    out = archives.through_archives(pages, archives.Archives(), F.col("key").cast("long"))
    return out.select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest collocations of two to four words of each language, over all texts."""
    return phrases.mined(documents(spark, sf_dir).select("lang", "text"))
