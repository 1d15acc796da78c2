"""From raw documents to token ids, in five stages over the documents table.

1. language: documents without a recognised language go;
2. lines: passages of lines that stand in an earlier place already are taken out, and documents that are
   left without a word go;
3. near_copies: of each group of near copies (five-word shingles, similarity 0.8) the least doc_id stays;
4. decontamination: documents that hold a benchmark item go;
5. tokens: byte-level BPE ids of what is left, decoded again as a check.

Each stage works on all that its predecessor kept and returns the columns of documents, but for the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from typeloom.llm import bpe, decontam, langid, line_chunks, minhash
from typeloom.llm.common import ready, table
from typeloom.llm.queries import byte_bpe
from typeloom.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return line_chunks.drop_repeats(docs, line_chunks.WHOLE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return minhash.keep_firsts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return bpe.tokenised(docs.select("doc_id", "lang", "source", "text"), byte_bpe()).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Language models and rolling hashes have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
