"""The pipeline against its plain version, stage by stage."""

import base64

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from typeloom.llm.queries import byte_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiktoken_encode():
    import tiktoken

    v = byte_bpe()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(v.path, "rb"))}
    return tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_pipeline_against_plain_version(spark, tiktoken_encode):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: texts[r["doc_id"]] for r in kept.select("doc_id").collect()}
    assert len(texts) >= 0.99 * docs.count()
    short = brute.without_passages(texts)
    texts = {i: t for i, t in short.items() if t == texts[i] or brute.WORD.search(t)}
    root = brute.components(texts, 5)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    # Every window of every text takes too long here: texts without any item's words in a row are clean.
    near = {i: t for i, t in texts.items() if any(brute.shingles(t, 5) & brute.shingles(x, 5) for x in items.values())}
    dirty = {d for d, _ in brute.leaks(near, items)}
    want = {i: tiktoken_encode(t) for i, t in texts.items() if i not in dirty}
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == want
    assert got.filter("NOT exact OR n_tokens <> size(ids)").count() == 0


def test_every_stage_stands_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (8, "1 2 3", None, "s", 5)], docs.schema)
    wide = docs.limit(40).unionByName(odd).withColumn("N_LINES", F.lit(1)).withColumn("_lang", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        for frame in (wide, wide.limit(0)):
            out = stage(spark, frame, SF)
            rows = out.count()
            assert rows <= frame.count()
            if name != "tokens":
                assert out.columns == wide.columns
