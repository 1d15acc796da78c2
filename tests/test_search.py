"""The inverted index: counts inside texts, objects in several rows, batches that replace each other."""

import re
from collections import Counter

from pyspark.sql import functions as F

from typeloom.operators.search import newest, postings
from typeloom.streaming import streams as S

ROWS = [("a", "x Y x, y-x"), ("a", "y 7"), (None, "z z"), (None, "z"), ("b", None), ("c", ""), ("d", " ., "), ("e", "ä Ä o"), ("f", "one")]


def plain(rows):
    out = Counter()
    for k, text in rows:
        out.update((k, w) for w in re.findall(r"[^\W_]+", (text or "").lower()))
    return out


def counts(df):
    return {(r.id, r.token): r.tf for r in df.collect()}


def test_postings_count_objects_in_several_rows(spark):
    rows = spark.createDataFrame(ROWS, "id string, text string")
    assert counts(postings(rows, F.col("text"))) == plain(ROWS)


def test_postings_of_single_rows_hold_no_state(spark):
    rows = spark.createDataFrame([r for r in ROWS if r[0] in tuple("bcdef")], "id string, text string")
    index = postings(rows, F.col("text"))
    assert counts(index) == plain([r for r in ROWS if r[0] in tuple("bcdef")])
    plan = index._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan and "Sort " not in plan


def test_newest(spark):
    rows = [("a", 1, "p"), ("a", 2, "q"), ("a", 2, "r"), ("a", None, "s"), ("b", 1, "t"), (None, 1, "u"), ("c", None, "v")]
    df = spark.createDataFrame(rows, "id string, version long, text string")
    assert sorted(r.text for r in newest(df).collect()) == ["q", "r", "t"]
    once = newest(df.where("text IN ('r', 't', 'u')"))
    assert sorted(r.text for r in once.collect()) == ["r", "t"]
    assert "Join" not in once._jdf.queryExecution().toString()


def test_maintained_index(spark, tmp_path):
    keep, path = S.maintain_index(str(tmp_path)), str(tmp_path)

    def batch(n, *rows):
        keep(spark.createDataFrame([(k, n, text, None) for k, text in rows], "id string, version long, search_text string, deleted_at timestamp"), n)

    batch(0, ("a", "x x"), ("b", "y"))
    index = S.read_maintained(spark, path)
    assert "Join" not in index._jdf.queryExecution().toString()
    assert counts(index) == {("a", "x"): 2, ("b", "y"): 1}
    batch(1, ("a", "z"), ("c", "y y"))
    assert counts(S.read_maintained(spark, path)) == {("a", "z"): 1, ("b", "y"): 1, ("c", "y"): 2}
