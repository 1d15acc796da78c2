"""Text search on the fly and through the inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.browse import SCORE, BrowseSpec, facets, matching, page, page_after, resolve
from ..operators.search import build_index, lookup, ranked, upsert
from .demo import DemoStore
from .registry import query

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda z: z <> '')"
_TOK = f"tok AS (SELECT id, created_at, lang, source, {_TOKENS} AS t FROM l_document)"
TEXT = "the is"
_MATCH = "list_contains(t, 'the') AND list_contains(t, 'is')"
_SCORE = "CAST(len(list_filter(t, lambda z: z = 'the')) + len(list_filter(t, lambda z: z = 'is')) AS BIGINT)"


@query("tokens", "SELECT id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM tok", _TOK)
def token_lists(s: DemoStore) -> DataFrame:
    toks = tokens(F.col("text"))
    return s.scan("Document").select("id", F.size(toks).cast("long").alias("n_tokens"), F.md5(F.array_join(toks, " ").cast("binary")).alias("digest"))


@query("search_match", f"SELECT id, lang FROM tok WHERE {_MATCH}", _TOK)
def search_match(s: DemoStore) -> DataFrame:
    return matching(s, resolve(s.schema, BrowseSpec(("Document",), text=TEXT))).select("id", "lang")


@query(
    "search_ranked",
    f"SELECT id, {_SCORE} AS score, row_number() OVER (ORDER BY {_SCORE} DESC, created_at, id) AS pos FROM tok WHERE {_MATCH} ORDER BY pos LIMIT 100",
    _TOK,
)
def search_ranked(s: DemoStore) -> DataFrame:
    q = resolve(s.schema, BrowseSpec(("Document",), text=TEXT, size=100))
    top = page(matching(s, q), q).select("id", SCORE, F.monotonically_increasing_id().alias("_at"))
    return top.withColumn("pos", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


@query(
    "page_after_ranked",
    f"SELECT id, {_SCORE} AS score FROM tok WHERE {_MATCH} AND ({_SCORE} < 12 OR ({_SCORE} = 12 AND created_at > TIMESTAMP '2024-01-01 06:00:00')) ORDER BY score DESC, created_at, id LIMIT 100",
    _TOK,
)
def page_after_ranked(s: DemoStore) -> DataFrame:
    """The page behind a known row of a ranked search."""
    q = resolve(s.schema, BrowseSpec(("Document",), text=TEXT, size=100))
    last = {SCORE: 12, "created_at": "2024-01-01 06:00:00", "id": "~"}
    return page_after(matching(s, q), q, last).select("id", F.col(SCORE).cast("long").alias("score"))


@query(
    "search_facets",
    f"SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM tok WHERE {_MATCH} AND lang IS NOT NULL GROUP BY lang "
    f"UNION ALL SELECT 'source', source, count(*) FROM tok WHERE {_MATCH} AND lang = 'en' GROUP BY source",
    _TOK,
)
def search_facets(s: DemoStore) -> DataFrame:
    return facets(s, resolve(s.schema, BrowseSpec(("Document",), (("lang", "eq", "en"),), text=TEXT, facets=("lang", "source"))))


@query("search_index", "SELECT token, id, count(*) AS tf FROM (SELECT id, unnest(t) AS token FROM tok) GROUP BY token, id", _TOK)
def search_index(s: DemoStore) -> DataFrame:
    return build_index(s, "Document").select("token", "id", "tf")


@query("search_by_index", f"SELECT id, {_SCORE} AS score FROM tok WHERE {_MATCH}", _TOK)
def search_by_index(s: DemoStore) -> DataFrame:
    return lookup(build_index(s, "Document"), TEXT)


@query(
    "search_ranked_by_index",
    f"SELECT id, lang, {_SCORE} AS score, row_number() OVER (ORDER BY {_SCORE} DESC, created_at, id) AS pos FROM tok WHERE {_MATCH} ORDER BY pos LIMIT 100",
    _TOK,
)
def search_ranked_by_index(s: DemoStore) -> DataFrame:
    top = ranked(s, build_index(s, "Document"), TEXT, "Document").limit(100)
    at = top.select("id", "lang", "score", F.monotonically_increasing_id().alias("_at"))
    return at.withColumn("pos", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


@query(
    "search_index_upsert",
    "SELECT token, id, count(*) AS tf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda z: z <> '')) AS token "
    "FROM (SELECT id, CASE WHEN lang = 'en' THEN source || ' ' || text ELSE text END AS text FROM l_document WHERE lang <> 'fr')) GROUP BY token, id",
)
def search_index_upsert(s: DemoStore) -> DataFrame:
    """English documents were rewritten and French ones deleted since the index was built."""
    docs = s.scan("Document", with_search_text=True)
    gone = F.when(F.col("lang") == "fr", F.current_timestamp())
    text = F.concat(F.col("source"), F.lit(" "), F.col("search_text"))
    changed = docs.where(F.col("lang").isin("en", "fr")).withColumn("deleted_at", gone).withColumn("search_text", text)
    return upsert(build_index(s, "Document"), changed).select("token", "id", "tf")
