"""Tokenising, matching and scoring text with built-in expressions only.

No stemming and no stop words: lower-cased runs of letters and digits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Property

# Fixed value: a token is a run of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def token_counts(text: Column) -> Column:
    """The distinct tokens of one text with their number of occurrences: array of (token, tf).

    The tokens are sorted and cut where a run of equal ones ends, so nothing is held beyond one text.
    """

    def runs(toks: Column) -> Column:
        # Behind the last token is null, which differs from it; of no tokens all places are null.
        ends = F.filter(F.sequence(F.lit(1), F.size(toks)), lambda i: ~F.get(toks, i).eqNullSafe(F.get(toks, i - 1)))
        return _bound(ends, lambda at: F.transform(at, lambda end, k: F.struct(
            F.get(toks, end - 1).alias("token"), (end - F.coalesce(F.get(at, k - 1), F.lit(0))).cast("long").alias("tf"))))

    return _bound(F.sort_array(tokens(text)), runs)


def query_tokens(text: str | None) -> list[str]:
    """Tokens of the query string itself; one short string, so split on the driver."""
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def searchable_text(properties: list[Property]) -> Column:
    """Text of every searchable property, joined by blanks; missing values are skipped."""
    parts = [F.array_join(F.col(p.name), " ") if isinstance(p.spark_type, T.ArrayType) else F.col(p.name) for p in properties]
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def query_words(text: str | None) -> dict[str, int]:
    """Distinct query tokens with how often the query repeats them."""
    return Counter(query_tokens(text))


def matches(toks: Column, text: str | None) -> Column:
    """True where every query token occurs; a query without tokens matches nothing."""
    wanted = query_words(text)
    if not wanted:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [F.array_contains(toks, w) for w in wanted])


def score(toks: Column, text: str | None) -> Column:
    """Occurrences of the query tokens, each counted as often as the query repeats it."""
    wanted = query_words(text)
    if not wanted:
        return F.lit(0).cast("long")

    def occurrences(word: str) -> Column:
        return F.size(F.filter(toks, lambda z: z == word)).cast("long")

    return reduce(add, [occurrences(w) * n for w, n in wanted.items()])
