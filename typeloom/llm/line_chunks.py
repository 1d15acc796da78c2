"""Removal of passages of lines that the corpus holds elsewhere already.

Every text is cut into chunks of whole lines by its content alone: a boundary follows a line where the
rolling hash over the last two line hashes is a local maximum, so that inserting or deleting lines
moves only the boundaries nearby and a passage is cut alike wherever it stands. A line of ``solo_words``
words or more is a chunk of its own. Where ``run_words`` is given, the shortest runs of that many words that
begin, and that end, with each line are hashed too, so that a passage of as many words is found whole, whatever
stands around it. Of the chunks of several lines, the long lines and the runs that occur more than once in
the corpus, the first occurrence (least doc_id, then least line) stays; the others are removed after their
bytes were compared with the first one's. What overlaps its first occurrence in the same text stays.

DataFrame expressions only. Only positions and hashes are grouped; a chunk or run that a third of all
documents share is counted map-side, and its rows are joined to one row of a written table, which lets
adaptive execution split them.

Defined results: null texts stay null; texts without a repeated chunk stay as they are; chunks without
a word are never removed; rows that share a doc_id count as one document, whose equal lines at equal
places are one occurrence; a null doc_id counts as the least. Columns besides doc_id and text pass
through. A single short line that repeats stays. A line counts as the words that its single spaces and tabs
allow, one at least.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, settled
from .common import fresh


@dataclass(frozen=True)
class LineChunks:
    """``run_words``: passages of that many words are looked for line by line too; None: chunks alone."""

    solo_words: int = 50
    min_lines: int = 2
    run_words: int | None = None


#: Chunks, and every passage of whole lines of 50 words or more.
WHOLE = LineChunks(run_words=50)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _span(start: Column, stop: Column) -> Column:
    """Both in one number, which sets of Spark hash."""
    return F.shiftleft(start.cast("long"), 32) + stop


def _runs(n: int) -> tuple[Column, Column]:
    """From ``at`` (the line of each word) and ``begin`` (each line's first word): the shortest runs of ``n``
    words that begin, and that end, with each line.

    Every line of a repeated passage of ``n`` words is in one such run that lies in the passage: in the one
    that ends with it or, where too few words stand before, in the one that begins with the passage.
    """
    after = lambda i: F.coalesce(F.get("begin", i + 1), F.size("at"))
    ahead = F.transform("begin", lambda p, i: _span(i + 1, F.get("at", p + n - 1)))
    behind = F.transform("begin", lambda p, i: _span(F.when(after(i) >= n, F.get("at", after(i) - n)), i + 1))
    return ahead, behind


def occurrences(docs: DataFrame, spec: LineChunks) -> DataFrame:
    """doc_id, version (hash of the text), first and last line (from 1) and hash of every run of lines that may be removed."""
    least = F.lit(-(2**63)).cast("long")
    lines = settled(
        docs.select("doc_id", F.xxhash64("text").alias("version"), _lines(F.col("text")).alias("lines")).filter(F.col("lines").isNotNull())
    )

    def n_words(x: Column) -> Column:
        # One at least, and as many as single spaces and tabs allow.
        pure = F.trim(x)
        gaps = F.octet_length(pure) - F.octet_length(F.replace(F.replace(pure, F.lit(" ")), F.lit("\t")))
        return F.least(gaps + 1, F.lit(spec.run_words))

    hashed = settled(
        lines.select(
            "doc_id",
            "version",
            F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
            # As many words as single spaces allow; counting stays cheap.
            F.transform("lines", lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) >= spec.solo_words - 1).alias("long"),
            F.transform("lines", lambda x: F.trim(x) != "").alias("full"),
            *([F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i + 1, n_words(x)))).alias("at")] if spec.run_words else []),
        )
    )
    own = ["doc_id", "version", "h", "long", "full", *(["at"] if spec.run_words else [])]

    def shifted(a: Column, by: int, fill: Column) -> Column:
        if by < 0:
            return F.concat(F.array(fill), F.slice(a, 1, F.size(a) - 1))
        return F.concat(F.slice(a, 2, F.size(a) - 1), F.array(fill))

    rolled = settled(hashed.select("*", F.zip_with(shifted(F.col("h"), -1, F.lit(0).cast("long")), "h", lambda a, b: F.xxhash64(a, b)).alias("r")))
    peaks = F.zip_with(
        F.zip_with(shifted(F.col("r"), -1, least), "r", lambda a, b: b > a),
        F.zip_with("r", shifted(F.col("r"), 1, least), lambda a, b: a >= b),
        lambda a, b: a & b,
    )
    alone = F.zip_with("long", shifted(F.col("long"), 1, F.lit(True)), lambda a, b: a | b)
    cut = settled(rolled.select(*own, F.zip_with(peaks, alone, lambda a, b: a | b).alias("cut")))
    begin = F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda p: (p == 0) | (F.get("at", p) != F.get("at", p - 1)))
    ends = settled(
        cut.select(
            *own,
            F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: F.get("cut", i - 1)).alias("ends"),
            *([begin.alias("begin")] if spec.run_words else []),
        )
    )
    chunks = F.zip_with(
        F.concat(F.array(F.lit(1)), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: e + 1)),
        "ends",
        lambda a, b: F.when((b - a + 1 >= spec.min_lines) | F.get("long", a - 1), _span(a, b)),
    )
    spans = F.array_distinct(F.concat(chunks, *_runs(spec.run_words))) if spec.run_words else chunks
    found = settled(ends.select("doc_id", "version", "h", "full", F.filter(spans, lambda x: x.isNotNull()).alias("spans")))

    def described(x: Column) -> Column:
        a, b = F.shiftright(x, 32).cast("int"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.struct(
            a.alias("start"),
            b.alias("stop"),
            F.xxhash64(F.slice("h", a, b - a + 1)).alias("key"),
            F.exists(F.slice("full", a, b - a + 1), lambda y: y).alias("full"),
        )

    return found.select("doc_id", "version", F.inline(F.transform("spans", described))).filter("full").drop("full")


def _chunk(lines: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(lines, start, stop - start + 1), "\n")


def marked(docs: DataFrame, spec: LineChunks = LineChunks()) -> DataFrame:
    """doc_id, version and the passages to remove from that text, each with the bytes it must have.

    Runs that overlap or touch, and whose first occurrences do so alike, are one passage.
    """
    occ = materialise(occurrences(docs.select("doc_id", "text"), spec), "line-chunks")
    first = materialise(
        occ.groupBy("key")
        .agg(F.min(F.struct("doc_id", "start", "version")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("key", *(F.col(f"first.{c}").alias(f"first_{n}") for c, n in (("doc_id", "id"), ("start", "start"), ("version", "version")))),
        "line-chunks-first",
    )
    ahead = F.col("first_start") - F.col("start")
    # Not the first itself, nor what overlaps it in its own text.
    itself = F.col("doc_id").eqNullSafe(F.col("first_id")) & ((ahead == 0) | ((F.col("version") == F.col("first_version")) & (ahead + F.col("stop") >= F.col("start"))))
    place = ["doc_id", "version", "first_id", "first_version", "ahead"]
    later = occ.join(first, "key").filter(~itself).withColumn("ahead", ahead)
    covered = later.groupBy(*place).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", "stop"))))).alias("rows"))
    edges = F.zip_with(
        F.filter("rows", lambda x, i: (i == 0) | (x - 1 != F.get("rows", i - 1))),
        F.filter("rows", lambda x, i: F.coalesce(x + 1 != F.get("rows", i + 1), F.lit(True))),
        lambda a, b: F.struct(a.alias("start"), b.alias("stop")),
    )
    passages = materialise(
        settled(covered).select(*place, F.inline(edges)).withColumns({"from": F.col("start") + F.col("ahead"), "to": F.col("stop") + F.col("ahead")}),
        "line-chunks-passages",
    )
    source = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_version"), _lines(F.col("text")).alias("lines"))
    wanted = passages.select("first_id", "first_version", "from", "to").distinct()
    # Merge joins: neither side has a bound, and texts are moved alike at every size.
    same_text = F.col("_id").eqNullSafe(F.col("first_id")) & (F.col("_version") == F.col("first_version"))
    held = source.join(wanted.hint("merge"), same_text).select(*wanted.columns, _chunk(F.col("lines"), F.col("from"), F.col("to")).alias("bytes"))
    kept = materialise(held.groupBy(*wanted.columns).agg(F.min("bytes").alias("bytes")), "line-chunks-bytes").withColumnsRenamed(
        {c: f"_{c}" for c in wanted.columns}
    )
    same = F.col("first_id").eqNullSafe(F.col("_first_id"))
    for c in wanted.columns[1:]:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return passages.join(kept, same).groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "stop", "bytes")).alias("marks"))


def remove_repeats(docs: DataFrame, spec: LineChunks = LineChunks()) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and the number of lines before and after.

    Adds n_lines and n_kept; a column of that name is replaced.
    """
    marks = marked(docs, spec)
    mark, lines, gone = (fresh(docs, c) for c in ("_marks", "_lines", "_gone"))
    right = marks.select(F.col("doc_id").alias(fresh(docs, "_id")), F.col("version").alias(fresh(docs, "_version")), F.col("marks").alias(mark)).hint("merge")
    same_text = docs["doc_id"].eqNullSafe(right[right.columns[0]]) & (F.xxhash64(docs["text"]) == right[right.columns[1]])
    joined = docs.join(right, same_text, "left").drop(*right.columns[:2])
    split = settled(joined.withColumn(lines, _lines(F.col("text"))))
    same = F.filter(mark, lambda m: _chunk(F.col(lines), m["start"], m["stop"]) == m["bytes"])
    found = settled(split.withColumn(gone, F.when(F.col(mark).isNotNull(), same)))
    left = F.filter(lines, lambda x, i: ~F.exists(gone, lambda m: (i + 1).between(m["start"], m["stop"])))
    rest = settled(found.withColumn(mark, F.when(F.size(gone) > 0, left)))
    return (
        rest.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)))
        .withColumn("n_kept", F.coalesce(F.size(mark), F.size(lines), F.lit(0)))
        .withColumn("text", F.when(F.col(mark).isNotNull(), F.array_join(mark, "\n")).otherwise(F.col("text")))
        .drop(mark, lines, gone)
    )


def drop_repeats(docs: DataFrame, spec: LineChunks = LineChunks()) -> DataFrame:
    """A filter with the columns of ``docs``: repeated chunks go, and documents left without a word.

    A column n_chars, where there is one, follows the text.
    """
    before, after = fresh(docs, "_n_lines"), fresh(docs, "_n_kept")
    clash = {c: fresh(docs, f"_own_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_kept")}
    own = docs.withColumnsRenamed(clash)
    out = remove_repeats(own, spec).withColumnsRenamed({"n_lines": before, "n_kept": after}).withColumnsRenamed({v: k for k, v in clash.items()})
    out = out.filter((F.col(before) == F.col(after)) | (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(before) == F.col(after), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
