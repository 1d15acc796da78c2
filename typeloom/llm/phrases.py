"""Collocations of two to four words, counted by stripes.

A stripe belongs to a word and holds everything that follows it: an associative array from continuations (the next
words, three at most, or the end of the piece) to counts. Each chunk of texts makes the stripes of its words;
merged element by element they give the counts of all phrases that begin with the word: the total of a prefix is the sum
of its continuations, ends included, the extensions are the continuations themselves, and the greatest of them says
whether a longer phrase subsumes the prefix.

A phrase is no more frequent than its words: words below the threshold end a continuation, which keeps the stripes
short without losing a phrase. To know them, chunks (bounded in bytes) first send each distinct word once and get the frequent
ones back as numbers; texts themselves don't travel. A very frequent word's stripe is dealt over as many buckets as its count asks
for. Phrases are told apart by the exact numbers of their words, not by hashes, and scores are computed in decimals.

Defined results: a null text is empty; a null language is ``und``; repeated rows count each time; ties in score and count are
ordered by the phrase's bytes. Very long texts are chunks of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .units import gathered, pack, unpack

#: Bytes between words, and those that end a piece. No phrase goes on over the latter.
BLANK, BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
#: In place of a word: the piece ends here, or an infrequent word follows.
END = -1


@dataclass(frozen=True)
class Phrases:
    least: int = 30
    #: A phrase is dropped if a longer one has so many hundredths of its occurrences.
    subsumed: int = 80
    scale: int = 2_000_000
    top: int = 2000
    chunk_bytes: int = 32 << 20
    #: Occurrences of a word for each bucket of its stripe.
    bucket: int = 1_000_000


_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANK)], _KIND[list(BREAK)] = 1, 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, A-Z in lower case, the word at each place, and how many words each piece has."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    _, offsets, data = texts.buffers()
    begin = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[begin[0] : begin[-1]]
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begin - begin[0]] = True
    inside = kind == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
    piece = np.cumsum((kind == 2) | edge[:-1], dtype=np.int64)[starts]
    cuts = np.flatnonzero(np.diff(piece, prepend=-1, append=-2)) if len(piece) else np.zeros(1, np.int64)
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(cuts)


def chunks(docs: DataFrame, spec: Phrases) -> DataFrame:
    """Chunks of one language each: a row for each distinct word (at, word, n), and one with the words' numbers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, 1, spec.chunk_bytes):
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                words, codes, sizes = words_of(batch.column(1).filter(pc.equal(langs.indices, k)))
                if not len(words):
                    continue
                count = np.bincount(codes, minlength=len(words))
                order = np.argsort(-count, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                words, count = words.take(pa.array(order)), count[order]
                for x in range(0, len(words), 100_000):
                    part = words.slice(x, 100_000)
                    yield _row_batch(number, lang, np.arange(x, x + len(part)), part, pa.array(count[x : x + len(part)]), pa.nulls(len(part), pa.binary()))
                yield _row_batch(number, lang, np.zeros(1, np.int64), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([pack(rank[codes], sizes)], pa.binary()))
                number += 1

    columns = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return columns.mapInArrow(run, "chunk long, lang string, at int, word string, n long, numbers binary")


def _row_batch(chunk: int, lang: str, at: np.ndarray, words: pa.Array, n: pa.Array, numbers: pa.Array) -> pa.RecordBatch:
    size = len(at)
    arrays = [pa.array(np.full(size, chunk)), pa.repeat(lang, size), pa.array(at, pa.int32()), words, n, numbers]
    return pa.RecordBatch.from_arrays(arrays, names=["chunk", "lang", "at", "word", "n", "numbers"])


def numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """``words`` with dense numbers ``id`` from 0, and how many there are. One row for each task is gathered."""
    words = materialise(words.withColumn("row", F.monotonically_increasing_id()), "frequent-words")
    part = F.shiftright("row", 33)
    sizes = words.groupBy(part.alias("part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    out = words.withColumn("part", part).join(F.broadcast(offsets), "part")
    ids = F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("id", ids).drop("part", "before", "row"), words.count()


def _windows(codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of up to four frequent words that begin at each place (short ones end with END), as local
    numbers plus 1 in two columns of two words, sorted, and how often each occurs."""
    seq = np.where(ids[codes] >= 0, codes + 1, 0)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    base = len(ids) + 1
    columns = [seq]
    for k in (1, 2, 3):
        nxt = np.zeros(len(seq), np.int64)
        nxt[:-k] = np.where(piece[k:] == piece[:-k], seq[k:], 0)
        columns.append(np.where(columns[-1] > 0, nxt, 0))
    full = seq > 0
    high, low = (columns[0] * base + columns[1])[full], (columns[2] * base + columns[3])[full]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.flatnonzero((np.diff(high, prepend=-1) != 0) | (np.diff(low, prepend=-1) != 0))
    count = np.diff(np.append(new, len(high)))
    return np.stack([high[new] // base, high[new] % base, low[new] // base, low[new] % base]), count


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(33)).astype(np.int64)


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def stripes(rows: DataFrame, known: DataFrame, spec: Phrases, wide: bool) -> DataFrame:
    """(w1, buckets, bucket, w2, w3, w4, n) of all chunks: the continuations of w1 in one bucket, as arrays.

    ``known``: (chunk, at, id, total) of frequent words.
    """
    kind, arrow = ("long", pa.int64()) if wide else ("int", pa.int32())
    schema = f"w1 {kind}, buckets int, bucket int, w2 array<{kind}>, w3 array<{kind}>, w4 array<{kind}>, n array<{kind}>"

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["w1", "buckets", "bucket", "w2", "w3", "w4", "n"]
        codes, sizes = unpack(left["numbers"][0].as_py()) if left.num_rows else (np.zeros(0, np.int64),) * 2
        at = right["at"].to_numpy()
        ids = np.full(int(max(codes.max(initial=0), at.max(initial=0))) + 1, END, np.int64)
        ids[at] = right["id"].to_numpy()
        buckets = np.ones(len(ids), np.int64)
        buckets[at] = right["total"].to_numpy() // spec.bucket + 1
        local, count = _windows(codes, sizes, ids)
        parts = buckets[local[0] - 1]
        words = np.where(local > 0, ids[np.maximum(local, 1) - 1], END)
        bucket = _spread(words[1] + 1, words[2] + 1) % parts
        order = np.lexsort((bucket, local[0]))  # stable: continuations stay sorted
        words, count, bucket, parts = words[:, order], count[order], bucket[order], parts[order]
        new = np.flatnonzero((np.diff(words[0], prepend=-2) != 0) | (np.diff(bucket, prepend=-1) != 0))
        cuts = np.append(new, len(count))
        arrays = [pa.array(words[0][new], arrow), pa.array(parts[new], pa.int32()), pa.array(bucket[new], pa.int32())]
        arrays += [_lists(x, cuts, arrow) for x in (*words[1:], count)]
        return pa.Table.from_arrays(arrays, names=names)

    numbers = rows.filter(F.col("numbers").isNotNull()).select("chunk", "numbers")
    return numbers.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(make, schema)


WORDS = ("w1", "w2", "w3", "w4")


def merged(striped: DataFrame, spec: Phrases) -> DataFrame:
    """(w1, w2, w3, w4, a) of all phrases of two words or more with ``least`` occurrences; END fills up short ones.

    Stripes are dealt by word and bucket once; prefixes are summed up where their stripe is. Only two-word
    prefixes of words with several buckets go on to be summed up over these.
    """
    dealt = striped.repartition("w1", "bucket")
    each = dealt.select("w1", "buckets", "bucket", F.inline(F.arrays_zip("w2", "w3", "w4", "n")))

    def level(size: int) -> DataFrame:
        keys = WORDS[:size]
        # The number of buckets is an aggregate that all levels look at, so that they read the same columns of the same exchange.
        rows = each.filter(F.col(keys[-1]) != END).groupBy("w1", "bucket", *keys[1:]).agg(F.sum("n").alias("a"), F.max("buckets").alias("parts")).filter("parts > 0")
        if size == 2:
            cross = rows.filter("parts > 1").groupBy(*keys).agg(F.sum("a").alias("a"))
            rows = rows.filter("parts = 1").select(*keys, "a").unionByName(cross)
        return rows.filter(F.col("a") >= spec.least).select(*[F.col(w).cast("long") if w in keys else F.lit(END).cast("long").alias(w) for w in WORDS], "a")

    return level(2).unionByName(level(3)).unionByName(level(4))


def _part(first: int, last: int) -> list[Column]:
    """The words from number ``first`` to ``last`` (exclusive) of a phrase, filled up with END."""
    taken = [F.col(w) for w in WORDS[first:last]]
    return [x.alias(w) for x, w in zip([*taken, *[F.lit(END).cast("long")] * (4 - len(taken))], WORDS)]


def scored(found: DataFrame, single: DataFrame, spec: Phrases) -> DataFrame:
    """``found`` without subsumed phrases, with l, r and score of the lowest cut. ``single``: (w1, ..., a) of single words."""
    size = sum((F.col(w) != END).cast("int") for w in WORDS)
    found = found.withColumn("size", size)
    parts, cover = [], []
    for n in (2, 3, 4):
        own = found.filter(F.col("size") == n)
        whole = F.struct(*WORDS).alias("whole")
        for k in range(1, n):
            parts += [own.select(whole, F.lit(2 * k + side).alias("what"), *_part(*at)) for side, at in enumerate(((0, k), (k, n)))]
        if n > 2:
            cover += [own.select(F.col("a").alias("longer"), *_part(*at)) for at in ((0, n - 1), (1, n))]
    counts = found.select(*WORDS, "a").unionByName(single.select(*WORDS, "a"))
    asked = reduce(DataFrame.unionByName, parts).join(counts, list(WORDS))
    values = [F.max(F.when(F.col("what") == 2 * k + side, F.col("a"))).alias(f"{'lr'[side]}{k}") for k in (1, 2, 3) for side in (0, 1)]
    lr = asked.groupBy("whole").agg(*values).select("whole.*", *[f"{s}{k}" for k in (1, 2, 3) for s in "lr"])
    longest = reduce(DataFrame.unionByName, cover).groupBy(*WORDS).agg(F.max("longer").alias("longer"))
    kept = found.join(longest, list(WORDS), "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * spec.subsumed))

    def at(k: int) -> Column:
        left, right = F.col(f"l{k}"), F.col(f"r{k}")
        score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(spec.scale), left.cast("decimal(20,0)") + right.cast("decimal(20,0)"))
        return F.when(left.isNotNull(), F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))

    best = F.array_min(F.array(*map(at, (1, 2, 3))))
    return kept.join(lr, list(WORDS)).select(*WORDS, "a", best.alias("best")).select(*WORDS, "a", "best.l", "best.r", "best.score")


def mined(docs: DataFrame, spec: Phrases = Phrases()) -> DataFrame:
    """The first phrases of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score."""
    rows = materialise(chunks(docs, spec), "phrase-chunks")
    words = rows.filter(F.col("word").isNotNull())
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang", "word"))
    often = materialise(words.select("chunk", "at", "lang", "word", total.alias("total")).filter(F.col("total") >= spec.least), "frequent-places")
    vocabulary, size = numbered(often.groupBy("lang", "word").agg(F.first("total").alias("total")))
    vocabulary = materialise(vocabulary, "vocabulary")
    known = often.select("chunk", "at", "lang", "word").join(vocabulary, ["lang", "word"]).select("chunk", "at", "id", "total")
    found = materialise(merged(stripes(rows, known, spec, size >= 1 << 31), spec), "phrases")
    end = F.lit(END).cast("long")
    single = vocabulary.select(F.col("id").alias("w1"), end.alias("w2"), end.alias("w3"), end.alias("w4"), F.col("total").alias("a"))
    out = scored(found, single, spec).join(vocabulary.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1")), "w1")
    # Spark keeps so many rows of a language in each task already; ties stay until their texts are known.
    close = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    out = out.withColumn("close", close).filter(F.col("close") <= spec.top)
    for k in (2, 3, 4):
        out = out.join(vocabulary.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}")), f"w{k}", "left")
    out = out.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3", "t4"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", rank).filter(F.col("rank") <= spec.top).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
