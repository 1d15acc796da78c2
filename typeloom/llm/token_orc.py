"""Token ids of documents in ORC files, in the order of doc_id.

Texts are range-partitioned by doc_id and sorted, encoded in that order by the tokenizers library, and written
with an end id after each document: ids as runs of integers (ORC's run-length encoding), row indexes
every ``stride`` rows, and Bloom filters on doc_id, so that readers of some documents skip files,
stripes and row groups by their statistics; stripes are read in parallel.

Byte-level BPE encodes units of text (``units.cut``) independently, so that each distinct one of a batch is looked up
once, and given to the library if it was not met of late (without the mark at its end, where the tokenizer has GPT-2's
pattern). Texts with an added token of the file go to the library whole.

Defined results: a null text is an empty one and gives the end id alone; rows that share a doc_id stand next to
each other, by text, and their starts follow that order, as rows are numbered when they are written; a null doc_id stands
first. Very long texts are batches of their own. Other columns are not written; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import held
from .units import LETTERS, Library, Numbered, cut, expand, gathered


#: Signs that GPT-2's pattern parts from a letter before them, where a unit ends with one.
MARKS = ".,;:!?)\"'"
MARKED = re.compile(f"(?s).*[{LETTERS}][{re.escape(MARKS)}]").fullmatch


@dataclass(frozen=True)
class TokenFiles:
    tokenizer: str  # path of the library's JSON file, on every machine
    end_id: int = 0
    stride: int = 1000
    stripe_bytes: int = 64 << 20
    fpp: float = 0.01
    compression: str = "snappy"
    #: Texts that are cut into words and encoded together.
    batch_bytes: int = 6 << 20

    def options(self) -> dict[str, str]:
        return {
            "compression": self.compression,
            "orc.create.index": "true",
            "orc.row.index.stride": str(self.stride),
            "orc.stripe.size": str(self.stripe_bytes),
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": str(self.fpp),
        }


class Encoder:
    KEEP_WORDS = 530_000

    def __init__(self, path: str):
        self.library = Library(path)
        self.known = Numbered(self.KEEP_WORDS, self.library.encoded)

    def numbers(self, units: list[str]) -> np.ndarray:
        """The number of each unit. Where one ends with a letter and a mark, its ids are those of its word and of the mark."""
        if not self.library.parts:
            return self.known.all(units)
        found = self.known.find(units)
        lacking = np.flatnonzero(found < 0)
        asked = [units[k] for k in lacking.tolist()]
        marked = np.array([m is not None and not b for m, b in zip(map(MARKED, asked), self.library.barred(asked))], bool)
        found[lacking[~marked]] = self.known.made(list(compress(asked, (~marked).tolist())))
        ended = list(compress(asked, marked.tolist()))
        words = [u[:-1] for u in ended]
        distinct = list(dict.fromkeys([*words, *MARKS]))
        number = dict(zip(distinct, self.known.all(distinct).tolist()))
        both = np.array([[number[w] for w in words], [number[u[-1]] for u in ended]], np.int64).T.ravel()
        ids, at = expand(self.known.ids, self.known.begin, both)
        found[lacking[marked]] = self.known.add(ended, ids, np.diff(at[::2]))
        return found

    def encode(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, ``end`` after each, and where each text's begin."""
        units, known = cut(texts, whole=self.library.added, lines=self.library.parts), self.known
        numbers = self.numbers(units.texts)[units.codes]
        flat = np.concatenate((known.ids, np.array(end, "<u4")))
        codes = np.insert(numbers, units.begin[1:], len(known.begin) - 1)
        ids, at = expand(flat, np.append(known.begin, len(flat)), codes)
        known.end_batch()
        return ids, at[units.begin + np.arange(len(units.begin))]


def encoder(path: str) -> Encoder:
    return held(("token_orc", path), lambda: Encoder(path))


def write(docs: DataFrame, path: str, spec: TokenFiles) -> None:
    """Writes (doc_id, ids, at) of ``docs`` (doc_id, text); ``at`` numbers the rows of a file."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec, at = encoder(spec.tokenizer), 0
        for batch in gathered(batches, 1, spec.batch_bytes):
            ids, begin = codec.encode(batch.column(1), [spec.end_id])
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.view("<i4")))
            rows = pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.arange(at, at + len(lists)))], names=["doc_id", "ids", "at"])
            at += len(lists)
            yield rows

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, f"doc_id {kind}, ids array<int>, at long").write.options(**spec.options()).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """(doc_id, ids), of some documents only where they are named: filters reach the files' indexes."""
    rows = spark.read.orc(path).select("doc_id", "ids")
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of all documents of a folder.

    Running sums are taken file by file; the files' own sums (one row each) put them together.
    """

    @F.arrow_udf("long")
    def checksum(ids: pa.Array) -> pa.Array:
        flat, ends = ids.flatten().to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        return pa.array([crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.int64())

    rows = spark.read.orc(path).select("doc_id", "at", F.size("ids").cast("long").alias("n_tokens"), checksum("ids").alias("ids_crc32"), F.col("_metadata.file_path").alias("file"))
    rows = materialise(rows, "token-digests")
    files = rows.groupBy("file").agg(F.min(F.struct(F.col("doc_id"))).alias("first"), F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = files.select("file", before.alias("offset"))
    within = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return summed.join(offsets, "file").select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
