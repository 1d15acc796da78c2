"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

#: Rows of one Arrow batch; texts are long, so that a batch stays at a few megabytes.
BATCH_ROWS = "512"
WHITE = r"[\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """The library's session settings, with small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]+``, as an array; null becomes no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """One large object for each Python worker: what another operator's tasks left there is dropped."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(texts: list, chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Bounds that cut a list of texts into runs of about ``chars`` characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit integers (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Random odd base and one random value for each byte: the hash of a word is a polynomial in the base.
_RNG = np.random.Generator(np.random.PCG64(20_240_607))
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = _RNG.integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)
_POW = np.ones(1, np.uint64)
_POW_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _POW_INV
    if len(_POW) < n:
        n = 1 << (n - 1).bit_length()
        steps = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
        for s in steps:
            s[0] = 1
        _POW, _POW_INV = np.cumprod(steps[0]), np.cumprod(steps[1])
    return _POW, _POW_INV


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and where each text's words begin (n + 1 entries).

    ``raw`` holds texts of words parted by single spaces, without spaces at either end.
    """
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    text_end = np.cumsum(sizes)
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    ends = np.flatnonzero(buf == 32)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    full = ends > starts  # the single "word" of an empty text has no byte
    ends, starts = ends[full], starts[full]
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    first = np.searchsorted(ends, np.concatenate(([0], text_end)), side="left")
    return hashes, first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, and where each text's runs begin.

    A text with fewer words has its whole sequence as its one run; a text without words has none.
    """
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(runs)))
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], runs)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    last = np.repeat(first[1:], runs)
    out = np.zeros(begin[-1], np.uint64)
    for k in range(size):
        part = padded[at + k]
        if k:
            part = np.where(at + k < last, part, np.uint64(0))
        out = out * np.uint64(0x9E3779B97F4A7C15) + part
    return mix(out ^ np.uint64(size)), begin


def plain_words(text: str | None) -> bytes:
    """UTF-8 of the words of a text, A-Z in lower case, parted by single spaces.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: the letters A-Z, and space and \\x09-\\x0D.
    """
    return b" ".join((text or "").encode().lower().split())
