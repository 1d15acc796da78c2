"""Alignment of two tokenizers' tokens of the same texts, by merge-path partitioning.

Both tokenizations cut a text's bytes. Merging their sorted token ends yields one overlap of an A and a B token
for each distinct end; where both end, a group of tokens that cover the same bytes is complete. The merge
of one batch is a path through the grid of A and B ends: diagonals cut it into pieces of equal work, whatever
the lengths of the texts, and a binary search on each finds the A and B ends where its piece begins. Pieces
are merged independently; an end that both sides share but a cut parts belongs to the piece of its A end,
and groups that go over a cut are put together from the shared ends of all pieces.

A batch's texts consist of units (words with the space before them) that both tokenizers encode one by one: each
distinct unit is encoded and aligned once in a batch, and texts take their tokens from it.

What a text's links are worth follows from the counts of id pairs over the whole corpus, in two passes. Chunks of
texts (bounded in bytes) are aligned and send each of their distinct pairs once; the counts come back to
the chunk, and its texts are summed up from them. Neither texts nor tokens travel, only a chunk's unit
numbers; no list of all pairs is held anywhere, and what is broadcast has one row for each B id at most.

Defined results: a null or empty text has no tokens, nor has one whose tokens in either vocabulary are not its
bytes (for instance a text that holds the sign that pieces write for a space); such texts count nowhere. Rows with equal
ids and equal texts each count. A very long text is a chunk of its own. Other columns are not touched; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import held
from .units import Library, cut, expand, flattened, gathered, level_characters, pack, unpack

#: How piece vocabularies write a space.
PIECE_SPACE = "▁"


@dataclass(frozen=True)
class Pair:
    """Tokenizer A (a JSON file of byte-level BPE) and B (a model of pieces with byte fallback), on every machine."""

    bytes_json: str
    pieces_model: str
    chunk_bytes: int = 12 << 20
    #: Steps of a piece of the merge path.
    piece: int = 1 << 16


def _byte_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all tokens, and the decimal digits of their numbers, at the left of five bytes or more."""
    wide = max(5, len(str(len(tokens))))
    digits = np.frombuffer(b"".join(str(i).encode().ljust(wide + 1, b"\0") for i in range(len(tokens))), np.uint8)
    return np.fromiter(map(len, tokens), np.int64, len(tokens)), digits.reshape(-1, wide + 1)


def level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the
    others, in order, for the characters from 256 on."""
    return {chr(c): b for b, c in enumerate(level_characters().tolist())}


class Tokenizers:
    def __init__(self, spec: Pair):
        import sentencepiece

        self.a = Library(spec.bytes_json, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=spec.pieces_model)
        table = level_bytes()
        self.a_bytes = [b""] * len(self.a.spaced)
        for token, i in self.a.vocabulary.items():
            self.a_bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.a_digits = _byte_table(self.a_bytes)
        self.b_size, self.b_digits = _byte_table(self.b_bytes)

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes((int(self.b.id_to_piece(i)[3:-1], 16),))
        return self.b.id_to_piece(i).replace(PIECE_SPACE, " ").encode()

    def encode(self, units: list[str]) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """Ids of both kinds of units that begin with a space, and which units both give back byte by byte."""
        a = self.a.units(units)
        b = [np.array(ids, "<u4").tobytes() for ids in self.b.encode([u[1:] for u in units], num_threads=1)]
        good = np.fromiter((self._same(self.a_bytes, x, u) and self._same(self.b_bytes, y, u) for u, x, y in zip(units, a, b)), bool, len(units))
        return a, b, good

    @staticmethod
    def _same(table: list[bytes], packed: bytes, unit: str) -> bool:
        return b"".join(map(table.__getitem__, memoryview(packed).cast("I"))) == unit.encode()


def tokenizers(spec: Pair) -> Tokenizers:
    return held(("alignment", spec), lambda: Tokenizers(spec))


def cuts(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d ends of the merged ends are A's, for each diagonal d (of equal ends, A's come first)."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        # A's end number mid is one of the first d exactly if it is not beyond B's end number d - mid - 1.
        within = open_.copy()
        within[open_] = a[mid[open_]] <= b[diagonals[open_] - mid[open_] - 1]
        low, high = np.where(within, mid + 1, low), np.where(open_ & ~within, mid, high)
    return low


def piece_overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A's and B's tokens of the overlaps that end within a piece, and whether both tokens end there."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    over_a = j0 + np.searchsorted(own_b, own_a)  # the B token over the last byte of an A token
    over_b = i0 + np.searchsorted(own_a, own_b)
    both = b[np.minimum(over_a, len(b) - 1)] == own_a
    alone = a[np.minimum(over_b, len(a) - 1)] != own_b
    if j0 < j1 and i0 and a[i0 - 1] == own_b[0]:
        alone[0] = False  # the cut parts a shared end: the piece before has it
    return (
        np.concatenate((np.arange(i0, i1), over_b[alone])),
        np.concatenate((over_a, np.arange(j0, j1)[alone])),
        np.concatenate((both, np.zeros(int(alone.sum()), bool))),
    )


def overlaps(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of tokens with the given ends (both sorted, with the same last one): A's and B's token of
    each, and the last A and B token of each group."""
    steps = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    i = cuts(a, b, steps)
    j = steps - i
    found = [piece_overlaps(a, b, *at) for at in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist())]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    of_a, of_b, both = (np.concatenate(x) for x in zip(*found))
    return of_a, of_b, of_a[both], of_b[both]


@dataclass
class Aligned:
    """Alignment of distinct units: tokens and groups of each, its links, and how its groups are written."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    link_unit: np.ndarray  # ascending
    link_key: np.ndarray  # A id * number of B ids + B id
    written: list[bytes]


def align(codec: Tokenizers, units: list[str], piece: int) -> Aligned:
    packed_a, packed_b, good = codec.encode(units)
    ids_a, begin_a = flattened([x if g else b"" for x, g in zip(packed_a, good)])
    ids_b, begin_b = flattened([x if g else b"" for x, g in zip(packed_b, good)])
    of_a, of_b, last_a, last_b = overlaps(np.cumsum(codec.a_size[ids_a]), np.cumsum(codec.b_size[ids_b]), piece)
    n_a, n_b = np.diff(begin_a), np.diff(begin_b)
    unit_of_a = np.repeat(np.arange(len(units)), n_a)
    n_groups = np.bincount(unit_of_a[last_a], minlength=len(units))
    link_unit = unit_of_a[of_a]
    order = np.argsort(link_unit, kind="stable")
    keys = ids_a[of_a].astype(np.int64) * len(codec.b_bytes) + ids_b[of_b]
    return Aligned(good, n_a, n_b, n_groups, link_unit[order], keys[order], _written(codec, ids_a, ids_b, last_a, last_b, np.cumsum(n_groups)))


def _written(codec: Tokenizers, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, groups: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each unit; ``groups``: how many groups there are up to each unit's end."""
    wide = max(codec.a_digits.shape[1], codec.b_digits.shape[1])
    rows = np.zeros((len(ids_a) + len(ids_b), wide), np.uint8)
    # In a group A's tokens come first, then B's.
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    before_a = np.concatenate(([0], np.cumsum(size_a)))
    before_b = np.concatenate(([0], np.cumsum(size_b)))
    at_a = np.arange(len(ids_a)) + np.repeat(before_b[:-1], size_a)
    at_b = np.arange(len(ids_b)) + np.repeat(before_a[1:], size_b)
    for at, ids, digits, last, end in ((at_a, ids_a, codec.a_digits, last_a, b"|"), (at_b, ids_b, codec.b_digits, last_b, b";")):
        own = digits[ids]
        sign = np.full(len(ids), ord(","), np.uint8)
        sign[last] = ord(end)
        own[np.arange(len(ids)), (own != 0).sum(axis=1)] = sign
        rows[at, : own.shape[1]] = own
    kept = rows != 0
    text = rows[kept].tobytes()
    chars = np.concatenate(([0], np.cumsum(kept.sum(axis=1))))
    tokens = np.concatenate(([0], before_a[1:] + before_b[1:]))  # tokens up to each group's end
    ends = chars[tokens[groups]].tolist() if len(groups) else []
    return [text[x : max(x, y - 1)] for x, y in zip([0, *ends[:-1]], ends)]  # without the last sign


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the slices that begin where ``begin`` says."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[begin[1:]] - total[begin[:-1]]


#: Rows of the first pass: texts of a chunk, its distinct pairs, and the numbers its texts are summed up from.
TEXT, PAIR, NUMBERS = 0, 1, 2


def _rows(spec: Pair, chunk: int, ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, pa.Array]]:
    codec = tokenizers(spec)
    units = cut(texts, " ")
    full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    known = align(codec, units.texts, spec.piece)
    use = full & (_sums(~known.good[units.codes], units.begin) == 0)
    shown = np.repeat(use, np.diff(units.begin))
    codes = units.codes[shown]
    begin = np.concatenate(([0], np.cumsum(np.where(use, np.diff(units.begin), 0))))
    n_links = np.bincount(known.link_unit, minlength=len(units.texts))
    names = map(known.written.__getitem__, codes.tolist())
    digests = [sha256(b";".join([next(names) for _ in range(n)])).hexdigest() if n else "" for n in np.diff(begin).tolist()]
    sums = {c: _sums(x[codes], begin) for c, x in (("n_a", known.n_a), ("n_b", known.n_b), ("n_groups", known.n_groups), ("n_links", n_links))}
    yield {"kind": np.full(len(ids), TEXT), "at": np.arange(len(ids)), "doc_id": ids, **sums, "groups_sha256": pa.array(digests, pa.string())}
    # Units that no text uses as a whole (their text has another bad one) leave the chunk here.
    times = np.bincount(codes, minlength=len(units.texts))
    used = np.flatnonzero(times)
    used = used[np.argsort(-times[used], kind="stable")]
    number = np.zeros(len(units.texts), np.int64)
    number[used] = np.arange(len(used))
    link_begin = np.concatenate(([0], np.cumsum(n_links)))
    keys, _ = expand(known.link_key, link_begin, used)
    pairs, which = np.unique(keys, return_inverse=True)
    count = np.bincount(which, np.repeat(times[used], n_links[used]), len(pairs)).astype(np.int64)
    yield {"kind": np.full(len(pairs), PAIR), "at": np.arange(len(pairs)), "pair": pairs, "n": count}
    yield {"kind": np.array([NUMBERS]), "at": np.zeros(1, np.int64), "numbers": pa.array([pack(number[codes], np.diff(begin), n_links[used], which)], pa.binary())}


def first_pass(docs: DataFrame, spec: Pair) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = {"chunk": "long", "kind": "int", "at": "int", "doc_id": kind, "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pair": "long", "n": "long", "numbers": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId() << 32, None
        for k, batch in enumerate(gathered(batches, 1, spec.chunk_bytes)):
            if schema is None:
                plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
                schema = pa.schema([(c, batch.schema.field(0).type if c == "doc_id" else plain[t]) for c, t in columns.items()])
            for rows in _rows(spec, part + k, batch.column(0), batch.column(1)):
                size = len(rows["kind"])
                rows["chunk"] = np.full(size, part + k)
                full = pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if f.name not in rows else pa.array(rows[f.name], f.type) if isinstance(rows[f.name], np.ndarray) else rows[f.name] for f in schema], schema=schema)
                yield from (full.slice(x, 100_000) for x in range(0, size, 100_000))

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in columns.items()))


def counted(rows: DataFrame, n_b: int) -> DataFrame:
    """(chunk, at, count, best) of the chunks' pairs: the corpus-wide count, and whether no A id has more with that B id."""
    pairs = rows.filter(F.col("kind") == PAIR).select("chunk", "at", "pair", "n")
    pairs = materialise(pairs.select("chunk", "at", "pair", F.sum("n").over(Window.partitionBy("pair")).alias("count")), "pair-counts")
    b = (F.col("pair") % n_b).cast("int")
    # One row for each B id: no more than the vocabulary has.
    most = pairs.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return pairs.withColumn("b", b).join(F.broadcast(most), "b").select("chunk", "at", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, spec: Pair) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of ``docs`` (doc_id, text).

    n_best: links whose pair is the most frequent of its B id (or as frequent as that); count_sum: the counts of all links' pairs.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=spec.pieces_model).get_piece_size()
    rows = materialise(first_pass(docs, spec), "aligned-chunks")
    texts = rows.filter(F.col("kind") != PAIR).drop("pair", "n")
    lookups = counted(rows, n_b)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join(f"{c} {kind if c == 'doc_id' else 'string' if c == 'groups_sha256' else 'long'}" for c in names)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.filter(pc.equal(left["kind"], TEXT)).sort_by("at")
        codes, sizes, n_links, which = unpack(left.filter(pc.equal(left["kind"], NUMBERS))["numbers"][0].as_py())
        begin, link_begin = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(n_links)))
        at = right["at"].to_numpy()
        for name, values in (("n_best", right["best"].to_numpy().astype(np.int64)), ("count_sum", right["count"].to_numpy())):
            of_pair = np.zeros(len(at), np.int64)
            of_pair[at] = values
            of_unit = _sums(of_pair[which], link_begin)
            own = own.append_column(name, pa.array(_sums(of_unit[codes], begin), pa.int64()))
        return own.select(names)

    return texts.groupBy("chunk").cogroup(lookups.groupBy("chunk")).applyInArrow(finish, schema)
