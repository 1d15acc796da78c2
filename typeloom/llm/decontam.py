"""Finds passages of benchmark items in texts by SimHash over item-sized windows.

Words are runs of anything but white space and ASCII punctuation, A-Z in lower case. For an item of n
words, each window of n words of a text is a candidate (the whole text, where it is shorter). Windows
and items have 64-bit SimHash fingerprints over their shingles of ``size`` words, weighted: a shingle that
many items of the whole benchmark have weighs less. Fingerprints are cut into 8 blocks; one that is within ``radius`` bits of an
item's must be within ``radius // 8`` bits in one block at least, which a table of each block answers, so
that no fingerprint within the radius is missed. Candidates are verified by the exact weighted Jaccard
similarity of their shingles as multisets.

Windows whose shingles cannot reach the threshold with any item of their size (the weight of the shingles
they share with all of them together is too low) are left out before that; this loses nothing. A text
needs one pass over its words, and the windows around benchmark shingles only are fingerprinted.

Items reach the workers in blocks of bounded size (``block_bytes``); there are as many passes over the texts
as blocks, and no join or shuffle of texts.

Defined results: null or empty texts and items match nothing; an item with fewer words than ``size`` has
its whole sequence as its one shingle, and so have windows of it; of an item's windows in a text the most
similar one is given, the first of equals; repeated rows are reported each.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import fresh, held, shingle_hashes, slices, word_hashes

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TO_SPACE = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
TABLE = bytes(_TO_SPACE[_KEEP[c]] for c in range(256))
BITS = np.arange(64, dtype=np.uint64)


@dataclass(frozen=True)
class Decontamination:
    size: int = 5
    threshold: float = 0.8
    radius: int = 23
    block_bytes: int = 4 << 20


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(TABLE).split())


def _shingles(words: list[bytes], size: int) -> Counter:
    if len(words) < size:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(size))))


class Matcher:
    """The items of one block, ready to be looked for.

    ``shared``: of the block's shingles that several items of the whole benchmark have, how many do; ``steps``: the
    items of the whole benchmark. Without them the block is all.
    """

    def __init__(self, items: list[tuple], spec: Decontamination, shared: dict[bytes, int] | None = None, steps: int | None = None):
        self.spec = spec
        rows = sorted({(i, plain(t)) for i, t in items if plain(t)}, key=lambda r: (str(r[0]), r[1]))
        self.ids = [i for i, _ in rows]
        self.words = [w.split() for _, w in rows]
        self.sets = [_shingles(w, spec.size) for w in self.words]
        seen = Counter(s for c in self.sets for s in c)
        if shared is not None:
            seen = {s: shared.get(b" ".join(s), 1) for s in seen}
        steps = len(rows) if steps is None else steps
        # By shingle: 1, and one more for each halving of the items that have it.
        self.weight = {s: (steps // n).bit_length() for s, n in seen.items()}
        self.full = steps.bit_length()
        self.sizes: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            self.sizes.setdefault(len(w), []).append(k)
        # Hashed shingles of each length of runs that items need.
        self.runs: dict[int, dict] = {}
        for run in sorted({min(spec.size, n) for n in self.sizes}):
            own = [k for k, w in enumerate(self.words) if min(spec.size, len(w)) == run]
            hashes, begin = shingle_hashes(*word_hashes([b" ".join(self.words[k]) for k in own]), run)
            flat = [s for k in own for s in zip(*(self.words[k][j:] for j in range(run)))]
            weights = np.array([self.weight[s] for s in flat], np.int64)
            keys, at = np.unique(hashes, return_index=True)
            bitmap = np.zeros(1 << 22, bool)
            bitmap[(keys >> np.uint64(42)).astype(np.int64)] = True
            classes = {}
            for n in sorted({len(self.words[k]) for k in own}):
                members = [j for j, k in enumerate(own) if len(self.words[k]) == n]
                span = [slice(begin[j], begin[j + 1]) for j in members]
                prints = np.array([self._fingerprints(hashes[s], weights[s], 0, [0], [s.stop - s.start])[0] for s in span], np.uint64)
                classes[n] = {
                    "items": [own[j] for j in members],
                    "keys": np.unique(np.concatenate([hashes[s] for s in span])),
                    "least": min(int(weights[s].sum()) for s in span),
                    "prints": prints,
                    "blocks": self._blocks(prints),
                }
            self.runs[run] = {"keys": keys, "weights": weights[at], "bitmap": bitmap, "classes": classes}

    def _blocks(self, prints: np.ndarray) -> np.ndarray:
        """By block and its 8 bits: which items' blocks are within radius // 8 bits."""
        byte = prints[None, :].view(np.uint8).reshape(len(prints), 8).T  # little-endian machines
        return np.array([np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ b[None, :]) <= self.spec.radius // 8 for b in byte])

    @staticmethod
    def _fingerprints(hashes: np.ndarray, weights: np.ndarray, at: int, starts, stops) -> np.ndarray:
        """SimHash of the shingles [start, stop) for each window; ``at`` is the place of hashes[0]."""
        signs = np.where((hashes[:, None] >> BITS) & np.uint64(1), weights[:, None], -weights[:, None])
        total = np.zeros((len(hashes) + 1, 64), np.int64)
        np.cumsum(signs, axis=0, out=total[1:])
        over = total[np.asarray(stops) - at] - total[np.asarray(starts) - at] > 0
        return (over.astype(np.uint64) << BITS).sum(axis=1, dtype=np.uint64)

    def _similarity(self, k: int, window: Counter) -> float:
        item, weigh = self.sets[k], self.weight
        shared = sum(min(v, item[s]) * weigh[s] for s, v in window.items() if s in item)
        total = sum(v * weigh[s] for s, v in item.items()) + sum(v * weigh.get(s, self.full) for s, v in window.items()) - shared
        return shared / total

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text: (item id, first word, words, similarity) of the items found in it."""
        raw = [plain(t) for t in texts]
        best: list[dict] = [{} for _ in texts]
        words, first = word_hashes(raw)
        for run, known in self.runs.items():
            hashes, begin = shingle_hashes(words, first, run)
            maybe = np.flatnonzero(known["bitmap"][(hashes >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known["keys"], hashes[maybe]), len(known["keys"]) - 1)
            maybe = maybe[known["keys"][at] == hashes[maybe]]
            for doc in np.unique(np.searchsorted(begin, maybe, side="right") - 1).tolist():
                self._in_text(known, run, hashes[begin[doc] : begin[doc + 1]], raw[doc], best[doc])
        return [[(self.ids[k], start, n, sim) for k, (sim, start, n) in sorted(b.items())] for b in best]

    def _in_text(self, known: dict, run: int, hashes: np.ndarray, raw: bytes, best: dict) -> None:
        at = np.minimum(np.searchsorted(known["keys"], hashes), len(known["keys"]) - 1)
        in_items = known["keys"][at] == hashes
        weights = np.where(in_items, known["weights"][at], self.full)
        words: list[bytes] | None = None
        for n, group in known["classes"].items():
            place = np.minimum(np.searchsorted(group["keys"], hashes), len(group["keys"]) - 1)
            shared = np.concatenate(([0], np.cumsum(np.where(group["keys"][place] == hashes, weights, 0))))
            width = min(n - run + 1, len(hashes))
            starts = np.flatnonzero(shared[width:] - shared[:-width] >= self.spec.threshold * group["least"])
            if not len(starts):
                continue
            words = raw.split() if words is None else words
            # Windows that lie together are fingerprinted together.
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
                low, high = int(part[0]), int(part[-1]) + width
                for some in np.split(part, range(4096, len(part), 4096)):
                    prints = self._fingerprints(hashes[low:high], weights[low:high], low, some, some + width)
                    near = group["blocks"][0][prints & np.uint64(255)]
                    for b in range(1, 8):
                        near = near | group["blocks"][b][(prints >> np.uint64(8 * b)) & np.uint64(255)]
                    row, item = np.nonzero(near)
                    ok = np.bitwise_count(prints[row] ^ group["prints"][item]) <= self.spec.radius
                    for r, i in zip(some[row[ok]].tolist(), item[ok].tolist()):
                        k = group["items"][i]
                        window = words[r : r + n]
                        sim = self._similarity(k, _shingles(window, self.spec.size))
                        if sim >= self.spec.threshold and (k not in best or sim > best[k][0]):
                            best[k] = (sim, r, len(window))


def _shingle_rows(size: int):
    def rows(batches):
        for batch in batches:
            found = [[b" ".join(x) for x in _shingles(t.encode().split(), size)] for t in batch.column(1).to_pylist()]
            block = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array([x for f in found for x in f], pa.binary())], names=["block", "shingle"])

    return rows


def matchers(benchmark: DataFrame, spec: Decontamination = Decontamination()) -> list:
    """The items (item_id, text) as broadcast blocks, none much above ``block_bytes``.

    Weights follow from the whole benchmark, so that similarities don't depend on the blocks.
    """

    @F.arrow_udf("string")
    def plainly(texts: pa.Array) -> pa.Array:
        return pa.array([plain(t).decode() for t in texts.to_pylist()], pa.string())

    items = benchmark.select("item_id", plainly("text").alias("text")).filter("text <> ''").distinct()
    items = materialise(items, "decontam-items")
    total = items.agg(F.sum(F.octet_length("text") + 16).alias("size"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(total["size"] or 0) // spec.block_bytes))
    context = benchmark.sparkSession.sparkContext
    if blocks == 1:
        return [context.broadcast(([tuple(r) for r in items.collect()], spec))]
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    rows = items.select("block", "text").mapInArrow(_shingle_rows(spec.size), "block long, shingle binary")
    by_block = rows.groupBy("shingle", "block").agg(F.count("*").alias("n"))
    counts = by_block.groupBy("shingle").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks")).filter("n > 1")
    counts = materialise(counts.select("shingle", "n", F.explode("blocks").alias("block")), "decontam-shingles")

    def block(k: int):
        shared = {bytes(r["shingle"]): r["n"] for r in counts.filter(F.col("block") == k).collect()}
        return [tuple(r) for r in items.filter(F.col("block") == k).select("item_id", "text").collect()], spec, shared, total["n"]

    return [context.broadcast(block(k)) for k in range(blocks)]


def _matcher(shared) -> Matcher:
    value = shared.value
    ready = held(("decontam",), dict)
    if id(value) not in ready:
        if len(ready) > 3:
            ready.clear()
        ready[id(value)] = (value, Matcher(*value))
    return ready[id(value)][1]


def _found(shared, texts: pa.Array) -> list[list[tuple]]:
    values = texts.to_pylist()
    return [x for a, b in slices([v or "" for v in values]) for x in _matcher(shared).find(values[a:b])]


def leaks(docs: DataFrame, benchmark: DataFrame, spec: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity of every item found in a document."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    number = kind in ("bigint", "int", "smallint", "tinyint")
    row = f"item_id: {'long' if number else 'string'}, start_word: long, n_words: long, similarity: double"

    def parts(shared):
        @F.arrow_udf(f"array<struct<{row}>>")
        def found(texts: pa.Array) -> pa.Array:
            names = ["item_id", "start_word", "n_words", "similarity"]
            kinds = [pa.int64() if number else pa.string(), pa.int64(), pa.int64(), pa.float64()]
            rows = [[dict(zip(names, m if number else (None if m[0] is None else str(m[0]), *m[1:]))) for m in x] for x in _found(shared, texts)]
            return pa.array(rows, pa.list_(pa.struct(list(zip(names, kinds)))))

        return found.asNondeterministic()(F.col("text"))

    outs = [docs.select("doc_id", parts(shared).alias("found")).filter(F.size("found") > 0).select("doc_id", F.inline("found")) for shared in matchers(benchmark, spec)]
    out = outs[0]
    for other in outs[1:]:
        out = out.unionByName(other)
    return out


def contaminated(shared, text: Column) -> Column:
    @F.arrow_udf("boolean")
    def has(texts: pa.Array) -> pa.Array:
        return pa.array([bool(x) for x in _found(shared, texts)], pa.bool_())

    return has.asNondeterministic()(text)


def keep_clean(docs: DataFrame, benchmark: DataFrame, spec: Decontamination = Decontamination()) -> DataFrame:
    """A filter with the columns of ``docs``: documents that hold an item go."""
    name = fresh(docs, "_leak")
    for shared in matchers(benchmark, spec):
        docs = docs.withColumn(name, contaminated(shared, F.col("text"))).filter(~F.col(name)).drop(name)
    return docs
