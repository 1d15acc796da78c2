"""Near copies by fast similarity sketching, banding and exact verification.

A text's set is its distinct runs of ``size`` words. Sketches follow fast similarity sketching: in
round i (i < t) each shingle throws itself into one of the t coordinates with the value i + u, u from
[0, 1); in round t + j it throws into coordinate j. A coordinate keeps its least value, and a text's
rounds end as soon as no coordinate is empty, which 2t rounds guarantee. Two texts agree in a
coordinate with the probability of their Jaccard similarity, with concentration as of independent
coordinates, while a long text costs two or three rounds only.

Texts that are equal word by word are one class from the start. Classes that agree in all coordinates
of a band meet in a bucket:

1. each class of a bucket is verified against the bucket's first class only, on full shingle sets;
2. links give components; only buckets that still hold several components are looked at further;
3. there classes of different components are compared by sketch, in blocks of bounded size and only in the
   first band that they agree in; blocks with pairs that could be similar enough get the full texts and
   yield the links that join components (no more than they have classes), which give the final components.

So a group of m copies costs about m verifications, no link between different components is lost that
banding has found, and no table of pairs within a group is written. With 40 bands of 5 coordinates a pair
of similarity 0.8 is missed with a probability of 1e-7, and the comparison of sketches (by 200
coordinates of 8 bits, down to 0.6) adds less than 1e-10.

Defined results: no text or no words: an empty set, linked with nothing. Fewer words than ``size``: the
whole sequence is the one shingle. Rows that share a doc_id are one document each, with its id; a null
doc_id is below all others. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import fresh, mix, plain_words, shingle_hashes, slices, word_hashes
from .components import components

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class MinHash:
    size: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    least_agree: float = 0.6  # share of equal sketch bytes below which a pair can't be similar
    block: int = 256  # classes of a bucket on either side of one comparison

    @property
    def width(self) -> int:
        return self.bands * self.rows


def sketches(hashes: np.ndarray, begin: np.ndarray, t: int) -> np.ndarray:
    """The sketch (t unsigned integers) of each set; set k has hashes[begin[k]:begin[k + 1]].

    An empty set's sketch is all ones. Values: the round in the upper 16 bits, random bits below.
    """
    sets = len(begin) - 1
    out = np.full(sets * t, ~np.uint64(0), np.uint64)
    counts = np.diff(begin)
    open_sets = np.flatnonzero(counts)
    round_ = 0
    rows, owner = hashes, np.repeat(np.arange(sets), counts)
    while len(open_sets) and round_ < 2 * t:
        x = mix(rows ^ np.uint64((round_ + 1) * int(_STEP) & (1 << 64) - 1))
        low = (x >> np.uint64(17)) | (np.uint64(round_) << np.uint64(48))
        if round_ < t:
            place = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32)
            at = owner * t + place.astype(np.int64)
        else:
            at = owner * t + (round_ - t)
        # The least value of each coordinate that an earlier round has left empty.
        np.minimum.at(out, at, low)
        round_ += 1
        missing = (out.reshape(sets, t)[open_sets] == ~np.uint64(0)).any(axis=1)
        if not missing.all():
            open_sets = open_sets[missing]
            keep = np.zeros(sets, bool)
            keep[open_sets] = True
            stay = keep[owner]
            rows, owner = rows[stay], owner[stay]
    return out.reshape(sets, t)


def _distinct(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets' distinct hashes, and where each set begins."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else hashes[:0]), np.concatenate(([0], np.cumsum(sizes)))


def sketched(docs: DataFrame, spec: MinHash) -> DataFrame:
    """id, the class of equal word sequences, the size of the set, band hashes and sketch bytes."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([t or "" for t in texts]):
                raw = [plain_words(t) for t in texts[a:b]]
                values, begin = _distinct(*shingle_hashes(*word_hashes(raw), spec.size))
                sketch = sketches(values, begin, spec.width)
                band = np.zeros((len(raw), spec.bands), np.uint64)
                for k in range(spec.rows):
                    band = mix(band * _STEP + sketch[:, k :: spec.rows])
                band = mix(band + np.arange(1, spec.bands + 1, dtype=np.uint64) * _STEP)
                sizes = np.diff(begin)
                # A byte of each coordinate, then four of each band's hash.
                small = np.hstack((mix(sketch).astype(np.uint8), band.astype("<u4").view(np.uint8)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array([x if n else None for x, n in zip(band.view(np.int64), sizes)], pa.list_(pa.int64())),
                        pa.array([x.tobytes() if n else None for x, n in zip(small, sizes)], pa.binary()),
                    ],
                    names=["id", "class", "n", "bands", "sketch"],
                )

    return docs.select("id", "text").mapInArrow(run, "id long, class binary, n long, bands array<long>, sketch binary")


def _similar(a: set, b: set, percent: int) -> bool:
    shared = len(a & b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def shingle_set(text: str | None, size: int) -> set:
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def verified(pairs: DataFrame, texts: DataFrame, spec: MinHash) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; ``texts`` has id and text."""

    def run(batches):
        last, last_set = None, None
        for batch in batches:
            links = []
            a, b, left, right = (batch.column(k) for k in range(4))
            for i in range(len(a)):
                if last_set is None or b[i].as_py() != last:
                    last, last_set = b[i].as_py(), shingle_set(right[i].as_py(), spec.size)
                if _similar(shingle_set(left[i].as_py(), spec.size), last_set, spec.percent):
                    links.append(i)
            yield batch.select([0, 1]).take(pa.array(links, pa.int64()))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b"
    )
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _agree(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return (a == b).mean(axis=1) >= least


def _bytes(column, spec: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """A byte of each coordinate, and four of each band's hash."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, spec.width + 4 * spec.bands)
    return rows[:, : spec.width], np.ascontiguousarray(rows[:, spec.width :]).view("<u4")


def likely(pairs: DataFrame, sets: DataFrame, spec: MinHash) -> DataFrame:
    """The pairs (a, b) that their sizes and sketches do not rule out."""

    def run(batches):
        for batch in batches:
            left, right = (_bytes(batch.column(k), spec)[0] for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(_agree(left, right, spec.least_agree)))

    side = [sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    both = pairs.join(side[0], "a").join(side[1], "b")
    sized = both.filter(F.lit(100) * F.least("n_a", "n_b") >= F.lit(spec.percent) * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long").distinct()


PLACE = "bucket long, band int, i int, j int, id long, component long, leader long, part int, n long, sketch binary"
_NUMBERS = ("bucket", "band", "i", "j", "id", "component", "leader", "part", "n")


class _Group:
    """The classes of one bucket that one block pair (i, j) compares."""

    def __init__(self, table: pa.Table, spec: MinHash):
        self.table, self.spec = table, spec
        for c in _NUMBERS:
            setattr(self, c, table.column(c).to_numpy())
        self.sketch, self.met = _bytes(table.column("sketch"), spec)

    def pairs(self):
        """(x, ys): rows that may be similar, of different components, and meet in no earlier band."""
        i, j, band, leader = (int(getattr(self, c)[0]) for c in ("i", "j", "band", "leader"))
        right = np.flatnonzero(self.part == j)
        for x in np.flatnonzero(self.part == i):
            ok = self.component[right] != self.component[x]
            if i == j:
                ok &= right > x
            # Pairs with the leader have been verified.
            ok &= (self.id[right] != leader) & (self.id[x] != leader)
            ok &= 100 * np.minimum(self.n[right], self.n[x]) >= self.spec.percent * np.maximum(self.n[right], self.n[x])
            near = right[ok]
            if len(near):
                ok = _agree(self.sketch[near], self.sketch[x], self.spec.least_agree)
                ok &= ~(self.met[near, :band] == self.met[x, :band]).any(axis=1)
                if ok.any():
                    yield x, near[ok]


def _groups(batches, spec: MinHash):
    """The groups of rows that come sorted by (bucket, i, j); None after each batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        new = np.zeros(max(len(table) - 1, 0), bool)
        for c in ("bucket", "i", "j"):
            new |= np.diff(table.column(c).to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                yield _Group(table.slice(a, b - a), spec)
        rest = table.slice(cuts[-1])
        yield None
    if rest is not None and len(rest) > 1:
        yield _Group(rest, spec)


def _far_members(spec: MinHash):
    """The rows of groups that have a pair to verify."""

    def run(batches):
        kept: list[pa.Table] = []
        for group in _groups(batches, spec):
            if group is None:
                for t in kept:
                    yield from t.to_batches()
                kept = []
                continue
            use = np.zeros(len(group.id), bool)
            for x, ys in group.pairs():
                use[x] = use[ys] = True
            if use.any():
                kept.append(group.table.filter(pa.array(use)))
        for t in kept:
            yield from t.to_batches()

    return run


def _far_links(spec: MinHash):
    """Links between different components within a group, on full sets: as many as join what can be joined."""

    def linked(group: _Group) -> set:
        texts = group.table.column("text").to_pylist()
        sets: dict[int, np.ndarray] = {}

        def hashed(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = np.unique(shingle_hashes(*word_hashes([plain_words(texts[x])]), spec.size)[0])
            return sets[x]

        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        links = set()
        for x, ys in group.pairs():
            for y in ys.tolist():
                cx, cy = find(int(group.component[x])), find(int(group.component[y]))
                if cx == cy:
                    continue
                a, b = hashed(x), hashed(y)
                shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if 100 * shared >= spec.percent * (len(a) + len(b) - shared) and _similar(
                    shingle_set(texts[x], spec.size), shingle_set(texts[y], spec.size), spec.percent
                ):
                    root[cx] = cy
                    links.add((int(group.id[x]), int(group.id[y])))
        return links

    def run(batches):
        links: set = set()
        for group in _groups(batches, spec):
            if group is None:
                yield _pairs(links)
                links = set()
            else:
                links |= linked(group)
        yield _pairs(links)

    return run


def _pairs(links: set) -> pa.RecordBatch:
    rows = np.array(sorted(links), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])


def near_copies(docs: DataFrame, spec: MinHash = MinHash()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) for every row of ``docs``.

    doc_id is a whole number of at most 64 bits.
    """
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    texts = docs.select(own_id.alias("id"), "text")
    sk = materialise(sketched(texts, spec), "minhash")
    classes = materialise(sk.groupBy("class").agg(F.min("id").alias("least")), "minhash-classes")
    firsts = classes.select("class", F.col("least").alias("id"))
    sets = sk.filter("n > 0").join(firsts, ["class", "id"])
    band = sets.select(F.posexplode("bands").alias("band", "bucket"), "id")
    shared = materialise(
        band.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("members")).filter("leader < last").drop("last"),
        "minhash-buckets",
    )
    inside = materialise(band.join(shared, "bucket").distinct(), "minhash-members")
    slim = materialise(sets.select("id", "n", "sketch").join(inside.select("id").distinct(), "id", "left_semi"), "minhash-sketches")

    stars = materialise(likely(inside.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), slim, spec), "minhash-stars")
    links = materialise(verified(stars, texts, spec), "minhash-links")
    found = materialise(components(links), "minhash-components")

    placed = inside.filter("members > 2").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = materialise(placed, "minhash-placed")
    mixed = materialise(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket"), "minhash-mixed")
    blocks = F.ceil(F.col("members") / spec.block).cast("int")
    dealt = (
        placed.join(mixed, "bucket")
        .join(slim, "id")
        .withColumn("part", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", "band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "component", "leader", "part", "n", "sketch")
    )
    group = ["bucket", "i", "j"]
    far = materialise(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_far_members(spec), PLACE), "minhash-far")
    far = far.join(texts, "id").select(*[c.split()[0] for c in PLACE.split(", ")], "text")
    more = materialise(far.repartition(*group).sortWithinPartitions(*group).mapInArrow(_far_links(spec), "a long, b long").distinct(), "minhash-more")
    final = materialise(components(links.unionByName(more)), "minhash-final") if not more.isEmpty() else found

    named = materialise(
        classes.join(final, F.col("least") == F.col("id"), "left").select("class", F.coalesce("component", "least").alias("component")), "minhash-named"
    )
    out = sk.select("class", "id", "n").join(named, "class")
    nothing = F.col("n") == 0
    component = F.when(nothing, F.col("id")).otherwise(F.col("component"))
    real = lambda c: F.when(c != -(2**63), c)
    return out.select(
        real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"), (F.col("id") == component).alias("kept")
    )


def keep_firsts(docs: DataFrame, spec: MinHash = MinHash()) -> DataFrame:
    """A filter with the columns of ``docs``: of each group of near copies the least doc_id stays.

    Of several rows of that doc_id all stay.
    """
    name = fresh(docs, "_kept_id")
    gone = near_copies(docs, spec).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
