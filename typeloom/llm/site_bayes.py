"""Quality of documents by hierarchical empirical Bayes over hosts and paths.

A naive Bayes classifier over hashed words and a few shapes (shares of symbols, capitals, repeated words), fitted
and calibrated on a bounded sample of labelled documents (``max_labelled``), gives each document's evidence: a
log odds ratio against the overall share. All documents then vote for their path and host with the share
that their evidence makes of them. A host's posterior shrinks to the overall share, a path's to its host's,
by strengths that the spread between hosts (between paths) tells. A document's posterior is its own
evidence on top of what the other documents of its path say.

The texts are read without a shuffle: labels of the sample are broadcast (bounded by ``max_labelled``), weights
too (bounded by ``buckets``). Sites are counted map-side, so that one that holds a third of all documents is a
few rows; their posteriors are joined back through a written table.

Defined results: a text without words has no evidence and gets its path's posterior; null hosts and paths
are sites like others; a document with several labels counts as the worst of them; without labels all
evidence is 0 and the share is a half. Repeated rows vote each.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import slices, word_hashes
from .decontam import plain

HEADS = ("low", "toxic")
SYMBOLS, CAPITALS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEPS = (0.002, 0.01, 0.03, 0.1, 0.2, 0.4, 0.8)


@dataclass(frozen=True)
class SiteBayes:
    max_labelled: int = 20_000
    bits: int = 18
    least_docs: int = 5
    least_gain: float = 25.0  # a feature counts where twice its log likelihood ratio is larger
    smooth: float = 2.0
    weakest: float = 1.0  # bounds of the strength of a prior, in documents
    strongest: float = 10_000.0

    @property
    def buckets(self) -> int:
        return 1 << self.bits


@dataclass
class Evidence:
    """Weights by bucket and head, the overall shares, and the calibration (slope, shift) of each head."""

    weights: np.ndarray
    share: list[float]
    lines: list[tuple[float, float]]


def _shapes(text: str, words: int) -> list[int]:
    """Numbers from 1 of the shapes that a text has."""
    raw = text.encode()
    n = max(len(raw), 1)
    parts = [(n - len(raw.translate(None, SYMBOLS))) / n, (n - len(raw.translate(None, CAPITALS))) / n, raw.count(b"!") / n]
    seen = raw.split()
    parts += [1 - len(set(seen)) / max(len(seen), 1)]
    return [1 + 8 * k + sum(p > s for s in STEPS) for k, p in enumerate(parts)] + [40 + min(words.bit_length(), 20)]


def buckets_of(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the different features of each text that has words."""
    raw = [plain(t) for t in texts]
    hashes, first = word_hashes(raw)
    counts = np.diff(first)
    shapes = [(k, s) for k, n in enumerate(counts.tolist()) if n for s in _shapes(texts[k], n)]
    owner = np.concatenate((np.repeat(np.arange(len(texts)), counts), np.array([k for k, _ in shapes], np.int64)))
    bucket = np.concatenate(((hashes >> np.uint64(64 - bits)).astype(np.int64) | 64, np.array([s for _, s in shapes], np.int64)))
    pairs = np.unique(owner << bits | bucket)
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _counts(bits: int):
    """By bucket: labelled texts that have it and how many of them are positive, for each head."""

    def run(batches):
        for batch in batches:
            texts, *labels = (batch.column(k).to_pylist() for k in range(3))
            total = np.zeros((1 << bits, 4))
            for a, b in slices([t or "" for t in texts]):
                owner, bucket = buckets_of(texts[a:b], bits)
                for h, label in enumerate(labels):
                    known = np.array([x is not None for x in label[a:b]])[owner]
                    value = np.array([bool(x) for x in label[a:b]])[owner]
                    total[:, 2 * h] += np.bincount(bucket[known], minlength=1 << bits)
                    total[:, 2 * h + 1] += np.bincount(bucket[known & value], minlength=1 << bits)
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k].astype(np.int64)) for k in range(4))], names=["bucket", *_COUNTS])

    return run


_COUNTS = ("n_low", "k_low", "n_toxic", "k_toxic")


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _line(scores: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression, held near 1 and 0 by a weak prior; Newton's method with
    steps that are halved until they help."""
    x = np.column_stack((scores, np.ones(len(scores))))
    prior = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - positive * z).sum() + 0.05 * ((w - prior) ** 2).sum())

    w = prior
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - positive) + 0.1 * (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-7:
            break
        w = w - size * step
    return max(float(w[0]), 0.0), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, spec: SiteBayes = SiteBayes()) -> Evidence:
    """Evidence from ``labels`` (doc_id, quality: 1 good or 0, toxic: 1 or 0) of ``docs`` (doc_id, text)."""
    n = labels.agg(F.count("*").alias("n")).first()["n"]
    cut = min(1.0, spec.max_labelled / max(n, 1))
    spot = F.pmod(F.xxhash64("doc_id", F.lit("labels")), F.lit(1 << 30))
    known = labels.filter(spot < int(cut * (1 << 30))).groupBy("doc_id").agg((F.min("quality") == 0).alias("low"), (F.max("toxic") == 1).alias("toxic"))
    # About max_labelled rows of three small values at most.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    train = sample.filter("NOT held").select("text", *HEADS)
    counted = train.mapInArrow(_counts(spec.bits), "bucket long, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    seen = sample.groupBy("held").agg(*(x for h in HEADS for x in (F.count(h).alias(f"n_{h}"), F.count_if(h).alias(f"k_{h}")))).collect()
    weights, share = np.zeros((spec.buckets, 2), np.float32), []
    total = {c: sum(r[c] for r in seen if not r["held"]) for c in _COUNTS}
    rows = np.array([list(r) for r in counted.toLocalIterator()], np.float64).reshape(-1, 5)  # at most ``buckets`` rows
    for h, head in enumerate(HEADS):
        n_all, k_all = total[f"n_{head}"], total[f"k_{head}"]
        p = (k_all + 0.5) / (n_all + 1)
        share.append(p)
        with_n, with_k = rows[:, 1 + 2 * h], rows[:, 2 + 2 * h]
        odds = np.log((with_k + spec.smooth * p) / (with_n - with_k + spec.smooth * (1 - p))) - _logit(p)
        q = np.clip(with_k / np.maximum(with_n, 1), 1e-9, 1 - 1e-9)
        gain = 2 * (with_k * np.log(q / p) + (with_n - with_k) * np.log((1 - q) / (1 - p)))
        # Only what raises suspicion counts: what lowers it grows with a text's length.
        use = (with_n >= spec.least_docs) & (gain >= spec.least_gain) & (odds > 0)
        weights[rows[use, 0].astype(np.int64), h] = odds[use]
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    held = sample.filter("held").select(*HEADS, _raw(shared, spec.bits)(F.col("text")).alias("s")).select(*HEADS, "s.*").collect()
    lines = []
    for h, head in enumerate(HEADS):
        own = [(r[f"s{h}"], r[head]) for r in held if r[head] is not None and r["n"]]
        lines.append(_line(np.array([s for s, _ in own]) + _logit(share[h]), np.array([float(y) for _, y in own])) if own else (1.0, 0.0))
    return Evidence(weights, share, lines)


def _raw(shared, bits: int):
    @F.arrow_udf("struct<s0: double, s1: double, n: long>")
    def score(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        out = np.zeros((len(values), 3))
        for a, b in slices([v or "" for v in values]):
            owner, bucket = buckets_of(values[a:b], bits)
            for h in range(2):
                out[a:b, h] = np.bincount(owner, shared.value[bucket, h], b - a)
            out[a:b, 2] = np.bincount(owner, minlength=b - a)
        return pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2].astype(np.int64))], ["s0", "s1", "n"])

    return score.asNondeterministic()


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, n: str, k: str, mean: Column, spec: SiteBayes) -> float:
    """Documents that the prior of a level is worth, from the spread of its groups' shares about ``mean``."""
    spread = F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - mean, 2))
    r = groups.agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(F.pow(F.col(n), 2)).alias("n2"), spread.alias("s"), F.avg(mean * (1 - mean)).alias("v")).first()
    if not r["g"] or r["g"] < 2 or not r["v"]:
        return spec.strongest
    usual = (r["n"] - r["n2"] / r["n"]) / (r["g"] - 1)  # documents of a usual group
    share = (r["s"] / (r["v"] * (r["g"] - 1)) - 1) / max(usual - 1, 1e-9)  # of the variance between groups
    return float(np.clip(1 / share - 1 if share > 0 else spec.strongest, spec.weakest, spec.strongest))


def judged(docs: DataFrame, evidence: Evidence, host: Column, path: Column, spec: SiteBayes = SiteBayes(), heads: Iterable[str] = HEADS) -> DataFrame:
    """doc_id, and for each head its posterior p_<head>, its host's and its path's share."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence.weights)
    scored = docs.select("doc_id", host.alias("host"), path.alias("path"), _raw(shared, spec.bits)(F.col("text")).alias("s"))
    columns = []
    for h, head in enumerate(HEADS):
        slope, shift = evidence.lines[h]
        prior = _logit(evidence.share[h])
        columns.append(F.when(F.col("s.n") > 0, slope * (F.col(f"s.s{h}") + prior) + shift - prior).otherwise(0.0).alias(f"e_{head}"))
    scored = materialise(scored.select("doc_id", "host", "path", *columns), "site-evidence")
    scored = scored.select("*", *(_sigmoid(F.col(f"e_{x}") + _logit(evidence.share[h])).alias(f"v_{x}") for h, x in enumerate(HEADS)))
    sums = [F.sum(f"v_{x}").alias(f"k_{x}") for x in HEADS]
    paths = materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), *(F.sum(f"k_{x}").alias(f"host_k_{x}") for x in HEADS))
    overall = paths.agg(F.sum("n").alias("n"), *(F.sum(f"k_{x}").alias(x) for x in HEADS)).first()
    if not overall["n"]:
        overall = {"n": 1, **{x: 0.5 for x in HEADS}}
    shares = {x: min(max(overall[x] / overall["n"], 1e-6), 1 - 1e-6) for x in HEADS}
    host_prior = {x: _strength(hosts, "n_host", f"host_k_{x}", F.lit(shares[x]), spec) for x in HEADS}
    hosts = hosts.withColumns({f"host_{x}": (F.col(f"host_k_{x}") + host_prior[x] * shares[x]) / (F.col("n_host") + host_prior[x]) for x in HEADS})
    both = materialise(paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h"), "site-shares")
    path_prior = {x: _strength(both, "n", f"k_{x}", F.col(f"host_{x}"), spec) for x in HEADS}
    right = both.withColumnsRenamed({"host": "h", "path": "p"})
    joined = scored.join(right, scored["host"].eqNullSafe(right["h"]) & scored["path"].eqNullSafe(right["p"]))
    out = [F.col("doc_id")]
    for x in HEADS:
        share = (F.col(f"k_{x}") + path_prior[x] * F.col(f"host_{x}")) / (F.col("n") + path_prior[x])
        others = (F.col(f"k_{x}") - F.col(f"v_{x}") + path_prior[x] * F.col(f"host_{x}")) / (F.col("n") - 1 + path_prior[x])
        others = F.greatest(F.least(others, F.lit(1 - 1e-6)), F.lit(1e-6))
        out += [_sigmoid(F.col(f"e_{x}") + F.log(others / (1 - others))).alias(f"p_{x}"), F.col(f"host_{x}"), share.alias(f"path_{x}")]
    return joined.select(*out)
