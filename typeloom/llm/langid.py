"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model of the letters of its words (with marks for their
begin and end). The models are kept as sorted arrays of n-gram hashes with a row of log probabilities,
one column for each language. A text gets the language whose model needs the fewest nats a letter;
a text that even its best model finds far odder than calibration texts is rejected.

The models are fitted on a bounded sample of different labelled texts (``per_lang``, drawn by a hash of the text
so that it doesn't depend on how the table is partitioned, nor on copies). Of the others, only the hashes
are counted; all else runs once over every text, without a shuffle.

Defined results: no text, or no letter (``\\p{L}``) in it: ``und``, score 0, rejected. Ties go to the
language first in code-point order. Without labelled texts, every text is ``und``. Repeated rows are
judged alike; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held, mix, slices

#: Letters, and the few characters that Python counts as alphanumeric besides (dropped again below).
LETTERS = re.compile(r"[^\W\d_]+")
BEGIN, END = "\x02", "\x03"
RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


@dataclass(frozen=True)
class LanguageId:
    """Of each language, ``per_lang`` different labelled texts are drawn; a tenth of them calibrates."""

    order: int = 4
    per_lang: int = 3000
    odd: float = 1.5  # a text is rejected beyond this many times what 99.9 % of calibration texts show
    model_bytes: int = 128 << 20
    few: int = 50  # languages with fewer texts in the sample are fitted on all of them


@dataclass
class Model:
    langs: list[str]
    order: int
    grams: list[np.ndarray] = field(default_factory=list)  # by length: sorted hashes
    logp: list[np.ndarray] = field(default_factory=list)  # rows of grams, columns of langs
    contexts: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)  # log weight of the next shorter model
    floor: float = 0.0
    centre: list[float] = field(default_factory=list)
    odd: float = float("inf")
    sharp: float = 1.0

    def size(self) -> int:
        return sum(a.nbytes for part in (self.grams, self.logp, self.contexts, self.back) for a in part)


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def _hash(codes: list[np.ndarray], rows: int | None = None) -> np.ndarray:
    """Hashes of n-grams whose k-th characters are ``codes[k]``."""
    h = np.full(len(codes[0]) if rows is None else rows, len(codes), np.uint64)
    for c in codes:
        h = h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
    return mix(h)


def _hash_grams(grams: list[str]) -> np.ndarray:
    n = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(len(grams), n)
    return _hash([codes[:, k] for k in range(n)], len(grams))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def kneser_ney(counts: dict[str, dict[str, int]], order: int) -> Model:
    """Models from the counts of n-grams of length ``order`` (the letters of a word after ``order - 1``
    begin marks, then an end mark), by language.

    Each n-gram that any language has gets its whole interpolated probability in all of them.
    """
    langs = sorted(counts)
    model = Model(langs, order)
    if not langs:
        return model
    model.floor = float(np.log(1 / (1 + len({g[-1] for c in counts.values() for g in c}))))
    # The occurrences of the longest n-grams; of shorter ones, how many different letters stand before them.
    levels = [[counts[x] for x in langs]]
    for _ in range(order - 1):
        levels.append([Counter(g[1:] for g in longer) for longer in levels[-1]])
    lower: list[dict[str, float]] = [{"": np.exp(model.floor)} for _ in langs]
    for n, level in enumerate(reversed(levels), 1):
        grams = sorted(set().union(*level))
        contexts = sorted({g[:-1] for g in grams})
        logp, back = np.zeros((len(grams), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
        for k, own in enumerate(level):
            once, twice = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total, kinds = Counter(), Counter()
            for g, v in own.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            weight = {h: discount * kinds[h] / t for h, t in total.items()}
            here = {
                g: (max(own.get(g, 0) - discount, 0) / total[g[:-1]] if g in own else 0) + weight.get(g[:-1], 1.0) * lower[k][g[1:]]
                for g in grams
            }
            logp[:, k] = np.log([here[g] for g in grams])
            back[:, k] = np.log([weight.get(h, 1.0) for h in contexts])
            lower[k] = here
        for keys, rows, to_keys, to_rows in (
            (_hash_grams(grams), logp, model.grams, model.logp),
            (_hash_grams(contexts), back, model.contexts, model.back),
        ):
            at = np.argsort(keys)
            to_keys.append(keys[at])
            to_rows.append(rows[at])
    return model


class Scorer:
    """Log probabilities of texts; those of words seen before are remembered, in bounded memory."""

    KEEP = 200_000

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)), np.float32)
        self.sizes = np.zeros(1024, np.int64)

    def _learn(self, new: list[str]) -> None:
        at = len(self.known)
        while len(self.rows) < at + len(new):
            self.rows, self.sizes = np.vstack((self.rows, np.zeros_like(self.rows))), np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        pure = [letters_of(w) for w in new]
        for a, b in slices(pure):
            self.rows[at + a : at + b], self.sizes[at + a : at + b] = self.word_scores(pure[a:b])
        self.known.update(zip(new, range(at, at + len(new))))

    def word_scores(self, pure: list[str]) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        n = m.order
        sizes = np.array([len(w) + 1 if w else 0 for w in pure], np.int64)
        codes = np.frombuffer("".join(BEGIN * (n - 1) + w + END for w in pure if w).encode("utf-32-le"), np.uint32)
        out = np.zeros((len(pure), len(m.langs)), np.float32)
        if not len(codes):
            return out, sizes
        at = np.flatnonzero(codes != ord(BEGIN))
        score = np.zeros((len(at), len(m.langs)), np.float32)
        todo = np.arange(len(at))
        for k in range(n, 0, -1):
            window = [codes[at[todo] - j] for j in range(k - 1, -1, -1)]
            row, found = _find(m.grams[k - 1], _hash(window))
            score[todo[found]] += m.logp[k - 1][row[found]]
            todo, window = todo[~found], [c[~found] for c in window]
            row, found = _find(m.contexts[k - 1], _hash(window[:-1], len(todo)))
            score[todo[found]] += m.back[k - 1][row[found]]
        score[todo] += m.floor
        full = np.flatnonzero(sizes)
        out[full] = np.add.reduceat(score, np.cumsum(sizes[full]) - sizes[full], axis=0)
        return out, sizes

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the log probability in each language and the letters it is of."""
        found = [words_of(t) for t in texts]
        if len(self.known) > self.KEEP:
            self._reset()
        new = {w for w in set(chain.from_iterable(found)) if w not in self.known}
        if new:
            self._learn(sorted(new))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, counts.sum())
        text = np.repeat(np.arange(len(texts)), counts)
        sizes = np.bincount(text, self.sizes[ids], len(texts))
        scores = [np.bincount(text, self.rows[ids, k], len(texts)) for k in range(len(self.model.langs))]
        return np.array(scores).reshape(-1, len(texts)).T, sizes


def judge(model: Model, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best language (-1: none), its share, its cross-entropy, and whether that is odd."""
    entropy = -scores / np.maximum(sizes, 1)[:, None]
    if not model.langs:
        return np.full(len(sizes), -1), np.zeros(len(sizes)), np.full(len(sizes), np.nan), np.ones(len(sizes), bool)
    best = np.argmin(entropy, axis=1)
    least = entropy.min(axis=1)
    share = 1 / np.exp((least[:, None] - entropy) * model.sharp).sum(axis=1)
    centre = np.array(model.centre or [np.inf] * len(model.langs))[best]
    odd = (least - centre) * np.sqrt(np.minimum(sizes, 400)) > model.odd
    none = sizes == 0
    return np.where(none, -1, best), np.where(none, 0, share), np.where(none, np.nan, least), none | odd


def calibrate(model: Model, truth: list[str], scores: np.ndarray, sizes: np.ndarray, odd: float) -> None:
    """Sets from labelled texts, that the models didn't see, what is usual."""
    k = np.array([model.langs.index(t) for t in truth], np.int64)
    use = sizes > 0
    if not use.any():
        return
    entropy, k, sizes = (-scores / np.maximum(sizes, 1)[:, None])[use], k[use], sizes[use]
    own = entropy[np.arange(len(k)), k]
    mean = float(np.average(own, weights=sizes))
    model.centre = [float(np.average(own[k == j], weights=sizes[k == j])) if (k == j).any() else mean for j in range(len(model.langs))]
    far = (own - np.array(model.centre)[k]) * np.sqrt(np.minimum(sizes, 400))
    model.odd = odd * max(float(np.quantile(far, 0.999)), 1.0)

    def loss(sharp: float) -> float:
        return float(np.log(np.exp((own[:, None] - entropy) * sharp).sum(axis=1)).mean())

    model.sharp = min((float(2**j) for j in range(9)), key=loss)


def _gram_counts(order: int):
    def count(batches):
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[lang].update(words_of(text))
            rows = Counter()
            for lang, words in seen.items():
                for word, v in words.items():
                    if w := letters_of(word):
                        w = BEGIN * (order - 1) + w + END
                        for i in range(len(w) - order + 1):
                            rows[lang, w[i : i + order]] += v
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a for a, _ in rows], pa.string()),
                    pa.array([b for _, b in rows], pa.string()),
                    pa.array(list(rows.values()), pa.int64()),
                ],
                names=["lang", "gram", "n"],
            )

    return count


def fit(labelled: DataFrame, spec: LanguageId = LanguageId(), text: str = "text", lang: str = "lang") -> Model:
    """Models of the languages of ``labelled`` (rows without text or language aside).

    Texts that calibrate are not fitted on, but for languages with fewer than ``few`` texts in the sample: these
    are fitted on all of them, and calibrated by a trial model that saw half of them.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("key", F.xxhash64("text"))
    # Copies count once, as they are drawn once.
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", "key").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], spec.order)
    share = F.create_map(*chain.from_iterable((F.lit(x), F.lit(min(1.0, spec.per_lang / n))) for x, n in sizes.items()))
    sample = rows.filter(F.pmod(F.shiftrightunsigned("key", 32), F.lit(1 << 24)) < share[F.col("lang")] * (1 << 24)).dropDuplicates(["lang", "key"])
    rare = sorted(x for x, n in sizes.items() if min(n, spec.per_lang) < spec.few)
    is_rare = F.col("lang").isin(rare)
    held = F.pmod("key", F.when(is_rare, F.lit(2)).otherwise(F.lit(10))) == 0

    def counted(texts: DataFrame) -> dict[str, dict[str, int]]:
        grams = texts.select("lang", "text").mapInArrow(_gram_counts(spec.order), "lang string, gram string, n long")
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        for r in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["lang"]][r["gram"]] = r["n"]
        return counts

    counts = counted(sample.filter(~held | is_rare))
    model = kneser_ney(counts, spec.order)
    if model.size() > spec.model_bytes:
        raise ValueError(f"the models take {model.size()} bytes; lower per_lang or order")
    trial = model
    if rare:
        trial = kneser_ney({x: c for x, c in counts.items() if x not in rare} | counted(sample.filter(~held & is_rare)), spec.order)
    shared = labelled.sparkSession.sparkContext.broadcast(trial)
    known = sample.filter(held & F.col("lang").isin(trial.langs))
    seen = known.select("lang", _scores(shared)("text").alias("s")).select("lang", "s.*").collect()
    if seen:
        calibrate(trial, [r["lang"] for r in seen], np.array([r["scores"] for r in seen]), np.array([r["n"] for r in seen]), spec.odd)
    if trial is not model and trial.centre:
        centre = dict(zip(trial.langs, trial.centre))
        model.centre = [centre.get(x, float(np.mean(trial.centre))) for x in model.langs]
        model.odd, model.sharp = trial.odd, trial.sharp
    return model


def _scorer(shared) -> Scorer:
    model = shared.value
    return held(("langid", id(model)), lambda: (model, Scorer(model)))[1]


def _scored(shared, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = texts.to_pylist()
    score = _scorer(shared)
    parts = [score(values[a:b]) for a, b in slices([v or "" for v in values])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _scores(shared):
    @F.arrow_udf("struct<scores: array<double>, n: double>")
    def scores(texts: pa.Array) -> pa.Array:
        rows, sizes = _scored(shared, texts)
        return pa.StructArray.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), pa.array(sizes, pa.float64())], ["scores", "n"])

    return scores


def predicted(model: Model, frame: DataFrame, text: str | Column = "text") -> Column:
    """A struct column: lang_pred, score, cross_entropy, rejected."""
    shared = frame.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{RESULT.replace(' ', ': ').replace(',:', ',')}>")
    def predict(texts: pa.Array) -> pa.Array:
        best, share, least, rejected = judge(shared.value, *_scored(shared, texts))
        names = [*shared.value.langs, "und"]
        return pa.StructArray.from_arrays(
            [
                pa.array([names[k] for k in best], pa.string()),
                pa.array(share, pa.float64()),
                pa.array(least, pa.float64(), from_pandas=True),
                pa.array(rejected, pa.bool_()),
            ],
            ["lang_pred", "score", "cross_entropy", "rejected"],
        )

    # Told to be non-deterministic, so that a filter on the result doesn't run it again.
    return predict.asNondeterministic()(text)


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language is recognised, with their own columns."""
    name = fresh(docs, "_lang")
    return docs.withColumn(name, predicted(model, docs, F.col(text))).filter(~F.col(name)["rejected"]).drop(name)
