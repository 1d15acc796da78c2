"""Quality rules: text statistics, and a decision list over them learned from labels.

Statistics are array and string expressions of one row each. Rules that tell low quality are learned by
sequential covering: a rule grows on two thirds of the labelled rows that no earlier rule covers, by the
threshold condition with the best information gain; its last conditions are pruned as long as that doesn't
lower its worth on the other third; it is taken if it is precise enough there. The list is a chain of
``when`` expressions.

DataFrame expressions only. Labelled rows are binned once and written (a few small integers each); every step
aggregates them map-side to counts by condition and bin, which alone the driver sees.

Defined results: a null text has no words and all statistics 0; labels of unknown documents and null labels
are not used; without labels the list is empty and keeps all. Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, settled
from .common import fresh, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Covering:
    window: int = 5
    bins: int = 32
    max_rules: int = 12
    max_terms: int = 3
    precise: float = 0.97  # share of low quality that a rule needs on the rows it wasn't grown on
    least: int = 5  # rows of low quality that it has to find there


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        return (features()[self.feature] > self.limit) if self.above else (features()[self.feature] <= self.limit)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Term, ...]


def _count(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def statistics(docs: DataFrame, spec: Covering = Covering()) -> DataFrame:
    """``docs`` with STATS; columns of these names are replaced. The column text must be there."""
    w, h, lines, grams = (fresh(docs, c) for c in ("_w", "_h", "_lines", "_grams"))
    text = F.coalesce(F.col("text"), F.lit(""))
    k = spec.window
    split = settled(docs.withColumns({w: words(F.col("text")), lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))}))
    hashed = settled(
        split.withColumns(
            {
                "n_words": F.size(w).cast("long"),
                "word_chars": F.length(F.array_join(w, "")).cast("long"),
                "n_symbols": _count(text, r"[^#*$%&|<>]+"),
                "n_capitals": _count(text, "[^A-Z]+"),
                "n_lines": F.size(lines).cast("long"),
                "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
                h: F.transform(w, lambda x: F.xxhash64(x)),
            }
        ).drop(w, lines)
    )
    window = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(F.col(h), i + j) for j in range(1, k))))
    windows = settled(hashed.withColumn(grams, window).drop(h))
    # Most texts repeat no window; only the others sort theirs.
    order = F.when(
        F.size(F.array_distinct(grams)) < F.size(grams),
        F.sort_array(F.transform(grams, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    )
    ordered = settled(windows.withColumn(grams, order))
    size = F.size(grams)
    same = F.zip_with(F.slice(grams, 1, size - 1), F.slice(grams, 2, size - 1), lambda a, b: a["x"] == b["x"])
    no = F.array(F.lit(False))
    often = F.zip_with(F.zip_with(F.concat(no, same), F.concat(same, no), lambda a, b: a | b), grams, lambda f, g: F.when(f, g["i"]))
    places = settled(ordered.withColumn(grams, F.when(F.col(grams).isNotNull(), F.sort_array(F.filter(often, lambda i: i.isNotNull())))))
    spread = F.zip_with(grams, F.concat(F.slice(grams, 2, F.size(grams) - 1), F.array(F.lit(2**31 - 1))), lambda a, b: F.least(b - a, F.lit(k)))
    covered = F.aggregate(spread, F.lit(0).cast("long"), lambda s, x: s + x)
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(grams)


def features() -> dict[str, Column]:
    n, c, lines = (F.greatest(F.col(x), F.lit(1)) for x in ("n_words", "word_chars", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols": F.col("n_symbols") / c,
        "capitals": F.col("n_capitals") / c,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / n,
    }


def holds(rule: Rule) -> Column:
    out = rule[0].column()
    for term in rule[1:]:
        out = out & term.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that tells low quality (from 1), or 0."""
    if not rules:
        return F.lit(0)
    chain = F.when(holds(rules[0]), 1)
    for k, rule in enumerate(rules[1:], 2):
        chain = chain.when(holds(rule), k)
    return chain.otherwise(0)


def learn(labelled: DataFrame, spec: Covering = Covering()) -> list[Rule]:
    """Rules from STATS and ``low`` (boolean: of low quality) of labelled rows."""
    names = list(features())
    shares = [j / spec.bins for j in range(1, spec.bins)]
    values = labelled.filter("low IS NOT NULL").select("low", F.pmod(F.xxhash64(*STATS), F.lit(3)).alias("fold"), *(c.alias(x) for x, c in features().items()))
    values = materialise(values, "rules-values")
    found = values.agg(*(F.percentile_approx(x, shares, 10_000).alias(x) for x in names)).first()
    limits = {x: sorted(set(found[x] or [])) for x in names}
    if not any(limits.values()):
        return []

    # The bin of a value is the number of limits that it is above.
    def bin_of(x: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, limits[x])), lambda t: F.col(x) > t)) if limits[x] else F.lit(0)

    bins = [bin_of(x).alias(x) for x in names]
    rows = materialise(values.select("low", (F.col("fold") == 0).alias("prune"), *bins), "rules-bins")

    def kept(terms: list) -> Column:
        out = F.lit(True)
        for x, above, k in terms:
            out = out & ((F.col(x) > k) if above else (F.col(x) <= k))
        return out

    def counts(frame: DataFrame) -> tuple[int, int]:
        r = frame.agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n")).first()
        return r["p"], r["n"]

    def grow(frame: DataFrame) -> list:
        terms: list = []
        p0, n0 = counts(frame)
        while len(terms) < spec.max_terms and p0 and n0:
            cells = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.col(x).alias("bin")) for x in names)))
            table = frame.filter(kept(terms)).select("low", cells.alias("c")).groupBy("c.x", "c.bin").agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n")).collect()
            best = (0.0, None, 0, 0)
            for x in names:
                p = n = 0
                for r in sorted((r for r in table if r["x"] == x), key=lambda r: r["bin"]):
                    p, n = p + r["p"], n + r["n"]
                    for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                        gain = a * (log2(a / (a + b)) - log2(p0 / (p0 + n0))) if a else 0
                        if gain > best[0] + 1e-9 and r["bin"] < len(limits[x]):
                            best = (gain, (x, above, r["bin"]), a, b)
            if best[1] is None:
                break
            terms.append(best[1])
            p0, n0 = best[2], best[3]
        return terms

    rules: list[Rule] = []
    left = rows
    while len(rules) < spec.max_rules:
        terms = grow(left.filter("NOT prune"))
        if not terms:
            break
        # How each shorter form of the rule does on the rows that it wasn't grown on.
        tries = [terms[: k + 1] for k in range(len(terms))]
        held = left.filter("prune").agg(
            *(F.count_if(F.col("low") & kept(t)).alias(f"p{k}") for k, t in enumerate(tries)), *(F.count_if(~F.col("low") & kept(t)).alias(f"n{k}") for k, t in enumerate(tries))
        ).first()
        worth = [((held[f"p{k}"] - held[f"n{k}"]) / max(held[f"p{k}"] + held[f"n{k}"], 1), -k) for k in range(len(tries))]
        k = -max(worth)[1]
        p, n = held[f"p{k}"], held[f"n{k}"]
        if p < spec.least or p < spec.precise * (p + n):
            break
        # Between the values on either side of a limit, so that what lies closer to one side goes with it.
        edges = values.agg(
            *(F.max(F.when(F.col(x) <= limits[x][b], F.col(x))).alias(f"low{j}") for j, (x, _, b) in enumerate(tries[k])),
            *(F.min(F.when(F.col(x) > limits[x][b], F.col(x))).alias(f"high{j}") for j, (x, _, b) in enumerate(tries[k])),
        ).first()
        rules.append(tuple(Term(x, above, (edges[f"low{j}"] + edges[f"high{j}"]) / 2) for j, (x, above, _) in enumerate(tries[k])))
        left = left.filter(~kept(tries[k]))
    return rules
