"""Secret scans that look at each content once per rule version.

Every version of every document is addressed by the SHA-256 of its text. A ledger (two tables in one folder)
holds which blob has been scanned by which rule version, and what was found. A scan looks only at
pairs of blob and rule version that the ledger doesn't have, whoever holds the blob; findings are then joined
back to all rows, so that copies and later scans cost a hash of their text. A rule's version follows from
its definition: a changed rule is a new one.

DataFrame expressions only. Hashes and ids are grouped and joined; each new blob's text moves once, to meet
the list of its open rules. Findings are written before the ledger of scanned pairs, so that a scan that
breaks off is repeated, and equal findings count once.

Defined results: a null text is an empty one; matches are leftmost and do not overlap within a kind; a
match that is too short is dropped, but later ones start behind it; positions are code points, ends
exclusive. Repeated rows are reported each. Columns besides the id and the text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, materialise

SPANS = "array<struct<start: int, kind: int, stop: int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the part whose length counts
    least: int = 1
    hints: tuple[str, ...] = ()  # a match holds one of them, in any case; spares the pattern

    @property
    def version(self) -> str:
        return f"{self.kind}@{sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]}"


# The three base kinds; no run of hexadecimal digits or of AKIA's characters that is shorter
# than asked for can hold a longer match, so that the least length stands in the pattern.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        ("passw", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hints=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", hints=("private key",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyj",)),
)
RULES = BASE + MORE


def spans(text: Column, rule: Rule, number: int) -> Column:
    """The rule's matches as structs (start, kind, stop)."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    # What stands before each match, from the end of the one before.
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))
    steps = F.zip_with(
        F.zip_with(gaps, whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("size"))),
        part,
        lambda s, p: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), (F.length(p) >= rule.least).alias("good")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), (begin + step["size"]).alias("stop"))
        return F.struct((begin + step["size"]).alias("at"), F.when(step["good"], F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    return F.aggregate(steps, start, add, lambda s: s["found"])


def all_spans(text: Column, lower: Column, open_rules: Column, rules: tuple[Rule, ...]) -> Column:
    """The matches of those rules whose versions are in ``open_rules``."""
    none = F.array().cast(SPANS)
    parts = []
    for k, rule in enumerate(rules):
        use = F.array_contains(open_rules, rule.version)
        if rule.hints:
            use = use & reduce(lambda a, b: a | b, [F.contains(lower, F.lit(h)) for h in rule.hints])
        else:
            use = use & text.rlike(rule.pattern)
        parts.append(F.when(use, spans(text, rule, k)).otherwise(none))
    return F.concat(*parts)


class Ledger:
    """Tables ``scanned`` (blob, rule) and ``findings`` (blob, rule, start, kind, stop) in a folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.rules = spark, rules
        self.path = path or fresh_path(spark, "ledger")
        if path is None:
            none = spark.range(0)
            none.selectExpr("'' AS blob", "'' AS rule").write.parquet(f"{self.path}/scanned")
            none.selectExpr("'' AS blob", "'' AS rule", "0 AS start", "0 AS stop").write.parquet(f"{self.path}/findings")

    @property
    def scanned(self) -> DataFrame:
        return self.spark.read.schema("blob string, rule string").parquet(f"{self.path}/scanned")

    @property
    def findings(self) -> DataFrame:
        return self.spark.read.schema("blob string, rule string, start int, stop int").parquet(f"{self.path}/findings")

    def scan(self, versions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Scans what is new in ``versions``; (key, blob) of all its rows."""
        body = F.coalesce(F.col(text), F.lit(""))
        rows = versions.select(F.col(key).alias("key"), F.sha2(body, 256).alias("blob"))
        rows = materialise(rows, "ledger-rows")
        names = [r.version for r in self.rules]
        seen = self.scanned.filter(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        due = F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>")))
        todo = rows.groupBy("blob").agg(F.min("key").alias("key")).join(seen, "blob", "left").select("blob", F.col("key").alias("at"), due.alias("due"))
        todo = materialise(todo.filter(F.size("due") > 0), "ledger-todo")
        texts = versions.select(F.col(key).alias("key"), body.alias("text")).withColumn("own", F.sha2("text", 256))
        new = texts.join(todo.hint("merge"), (texts["own"] == todo["blob"]) & texts["key"].eqNullSafe(todo["at"]))
        found = new.select("blob", F.inline(all_spans(F.col("text"), F.lower("text"), F.col("due"), self.rules)))
        rule = F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1)
        found.select("blob", rule.alias("rule"), "start", "stop").write.mode("append").parquet(f"{self.path}/findings")
        todo.select("blob", F.explode("due").alias("rule")).write.mode("append").parquet(f"{self.path}/scanned")
        return rows

    def report(self, rows: DataFrame) -> DataFrame:
        """(key, blob, spans) of all rows: each blob's findings by the present rules, in order."""
        names = [r.version for r in self.rules]
        kind = F.array_position(F.array(*map(F.lit, names)), F.col("rule")).cast("int") - 1
        span = F.struct("start", kind.alias("kind"), "stop")
        by_blob = self.findings.filter(F.col("rule").isin(names)).groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))
        by_blob = materialise(by_blob, "ledger-spans")
        return rows.join(by_blob, "blob", "left").select("key", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def described(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")
