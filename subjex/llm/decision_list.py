"""Quality rules: learned decision lists, in DataFrame functions only.

Method. Per-document statistics are column expressions. From the statistics
of labelled rows, sequential covering learns an ordered list of rules that
reject: a rule grows condition by condition (``share > cut`` or ``<= cut``)
by information gain on two thirds of the rows, is pruned back on the other
third, is accepted only at ``min_precision`` there, and the rows it covers
leave before the next rule grows. The list is emitted as one ordered
``CASE WHEN`` expression, readable by ``Rule.text`` and applied by Spark
without any join.

Bounds. Learning uses at most ``max_train`` labelled rows (smallest hashes of
doc_id, outside the held-out fold) and collects one count per feature and cut.
Applying is one pass without a shuffle.

Defined results. Null text is empty text: no words, so it fails the base rule.
Labels that are null are ignored. Without labels the list is empty and the
base rule decides alone. Rows that repeat a doc_id are judged one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import SPACE, held_out, materialise, text_or_empty

#: Characters that count as symbols. Fixed by the contract.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "symbol_share", "capital_share", "bang_share", "digit_share", "mean_word",
            "distinct_share", "dup_line_share", "repeat_share", "mark_share"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside some run of ``WINDOW`` words that occurs at least twice in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h):
        n = F.size(h) - (WINDOW - 1)
        runs = F.arrays_zip(*(F.slice(h, F.lit(k + 1), n) for k in range(WINDOW)))
        return F.when(n > 0, F.transform(runs, lambda s: F.xxhash64(s))).otherwise(F.expr("cast(array() as array<bigint>)"))

    def covered(v):
        placed = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = _let(placed, lambda s: F.filter(s, lambda e, j: (e["x"] == F.get(s, j - 1)["x"]) | (e["x"] == F.get(s, j + 1)["x"])))
        # runs that overlap or touch count once: each start covers what lies before the next one, WINDOW words at most
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return _let(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    return _let(_let(hashes, windows), lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), 0).otherwise(covered(v))).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """(d, stats): each row of ``docs`` as a struct, its base counts and every feature, computed once per document."""
    d = docs.select(F.struct("*").alias("d"), text_or_empty().alias("_text"))
    # The counts come out of a generator of one row: later filters stay above it, where pushed below they would compute every count again.
    d = d.select("d", "_text", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "").alias("_words"),
                 F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias("_lines"))
    counts = [F.size("_words").cast("long").alias("n_words"), F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
              _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
              (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
              repeat_words(F.col("_words")).alias("n_repeat_words")]
    more = [F.size("_lines").alias("n_lines"), F.size(F.array_distinct("_words")).alias("n_distinct"),
            _count(F.col("_text"), CAPITALS).alias("n_capitals"), _count(F.col("_text"), "!").alias("n_bangs"),
            _count(F.col("_text"), "0123456789").alias("n_digits"), _count(F.col("_text"), "!?.,;:|\"'()[]{}/\\=+~^_@").alias("n_marks")]
    d = d.select("d", F.explode(F.array(F.struct(*counts, *more))).alias("_raw"))
    r = F.col("_raw")
    chars, words = F.greatest(r["word_chars"], F.lit(1)), F.greatest(r["n_words"], F.lit(1))
    shares = {"symbol_share": r["n_symbols"] / chars, "capital_share": r["n_capitals"] / chars, "bang_share": r["n_bangs"] / chars,
              "digit_share": r["n_digits"] / chars, "mark_share": r["n_marks"] / chars, "mean_word": r["word_chars"] / words,
              "distinct_share": r["n_distinct"] / words, "repeat_share": r["n_repeat_words"] / words,
              "dup_line_share": r["n_dup_lines"] / F.greatest(r["n_lines"], F.lit(1))}
    return d.select("d", F.struct(*[r[c].alias(c) for c in BASE], *[v.alias(k) for k, v in shares.items()]).alias("stats"))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, stats: Column) -> Column:
        value = stats[self.feature].cast("double")
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


@dataclass(frozen=True)
class Rule:
    """Rejects a document for which all conditions hold."""
    conditions: tuple[Condition, ...]

    def holds(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, (c.holds(stats) for c in self.conditions))

    @property
    def text(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.cut:.6g}" for c in self.conditions)


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The ordered conditional expression: false at the first rule that holds, else true."""
    out = None
    for r in rules:
        out = (F if out is None else out).when(r.holds(stats), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """Statistics of at most ``max_train`` labelled rows; ``junk`` marks label 0."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
              .groupBy("doc_id").agg(F.min("quality").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_train rows of two numbers
    s = with_statistics(rows)
    return s.select((F.col("d.label") == 0).cast("int").alias("junk"), (F.pmod(F.xxhash64("d.doc_id", F.lit(7)), F.lit(3)) < 2).alias("grow"),
                    F.struct(*[F.col("stats")[f].cast("double").alias(f) for f in FEATURES]).alias("s"))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = 10_000, max_rules: int = 8, max_conditions: int = 3,
          cuts: int = 24, min_precision: float = 0.9) -> list[Rule]:
    """Sequential covering over labelled statistics; the driver sees counts per feature and cut only."""
    rows = materialise(training_rows(docs, labels, max_train), "rule-statistics")
    share = [i / cuts for i in range(cuts + 1)]
    grid_rows = rows.groupBy("junk").agg(*[F.percentile(F.col("s")[f], F.array(*map(F.lit, share))).alias(f) for f in FEATURES]).collect()
    values = {f: sorted({v for r in grid_rows for v in r[f] or []}) for f in FEATURES}
    grid = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}  # cuts lie between what was seen
    binned = materialise(rows.select("junk", "grow", *[_bin(F.col("s")[f], grid[f]).alias(f) for f in FEATURES]), "rule-bins")
    rules: list[Rule] = []
    left = binned
    while len(rules) < max_rules:
        grown = _grow(left.where("grow"), grid, max_conditions)
        if not grown:
            break
        kept, p, n = _prune(left.where(~F.col("grow")), grown, grid)
        if p < 1 or p < min_precision * (p + n):
            break
        rules.append(Rule(tuple(kept)))
        left = left.where(~_covers(kept, grid))
    return rules


def _bin(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: value > c)) if cuts else F.lit(0)


def _covers(conditions: list[Condition], grid: dict) -> Column:
    """The conditions over binned features: a bin is the number of cuts below the value."""
    tests = ((F.col(c.feature) > grid[c.feature].index(c.cut)) if c.above else (F.col(c.feature) <= grid[c.feature].index(c.cut)) for c in conditions)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _grow(rows: DataFrame, grid: dict, most: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x")
        counts = rows.where(_covers(rule, grid)).select("junk", bins).groupBy("x.f", "x.b").agg(F.sum("junk").alias("p"), F.sum(1 - F.col("junk")).alias("n")).collect()
        best = _best_condition(counts, grid)
        if best is None or best in rule:
            break
        rule.append(best)
    return rule


def _best_condition(counts: list, grid: dict) -> Condition | None:
    """The cut with the most information gained, from counts per feature and bin."""
    by: dict[str, list] = {f: [[0, 0] for _ in range(len(grid[f]) + 1)] for f in FEATURES}
    for r in counts:
        by[r["f"]][r["b"]] = [r["p"], r["n"]]
    p0, n0 = (sum(x[i] for x in by[FEATURES[0]]) for i in (0, 1))
    if not p0 or not n0:
        return None
    info = lambda p, n: math.log2((p + 0.5) / (p + n + 1))
    best, most = None, 1e-9
    for f in FEATURES:
        p = n = 0
        for j, cut in enumerate(grid[f]):
            p, n = p + by[f][j][0], n + by[f][j][1]
            for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                if (gain := q * (info(q, m) - info(p0, n0))) > most:
                    best, most = Condition(f, above, cut), gain
    return best


def _prune(rows: DataFrame, rule: list[Condition], grid: dict) -> tuple[list[Condition], int, int]:
    """The shortest beginning of the rule with the best (p - n) / (p + n) on rows it did not grow on."""
    ks = range(1, len(rule) + 1)
    got = rows.agg(*[F.sum(F.when(_covers(rule[:k], grid), y)).alias(f"{a}{k}") for k in ks for a, y in (("p", F.col("junk")), ("n", 1 - F.col("junk")))]).first()
    scored = [((got[f"p{k}"] or 0), (got[f"n{k}"] or 0), k) for k in ks]
    p, n, k = max(scored, key=lambda x: ((x[0] - x[1]) / (x[0] + x[1] + 1), -x[2]))
    return rule[:k], p, n


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, base counts, base_failed, kept) for every row."""
    s = F.col("stats")
    d = with_statistics(docs.select("doc_id", "text"))
    failed = base_failed(s)
    return d.select("d.doc_id", *[s[c].alias(c) for c in BASE], failed.alias("base_failed"), (~failed & verdict(rules, s)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and the list."""
    s = F.col("stats")
    return with_statistics(docs).where(~base_failed(s) & verdict(rules, s)).select("d.*")
