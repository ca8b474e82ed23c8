"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Method. Tokens are summed per cell (source, language, topic). The mixture keeps
the share ``keep`` of all tokens, and each dimension says how they are to be split.
A value that has fewer tokens than its share asks for gives all it has (times
``max_rate``), and what it lacks is shared out among the other values of its dimension in
proportion to their targets. Raking then fits source, language and topic in turn:
the rates of a value's cells are multiplied by wanted over attained tokens, never beyond
``max_rate``, until no rate moves any more. It runs as one expression over
the table of cells. A document is taken floor(rate) times, and once more with the remaining
probability, decided by a hash of its doc_id, so a repeated run takes the same.

As the kept total is given and scarce values are capped, a few documents of a rare value
move a few documents of the mixture, whatever their target. ``attained`` reports
what each value was to have, could have and got.

Bounds. Values without a target count as ``other``, so there are at most
(targets + 1) cubed cells whatever the corpus; they are broadcast. The sums are
partial before the shuffle; a source with a third of all rows is a few cells.

Defined results. Null text has no tokens; null source or language is ``other``;
a null doc_id hashes as the empty string. Values whose target is zero are left out. If the
values with a target hold too little for ``keep``, the total is what they hold. Rows that repeat a doc_id
are taken alike. Rows come as a struct, so extra columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import SPACE, text_or_empty

OTHER = "other"
DIMENSIONS = ("source", "lang", "topic")
#: Share of all tokens that the mixture keeps, and rounds of raking at most; rates that move less than STILL have settled.
KEEP, ROUNDS, STILL = 0.4, 500, 1e-12
#: Hexadecimal digits of the hash that decide: 52 bits, exact in a double.
HEX = 13


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A topic by form, for corpora without a topic column: tables, notes with figures, briefs, articles."""
    return (F.when(F.contains(text, F.lit("|")), "table").when(text.rlike("[0-9]"), "figures")
            .when(tokens < 100, "brief").otherwise("article"))


def _codes(targets: dict[str, dict[str, float]]) -> dict[str, list[str]]:
    return {d: [*(v for v in targets[d] if v != OTHER), OTHER] for d in DIMENSIONS}


def _code(value: Column, names: list[str]) -> Column:
    """Place of a value among the named ones, the last one for any other."""
    at = F.array_position(F.array(*map(F.lit, names[:-1])), value) if len(names) > 1 else F.lit(0)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(names) - 1)).cast("int")


def coded(docs: DataFrame, targets: dict, topic: Column | None = None) -> DataFrame:
    """(d, cell): each row of ``docs`` as a struct; its tokens, topic and the codes of the three dimensions."""
    names = _codes(targets)
    d = docs.select(F.struct("*").alias("d"), n_tokens(text_or_empty()).alias("n"), *([] if topic is None else [topic.alias("topic")]))
    d = d if topic is not None else d.withColumn("topic", form_topic(text_or_empty("d.text"), F.col("n")))
    return d.select("d", F.struct("n", "topic", *(_code(F.col(c), names[x]).alias(x[0]) for x, c in zip(DIMENSIONS, ("d.source", "d.lang", "topic")))).alias("cell"))


def rates(cells: DataFrame, targets: dict, keep: float = KEEP, max_rate: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """(s, l, t, w, rate) per cell, from (s, l, t, w): raking as one expression over all cells."""
    flat = _fitted(cells, targets, keep, max_rate, rounds).select(F.expr("inline(f.cells)"))
    return flat.select("s", "l", "t", "w", F.col("r").alias("rate"))


def _fitted(cells: DataFrame, targets: dict, keep: float, max_rate: float, rounds: int) -> DataFrame:
    """One row: goals in tokens by dimension and value, and ``f`` with the cells and their rates."""
    one = cells.where("w > 0").agg(F.sort_array(F.collect_list(F.struct("s", "l", "t", F.col("w").cast("double").alias("w")))).alias("cells"))
    one = one.select("cells", *(F.expr(_sql(wanted(targets, d))).alias(d) for d in DIMENSIONS),
                     *(F.expr(f"transform({_sql(wanted(targets, d))}, (x, i) -> aggregate(filter(cells, c -> c.{d[0]} = i), 0D, (p, c) -> p + c.w) * {max_rate!r}D)").alias(f"{d}_most") for d in DIMENSIONS))
    # what the values with a target hold bounds the total
    held = [f"aggregate(zip_with({d}, {d}_most, (x, m) -> if(x > 0, m, 0D)), 0D, (p, y) -> p + y)" for d in DIMENSIONS]
    one = one.withColumn("total", F.expr(f"least(aggregate(cells, 0D, (p, c) -> p + c.w) * {keep!r}D, {', '.join(held)})"))
    one = one.select("cells", "total", *(F.expr(_goal(d, len(_codes(targets)[d]))).alias(d) for d in DIMENSIONS))
    return one.withColumn("f", F.expr(_raking(max_rate, rounds)))


def attained(docs: DataFrame, targets: dict, topic: Column | None = None, keep: float = KEEP, max_rate: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """(dimension, value, target, goal, got): the target share of each value, the tokens it was to have after capping, and the
    tokens that the rates give it."""
    fitted, names = _fitted(_cells(coded(docs, targets, topic)), targets, keep, max_rate, rounds), _codes(targets)
    value = lambda d: (f"transform({d}, (g, i) -> named_struct('dimension', '{d}', 'value', array({', '.join(repr(v) for v in names[d])})[i], 'target', {_sql(wanted(targets, d))}[i], "  # noqa: E731
                       f"'goal', g, 'got', aggregate(filter(f.cells, c -> c.{d[0]} = i), 0D, (p, c) -> p + c.w * c.r)))")
    return fitted.select(F.expr(f"inline(concat({', '.join(map(value, DIMENSIONS))}))"))


def wanted(targets: dict, dimension: str) -> list[float]:
    return [float(targets[dimension].get(v, 0.0)) for v in _codes(targets)[dimension]]


def _sql(values: list[float]) -> str:
    return f"array({', '.join(f'{v!r}D' for v in values)})"


def _goal(d: str, n: int) -> str:
    """Tokens per value: a common multiple of the targets, capped at what a value holds, that adds up to the total. Each step
    shares out what the values capped so far leave over; there are no more steps than values."""
    left = f"total - aggregate(zip_with({d}, {d}_most, (x, m) -> if(x * y >= m, m, 0D)), 0D, (p, v) -> p + v)"
    open_ = f"aggregate(zip_with({d}, {d}_most, (x, m) -> if(x * y >= m, 0D, x)), 0D, (p, v) -> p + v)"
    sum_ = f"aggregate({d}, 0D, (p, v) -> p + v)"
    multiple = f"aggregate(sequence(1, {n}), coalesce(try_divide(total, {sum_}), 0D), (y, k) -> if({open_} > 0, greatest(y, ({left}) / {open_}), y))"
    return f"transform(array({multiple}), y -> zip_with({d}, {d}_most, (x, m) -> least(x * y, m)))[0]"


def _raking(max_rate: float, rounds: int) -> str:
    """Each round fits source, language and topic in turn; it stops when no rate moves by more than ``STILL``."""
    def fit(cells: str, d: str) -> str:
        k = d[0]
        ratio = f"transform({d}, (g, i) -> coalesce(try_divide(g, aggregate(filter({cells}, c -> c.{k} = i), 0D, (p, c) -> p + c.w * c.r)), 0D))"
        # transform(array(x), q -> ...)[0] names an intermediate result, so that it is computed once
        return f"transform(array({ratio}), q -> transform({cells}, c -> named_struct('s', c.s, 'l', c.l, 't', c.t, 'w', c.w, 'r', least({max_rate!r}D, c.r * q[c.{k}]))))[0]"

    step = fit("z.cells", DIMENSIONS[0])
    for d, name in zip(DIMENSIONS[1:], "xy"):
        step = f"transform(array({step}), {name} -> {fit(name, d)})[0]"
    moved = "array_max(zip_with(z.cells, v, (a, b) -> abs(a.r - b.r)))"
    whole = "aggregate(cells, 0D, (p, c) -> p + c.w)"
    given = " and ".join(f"{d}[c.{d[0]}] > 0" for d in DIMENSIONS)
    begin = f"transform(cells, c -> named_struct('s', c.s, 'l', c.l, 't', c.t, 'w', c.w, 'r', if({given}, coalesce(try_divide(total, {whole}), 0D), 0D)))"
    return (f"aggregate(sequence(1, {rounds}), named_struct('cells', {begin}, 'moved', 1D), (z, k) -> if(z.moved <= {STILL!r}D, z, "
            f"transform(array({step}), v -> named_struct('cells', v, 'moved', coalesce({moved}, 0D)))[0]))")


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HEX), 16, 10).cast("double") / F.lit(float(16**HEX))


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*(F.col(f"cell.{k[0]}").alias(k[0]) for k in DIMENSIONS)).agg(F.sum("cell.n").alias("w"))


def with_copies(docs: DataFrame, targets: dict, topic: Column | None = None, keep: float = KEEP, max_rate: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """(d, n_tokens, topic, rate, copies): each row of ``docs`` as a struct, its rate and the number of copies to take."""
    rows = coded(docs, targets, topic)
    codes = [k[0] for k in DIMENSIONS]
    known = F.broadcast(rates(_cells(rows), targets, keep, max_rate, rounds).select(F.struct(*codes).alias("key"), "rate"))  # at most (targets + 1) cubed rows
    rows = rows.join(known, F.struct(*(F.col(f"cell.{k}").alias(k) for k in codes)) == F.col("key"), "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    copies = F.floor("rate") + F.when(chance(F.col("d.doc_id")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rows.select("d", F.col("cell.n").alias("n_tokens"), "cell.topic", "rate", copies.cast("long").alias("copies"))


def sample(docs: DataFrame, targets: dict, topic: Column | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the mixture takes."""
    return with_copies(docs, targets, topic, keep).where("copies > 0").select("d.*")
