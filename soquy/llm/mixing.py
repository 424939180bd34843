"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells, one per combination of the margin columns. A cell's natural weight is
its number of tokens. Raking multiplies the weights of all cells with one value of a margin by the
ratio of that value's target to its present sum, one margin after the other, sweep after sweep,
until every margin is met. A document is drawn if a hash of its id is below its probability.

With ``sample`` the expected size is given: that share of all tokens, however rare the rarest cell is.
No cell can give more than it has, so a value that has less than its target is taken whole and the
others of its margin share what is missing; a raked weight that passes its cell's tokens is cut to
these, and the sweeps go on with the other cells. The targets are then met as nearly as the tokens
allow, and the sample is smaller only where the values with a target have fewer tokens.

Without ``sample`` the targets come first: the probability is the cell's ratio of raked to natural
weight, scaled by one constant so that the largest is ``rate``, and the expected tokens stand in the
target shares on every margin. The rarest cell then sets the size of the sample.

* Only the cell table (distinct combinations of values) is raked; documents meet it in one join. A
  cell table of at most ``TOGETHER`` rows is brought into one partition once, where no step of the
  targets and sweeps moves it again, so these are queries of one task however many partitions the
  session has; a larger one is shuffled by each margin in turn. Both give the same weights.
* A target is a share per value. Values without a target share keep weight 0 and are never drawn;
  targets of values without tokens are left out and the rest is rescaled to 1. Null is a value of
  its own. By default the target of a value is its natural share to the power ``temperature``.
* Documents without tokens count nothing, have probability 0 and are not drawn. Repeated rows are
  drawn alike. An empty table gives an empty result.
* The sweeps end when every margin is met, or when a sweep no longer changes any weight; where the
  targets contradict each other (a cell pattern that cannot meet them all), after ``rounds`` at the
  latest, and the last margin is the one that is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soquy.llm.common import hidden, stored

ADDED = ("mix_tokens", "mix_weight", "mix_probability", "mix_sampled")
# Fixed value: the share of all tokens that the queries draw.
SAMPLE = 0.5
# Patterns of the topics, the first that fits counts.
TOPICS = {
    "legal": "(?i)licen[cs]e|copyright|warranty",
    "contact": "@[a-zA-Z0-9]+[.]|\\\\+[0-9]{2}",
    "table": "[|] ",
    "markup": "[%#$&*]{3}",
    "figures": "[0-9]{3}",
}


def topic_column(text_col: str = "text") -> Column:
    """A coarse topic of a text by surface patterns, ``prose`` where none fits."""
    branches = " ".join(f"WHEN `{text_col}` RLIKE '{p}' THEN '{name}'" for name, p in TOPICS.items())
    return F.expr(f"CASE {branches} ELSE 'prose' END")


TOGETHER = 50_000
"""Cells up to which the cell table is raked in one partition: some MB."""


def one_number(df: DataFrame, column: Column) -> float:
    """An aggregate over all rows, 1 where there is none or nothing."""
    return float(df.agg(column).first()[0] or 1.0)


def kept(df: DataFrame, together: bool) -> DataFrame:
    """The stored rows, in one partition if they are to stay together."""
    return stored(df.coalesce(1)).coalesce(1) if together else stored(df)


def gathered(cells: DataFrame) -> tuple[DataFrame, bool]:
    """The stored cells, in one partition if they are few enough, and whether they are."""
    cells = stored(cells)
    together = cells.count() <= TOGETHER
    return (kept(cells, True) if together else cells), together


def natural_targets(cells: DataFrame, margin: str, temperature: float) -> DataFrame:
    """(margin, share): shares of tokens to the power of the temperature, scaled to 1."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), temperature).alias("raw"))
    whole = sums.agg(F.coalesce(F.sum("raw"), F.lit(1.0))).scalar()
    return sums.select(margin, (F.col("raw") / whole).alias("share"))


def level(df: DataFrame, room: str, part: str, total: float) -> float:
    """The factor s with sum(least(room, s * part)) = total, or one that fills all rooms if they have less.

    From one step to the next only more rows are full, so this ends; each step is one aggregate.
    """
    s, full = 0.0, -1
    while True:
        is_full = F.col(room) <= s * F.col(part)
        row = df.filter(F.col(part) > 0).agg(
            F.coalesce(F.sum(F.when(is_full, F.col(room))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col(part))), F.lit(0.0)),
            F.count(F.when(is_full, 1)),
        ).first()
        if row[2] == full or not row[1]:
            return s
        s, full = max(s, (total - row[0]) / row[1]), row[2]


def rake(
    cells: DataFrame,
    margins: list[str],
    targets: dict[str, DataFrame],
    sweeps: int = 5,
    rounds: int = 6,
    tolerance: float = 1e-6,
    sample: float | None = None,
) -> DataFrame:
    """Cells (margins, tokens) with ``weight``, whose sums by each margin are the target shares. With
    ``sample`` the weights add up to that and none is above its cell's share of the tokens."""
    cells, together = gathered(cells)
    total = one_number(cells, F.sum("tokens"))
    room = F.col("tokens") / total
    held = cells.withColumn("weight", room)
    for margin in margins:
        wanted = targets[margin].select(F.col(margin).alias("_value"), F.col("share").alias(f"_to_{margin}"))
        held = held.join(wanted, F.col(margin).eqNullSafe(F.col("_value")), "left").drop("_value")
        held = held.fillna(0.0, [f"_to_{margin}"])
    held = kept(held, together)
    for margin in margins:  # targets of the values that are there, to 1
        values = held.groupBy(margin).agg(F.first(f"_to_{margin}").alias("share"))
        present = values.agg(F.sum("share").alias("n")).select(F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).scalar()
        held = held.withColumn(f"_to_{margin}", F.col(f"_to_{margin}") / present)
    held = kept(held, together)
    if sample is not None:
        for margin in margins:
            values = held.groupBy(margin).agg(F.sum(room).alias("room"), F.first(f"_to_{margin}").alias("share"))
            at_most = F.sum(room).over(Window.partitionBy(margin))
            wanted = level(kept(values, together), "room", "share", sample) * F.col(f"_to_{margin}")
            held = held.withColumn(f"_to_{margin}", F.least(at_most, wanted))
        held = kept(held, together)
    for _ in range(rounds):
        for k in range(sweeps):
            if k == sweeps - 1:
                held = held.withColumn("_before", F.col("weight"))
            for margin in margins:
                now = F.sum("weight").over(Window.partitionBy(margin))
                raked = F.when(now > 0, F.col("weight") * F.col(f"_to_{margin}") / now).otherwise(0.0)
                held = held.withColumn("weight", raked if sample is None else F.least(room, raked))
        off = held
        for margin in margins:
            now = F.sum("weight").over(Window.partitionBy(margin))
            off = off.withColumn(f"_off_{margin}", F.abs(now - F.col(f"_to_{margin}")))
        off = kept(off, together)
        worst = F.max(F.greatest(*(F.col(f"_off_{m}") for m in margins), F.lit(0.0)))
        moved = F.max(F.abs(F.col("weight") - F.col("_before")) / room)
        worst, moved = off.agg(worst, moved).first()
        held = off.drop("_before", *(f"_off_{m}" for m in margins))
        if worst is None or worst < tolerance or moved < tolerance:
            break
    if sample is not None:
        held = held.withColumn("room", room)
        held = held.withColumn("weight", F.least("room", level(held, "room", "weight", sample) * F.col("weight")))
    return held.select(*margins, "tokens", "weight")


def mix_sources(
    docs: DataFrame,
    margins: dict[str, Column],
    targets: dict[str, DataFrame] | None = None,
    temperature: float = 0.7,
    rate: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: float | None = None,
) -> DataFrame:
    """All rows with mix_tokens, mix_weight (the share of their cell in the expected sample),
    mix_probability and mix_sampled added. ``margins`` names the margins and gives the column of each;
    ``sample`` is the share of all tokens to draw (``rate`` only counts without it)."""
    keep = [c for c in docs.columns if c not in ADDED]
    names = hidden(docs, *(f"margin_{k}" for k in range(len(margins))))
    of_names = hidden(docs, *(f"of_margin_{k}" for k in range(len(margins))))
    (odds_name,) = hidden(docs, "odds")
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit("\\S+")), F.lit(0)).cast("long")
    rows = docs.select(*keep, *(c.alias(n) for n, c in zip(names, margins.values(), strict=True)), tokens.alias("mix_tokens"))
    # the shares of cells need the counts only, so the texts are not written again
    cells, _ = gathered(rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")).filter("tokens > 0"))
    wanted = {}
    for name, column in zip(margins, names, strict=True):
        given = (targets or {}).get(name)
        wanted[column] = (
            natural_targets(cells, column, temperature) if given is None else given.select(F.col(name).alias(column), "share")
        )
    raked = rake(cells, names, wanted, sample=sample)
    ratio = F.col("weight") / F.col("tokens")
    if sample is None:
        probability, drawn = rate * ratio / one_number(raked, F.max(ratio)), 1.0
    else:
        probability, drawn = ratio * one_number(cells, F.sum("tokens")), one_number(raked, F.sum("weight"))
    odds = stored(
        raked.select(
            *(F.col(n).alias(o) for n, o in zip(names, of_names, strict=True)),
            (F.col("weight") / drawn).alias("mix_weight"),
            F.least(F.lit(1.0), probability).alias(odds_name),
        )
    )
    same = [F.col(n).eqNullSafe(F.col(o)) for n, o in zip(names, of_names, strict=True)]
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 53)) / float(1 << 53)
    chance = F.when(F.col("mix_tokens") > 0, F.coalesce(odds_name, F.lit(0.0))).otherwise(0.0)
    joined = rows.join(odds, same, "left").withColumn("mix_probability", chance)
    return joined.select(
        *keep,
        "mix_tokens",
        F.coalesce("mix_weight", F.lit(0.0)).alias("mix_weight"),
        "mix_probability",
        (draw < F.col("mix_probability")).alias("mix_sampled"),
    )
