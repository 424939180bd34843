"""Quality scores by a sparse ensemble of rules.

Statistics of a text are Spark columns. Shallow trees are grown on the labelled statistics; each
path from a root to a node becomes a rule, a conjunction of bounds on statistics. A logistic
regression with an L1 penalty weighs the rules and drops most of them, and what is left is compiled
into one Spark column: the logistic function of a sum of weighted conjunctions. Trees and weights
are fitted by Spark ML on all labelled rows; the driver sees rules and weights only, at most
``trees * (2**(depth + 1) - 2)`` of them.

* A null or empty text has all statistics 0 and gets a score like any other.
* Rows with a null label count as unlabelled. Without a labelled row the score is 0.5; with labels
  of one value only it is that value.
* Repeated rows are scored alike and each counts in the fit.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The text statistics and the expressions that count them.
COUNTS = {
    "chars": "length(t)",
    "words": "regexp_count(t, '\\\\S+')",
    "lines": "regexp_count(t, '\\n') + 1",
    "upper": "regexp_count(t, '\\\\p{Lu}')",
    "digits": "regexp_count(t, '[0-9]')",
    "stops": "regexp_count(t, '[.!?](\\\\s|$)')",
    "commas": "regexp_count(t, ',')",
    "symbols": "regexp_count(t, '[^\\\\p{L}\\\\p{N}\\\\s.,]')",
    "short_words": "regexp_count(t, '(?<!\\\\S)\\\\S{1,3}(?!\\\\S)')",
    "echoes": "regexp_count(t, '(?<!\\\\S)(\\\\S++)(?=\\\\s+\\\\1(?!\\\\S))')",
    "distinct_lines": "size(array_distinct(split(t, '\\n')))",
}
SHARES = {
    "log_chars": "log1p(chars)",
    "chars_per_word": "chars / greatest(words, 1)",
    "words_per_line": "words / lines",
    "upper_share": "upper / greatest(chars, 1)",
    "digit_share": "digits / greatest(chars, 1)",
    "stops_per_word": "stops / greatest(words, 1)",
    "commas_per_word": "commas / greatest(words, 1)",
    "symbols_per_word": "symbols / greatest(words, 1)",
    "short_word_share": "short_words / greatest(words, 1)",
    "echo_share": "echoes / greatest(words, 1)",
    "distinct_line_share": "distinct_lines / lines",
}
STATISTICS = list(SHARES)


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, is upper bound, value) that hold together, and the weight of that."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        held = F.lit(True)
        for name, below, value in self.bounds:
            held = held & ((F.col(name) <= value) if below else (F.col(name) > value))
        return held


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(), rule.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep (but those named like a statistic or count) and the statistics."""
    keep = [c for c in keep if c not in (*COUNTS, *SHARES, "t")]
    text = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    counted = text.select(*keep, *(F.expr(e).cast("double").alias(n) for n, e in COUNTS.items()))
    return counted.select(*keep, *(F.expr(e).cast("double").alias(n) for n, e in SHARES.items()))


def tree_rules(description: str) -> set[tuple[tuple[str, bool, float], ...]]:
    """The conjunctions of all paths of one described tree that do not end at the root."""
    found, path = set(), []
    for line in description.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            path = [(d, b) for d, b in path if d < depth]
            path.append((depth, (STATISTICS[int(m[2])], m[3] == "<=", float(m[4]))))
            found.add(tuple(sorted({b for _, b in path})))
    return found


def fit(labelled: DataFrame, label: str, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Rules and weights from the statistics of labelled rows; ``label`` is 0 or 1."""
    rows = labelled.filter(F.col(label).isin(0, 1)).select(
        array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS, F.col(label).cast("double").alias("label")
    )
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return RuleModel(40.0 if 1.0 in seen else -40.0 if seen else 0.0, ())
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed).fit(
        rows.select("features", "label")
    )
    paths = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not paths:
        ones = seen[1.0] / sum(seen.values())
        return RuleModel(math.log(ones / (1 - ones)), ())
    rules = [Rule(p) for p in paths]
    held = rows.select(array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"), "label")
    weighed = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(held)
    weights = weighed.coefficients.toArray()
    return RuleModel(
        float(weighed.intercept), tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights, strict=True) if w)
    )
