"""Quality scores by a sparse rule ensemble.

Statistics of a text are column expressions. A forest of shallow trees over them is fitted to labelled rows; every path from a
root to a node becomes a rule (a conjunction of threshold tests); a logistic model with a lasso penalty weighs the rules, most of
them with zero; the rest are compiled into one column expression, so scoring is a projection over the whole table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, written

FOLDS = 5
#: Labelled rows used for fitting at most; those with the least hash of their doc_id.
MAX_ROWS = 20_000
PREDICT_FROM = 0.3
SYMBOL = r"[#*$%&|<>]"


def statistics(text: Column) -> dict[str, Column]:
    """Named numbers of a text; shares are of its words or characters. Null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, BLANK_CLASS + "+"), lambda w: w != "")
    return {
        "words": F.size(words).cast("double"), "distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "chars": F.char_length(t).cast("double"), "symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("double"),
        "stuck": F.regexp_count(t, F.lit(r"[#*$%&<>!]{2,}(?=\s|$)")).cast("double"), "bars": F.regexp_count(t, F.lit(r"(?<=\s)[|>»](?=\s|$)")).cast("double"),
        "shouts": F.regexp_count(t, F.lit("!!")).cast("double"), "ends": F.regexp_count(t, F.lit(r"[.?!](?=\s|$)")).cast("double"),
        "capitals": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("double"), "digits": F.regexp_count(t, F.lit("[0-9]")).cast("double"),
        "lines": F.size(F.split(t, "\n")).cast("double"), "distinct_lines": F.size(F.array_distinct(F.split(t, "\n"))).cast("double"),
    }


def shares(c: dict[str, Column]) -> dict[str, Column]:
    words, chars = F.greatest(c["words"], F.lit(1.0)), F.greatest(c["chars"], F.lit(1.0))
    return {
        "words": c["words"], "distinct_share": c["distinct_words"] / words, "distinct_root": c["distinct_words"] / F.sqrt(words), "word_length": c["chars"] / words, "symbols": c["symbols"] / words,
        "stuck": c["stuck"] / words, "bars": c["bars"] / words, "shouts": c["shouts"] / words, "ends": c["ends"] / words,
        "capitals": c["capitals"] / chars, "digits": c["digits"] / chars, "lines": c["lines"], "line_words": c["words"] / c["lines"],
        "repeated_lines": F.lit(1.0) - c["distinct_lines"] / c["lines"],
    }


STATISTICS = ["words", "distinct_share", "distinct_root", "word_length", "symbols", "stuck", "bars", "shouts", "ends", "capitals", "digits", "lines", "line_words", "repeated_lines"]
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class Ensemble:
    """Rules with weights: each rule is a tuple of (statistic, above, threshold)."""

    intercept: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, stats: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [stats[s] > t if above else stats[s] <= t for s, above, t in rule])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """STATISTICS and ``label`` of at most ``max_rows`` labelled rows outside the held-out fold.

    Only labels with a doc_id and a label of 0 or 1 count; of several labels for one doc_id the least holds. A document whose
    doc_id repeats takes part with each of its rows.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    # max_rows bounds this side, which makes the broadcast safe
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", F.struct(*[c.alias(k) for k, c in statistics(F.col("text")).items()]).alias("c"))
    counted = written(found, "training")
    return counted.select("label", *[c.alias(k) for k, c in shares({k: F.col(f"c.{k}") for k in statistics(F.col("text"))}).items()])


def tree_rules(forest) -> list[Rule]:
    """Every distinct path of a fitted forest, the one test of a statistic reduced to the tightest."""
    rules: dict[Rule, None] = {}

    def walk(node, path: dict[tuple[str, bool], float]) -> None:
        if path:
            rules.setdefault(tuple(sorted((s, above, t) for (s, above), t in path.items())))
        if node.numDescendants() == 0:
            return
        split = node.split()
        stat, limit = STATISTICS[split.featureIndex()], float(split.threshold())
        for above, child in ((False, node.leftChild()), (True, node.rightChild())):
            tight = (max if above else min)(path.get((stat, above), limit), limit)
            walk(child, path | {(stat, above): tight})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(rules)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, trees: int = 12, depth: int = 3, penalty: float = 0.002) -> Ensemble:
    """The ensemble of ``training_rows``. With one class only, no row, or too few rows for any rule, the score is constant."""
    rows = training_rows(docs, labels, label, max_rows).cache()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        rows.unpersist()
        return Ensemble({0: 0.0, 1: 4.0 if 1.0 in counts else -4.0}[len(counts)])
    assembled = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, featureSubsetStrategy="onethird", minInstancesPerNode=10).fit(assembled)
    rules = tree_rules(forest)
    if not rules:
        rows.unpersist()
        return Ensemble(math.log(counts[1.0] / counts[0.0]))
    stats = {s: F.col(s) for s in STATISTICS}
    fired = rows.select("label", *[holds(r, stats).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(fired).select("label", "features").cache()
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(fired)
    fired.unpersist()
    rows.unpersist()
    return Ensemble(float(model.intercept), {r: float(w) for r, w in zip(rules, model.coefficients, strict=True) if w})


def scored(docs: DataFrame, ensemble: Ensemble, predict_from: float = PREDICT_FROM) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of ``docs``.

    Null and empty texts are scored like any other, with statistics of zero. doc_id only tells the fold; a null one is in the
    fold of the empty string. Repeated rows get equal scores. Very long texts are measured whole, in one pass over their words. Other
    columns are neither read nor returned. An empty table gives an empty result.
    """
    counted = docs.select("doc_id", F.struct(*[c.alias(k) for k, c in statistics(F.col("text")).items()]).alias("c"))
    # An explode of one element: without it each rule would have its statistics counted from the text again.
    once = counted.select("doc_id", F.explode(F.array("c")).alias("c"))
    stats = shares({k: F.col(f"c.{k}") for k in statistics(F.col("text"))})
    wide = once.select("doc_id", *[c.alias(k) for k, c in stats.items()])
    wide = wide.select("doc_id", F.explode(F.array(F.struct(*STATISTICS))).alias("s")).select("doc_id", "s.*")
    rated = wide.select("doc_id", ensemble.score({s: F.col(s) for s in STATISTICS}).alias("score"))
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= predict_from).cast("int").alias("predicted"))
