"""Answers to batches of questions, scores against labels, and whether a model may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.operators.corpus import confusion
from suasion.operators.dims import LOG_THRESHOLD, SURFACE_THRESHOLD
from suasion.operators.ledger import newest

# fixed values: what a model must have and reach before it is used
MIN_POSITIVES, MIN_HELD, MIN_HELD_POSITIVES, MIN_PRECISION, MIN_RECALL = 40, 20, 8, 0.8, 0.5
# fixed value: how much recall may fall between two runs over the same labels
TOLERANCE = 0.02


def answered(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items with their answer; an item without one is not a negative, it is left out."""
    return items.join(answers, "i")


def label_every_pattern(rows: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """One row for each answered item and pattern: 1 for the pattern named, 0 for the others."""
    each = F.explode(F.array(*map(F.lit, patterns)))
    return rows.withColumn("pattern_id", each).withColumn("label", (F.col("answer") == F.col("pattern_id")).cast("int"))


def score_or_zero(labels: DataFrame, scores: DataFrame, key: list[str]) -> DataFrame:
    """Labels with the best score of their text; a text that no detector fired on scores 0."""
    best = scores.groupBy(*key).agg(F.max("score").alias("score"))
    return labels.join(best, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def at_two_thresholds(scored: DataFrame, by: tuple[str, ...] = ("pattern_id",)) -> DataFrame:
    """Positives, and hits and precision at the logging and at the surfacing threshold, in one pass."""
    yes = F.col("label") == 1
    over = {"log": F.col("score") >= LOG_THRESHOLD, "surface": F.col("score") >= SURFACE_THRESHOLD}
    counts = [F.count_if(yes).alias("positives")]
    for name, hit in over.items():
        counts += [F.count_if(hit & yes).alias(f"tp_{name}"), F.count_if(hit & ~yes).alias(f"fp_{name}")]
    out = scored.groupBy(*by).agg(*counts)
    for name in over:
        tp, fp = F.col(f"tp_{name}"), F.col(f"fp_{name}")
        out = out.withColumn(f"recall_{name}", F.try_divide(tp, F.col("positives"))).withColumn(f"precision_{name}", F.try_divide(tp, tp + fp))
    return out


def recall_baseline(scored: DataFrame) -> DataFrame:
    """What a run leaves for the next to be held against: pattern_id, positives, recall (three digits, 0 without positives)."""
    return at_two_thresholds(scored).select("pattern_id", "positives", F.round(F.coalesce("recall_log", F.lit(0.0)), 3).alias("recall"))


def ratchet(now: DataFrame, before: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Two baselines side by side, with a verdict by pattern.

    ``labels_changed``: other positives than before (none counts as 0), so the recalls are not comparable; ``regressed``:
    recall fell by more than the tolerance; ``held``; ``new``: a pattern without a figure before.
    """
    was = before.select("pattern_id", F.col("positives").alias("positives_was"), F.col("recall").alias("recall_was"))
    both = was.join(now.select("pattern_id", "positives", "recall"), "pattern_id", "full").withColumns({"positives": F.coalesce("positives", F.lit(0)), "recall": F.coalesce("recall", F.lit(0.0))})
    verdict = F.when(F.col("positives_was").isNull(), "new").when(F.col("positives") != F.col("positives_was"), "labels_changed").when(F.col("recall") < F.col("recall_was") - F.lit(tolerance), "regressed").otherwise("held")
    return both.withColumn("verdict", verdict)


def verdicts(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """pattern_id and verdict (SKIPPED: too few labels; REJECTED: held-out figures too low; OK). Needs held_out."""
    sizes = scored.groupBy("pattern_id").agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("held_out")).alias("held"), F.count_if(F.col("held_out") & (F.col("label") == 1)).alias("held_positives")
    )
    held = confusion(scored.filter("held_out"), threshold, ("pattern_id",)).select("pattern_id", "precision", "recall")
    few = (F.col("positives") < MIN_POSITIVES) | (F.col("held") < MIN_HELD) | (F.col("held_positives") < MIN_HELD_POSITIVES)
    low = (F.col("precision") < MIN_PRECISION) | (F.col("recall") < MIN_RECALL)
    return sizes.join(held, "pattern_id", "left").withColumn("verdict", F.when(few, "SKIPPED").when(low, "REJECTED").otherwise("OK"))


def novelty(labels: DataFrame, strict: str, text: str = "text") -> DataFrame:
    """By pattern: positives, and those among them that the strict words miss."""
    yes = F.col("label") == 1
    return labels.groupBy("pattern_id").agg(F.count_if(yes).alias("positives"), F.count_if(yes & ~F.col(text).rlike(strict)).alias("novel"))


def distinct_claims(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """Distinct claims with how often each was logged and when first."""
    return log.groupBy(*key).agg(F.count("*").alias("logged_times"), F.min(order).alias("first_at"))


def with_examples(rows: DataFrame, key: str, example: str, order: list[str | Column], most: int = 3) -> DataFrame:
    """By key: how many rows, and the first ``most`` examples (the limit reaches the map side)."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    firsts = newest(rows, (key,), tuple(order), most).groupBy(key).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    return counts.join(firsts, key)
