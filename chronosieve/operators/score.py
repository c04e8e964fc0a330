"""Scores of predictions and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relative_error(predicted: Column, actual: Column) -> Column:
    return F.when(actual > 0, F.abs(predicted - actual) / actual).otherwise(1.0)


def banded(direction_right: Column, error: Column) -> Column:
    """0.40 for the direction, 0.35 for an error of at most a half, 0.25 for at most a fifth."""
    return F.when(direction_right, 0.40).otherwise(0.0) + F.when(error <= 0.5, 0.35).otherwise(0.0) + F.when(error <= 0.2, 0.25).otherwise(0.0)


def direction_points(predicted: Column, actual: Column) -> Column:
    """1 for the direction, a half for Stable where the truth is another one, else 0; a missing prediction gets 0."""
    p, a = F.initcap(F.trim(predicted)), F.initcap(F.trim(actual))
    return F.when(p.isNull(), 0.0).when(p == a, 1.0).when((p == "Stable") & (a != "Stable"), 0.5).otherwise(0.0)


def with_predictions(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the truth with their predictions, nulls where there are none."""
    return truth.join(predictions, keys, "left")


def choice_right(answer: Column, truth: Column) -> Column:
    return F.substring(F.upper(F.trim(answer)), 1, 1) == F.substring(F.upper(F.trim(truth)), 1, 1)


def calibration_bins(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Bins (lo, hi], the first with 0: count, mean confidence, accuracy."""
    c = F.when(confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))  # both skip nulls
    b = F.greatest(F.ceil(c * bins), F.lit(1)).cast("long")
    return rows.select(b.alias("bin"), c.alias("c"), correct.cast("double").alias("ok")).where("c is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("confidence"), F.avg("ok").alias("accuracy"))


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error of calibration_bins."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def ablation(rows: DataFrame, by: str, condition: str, value: str, with_: str, without: str) -> DataFrame:
    """Mean with and without something, and the difference; null if one is missing."""
    wide = rows.groupBy(by).pivot(condition, [with_, without]).agg(F.avg(value))
    return wide.select(by, F.col(with_).alias("mean_with"), F.col(without).alias("mean_without"), (F.col(with_) - F.col(without)).alias("delta"))


#: Weights of a request's five parts (core, wrong, under, over, justification), and slopes of its penalties.
WEIGHTS, UNDER, OVER, EPSILON, CEILING = (0.35, 0.20, 0.10, 0.20, 0.15), 2.0, 0.5, 1e-6, 0.70


def _weighed(parts: list[Column], weights=WEIGHTS) -> Column:
    return sum((F.lit(w) * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0))


def request_reward(asked: Column, core: Column, optional: Column, justified: Column, weights=WEIGHTS, under: float = UNDER, over: float = OVER) -> Column:
    """Reward of a request by the rubric: penalties are linear.

    asked, core, optional: arrays of different names; justified: 0, 0.5 or 1.
    """
    hit, n, n_core = F.size(F.array_intersect(asked, core)), F.size(asked), F.size(core)
    wrong = F.size(F.array_except(asked, F.concat(core, optional)))
    return _weighed([hit / n_core, 1 - wrong / (n + EPSILON), -under * (n_core - hit), -over * F.greatest(F.lit(0), n - n_core - F.size(optional)), justified], weights)


def graded_reward(n_core_cited: Column, n_optional: Column, n_irrelevant: Column, n_driver: Column, core: int, optional: int, irrelevant: int, justified: Column, weights=WEIGHTS, under: float = UNDER, over: float = OVER, ceiling: float = CEILING) -> Column:
    """Reward of a request by a grader's counts: penalties are exponential and the sum has a ceiling.

    n_driver: irrelevant names given as reasons; core, optional, irrelevant: how many names each list has.
    """
    parts = [
        n_core_cited / core, 1 - n_driver / irrelevant, F.exp(-under * F.greatest(F.lit(0.0), (core - n_core_cited) / core)),
        F.exp(-over * F.greatest(F.lit(0.0), (n_optional + n_irrelevant - core) / optional)), justified,
    ]
    return F.least(F.lit(ceiling), _weighed(parts, weights))


def mean_of(*parts: Column) -> Column:
    """The mean of parts that are all there."""
    return sum(parts, F.lit(0.0)) / len(parts)


def confidence_and_accuracy(rows: DataFrame, by: list[str], confidence: Column, correct: Column) -> DataFrame:
    """Mean stated confidence and accuracy of each group, over the rows that state one."""
    return rows.where(confidence.isNotNull()).groupBy(*by).agg(F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def gathered(results: DataFrame, by: list[str], predictions: str, scores: str) -> DataFrame:
    """A row for each entry of a map of predictions (label to confidence), with whether its score is 1."""
    rows = results.select(*by, scores, F.explode(predictions).alias("label", "confidence")).where("confidence is not null")
    return rows.select(*by, "label", "confidence", (F.coalesce(F.try_element_at(scores, F.col("label")), F.lit(0.0)) == 1).cast("double").alias("correct"))


def condition_summary(rows: DataFrame, condition: str, score: str, flags: list[str]) -> DataFrame:
    """For each condition the mean score and the rates of flags, to three digits."""
    return rows.groupBy(condition).agg(F.round(F.avg(score), 3).alias("mean_score"), *[F.round(F.avg(F.col(c).cast("double")), 3).alias(f"{c}_rate") for c in flags])


def comparison(rows: DataFrame, case: str, condition: str, scores: list[str]) -> DataFrame:
    """Scores by case and condition as text of three digits, n/a where there is none."""
    shown = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.3f", F.col(c).cast("double")))
    return rows.select(case, condition, *[shown(c).alias(c) for c in scores]).orderBy(case, condition)


def outcomes(episodes: DataFrame, ident: str, trajectories: str, label: str) -> DataFrame:
    """The array of values of one label, for the episodes that have it."""
    return episodes.where(F.map_contains_key(trajectories, label)).select(ident, F.element_at(trajectories, label).alias("trajectory"))


def shape_distance(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    """L2 distance of two arrays, each less its mean and over its population deviation; the shorter one ends in zeros."""

    def standard(x: Column) -> Column:
        total = lambda y: F.aggregate(y, F.lit(0.0), lambda acc, v: acc + v)
        mean = total(x) / F.size(x)
        deviation = F.sqrt(total(F.transform(x, lambda v: (v - mean) * (v - mean))) / F.size(x))
        return F.transform(x, lambda v: (v - mean) / (deviation + epsilon))

    gaps = F.zip_with(standard(a), standard(b), lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g))
