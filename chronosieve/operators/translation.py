"""Cases moved from one population to another: values and thresholds by their deviations, and panels that only one population's ranges explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.direction import rounded


def moved(value: Column, a: str, b: str) -> Column:
    """A value of population a at the same deviations from the mean of population b."""
    return F.col(f"{b}_mean") + (value - F.col(f"{a}_mean")) / F.col(f"{a}_sd") * F.col(f"{b}_sd")


def both_populations(source: DataFrame, target: DataFrame) -> DataFrame:
    """lab, s_low, s_high, s_mean, s_sd, t_low, ...: the labs that both populations have. A row for each lab."""
    named = lambda df, p: df.select("lab", *[F.col(c).alias(f"{p}_{c}") for c in ("low", "high", "mean", "sd")])
    return named(source, "s").join(named(target, "t"), "lab")


def side(value: Column, low: str, high: str) -> Column:
    return F.when(value > F.col(high), "HIGH").when(value < F.col(low), "LOW").otherwise("NORMAL")


def hits(panels: DataFrame, rules: DataFrame, case: list[str]) -> DataFrame:
    """The rules that a case's panel meets: case, lab, value, direction, threshold, action, priority. rules: few rows."""
    v, t = F.col("value"), F.col("threshold")
    hit = F.when(F.col("direction") == "above", v > t).otherwise(v < t)
    return panels.join(F.broadcast(rules), "lab").where(hit).select(*case, "lab", "value", "direction", "threshold", "action", "priority")


def translated_cases(panels: DataFrame, rules: DataFrame, source: DataFrame, target: DataFrame, case: list[str], least: int = 3) -> DataFrame:
    """panels: case, lab, value -> one row for each case that a rule hits: panel, hits and the first hit (by priority), all in the target population.

    Values and thresholds keep their deviations from the mean and are rounded to one digit, deviations
    to two, halves away from zero (see rounded). Labs that a population lacks go; cases with fewer than
    `least` labs left, or whose first hit went, do too. The tables of labs and rules go to all tasks, as
    they have a row for each lab or rule.
    """
    known = F.broadcast(both_populations(source, target))
    x = moved(F.col("value"), "s", "t")
    z = (F.col("value") - F.col("s_mean")) / F.col("s_sd")
    entry = F.struct("lab", rounded(x, 1).alias("value"), rounded(z, 2).alias("z"), side(x, "t_low", "t_high").alias("side"), F.col("t_low").alias("low"), F.col("t_high").alias("high"))
    panel = panels.join(known, "lab").groupBy(*case).agg(F.array_sort(F.collect_list(entry)).alias("panel")).where(F.size("panel") >= least)
    found = hits(panels, rules, case)
    first = found.groupBy(*case).agg(F.min_by(F.struct("lab", "action"), F.struct("priority", "lab", "threshold")).alias("primary"), F.count(F.lit(1)).alias("n_source_hits"))
    hit = F.struct("priority", "lab", rounded(x, 1).alias("value"), rounded(moved(F.col("threshold"), "s", "t"), 1).alias("threshold"), "direction", "action", rounded(z, 2).alias("z"))
    listed = found.join(known, "lab").groupBy(*case).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    out = panel.join(first, case).join(listed, case)
    pivot = F.get(F.filter("hits", lambda h: (h["lab"] == F.col("primary.lab")) & (h["action"] == F.col("primary.action"))), F.lit(0))
    return out.withColumn("pivot", pivot).where(F.col("pivot").isNotNull()).drop("primary")


def natural(value: Column) -> Column:
    """A value moved to the target population if it is normal there, the middle of the range if not or if there is none."""
    x = moved(value, "s", "t")
    middle = (F.col("t_low") + F.col("t_high")) / 2
    return F.round(F.when((x >= F.col("t_low")) & (x <= F.col("t_high")), x).otherwise(middle), 1)


def deceptive_cases(panels: DataFrame, pivots: DataFrame, source: DataFrame, target: DataFrame, case: list[str], each: int) -> DataFrame:
    """Cases whose pivot value is normal in the source population but not in the target one, with everything else made normal there.

    pivots: lab, action; few rows. For each of them the `each` cases whose value is least outside the target range,
    first by case, are kept. Of each: the panel over all labs of both populations, the pivot's value as it is and all
    others moved (see natural); the counterfactual panel, with the pivot in the middle; which values had to be
    moved to the middle; and by how many percent of the limit the pivot lies outside.
    """
    from .cohort import per_group

    known = both_populations(source, target)
    v = F.round("value", 1)
    inside = (v >= F.col("s_low")) & (v <= F.col("s_high"))
    limit = F.when(v > F.col("t_high"), F.col("t_high")).when(v < F.col("t_low"), F.col("t_low"))
    off = F.abs(v - limit) / limit * 100
    own = panels.join(F.broadcast(known.join(pivots, "lab")), "lab").where(inside & limit.isNotNull())
    own = own.select(*case, F.col("lab").alias("pivot"), "action", v.alias("pivot_value"), off.alias("off"), F.when(v > F.col("t_high"), "HIGH").otherwise("LOW").alias("direction"))
    chosen = per_group(own, ["pivot", "action"], [F.col("off"), *map(F.col, case)], each).drop("rank")
    # every lab of the populations, whether or not the case has it: labs times chosen cases
    wide = chosen.join(F.broadcast(known.agg(F.collect_list(F.struct(*known.columns)).alias("labs"))), how="cross")  # one row
    wide = wide.select(*chosen.columns, F.explode("labs").alias("l")).select(*chosen.columns, "l.*")
    mine = panels.join(chosen.select(*case).distinct(), case, "left_semi").select(*case, "lab", F.col("value").alias("__v"))
    full = wide.join(mine, [*case, "lab"], "left")
    is_pivot = F.col("lab") == F.col("pivot")
    middle = F.round((F.col("t_low") + F.col("t_high")) / 2, 1)
    at = natural(F.col("__v"))
    entry = lambda x: F.array_sort(F.collect_list(F.struct("lab", x.alias("value"))))
    put = F.col("__v").isNull() | ~moved(F.col("__v"), "s", "t").between(F.col("t_low"), F.col("t_high"))
    return full.groupBy(*chosen.columns).agg(
        entry(F.when(is_pivot, F.col("pivot_value")).otherwise(at)).alias("panel"), entry(F.when(is_pivot, middle).otherwise(at)).alias("counterfactual"),
        F.array_sort(F.collect_list(F.when(~is_pivot & put, F.col("lab")))).alias("put_to_middle"),
    ).withColumn("off", F.round("off", 1))
