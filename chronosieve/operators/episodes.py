"""Episodes around interventions: what was measured before, trajectories after on one grid, context and features.

A series is an array from the first aggregation on. Its place on the grid, its trend and
its features are functions of arrays, so a grid point is never a row, and one
shuffle on the episode serves all series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.direction import severity_bin
from ..functions.timewin import DAY_US, HOUR_US, micros_between

GRID = 96


def on_grid(xs: Column, ys: Column, n: int = GRID) -> Column:
    """The series on n evenly spaced points from its first to its last x (ascending, the first 0), linear in between.

    Of points of one x the last counts. One point or no extent gives the first value throughout.
    """
    whole = F.element_at(xs, -1)

    def at(i):
        x = F.when(i == n - 1, whole).otherwise(i * (whole / (n - 1)))
        j = F.size(F.filter(xs, lambda v: v <= x))
        x0, x1, y0, y1 = F.get(xs, j - 1), F.get(xs, j), F.get(ys, j - 1), F.get(ys, j)
        return F.when(j >= F.size(xs), F.element_at(ys, -1)).otherwise((y1 - y0) / (x1 - x0) * (x - x0) + y0)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(whole == 0, F.get(ys, F.lit(0))).otherwise(at(i)))


def windows(events: DataFrame, interventions: DataFrame, hours: float = 48) -> DataFrame:
    """Measurements around each intervention (subject, episode, t): episode, subject, t, label, ts, event_id, value, post; dealt by subject."""
    most = int(hours * HOUR_US)
    us = micros_between("t", "ts")
    measured = events.where("role = 'measurement' and value is not null").select("subject", F.col("name").alias("label"), "ts", "event_id", "value")
    return measured.join(interventions.select("subject", "episode", "t"), "subject").where(us.between(-most, most)).withColumn("post", F.col("ts") > F.col("t"))


def series(seen: DataFrame) -> DataFrame:
    """One row for each episode and label: pre (ts, value), trend of pre, post on the grid, and how many measurements made it."""
    entry = F.struct("ts", "event_id", "value")
    hours = micros_between("t", "ts") / F.lit(float(HOUR_US))
    before = ~F.col("post")
    x, y = F.when(before, hours), F.when(before, F.col("value"))
    g = seen.groupBy("subject", "episode", "label").agg(
        F.array_sort(F.collect_list(F.when(before, entry))).alias("pre"), F.array_sort(F.collect_list(F.when(F.col("post"), entry))).alias("post"),
        F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    )
    n = F.size("pre")
    flat = (n < 2) | F.coalesce(F.col("sxx") == 0, F.lit(True))
    slope = F.when(flat, 0.0).otherwise(F.col("slope"))
    rest = F.sqrt(F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / n)
    direction = F.when(F.abs(slope) < 0.001, "stable").when(slope > 0, "rising").otherwise("falling")
    first = F.get("post", F.lit(0))["ts"]
    seconds = F.transform("post", lambda p: micros_between(first, p["ts"]) / F.lit(1e6))
    trend = F.when(n > 0, F.struct(F.round(slope, 4).alias("slope"), F.round(slope * 48, 3).alias("slope_48h"), direction.alias("direction"), F.round(F.when(flat, 0.0).otherwise(rest), 4).alias("volatility"), n.alias("n")))
    post = F.when(F.size("post") > 0, F.struct(on_grid(seconds, F.transform("post", lambda p: p["value"])).alias("grid"), first.alias("t_start"), F.element_at("post", -1)["ts"].alias("t_end"), F.size("post").alias("n")))
    return g.select("subject", "episode", "label", "pre", trend.alias("trend"), post.alias("post"))


def context(events: DataFrame, interventions: DataFrame, conditions: int = 10, drugs: int = 15) -> DataFrame:
    """episode, diagnoses, medications: the first different ones, up to the intervention, of the visit of the first event less than a day away that has one."""
    own = events.join(interventions.select("subject", "episode", "t"), "subject").where(F.col("visit").isNotNull())
    gap = F.abs(micros_between("t", "ts"))
    at = F.struct("ts", "event_id")
    day = own.where(gap < DAY_US).groupBy("subject", "episode").agg(F.min_by("visit", at).alias("visit"))
    listed = own.where((F.col("ts") <= F.col("t")) & F.col("role").isin("condition", "drug") & F.col("name").isNotNull()).join(day, ["subject", "episode", "visit"])
    first = listed.groupBy("subject", "episode", "role", "name").agg(F.min(at).alias("at"))
    names = lambda role, most: F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("at", "name")))), 1, most), lambda x: x["name"])
    return first.groupBy("subject", "episode").agg(names("condition", conditions).alias("diagnoses"), names("drug", drugs).alias("medications"))


def banded(value: Column, limits: list[float]) -> Column:
    """Points of a value: how many of the limits it reaches (ascending limits) or stays under (descending); null has none."""
    up = limits[0] < limits[-1]
    return sum((F.when((value >= x) if up else (value < x), 1).otherwise(0) for x in limits), F.lit(0))


def _starts(prefixes: list[str]):
    return lambda text: reduce(lambda a, b: a | b, [text.startswith(x) for x in prefixes])


def episodes(events: DataFrame, interventions: DataFrame, ranges: dict[str, tuple[float, float]], bands: dict[str, list[float]], groups: dict[str, list[str]], hours: float = 48) -> DataFrame:
    """One row for each intervention (subject, episode, t, kind) with anything measured after it.

    pre: all measurements before, by time and label; post: for each label the trajectory on
    the grid; context; severity from the first value of each banded label, its bin; flags
    of groups of diagnoses by prefix; the trend of each label before; first values in
    units of a quarter of their range. ranges, bands, groups are rule tables.
    """
    per = series(windows(events, interventions, hours))
    labels = per.groupBy("subject", "episode").agg(F.array_sort(F.collect_list(F.struct("label", F.struct("pre", "trend", "post").alias("s")))).alias("labels"))
    labels = labels.where(F.exists("labels", lambda x: x["s"]["post"].isNotNull()))
    out = interventions.join(labels, ["subject", "episode"]).join(context(events, interventions), ["subject", "episode"], "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("diagnoses", "medications")})
    first = lambda label: F.get(F.transform(F.filter("labels", lambda x: x["label"] == label), lambda x: F.get(x["s"]["pre"], F.lit(0))["value"]), F.lit(0))
    score = F.least(reduce(lambda a, b: a + b, [banded(first(k), limits) for k, limits in bands.items()]), F.lit(24))
    flat = F.flatten(F.transform("labels", lambda x: F.transform(x["s"]["pre"], lambda p: F.struct(p["ts"].alias("ts"), x["label"].alias("label"), p["event_id"].alias("event_id"), p["value"].alias("value")))))
    flags = [F.exists("diagnoses", _starts(prefixes)).cast("int").alias(g) for g, prefixes in groups.items()]
    shift = [F.round((first(k) - (low + high) / 2) / ((high - low) / 4), 3).alias(k) for k, (low, high) in ranges.items()]
    kept = lambda field: F.transform(F.filter("labels", lambda x: x["s"][field].isNotNull()), lambda x: F.struct(x["label"].alias("label"), x["s"][field].alias(field)))
    return out.select(
        "subject", "episode", "kind", "t", "diagnoses", "medications", F.array_sort(flat).alias("pre"), kept("post").alias("post"), kept("trend").alias("trends"),
        score.alias("severity"), severity_bin(score).alias("severity_bin"), F.struct(*flags).alias("flags"), F.struct(*shift).alias("shifts"),
    )
