"""Series of one subject in time: neighbours, pairs, sessions, grids, slopes.

All of it is window functions and joins with an equality key on the subject, so
one shuffle on the subject serves each operator. Every ordering ends in a unique
tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import direction as D
from ..functions.timewin import DAY_US, hours_between, micros_between


def in_time(keys: list[str], t: str = "ts", tie: str = "event_id"):
    return Window.partitionBy(*keys).orderBy(t, tie)


def next_pairs(events: DataFrame, keys: list[str], least_h: float = 1, most_h: float = 48, t: str = "ts", v: str = "value", tie: str = "event_id") -> DataFrame:
    """Each measurement with the next one of its series, if they are least_h to most_h apart and differ."""
    w = in_time(keys, t, tie)
    pairs = events.select(*keys, tie, F.col(v).alias("before"), F.lead(v).over(w).alias("after"), F.lead(tie).over(w).alias("next_id"), hours_between(t, F.lead(t).over(w)).alias("hours_ahead"), F.row_number().over(w).cast("long").alias("n_context"))
    pairs = pairs.where(F.col("hours_ahead").between(least_h, most_h) & (F.col("before") != F.col("after")))
    return pairs.withColumn("direction", D.direction("before", "after")).withColumn("difficulty", D.difficulty("n_context"))


def ordered_pairs(events: DataFrame, keys: list[str], least_h: float = 4, most_h: float = 48, t: str = "ts", v: str = "value", tie: str = "event_id") -> DataFrame:
    """All pairs (visible before target) of a series that are least_h to most_h apart, with the trend up to the visible one.

    A time bucket of most_h joins each row with its own and the next bucket only,
    so a long series costs its near pairs and not the square of its length.
    """
    w = in_time(keys, t, tie)
    width = F.lit(int(most_h * 3600))
    second = F.floor(micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), t) / 1_000_000)
    rows = events.select(*keys, F.col(tie).alias("id"), F.col(t).alias("t"), F.col(v).alias("v"), F.lag(v).over(w).alias("v_prev"), F.row_number().over(w).alias("i"), F.floor(second / width).alias("__cell"))
    seen = rows.withColumn("__cell", F.explode(F.array("__cell", F.col("__cell") + 1))).alias("a")
    b = rows.alias("b")
    gap = hours_between(F.col("a.t"), F.col("b.t"))
    same = F.lit(True)
    for k in [*keys, "__cell"]:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = seen.join(b, same & (F.col("a.i") < F.col("b.i")) & gap.between(least_h, most_h))
    return joined.select(*[F.col(f"a.{k}") for k in keys], F.col("a.id").alias("visible_id"), F.col("b.id").alias("target_id"), F.col("a.v_prev").alias("v_prev"), F.col("a.v").alias("v_visible"), F.col("b.v").alias("v_target"), gap.alias("gap_hours"), (F.col("b.i") - F.col("a.i") - 1).cast("long").alias("n_between"))


def trend_reversals(events: DataFrame, keys: list[str], **window) -> DataFrame:
    """Ordered pairs whose visible trend (from the measurement before) and actual direction differ."""
    pairs = ordered_pairs(events, keys, **window).where(F.col("v_prev").isNotNull())
    pairs = pairs.withColumn("visible_trend", D.direction("v_prev", "v_visible")).withColumn("actual_dir", D.direction("v_visible", "v_target"))
    return pairs.where(F.col("visible_trend") != F.col("actual_dir")).withColumn("reversal_type", F.concat_ws("_to_", "visible_trend", "actual_dir"))


def best_window(pairs: DataFrame, subject: str) -> DataFrame:
    """The window of each subject with the largest score: change, measurements between, a bonus for 6 to 24 hours."""
    change = F.when(F.col("v_visible") > 0, F.abs(F.col("v_target") - F.col("v_visible")) / F.col("v_visible")).otherwise(0.0)
    scored = pairs.withColumn("score", 3 * change + 0.01 * F.col("n_between") + D.gap_bonus("gap_hours"))
    w = Window.partitionBy(subject).orderBy(F.desc("score"), "target_id", "visible_id")
    return scored.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def sessions(events: DataFrame, subject: str, gap_us: int = 4 * DAY_US, t: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds `session`, from 1: a new one starts where the gap to the event before is gap_us or more."""
    w = in_time([subject], t, tie)
    new = F.when(micros_between(F.lag(t).over(w), t) >= gap_us, 1).otherwise(0)
    return events.withColumn("__new", new).withColumn("session", (F.sum("__new").over(w) + 1).cast("long")).drop("__new")


def session_panels(events: DataFrame, subject: str, kind: str, v: str = "value", t: str = "ts", tie: str = "event_id", gap_us: int = 4 * DAY_US, least: int = 3) -> DataFrame:
    """First value of each kind in each session, for sessions with at least `least` kinds."""
    s = sessions(events, subject, gap_us, t, tie)
    panel = s.groupBy(subject, "session", kind).agg(F.min_by(v, F.struct(t, tie)).alias("first_value"))
    return panel.withColumn("n_kinds", F.count(F.lit(1)).over(Window.partitionBy(subject, "session"))).where(F.col("n_kinds") >= least)


def resampled(points: DataFrame, keys: list[str], n: int = 96, x: str = "x", y: str = "y", tie: str = "event_id") -> DataFrame:
    """The series on n evenly spaced points from its first to its last, linear in between.

    One point or no extent in time gives a constant: the first value.
    """
    w = in_time(keys, x, tie)
    whole = Window.partitionBy(*keys)
    seg = points.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.min(x).over(whole).alias("lo"), F.max(x).over(whole).alias("hi"), F.row_number().over(w).alias("i"))
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    flat = (F.col("hi") == F.col("lo")) & (F.col("i") == 1)
    at = F.when(F.col("hi") > F.col("lo"), F.col("lo") + F.col("idx") * step).otherwise(F.col("lo"))
    grid = seg.where(((F.col("x1") > F.col("x0")) & (F.col("hi") > F.col("lo"))) | flat)
    # a segment makes its own grid points; it owns those after its start, the first segment also the start
    first = F.when(flat, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((F.col("x0") - F.col("lo")) / step).cast("int")))
    last = F.when(flat, F.lit(n - 1)).otherwise(F.least(F.lit(n - 1), F.ceil((F.col("x1") - F.col("lo")) / step).cast("int")))
    rows = grid.withColumn("idx", F.explode(F.sequence(first, last))).withColumn("xx", at)
    mine = flat | ((F.col("xx") > F.col("x0")) & (F.col("xx") <= F.col("x1"))) | ((F.col("idx") == 0) & (F.col("x0") == F.col("lo"))) | ((F.col("idx") == n - 1) & (F.col("x1") == F.col("hi")) & (F.col("xx") > F.col("x1")))
    y_at = F.when(flat, F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.least("xx", "x1") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return rows.where(mine).select(*keys, F.col("idx").cast("long").alias("idx"), y_at.alias("v"))


def slopes(points: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Least-squares slope and population deviation from the line, for series of at least two points in time."""
    p = points.select(*keys, x.alias("x"), y.alias("y"))
    fit = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    rest = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    return fit.where((F.col("n") >= 2) & (F.col("sxx") > 0)).select(*keys, "n", "slope", F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("n")).alias("volatility"))


def inflections(series: DataFrame, keys: list[str], idx: str = "idx", v: str = "v", digits: int = 9) -> DataFrame:
    """Where the second difference is largest in size (to so many digits); the first such place."""
    w = Window.partitionBy(*keys).orderBy(idx)
    d2 = series.select(*keys, (F.col(idx) - 2).alias("at"), (F.col(v) - 2 * F.lag(v, 1).over(w) + F.lag(v, 2).over(w)).alias("d2"))
    return d2.where("d2 is not null").groupBy(*keys).agg(F.max_by("at", F.struct(F.round(F.abs("d2"), digits), -F.col("at"))).alias("inflection_idx"))
