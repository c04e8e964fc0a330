"""What lies before, around and after a subject's anchor in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.direction import direction_in_range
from ..functions.timewin import DAY_US, hours_between, micros_between, whole_days


def first_event(events: DataFrame, subject: str, kind: Column, t: str = "ts", tie: str = "event_id") -> DataFrame:
    """The anchor of each subject: its first event of a kind."""
    return events.where(kind).groupBy(subject).agg(F.min_by(tie, F.struct(t, tie)).alias("anchor_id"), F.min(t).alias("anchor_ts"))


def before_anchor(events: DataFrame, anchors: DataFrame, subject: str, t: str = "ts", inclusive: bool = True) -> DataFrame:
    at = F.col(t) <= F.col("anchor_ts") if inclusive else F.col(t) < F.col("anchor_ts")
    return events.join(anchors, subject).where(at)


def asof_backward(left: DataFrame, right: DataFrame, subject: str, t: str = "ts", tie: str = "event_id", v: str = "value") -> DataFrame:
    """For each left row the last right row of its subject at or before it, or nulls.

    One pass over the union in time order: the last right row so far is carried
    forward, so neither side is multiplied.
    """
    a = left.select(subject, F.col(t).alias("t"), F.col(tie).alias("id"), F.lit(1).alias("side"), F.lit(None).cast("struct<v:double,id:bigint>").alias("r"))
    b = right.select(subject, F.col(t).alias("t"), F.col(tie).alias("id"), F.lit(0).alias("side"), F.struct(F.col(v).cast("double").alias("v"), F.col(tie).cast("bigint").alias("id")).alias("r"))
    w = Window.partitionBy(subject).orderBy("t", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("last", F.last("r", ignorenulls=True).over(w))
    return both.where("side = 1").select(subject, F.col("id").alias(tie), F.col("last.id").alias("asof_id"), F.col("last.v").alias("asof_value"))


def asof_nearest(left: DataFrame, right: DataFrame, subject: str, t: str = "ts", tie: str = "event_id") -> DataFrame:
    """For each left row the right row of its subject nearest in time; ties to the earlier, then the smaller id.

    The last right row before and the first one after are carried through the
    union in time order, and the nearer of the two is taken.
    """
    a = left.select(subject, F.col(t).alias("t"), F.col(tie).alias("id"), F.lit(1).alias("side"))
    b = right.select(subject, F.col(t).alias("t"), F.col(tie).alias("id"), F.lit(0).alias("side"))
    at = F.when(F.col("side") == 0, F.struct("t", "id"))
    back = Window.partitionBy(subject).orderBy("t", "side", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(subject).orderBy("t", F.desc("side"), "id").rowsBetween(0, Window.unboundedFollowing)
    both = a.unionByName(b).withColumn("prev", F.last(at, ignorenulls=True).over(back)).withColumn("next", F.first(at, ignorenulls=True).over(ahead)).where("side = 1")
    earlier = micros_between("prev.t", "t") <= micros_between("t", "next.t")
    take = F.when(F.col("next").isNull() | F.coalesce(earlier, F.lit(False)), F.col("prev.id")).otherwise(F.col("next.id"))
    return both.select(subject, F.col("id").alias(tie), take.alias("nearest_id"))


def interval_join(triggers: DataFrame, procedures: DataFrame, subject: str, least: int = 1, most: int = 60, t: str = "ts", tie: str = "event_id", also: list[str] = ()) -> DataFrame:
    """Trigger and later procedure of a subject, least to most whole days apart; `also`: further columns that must be equal.

    A trigger meets the procedures of its own and the next cell of most + 1 days only,
    so a long history costs its near pairs.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    cell = F.floor(micros_between(epoch, F.col(t).cast("timestamp_ntz")) / F.lit(float((most + 1) * DAY_US)))
    a = triggers.select(subject, *also, F.col(tie).alias("trigger_id"), F.col(t).alias("t0"), "threshold", "value", F.explode(F.array(cell, cell + 1)).alias("__cell"))
    b = procedures.select(subject, *also, F.col(tie).alias("procedure_id"), F.col(t).alias("t1"), cell.alias("__cell"))
    days = whole_days("t0", "t1")
    return a.join(b, [subject, *also, "__cell"]).where(days.between(least, most)).select(subject, *also, "trigger_id", "procedure_id", days.alias("days"), ((F.col("value") - F.col("threshold")) / F.col("threshold")).alias("severity"))


def masked(events: DataFrame, questions: DataFrame, subject: str, target: Column, t: str = "ts") -> DataFrame:
    """What may be seen of each question: the target series up to t_visible, all others up to t_target."""
    return events.join(questions, subject).where(F.when(target, F.col(t) <= F.col("t_visible")).otherwise(F.col(t) <= F.col("t_target")))


def look_back(events: DataFrame, anchors: DataFrame, subject: str, target: Column, days: float = 90, t: str = "ts") -> DataFrame:
    """Events up to the anchor: the target series from its beginning, all others of the last `days` only."""
    return before_anchor(events, anchors, subject, t).where(target | (micros_between(t, "anchor_ts") <= int(days * DAY_US)))


def around(events: DataFrame, anchors: DataFrame, subject: str, before_days: float = 3, after_days: float = 1, t: str = "ts") -> DataFrame:
    """Events from before_days before the anchor to after_days after it, both ends included."""
    us = micros_between("anchor_ts", t)
    return events.join(anchors, subject).where(us.between(-int(before_days * DAY_US), int(after_days * DAY_US)))


def visit_spans(events: DataFrame, subject: str, visit: str, t: str = "ts") -> DataFrame:
    return events.where(F.col(visit).isNotNull()).groupBy(subject, visit).agg(F.min(t).alias("t_min"), F.max(t).alias("t_max"))


def straddling_visit(triggers: DataFrame, visits: DataFrame, subject: str, ident: str, visit: str, slack_days: float = 1, t: str = "ts") -> DataFrame:
    """For each trigger the first visit of its subject that begins by then and ends at most slack_days before, or null."""
    late = micros_between("t_max", t) <= int(slack_days * DAY_US)
    held = triggers.select(subject, ident, t).join(visits, subject).where((F.col("t_min") <= F.col(t)) & late)
    first = held.groupBy(subject, ident).agg(F.min_by(visit, F.struct("t_min", visit)).alias("visit"))
    return triggers.select(subject, ident).join(first, [subject, ident], "left")


def visit_within_a_day(triggers: DataFrame, events: DataFrame, subject: str, ident: str, visit: str, t: str = "ts", tie: str = "event_id") -> DataFrame:
    """For each trigger the visit of the first event of its subject less than a day away that has one, or null."""
    day = F.floor(micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(t).cast("timestamp_ntz")) / F.lit(float(DAY_US)))
    a = triggers.select(subject, ident, F.col(t).alias("__t0"), F.explode(F.array(day - 1, day, day + 1)).alias("__day"))
    b = events.where(F.col(visit).isNotNull()).select(subject, F.col(visit).alias("__v"), F.col(t).alias("__t1"), F.col(tie).alias("__tie"), day.alias("__day"))
    near = a.join(b, [subject, "__day"]).where(F.abs(micros_between("__t0", "__t1")) < DAY_US)
    first = near.groupBy(subject, ident).agg(F.min_by("__v", F.struct("__t1", "__tie")).alias("visit"))
    return triggers.select(subject, ident).join(first, [subject, ident], "left")


def pre_post(anchors: DataFrame, events: DataFrame, subject: str, hours: float, t: str = "ts") -> DataFrame:
    """Events within [anchor - hours, anchor] (side pre) and (anchor, anchor + hours] (side post)."""
    h = hours_between("anchor_ts", t)
    side = F.when(h.between(-hours, 0), "pre").when((h > 0) & (h <= hours), "post")
    return events.join(anchors, subject).withColumn("side", side).where("side is not null").withColumn("h", h)


def late_enough(anchors: DataFrame, arrival: str, hours: float = 6) -> DataFrame:
    """Anchors at least so many hours after the arrival."""
    return anchors.where(micros_between(arrival, "anchor_ts") >= int(hours * 3_600_000_000))


def eligible(windows: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Counts before and after, for those with at least `least` of both."""
    n = windows.groupBy(*by).agg(F.count_if(F.col("side") == "pre").alias("n_pre"), F.count_if(F.col("side") == "post").alias("n_post"))
    return n.where((F.col("n_pre") >= least) & (F.col("n_post") >= least))


def trajectory(windows: DataFrame, by: list[str], v: str = "value", t: str = "ts", tie: str = "event_id") -> DataFrame:
    """Last value before, median after (NaN left out), and the direction against a reference range `low`, `high`."""
    clean = windows.where(F.col(v).isNotNull() & ~F.isnan(v))
    g = clean.groupBy(*by).agg(
        F.max_by(F.when(F.col("side") == "pre", F.col(v)), F.when(F.col("side") == "pre", F.struct(t, tie))).alias("baseline"),
        F.median(F.when(F.col("side") == "post", F.col(v))).alias("post_rep"), F.first("low").alias("low"), F.first("high").alias("high"),
        F.count_if(F.col("side") == "pre").alias("n_pre"), F.count_if(F.col("side") == "post").alias("n_post"),
    )
    return g.where("baseline is not null and post_rep is not null").withColumn("direction", direction_in_range("baseline", "post_rep", "low", "high"))


def summary(rows: DataFrame, by: list[str], v: str = "value", t: str = "ts", tie: str = "event_id", abnormal: Column | None = None, unit: str | None = None) -> DataFrame:
    """Per series: count, first, latest, smallest, largest value and whether any is abnormal; series without values go.

    With `unit`: also the unit of the last row, whether or not that row has a value.
    """
    order = F.struct(t, tie)
    has = F.col(v).isNotNull()
    g = rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.min_by(v, F.when(has, order)).alias("first_value"), F.max_by(v, F.when(has, order)).alias("latest_value"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.bool_or(abnormal if abnormal is not None else F.lit(False)).alias("any_abnormal"),
        *([F.max_by(unit, order).alias("unit")] if unit else []),
    )
    return g.where("n > 0")


def prior_distinct(events: DataFrame, anchors: DataFrame, subject: str, what: str, t: str = "ts") -> DataFrame:
    """Different things before the anchor, sorted, as one string."""
    prior = before_anchor(events, anchors, subject, t, inclusive=False).select(subject, what).distinct()
    return prior.groupBy(subject).agg(F.concat_ws(",", F.array_sort(F.collect_list(what))).alias("prior"))
