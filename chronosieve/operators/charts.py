"""Whole charts up to a cut-off: many tables deduplicated, capped by the subject's own volume and listed, with one shuffle on the subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY = ["ts", "event_id", "code", "name", "value"]


def capped_measurements(rows: DataFrame, subject: str, pinned: Column, known: Column, cap: int, heavy_cap: int, heavy: int) -> DataFrame:
    """The measurements to keep, and all other rows: adds total and cap of the subject's measurements.

    A subject with more than `heavy` measurements has the lower cap. Pinned ones all stay. What is
    left of the cap goes to known ones: all, and then the oldest unknown ones, or if they
    do not fit, the newest of them. Measurements without value count, but do not stay.
    """
    measured = F.col("role") == "measurement"
    has = measured & F.col("value").isNotNull()
    kind = F.when(~has, "none").when(pinned, "pinned").when(known, "known").otherwise("unknown")
    whole = Window.partitionBy(subject)
    own = Window.partitionBy(subject, "__kind")
    count = lambda c: F.sum(c.cast("long")).over(whole)
    out = rows.withColumn("__kind", kind).withColumns({"total": count(measured), "__pinned": count(F.col("__kind") == "pinned"), "__known": count(F.col("__kind") == "known")})
    out = out.withColumn("cap", F.when(F.col("total") > heavy, heavy_cap).otherwise(cap)).withColumn("__left", F.greatest(F.lit(0), F.col("cap") - F.col("__pinned")))
    out = out.withColumns({"__old": F.row_number().over(own.orderBy("ts", "event_id")), "__new": F.row_number().over(own.orderBy(F.desc("ts"), F.desc("event_id")))})
    fit = F.col("__known") <= F.col("__left")
    k = F.col("__kind")
    keep = (k == "pinned") | ((k == "known") & (fit | (F.col("__new") <= F.col("__left")))) | ((k == "unknown") & fit & (F.col("__old") <= F.col("__left") - F.col("__known")))
    return out.where(~measured | keep).drop("__kind", "__pinned", "__known", "__left", "__old", "__new")


def chart_until(events: DataFrame, cases: DataFrame, subject: str, tables: list[str], once_ever: list[str], pinned: Column, known: Column, cap: int, heavy_cap: int, heavy: int) -> DataFrame:
    """A row for each case (subject, cutoff): an array of entries for each table of events up to the cut-off, and total, cap of its measurements.

    events: subject, ts, event_id, role, code, name, value. Measurements are capped; of all other
    tables the first entry of a code on a day stays (of those in `once_ever`, of a code at
    all). The cases' subjects are different. All windows and the last aggregation are on the subject, so the join's
    shuffle serves them all; entries go before they are listed.
    """
    role = F.col("role")
    seen = events.where(role.isin(*tables)).join(cases.select(subject, "cutoff"), subject).where(F.col("ts") <= F.col("cutoff"))
    capped = capped_measurements(seen, subject, pinned, known, cap, heavy_cap, heavy)
    day = F.when(role.isin(*once_ever), F.lit(None).cast("date")).otherwise(F.to_date("ts"))
    alone = F.when(role == "measurement", F.col("event_id"))
    first = F.row_number().over(Window.partitionBy(subject, "role", "code", "__day", "__alone").orderBy("ts", "event_id"))
    once = capped.withColumns({"__day": day, "__alone": alone}).withColumn("__first", first).where("__first = 1")
    listed = [F.array_sort(F.collect_list(F.when(role == t, F.struct(*ENTRY)))).alias(t) for t in tables]
    return once.groupBy(subject).agg(*listed, F.first("total").alias("total"), F.first("cap").alias("cap"))
