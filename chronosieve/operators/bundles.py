"""Next-event bundles: a subject's most severe trigger that a fitting procedure follows, with the record around it, whole and trimmed.

Events have the columns of a chart: subject, time, id, role (measurement, procedure,
condition, drug, visit), code, name, value and visit, which may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timewin import DAY_US, micros_between, whole_days
from ..session import saved
from .cohort import capped, keep_first, per_group

MASK = "___"


def triggered(measured: DataFrame, rules: DataFrame) -> DataFrame:
    """Measurements beyond a rule's threshold, with the rule's action and a severity relative to the threshold. rules: code, direction, threshold, action; few rows."""
    above = F.col("direction") == "above"
    hit = F.when(above, F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    severity = F.when(above, F.col("value") - F.col("threshold")).otherwise(F.col("threshold") - F.col("value")) / F.col("threshold")
    return measured.join(F.broadcast(rules), "code").where(hit).select("subject", "ts", "event_id", "action", severity.alias("severity"))


def followed(triggers: DataFrame, procedures: DataFrame, allowed: DataFrame, least: int = 1, most: int = 60) -> DataFrame:
    """Per subject the most severe trigger with a procedure that its action allows, least to most whole days later.

    Ties go to the earlier trigger, then the earlier procedure. allowed: action, code; few rows.
    A trigger meets the procedures of its own and the next cell of most + 1 days only.
    """
    cell = F.floor(micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / F.lit(float((most + 1) * DAY_US)))
    a = triggers.select("subject", "action", "severity", F.col("ts").alias("t0"), F.col("event_id").alias("trigger_id"), F.explode(F.array(cell, cell + 1)).alias("__cell"))
    b = procedures.join(F.broadcast(allowed), "code").select("subject", "action", F.col("ts").alias("t1"), F.col("event_id").alias("procedure_id"), F.col("code").alias("procedure"), cell.alias("__cell"))
    near = a.join(b, ["subject", "action", "__cell"]).where(whole_days("t0", "t1").between(least, most))
    best = F.struct((-F.col("severity")).alias("s"), "t0", "trigger_id", "action", "t1", "procedure_id")
    return near.groupBy("subject").agg(F.min_by(F.struct("action", "severity", "t0", "trigger_id", "t1", "procedure_id", "procedure"), best).alias("best")).select("subject", "best.*")


def visits(events: DataFrame, kinds: list[tuple[str, str]], most_conditions: int = 8, most_drugs: int = 15, other: str = "Inpatient") -> DataFrame:
    """One row for each visit of a subject: its first and last time, its kind, and the first different conditions and drugs.

    kinds: (word, kind) in order; the first visit event in time whose name holds one decides.
    """
    of = events.where(F.col("visit").isNotNull())
    name = F.lower("name")
    kind = F.lit(None).cast("string")
    for word, k in reversed(kinds):
        kind = F.when(name.contains(word), k).otherwise(kind)
    kind = F.when(F.col("role") == "visit", kind)
    at = F.struct("ts", "event_id")
    spans = of.groupBy("subject", "visit").agg(F.min("ts").alias("t_min"), F.max("ts").alias("t_max"), F.coalesce(F.min_by(kind, F.when(kind.isNotNull(), at)), F.lit(other)).alias("kind"))
    listed = of.where(F.col("role").isin("condition", "drug") & F.col("name").isNotNull())
    first = listed.groupBy("subject", "visit", "role", "name").agg(F.min(at).alias("at"))
    most = F.when(F.col("role") == "condition", most_conditions).otherwise(most_drugs)
    nth = F.row_number().over(Window.partitionBy("subject", "visit", "role").orderBy("at"))
    first = first.withColumn("nth", nth).where(F.col("nth") <= most)
    names = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("nth", "name")))), lambda x: x["name"])
    lists = first.groupBy("subject", "visit").agg(names("condition").alias("diagnoses"), names("drug").alias("medications"))
    empty = F.array().cast("array<string>")
    return spans.join(lists, ["subject", "visit"], "left").withColumns({c: F.coalesce(c, empty) for c in ("diagnoses", "medications")})


def trigger_visit(cases: DataFrame, measured: DataFrame, spans: DataFrame, codes: DataFrame, slack_days: float = 1) -> DataFrame:
    """cases with `visit`: that of the trigger measurement nearest in time; if it has none, the first visit around the trigger; else null."""
    gap = F.abs(micros_between("ts", "t0"))
    near = measured.join(F.broadcast(codes), "code", "left_semi").join(cases.select("subject", "t0"), "subject")
    near = near.groupBy("subject").agg(F.min_by("visit", F.struct(gap.alias("gap"), "ts", "event_id")).alias("own"))
    around = spans.join(cases.select("subject", "t0"), "subject").where((F.col("t_min") <= F.col("t0")) & (micros_between("t_max", "t0") <= int(slack_days * DAY_US)))
    around = around.groupBy("subject").agg(F.min_by("visit", F.struct("t_min", "visit")).alias("straddling"))
    return cases.join(near, "subject", "left").join(around, "subject", "left").withColumn("visit", F.coalesce("own", "straddling")).drop("own", "straddling")


def window_labs(measured: DataFrame, cases: DataFrame, ranges: DataFrame, before_days: float = 3, after_days: float = 1) -> DataFrame:
    """Per subject the measurements around its trigger: the first of each label and day, rounded, with a flag against the label's range, by day and label."""
    us = micros_between("t0", "ts")
    some = measured.where(F.col("value").isNotNull()).join(cases.select("subject", "t0"), "subject").where(us.between(-int(before_days * DAY_US), int(after_days * DAY_US)))
    once = keep_first(some.withColumn("date", F.to_date("ts")), ["subject", "name", "date"], [F.col("ts"), F.col("event_id")])
    once = once.join(F.broadcast(ranges.withColumnRenamed("label", "name")), "name", "left")  # a row for each label
    flag = F.when(F.col("value") < F.col("low"), "low").when(F.col("value") > F.col("high"), "abnormal")
    entry = F.struct(F.col("date").cast("string").alias("date"), F.col("name").alias("label"), F.round("value", 2).cast("string").alias("value"), flag.alias("flag"), F.col("low").cast("string").alias("ref_lower"), F.col("high").cast("string").alias("ref_upper"))
    return once.groupBy("subject").agg(F.array_sort(F.collect_list(entry)).alias("lab_data"))


def bundles(
    events: DataFrame, people: DataFrame, rules: DataFrame, allowed: DataFrame, ranges: DataFrame, kinds: list[tuple[str, str]], masked: list[str], guidelines: str,
    per_action: int, cases: int, history: int = 5, age: int = 50,
) -> DataFrame:
    """Two rows for each case, copy `full` and `trimmed`: subject, action, procedure, age, gender, admit_date, diagnoses, medications, history, lab_data, guidelines.

    The `cases` most severe subjects are taken, `per_action` of an action at most; that
    many rows go to all tasks, and what follows reads their events only. The
    trimmed copy hides the values of the labels in `masked` and adds the guidelines. people: subject,
    birth_year, gender, where known.
    """
    measured = events.where("role = 'measurement'")
    found = followed(triggered(measured.where("value is not null"), rules), events.where("role = 'procedure'"), allowed)
    chosen = capped(found, ["action"], per_action, cases, [F.desc("severity"), F.col("subject")])
    chosen = F.broadcast(saved(chosen))  # `cases` rows at most
    own = events.join(chosen.select("subject"), "subject", "left_semi")
    measured = own.where("role = 'measurement'")
    spans = visits(own, kinds)
    held = trigger_visit(chosen, measured.where("value is not null"), spans, rules.select("code").distinct())

    both = spans.join(held.select("subject", F.col("visit").alias("__current")), "subject")
    is_current = F.col("visit").eqNullSafe(F.col("__current"))
    prior = per_group(both.where(~is_current), ["subject"], [F.desc("t_min"), F.desc("visit")], history)
    entry = F.struct(F.col("t_min").alias("t"), "visit", F.to_date("t_min").cast("string").alias("admit_date"), F.to_date("t_max").cast("string").alias("discharge_date"), F.col("kind").alias("admission_type"), "diagnoses", "medications")
    listed = prior.groupBy("subject").agg(F.array_sort(F.collect_list(entry)).alias("history"))
    listed = listed.withColumn("history", F.transform("history", lambda x: x.dropFields("t", "visit")))
    current = both.where(is_current).select("subject", F.to_date("t_min").alias("__admit"), "diagnoses", "medications")
    labs = window_labs(measured, chosen, ranges)

    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    kind_of = lambda df, c: dict(df.dtypes)[c]
    out = held.join(people, "subject", "left").join(current, "subject", "left").join(listed, "subject", "left").join(labs, "subject", "left").select(
        "subject", "action", "procedure", F.coalesce(F.year("t0") - F.col("birth_year"), F.lit(age)).cast("long").alias("age"), F.coalesce("gender", F.lit("Unknown")).alias("gender"),
        F.coalesce("__admit", F.to_date("t0")).cast("string").alias("admit_date"), empty("diagnoses", "array<string>"), empty("medications", "array<string>"),
        empty("history", kind_of(listed, "history")), empty("lab_data", kind_of(labs, "lab_data")),
    )
    return copies(out, masked, guidelines)


def copies(records: DataFrame, masked: list[str], guidelines: str) -> DataFrame:
    """Each record twice, from one pass: as it is, and with the values of some labels hidden and guidelines added."""
    trimmed = F.col("copy") == "trimmed"
    hide = lambda x: F.when(x["label"].isin(*masked), x.withField("value", F.lit(MASK))).otherwise(x)
    both = records.withColumn("copy", F.explode(F.array(F.lit("full"), F.lit("trimmed"))))
    return both.withColumns({"lab_data": F.when(trimmed, F.transform("lab_data", hide)).otherwise(F.col("lab_data")), "guidelines": F.when(trimmed, F.lit(guidelines))})


def as_text(entries: Column, fields: list[str]) -> Column:
    """A list of entries as text, for comparison: fields by '|', entries by ';'."""
    one = lambda x: F.concat_ws("|", *[F.coalesce(x[f] if f not in ("diagnoses", "medications") else F.array_join(x[f], ","), F.lit("-")) for f in fields])
    return F.array_join(F.transform(entries, one), ";")


def protected_timeline(seen: DataFrame, most: int) -> DataFrame:
    """seen: subject, ts, event_id, name, value, main -> subject, timeline, prior (its main entries).

    The first measurement of each label and minute; main ones all stay, and beyond `most` entries the oldest others go.
    """
    once = keep_first(seen.withColumn("minute", F.date_trunc("minute", "ts")), ["subject", "name", "minute"], [F.col("ts"), F.col("event_id")])
    newest = F.row_number().over(Window.partitionBy("subject", "main").orderBy(F.desc("minute"), F.desc("name")))
    kept = once.withColumns({"__main": F.count_if("main").over(Window.partitionBy("subject")), "__new": newest}).where(F.col("main") | (F.col("__new") <= F.greatest(F.lit(0), most - F.col("__main"))))
    entry = F.struct("minute", "name", "value", "event_id")
    return kept.groupBy("subject").agg(F.array_sort(F.collect_list(entry)).alias("timeline"), F.array_sort(F.collect_list(F.when(F.col("main"), entry))).alias("prior"))


def window_records(measured: DataFrame, cases: DataFrame, main: Column, most: int) -> DataFrame:
    """cases (subject, t_visible, t_target, ...) with the record that may be shown: the main series up to the visible value, all others up to the target."""
    seen = measured.withColumn("main", main).join(cases.select("subject", "t_visible", "t_target"), "subject")
    seen = seen.where(F.col("ts") <= F.when(F.col("main"), F.col("t_visible")).otherwise(F.col("t_target")))
    return cases.join(protected_timeline(seen, most), "subject")


def next_value_records(events: DataFrame, cases: DataFrame, main: Column, kinds: list[tuple[str, str]], days: float = 90, most: int = 80, conditions: int = 8, drugs: int = 12) -> DataFrame:
    """One row for each case (subject, t1, and what else it has): its timeline, earlier main values, and the conditions and drugs of its visit.

    The timeline holds the first measurement of each label and minute up to t1: the main label from the
    beginning, all others of the last `days`. Main ones all stay; beyond `most` entries the oldest others go.
    The visit is that of the main measurement nearest to t1; its lists end at t1 too. The cases' subjects are different.
    """
    seen = events.join(cases.select("subject", "t1"), "subject").where(F.col("ts") <= F.col("t1"))
    measured = seen.where("role = 'measurement' and value is not null").withColumn("main", main)
    recent = measured.where(F.col("main") | (micros_between("ts", "t1") <= int(days * DAY_US)))
    line = protected_timeline(recent, most)
    gap = F.struct(F.abs(micros_between("ts", "t1")).alias("gap"), "ts", "event_id")
    current = measured.where("main").groupBy("subject").agg(F.min_by("visit", gap).alias("visit"))
    lists = visits(seen.drop("t1"), kinds, conditions, drugs).select("subject", "visit", "diagnoses", "medications")
    held = current.join(lists, ["subject", "visit"], "left").drop("visit")
    out = cases.join(line, "subject").join(held, "subject", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("diagnoses", "medications")})


def admission_records(admissions: DataFrame, lines: DataFrame, diagnoses: int = 8, drugs: int = 12, drugs_now: int = 15) -> DataFrame:
    """One row for each subject: its earlier admissions in order, and the current one with its measurements.

    admissions: subject, visit, t, kind, part (prior or current; one current a subject). lines: visit, nth, date, diagnosis,
    drug, procedure, label, value, any of which may be null. Of an admission: the first diagnoses by nth, all
    procedures by date, the first different drugs by name; of the current one also the first value of each label and day.
    What is listed is cut for each admission before a subject's admissions meet.
    """
    own = Window.partitionBy("visit")
    some = lines.join(admissions.select("visit", "part"), "visit")
    once = F.row_number().over(Window.partitionBy("visit", "date", "label").orderBy("nth"))
    some = some.withColumns({"__d": F.count("diagnosis").over(own.orderBy("nth")), "__once": once})
    per = some.groupBy("visit").agg(
        F.array_sort(F.collect_list(F.when(F.col("diagnosis").isNotNull() & (F.col("__d") <= diagnoses), F.struct("nth", "diagnosis")))).alias("d"),
        F.array_sort(F.collect_list(F.when(F.col("procedure").isNotNull(), F.struct("date", "nth", "procedure")))).alias("p"),
        F.array_sort(F.collect_set("drug")).alias("m"),
        F.array_sort(F.collect_list(F.when((F.col("part") == "current") & F.col("label").isNotNull() & (F.col("__once") == 1), F.struct("date", "label", "value")))).alias("labs"),
    )
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(per.dtypes)[c]))
    full = admissions.join(per, "visit", "left").withColumns({c: empty(c) for c in ("d", "p", "m", "labs")})
    names = lambda c, field: F.transform(c, lambda x: x[field])
    prior = F.struct("t", "visit", F.to_date("t").alias("admit_date"), "kind", names("d", "diagnosis").alias("diagnoses"), names("p", "procedure").alias("procedures"), F.slice("m", 1, drugs).alias("medications"))
    now = F.col("part") == "current"
    current = F.struct("visit", F.to_date("t").alias("admit_date"), "kind", names("d", "diagnosis").alias("diagnoses"), F.slice("m", 1, drugs_now).alias("medications"))
    return full.groupBy("subject").agg(F.array_sort(F.collect_list(F.when(~now, prior))).alias("history"), F.first(F.when(now, current), ignorenulls=True).alias("current"), F.first(F.when(now, F.col("labs")), ignorenulls=True).alias("lab_data"))
