"""Whole case records: timelines, truths of pairs, inferred kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cohort import keep_first, per_group


def timeline(seen: DataFrame, case: list[str], label: str, most: int, v: str = "value", t: str = "ts", tie: str = "event_id") -> DataFrame:
    """What is seen of each case in time order: one entry for each label and minute, the newest `most` of them.

    Entries are cut before they are listed, so a long history does not become one row.
    """
    once = keep_first(seen.withColumn("__minute", F.date_trunc("minute", t)), [*case, label, "__minute"], [F.col(t), F.col(tie)])
    newest = per_group(once, case, [F.desc(t), F.desc(tie)], most)
    entries = F.array_sort(F.collect_list(F.struct(t, tie, label, v)))
    return newest.groupBy(*case).agg(entries.alias("timeline"))


def pair_truth(pairs: DataFrame, ends: DataFrame, ident: str) -> DataFrame:
    """Changes of both sides of pairs (a_id, b_id), which is larger (A, B or same) and by how much. ends: ident, baseline, final."""
    change = ends.select(ident, (F.col("final") - F.col("baseline")).alias("change"))
    both = pairs
    for side in "ab":
        both = both.join(change.select(F.col(ident).alias(f"{side}_id"), F.col("change").alias(f"change_{side}")), f"{side}_id")
    a, b = F.abs("change_a"), F.abs("change_b")
    return both.select("a_id", "b_id", "change_a", "change_b", F.when(a > b, "A").when(a < b, "B").otherwise("same").alias("larger"), F.abs(a - b).alias("difference"))


def inferred_kind(number: Column, kinds: list[str], rules: list[tuple[list[str], Column, Column, str]]) -> Column:
    """A kind by turns of the case's number (from 1), unless a rule holds: (words, text that holds one, further condition, kind)."""
    out = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(number - 1, F.lit(len(kinds))) + 1).cast("int"))
    for words, text, also, kind in reversed(rules):
        has = F.lit(False)
        for w in words:
            has = has | F.lower(text).contains(w)
        out = F.when(has & also, kind).otherwise(out)
    return out


def full_record(tables: dict[str, DataFrame], key: str, what: str, most: int, t: str = "ts", tie: str = "event_id") -> DataFrame:
    """One record for each subject: of every table the newest `most` entries, one for each thing and day; an empty list where a table has none."""
    out = None
    for name, table in tables.items():
        once = keep_first(table.withColumn("__day", F.to_date(t)), [key, what, "__day"], [F.col(t), F.col(tie)])
        own = per_group(once, [key], [F.desc(t), F.desc(tie)], most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(t, tie, what))).alias(name))
        out = own if out is None else out.join(own, key, "full")
    empty = lambda n: F.coalesce(n, F.array().cast(dict(out.dtypes)[n]))
    return out.select(key, *[empty(n).alias(n) for n in tables])


def signals_until(events: DataFrame, subject: str, signal: Column, t: str = "ts") -> DataFrame:
    """`events` with `signals`, how many signals of the subject there are up to their time; the difference of two rows counts those between."""
    upto = Window.partitionBy(subject).orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("signals", F.sum(signal.cast("long")).over(upto))


def pair_outcomes(pairs: DataFrame, made: DataFrame, label: str) -> DataFrame:
    """pairs (a_id, b_id) of episodes -> what happened to one label on both sides, and how far the changes are apart.

    Of each side: the last value before (0 without one), the grid's last value after (the baseline without
    any), the change, its direction (unknown without any), and whether it fell. made: episodes with pre and post.
    """
    before = F.element_at(F.filter("pre", lambda x: x["label"] == label), -1)["value"]
    after = F.get(F.filter("post", lambda x: x["label"] == label), F.lit(0))["post"]["grid"]
    base, has = F.coalesce(F.when(F.exists("pre", lambda x: x["label"] == label), before), F.lit(0.0)), after.isNotNull()
    final = F.when(has, F.element_at(after, -1))
    ends = made.select("episode", "kind", "severity", "flags", base.alias("baseline"), F.coalesce(final, base).alias("final"), F.when(has, final - base).otherwise(0.0).alias("change"), F.when(~has, "unknown").when(final > base, "rising").otherwise("falling").alias("direction"), F.coalesce(final < base, F.lit(False)).alias("improved"), has.alias("measured"))
    out = pairs
    for side in "ab":
        out = out.join(ends.select(F.col("episode").alias(f"{side}_id"), *[F.col(c).alias(f"{c}_{side}") for c in ends.columns[1:]]), f"{side}_id")
    apart = F.when(F.col("measured_a") & F.col("measured_b"), F.abs(F.col("change_a") - F.col("change_b"))).otherwise(0.0)
    return out.withColumn("apart", apart).drop("measured_a", "measured_b")


def balance_report(outcomes: DataFrame, deviation: float = 0.5, good: float = 0.1) -> DataFrame:
    """One row: how many pairs, how many of them with balanced severities, and a map of the pairs of kinds (sorted) to their number.

    A pair is balanced if its severities differ by less than `good` assumed deviations.
    """
    gap = F.abs(F.col("severity_a") - F.col("severity_b")) / deviation
    kinds = F.array_join(F.array_sort(F.array("kind_a", "kind_b")), " vs ")
    per = outcomes.groupBy(kinds.alias("kinds")).agg(F.count(F.lit(1)).alias("n"), F.count_if(gap < good).alias("good"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good_balance"), F.array_sort(F.collect_list(F.struct("kinds", "n"))).alias("kinds"))  # a row for each pair of kinds
