"""Context records of procedures: what was known by their start, covariates, and the two sides of a pair.

What is known by a moment is carried forward in time over the union of measurements and
moments, so a long history meets its procedures once and is not multiplied by them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timewin import HOUR_US, micros_between
from ..session import saved
from . import anchor as A
from .matching import imputed, varying


def known_by(measured: DataFrame, index: DataFrame, labels: list[str]) -> DataFrame:
    """For each index procedure and label measured by its start: latest, n, smallest and largest value. index: subject, episode, t."""
    own = Window.partitionBy("subject", "label").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = measured.where(F.col("value").isNotNull() & F.col("label").isin(*labels))
    state = F.struct(F.col("value").alias("latest"), F.count("value").over(own).alias("n"), F.min("value").over(own).alias("least"), F.max("value").over(own).alias("most"))
    rows = rows.select("subject", "label", F.col("ts").alias("at"), F.lit(0).alias("side"), F.col("event_id").alias("tie"), F.lit(None).cast("long").alias("episode"), state.alias("state"))
    asked = index.select("subject", F.explode(F.array(*map(F.lit, labels))).alias("label"), F.col("t").alias("at"), F.lit(1).alias("side"), F.col("episode").alias("tie"), F.col("episode").cast("long").alias("episode"), F.lit(None).cast(rows.schema["state"].dataType).alias("state"))
    upto = Window.partitionBy("subject", "label").orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asked).withColumn("state", F.last("state", ignorenulls=True).over(upto))
    return both.where("side = 1 and state is not null").select("subject", "episode", "label", "state.*")


def near_in_time(measured: DataFrame, index: DataFrame, hours: float) -> DataFrame:
    """Measurements from `hours` before to `hours` after each index procedure, with side (pre, post) and h; a procedure meets near cells of time only."""
    most = int(hours * HOUR_US)
    cell = lambda c: F.floor(micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz")) / F.lit(float(most + 1)))
    a = index.select("subject", "episode", "t", F.explode(F.array(cell("t") - 1, cell("t"), cell("t") + 1)).alias("__cell"))
    us = micros_between("t", "ts")
    both = a.join(measured.withColumn("__cell", cell("ts")), ["subject", "__cell"]).where(us.between(-most, most)).drop("__cell")
    return both.withColumns({"side": F.when(us <= 0, "pre").otherwise("post"), "h": us / F.lit(float(HOUR_US))})


def prior_codes(procedures: DataFrame, index: DataFrame) -> DataFrame:
    """episode, prior: the different codes of the subject's earlier procedures, sorted; by the first time of each code."""
    first = procedures.groupBy("subject", "code").agg(F.min("ts").alias("__first"))
    return index.select("subject", "episode", "t").join(first, "subject").where("__first < t").groupBy("subject", "episode").agg(F.array_sort(F.collect_list("code")).alias("prior"))


def flags_of(conditions: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """subject and a flag for each group: whether any of the subject's conditions begins with one of its prefixes."""
    hit = lambda prefixes: F.max(reduce(lambda a, b: a | b, [F.col("name").startswith(p) for p in prefixes]).cast("int"))
    return conditions.where(F.col("name").isNotNull()).groupBy("subject").agg(*[hit(p).alias(g) for g, p in groups.items()])


def blocks(events: DataFrame, index: DataFrame, people: DataFrame, ranges: DataFrame, groups: dict[str, list[str]], labels: list[str], hours: float = 72, oldest: int = 89) -> DataFrame:
    """One row for each index procedure (subject, episode, t, kind) of a subject younger than `oldest`.

    pre: summary of each label by its start; prior: earlier procedures; flags; trajectories: of
    each label measured on both sides, the last value before, the median after, direction and counts; post: the
    measurements after, with hours. people: subject, age, gender; ranges: label, low, high, few rows.
    """
    measured = events.where("role = 'measurement'").withColumn("label", F.col("name"))
    young = index.join(people.where(F.col("age") < oldest), "subject")
    summary = known_by(measured, young, labels).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("label", "latest", "n", "least", "most"))).alias("pre"))
    near = near_in_time(measured.where(F.col("value").isNotNull() & F.col("label").isin(*labels)), young, hours).join(F.broadcast(ranges), "label")
    paths = A.trajectory(near, ["episode", "label"])
    paths = paths.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("label", "direction", "baseline", "post_rep", "n_pre", "n_post"))).alias("trajectories"))
    after = near.where("side = 'post'").groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("label", "ts", "event_id", "value", F.round("h", 1).alias("h")))).alias("post"))
    prior = prior_codes(events.where("role = 'procedure'"), young).drop("subject")
    flags = flags_of(events.where("role = 'condition'"), groups)
    out = young.join(flags, "subject", "left")
    for part in (summary, prior, paths, after):
        out = out.join(part, "episode", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(out.dtypes)[c])).alias(c)
    return out.select("subject", "episode", "t", "kind", "age", "gender", F.struct(*[F.coalesce(g, F.lit(0)).alias(g) for g in groups]).alias("flags"), *[empty(c) for c in ("pre", "prior", "trajectories", "post")])


def covariates(events: DataFrame, index: DataFrame, people: DataFrame, groups: dict[str, list[str]], labels: list[str]) -> DataFrame:
    """subject, episode, t, kind and numbers: the last value of each label by the start, flags, age.

    Missing ones become the column's median (0 without any); columns with one value only go.
    """
    last = known_by(events.where("role = 'measurement'").withColumn("label", F.col("name")), index, labels)
    wide = last.groupBy("episode").agg(*[F.max(F.when(F.col("label") == c, F.col("latest"))).alias(f"lab_{c}") for c in labels])
    flags = flags_of(events.where("role = 'condition'"), groups).select("subject", *[F.col(g).alias(f"cm_{g}") for g in groups])
    rows = index.join(wide, "episode", "left").join(flags, "subject", "left").join(people.select("subject", F.col("age").cast("double").alias("age")), "subject", "left")
    names = [f"lab_{c}" for c in labels] + [f"cm_{g}" for g in groups] + ["age"]
    rows = rows.withColumns({f"cm_{g}": F.coalesce(f"cm_{g}", F.lit(0)).cast("double") for g in groups})
    full = saved(imputed(rows.select("subject", "episode", "t", "kind", *names), names))
    return full.select("subject", "episode", "t", "kind", *varying(full, names))


def pair_contexts(pairs: DataFrame, made: DataFrame, owner: Column) -> DataFrame:
    """pairs: a_id, b_id (episodes) -> both blocks without what came after, and the measurements after of the owner (A or B), unlabelled.

    Pairs of which either side has no block (too old, say) go.
    """
    side = lambda s: made.select(F.col("episode").alias(f"{s}_id"), F.struct(*[c for c in made.columns if c not in ("post", "trajectories")]).alias(f"patient_{s}"), F.col("post").alias(f"post_{s}"))
    both = pairs.withColumn("owner", owner).join(side("a"), "a_id").join(side("b"), "b_id")
    return both.withColumn("shown", F.when(F.col("owner") == "A", F.col("post_a")).otherwise(F.col("post_b"))).drop("post_a", "post_b")
