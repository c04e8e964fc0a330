"""Cohorts: densities, thresholds, key sets, counts, samples, quotas and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered


def flagged(c: Column) -> Column:
    """A flag counts as set if it is neither null nor blank."""
    return c.isNotNull() & (F.trim(c) != "")


def density(rows: DataFrame, key: str, item: str, value: str, flag: Column) -> DataFrame:
    """Per key: values that are there, distinct items, rows whose flag is set."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(value).alias("n_values"), F.countDistinct(item).alias("n_items"), F.count_if(flag).alias("n_flagged"))


def stays(rows: DataFrame, subject: str, stay: str, begin: str, amount: Column) -> DataFrame:
    """Per subject: the first and last stay by time, how many, and the sum of an amount."""
    order = F.struct(begin, stay)
    return rows.groupBy(subject).agg(F.min_by(stay, order).alias("first_stay"), F.max_by(stay, order).alias("last_stay"), F.countDistinct(stay).alias("n_stays"), F.sum(amount).alias("total"))


def counts_over(rows: DataFrame, by: str, least: int) -> DataFrame:
    return rows.groupBy(by).count().where(F.col("count") >= least).select(by, F.col("count").alias("n"))


def top_categories(rows: DataFrame, by: str, least: int, k: int) -> DataFrame:
    return counts_over(rows, by, least).orderBy(F.desc("n"), by).limit(k)


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def in_code_ranges(code: Column, version: Column, lexical: list[tuple[str, str]], numeric: list[tuple[int, int]]) -> Column:
    """Version 10: first three characters within a lexical range; else as a number within a numeric one, false if it is none."""
    head = F.substring(code, 1, 3)
    as_int = head.try_cast("int")
    new, old = F.lit(False), F.lit(False)
    for a, b in lexical:
        new = new | head.between(a, b)
    for a, b in numeric:
        old = old | as_int.between(a, b)
    return F.when(version == 10, new).otherwise(F.coalesce(old, F.lit(False)))


def hash_order(seed: int, *cols: str) -> list[Column]:
    """A reproducible random order."""
    return [F.xxhash64(F.lit(seed), *cols), *map(F.col, cols)]


def pool(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n keys, uniformly without replacement, the same on every run and in any engine; null is no key."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(seeded(seed, key), key).limit(n)


def per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; the planner cuts each partition before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def quota_then_fill(rows: DataFrame, by: str, quota: int, n: int, order: list[Column]) -> DataFrame:
    """Up to `quota` rows of each class, then the best of the rest until there are n.

    No row beyond the first quota + n of its class can be picked, so those alone are
    ordered together, by a sort that keeps n rows.
    """
    ranked = per_group(rows, [by], order, quota + n).withColumnRenamed("rank", "__r")
    first = (F.col("__r") <= quota).cast("int")
    return ranked.orderBy(F.desc(first), *order).limit(n).withColumn("by_quota", F.col("__r") <= quota).drop("__r")


def balanced(rows: DataFrame, pool: Column, by: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The best rows of each class in each pool, as many as the quota of the class."""
    ranked = per_group(rows.withColumn("pool", pool).where(F.col(by).isin(list(quotas))), ["pool", by], order, max(quotas.values()))
    limit = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    return ranked.where(F.col("rank") <= F.element_at(limit, F.col(by)))


def thirds(n: int, kinds: tuple[str, str, str] = ("rising", "falling", "stable")) -> dict[str, int]:
    """n in three shares; what is left over goes to the first ones."""
    return {k: n // 3 + (n % 3 > i) for i, k in enumerate(kinds)}


def capped(rows: DataFrame, by: list[str], most: int, n: int, order: list[Column]) -> DataFrame:
    """At most `most` rows of each class, and n in all, the first by order."""
    return per_group(rows, by, order, most).orderBy(*order).limit(n)


def seeded(seed: int, *cols: str) -> Column:
    """A hash that any engine can compute: the MD5 of the seed and the columns, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def seeded_number(seed: int, *cols: str) -> Column:
    """The first 32 bits of `seeded`, as a number."""
    return F.conv(F.substring(seeded(seed, *cols), 1, 8), 16, 10).cast("long")


def pick_one(rows: DataFrame, subject: str, seed: int, *cols: str) -> DataFrame:
    """One row of each subject, the same on every run; `cols` tell its rows apart."""
    all_of = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(subject).agg(F.min_by(all_of, F.struct(seeded(seed, subject, *cols), *cols)).alias("__one")).select("__one.*")


def coin(seed: int, *cols: str, sides: tuple[str, str] = ("A", "B")) -> Column:
    return F.when(seeded_number(seed, *cols) < (1 << 31), sides[0]).otherwise(sides[1])


def shuffled(rows: DataFrame, seed: int, *cols: str) -> DataFrame:
    """`rows` with `place`, their place from 0 in a random order that is the same on every run."""
    return numbered(rows, seeded_number(seed, *cols), [seeded(seed, *cols), *map(F.col, cols)], "place")


def sequential(rows: DataFrame, lead: Column, order: list[Column], pattern: str = "p%06d") -> DataFrame:
    """`rows` with `uid`, numbered from 0 in a total order."""
    return numbered(rows, lead, order, "__n").withColumn("uid", F.format_string(pattern, "__n")).drop("__n")


def assigned(rows: DataFrame, key: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """Different keys in random order get kinds, each time the kind with the most left; key, nth, kind. No key is used twice."""
    spark = rows.sparkSession
    slots = sorted((-left, kind) for kind, n in quotas.items() for left in range(1, n + 1))  # as many as are picked
    table = spark.createDataFrame([(k, kind) for k, (_, kind) in enumerate(slots)], "nth long, kind string")
    picked = pool_in_order(rows, key, len(slots), seed)
    return picked.join(F.broadcast(table), "nth").select(key, "nth", "kind")


def pool_in_order(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The first n different keys of a random order with their place from 0."""
    first = rows.select(key).distinct().orderBy(seeded(seed, key), key).limit(n)
    return first.withColumn("nth", (F.row_number().over(Window.orderBy(seeded(seed, key), key)) - 1).cast("long"))  # n rows


def tiers_first(rows: DataFrame, tier: str, tiers: list, n: int, order: list[Column]) -> DataFrame:
    """At most n rows of some tiers, the highest tier first."""
    return rows.where(F.col(tier).isin(tiers)).orderBy(F.desc(tier), *order).limit(n)


def one_per(rows: DataFrame, stratum: str, order: list[Column]) -> DataFrame:
    """An example of each stratum, the first by order."""
    return per_group(rows, [stratum], order, 1).drop("rank")


def split_at(rows: DataFrame, key: str, order: list[Column], cut: Column) -> DataFrame:
    """`rows` with `part`: prior before the first row that is the cut, current for it, later after it; none without a cut."""
    w = Window.partitionBy(key)
    placed = rows.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("__c", F.min(F.when(cut, F.col("__r"))).over(w))
    return placed.withColumn("part", F.when(F.col("__r") < F.col("__c"), "prior").when(F.col("__r") == F.col("__c"), "current").when(F.col("__r") > F.col("__c"), "later")).drop("__r", "__c")


def distinct_by_name(rows: DataFrame, key: str, name: str, order: list[Column], most: int = 80) -> DataFrame:
    """The earliest row of each name, case and outer blanks aside, and the first `most` of them in order."""
    folded = rows.withColumn("__name", F.lower(F.trim(name)))
    return per_group(keep_first(folded, [key, "__name"], order), [key], order, most).drop("__name")


def preferred(rows: DataFrame, label: str, wanted: list[str], better: Column, order: list[Column]) -> DataFrame:
    """One row for each wanted label, case aside; one that is `better` where labels repeat."""
    some = rows.where(F.lower(label).isin([w.lower() for w in wanted]))
    return keep_first(some, [label], [F.desc(F.coalesce(better, F.lit(False))), *order])


def pair_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def either_side(pairs: DataFrame, a: str, b: str, name: str, also: list[str] = ()) -> DataFrame:
    """All different members of pairs, whichever side they are on; `also`: with further columns of their pairs."""
    return pairs.select(*also, F.col(a).alias(name)).union(pairs.select(*also, F.col(b).alias(name))).distinct()


def weighted_size(counts: dict[str, int], per_token: int = 4) -> Column:
    """A size estimate: counts by weight, over so many characters a token."""
    return F.floor(sum((F.col(c) * w for c, w in counts.items()), F.lit(0)) / per_token).cast("long")


def cap_protected(rows: DataFrame, key: list[str], protected: Column, newest: list[Column], n: int) -> DataFrame:
    """All protected rows and the newest others up to n in all; none of the others if the protected fill n."""
    flag = rows.withColumn("__p", protected)
    w = Window.partitionBy(*key)
    flag = flag.withColumn("__np", F.sum(F.col("__p").cast("int")).over(w)).withColumn("__r", F.row_number().over(Window.partitionBy(*key, "__p").orderBy(*newest)))
    return flag.where(F.col("__p") | (F.col("__r") <= F.greatest(F.lit(n) - F.col("__np"), F.lit(0)))).drop("__p", "__np", "__r")


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def ordered_distinct(rows: DataFrame, key: str, value: str, order: list[str], n: int) -> DataFrame:
    """The first n different values of each key in order. Repeats go before the values are listed."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("__first"))
    first = first.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__first", value))).where(F.col("__r") <= n)
    listed = F.array_sort(F.collect_list(F.struct("__r", value)))
    return first.groupBy(key).agg(F.concat_ws(",", F.transform(listed, lambda x: x[value])).alias("items"))


def even_picks(rows: DataFrame, group: str, order: list[Column], k: int = 5) -> DataFrame:
    """k evenly spaced rows of each group, the first and last among them; all rows of groups of k or fewer."""
    w = Window.partitionBy(group)
    r = rows.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    # i is picked if some j has floor(j * (n - 1) / (k - 1) + 1/2) = i, in whole numbers
    picked = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor((2 * j * (F.col("n") - 1) + (k - 1)) / (2 * (k - 1))) == F.col("i"))
    return r.where((F.col("n") <= k) | picked)


def stride_picks(rows: DataFrame, group: str, order: list[Column], near: list[Column], k: int) -> DataFrame:
    """Rows 0, s, 2s, ... (s = n // k) of groups with more than 3k rows; of others the k nearest by `near`."""
    w = Window.partitionBy(group)
    r = rows.withColumn("i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("__c", F.row_number().over(w.orderBy(*near)))
    s = F.floor(F.col("n") / k)
    many = F.col("n") > 3 * k
    return r.where(F.when(many, (F.pmod("i", F.greatest(s, F.lit(1))) == 0) & (F.col("i") / F.greatest(s, F.lit(1)) < k)).otherwise(F.col("__c") <= k)).drop("__c")
