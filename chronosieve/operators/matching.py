"""Covariates, balance and matching of subjects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from .calipers import nearest_controls
from .cohort import either_side
from .ranks import quantiles, running


def imputed(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Missing covariates become the column's median, 0 if it has none. The rows are computed once, as the medians take several passes."""
    wide = saved(wide)
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")).select("c.*")
    found = {r.covariate: r.quantile for r in quantiles(long, ["covariate"], "x", [0.5]).collect()}  # a row for each column
    return wide.select(*[c for c in wide.columns if c not in columns], *[F.coalesce(F.col(c), F.lit(float(found.get(c, 0.0)))).alias(c) for c in columns])


def varying(wide: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than one value; constant covariates tell nothing."""
    ends = wide.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns]).first()
    return [c for c in columns if ends[f"a_{c}"] != ends[f"b_{c}"]]


def smd(a: Column, b: Column, sd_a: Column, sd_b: Column) -> Column:
    """Standardised difference of two means with assumed deviations; 0 if both are 0."""
    pooled = F.sqrt((sd_a * sd_a + sd_b * sd_b) / 2)
    return F.when(pooled == 0, 0.0).otherwise(F.abs(a - b) / pooled)


def hamming(a: list[Column], b: list[Column]) -> Column:
    return sum((F.when(~x.eqNullSafe(y), 1).otherwise(0) for x, y in zip(a, b, strict=True)), F.lit(0))


def euclidean(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def trends_compatible(da: Column, sa: Column, db: Column, sb: Column, most: float = 0.2) -> Column:
    """One direction, and slopes that differ by at most a fifth of the larger (tiny ones do); true where a side has none."""
    largest = F.greatest(F.abs(sa), F.abs(sb))
    fits = (da == db) & ((largest < 0.001) | (F.abs(sa - sb) <= most * largest))
    return F.when(da.isNull() | sa.isNull() | db.isNull() | sb.isNull(), True).otherwise(fits)


def slope_gap(sa: Column, sb: Column) -> Column:
    """Difference of two slopes relative to the larger; 0 for tiny slopes and where a side has none."""
    return F.coalesce(F.when(F.abs(sa) + F.abs(sb) > 0.001, F.abs(sa - sb) / F.greatest(F.abs(sa), F.abs(sb))), F.lit(0.0))


def standardised(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation, 0 for constant columns. The moments are one row."""
    moments = wide.agg(*[F.avg(c).alias(f"__a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    z = lambda c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__a_{c}")) / F.col(f"__s_{c}")).otherwise(0.0)
    return wide.crossJoin(F.broadcast(moments)).select(*[c for c in wide.columns if c not in columns], *[z(c).alias(c) for c in columns])


def balance(rows: DataFrame, treated: Column, columns: list[str], group: list[str] = ()) -> DataFrame:
    """Standardised mean difference of each column between treated and others, of each group."""
    long = rows.select(*group, treated.alias("__t"), F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")).select(*group, "__t", "c.*")
    part = lambda f, t: f(F.when(F.col("__t") == t, F.col("x")))
    g = long.groupBy(*group, "covariate").agg(part(F.avg, True).alias("ma"), part(F.avg, False).alias("mb"), part(F.var_pop, True).alias("va"), part(F.var_pop, False).alias("vb"))
    return g.select(*group, "covariate", (F.abs(F.col("ma") - F.col("mb")) / (F.sqrt((F.col("va") + F.col("vb")) / 2) + 1e-9)).alias("smd"))


def candidate_pairs(episodes: DataFrame, stratum: str, kind: str, ident: str, flags: list[str], trends: list[tuple[str, str]], severity: str = "severity", cell: Column | None = None) -> DataFrame:
    """Pairs of episodes of different kinds in one stratum with compatible trends, and their score, lower for better ones.

    score = 10 * Hamming distance of the flags + severity difference + 5 * relative
    slope difference of each trend. trends: (direction, slope) columns of each
    measurement; null where an episode lacks it. The first trend also narrows the
    join: compatible slopes lie in equal or neighbouring cells of their logarithm
    (tiny slopes in one of their own, missing ones meet all).
    """
    (d0, s0), *_ = trends
    width = math.log(1.2501)
    own = F.when(F.abs(s0) < 0.001, F.lit(-10_000)).otherwise(F.floor(F.log(F.abs(s0)) / width).cast("int"))
    # a slope just over the limit may meet one just under it
    edge = F.abs(s0).between(0.001, 0.00126)
    cells = F.when(F.abs(s0) < 0.001, F.array(own, F.floor(F.log(F.lit(0.001)) / width).cast("int"), F.floor(F.log(F.lit(0.00126)) / width).cast("int"))).otherwise(F.array(own - 1, own, own + 1))
    cells = F.array_distinct(F.when(edge, F.concat(cells, F.array(F.lit(-10_000)))).otherwise(cells))
    has = F.col(d0).isNotNull() & F.col(s0).isNotNull()
    base = episodes.withColumn("__more", cell if cell is not None else F.lit(0))
    b = base.alias("b")
    key = (F.col(f"a.{stratum}") == F.col(f"b.{stratum}")) & (F.col("a.__more") == F.col("b.__more"))
    rest = F.col(f"a.{kind}") < F.col(f"b.{kind}")
    for d, s in trends:
        rest = rest & trends_compatible(F.col(f"a.{d}"), F.col(f"a.{s}"), F.col(f"b.{d}"), F.col(f"b.{s}"))
    near = base.where(has).withColumn("__cell", F.explode(cells)).alias("a").join(base.where(has).withColumn("__cell", own).alias("b"), key & (F.col("a.__cell") == F.col("b.__cell")) & rest)
    none = base.where(~has)
    score = 10.0 * hamming([F.col(f"a.{c}") for c in flags], [F.col(f"b.{c}") for c in flags]) + F.abs(F.col(f"a.{severity}") - F.col(f"b.{severity}"))
    for _, s in trends:
        score = score + 5.0 * slope_gap(F.col(f"a.{s}"), F.col(f"b.{s}"))
    out = lambda df: df.select(F.col(f"a.{stratum}").alias(stratum), F.col(f"a.{ident}").alias("a_id"), F.col(f"b.{ident}").alias("b_id"), F.col(f"a.{kind}").alias("a_kind"), F.col(f"b.{kind}").alias("b_kind"), hamming([F.col(f"a.{c}") for c in flags], [F.col(f"b.{c}") for c in flags]).cast("long").alias("hamming"), score.alias("score"))
    one = out(none.alias("a").join(b, key & rest))
    two = out(base.where(has).alias("a").join(none.alias("b"), key & rest))
    return out(near).unionByName(one).unionByName(two)


def settled(candidates: DataFrame, group: list[str], a_order: list[str], b_order: list[str], capacity: int = 1) -> DataFrame:
    """Pairs (a_id, b_id) that no two sides would leave for each other: every a has one partner at most, every b `capacity`.

    In each round every a asks its best partner that is left, every b keeps its best
    askers, and pairs that a full b would refuse go. With one common order of the
    pairs this is greedy matching in that order; with one common order of the a's
    it is the choice of one a after another. Rounds are joins and windows on
    (group, id), so a large group is not one task's work.
    """
    left = saved(candidates)
    ask = Window.partitionBy(*group, "a_id").orderBy(*a_order)
    keep = Window.partitionBy(*group, "b_id").orderBy(*b_order)
    while True:
        asks = left.withColumn("__r", F.row_number().over(ask)).where("__r = 1").drop("__r")
        ranked = saved(asks.withColumn("__k", F.row_number().over(keep)))
        if not ranked.where(F.col("__k") > capacity).head(1):
            return ranked.where(F.col("__k") <= capacity).drop("__k")
        # the last that a full b keeps: whatever it likes less has no chance any more
        last = ranked.where(F.col("__k") == capacity).select(*group, "b_id", F.struct(*b_order).alias("__last"))
        rest = left.join(last, [*group, "b_id"], "left").where(F.col("__last").isNull() | (F.struct(*b_order) <= F.col("__last")))
        left = saved(rest.select(*candidates.columns))


def greedy_pairs(candidates: DataFrame, group: list[str]) -> DataFrame:
    """One-to-one pairs in score order within each group; earlier picks exclude later ones."""
    order = ["score", "a_id", "b_id"]
    return settled(candidates.select(*group, *order), group, order, order).select(*group, "a_id", "b_id", "score")


def propensity(rows: DataFrame, treated: str, columns: list[str], keep: bool = False) -> DataFrame:
    """Adds `p`, the probability of treatment by L2-regularised logistic regression on standardised covariates.

    The covariates become standardised too, unless `keep`; p is rounded to twelve digits.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = [f"__z_{c}" for c in columns] if keep else columns
    z = standardised(rows.select("*", *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]) if keep else rows, names)
    data = VectorAssembler(inputCols=names, outputCol="__x").transform(z)
    n = max(1, data.count())
    model = LogisticRegression(featuresCol="__x", labelCol=treated, maxIter=200, regParam=1.0 / n, elasticNetParam=0.0, standardization=False).fit(data)
    return model.transform(data).withColumn("p", F.round(vector_to_array("probability")[1], 12)).drop("__x", "rawPrediction", "probability", "prediction", *(names if keep else []))


def auc(rows: DataFrame, label: str, score: str, group: list[str] = ()) -> DataFrame:
    """Area under the ROC curve of each group from ranks; ties count half. Ranks come from counts per score, summed over range partitions."""
    per = rows.groupBy(*group, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    below = running(per, [*map(F.col, group), F.col(score)], {"neg_below": F.col("neg")})
    if group:
        # the sum runs over all groups; each begins with its smallest
        first = below.groupBy(*group).agg(F.min("neg_below").alias("__first"))
        below = below.join(first, list(group)).withColumn("neg_below", F.col("neg_below") - F.col("__first"))
    share = F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg"))
    return below.groupBy(*group).agg(share.alias("auc")) if group else below.agg(share.alias("auc"))


def caliper_pairs(rows: DataFrame, group: list[str], ident: str, treated: str, p: str = "p", share: float = 0.2, reuse: int = 2) -> DataFrame:
    """Each treated row with its nearest control within the caliper, controls used `reuse` times at most.

    The caliper is `share` population deviations of p in the group. Treated rows choose
    in the order of p (ties by id), each the nearest control (ties by id) that has room;
    see calipers, also for ties of points on both sides.
    """
    known = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    width = (known.groupBy(*group) if group else known).agg((F.stddev_pop(p) * share).alias("__width"))
    return nearest_controls(rows, group, ident, treated, p, width, reuse)


def systems(label: Column, words: dict[str, str], other: str = "other") -> Column:
    """The system of a label: that of the first word, in order, that it holds, case aside."""
    out = F.lit(other)
    for w, system in reversed(words.items()):
        out = F.when(F.lower(label).contains(w), system).otherwise(out)
    return out


def propensities(rows: DataFrame, group: str, treated: str, columns: list[str], name: str = "p", rounds: int = 60) -> DataFrame:
    """Adds the probability of treatment within each group: one L2-regularised logistic model a group, all fitted together.

    Covariates are standardised in the group, constant ones are 0; the intercept is not
    penalised. Each pass over the rows gives the gradients and Hessians of all groups,
    and each group takes Newton steps, halved while its loss does not fall, until its
    gradient is gone. The driver holds the moments of a group's covariates, so groups should be few
    (thousands). p is rounded to twelve digits.
    """
    import numpy as np

    spark = rows.sparkSession
    d, kind = len(columns), dict(rows.dtypes)[group]
    moments = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"__a{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"__s{k}") for k, c in enumerate(columns)])
    z = [F.when(F.col(f"__s{k}") > 0, (F.col(c) - F.col(f"__a{k}")) / F.col(f"__s{k}")).otherwise(0.0) for k, c in enumerate(columns)]
    data = saved(rows.join(F.broadcast(moments), group).withColumn("__x", F.array(F.lit(1.0), *z)).select(*rows.columns, "__x"))  # a row for each group
    narrow = data.select(group, F.col(treated).cast("double").alias("__y"), "__x")
    pairs = [(j, k) for j in range(d + 1) for k in range(j + 1)]
    ridge = np.diag([0.0] + [1.0] * d)

    def weighted(df: DataFrame, weights: dict) -> DataFrame:
        table = spark.createDataFrame([(g, [float(x) for x in w]) for g, w in weights.items()], f"{group} {kind}, __w array<double>")
        eta = F.aggregate(F.zip_with("__w", "__x", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return df.join(F.broadcast(table), group).withColumn("__eta", eta).withColumn("__p", 1 / (1 + F.exp(-F.col("__eta"))))

    def looked(weights: dict) -> dict:
        """Loss, gradient and Hessian of each group at its weights."""
        at = weighted(narrow, weights)
        x = [F.get("__x", F.lit(k)) for k in range(d + 1)]
        loss = F.sum(F.greatest("__eta", F.lit(0.0)) - F.col("__y") * F.col("__eta") + F.log1p(F.exp(-F.abs("__eta"))))
        v = F.col("__p") * (1 - F.col("__p"))
        got = at.groupBy(group).agg(loss.alias("l"), F.array(*[F.sum((F.col("__p") - F.col("__y")) * x[k]) for k in range(d + 1)]).alias("g"), F.array(*[F.sum(v * x[j] * x[k]) for j, k in pairs]).alias("h"))
        out = {}
        for r in got.collect():  # a row for each group
            w, h = np.array(weights[r[group]]), np.zeros((d + 1, d + 1))
            for (j, k), value in zip(pairs, r.h, strict=True):
                h[j, k] = h[k, j] = value
            out[r[group]] = (r.l + 0.5 * w[1:] @ w[1:], np.array(r.g) + ridge @ w, h + ridge)
        return out

    weights = {r[group]: np.zeros(d + 1) for r in moments.select(group).collect()}
    state, done = looked(weights) if weights else {}, {}
    step = {g: 1.0 for g in weights}
    for _ in range(rounds):
        open_ = {g: s for g, s in state.items() if g not in done and np.abs(s[1]).max() > 1e-9 * max(1.0, np.abs(s[2]).max())}
        done |= {g: weights[g] for g in state if g not in open_}
        if not open_:
            break
        tried = {g: weights[g] - step[g] * np.linalg.lstsq(h, grad, rcond=None)[0] for g, (_, grad, h) in open_.items()}
        for g, s in looked(tried).items():
            if s[0] <= state[g][0] + 1e-12 * abs(state[g][0]):
                weights[g], state[g], step[g] = tried[g], s, 1.0
            else:
                step[g] /= 2
                if step[g] < 1e-6:
                    done[g] = weights[g]
    if not weights:
        return data.drop("__x").withColumn(name, F.lit(None).cast("double"))
    return weighted(data, weights).withColumn(name, F.round("__p", 12)).drop("__w", "__x", "__eta", "__p")


def overlap_diagnosis(rows: DataFrame, kind: str, ident: str, columns: list[str], system: dict[str, str], least: int = 20, common: int = 1, top: int = 10, share: float = 0.2, reuse: int = 2, largest: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(matched pairs across systems of kinds, a diagnosis of each pair of kinds).

    The `top` most frequent kinds with at least `common` rows are paired if their systems are
    known and differ and both have `least` rows. All pairs of kinds go through each step together:
    one model each, matching within calipers, balance, one model each on what was matched.
    The diagnosis has a row for each pair of kinds: a_kind, b_kind, systems, n_a, n_b, n_pairs, auc_before, auc_after,
    largest_smd, mean_smd (rounded to three digits; null without pairs) and kept: whether
    there are pairs and no covariate differs by more than `largest`. Pairs of kept ones are returned.
    """
    spark = rows.sparkSession
    order = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= common).orderBy(F.desc("n"), kind).limit(top).withColumn("system", systems(F.col(kind), system)).collect()
    told = []
    for i, x in enumerate(order):
        for y in order[i + 1 :]:
            if "other" not in (x.system, y.system) and x.system != y.system and min(x.n, y.n) >= least:
                told.append((len(told), x[kind], y[kind], f"{x.system} vs {y.system}", x.n, y.n))
    kinds = dict(rows.dtypes)
    cases = spark.createDataFrame(told, f"__case int, a_kind {kinds[kind]}, b_kind {kinds[kind]}, systems string, n_a long, n_b long")  # top * (top - 1) / 2 rows at most
    sides = cases.select("__case", F.explode(F.array(F.struct(F.col("a_kind").alias("__kind"), F.lit(1).alias("__treated")), F.struct(F.col("b_kind").alias("__kind"), F.lit(0).alias("__treated")))).alias("s")).select("__case", "s.*")
    data = rows.select(F.col(ident).alias("__ident"), F.col(kind).alias("__kind"), *columns).join(F.broadcast(sides), "__kind").drop("__kind")
    both = saved(propensities(data, "__case", "__treated", columns))
    pairs = saved(caliper_pairs(both, ["__case"], "__ident", "__treated", "p", share, reuse))
    matched = either_side(pairs, "a_id", "b_id", "__ident", ["__case"])
    again = saved(propensities(both.drop("p").join(matched, ["__case", "__ident"], "left_semi"), "__case", "__treated", columns))
    gaps = balance(again, F.col("__treated") == 1, columns, ["__case"]).groupBy("__case").agg(F.round(F.max("smd"), 3).alias("largest_smd"), F.round(F.avg("smd"), 3).alias("mean_smd"))
    area = lambda df, c: auc(df, "__treated", "p", ["__case"]).select("__case", F.round("auc", 3).alias(c))
    said = cases.join(pairs.groupBy("__case").agg(F.count(F.lit(1)).alias("n_pairs")), "__case", "left").join(area(both, "auc_before"), "__case", "left").join(area(again, "auc_after"), "__case", "left").join(gaps, "__case", "left")
    said = saved(said.withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("long"))).withColumn("kept", (F.col("n_pairs") > 0) & F.coalesce(F.col("largest_smd") <= largest, F.lit(False))))
    own = pairs.join(F.broadcast(said.where("kept").select("__case", "a_kind", "b_kind")), "__case").select("a_kind", "b_kind", "a_id", "b_id", "pa", "pb")
    return own, said.drop("__case")
