"""Places, neighbours and quantiles over a whole table, in two steps: about all parts together, then within each.

Places and neighbours take range partitions, quantiles counts of buckets. No task orders
more than a part, and what is known about the parts is bounded by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

BUCKETS = 1024
#: Rows of one bucket that are ordered at once; a fuller bucket is divided again.
FEW = 100_000


def _bucket(x: Column, low: Column, high: Column, n: int = BUCKETS) -> Column:
    """Which of n equal parts of [low, high] x lies in, from 0; monotone in x."""
    at = F.floor(F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)) * n)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), at)).cast("int")


def _laid_out(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` in range partitions of the whole order, checkpointed, with __part and __nth (the place in it).

    Spark samples the order's keys for the ends of the ranges, so partitions are about
    equally full however the keys are spread. Rows that are equal in the whole
    order lie in one partition, so it should end in an id.
    """
    nth = F.monotonically_increasing_id()
    part = F.shiftright(nth, 33)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return saved(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", part.alias("__part"), (nth - F.shiftleft(part, 33)).alias("__nth")))


def running(rows: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """`rows` with, for each name, the sum of a value over all rows before in the order; of F.lit(1), that is the place from 0."""
    placed = _laid_out(rows, order)
    own = Window.partitionBy("__part").orderBy("__nth").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__part").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    # a row for each partition, so one task orders them and all get them
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"__b_{n}") for n in values])
    inside = placed.withColumns({f"__o_{n}": F.coalesce(F.sum(v).over(own), F.lit(0)) for n, v in values.items()})
    out = inside.join(F.broadcast(before), "__part")
    return out.withColumns({n: F.col(f"__o_{n}") + F.col(f"__b_{n}") for n in values}).select(*rows.columns, *values)


def numbered(rows: DataFrame, lead: Column, order: list[Column], name: str = "number", value: Column | None = None) -> DataFrame:
    """`rows` with their place from 0 in the order of (lead, *order), or with the sum of `value` over all rows before."""
    return running(rows, [lead, *order], {name: F.lit(1) if value is None else value})


def previous(rows: DataFrame, group: list[str], order: list[Column], column: str, name: str) -> DataFrame:
    """`rows` with a column's value in the row before of the same group, null in a group's first row.

    A partition's first row gets what its left neighbour's last row holds: one
    row is carried over each boundary.
    """
    placed = _laid_out(rows, [*map(F.col, group), *order])
    held = F.struct(*group, F.col(column).alias("__value"))
    last = placed.groupBy("__part").agg(F.max_by(held, "__nth").alias("__last"))
    carried = last.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__carried"))  # a row for each partition
    inside = placed.withColumn("__held", F.lag(held).over(Window.partitionBy("__part").orderBy("__nth")))
    out = inside.join(F.broadcast(carried), "__part").withColumn("__held", F.when(F.col("__nth") == 0, F.col("__carried")).otherwise(F.col("__held")))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__held.{g}"))
    return out.withColumn(name, F.when(same, F.col("__held.__value"))).select(*rows.columns, name)


def quantiles(rows: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact quantiles, interpolated between neighbours, of the values of each group that are there.

    Returns group, share, quantile. The range around each wanted place is narrowed by
    counts of its parts until few rows are left in it (or one value), and only those
    are ordered. Groups should be few (thousands), as each has a row for each share.
    """
    x = F.col(value).cast("double")
    data = rows.select(*group, x.alias("__x")).where("__x is not null and not isnan(__x)")
    whole = data.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
    at = F.col("share") * (F.col("n") - 1)
    sought = whole.select(*group, F.explode(F.array(*map(F.lit, map(float, shares)))).alias("share"), "n", "low", "high").withColumn("at", at)
    sought = sought.withColumn("before", F.lit(0).cast("long"))
    # `before` rows lie under [low, high]; the place of the lower neighbour lies in it
    spark = rows.sparkSession
    while True:
        state = spark.createDataFrame(sought.collect(), sought.schema)  # a row for each group and share
        if not state.where((F.col("n") > FEW) & (F.col("low") < F.col("high"))).head(1):
            break
        inside = (F.col("__x") >= F.col("low")) & (F.col("__x") <= F.col("high"))
        parts = _joined(data, state.select(*group, "share", "low", "high"), group).where(inside)
        parts = parts.withColumn("b", _bucket(F.col("__x"), F.col("low"), F.col("high"))).groupBy(*group, "share", "b").agg(F.count(F.lit(1)).alias("c"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        w = Window.partitionBy(*group, "share").orderBy("b")
        parts = parts.withColumn("upto", F.sum("c").over(w)).withColumn("next_hi", F.lead("hi").over(w)).withColumn("next_c", F.lead("c").over(w))
        found = parts.alias("p").join(F.broadcast(state.alias("s")), _same("p", "s", [*group, "share"]))
        place = F.floor("s.at")
        first = found.where((F.col("s.before") + F.col("upto") > place) & (F.col("s.before") + F.col("upto") - F.col("c") <= place))
        # the upper neighbour may be the first value of the next part
        spills = (F.col("s.before") + F.col("upto") == place + 1) & F.col("next_hi").isNotNull()
        sought = first.select(*[F.col(f"s.{g}").alias(g) for g in group], F.col("s.share").alias("share"), (F.col("c") + F.when(spills, F.col("next_c")).otherwise(0)).alias("n"), F.col("lo").alias("low"), F.when(spills, F.col("next_hi")).otherwise(F.col("hi")).alias("high"), F.col("s.at").alias("at"), (F.col("s.before") + F.col("upto") - F.col("c")).alias("before"))
        if sought.join(state, [*group, "share", "n"]).count() == state.count():
            break  # nothing narrows any more
    inside = _joined(data, state.select(*group, "share", "low", "high", "at", "before"), group).where((F.col("__x") >= F.col("low")) & (F.col("__x") <= F.col("high")))
    # equal values are one row, so a value that fills the range does not fill a task
    values = inside.groupBy(*group, "share", "at", "before", "__x").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*group, "share").orderBy("__x")
    values = values.withColumn("upto", F.sum("c").over(w) + F.col("before"))
    holds = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col("__x")))
    ends = values.groupBy(*group, "share", "at").agg(holds(F.floor("at")).alias("a"), holds(F.ceil("at")).alias("b"))
    return ends.select(*group, "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("quantile"))


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _joined(data: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """data with the rows of state of its group; state has a row for each group and share."""
    if not group:
        return data.crossJoin(F.broadcast(state))
    return data.alias("d").join(F.broadcast(state.alias("s")), _same("d", "s", group)).drop(*[F.col(f"s.{g}") for g in group])
