"""Records: masking, derived fields, visits, pivots, templates, lookups against a chart."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import direction as D
from ..functions.timewin import age_at, hours_between
from ..session import load
from . import timelines as T
from .registry import query

MASK = "___"


def masked(c, hidden):
    """The value as text, or the mask where it is hidden."""
    return F.when(hidden, F.lit(MASK)).otherwise(c.cast("string"))


@query("mask_values", "SELECT event_id, event_type, CASE WHEN event_type IN ('error', 'click') THEN '___' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS shown FROM events")
def mask_values(spark, sf):
    return load(spark, sf, "events").select("event_id", "event_type", masked(F.round(F.col("value") * 100).cast("long"), F.col("event_type").isin("error", "click")).alias("shown"))


@query("age_at_event", """
SELECT o_orderkey, coalesce(year(o_orderdate) - CASE WHEN c_custkey % 7 > 0 THEN 1930 + c_nationkey * 2 END, 50) AS age,
  CASE WHEN upper(c_mktsegment) IN ('HOUSEHOLD', 'FURNITURE') THEN 'Female' ELSE 'Male' END AS gender
FROM orders JOIN customer ON c_custkey = o_custkey WHERE coalesce(year(o_orderdate) - CASE WHEN c_custkey % 7 > 0 THEN 1930 + c_nationkey * 2 END, 50) < 60""")
def age_at_event(spark, sf):
    c = load(spark, sf, "customer").withColumn("born", F.when(F.col("c_custkey") % 7 > 0, 1930 + F.col("c_nationkey") * 2))
    gender = F.when(F.upper("c_mktsegment").isin("HOUSEHOLD", "FURNITURE"), "Female").otherwise("Male")
    rows = load(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", age_at("o_orderdate", "born").cast("long").alias("age"), gender.alias("gender")).where("age < 60")


@query("visit_type", """
SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'emergency' WHEN lower(o_orderpriority) LIKE '%high%' OR lower(o_orderpriority) LIKE '%medium%' THEN 'inpatient'
  WHEN lower(o_orderpriority) LIKE '%low%' THEN 'outpatient' ELSE 'other' END AS visit_type FROM orders""")
def visit_type(spark, sf):
    p = F.lower("o_orderpriority")
    kind = F.when(p.contains("urgent"), "emergency").when(p.contains("high") | p.contains("medium"), "inpatient").when(p.contains("low"), "outpatient").otherwise("other")
    return load(spark, sf, "orders").select("o_orderkey", kind.alias("visit_type"))


@query("window_count", f"""
WITH {T._PAIRS}, b AS (SELECT user_id, visible_id, target_id FROM pairs WHERE gap_hours <= 12)
SELECT b.user_id, visible_id, target_id, count(e.event_id) AS n_in_gap FROM b JOIN events v ON v.event_id = visible_id JOIN events t ON t.event_id = target_id
LEFT JOIN events e ON e.user_id = b.user_id AND e.ts > v.ts AND e.ts <= t.ts GROUP BY 1, 2, 3""")
def window_count(spark, sf):
    """Events in (visible, target]: the difference of running counts at both ends, so no range join is needed."""
    from ..operators import series as S

    e = load(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("k", F.count(F.lit(1)).over(w)).select("event_id", "k")
    pairs = S.ordered_pairs(e.where("event_type = 'error'"), ["user_id"]).where("gap_hours <= 12")
    a, b = seen.select(F.col("event_id").alias("visible_id"), F.col("k").alias("k0")), seen.select(F.col("event_id").alias("target_id"), F.col("k").alias("k1"))
    return pairs.join(a, "visible_id").join(b, "target_id").select("user_id", "visible_id", "target_id", (F.col("k1") - F.col("k0")).alias("n_in_gap"))


@query("condition_pivot", """
SELECT user_id, max(value) FILTER (WHERE event_type = 'error') AS error, max(value) FILTER (WHERE event_type = 'view') AS view, max(value) FILTER (WHERE event_type = 'click') AS click
FROM events GROUP BY 1""")
def condition_pivot(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").pivot("event_type", ["error", "view", "click"]).agg(F.max("value"))


@query("describe_values", """
SELECT event_type, count(value) AS n, min(value) AS smallest, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS mid, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS largest, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1""")
def describe_values(spark, sf):
    from ..operators.ranks import quantiles

    e = load(spark, sf, "events")
    whole = e.groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("smallest"), F.max("value").alias("largest"), F.round(F.avg(F.col("value").cast("decimal(18,2)")), 6).cast("double").alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"))
    at = quantiles(e, ["event_type"], "value", [0.25, 0.5, 0.75])
    wide = at.groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("share") == p, F.col("quantile"))), 6).alias(k) for k, p in (("q1", 0.25), ("mid", 0.5), ("q3", 0.75))])
    return whole.join(wide, "event_type")


@query("last_visits", """
SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 5""")
def last_visits(spark, sf):
    from ..operators import cohort as C

    return C.per_group(load(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("two_tier_cap", """
WITH r AS (SELECT *, event_type IN ('error', 'view') AS known, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY known DESC, ts DESC, event_id DESC) AS k FROM r)
SELECT user_id, event_id FROM k WHERE k <= CASE WHEN n > 70 THEN 10 ELSE 20 END""")
def two_tier_cap(spark, sf):
    """Known kinds first, then the newest; a heavy subject has the lower cap."""
    w = Window.partitionBy("user_id")
    r = load(spark, sf, "events").withColumn("known", F.col("event_type").isin("error", "view")).withColumn("n", F.count(F.lit(1)).over(w))
    k = r.withColumn("k", F.row_number().over(w.orderBy(F.desc("known"), F.desc("ts"), F.desc("event_id"))))
    return k.where(F.col("k") <= F.when(F.col("n") > 70, 10).otherwise(20)).select("user_id", "event_id")


@query("straight_lines", """
WITH x AS (SELECT user_id, min_by(value, (ts, event_id)) AS b, max_by(value, (ts, event_id)) AS f FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, i AS idx, b + (f - b) * i / 95 AS v FROM x, range(96) t(i)""")
def straight_lines(spark, sf):
    at = F.struct("ts", "event_id")
    x = load(spark, sf, "events").where("event_type = 'view'").groupBy("user_id").agg(F.min_by("value", at).alias("b"), F.max_by("value", at).alias("f"))
    return x.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(95).cast("long")))).select("user_id", "idx", (F.col("b") + (F.col("f") - F.col("b")) * F.col("idx") / 95).alias("v"))


@query("stem_template", f"""
WITH n AS (SELECT event_id, user_id, event_type, ts, lead(ts) OVER w AS ts2 FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, 'Subject ' || user_id || ': what is ' || event_type || ' ' || CAST(floor({T._H.format(a='ts', b='ts2')}) AS BIGINT) || ' hours later?' AS stem FROM n WHERE ts2 IS NOT NULL""")
def stem_template(spark, sf):
    w = Window.partitionBy(*T.KEYS).orderBy("ts", "event_id")
    h = F.floor(hours_between("ts", F.lead("ts").over(w))).cast("long")
    return load(spark, sf, "events").select("event_id", F.format_string("Subject %d: what is %s %d hours later?", "user_id", "event_type", h).alias("stem"), h.alias("h")).where("h is not null").drop("h")


@query("percent_change", f"""
WITH n AS (SELECT event_id, value AS b, lead(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS a FROM events)
SELECT event_id, CASE WHEN b > 0 THEN (a - b) / b * 100 ELSE 0 END AS pct FROM n WHERE a IS NOT NULL""")
def percent_change(spark, sf):
    w = Window.partitionBy(*T.KEYS).orderBy("ts", "event_id")
    n = load(spark, sf, "events").select("event_id", F.col("value").alias("b"), F.lead("value").over(w).alias("a")).where("a is not null")
    return n.select("event_id", D.pct_change("b", "a").alias("pct"))


@query("attach_chart_values", """
WITH gold(event_type, claim) AS (VALUES ('error', 1), ('view', 2), ('missing', 3)), u AS (SELECT DISTINCT user_id FROM events),
x AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS patient_value, count(*) AS n_measurements FROM events GROUP BY 1, 2)
SELECT u.user_id, event_type, claim, patient_value, coalesce(n_measurements, 0) AS n_measurements, patient_value IS NOT NULL AS in_chart
FROM u CROSS JOIN gold LEFT JOIN x USING (user_id, event_type)""")
def attach_chart_values(spark, sf):
    e = load(spark, sf, "events")
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("event_type"), F.lit(c).alias("claim")) for k, c in (("error", 1), ("view", 2), ("missing", 3))]))
    gold = e.select("user_id").distinct().select("user_id", wanted.alias("g")).select("user_id", "g.*")
    x = e.groupBy(*T.KEYS).agg(F.max_by("value", F.struct("ts", "event_id")).alias("patient_value"), F.count(F.lit(1)).alias("n_measurements"))
    return gold.join(x, T.KEYS, "left").select(*T.KEYS, "claim", "patient_value", F.coalesce("n_measurements", F.lit(0)).alias("n_measurements"), F.col("patient_value").isNotNull().alias("in_chart"))


@query("citations_verified", """
WITH c AS (SELECT DISTINCT event_id % 97 AS pmid, event_type FROM events)
SELECT event_type, count(*) AS n_cited, count(*) FILTER (WHERE p_partkey IS NOT NULL) AS n_verified FROM c LEFT JOIN part ON p_partkey = pmid AND p_size > 20 GROUP BY 1""")
def citations_verified(spark, sf):
    cited = load(spark, sf, "events").select((F.col("event_id") % 97).alias("pmid"), "event_type").distinct()
    valid = load(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").alias("pmid"), F.lit(True).alias("ok"))
    return cited.join(valid, "pmid", "left").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_cited"), F.count("ok").alias("n_verified"))


@query("last_records", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def last_records(spark, sf):
    return load(spark, sf, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(25)


@query("hydrate_pairs", f"""
WITH {T._PAIRS} SELECT p.user_id, visible_id, target_id, a.value AS a_value, b.value AS b_value, a.event_type AS a_type FROM pairs p JOIN events a ON a.event_id = visible_id JOIN events b ON b.event_id = target_id""")
def hydrate_pairs(spark, sf):
    from ..operators import series as S

    e = load(spark, sf, "events")
    pairs = S.ordered_pairs(e.where("event_type = 'error'"), ["user_id"]).select("user_id", "visible_id", "target_id")
    a, b = e.select(F.col("event_id").alias("visible_id"), F.col("value").alias("a_value"), F.col("event_type").alias("a_type")), e.select(F.col("event_id").alias("target_id"), F.col("value").alias("b_value"))
    return pairs.join(a, "visible_id").join(b, "target_id").select("user_id", "visible_id", "target_id", "a_value", "b_value", "a_type")


@query("dates_listed", """
WITH d AS (SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS d FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY d) AS r FROM d)
SELECT user_id, event_type, n, dates FROM (SELECT user_id, event_type, string_agg(d, ',' ORDER BY d) AS dates FROM r WHERE r <= 8 GROUP BY 1, 2) JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) USING (user_id, event_type)""")
def dates_listed(spark, sf):
    g = load(spark, sf, "events").groupBy(*T.KEYS, F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    return g.groupBy(*T.KEYS).agg(F.sum("k").alias("n"), F.concat_ws(",", F.slice(F.array_sort(F.collect_list("d")), 1, 8)).alias("dates"))
