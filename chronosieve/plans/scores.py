"""Scoring and calibration queries. Predictions are deterministic stand-ins computed from the data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import direction as D
from ..operators import score as K
from ..operators.ranks import previous, quantiles
from ..session import load
from . import timelines as T
from .registry import query

_NEXT = f"""
n AS (SELECT user_id, event_type, event_id, ts, value AS before, lead(value) OVER w AS actual, lag(value) OVER w AS prior FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
p AS (SELECT *, CASE WHEN prior IS NULL THEN before ELSE (before + prior) / 2 END AS predicted FROM n WHERE actual IS NOT NULL),
e AS (SELECT *, CASE WHEN actual > 0 THEN abs(predicted - actual) / actual ELSE 1 END AS err, CASE WHEN actual > 0 THEN abs(before - actual) / actual ELSE 1 END AS err0,
  {T._DIR.format(b='before', a='actual')} AS d_actual, {T._DIR.format(b='before', a='predicted')} AS d_pred FROM p)"""
_BAND = "CASE WHEN {d} THEN 0.40::DOUBLE ELSE 0::DOUBLE END + CASE WHEN {e} <= 0.5 THEN 0.35::DOUBLE ELSE 0::DOUBLE END + CASE WHEN {e} <= 0.2 THEN 0.25::DOUBLE ELSE 0::DOUBLE END"


def _predicted(spark, sf):
    w = Window.partitionBy(*T.KEYS).orderBy("ts", "event_id")
    n = load(spark, sf, "events").select(*T.KEYS, "event_id", F.col("value").alias("before"), F.lead("value").over(w).alias("actual"), F.lag("value").over(w).alias("prior")).where("actual is not null")
    p = n.withColumn("predicted", F.when(F.col("prior").isNull(), F.col("before")).otherwise((F.col("before") + F.col("prior")) / 2))
    return p.withColumn("err", K.relative_error(F.col("predicted"), F.col("actual"))).withColumn("d_actual", D.direction("before", "actual")).withColumn("d_pred", D.direction("before", "predicted"))


@query("score_bands", f"WITH {_NEXT} SELECT event_id, {_BAND.format(d='d_actual = d_pred', e='err')} AS score FROM e")
def score_bands(spark, sf):
    return _predicted(spark, sf).select("event_id", K.banded(F.col("d_actual") == F.col("d_pred"), F.col("err")).alias("score"))


@query("lastvalue_baseline", f"WITH {_NEXT} SELECT event_id, {_BAND.format(d=chr(39) + 'stable' + chr(39) + ' = d_actual', e='err0')} AS score FROM e")
def lastvalue_baseline(spark, sf):
    p = _predicted(spark, sf)
    return p.select("event_id", K.banded(F.col("d_actual") == "stable", K.relative_error(F.col("before"), F.col("actual"))).alias("score"))


@query("score_delta", f"""
WITH {_NEXT}, s AS (SELECT event_type, round(({_BAND.format(d='d_actual = d_pred', e='err')}) * 100)::BIGINT AS a, round(({_BAND.format(d=chr(39) + 'stable' + chr(39) + ' = d_actual', e='err0')}) * 100)::BIGINT AS b FROM e)
SELECT event_type, count(*) AS n, (sum(a) / count(*)) / 100 AS mean_model, (sum(b) / count(*)) / 100 AS mean_baseline, ((sum(a) - sum(b)) / count(*)) / 100 AS delta FROM s GROUP BY 1""")
def score_delta(spark, sf):
    s = score_bands(spark, sf).withColumnRenamed("score", "a").join(lastvalue_baseline(spark, sf).withColumnRenamed("score", "b"), "event_id").join(load(spark, sf, "events").select("event_id", "event_type"), "event_id")
    # scores are hundredths, so they are summed as whole numbers
    a, b, n = (F.sum(F.round(F.col("a") * 100).cast("long")), F.sum(F.round(F.col("b") * 100).cast("long")), F.count(F.lit(1)))
    return s.groupBy("event_type").agg(n.alias("n"), (a / n / 100).alias("mean_model"), (b / n / 100).alias("mean_baseline"), ((a - b) / n / 100).alias("delta"))


_PRED = "CASE user_id % 4 WHEN 0 THEN ' rising' WHEN 1 THEN 'Falling' WHEN 2 THEN 'stable ' END"


def _guess():
    return F.when(F.col("user_id") % 4 == 0, " rising").when(F.col("user_id") % 4 == 1, "Falling").when(F.col("user_id") % 4 == 2, "stable ")


@query("direction_score_b", f"""
WITH {T._TRAJECTORY}, g2 AS (SELECT user_id, event_type, direction, trim({_PRED}) AS p FROM traj)
SELECT user_id, sum(CASE WHEN p IS NULL THEN 0 WHEN upper(p[1]) || lower(p[2:]) = direction THEN 1 WHEN lower(p) = 'stable' AND direction <> 'Stable' THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS score, count(*) AS n_labels FROM g2 GROUP BY 1""")
def direction_score_b(spark, sf):
    t = T.trajectory_direction(spark, sf)
    return t.groupBy("user_id").agg((F.sum(K.direction_points(_guess(), F.col("direction"))) / F.count(F.lit(1))).alias("score"), F.count(F.lit(1)).alias("n_labels"))


@query("choice_score_c", """
SELECT o_orderkey, substr(upper(trim(o_orderstatus)), 1, 1) = substr(upper(trim(CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE ' f' END)), 1, 1) AS right_choice FROM orders""")
def choice_score_c(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", K.choice_right(F.when(F.col("o_orderkey") % 2 == 0, "open").otherwise(" f"), F.col("o_orderstatus")).alias("right_choice"))


_BINS = """
c AS (SELECT CASE WHEN n_chars % 1001 > 1000 THEN 1 ELSE (n_chars % 1001) / 1000 END AS c, quality AS ok FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
b AS (SELECT CAST(greatest(ceil(c * 10), 1) AS BIGINT) AS bin, count(*) AS n, CAST(sum(CAST(round(c * 1000) AS BIGINT)) AS BIGINT) AS c1000, CAST(sum(ok) AS BIGINT) AS ok FROM c GROUP BY 1)"""


def _bins(spark, sf):
    d = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").where("quality is not null and n_chars is not null")
    b = K.calibration_bins(d, F.pmod("n_chars", F.lit(1001)) / 1000, F.col("quality"))
    # thousandths again, so that sums agree to the last bit
    return b.withColumn("confidence", F.round(F.col("confidence") * F.col("n") * 1000).cast("long") / 1000 / F.col("n")).withColumn("accuracy", F.round(F.col("accuracy") * F.col("n")).cast("long") / F.col("n"))


@query("reliability_points", f"WITH {_BINS} SELECT bin, n, c1000 / 1000 / n AS confidence, ok / n AS accuracy FROM b WHERE n >= 3")
def reliability_points(spark, sf):
    return _bins(spark, sf).where("n >= 3")


@query("ece", f"WITH {_BINS} SELECT round(sum(n * abs(ok / n - c1000 / 1000 / n)) / sum(n), 9) AS ece FROM b")
def ece(spark, sf):
    return K.ece(_bins(spark, sf)).select(F.round("ece", 9).alias("ece"))


@query("ablation_delta", """
WITH m AS (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'with' ELSE 'without' END AS c, CAST(sum(quality) AS BIGINT) / count(*) AS m FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang, max(m) FILTER (WHERE c = 'with') AS mean_with, max(m) FILTER (WHERE c = 'without') AS mean_without,
  max(m) FILTER (WHERE c = 'with') - max(m) FILTER (WHERE c = 'without') AS delta FROM m GROUP BY 1""")
def ablation_delta(spark, sf):
    d = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return K.ablation(d.withColumn("c", F.when(F.col("doc_id") % 2 == 0, "with").otherwise("without")), "lang", "c", "quality", "with", "without")


_ENDS = """
x AS (SELECT user_id, event_type, count(*) AS n, min_by(value, (ts, event_id)) AS b, max_by(value, (ts, event_id)) AS f, max_by(event_id, (ts, event_id)) % 3 AS k FROM events GROUP BY 1, 2),
y AS (SELECT *, f - b AS change, CASE k WHEN 0 THEN b - f WHEN 1 THEN f - b ELSE (f - b) / 2 END AS predicted FROM x WHERE n >= 2)"""


def _ends(spark, sf):
    at = F.struct("ts", "event_id")
    x = load(spark, sf, "events").groupBy(*T.KEYS).agg(F.count(F.lit(1)).alias("n"), F.min_by("value", at).alias("b"), F.max_by("value", at).alias("f"), (F.max_by("event_id", at) % 3).alias("k")).where("n >= 2")
    d = F.col("f") - F.col("b")
    return x.withColumn("change", d).withColumn("predicted", F.when(F.col("k") == 0, -d).when(F.col("k") == 1, d).otherwise(d / 2))


@query("mccs", f"WITH {_ENDS} SELECT event_type, CAST(count(*) FILTER (WHERE sign(change) = sign(predicted)) AS DOUBLE) / count(*) AS mccs, count(*) AS n FROM y GROUP BY 1")
def mccs(spark, sf):
    return _ends(spark, sf).groupBy("event_type").agg((F.count_if(F.signum("change") == F.signum("predicted")) / F.count(F.lit(1))).alias("mccs"), F.count(F.lit(1)).alias("n"))


@query("iec", f"WITH {_ENDS} SELECT event_type, round(avg(abs(change - predicted)), 6) AS iec FROM y GROUP BY 1")
def iec(spark, sf):
    return _ends(spark, sf).groupBy("event_type").agg(F.round(F.avg(F.abs(F.col("change") - F.col("predicted"))), 6).alias("iec"))


@query("leaderboard", f"""
WITH {_ENDS}, m AS (SELECT event_type AS model, CAST(count(*) FILTER (WHERE sign(change) = sign(predicted)) AS DOUBLE) / count(*) AS mccs FROM y GROUP BY 1)
SELECT model, mccs, CASE WHEN mccs > 0.65 THEN 'good' WHEN mccs > 0.55 THEN 'medium' ELSE 'poor' END AS status FROM m""")
def leaderboard(spark, sf):
    m = mccs(spark, sf).select(F.col("event_type").alias("model"), "mccs")
    return m.withColumn("status", F.when(F.col("mccs") > 0.65, "good").when(F.col("mccs") > 0.55, "medium").otherwise("poor")).orderBy(F.desc("mccs"), "model")


@query("invariance_shuffle", f"""
WITH {_ENDS}, p AS (SELECT *, lag(predicted) OVER (PARTITION BY event_type ORDER BY user_id) AS other FROM y)
SELECT event_type, CAST(count(*) FILTER (WHERE sign(change) = sign(predicted)) AS DOUBLE) / count(*) AS as_given, CAST(count(*) FILTER (WHERE sign(-change) = sign(-predicted)) AS DOUBLE) / count(*) AS swapped,
  CAST(count(*) FILTER (WHERE sign(change) = sign(other)) AS DOUBLE) / count(*) AS permuted FROM p WHERE other IS NOT NULL GROUP BY 1""")
def invariance_shuffle(spark, sf):
    """The sign match as given, with both sides swapped (which cannot change it), and with the next subject's prediction."""
    p = previous(_ends(spark, sf), ["event_type"], [F.col("user_id")], "predicted", "other").where("other is not null")
    rate = lambda a, b: F.count_if(F.signum(a) == F.signum(b)) / F.count(F.lit(1))
    return p.groupBy("event_type").agg(rate(F.col("change"), F.col("predicted")).alias("as_given"), rate(-F.col("change"), -F.col("predicted")).alias("swapped"), rate(F.col("change"), F.col("other")).alias("permuted"))


@query("tcae", f"""
WITH {T._RESAMPLED}, d AS (SELECT user_id, idx - 2 AS pos, v - 2 * lag(v, 1) OVER w + lag(v, 2) OVER w AS d2 FROM (SELECT user_id, idx, round(v, 6) AS v FROM res) WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
i AS (SELECT user_id, max_by(pos, (round(abs(d2), 5), -pos)) AS pos FROM d WHERE d2 IS NOT NULL GROUP BY 1)
SELECT median(abs(pos - user_id % 96)) * 0.5::DOUBLE AS tcae FROM i""")
def tcae(spark, sf):
    i = T.inflection_index(spark, sf).select(F.abs(F.col("inflection_idx") - F.col("user_id") % 96).alias("off"))
    return quantiles(i, [], "off", [0.5]).select((F.col("quantile") * 0.5).alias("tcae"))


@query("shape_l2", f"""
WITH {T._RESAMPLED}, r AS (SELECT user_id, idx, round(v, 6) AS v FROM res), m AS (SELECT user_id, avg(v) AS a, stddev_pop(v) AS s FROM r GROUP BY 1),
z AS (SELECT r.user_id, idx, CASE WHEN s > 1e-9 THEN (v - a) / s ELSE 0 END AS z FROM r JOIN m USING (user_id))
SELECT a.user_id, round(sqrt(sum((a.z - b.z) * (a.z - b.z))), 4) AS shape_l2 FROM z a JOIN z b ON b.user_id = a.user_id + 1 AND a.idx = b.idx GROUP BY 1""")
def shape_l2(spark, sf):
    r = T.resample_96(spark, sf)
    w = Window.partitionBy("user_id")
    z = r.withColumn("a", F.avg("v").over(w)).withColumn("s", F.stddev_pop("v").over(w)).select("user_id", "idx", F.when(F.col("s") > 1e-9, (F.col("v") - F.col("a")) / F.col("s")).otherwise(0.0).alias("z"))
    b = z.select((F.col("user_id") - 1).alias("user_id"), "idx", F.col("z").alias("z2"))
    return z.join(b, ["user_id", "idx"]).groupBy("user_id").agg(F.round(F.sqrt(F.sum((F.col("z") - F.col("z2")) * (F.col("z") - F.col("z2")))), 4).alias("shape_l2"))


@query("tier_rollup", """
SELECT coalesce(tier, 'all') AS tier, coalesce(event_type, 'all') AS action, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean
FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN 't1' WHEN user_id % 3 = 1 THEN 't2' ELSE 't3' END AS tier FROM events) GROUP BY ROLLUP (tier, event_type)""")
def tier_rollup(spark, sf):
    tier = F.when(F.col("user_id") % 3 == 0, "t1").when(F.col("user_id") % 3 == 1, "t2").otherwise("t3")
    g = load(spark, sf, "events").withColumn("tier", tier).rollup("tier", "event_type").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("mean"))
    return g.select(F.coalesce("tier", F.lit("all")).alias("tier"), F.coalesce("event_type", F.lit("all")).alias("action"), "n", "mean")
