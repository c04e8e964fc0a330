"""Queries on subjects' events in time. The subject is user_id, a series is (user_id, event_type)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import direction as D
from ..functions.timewin import micros_between
from ..operators import anchor as A, matching as M, series as S
from ..session import load
from .registry import query

KEYS = ["user_id", "event_type"]
#: Reference ranges of the stand-in series: type -> (low, high, mean, deviation).
RANGES = {"click": (20.0, 60.0, 40.0, 10.0), "error": (10.0, 50.0, 30.0, 10.0), "purchase": (15.0, 70.0, 45.0, 12.0), "signup": (25.0, 80.0, 50.0, 15.0), "view": (5.0, 45.0, 25.0, 10.0)}
_RANGES = "ranges(event_type, low, high, mean, sd) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, (a, b, c, d) in RANGES.items()) + ")"
_DIR = "CASE WHEN {b} <= 0 THEN CASE WHEN {a} > 0 THEN 'rising' ELSE 'stable' END WHEN ({a} - {b}) / {b} > 0.2 THEN 'rising' WHEN ({a} - {b}) / {b} < -0.2 THEN 'falling' ELSE 'stable' END"
_H = "(epoch_us({b}) - epoch_us({a})) / 3.6e9"
#: D.rounded: a half is one of the shortest decimal that stands for the number, to nine digits.
_ROUND = "coalesce(round(TRY_CAST({x}::VARCHAR AS DECIMAL(28, 9)), {d})::DOUBLE, round({x}, {d}))"


def events(spark, sf):
    return load(spark, sf, "events")


def ranges(spark):
    return spark.createDataFrame([(k, *v) for k, v in RANGES.items()], "event_type string, low double, high double, mean double, sd double")


@query("next_pair_window", f"""
WITH n AS (SELECT user_id, event_type, event_id, ts, value AS before, lead(value) OVER w AS after, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS ts2,
  row_number() OVER w AS n_context FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
h AS (SELECT *, {_H.format(a='ts', b='ts2')} AS hours_ahead FROM n)
SELECT user_id, event_type, event_id, before, after, next_id, hours_ahead, n_context, {_DIR.format(b='before', a='after')} AS direction,
  CASE WHEN n_context <= 1 THEN 'hard' WHEN n_context = 2 THEN 'medium' ELSE 'easy' END AS difficulty
FROM h WHERE hours_ahead BETWEEN 1 AND 48 AND before <> after""")
def next_pair_window(spark, sf):
    return S.next_pairs(events(spark, sf), KEYS)


_PAIRS = f"""
r AS (SELECT user_id, event_id AS id, ts AS t, value AS v, lag(value) OVER w AS v_prev, row_number() OVER w AS i
  FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
pairs AS (SELECT a.user_id, a.id AS visible_id, b.id AS target_id, a.v_prev, a.v AS v_visible, b.v AS v_target, {_H.format(a='a.t', b='b.t')} AS gap_hours, b.i - a.i - 1 AS n_between
  FROM r a JOIN r b ON a.user_id = b.user_id AND a.i < b.i WHERE {_H.format(a='a.t', b='b.t')} BETWEEN 4 AND 48),
rev AS (SELECT *, {_DIR.format(b='v_prev', a='v_visible')} AS visible_trend, {_DIR.format(b='v_visible', a='v_target')} AS actual_dir FROM pairs WHERE v_prev IS NOT NULL)"""


@query("visible_trend_reversal", f"""
WITH {_PAIRS} SELECT *, visible_trend || '_to_' || actual_dir AS reversal_type FROM rev WHERE visible_trend <> actual_dir""")
def visible_trend_reversal(spark, sf):
    return S.trend_reversals(events(spark, sf).where("event_type = 'error'"), ["user_id"])


@query("best_window_per_subject", f"""
WITH {_PAIRS}, s AS (SELECT *, 3 * CASE WHEN v_visible > 0 THEN abs(v_target - v_visible) / v_visible ELSE 0 END + 0.01::DOUBLE * n_between
  + CASE WHEN gap_hours BETWEEN 6 AND 24 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM rev WHERE visible_trend <> actual_dir)
SELECT user_id, visible_id, target_id, gap_hours, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, target_id, visible_id) AS r FROM s) WHERE r = 1""")
def best_window_per_subject(spark, sf):
    return S.best_window(visible_trend_reversal(spark, sf), "user_id").select("user_id", "visible_id", "target_id", "gap_hours", "score")


@query("asof_backward", """
SELECT l.user_id, l.event_id, r.event_id AS asof_id, r.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
LEFT JOIN LATERAL (SELECT event_id, value FROM events e WHERE e.event_type = 'error' AND e.user_id = l.user_id AND e.ts <= l.ts ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) r ON true""")
def asof_backward(spark, sf):
    e = events(spark, sf)
    return A.asof_backward(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), "user_id")


@query("asof_nearest", """
SELECT l.user_id, l.event_id, r.event_id AS nearest_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l
LEFT JOIN LATERAL (SELECT event_id FROM events e WHERE e.event_type = 'view' AND e.user_id = l.user_id
  ORDER BY abs(epoch_us(e.ts) - epoch_us(l.ts)), e.ts, e.event_id LIMIT 1) r ON true""")
def asof_nearest(spark, sf):
    e = events(spark, sf)
    return A.asof_nearest(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id")


@query("interval_join_trigger_proc", """
WITH t AS (SELECT e.*, x.threshold FROM events e JOIN (VALUES ('view', 120.0::DOUBLE), ('error', 150.0::DOUBLE)) x(event_type, threshold) USING (event_type) WHERE e.value > x.threshold),
j AS (SELECT t.user_id, t.event_id AS trigger_id, p.event_id AS procedure_id, CAST(floor((epoch_us(p.ts) - epoch_us(t.ts)) / 8.64e10) AS BIGINT) AS days, (t.value - t.threshold) / t.threshold AS severity
  FROM t JOIN events p ON p.user_id = t.user_id AND p.event_type = 'purchase')
SELECT * FROM j WHERE days BETWEEN 1 AND 60""")
def interval_join_trigger_proc(spark, sf):
    e = events(spark, sf)
    rules = spark.createDataFrame([("view", 120.0), ("error", 150.0)], "event_type string, threshold double")
    triggers = e.join(F.broadcast(rules), "event_type").where("value > threshold")  # two rows
    return A.interval_join(triggers, e.where("event_type = 'purchase'"), "user_id")


_WINDOWS = f"""
a AS (SELECT user_id, min_by(event_id, (ts, event_id)) AS anchor_id, min(ts) AS anchor_ts FROM events WHERE event_type = 'purchase' GROUP BY 1),
w AS (SELECT e.*, anchor_ts, {_H.format(a='anchor_ts', b='e.ts')} AS h FROM events e JOIN a USING (user_id)),
s AS (SELECT *, CASE WHEN h BETWEEN -72 AND 0 THEN 'pre' WHEN h > 0 AND h <= 72 THEN 'post' END AS side FROM w)"""


def _windows(spark, sf):
    e = events(spark, sf)
    return A.pre_post(A.first_event(e, "user_id", F.col("event_type") == "purchase"), e, "user_id", 72)


@query("prepost_counts", f"""
WITH {_WINDOWS} SELECT user_id, event_type, count(*) FILTER (WHERE side = 'pre') AS n_pre, count(*) FILTER (WHERE side = 'post') AS n_post FROM s WHERE side IS NOT NULL
GROUP BY 1, 2 HAVING count(*) FILTER (WHERE side = 'pre') >= 1 AND count(*) FILTER (WHERE side = 'post') >= 1""")
def prepost_counts(spark, sf):
    return A.eligible(_windows(spark, sf), KEYS, 1)


_TRAJECTORY = f"""
{_WINDOWS}, {_RANGES},
g AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) FILTER (WHERE side = 'pre') AS baseline, median(value) FILTER (WHERE side = 'post') AS post_rep,
  first(low) AS low, first(high) AS high, count(*) FILTER (WHERE side = 'pre') AS n_pre, count(*) FILTER (WHERE side = 'post') AS n_post
  FROM s JOIN ranges USING (event_type) WHERE side IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2),
traj AS (SELECT *, CASE WHEN low < high THEN CASE WHEN post_rep BETWEEN low AND high THEN 'Stable' WHEN post_rep >= baseline THEN 'Rising' ELSE 'Falling' END
  ELSE 'Stable' END AS direction FROM g WHERE baseline IS NOT NULL AND post_rep IS NOT NULL)"""


@query("trajectory_direction", f"WITH {_TRAJECTORY} SELECT user_id, event_type, baseline, post_rep, n_pre, n_post, direction FROM traj")
def trajectory_direction(spark, sf):
    w = _windows(spark, sf).join(F.broadcast(ranges(spark)), "event_type")  # five rows
    return A.trajectory(w, KEYS).select(*KEYS, "baseline", "post_rep", "n_pre", "n_post", "direction")


@query("pre_anchor_summary", f"""
WITH {_WINDOWS} SELECT user_id, event_type, count(value) AS n, min_by(value, (ts, event_id)) AS first_value, max_by(value, (ts, event_id)) AS latest_value,
  min(value) AS min_value, max(value) AS max_value, bool_or(value > 100) AS any_abnormal FROM w WHERE ts <= anchor_ts GROUP BY 1, 2 HAVING count(value) > 0""")
def pre_anchor_summary(spark, sf):
    e = events(spark, sf)
    rows = A.before_anchor(e, A.first_event(e, "user_id", F.col("event_type") == "purchase"), "user_id")
    return A.summary(rows, KEYS, abnormal=F.col("value") > 100)


@query("prior_events_distinct", f"""
WITH {_WINDOWS} SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS prior FROM w WHERE ts < anchor_ts GROUP BY 1""")
def prior_events_distinct(spark, sf):
    e = events(spark, sf)
    return A.prior_distinct(e, A.first_event(e, "user_id", F.col("event_type") == "purchase"), "user_id", "event_type")


_SESSIONS = """
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 86400000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS BIGINT) AS session FROM g)"""


@query("sessionise_panel", f"""
WITH {_SESSIONS}, p AS (SELECT user_id, session, event_type, min_by(value, (ts, event_id)) AS first_value FROM s GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id, session) AS n_kinds FROM p) WHERE n_kinds >= 3""")
def sessionise_panel(spark, sf):
    return S.session_panels(events(spark, sf), "user_id", "event_type", gap_us=86_400_000_000)


@query("rule_priority_pick", f"""
WITH {_SESSIONS}, r(event_type, above, threshold, action, priority) AS (VALUES ('error', true, 120.0::DOUBLE, 'stop', 1), ('view', true, 100.0::DOUBLE, 'check', 2), ('click', false, 2.0::DOUBLE, 'wake', 3)),
h AS (SELECT user_id, session, event_id, action, priority FROM s JOIN r USING (event_type) WHERE CASE WHEN above THEN value > threshold ELSE value < threshold END)
SELECT user_id, session, event_id, action, n_hits FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY priority, event_id) AS k, count(*) OVER (PARTITION BY user_id, session) AS n_hits FROM h) WHERE k = 1""")
def rule_priority_pick(spark, sf):
    rules = spark.createDataFrame([("error", True, 120.0, "stop", 1), ("view", True, 100.0, "check", 2), ("click", False, 2.0, "wake", 3)], "event_type string, above boolean, threshold double, action string, priority int")
    s = S.sessions(events(spark, sf), "user_id", 86_400_000_000)
    hits = s.join(F.broadcast(rules), "event_type").where(F.when(F.col("above"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold")))  # three rows
    w = Window.partitionBy("user_id", "session")
    return hits.withColumn("k", F.row_number().over(w.orderBy("priority", "event_id"))).withColumn("n_hits", F.count(F.lit(1)).over(w)).where("k = 1").select("user_id", "session", "event_id", "action", "n_hits")


_X = "(epoch_us(ts) - 1704067200000000) / 3.6e9"


def _x():
    return micros_between(F.lit("2024-01-01").cast("timestamp_ntz"), "ts") / F.lit(3.6e9)


@query("slope_volatility", f"""
WITH f AS (SELECT user_id, event_type, count(*) AS n, regr_slope(value, {_X}) AS slope, regr_sxx(value, {_X}) AS sxx, regr_syy(value, {_X}) AS syy, regr_sxy(value, {_X}) AS sxy FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, round(slope, 6) AS slope, round(sqrt(greatest(syy - sxy * sxy / sxx, 0) / n), 6) AS volatility FROM f WHERE n >= 2 AND sxx > 0""")
def slope_volatility(spark, sf):
    s = S.slopes(events(spark, sf), KEYS, _x(), F.col("value"))
    return s.withColumn("slope", F.round("slope", 6)).withColumn("volatility", F.round("volatility", 6))


_RESAMPLED = f"""
pt AS (SELECT user_id, event_id, {_X} AS x, value AS y FROM events WHERE event_type = 'error'),
seg AS (SELECT user_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, min(x) OVER (PARTITION BY user_id) AS lo, max(x) OVER (PARTITION BY user_id) AS hi, row_number() OVER w AS i
  FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id)),
grid AS (SELECT user_id, g AS idx, lo, hi, CASE WHEN hi > lo THEN lo + g * ((hi - lo) / 95) ELSE lo END AS xx FROM (SELECT DISTINCT user_id, lo, hi FROM seg) u, range(96) t(g)),
res AS (SELECT g.user_id, g.idx, CASE WHEN g.hi = g.lo THEN s.y0 ELSE s.y0 + (s.y1 - s.y0) * (least(g.xx, s.x1) - s.x0) / (s.x1 - s.x0) END AS v
  FROM grid g JOIN seg s ON s.user_id = g.user_id AND CASE WHEN g.hi = g.lo THEN s.i = 1 ELSE s.x1 > s.x0 AND ((g.xx > s.x0 AND g.xx <= s.x1) OR (g.idx = 0 AND s.x0 = g.lo) OR (g.idx = 95 AND s.x1 = g.hi AND g.xx > s.x1)) END)"""


def _resampled(spark, sf):
    p = events(spark, sf).where("event_type = 'error'").select("user_id", "event_id", _x().alias("x"), F.col("value").alias("y"))
    return S.resampled(p, ["user_id"])


@query("resample_96", f"WITH {_RESAMPLED} SELECT user_id, idx, round(v, 6) AS v FROM res")
def resample_96(spark, sf):
    return _resampled(spark, sf).withColumn("v", F.round("v", 6))


@query("inflection_index", f"""
WITH {_RESAMPLED}, d AS (SELECT user_id, idx - 2 AS pos, v - 2 * lag(v, 1) OVER w + lag(v, 2) OVER w AS d2 FROM (SELECT user_id, idx, round(v, 6) AS v FROM res) WINDOW w AS (PARTITION BY user_id ORDER BY idx))
SELECT user_id, max_by(pos, (round(abs(d2), 5), -pos)) AS inflection_idx FROM d WHERE d2 IS NOT NULL GROUP BY 1""")
def inflection_index(spark, sf):
    return S.inflections(resample_96(spark, sf), ["user_id"], digits=5)


_SEVERITY = """
b AS (SELECT user_id, event_type, max(value) AS m FROM events GROUP BY 1, 2),
sev AS (SELECT user_id, CAST(least(sum(CASE WHEN m > 200 THEN 4 WHEN m > 120 THEN 3 WHEN m > 80 THEN 2 WHEN m > 40 THEN 1 ELSE 0 END), 24) AS BIGINT) AS severity FROM b GROUP BY 1)"""
_BIN = "CASE WHEN severity < 4 THEN 'mild' WHEN severity < 7 THEN 'moderate' WHEN severity < 10 THEN 'moderately_severe' ELSE 'severe' END"


def _severity(spark, sf):
    m = F.col("m")
    band = F.when(m > 200, 4).when(m > 120, 3).when(m > 80, 2).when(m > 40, 1).otherwise(0)
    return events(spark, sf).groupBy(*KEYS).agg(F.max("value").alias("m")).groupBy("user_id").agg(F.least(F.sum(band), F.lit(24)).cast("long").alias("severity"))


@query("severity_score_bin", f"WITH {_SEVERITY} SELECT user_id, severity, {_BIN} AS severity_bin FROM sev")
def severity_score_bin(spark, sf):
    return _severity(spark, sf).withColumn("severity_bin", D.severity_bin("severity"))


PAIR_SQL = f"""{_SEVERITY},
sl AS (SELECT user_id, event_type, round(regr_slope(value, {_X}), 6) AS slope FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2 HAVING count(*) >= 2 AND regr_sxx(value, {_X}) > 0),
fl AS (SELECT user_id, max((event_type = 'error' AND value > 90)::INT) AS f_error, max((event_type = 'view' AND value > 90)::INT) AS f_view, max((event_type LIKE 'sign%' AND value > 90)::INT) AS f_sign FROM events GROUP BY 1),
ep AS (SELECT user_id, {_BIN} AS severity_bin, severity, e.slope AS s1, sign(e.slope)::INT AS d1, v.slope AS s2, sign(v.slope)::INT AS d2, f_error, f_view, f_sign, (user_id % 4)::INT AS kind
  FROM sev JOIN fl USING (user_id) LEFT JOIN (SELECT * FROM sl WHERE event_type = 'error') e USING (user_id) LEFT JOIN (SELECT * FROM sl WHERE event_type = 'view') v USING (user_id)),
scored AS (SELECT a.severity_bin, a.user_id AS a_id, b.user_id AS b_id, a.kind AS a_kind, b.kind AS b_kind,
  (a.f_error <> b.f_error)::BIGINT + (a.f_view <> b.f_view)::BIGINT + (a.f_sign <> b.f_sign)::BIGINT AS hamming, 10.0::DOUBLE * ((a.f_error <> b.f_error)::BIGINT + (a.f_view <> b.f_view)::BIGINT + (a.f_sign <> b.f_sign)::BIGINT) + abs(a.severity - b.severity)
  + 5.0::DOUBLE * coalesce(CASE WHEN abs(a.s1) + abs(b.s1) > 0.001 THEN abs(a.s1 - b.s1) / (CASE WHEN abs(a.s1) > abs(b.s1) THEN abs(a.s1) ELSE abs(b.s1) END) END, 0)
  + 5.0::DOUBLE * coalesce(CASE WHEN abs(a.s2) + abs(b.s2) > 0.001 THEN abs(a.s2 - b.s2) / (CASE WHEN abs(a.s2) > abs(b.s2) THEN abs(a.s2) ELSE abs(b.s2) END) END, 0) AS score
  FROM ep a JOIN ep b ON a.severity_bin = b.severity_bin AND a.kind < b.kind
  AND (a.s1 IS NULL OR b.s1 IS NULL OR (a.d1 = b.d1 AND ((abs(a.s1) < 0.001 AND abs(b.s1) < 0.001) OR abs(a.s1 - b.s1) <= 0.2::DOUBLE * (CASE WHEN abs(a.s1) > abs(b.s1) THEN abs(a.s1) ELSE abs(b.s1) END))))
  AND (a.s2 IS NULL OR b.s2 IS NULL OR (a.d2 = b.d2 AND ((abs(a.s2) < 0.001 AND abs(b.s2) < 0.001) OR abs(a.s2 - b.s2) <= 0.2::DOUBLE * (CASE WHEN abs(a.s2) > abs(b.s2) THEN abs(a.s2) ELSE abs(b.s2) END)))))"""


@query("pair_candidates_scored", f"WITH {PAIR_SQL} SELECT severity_bin, a_id, b_id, a_kind, b_kind, hamming, round(score, 9) AS score FROM scored")
def pair_candidates_scored(spark, sf):
    from .cohorts import comorbidity_flags

    e = severity_score_bin(spark, sf).join(comorbidity_flags(spark, sf), "user_id").withColumn("kind", F.pmod("user_id", F.lit(4)).cast("int"))
    slope = S.slopes(events(spark, sf).where("event_type in ('error', 'view')"), KEYS, _x(), F.col("value")).withColumn("slope", F.round("slope", 6))
    for k, kind in ((1, "error"), (2, "view")):
        own = slope.where(F.col("event_type") == kind).select("user_id", F.col("slope").alias(f"s{k}"), F.signum("slope").cast("int").alias(f"d{k}"))
        e = e.join(own, "user_id", "left")
    pairs = M.candidate_pairs(e, "severity_bin", "kind", "user_id", ["f_error", "f_view", "f_sign"], [("d1", "s1"), ("d2", "s2")])
    return pairs.withColumn("score", F.round("score", 9))


@query("range_flag", f"""
WITH {_RANGES} SELECT event_id, CASE WHEN value < low THEN 'low' WHEN value > high THEN 'abnormal' END AS flag FROM events JOIN ranges USING (event_type)""")
def range_flag(spark, sf):
    return events(spark, sf).join(F.broadcast(ranges(spark)), "event_type").select("event_id", D.range_flag("value", "low", "high").alias("flag"))


@query("zscore_translate", f"""
WITH {_RANGES} SELECT event_id, (value - (low + high) / 2) / ((high - low) / 4) AS z, 50 + (value - mean) / sd * 5 AS translated FROM events JOIN ranges USING (event_type)""")
def zscore_translate(spark, sf):
    e = events(spark, sf).join(F.broadcast(ranges(spark)), "event_type")
    return e.select("event_id", D.z_on_range("value", "low", "high").alias("z"), D.translated("value", "mean", "sd", F.lit(50), F.lit(5)).alias("translated"))


@query("counterfactual_pivot", f"""
WITH {_RANGES}, x AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)
SELECT user_id, event_type, value, CASE WHEN event_type = 'error' THEN (low + high) / 2 ELSE value END AS counterfactual FROM x JOIN ranges USING (event_type)""")
def counterfactual_pivot(spark, sf):
    last = events(spark, sf).groupBy(*KEYS).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")).join(F.broadcast(ranges(spark)), "event_type")
    return last.select(*KEYS, "value", F.when(F.col("event_type") == "error", (F.col("low") + F.col("high")) / 2).otherwise(F.col("value")).alias("counterfactual"))


@query("subject_profile", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT e.user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types, CAST(sum(length(props)) // 4 AS BIGINT) AS n_tokens, any_value(m.value) AS upper_median
FROM events e JOIN (SELECT user_id, value FROM r WHERE i = n // 2) m USING (user_id) GROUP BY 1""")
def subject_profile(spark, sf):
    e = events(spark, sf)
    w = Window.partitionBy("user_id")
    ranked = e.withColumn("i", F.row_number().over(w.orderBy("value", "event_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    middle = F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("value")))
    return ranked.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_type").alias("n_types"), F.floor(F.sum(F.length("props")) / 4).alias("n_tokens"), middle.alias("upper_median"))


@query("case_record", f"""
WITH b AS (SELECT user_id, visible_id, target_id, gap_hours, row_number() OVER (PARTITION BY user_id ORDER BY gap_hours, target_id, visible_id) AS r FROM (WITH {_PAIRS} SELECT * FROM rev WHERE visible_trend <> actual_dir)),
c AS (SELECT * FROM b WHERE r = 1),
t AS (SELECT c.user_id, c.visible_id, c.target_id, e.event_id, e.value, row_number() OVER (PARTITION BY c.user_id ORDER BY e.ts DESC, e.event_id DESC) AS k
  FROM c JOIN events v ON v.event_id = c.visible_id JOIN events e ON e.user_id = c.user_id AND e.ts <= v.ts)
SELECT user_id, visible_id, target_id, count(*) AS n_timeline, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k DESC) AS timeline FROM t WHERE k <= 12 GROUP BY 1, 2, 3""")
def case_record(spark, sf):
    """Cases as nested records, flattened to columns that can be compared."""
    return case_records(spark, sf).select("user_id", "question.visible_id", "question.target_id", F.size("timeline").cast("long").alias("n_timeline"), F.concat_ws(",", F.transform("timeline", lambda x: x["event_id"].cast("string"))).alias("timeline"))


def case_records(spark, sf, cap: int = 12):
    e = events(spark, sf)
    w = Window.partitionBy("user_id").orderBy("gap_hours", "target_id", "visible_id")
    chosen = visible_trend_reversal(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1")
    seen = chosen.join(e.select(F.col("event_id").alias("visible_id"), F.col("ts").alias("cut")), "visible_id").select("user_id", "visible_id", "target_id", "cut")
    last = e.join(seen, "user_id").where("ts <= cut").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("k") <= cap)
    return last.groupBy("user_id", "visible_id", "target_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value"))).alias("timeline")).select("user_id", F.struct("visible_id", "target_id").alias("question"), "timeline")
