"""Whole case records: next-event bundles, pool slices, episodes, full records, translated cases."""

from pyspark.sql import functions as F

from ..functions import direction as D, guards as G
from ..operators import anchor as A, bundles as B, charts, cohort as C, contexts as X, episodes as E, records as R, series as S, translation
from ..session import load
from ..sources import slices
from . import timelines as T
from .registry import query

#: Rules of the stand-in chart: code, direction, threshold, action; and the procedures that answer an action.
RULES = [("view", "above", 90.0, "urgent"), ("error", "above", 80.0, "watch"), ("error", "below", 2.0, "low")]
ALLOWED = [("urgent", "p0"), ("urgent", "p1"), ("watch", "p1"), ("watch", "p2"), ("low", "p0")]
KINDS = [("inpatient", "Inpatient"), ("emergency", "Emergency"), ("emergent", "Emergency"), ("outpatient", "Outpatient")]
GUIDE = "values above the limit call for a procedure within the day"

_CHART = """
e AS (SELECT user_id AS subject, ts, event_id, value, CASE event_type WHEN 'error' THEN 'measurement' WHEN 'view' THEN 'measurement' WHEN 'purchase' THEN 'procedure' WHEN 'signup' THEN 'visit' ELSE CASE WHEN event_id % 2 = 0 THEN 'condition' ELSE 'drug' END END AS role,
  CASE event_type WHEN 'purchase' THEN 'p' || event_id % 3 ELSE event_type END AS code,
  CASE event_type WHEN 'click' THEN CASE WHEN event_id % 9 > 0 THEN 'n' || event_id % 11 END WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'Emergency Room' WHEN 1 THEN 'Outpatient Visit' WHEN 2 THEN 'Telehealth' ELSE 'Inpatient Visit' END ELSE event_type END AS name,
  CASE WHEN event_id % 4 <> 0 THEN user_id * 1000 + date_diff('day', DATE '2024-01-01', ts::DATE) // 3 END AS visit FROM events)"""


def chart(spark, sf):
    """events as a chart: subject, ts, event_id, value, role, code, name, visit."""
    t, i = F.col("event_type"), F.col("event_id")
    role = F.when(t.isin("error", "view"), "measurement").when(t == "purchase", "procedure").when(t == "signup", "visit").when(i % 2 == 0, "condition").otherwise("drug")
    code = F.when(t == "purchase", F.concat(F.lit("p"), (i % 3).cast("string"))).otherwise(t)
    places = F.element_at(F.array(*map(F.lit, ["Emergency Room", "Outpatient Visit", "Telehealth", "Inpatient Visit"])), (i % 4 + 1).cast("int"))
    name = F.when(t == "click", F.when(i % 9 > 0, F.concat(F.lit("n"), (i % 11).cast("string")))).when(t == "signup", places).otherwise(t)
    visit = F.when(i % 4 != 0, F.col("user_id") * 1000 + F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 3))
    return load(spark, sf, "events").select(F.col("user_id").alias("subject"), "ts", "event_id", "value", role.alias("role"), code.alias("code"), name.alias("name"), visit.alias("visit"))


def _values(name, rows):
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return f"{name} AS (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


_BUNDLES = f"""
WITH {_CHART}, {_values("rules(code, direction, threshold, action)", RULES)}, {_values("allowed(action, code)", ALLOWED)}, {_values("refs(name, low, high)", [("error", 10.0, 50.0), ("view", 5.0, 45.0)])},
m AS (SELECT * FROM e WHERE role = 'measurement' AND value IS NOT NULL),
t AS (SELECT m.*, action, CASE direction WHEN 'above' THEN value - threshold ELSE threshold - value END / threshold AS severity FROM m JOIN rules USING (code) WHERE CASE direction WHEN 'above' THEN value > threshold ELSE value < threshold END),
j AS (SELECT t.subject, t.action, severity, t.ts AS t0, t.event_id AS trigger_id, p.ts AS t1, p.event_id AS procedure_id, p.code AS procedure
  FROM t JOIN allowed ON allowed.action = t.action JOIN e p ON p.subject = t.subject AND p.role = 'procedure' AND p.code = allowed.code WHERE floor((epoch_us(p.ts) - epoch_us(t.ts)) / 8.64e10) BETWEEN 1 AND 60),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY severity DESC, t0, trigger_id, action, t1, procedure_id) AS r FROM j) WHERE r = 1),
c AS (SELECT * EXCLUDE (r, k) FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY severity DESC, subject) AS k FROM b) WHERE k <= 6 ORDER BY severity DESC, subject LIMIT 15),
v AS (SELECT subject, visit, min(ts) AS t_min, max(ts) AS t_max,
  coalesce(min_by(kind, (ts, event_id)) FILTER (WHERE kind IS NOT NULL), 'Inpatient') AS kind FROM (SELECT *, CASE WHEN role = 'visit' THEN CASE WHEN lower(name) LIKE '%inpatient%' THEN 'Inpatient' WHEN lower(name) LIKE '%emergency%' OR lower(name) LIKE '%emergent%' THEN 'Emergency' WHEN lower(name) LIKE '%outpatient%' THEN 'Outpatient' END END AS kind FROM e WHERE visit IS NOT NULL) GROUP BY 1, 2),
f AS (SELECT subject, visit, role, name, min((ts, event_id)) AS seen FROM e WHERE visit IS NOT NULL AND role IN ('condition', 'drug') AND name IS NOT NULL GROUP BY ALL),
l AS (SELECT subject, visit, string_agg(name, ',' ORDER BY seen) FILTER (WHERE role = 'condition' AND n <= 8) AS diagnoses, string_agg(name, ',' ORDER BY seen) FILTER (WHERE role = 'drug' AND n <= 15) AS medications
  FROM (SELECT *, row_number() OVER (PARTITION BY subject, visit, role ORDER BY seen) AS n FROM f) GROUP BY 1, 2),
o AS (SELECT c.subject, first(m.visit ORDER BY abs(epoch_us(m.ts) - epoch_us(t0)), m.ts, m.event_id) AS own FROM c JOIN m USING (subject) WHERE m.code IN (SELECT code FROM rules) GROUP BY 1),
a AS (SELECT c.subject, first(v.visit ORDER BY t_min, v.visit) AS straddling FROM c JOIN v USING (subject) WHERE t_min <= t0 AND epoch_us(t0) - epoch_us(t_max) <= 86400000000 GROUP BY 1),
h AS (SELECT c.*, coalesce(own, straddling) AS visit FROM c LEFT JOIN o USING (subject) LEFT JOIN a USING (subject)),
p AS (SELECT v.*, diagnoses, medications, row_number() OVER (PARTITION BY h.subject ORDER BY t_min DESC, v.visit DESC) AS n FROM h JOIN v ON v.subject = h.subject AND v.visit IS DISTINCT FROM h.visit LEFT JOIN l ON l.subject = v.subject AND l.visit = v.visit),
i AS (SELECT subject, string_agg(t_min::DATE || '|' || t_max::DATE || '|' || kind || '|' || coalesce(diagnoses, '') || '|' || coalesce(medications, ''), ';' ORDER BY t_min, visit) AS history FROM p WHERE n <= 5 GROUP BY 1),
w AS (SELECT * FROM (SELECT m.subject, m.ts::DATE AS date, m.name, m.value, row_number() OVER (PARTITION BY m.subject, m.name, m.ts::DATE ORDER BY m.ts, m.event_id) AS r FROM m JOIN c USING (subject) WHERE epoch_us(m.ts) - epoch_us(t0) BETWEEN -259200000000 AND 86400000000) WHERE r = 1),
x AS (SELECT subject, copy, string_agg(date || '|' || name || '|' || CASE WHEN copy = 'trimmed' AND name = 'view' THEN '___' ELSE CAST(round(value, 2) AS VARCHAR) END || '|' || CASE WHEN value < low THEN 'low' WHEN value > high THEN 'abnormal' ELSE '-' END || '|' || low || '|' || high, ';' ORDER BY date, name) AS labs
  FROM w JOIN refs USING (name) CROSS JOIN (VALUES ('full'), ('trimmed')) z(copy) GROUP BY 1, 2)
SELECT h.subject, z.copy, action, procedure, coalesce(year(t0) - CASE WHEN h.subject % 5 > 0 THEN 1950 + h.subject % 40 END, 50)::BIGINT AS age, CASE WHEN h.subject % 5 > 0 THEN CASE WHEN h.subject % 3 = 0 THEN 'Female' ELSE 'Male' END ELSE 'Unknown' END AS gender,
  coalesce(v.t_min, t0)::DATE::VARCHAR AS admit_date, coalesce(l.diagnoses, '') AS diagnoses, coalesce(l.medications, '') AS medications, coalesce(history, '') AS history, coalesce(labs, '') AS lab_data, CASE WHEN z.copy = 'trimmed' THEN '{GUIDE}' END AS guidelines
FROM h CROSS JOIN (VALUES ('full'), ('trimmed')) z(copy) LEFT JOIN v ON v.subject = h.subject AND v.visit = h.visit LEFT JOIN l ON l.subject = h.subject AND l.visit = h.visit LEFT JOIN i ON i.subject = h.subject LEFT JOIN x ON x.subject = h.subject AND x.copy = z.copy"""


def next_event_records(spark, sf):
    e = chart(spark, sf)
    known = F.col("subject") % 5 > 0
    people = e.select("subject").distinct().where(known).select("subject", (1950 + F.col("subject") % 40).alias("birth_year"), F.when(F.col("subject") % 3 == 0, "Female").otherwise("Male").alias("gender"))
    rules = spark.createDataFrame(RULES, "code string, direction string, threshold double, action string")
    ranges = spark.createDataFrame([("error", 10.0, 50.0), ("view", 5.0, 45.0)], "label string, low double, high double")
    return B.bundles(e, people, rules, spark.createDataFrame(ALLOWED, "action string, code string"), ranges, KINDS, ["view"], GUIDE, per_action=6, cases=15)


@query("next_event_bundle", _BUNDLES)
def next_event_bundle(spark, sf):
    """Both copies of the records, their lists as text."""
    r = next_event_records(spark, sf)
    return r.select(
        "subject", "copy", "action", "procedure", "age", "gender", "admit_date", F.array_join("diagnoses", ",").alias("diagnoses"), F.array_join("medications", ",").alias("medications"),
        B.as_text(F.col("history"), ["admit_date", "discharge_date", "admission_type", "diagnoses", "medications"]).alias("history"), B.as_text(F.col("lab_data"), ["date", "label", "value", "flag", "ref_lower", "ref_upper"]).alias("lab_data"), "guidelines",
    )


BANDS = {"error": [20.0, 40.0, 80.0, 120.0], "view": [60.0, 40.0, 20.0, 5.0]}
GROUPS = {"one": ["n1"], "two": ["n2", "n3"]}
REFS = {"error": (10.0, 50.0), "view": (5.0, 45.0)}
_POINTS = {"error": "(f_error >= 20)::INT + (f_error >= 40)::INT + (f_error >= 80)::INT + (f_error >= 120)::INT", "view": "(f_view < 60)::INT + (f_view < 40)::INT + (f_view < 20)::INT + (f_view < 5)::INT"}
_AT = "(CASE WHEN i = 95 THEN xs[-1] ELSE i * (xs[-1] / 95) END)"
_J = f"len(list_filter(xs, lambda q: q <= {_AT}))"
_EPISODES = f"""
WITH {_CHART},
ep AS (SELECT subject, event_id AS episode, code AS kind, ts AS t FROM e WHERE role = 'procedure' AND event_id % 5 = 0),
m AS (SELECT subject, episode, t, name AS label, ts, event_id, value, ts > t AS post, (epoch_us(ts) - epoch_us(t)) / 3.6e9 AS x FROM ep JOIN e USING (subject) WHERE role = 'measurement' AND value IS NOT NULL AND abs(epoch_us(ts) - epoch_us(t)) <= 172800000000),
g AS (SELECT episode, label, list(value ORDER BY ts, event_id) AS ys, list((epoch_us(ts) - epoch_us(s)) / 1e6 ORDER BY ts, event_id) AS xs FROM (SELECT *, min(ts) OVER (PARTITION BY episode, label) AS s FROM m WHERE post) GROUP BY 1, 2),
r AS (SELECT episode, string_agg(label || ':' || len(ys) || ':' || array_to_string(list_transform(list_transform(range(96), lambda i: CASE WHEN xs[-1] = 0 THEN ys[1] WHEN {_J} >= len(xs) THEN ys[-1]
    ELSE (ys[{_J} + 1] - ys[{_J}]) / (xs[{_J} + 1] - xs[{_J}]) * ({_AT} - xs[{_J}]) + ys[{_J}] END), lambda v: CAST(round(v * 1000) AS BIGINT)::VARCHAR), ' '), ';' ORDER BY label) AS post FROM g GROUP BY 1),
p AS (SELECT episode, string_agg(epoch_us(ts) || ' ' || label || ' ' || CAST(round(value * 100) AS BIGINT), ';' ORDER BY ts, label, event_id) AS pre FROM m WHERE NOT post GROUP BY 1),
q AS (SELECT episode, label, count(*) AS n, regr_slope(value, x) AS slope, regr_sxx(value, x) AS sxx, regr_syy(value, x) AS syy, regr_sxy(value, x) AS sxy, min_by(value, (ts, event_id)) AS first_value FROM m WHERE NOT post GROUP BY 1, 2),
k AS (SELECT episode, label, n, first_value, CASE WHEN n < 2 OR sxx = 0 THEN 0 ELSE slope END AS slope, CASE WHEN n < 2 OR sxx = 0 THEN 0 ELSE sqrt(greatest(syy - sxy * sxy / sxx, 0) / n) END AS volatility FROM q),
l AS (SELECT episode, string_agg(label || ' ' || CAST(round(slope * 1e4) AS BIGINT) || ' ' || CASE WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END || ' ' || CAST(round(volatility * 1e4) AS BIGINT) || ' ' || n, ';' ORDER BY label) AS trends,
  max(first_value) FILTER (WHERE label = 'error') AS f_error, max(first_value) FILTER (WHERE label = 'view') AS f_view FROM k GROUP BY 1),
d AS (SELECT episode, min_by(visit, (ts, event_id)) AS visit FROM ep JOIN e USING (subject) WHERE visit IS NOT NULL AND abs(epoch_us(ts) - epoch_us(t)) < 86400000000 GROUP BY 1),
n AS (SELECT episode, role, name, min((ts, event_id)) AS seen FROM ep JOIN d USING (episode) JOIN e ON e.subject = ep.subject AND e.visit = d.visit WHERE ts <= t AND role IN ('condition', 'drug') AND name IS NOT NULL GROUP BY ALL),
c AS (SELECT episode, string_agg(name, ',' ORDER BY seen) FILTER (WHERE role = 'condition' AND z <= 10) AS diagnoses, string_agg(name, ',' ORDER BY seen) FILTER (WHERE role = 'drug' AND z <= 15) AS medications,
  max((role = 'condition' AND z <= 10 AND starts_with(name, 'n1'))::INT) AS one, max((role = 'condition' AND z <= 10 AND (starts_with(name, 'n2') OR starts_with(name, 'n3')))::INT) AS two FROM (SELECT *, row_number() OVER (PARTITION BY episode, role ORDER BY seen) AS z FROM n) GROUP BY 1),
s AS (SELECT *, coalesce({_POINTS["error"]}, 0) + coalesce({_POINTS["view"]}, 0) AS severity FROM l)
SELECT ep.subject, ep.episode, kind, coalesce(diagnoses, '') AS diagnoses, coalesce(medications, '') AS medications, coalesce(pre, '') AS pre, post, coalesce(trends, '') AS trends, coalesce(severity, 0)::BIGINT AS severity,
  CASE WHEN coalesce(severity, 0) < 4 THEN 'mild' WHEN severity < 7 THEN 'moderate' WHEN severity < 10 THEN 'moderately_severe' ELSE 'severe' END AS severity_bin, coalesce(one, 0) AS one, coalesce(two, 0) AS two,
  CAST(round((f_error - 30) / 10 * 1000) AS BIGINT) AS shift_error, CAST(round((f_view - 25) / 10 * 1000) AS BIGINT) AS shift_view
FROM ep JOIN r USING (episode) LEFT JOIN p USING (episode) LEFT JOIN s USING (episode) LEFT JOIN c USING (episode)"""


def episode_records(spark, sf):
    e = chart(spark, sf)
    interventions = e.where("role = 'procedure' and event_id % 5 = 0").select("subject", F.col("event_id").alias("episode"), F.col("code").alias("kind"), F.col("ts").alias("t"))
    return E.episodes(e, interventions, REFS, BANDS, GROUPS)


@query("whole_episodes", _EPISODES)
def whole_episodes(spark, sf):
    """Episodes with their features; lists and grids as text, numbers as integers."""
    r = episode_records(spark, sf)
    whole = lambda x, by: F.round(x * by).cast("long").cast("string")
    pre = F.transform("pre", lambda x: F.concat_ws(" ", F.unix_micros(x["ts"].cast("timestamp")).cast("string"), x["label"], whole(x["value"], 100)))
    post = F.transform("post", lambda x: F.concat_ws(":", x["label"], x["post"]["n"].cast("string"), F.array_join(F.transform(x["post"]["grid"], lambda v: whole(v, 1000)), " ")))
    trends = F.transform("trends", lambda x: F.concat_ws(" ", x["label"], whole(x["trend"]["slope"], 10_000), x["trend"]["direction"], whole(x["trend"]["volatility"], 10_000), x["trend"]["n"].cast("string")))
    join = lambda c: F.array_join(c, ";")
    return r.select(
        "subject", "episode", "kind", F.array_join("diagnoses", ",").alias("diagnoses"), F.array_join("medications", ",").alias("medications"), join(pre).alias("pre"), join(post).alias("post"), join(trends).alias("trends"),
        F.col("severity").cast("long").alias("severity"), "severity_bin", "flags.one", "flags.two", F.round(F.col("shifts.error") * 1000).cast("long").alias("shift_error"), F.round(F.col("shifts.view") * 1000).cast("long").alias("shift_view"),
    )


POOL = 40


def pool_tables(spark, sf) -> dict[str, str]:
    """Slices of a seeded pool of subjects: measurements with their dictionary, conditions, and procedures with a code."""
    e = chart(spark, sf)
    pool = e.select("subject").distinct().orderBy(C.seeded(17, "subject"), "subject").limit(POOL)
    dictionary = spark.createDataFrame([("error", "E", 10.0, 50.0), ("view", "V", 5.0, 45.0)], "name string, label string, low double, high double")
    labs = e.where("role = 'measurement'").join(F.broadcast(dictionary), "name", "left").select("subject", "event_id", "ts", "label", "value", "low", "high")  # two rows
    return slices.materialised({"labs": labs, "conditions": e.where("role = 'condition'").select("subject", "event_id", "name"), "procedures": e.where("role = 'procedure'").select("subject", "event_id", "ts", "code")}, pool, "subject")


def of_slices(spark, names: dict[str, str]):
    """A row for each subject of the slices, from joins and aggregations on their key: no exchange."""
    labs = spark.table(names["labs"]).groupBy("subject").agg(F.count(F.lit(1)).alias("n_labs"), F.count_if(F.col("value") > F.col("high")).alias("n_high"), F.max_by("label", F.struct("ts", "event_id")).alias("last_label"))
    conditions = spark.table(names["conditions"]).groupBy("subject").agg(F.concat_ws(",", F.array_sort(F.collect_set("name"))).alias("conditions"))
    procedures = spark.table(names["procedures"]).groupBy("subject").agg(F.min_by("code", F.struct("ts", "event_id")).alias("first_code"))
    return labs.join(conditions, "subject", "left").join(procedures, "subject", "left")


@query("pool_slices", f"""
WITH {_CHART}, p AS (SELECT subject FROM (SELECT DISTINCT subject FROM e) ORDER BY md5('17:' || subject), subject LIMIT {POOL}),
d(name, label, low, high) AS (VALUES ('error', 'E', 10.0::DOUBLE, 50.0::DOUBLE), ('view', 'V', 5.0::DOUBLE, 45.0::DOUBLE)),
l AS (SELECT subject, count(*) AS n_labs, count(*) FILTER (WHERE value > high) AS n_high, max_by(label, (ts, event_id)) AS last_label FROM e LEFT JOIN d USING (name) WHERE role = 'measurement' AND subject IN (FROM p) GROUP BY 1),
c AS (SELECT subject, string_agg(DISTINCT name, ',' ORDER BY name) AS conditions FROM e WHERE role = 'condition' GROUP BY 1),
r AS (SELECT subject, min_by(code, (ts, event_id)) AS first_code FROM e WHERE role = 'procedure' GROUP BY 1)
SELECT l.*, CASE WHEN c.subject IS NOT NULL THEN coalesce(conditions, '') END AS conditions, first_code FROM l LEFT JOIN c USING (subject) LEFT JOIN r USING (subject)""")
def pool_slices(spark, sf):
    return of_slices(spark, pool_tables(spark, sf))


ROLES = ["condition", "drug", "procedure", "observation", "visit", "measurement"]
_SIX = """
x AS (SELECT user_id AS subject, ts, event_id, value, CASE event_type WHEN 'purchase' THEN 'procedure' WHEN 'signup' THEN 'visit' WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'condition' WHEN 1 THEN 'drug' ELSE 'observation' END ELSE 'measurement' END AS role,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN CASE WHEN event_id % 3 > 0 THEN 'view' ELSE 'odd' END ELSE 'c' || event_id % 7 END AS code FROM events)"""
_SERIES_DIR = T._DIR.format(b="v1", a="v2")


def six_tables(spark, sf):
    """events as six tables in one, with a main, a known and an unknown kind of measurement."""
    t, i = F.col("event_type"), F.col("event_id")
    role = F.when(t == "purchase", "procedure").when(t == "signup", "visit").when(t == "click", F.element_at(F.array(*map(F.lit, ["condition", "drug", "observation"])), (i % 3 + 1).cast("int"))).otherwise("measurement")
    code = F.when(t == "error", "error").when(t == "view", F.when(i % 3 > 0, "view").otherwise("odd")).otherwise(F.concat(F.lit("c"), (i % 7).cast("string")))
    return load(spark, sf, "events").select(F.col("user_id").alias("subject"), "ts", "event_id", "value", role.alias("role"), code.alias("code"), code.alias("name"))


@query("full_chart_cases", f"""
WITH {_SIX}, n AS (SELECT subject, event_id, ts, value AS v1, lead(value) OVER w AS v2, lead(ts) OVER w AS ts2, row_number() OVER w AS k FROM x WHERE code = 'error' WINDOW w AS (PARTITION BY subject ORDER BY ts, event_id)),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY md5('23:' || subject || ':' || event_id), event_id) AS r FROM n WHERE {T._H.format(a='ts', b='ts2')} BETWEEN 1 AND 48 AND v1 <> v2) WHERE r = 1),
s AS (SELECT x.*, count(*) FILTER (WHERE role = 'measurement') OVER (PARTITION BY x.subject) AS total, CASE WHEN role = 'measurement' THEN CASE WHEN x.value IS NULL THEN 'none' WHEN code = 'error' THEN 'pinned' WHEN code = 'view' THEN 'known' ELSE 'unknown' END END AS kind FROM x JOIN c ON c.subject = x.subject AND x.ts <= c.ts),
a AS (SELECT *, CASE WHEN total > 30 THEN 14 ELSE 20 END AS cap, greatest(0, CASE WHEN total > 30 THEN 14 ELSE 20 END - count(*) FILTER (WHERE kind = 'pinned') OVER u) AS room, count(*) FILTER (WHERE kind = 'known') OVER u AS n_known,
  row_number() OVER (PARTITION BY subject, kind ORDER BY ts, event_id) AS old, row_number() OVER (PARTITION BY subject, kind ORDER BY ts DESC, event_id DESC) AS new FROM s WINDOW u AS (PARTITION BY subject)),
k AS (SELECT * FROM a WHERE role <> 'measurement' OR kind = 'pinned' OR (kind = 'known' AND (n_known <= room OR new <= room)) OR (kind = 'unknown' AND n_known <= room AND old <= room - n_known)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, role, code, CASE WHEN role <> 'condition' THEN ts::DATE END, CASE WHEN role = 'measurement' THEN event_id END ORDER BY ts, event_id) AS f FROM k) WHERE f = 1),
l AS (SELECT subject, any_value(total) AS total, any_value(cap) AS cap, {", ".join(f"coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) FILTER (WHERE role = '{r}'), '') AS {r}" for r in ROLES)} FROM o GROUP BY 1)
SELECT l.*, c.event_id AS visible_id, v2 AS truth, {_SERIES_DIR} AS direction, CAST(round((v2 - v1) / v1 * 1000) AS BIGINT) AS change_permille, CASE WHEN k <= 1 THEN 'hard' WHEN k = 2 THEN 'medium' ELSE 'easy' END AS difficulty,
  CAST(round({T._H.format(a='c.ts', b='ts2')} * 10) AS BIGINT) AS tenths_ahead FROM l JOIN c USING (subject)""")
def full_chart_cases(spark, sf):
    """One case of each subject: all six tables up to the visible value, capped by the subject's volume, and the truth. From 0 there is no relative change: null."""
    x = six_tables(spark, sf)
    pairs = S.next_pairs(x.where("code = 'error'"), ["subject"])
    chosen = C.per_group(pairs, ["subject"], [C.seeded(23, "subject", "event_id"), F.col("event_id")], 1)
    seen = x.where("code = 'error'").select("event_id", F.col("ts").alias("cutoff"))
    cases = chosen.join(seen, "event_id").select("subject", "cutoff", F.col("event_id").alias("visible_id"), "before", "after", "direction", "difficulty", "hours_ahead")
    chart_ = charts.chart_until(x, cases, "subject", ROLES, ["condition"], F.col("code") == "error", F.col("code") == "view", 20, 14, 30)
    ids = lambda c: F.array_join(F.transform(c, lambda e: e["event_id"].cast("string")), ",").alias(c)
    return chart_.join(cases, "subject").select(
        "subject", "total", F.col("cap").cast("int").alias("cap"), *[ids(r) for r in ROLES], "visible_id", F.col("after").alias("truth"), "direction",
        F.round(F.try_divide(F.col("after") - F.col("before"), "before") * 1000).try_cast("long").alias("change_permille"), "difficulty", F.round(F.col("hours_ahead") * 10).cast("long").alias("tenths_ahead"),
    )


#: lab, low, high, mean, deviation of two populations, and rules on the first.
ONE = [("click", 20.0, 60.0, 40.0, 10.0), ("error", 10.0, 50.0, 30.0, 10.0), ("purchase", 15.0, 70.0, 45.0, 12.0), ("view", 5.0, 45.0, 25.0, 10.0)]
OTHER = [("click", 30.0, 50.0, 40.0, 5.0), ("error", 40.0, 90.0, 65.0, 13.0), ("view", 25.0, 60.0, 45.0, 8.0), ("signup", 1.0, 2.0, 1.5, 0.2)]
LAB_RULES = [("error", "above", 80.0, "stop", 1), ("view", "above", 60.0, "check", 2), ("purchase", "above", 50.0, "hold", 3), ("click", "below", 15.0, "wake", 4)]
PIVOTS = [("error", "warm"), ("view", "lift")]
_POPULATIONS = f"""
{_values("one(lab, low, high, mean, sd)", ONE)}, {_values("other(lab, low, high, mean, sd)", OTHER)}, {_values("rules(lab, direction, threshold, action, priority)", LAB_RULES)}, {_values("pivots(lab, action)", PIVOTS)},
b AS (SELECT lab, s.low AS s_low, s.high AS s_high, s.mean AS s_mean, s.sd AS s_sd, t.low AS t_low, t.high AS t_high, t.mean AS t_mean, t.sd AS t_sd FROM one s JOIN other t USING (lab)),
q AS (SELECT user_id AS subject, ts::DATE AS day, event_type AS lab, min_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2, 3)"""
_X = "(t_mean + (value - s_mean) / s_sd * t_sd)"


def panels(spark, sf):
    """The first value of each lab on a subject's day."""
    e = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy(F.col("user_id").alias("subject"), "day", F.col("event_type").alias("lab")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("value"))


def _populations(spark):
    schema = "lab string, low double, high double, mean double, sd double"
    return spark.createDataFrame(ONE, schema), spark.createDataFrame(OTHER, schema)


_TENTHS = f"CAST(round({T._ROUND.format(x='{x}', d=1)} * 10) AS BIGINT)"


@query("translated_cases", f"""
WITH {_POPULATIONS}, y AS (SELECT *, {_X} AS x, (value - s_mean) / s_sd AS z FROM q JOIN b USING (lab)),
p AS (SELECT subject, day, count(*) AS n, string_agg(lab || ' ' || {_TENTHS.format(x='x')} || ' ' || CASE WHEN x > t_high THEN 'HIGH' WHEN x < t_low THEN 'LOW' ELSE 'NORMAL' END, ';' ORDER BY lab) AS panel FROM y GROUP BY 1, 2 HAVING count(*) >= 3),
h AS (SELECT q.subject, q.day, lab, value, direction, threshold, action, priority FROM q JOIN rules USING (lab) WHERE CASE direction WHEN 'above' THEN value > threshold ELSE value < threshold END),
f AS (SELECT subject, day, min_by(lab, (priority, lab, threshold)) AS lab, min_by(action, (priority, lab, threshold)) AS action, count(*) AS n_source_hits FROM h GROUP BY 1, 2),
g AS (SELECT h.*, {_X} AS x, (value - s_mean) / s_sd AS z, t_mean + (threshold - s_mean) / s_sd * t_sd AS limit_x FROM h JOIN b USING (lab)),
l AS (SELECT subject, day, string_agg(lab || ' ' || {_TENTHS.format(x='x')} || ' ' || {_TENTHS.format(x='limit_x')} || ' ' || action, ';' ORDER BY priority, lab) AS hits FROM g GROUP BY 1, 2)
SELECT subject, day::VARCHAR AS day, panel, hits, n_source_hits, g.lab AS pivot_lab, g.action, {_TENTHS.format(x='g.x')} AS pivot_value, {_TENTHS.format(x='g.limit_x')} AS pivot_threshold, g.direction FROM p JOIN f USING (subject, day) JOIN l USING (subject, day) JOIN g USING (subject, day, lab, action)""")
def translated_cases(spark, sf):
    """Days of subjects as cases of another population: panel, hits and the hit that counts, with their thresholds."""
    rules = spark.createDataFrame(LAB_RULES, "lab string, direction string, threshold double, action string, priority int")
    got = translation.translated_cases(panels(spark, sf), rules, *_populations(spark), ["subject", "day"])
    tenths = lambda x: F.round(x * 10).cast("long")
    panel = F.transform("panel", lambda x: F.concat_ws(" ", x["lab"], tenths(x["value"]).cast("string"), x["side"]))
    hits = F.transform("hits", lambda x: F.concat_ws(" ", x["lab"], tenths(x["value"]).cast("string"), tenths(x["threshold"]).cast("string"), x["action"]))
    return got.select("subject", F.col("day").cast("string").alias("day"), F.array_join(panel, ";").alias("panel"), F.array_join(hits, ";").alias("hits"), "n_source_hits", F.col("pivot.lab").alias("pivot_lab"), "pivot.action", tenths(F.col("pivot.value")).alias("pivot_value"), tenths(F.col("pivot.threshold")).alias("pivot_threshold"), "pivot.direction")


_MIDDLE = "CAST(round((t_low + t_high) / 2 * 10) AS BIGINT)"
_NATURAL = f"CASE WHEN {_X} BETWEEN t_low AND t_high THEN CAST(round({_X} * 10) AS BIGINT) ELSE {_MIDDLE} END"


@query("deceptive_cases", f"""
WITH {_POPULATIONS}, v AS (SELECT subject, day, lab AS pivot_lab, action, round(value, 1) AS v, t_low, t_high FROM q JOIN b USING (lab) JOIN pivots USING (lab) WHERE round(value, 1) BETWEEN s_low AND s_high AND (round(value, 1) < t_low OR round(value, 1) > t_high)),
o AS (SELECT *, CASE WHEN v > t_high THEN 'HIGH' ELSE 'LOW' END AS direction, abs(v - CASE WHEN v > t_high THEN t_high ELSE t_low END) / CASE WHEN v > t_high THEN t_high ELSE t_low END * 100 AS off FROM v),
c AS (SELECT subject, day, pivot_lab, action, v, direction, off FROM (SELECT *, row_number() OVER (PARTITION BY pivot_lab, action ORDER BY off, subject, day) AS r FROM o) WHERE r <= 10),
w AS (SELECT c.*, b.*, q.value FROM c CROSS JOIN b LEFT JOIN q ON q.subject = c.subject AND q.day = c.day AND q.lab = b.lab)
SELECT subject, day::VARCHAR AS day, pivot_lab, action, direction, CAST(round(v * 10) AS BIGINT) AS pivot_value, CAST(round(off * 10) AS BIGINT) AS off,
  string_agg(lab || ' ' || CASE WHEN lab = pivot_lab THEN CAST(round(v * 10) AS BIGINT) ELSE {_NATURAL} END, ';' ORDER BY lab) AS panel, string_agg(lab || ' ' || CASE WHEN lab = pivot_lab THEN {_MIDDLE} ELSE {_NATURAL} END, ';' ORDER BY lab) AS counterfactual,
  coalesce(string_agg(lab, ',' ORDER BY lab) FILTER (WHERE lab <> pivot_lab AND (value IS NULL OR NOT {_X} BETWEEN t_low AND t_high)), '') AS put_to_middle FROM w GROUP BY ALL""")
def deceptive_cases(spark, sf):
    """Days whose pivot one population calls normal and the other does not, with counterfactuals."""
    pivots = spark.createDataFrame(PIVOTS, "lab string, action string")
    got = translation.deceptive_cases(panels(spark, sf), pivots, *_populations(spark), ["subject", "day"], 10)
    tenths = lambda x: F.round(x * 10).cast("long")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["lab"], tenths(x["value"]).cast("string"))), ";").alias(c)
    return got.select("subject", F.col("day").cast("string").alias("day"), F.col("pivot").alias("pivot_lab"), "action", "direction", tenths(F.col("pivot_value")).alias("pivot_value"), tenths(F.col("off")).alias("off"), shown("panel"), shown("counterfactual"), F.array_join("put_to_middle", ",").alias("put_to_middle"))


_PEOPLE = "n AS (SELECT DISTINCT subject, 60 + subject % 40 AS age, CASE WHEN subject % 3 = 0 THEN 'F' ELSE 'M' END AS gender FROM e WHERE 60 + subject % 40 < 89)"
_BLOCKS = f"""
{_CHART}, {_PEOPLE}, {_values("refs(label, low, high)", [(k, *v) for k, v in REFS.items()])},
ix AS (SELECT subject, event_id AS episode, ts AS t, code AS kind, age, gender FROM e JOIN n USING (subject) WHERE role = 'procedure' AND event_id % 5 = 0),
m AS (SELECT ix.episode, ix.t, name AS label, ts, event_id, value, (epoch_us(ts) - epoch_us(t)) / 3.6e9 AS h FROM ix JOIN e USING (subject) WHERE e.role = 'measurement' AND value IS NOT NULL),
s AS (SELECT episode, label, max_by(value, (ts, event_id)) AS latest, count(*) AS k, min(value) AS least, max(value) AS most FROM m WHERE ts <= t GROUP BY 1, 2),
pre AS (SELECT episode, string_agg(label || ' ' || CAST(round(latest * 100) AS BIGINT) || ' ' || k || ' ' || CAST(round(least * 100) AS BIGINT) || ' ' || CAST(round(most * 100) AS BIGINT), ';' ORDER BY label) AS pre FROM s GROUP BY 1),
w AS (SELECT m.*, low, high FROM m JOIN refs USING (label) WHERE h BETWEEN -72 AND 72),
tr AS (SELECT episode, label, max_by(value, (ts, event_id)) FILTER (WHERE h <= 0) AS b, median(value) FILTER (WHERE h > 0) AS p, any_value(low) AS low, any_value(high) AS high, count(*) FILTER (WHERE h <= 0) AS n_pre, count(*) FILTER (WHERE h > 0) AS n_post FROM w GROUP BY 1, 2),
post AS (SELECT episode, string_agg(label || ' ' || event_id || ' ' || CAST(round(h * 10) AS BIGINT), ';' ORDER BY label, ts, event_id) AS post FROM w WHERE h > 0 GROUP BY 1),
c1 AS (SELECT subject, code, min(ts) AS first_ts FROM e WHERE role = 'procedure' GROUP BY 1, 2),
pr AS (SELECT episode, string_agg(c1.code, ',' ORDER BY c1.code) AS prior FROM ix JOIN c1 ON c1.subject = ix.subject AND first_ts < t GROUP BY 1),
fl AS (SELECT subject, max(starts_with(name, 'n1')::INT) AS one, max((starts_with(name, 'n2') OR starts_with(name, 'n3'))::INT) AS two FROM e WHERE role = 'condition' AND name IS NOT NULL GROUP BY 1),
bl AS (SELECT ix.*, coalesce(one, 0) AS one, coalesce(two, 0) AS two, coalesce(pre, '') AS pre, coalesce(prior, '') AS prior, coalesce(post, '') AS post FROM ix LEFT JOIN fl USING (subject) LEFT JOIN pre USING (episode) LEFT JOIN pr USING (episode) LEFT JOIN post USING (episode))"""


def _index(spark, sf):
    e = chart(spark, sf)
    index = e.where("role = 'procedure' and event_id % 5 = 0").select("subject", F.col("event_id").alias("episode"), F.col("ts").alias("t"), F.col("code").alias("kind"))
    people = e.select("subject").distinct().select("subject", (60 + F.col("subject") % 40).alias("age"), F.when(F.col("subject") % 3 == 0, "F").otherwise("M").alias("gender"))
    return e, index, people


def _blocks(spark, sf):
    e, index, people = _index(spark, sf)
    ranges = spark.createDataFrame([(k, *v) for k, v in REFS.items()], "label string, low double, high double")
    return X.blocks(e, index, people, ranges, GROUPS, list(REFS))


def _hundredths(x):
    return F.round(x * 100).cast("long").cast("string")


def _pre_text(c):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["label"], _hundredths(x["latest"]), x["n"].cast("string"), _hundredths(x["least"]), _hundredths(x["most"]))), ";")


def _post_text(c):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["label"], x["event_id"].cast("string"), F.round(x["h"] * 10).cast("long").cast("string"))), ";")


@query("procedure_contexts", f"""
WITH {_BLOCKS},
tx AS (SELECT episode, string_agg(label || ' ' || CASE WHEN p BETWEEN low AND high THEN 'Stable' WHEN p >= b THEN 'Rising' ELSE 'Falling' END || ' ' || CAST(round(b * 1000) AS BIGINT) || ' ' || CAST(round(p * 1000) AS BIGINT) || ' ' || n_pre || ' ' || n_post, ';' ORDER BY label) AS trajectories FROM tr WHERE b IS NOT NULL AND p IS NOT NULL GROUP BY 1)
SELECT subject, episode, kind, age, gender, one, two, pre, prior, coalesce(trajectories, '') AS trajectories, post FROM bl LEFT JOIN tx USING (episode)""")
def procedure_contexts(spark, sf):
    """What was known by each index procedure, and the trajectories that followed."""
    whole = lambda x: F.round(x * 1000).cast("long").cast("string")
    paths = F.transform("trajectories", lambda x: F.concat_ws(" ", x["label"], x["direction"], whole(x["baseline"]), whole(x["post_rep"]), x["n_pre"].cast("string"), x["n_post"].cast("string")))
    return _blocks(spark, sf).select("subject", "episode", "kind", "age", "gender", "flags.one", "flags.two", _pre_text("pre").alias("pre"), F.array_join("prior", ",").alias("prior"), F.array_join(paths, ";").alias("trajectories"), _post_text("post").alias("post"))


@query("pair_contexts", f"""
WITH {_BLOCKS},
o AS (SELECT episode, row_number() OVER (ORDER BY md5('31:' || episode), episode) - 1 AS place FROM (SELECT event_id AS episode FROM e WHERE role = 'procedure' AND event_id % 5 = 0)),
pp AS (SELECT a.episode AS a_id, b.episode AS b_id, CASE WHEN substr(md5('31:' || a.episode), 1, 1) < '8' THEN 'A' ELSE 'B' END AS owner FROM o a JOIN o b ON a.place % 2 = 0 AND b.place = a.place + 1)
SELECT a_id, b_id, owner, a.kind || ' ' || a.age || ' ' || a.gender || ' ' || a.one || a.two || ' ' || a.prior || ' ' || a.pre AS patient_a, b.kind || ' ' || b.age || ' ' || b.gender || ' ' || b.one || b.two || ' ' || b.prior || ' ' || b.pre AS patient_b,
  CASE WHEN owner = 'A' THEN a.post ELSE b.post END AS shown FROM pp JOIN bl a ON a.episode = a_id JOIN bl b ON b.episode = b_id""")
def pair_contexts(spark, sf):
    """Both sides of seeded pairs, and what came after on one of them; pairs with a subject of 89 or more go, whichever side it is."""
    _, index, _ = _index(spark, sf)
    placed = C.shuffled(index.select("episode"), 31, "episode").withColumn("__two", F.floor(F.col("place") / 2))
    side = lambda k, name: placed.where(F.col("place") % 2 == k).select("__two", F.col("episode").alias(name))
    pairs = side(0, "a_id").join(side(1, "b_id"), "__two").drop("__two")
    made = X.pair_contexts(pairs, _blocks(spark, sf), C.coin(31, "a_id"))
    text = lambda p: F.concat_ws(" ", F.col(f"{p}.kind"), F.col(f"{p}.age").cast("string"), F.col(f"{p}.gender"), F.concat(F.col(f"{p}.flags.one").cast("string"), F.col(f"{p}.flags.two").cast("string")), F.array_join(f"{p}.prior", ","), _pre_text(F.col(f"{p}.pre"))).alias(p)
    return made.select("a_id", "b_id", "owner", text("patient_a"), text("patient_b"), _post_text("shown").alias("shown"))


@query("baseline_covariates", f"""
WITH {_CHART}, {_PEOPLE}, ix AS (SELECT subject, event_id AS episode, ts AS t, code AS kind FROM e WHERE role = 'procedure' AND event_id % 5 = 0),
l AS (SELECT episode, max_by(value, (ts, event_id)) FILTER (WHERE name = 'error') AS error, max_by(value, (ts, event_id)) FILTER (WHERE name = 'view') AS view FROM ix JOIN e USING (subject) WHERE role = 'measurement' AND value IS NOT NULL AND ts <= t GROUP BY 1),
f AS (SELECT subject, max(starts_with(name, 'n1')::INT) AS one, max((starts_with(name, 'n2') OR starts_with(name, 'n3'))::INT) AS two FROM e WHERE role = 'condition' AND name IS NOT NULL GROUP BY 1),
r AS (SELECT subject, episode, kind, error, view, coalesce(one, 0)::DOUBLE AS one, coalesce(two, 0)::DOUBLE AS two, (60 + subject % 40)::DOUBLE AS age FROM ix LEFT JOIN l USING (episode) LEFT JOIN f USING (subject)),
z AS (SELECT subject, episode, kind, coalesce(error, (SELECT median(error) FROM r), 0) AS lab_error, coalesce(view, (SELECT median(view) FROM r), 0) AS lab_view, one AS cm_one, two AS cm_two, age FROM r)
SELECT subject, episode, kind, {", ".join(f"CASE WHEN min({c}) OVER () <> max({c}) OVER () THEN {c} END AS {c}" for c in ("lab_error", "lab_view", "cm_one", "cm_two", "age"))} FROM z""")
def baseline_covariates(spark, sf):
    """Covariates of the index procedures; a column with one value only is null here."""
    e, index, people = _index(spark, sf)
    got = X.covariates(e, index, people, GROUPS, list(REFS))
    names = ["lab_error", "lab_view", "cm_one", "cm_two", "age"]
    return got.select("subject", "episode", "kind", *[F.col(c) if c in got.columns else F.lit(None).cast("double").alias(c) for c in names])


_OUTCOMES = f"""
{_EPISODES.split("SELECT ep.subject, ep.episode")[0].rstrip()},
o AS (SELECT episode, row_number() OVER (ORDER BY md5('37:' || episode), episode) - 1 AS place FROM ep),
pp AS (SELECT a.episode AS a_id, b.episode AS b_id FROM o a JOIN o b ON a.place % 2 = 0 AND b.place = a.place + 1),
w AS (SELECT episode, max_by(value, (ts, event_id)) AS b FROM m WHERE NOT post AND label = 'error' GROUP BY 1),
y AS (SELECT episode, ys[-1] AS f FROM g WHERE label = 'error'),
z AS (SELECT ep.episode, kind, coalesce(severity, 0) AS severity, coalesce(b, 0) AS baseline, coalesce(f, b, 0) AS final, CASE WHEN f IS NULL THEN 0 ELSE f - coalesce(b, 0) END AS change,
  CASE WHEN f IS NULL THEN 'unknown' WHEN f > coalesce(b, 0) THEN 'rising' ELSE 'falling' END AS direction, coalesce(f < coalesce(b, 0), false) AS improved, f IS NOT NULL AS measured FROM ep JOIN r USING (episode) LEFT JOIN s USING (episode) LEFT JOIN w USING (episode) LEFT JOIN y USING (episode)),
x AS (SELECT a_id, b_id, a.kind AS kind_a, b.kind AS kind_b, a.severity AS severity_a, b.severity AS severity_b, a.baseline AS baseline_a, b.baseline AS baseline_b, a.final AS final_a, b.final AS final_b, a.change AS change_a, b.change AS change_b, a.direction AS direction_a, b.direction AS direction_b, a.improved AS improved_a, b.improved AS improved_b,
  CASE WHEN a.measured AND b.measured THEN abs(a.change - b.change) ELSE 0 END AS apart FROM pp JOIN z a ON a.episode = a_id JOIN z b ON b.episode = b_id)"""


def _outcomes(spark, sf):
    made = episode_records(spark, sf)
    _, index, _ = _index(spark, sf)
    placed = C.shuffled(index.select("episode"), 37, "episode").withColumn("__two", F.floor(F.col("place") / 2))
    side = lambda k, name: placed.where(F.col("place") % 2 == k).select("__two", F.col("episode").alias(name))
    return R.pair_outcomes(side(0, "a_id").join(side(1, "b_id"), "__two").drop("__two"), made, "error")


@query("pair_outcomes", f"{_OUTCOMES} SELECT a_id, b_id, kind_a, kind_b, CAST(round(baseline_a * 100) AS BIGINT) AS baseline_a, CAST(round(baseline_b * 100) AS BIGINT) AS baseline_b, CAST(round(final_a * 100) AS BIGINT) AS final_a, CAST(round(final_b * 100) AS BIGINT) AS final_b, CAST(round(change_a * 100) AS BIGINT) AS change_a, CAST(round(change_b * 100) AS BIGINT) AS change_b, direction_a, direction_b, improved_a, improved_b, CAST(round(apart * 100) AS BIGINT) AS apart FROM x")
def pair_outcomes(spark, sf):
    """The truth of questions about pairs of episodes, in hundredths."""
    out = _outcomes(spark, sf)
    numbers = [f"{c}_{s}" for c in ("baseline", "final", "change") for s in "ab"] + ["apart"]
    return out.select("a_id", "b_id", "kind_a", "kind_b", *[F.round(F.col(c) * 100).cast("long").alias(c) for c in numbers], "direction_a", "direction_b", "improved_a", "improved_b")


@query("balance_report", f"{_OUTCOMES}, h AS (SELECT least(kind_a, kind_b) || ' vs ' || greatest(kind_a, kind_b) AS k, count(*) AS n, count(*) FILTER (WHERE abs(severity_a - severity_b) / 0.5 < 0.1) AS good FROM x GROUP BY 1) SELECT coalesce(sum(n), 0)::BIGINT AS n_pairs, coalesce(sum(good), 0)::BIGINT AS n_good_balance, string_agg(k || ' ' || n, ';' ORDER BY k) AS kinds FROM h")
def balance_report(spark, sf):
    r = R.balance_report(_outcomes(spark, sf))
    return r.select("n_pairs", "n_good_balance", F.array_join(F.transform("kinds", lambda x: F.concat_ws(" ", x["kinds"], x["n"].cast("string"))), ";").alias("kinds"))


@query("next_value_records", f"""
WITH {_CHART}, m AS (SELECT * FROM e WHERE role = 'measurement' AND value IS NOT NULL),
n AS (SELECT subject, event_id AS visible_id, ts AS t1, value AS v1, lead(value) OVER w AS v2, lead(ts) OVER w AS t2, row_number() OVER w AS k FROM m WHERE name = 'error' WINDOW w AS (PARTITION BY subject ORDER BY ts, event_id)),
c AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY md5('29:' || subject || ':' || visible_id), visible_id) AS r FROM n WHERE {T._H.format(a='t1', b='t2')} BETWEEN 1 AND 48 AND v1 <> v2) WHERE r = 1),
d AS (SELECT * FROM (SELECT m.*, t1, date_trunc('minute', m.ts) AS minute, row_number() OVER (PARTITION BY m.subject, m.name, date_trunc('minute', m.ts) ORDER BY m.ts, m.event_id) AS r FROM m JOIN c ON c.subject = m.subject AND m.ts <= t1 AND (m.name = 'error' OR epoch_us(t1) - epoch_us(m.ts) <= 10 * 86400000000)) WHERE r = 1),
k AS (SELECT *, count(*) FILTER (WHERE name = 'error') OVER (PARTITION BY subject) AS n_main, row_number() OVER (PARTITION BY subject, name = 'error' ORDER BY minute DESC, name DESC) AS nth FROM d),
l AS (SELECT subject, string_agg(event_id::VARCHAR, ',' ORDER BY minute, name, value, event_id) AS timeline, string_agg(event_id::VARCHAR, ',' ORDER BY minute, name, value, event_id) FILTER (WHERE name = 'error') AS prior FROM k WHERE name = 'error' OR nth <= greatest(0, 20 - n_main) GROUP BY 1),
v AS (SELECT subject, first(visit ORDER BY abs(epoch_us(ts) - epoch_us(t1)), ts, event_id) AS visit FROM m JOIN c USING (subject) WHERE name = 'error' AND ts <= t1 GROUP BY 1),
f AS (SELECT e.subject, role, e.name, min((ts, event_id)) AS seen FROM v JOIN c USING (subject) JOIN e ON e.subject = v.subject AND e.visit = v.visit AND e.ts <= t1 WHERE role IN ('condition', 'drug') AND e.name IS NOT NULL GROUP BY ALL),
g AS (SELECT subject, string_agg(name, ',' ORDER BY seen) FILTER (WHERE role = 'condition' AND z <= 8) AS diagnoses, string_agg(name, ',' ORDER BY seen) FILTER (WHERE role = 'drug' AND z <= 12) AS medications FROM (SELECT *, row_number() OVER (PARTITION BY subject, role ORDER BY seen) AS z FROM f) GROUP BY 1)
SELECT c.subject, visible_id, CASE WHEN k <= 1 THEN 'hard' WHEN k = 2 THEN 'medium' ELSE 'easy' END AS difficulty, CASE WHEN v2 > v1 * 1.2::DOUBLE THEN 'rising' WHEN v2 < v1 * 0.8::DOUBLE THEN 'falling' ELSE 'stable' END AS direction, CAST(round(v2 * 100) AS BIGINT) AS truth,
  timeline, prior, coalesce(diagnoses, '') AS diagnoses, coalesce(medications, '') AS medications FROM c JOIN l USING (subject) LEFT JOIN g USING (subject)""")
def next_value_records(spark, sf):
    """One case of each subject with its whole record: timeline, earlier values, conditions and drugs of the visit, truth."""
    e = chart(spark, sf)
    main = e.where("role = 'measurement' and name = 'error' and value is not null")
    chosen = C.per_group(S.next_pairs(main, ["subject"]), ["subject"], [C.seeded(29, "subject", "event_id"), F.col("event_id")], 1)
    cases = chosen.join(main.select("event_id", F.col("ts").alias("t1")), "event_id").select("subject", "t1", F.col("event_id").alias("visible_id"), "difficulty", D.direction("before", "after", base="product").alias("direction"), "after")
    got = B.next_value_records(e, cases, F.col("name") == "error", KINDS, 10, 20)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["event_id"].cast("string")), ",").alias(c)
    return got.select("subject", "visible_id", "difficulty", "direction", F.round(F.col("after") * 100).cast("long").alias("truth"), ids("timeline"), ids("prior"), F.array_join("diagnoses", ",").alias("diagnoses"), F.array_join("medications", ",").alias("medications"))


_LISTS = {"assertions": G.ASSERTIONS, "owners": G.OWNER_REVEALS}
_SAID = {k: "[" + ", ".join(f"'{p}'" for p in v) + "]" for k, v in _LISTS.items()}


@query("phrase_leaks", f"""
WITH s AS (SELECT conv_id, turn, lower(coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN ' It ' || {_SAID["assertions"]}[1 + conv_id % {len(G.ASSERTIONS)}] ELSE '' END || CASE WHEN turn % 2 = 1 THEN ' The Labs ' || upper({_SAID["owners"]}[1 + conv_id % {len(G.OWNER_REVEALS)}]) ELSE '' END) AS t FROM conversations)
SELECT conv_id, turn, {", ".join(f"array_to_string(list_sort(list_filter({v}, lambda p: contains(t, p))), ',') AS {k}" for k, v in _SAID.items())} FROM s""")
def phrase_leaks(spark, sf):
    """What stems give away, by the two fixed lists: conversations, some with a phrase of either list added."""
    pick = lambda phrases: F.element_at(F.array(*map(F.lit, phrases)), (F.col("conv_id") % len(phrases) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" It "), pick(G.ASSERTIONS))).otherwise(""), F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" The Labs "), F.upper(pick(G.OWNER_REVEALS)))).otherwise(""))
    return load(spark, sf, "conversations").select("conv_id", "turn", *[F.array_join(G.phrases_in(text, v), ",").alias(k) for k, v in _LISTS.items()])


_SHOWN = """d AS (SELECT * FROM (SELECT x.event_id, x.user_id, x.event_type AS name, x.value, date_trunc('minute', x.ts) AS minute, row_number() OVER (PARTITION BY x.user_id, x.event_type, date_trunc('minute', x.ts) ORDER BY x.ts, x.event_id) AS r FROM c JOIN events x USING (user_id) WHERE x.ts <= CASE WHEN x.event_type = 'error' THEN tv ELSE tw END) WHERE r = 1),
k AS (SELECT *, count(*) FILTER (WHERE name = 'error') OVER (PARTITION BY user_id) AS n_main, row_number() OVER (PARTITION BY user_id, name = 'error' ORDER BY minute DESC, name DESC) AS nth FROM d),
l AS (SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY minute, name, value, event_id) AS timeline, count(*) FILTER (WHERE name = 'error') AS n_prior FROM k WHERE name = 'error' OR nth <= greatest(0, 24 - n_main) GROUP BY 1)"""


def _windows_of(spark, sf, cases):
    """Cases with their times and the record that may be shown; ids as text."""
    e = T.events(spark, sf).withColumnsRenamed({"user_id": "subject", "event_type": "name"})
    at = lambda side: e.where("name = 'error'").select(F.col("event_id").alias(f"{side}_id"), F.col("ts").alias(f"t_{side}"))
    timed = cases.withColumnRenamed("user_id", "subject").join(at("visible"), "visible_id").join(at("target"), "target_id")
    made = B.window_records(e.select("subject", "ts", "event_id", "name", "value"), timed, F.col("name") == "error", 24)
    ids = F.array_join(F.transform("timeline", lambda x: x["event_id"].cast("string")), ",")
    return made.withColumnsRenamed({"subject": "user_id"}).withColumns({"timeline": ids, "n_prior": F.size("prior").cast("long")})


@query("reversal_records", f"""
WITH {T._PAIRS}, s AS (SELECT *, visible_trend || '_to_' || actual_dir AS reversal_type, 3 * CASE WHEN v_visible > 0 THEN abs(v_target - v_visible) / v_visible ELSE 0 END + 0.01::DOUBLE * n_between + CASE WHEN gap_hours BETWEEN 6 AND 24 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM rev WHERE visible_trend <> actual_dir),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, target_id, visible_id) AS r FROM s) WHERE r = 1),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reversal_type ORDER BY score DESC, user_id) <= 2 AS by_quota FROM b) ORDER BY by_quota DESC, score DESC, user_id LIMIT 12),
c AS (SELECT q.*, v.ts AS tv, w.ts AS tw FROM q JOIN events v ON v.event_id = visible_id JOIN events w ON w.event_id = target_id), {_SHOWN}
SELECT user_id, visible_id, target_id, reversal_type, by_quota, CAST(round(v_target * 100) AS BIGINT) AS truth, n_prior, timeline FROM c JOIN l USING (user_id)""")
def reversal_records(spark, sf):
    """Whole cases whose visible trend turns: the best window of a subject, some of each kind of turn first, and what may be shown."""
    best = S.best_window(T.visible_trend_reversal(spark, sf), "user_id")
    chosen = C.quota_then_fill(best, "reversal_type", 2, 12, [F.desc("score"), F.col("user_id")])
    return _windows_of(spark, sf, chosen).select("user_id", "visible_id", "target_id", "reversal_type", "by_quota", F.round(F.col("v_target") * 100).cast("long").alias("truth"), "n_prior", "timeline")


@query("signal_records", f"""
WITH {T._PAIRS}, t AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
n AS (SELECT p.*, v.ts AS tv, w.ts AS tw, (SELECT count(*) FROM events x WHERE x.user_id = p.user_id AND x.event_type <> 'error' AND x.ts > v.ts AND x.ts <= w.ts) AS n_signals FROM pairs p JOIN t v ON v.event_id = visible_id JOIN t w ON w.event_id = target_id),
s AS (SELECT *, {T._DIR.format(b='v_visible', a='v_target')} AS direction, 3 * n_signals + 2 * CASE WHEN v_target > 0 THEN abs(v_target - v_visible) / v_target WHEN v_target <> v_visible THEN 1 ELSE 0 END + CASE WHEN gap_hours BETWEEN 6 AND 24 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM n),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, target_id, visible_id) AS r FROM s) WHERE r = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY score DESC, user_id) AS z FROM b) WHERE z <= CASE direction WHEN 'stable' THEN 4 ELSE 5 END), {_SHOWN}
SELECT user_id, visible_id, target_id, direction, n_signals, CAST(round(v_target * 100) AS BIGINT) AS truth, n_prior, timeline FROM c JOIN l USING (user_id)""")
def signal_records(spark, sf):
    """Whole cases that other measurements tell most about: the best window of a subject, directions in thirds, and what may be shown."""
    e = T.events(spark, sf)
    own = F.col("event_type") == "error"
    counted = R.signals_until(e, "user_id", ~own).where(own)
    at = lambda side: counted.select(F.col("event_id").alias(f"{side}_id"), F.col("signals").alias(f"n_{side}"))
    pairs = S.ordered_pairs(e.where(own), ["user_id"]).join(at("visible"), "visible_id").join(at("target"), "target_id").withColumn("n_signals", F.col("n_target") - F.col("n_visible"))
    scored = pairs.withColumns({"score": D.window_score("n_signals", D.relative_gap("v_visible", "v_target"), "gap_hours"), "direction": D.direction("v_visible", "v_target")})
    best = C.per_group(scored, ["user_id"], [F.desc("score"), F.col("target_id"), F.col("visible_id")], 1).drop("rank")
    chosen = C.balanced(best, F.lit("all"), "direction", C.thirds(14), [F.desc("score"), F.col("user_id")])
    return _windows_of(spark, sf, chosen).select("user_id", "visible_id", "target_id", "direction", "n_signals", F.round(F.col("v_target") * 100).cast("long").alias("truth"), "n_prior", "timeline")


@query("admission_records", """
WITH c AS (SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS cut_key, min((o_orderdate, o_orderkey)) AS cut FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
a AS (SELECT o_custkey AS subject, o_orderkey AS visit, o_orderdate AS t, o_orderpriority AS kind, o_orderkey = cut_key AS now FROM orders JOIN c USING (o_custkey) WHERE (o_orderdate, o_orderkey) <= cut),
l AS (SELECT l_orderkey AS visit, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, l_shipdate::DATE AS date, CASE WHEN l_quantity > 10 THEN l_partkey END AS diagnosis, l_suppkey % 20 AS drug, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS procedure, l_linestatus AS label, l_extendedprice AS value FROM lineitem),
x AS (SELECT l.*, count(diagnosis) OVER (PARTITION BY visit ORDER BY nth) AS d, row_number() OVER (PARTITION BY visit, date, label ORDER BY nth) AS f FROM l),
p AS (SELECT visit, string_agg(diagnosis::VARCHAR, ',' ORDER BY nth) FILTER (WHERE d <= 3) AS diagnoses, string_agg(procedure::VARCHAR, ',' ORDER BY date, nth) AS procedures, array_to_string(list_sort(list_distinct(list(drug)))[1:3], ',') AS drugs, array_to_string(list_sort(list_distinct(list(drug)))[1:5], ',') AS drugs_now,
  string_agg(date || ' ' || label || ' ' || CAST(round(value * 100) AS BIGINT), ';' ORDER BY date, label) FILTER (WHERE f = 1) AS labs FROM x GROUP BY 1)
SELECT subject, coalesce(string_agg(t::DATE || '|' || kind || '|' || coalesce(diagnoses, '') || '|' || coalesce(procedures, '') || '|' || coalesce(drugs, ''), ';' ORDER BY t, a.visit) FILTER (WHERE NOT now), '') AS history, max(a.visit) FILTER (WHERE now) AS cut_key,
  coalesce(max(t::DATE || '|' || kind || '|' || coalesce(diagnoses, '') || '|' || coalesce(drugs_now, '')) FILTER (WHERE now), '') AS current, coalesce(max(labs) FILTER (WHERE now), '') AS lab_data FROM a LEFT JOIN p ON p.visit = a.visit GROUP BY 1""")
def admission_records(spark, sf):
    """Each subject's admissions before its first open one, and that one, as whole records."""
    o = C.split_at(load(spark, sf, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderstatus") == "P").where("part in ('prior', 'current')")
    admissions = o.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("visit"), F.col("o_orderdate").alias("t"), F.col("o_orderpriority").alias("kind"), "part")
    lines = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("visit"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("nth"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_quantity") > 10, F.col("l_partkey")).alias("diagnosis"),
        (F.col("l_suppkey") % 20).alias("drug"), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("procedure"), F.col("l_linestatus").alias("label"), F.col("l_extendedprice").alias("value"),
    )
    r = B.admission_records(admissions, lines, 3, 3, 5)
    texts = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    told = lambda x, fields: F.concat_ws("|", x["admit_date"].cast("string"), x["kind"], *[texts(x[f]) for f in fields])
    labs = F.transform("lab_data", lambda x: F.concat_ws(" ", x["date"].cast("string"), x["label"], F.round(x["value"] * 100).cast("long").cast("string")))
    history = F.transform("history", lambda x: told(x, ["diagnoses", "procedures", "medications"]))
    return r.select("subject", F.array_join(history, ";").alias("history"), F.col("current.visit").alias("cut_key"), told(F.col("current"), ["diagnoses", "medications"]).alias("current"), F.array_join(labs, ";").alias("lab_data"))


@query("converted_episodes", f"""
WITH m AS (SELECT user_id, event_type, ts, event_id, value FROM events),
n AS (SELECT user_id, event_id AS visible_id, ts AS t1, value AS v1, lead(value) OVER w AS v2, lead(ts) OVER w AS t2 FROM m WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('29:' || user_id || ':' || visible_id), visible_id) AS r FROM n WHERE {T._H.format(a='t1', b='t2')} BETWEEN 1 AND 48 AND v1 <> v2) WHERE r = 1),
p AS (SELECT c.user_id, count(*) AS n_pre, max_by(m.value, (m.ts, m.event_id)) FILTER (WHERE event_type = 'error') AS b FROM c JOIN m ON m.user_id = c.user_id AND m.ts <= t1 GROUP BY 1)
SELECT c.user_id, visible_id, n_pre, CASE WHEN visible_id % 7 = 0 THEN 'statin' ELSE ['heparin', 'beta blocker', 'diuretic'][1 + (visible_id - 1) % 3] END AS kind,
  array_to_string(list_transform(range(96), lambda i: CAST(round((b + (v2 - b) * i / 95) * 1000) AS BIGINT)::VARCHAR), ' ') AS grid FROM c JOIN p USING (user_id)""")
def converted_episodes(spark, sf):
    """Next-value cases as episodes: what was measured up to the cut-off, an inferred kind, and a straight line from the last value to the truth."""
    e = T.events(spark, sf)
    main = e.where("event_type = 'error'")
    chosen = C.per_group(S.next_pairs(main, ["user_id"]), ["user_id"], [C.seeded(29, "user_id", "event_id"), F.col("event_id")], 1)
    cases = chosen.join(main.select("event_id", F.col("ts").alias("anchor_ts")), "event_id").select("user_id", F.col("event_id").alias("visible_id"), "after", "anchor_ts")
    at = F.struct("ts", "event_id")
    own = F.col("event_type") == "error"
    seen = A.before_anchor(e, cases, "user_id").groupBy("user_id", "visible_id", "after").agg(F.count(F.lit(1)).alias("n_pre"), F.max_by(F.when(own, F.col("value")), F.when(own, at)).alias("b"))
    kind = R.inferred_kind(F.col("visible_id"), ["heparin", "beta blocker", "diuretic"], [(["7"], F.when(F.col("visible_id") % 7 == 0, F.lit("7")), F.lit(True), "statin")])
    line = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda i: F.round((F.coalesce("b", F.lit(0.0)) + (F.col("after") - F.coalesce("b", F.lit(0.0))) * i / 95) * 1000).cast("long").cast("string"))
    return seen.select("user_id", "visible_id", "n_pre", kind.alias("kind"), F.array_join(line, " ").alias("grid"))
