"""Queries of what case records are built from: masks, visits, samples, checks and translations.

Stand-ins as elsewhere: events are a subject's measurements, orders admissions,
parts a dictionary, conversations and documents free text.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import direction as D, guards as G, text as X
from ..functions.timewin import age_from_anchor, hours_from, time_zero
from ..operators import anchor as A, cohort as C, matching as M, score as K, series as S
from ..session import load
from . import timelines as T
from .registry import query

_FIRST_LAST = """
q AS (SELECT user_id, min(ts) AS t_visible, max(ts) AS t_target, max_by(event_id, (ts, event_id)) AS target_id FROM events WHERE event_type = 'error' GROUP BY 1)"""


def _questions(spark, sf):
    return T.events(spark, sf).where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("t_visible"), F.max("ts").alias("t_target"), F.max_by("event_id", F.struct("ts", "event_id")).alias("target_id"))


@query("masked_timeline", f"""
WITH {_FIRST_LAST} SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN q USING (user_id)
WHERE CASE WHEN e.event_type = 'error' THEN e.ts <= t_visible ELSE e.ts <= t_target END""")
def masked_timeline(spark, sf):
    return A.masked(T.events(spark, sf), _questions(spark, sf), "user_id", F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query("look_back", f"""
WITH {_FIRST_LAST} SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN q USING (user_id)
WHERE e.ts <= t_target AND (e.event_type = 'error' OR epoch_us(t_target) - epoch_us(e.ts) <= 5 * 86400000000)""")
def look_back(spark, sf):
    anchors = _questions(spark, sf).select("user_id", F.col("t_target").alias("anchor_ts"))
    return A.look_back(T.events(spark, sf), anchors, "user_id", F.col("event_type") == "error", 5).select("user_id", "event_id", "event_type")


@query("around_window", f"""
WITH {_FIRST_LAST} SELECT e.user_id, e.event_id, round((epoch_us(e.ts) - epoch_us(t_target)) / 3.6e9, 1) AS h FROM events e JOIN q USING (user_id)
WHERE epoch_us(e.ts) - epoch_us(t_target) BETWEEN -3 * 86400000000 AND 86400000000""")
def around_window(spark, sf):
    anchors = _questions(spark, sf).select("user_id", F.col("t_target").alias("anchor_ts"))
    return A.around(T.events(spark, sf), anchors, "user_id").select("user_id", "event_id", hours_from("anchor_ts", "ts").alias("h"))


@query("age_from_anchor", """
WITH a AS (SELECT o_orderkey, o_custkey, o_custkey % 60 + 35 + year(o_orderdate) - 1995 AS age FROM orders) SELECT o_orderkey, age FROM a WHERE age < 89""")
def age_from_anchor_query(spark, sf):
    age = age_from_anchor("o_orderdate", F.col("o_custkey") % 60 + 35, F.lit(1995))
    return load(spark, sf, "orders").select("o_orderkey", age.cast("long").alias("age")).where("age < 89")


@query("straddling_visit", """
WITH v AS (SELECT user_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS visit, min(ts) AS t_min, max(ts) AS t_max FROM events WHERE event_type = 'view' GROUP BY 1, 2),
t AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error')
SELECT t.user_id, t.event_id, min_by(v.visit, (v.t_min, v.visit)) AS visit FROM t LEFT JOIN v ON v.user_id = t.user_id AND v.t_min <= t.ts AND epoch_us(t.ts) - epoch_us(v.t_max) <= 86400000000 GROUP BY 1, 2""")
def straddling_visit(spark, sf):
    e = T.events(spark, sf).withColumn("visit", F.date_format("ts", "yyyyMMdd").cast("int"))
    visits = A.visit_spans(e.where("event_type = 'view'"), "user_id", "visit")
    return A.straddling_visit(e.where("event_type = 'error'").drop("visit"), visits, "user_id", "event_id", "visit")


@query("visit_within_a_day", """
WITH v AS (SELECT user_id, event_id AS visit, ts AS t1 FROM events WHERE event_type = 'view'), t AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT t.user_id, t.event_id, min_by(v.visit, (v.t1, v.visit)) AS visit FROM t LEFT JOIN v ON v.user_id = t.user_id AND abs(epoch_us(t.ts) - epoch_us(v.t1)) < 86400000000 GROUP BY 1, 2""")
def visit_within_a_day(spark, sf):
    e = T.events(spark, sf)
    views = e.where("event_type = 'view'").withColumn("visit", F.col("event_id"))
    return A.visit_within_a_day(e.where("event_type = 'purchase'"), views, "user_id", "event_id", "visit")


@query("interval_join_by_action", f"""
WITH {T._RANGES}, t AS (SELECT user_id, event_type, event_id, ts, value, high FROM events JOIN ranges USING (event_type) WHERE value > high)
SELECT t.user_id, t.event_type, t.event_id AS trigger_id, p.event_id AS procedure_id, CAST(floor((epoch_us(p.ts) - epoch_us(t.ts)) / 8.64e10) AS BIGINT) AS days, (t.value - high) / high AS severity
FROM t JOIN events p ON p.user_id = t.user_id AND p.event_type = t.event_type WHERE floor((epoch_us(p.ts) - epoch_us(t.ts)) / 8.64e10) BETWEEN 1 AND 6""")
def interval_join_by_action(spark, sf):
    e = T.events(spark, sf)
    triggers = e.join(F.broadcast(T.ranges(spark)), "event_type").where("value > high").withColumn("threshold", F.col("high"))
    return A.interval_join(triggers, e, "user_id", 1, 6, also=["event_type"])


@query("late_windows", f"""
WITH a AS (SELECT user_id, min(ts) AS first_ts, min(ts) FILTER (WHERE event_type = 'error') AS anchor_ts FROM events GROUP BY 1),
g AS (SELECT * FROM a WHERE epoch_us(anchor_ts) - epoch_us(first_ts) >= 6 * 3600000000),
w AS (SELECT e.user_id, e.event_type, {T._H.format(a='anchor_ts', b='e.ts')} AS h FROM events e JOIN g USING (user_id)),
n AS (SELECT user_id, event_type, count(*) FILTER (WHERE h BETWEEN -72 AND 0) AS n_pre, count(*) FILTER (WHERE h > 0 AND h <= 72) AS n_post FROM w GROUP BY 1, 2)
SELECT * FROM n WHERE n_pre >= 1 AND n_post >= 2""")
def late_windows(spark, sf):
    e = T.events(spark, sf)
    anchors = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("anchor_ts"))
    windows = A.pre_post(A.late_enough(anchors, "first_ts").drop("first_ts"), e, "user_id", 72)
    return A.eligible(windows, T.KEYS, 1).where("n_post >= 2")


@query("series_summary", """
SELECT user_id, event_type, count(value) AS n, min_by(value, (ts, event_id)) AS first_value, max_by(value, (ts, event_id)) AS latest_value, min(value) AS min_value, max(value) AS max_value,
  bool_or(value > 90) AS any_abnormal, max_by(props, (ts, event_id)) AS unit FROM events GROUP BY 1, 2""")
def series_summary(spark, sf):
    return A.summary(T.events(spark, sf), T.KEYS, abnormal=F.col("value") > 90, unit="props")


@query("time_zero", """
WITH f AS (SELECT l_orderkey, min(l_shipdate) AS first_ts FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, CAST(epoch_us(coalesce(first_ts, o_orderdate + INTERVAL 24 HOUR)) AS BIGINT) AS zero_us FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def time_zero_query(spark, sf):
    first = load(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ts"))
    o = load(spark, sf, "orders").join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", F.unix_micros(time_zero("o_orderdate", "first_ts").cast("timestamp")).alias("zero_us"))


# samples


@query("balanced_sample", f"""
WITH n AS (SELECT user_id, event_type, event_id, ts, value AS before, lead(value) OVER w AS after, lead(ts) OVER w AS ts2, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
p AS (SELECT event_id, k = 1 AS single, {T._DIR.format(b='before', a='after')} AS direction, abs(after - before) AS score FROM n WHERE {T._H.format(a='ts', b='ts2')} BETWEEN 1 AND 48 AND before <> after),
r AS (SELECT *, row_number() OVER (PARTITION BY single, direction ORDER BY score DESC, event_id) AS r FROM p)
SELECT event_id, CASE WHEN single THEN 'single' ELSE 'multi' END AS pool, direction FROM r WHERE r <= CASE direction WHEN 'rising' THEN 17 WHEN 'falling' THEN 17 ELSE 16 END""")
def balanced_sample(spark, sf):
    p = S.next_pairs(T.events(spark, sf), T.KEYS).withColumn("score", F.abs(F.col("after") - F.col("before")))
    pool = F.when(F.col("n_context") == 1, "single").otherwise("multi")
    return C.balanced(p, pool, "direction", C.thirds(50), [F.desc("score"), F.col("event_id")]).select("event_id", "pool", "direction")


@query("capped_sample", """
WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
SELECT event_id, event_type FROM r WHERE r <= 12 ORDER BY value DESC, event_id LIMIT 40""")
def capped_sample(spark, sf):
    return C.capped(T.events(spark, sf), ["event_type"], 12, 40, [F.desc("value"), F.col("event_id")]).select("event_id", "event_type")


@query("one_pair_per_subject", f"""
WITH n AS (SELECT user_id, event_type, event_id, ts, value AS before, lead(value) OVER w AS after, lead(ts) OVER w AS ts2, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
p AS (SELECT * FROM n WHERE {T._H.format(a='ts', b='ts2')} BETWEEN 1 AND 48 AND before <> after)
SELECT user_id, min_by(event_id, (md5('11:' || user_id || ':' || event_id), event_id)) AS event_id, min_by(next_id, (md5('11:' || user_id || ':' || event_id), event_id)) AS next_id FROM p GROUP BY 1""")
def one_pair_per_subject(spark, sf):
    return C.pick_one(S.next_pairs(T.events(spark, sf), T.KEYS), "user_id", 11, "event_id").select("user_id", "event_id", "next_id")


@query("seeded_coin", "SELECT o_orderkey, CASE WHEN substr(md5('3:' || o_orderkey), 1, 1) < '8' THEN 'A' ELSE 'B' END AS owner FROM orders")
def seeded_coin(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", C.coin(3, "o_orderkey").alias("owner"))


@query("seeded_shuffle", "SELECT c_custkey, row_number() OVER (ORDER BY md5('5:' || c_custkey), c_custkey) - 1 AS place FROM customer")
def seeded_shuffle(spark, sf):
    return C.shuffled(load(spark, sf, "customer").select("c_custkey"), 5, "c_custkey").select("c_custkey", F.col("place").cast("long").alias("place"))


@query("sequential_ids", """
SELECT o_orderkey, printf('p%06d', row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) AS uid FROM orders""")
def sequential_ids(spark, sf):
    return C.sequential(load(spark, sf, "orders"), -F.col("o_totalprice"), [F.col("o_orderkey")]).select("o_orderkey", "uid")


@query("assigned_kinds", """
WITH s AS (SELECT 'x' AS kind, unnest(range(1, 16)) AS l UNION ALL SELECT 'y', unnest(range(1, 11)) UNION ALL SELECT 'z', unnest(range(1, 6))),
k AS (SELECT kind, row_number() OVER (ORDER BY l DESC, kind) - 1 AS nth FROM s),
p AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('9:' || o_custkey), o_custkey) - 1 AS nth FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_custkey, nth, kind FROM p JOIN k USING (nth)""")
def assigned_kinds(spark, sf):
    return C.assigned(load(spark, sf, "orders"), "o_custkey", {"x": 15, "y": 10, "z": 5}, 9)


@query("one_per_reversal", f"""
WITH {T._PAIRS} SELECT reversal_type, user_id, visible_id, target_id FROM (
  SELECT *, visible_trend || '_to_' || actual_dir AS reversal_type, row_number() OVER (PARTITION BY visible_trend || '_to_' || actual_dir ORDER BY visible_id, target_id) AS r FROM rev WHERE visible_trend <> actual_dir) WHERE r = 1""")
def one_per_reversal(spark, sf):
    return C.one_per(T.visible_trend_reversal(spark, sf), "reversal_type", [F.col("visible_id"), F.col("target_id")]).select("reversal_type", "user_id", "visible_id", "target_id")


@query("tiers_first", "SELECT o_orderkey, tier FROM (SELECT o_orderkey, o_custkey % 4 AS tier FROM orders) WHERE tier IN (1, 2, 3) ORDER BY tier DESC, o_orderkey LIMIT 50")
def tiers_first(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(4)).alias("tier"))
    return C.tiers_first(o, "tier", [1, 2, 3], 50, [F.col("o_orderkey")])


@query("split_at_visit", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
c AS (SELECT *, min(CASE WHEN o_orderstatus = 'P' THEN r END) OVER (PARTITION BY o_custkey) AS c FROM r)
SELECT o_custkey, o_orderkey, CASE WHEN r < c THEN 'prior' WHEN r = c THEN 'current' WHEN r > c THEN 'later' END AS part FROM c""")
def split_at_visit(spark, sf):
    return C.split_at(load(spark, sf, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey", "part")


@query("distinct_by_name", """
WITH n AS (SELECT o_custkey, o_orderkey, o_orderdate, ' ' || upper(o_orderpriority) AS name FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(trim(name)) ORDER BY o_orderdate, o_orderkey) AS r FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM f WHERE r = 1)
SELECT o_custkey, o_orderkey, name FROM k WHERE k <= 3""")
def distinct_by_name(spark, sf):
    o = load(spark, sf, "orders").withColumn("name", F.concat(F.lit(" "), F.upper("o_orderpriority")))
    return C.distinct_by_name(o, "o_custkey", "name", [F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "name")


@query("preferred_labels", """
SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY (p_type = 'ECONOMY') DESC, p_partkey) AS r FROM part WHERE lower(p_name) IN ('small ring', 'red widget', 'blue ring')) WHERE r = 1""")
def preferred_labels(spark, sf):
    return C.preferred(load(spark, sf, "part"), "p_name", ["Small Ring", "red widget", "BLUE RING"], F.col("p_type") == "ECONOMY", [F.col("p_partkey")]).select("p_name", "p_partkey")


@query("weighted_size", """
SELECT user_id, CAST((count(*) FILTER (WHERE event_type = 'error') * 60 + count(*) FILTER (WHERE event_type = 'view') * 50 + count(*) FILTER (WHERE event_type = 'click') * 70) // 4 AS BIGINT) AS estimate FROM events GROUP BY 1""")
def weighted_size(spark, sf):
    n = T.events(spark, sf).groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("error", "view", "click")])
    return n.select("user_id", C.weighted_size({"error": 60, "view": 50, "click": 70}).alias("estimate"))


_PAIR_COUNTS = T.PAIR_SQL


@query("pair_coverage", f"WITH {_PAIR_COUNTS} SELECT a_kind, b_kind, count(*) AS n FROM scored GROUP BY 1, 2")
def pair_coverage(spark, sf):
    return C.pair_counts(T.pair_candidates_scored(spark, sf), "a_kind", "b_kind")


@query("pair_members", f"WITH {_PAIR_COUNTS} SELECT a_id AS user_id FROM scored UNION SELECT b_id FROM scored")
def pair_members(spark, sf):
    return C.either_side(T.pair_candidates_scored(spark, sf), "a_id", "b_id", "user_id")


# checks of text


@query("direction_assertions", "SELECT conv_id, turn, array_to_string(list_sort(list_filter(['tion', 'will', 'an the', 'of the'], lambda p: contains(lower(text), p))), ',') AS found FROM conversations")
def direction_assertions(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", F.array_join(G.phrases_in(F.col("text"), ["will", "of the", "tion", "an the"]), ",").alias("found"))


_CHART = """
c AS (SELECT user_id, map_from_entries(list((event_type, m > 95))) AS chart, list_sort(list(event_type) FILTER (WHERE m > 80)) AS gold FROM (SELECT user_id, event_type, max(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT doc_id AS user_id, lower(substr(coalesce(text, ''), 1, 400)) AS stem FROM documents)"""


def _charts(spark, sf):
    m = T.events(spark, sf).groupBy(*T.KEYS).agg(F.max("value").alias("m"))
    over = F.when(F.col("m") > 80, F.col("event_type"))
    c = m.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.col("m") > 95))).alias("chart"), F.array_sort(F.collect_list(over)).alias("gold"))
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), F.substring(F.coalesce("text", F.lit("")), 1, 400).alias("stem"))
    return c.join(d, "user_id")


@query("chart_checks", f"""
WITH {_CHART}, x AS (SELECT user_id, chart, coalesce(gold, []) AS gold, stem, list_transform(range(user_id % 4), lambda i: CASE WHEN i % 2 = 0 THEN 'induces ' || user_id ELSE 'impairs' END) AS chain FROM c JOIN d USING (user_id)),
y AS (SELECT user_id,
  len(gold) > 0 AND len(list_filter(['la ', 'der '], lambda p: contains(stem, p))) = 0 AND len(list_filter(map_keys(chart), lambda k: contains(stem, k))) = 0 AS answerable,
  len(list_filter(gold, lambda g: chart[g])) > 0 AS specific,
  len(chain) >= 3 OR (len(chain) = 2) AS causal, user_id % 2 = 0 AS grounded FROM x)
SELECT user_id, answerable, specific, causal, grounded AND user_id % 3 <> 1 AS grounded, answerable AND specific AND causal AND grounded AND user_id % 3 <> 1 AS accept FROM y""")
def chart_checks(spark, sf):
    chain = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("user_id") % 4), lambda i: F.when(i % 2 == 0, F.concat(F.lit("induces "), F.col("user_id").cast("string"))).otherwise("impairs"))
    auto = G.chart_checks(F.col("stem"), F.col("gold"), F.col("chart"), chain, F.col("user_id") % 2 == 0, ["induces", "impairs"], ["la ", "der "])
    review = {"grounded": F.when(F.col("user_id") % 3 == 1, False).when(F.col("user_id") % 3 == 2, True)}
    return _charts(spark, sf).select("user_id", *[c.alias(k) for k, c in G.merged(auto, review).items()])


_LEAK = G.whole_words(["the", "la"])


@query("direction_checks", f"""
WITH {T._TRAJECTORY}, truths AS (SELECT user_id, map_from_entries(list((event_type, direction))) AS truth FROM traj GROUP BY 1),
x AS (SELECT g.user_id, truth, ['error', 'view'] AS targets, coalesce(stem, '') AS stem FROM truths g LEFT JOIN (SELECT doc_id AS user_id, lower(substr(coalesce(text, ''), 1, 400)) AS stem FROM documents) d ON d.user_id = g.user_id),
y AS (SELECT *, list_filter(targets, lambda t: list_contains(map_keys(truth), t)) AS real FROM x)
SELECT user_id, len(real) = 2 AND len(list_filter(real, lambda t: truth[t] = 'Rising')) = len(real) AND NOT regexp_matches(stem, '{_LEAK}') AS answerable,
  list_contains(real, 'error') AS specific, len(list_filter(real, lambda t: t = 'view')) >= greatest(1, len(real) // 2) AS causal, len(real) > 0 AND user_id % 2 = 0 AS grounded FROM y""")
def direction_checks(spark, sf):
    t = T.trajectory_direction(spark, sf).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "direction"))).alias("truth"))
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), F.substring(F.coalesce("text", F.lit("")), 1, 400).alias("stem"))
    both = ("error", "view")
    same = lambda v: F.create_map(*[x for k in both for x in (F.lit(k), v)])
    reasons = F.create_map(F.lit("error"), F.lit("falls by 3"), F.lit("view"), F.lit("this IMPAIRS it"))
    checks = G.direction_checks(F.col("stem"), F.array(*map(F.lit, both)), F.col("truth"), same(F.lit("rising")), reasons, same(F.col("user_id") % 2 == 0), ["impairs", "induces"], _LEAK)
    return t.join(d, "user_id", "left").select("user_id", *[c.alias(k) for k, c in checks.items()])


@query("owner_checks", """
SELECT conv_id, turn, upper(role[1]) = 'U' AND NOT regexp_matches(lower(text), 'the answer|belongs to') AS answerable, regexp_matches(text, '[0-9]') AS specific,
  (contains(lower(text), 'tion') OR contains(lower(text), 'with')) AND turn >= 1 AS causal, conv_id % 2 = 0 AS grounded FROM conversations""")
def owner_checks(spark, sf):
    features = F.filter(F.array(F.lit("x")), lambda x: F.col("turn") >= 1)
    checks = G.owner_checks(F.col("text"), F.lit("U"), F.concat(F.lit(" "), F.substring("role", 1, 1)), F.col("text"), features, F.col("conv_id") % 2 == 0, ["tion", "with"], "the answer|belongs to")
    return load(spark, sf, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in checks.items()])


@query("content_keys", "SELECT user_id, substr(sha256(string_agg(event_id || ':' || event_type, '|' ORDER BY event_id || ':' || event_type)), 1, 16) AS k FROM events GROUP BY 1")
def content_keys(spark, sf):
    return T.events(spark, sf).groupBy("user_id").agg(X.content_key(F.collect_list(F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type")))).alias("k"))


@query("last_fragment", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def last_fragment(spark, sf):
    said = F.concat(F.lit('first {"k": 1, then '), F.lit('{"k": 2} and '), F.col("props"), F.lit(" {"))
    return T.events(spark, sf).select("event_id", X.last_fragment(said, "k bigint")["k"].alias("k"))


@query("compact_items", """
WITH k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, substr('[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY k) || ']', 1, 200) AS body FROM k WHERE k <= 8 GROUP BY 1""")
def compact_items(spark, sf):
    first = C.per_group(T.events(spark, sf), ["user_id"], [F.col("ts"), F.col("event_id")], 8)  # before they are listed
    items = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id", "event_type", "value"))).alias("items"))
    return items.select("user_id", X.compact_items(F.col("items"), ["event_id", "event_type"], 8, 200).alias("body"))


# values


@query("direction_variants", f"""
WITH n AS (SELECT event_id, value - 20 AS b, lead(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 20 AS a FROM events)
SELECT event_id, {T._DIR.format(b='b', a='a')} AS positive, CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN 'rising' ELSE 'stable' END WHEN (a - b) / b > 0.2 THEN 'rising' WHEN (a - b) / b < -0.2 THEN 'falling' ELSE 'stable' END AS nonzero,
  CASE WHEN a > b * 1.2::DOUBLE THEN 'rising' WHEN a < b * 0.8::DOUBLE THEN 'falling' ELSE 'stable' END AS product FROM n WHERE a IS NOT NULL""")
def direction_variants(spark, sf):
    w = Window.partitionBy(*T.KEYS).orderBy("ts", "event_id")
    n = T.events(spark, sf).select("event_id", (F.col("value") - 20).alias("b"), (F.lead("value").over(w) - 20).alias("a")).where("a is not null")
    return n.select("event_id", *[D.direction("b", "a", base=k).alias(k) for k in ("positive", "nonzero", "product")])


@query("window_scores", f"""
WITH {T._PAIRS} SELECT visible_id, target_id, 3 * n_between + 2 * CASE WHEN v_target > 0 THEN abs(v_target - v_visible) / v_target WHEN v_target <> v_visible THEN 1 ELSE 0 END
  + CASE WHEN gap_hours BETWEEN 6 AND 24 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM pairs""")
def window_scores(spark, sf):
    p = S.ordered_pairs(T.events(spark, sf).where("event_type = 'error'"), ["user_id"])
    return p.select("visible_id", "target_id", D.window_score("n_between", D.relative_gap("v_visible", "v_target"), "gap_hours").alias("score"))


@query("translated_values", f"""
WITH {T._RANGES}, x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN floor(value) ELSE value END AS v, low, high, mean, sd FROM events JOIN ranges USING (event_type)),
t AS (SELECT *, 50 + (v - mean) / sd * 5 AS t FROM x), r AS (SELECT *, {T._ROUND.format(x='t', d=0)} AS whole, {T._ROUND.format(x='t', d=1)} AS tenth FROM t)
SELECT event_id, CASE WHEN v = floor(v) THEN whole ELSE tenth END AS like_it, CASE WHEN tenth BETWEEN 45 AND 55 THEN tenth ELSE 50.0::DOUBLE END AS kept,
  CASE WHEN v > high THEN 'HIGH' WHEN v < low THEN 'LOW' ELSE 'NORMAL' END AS side, abs(v - CASE WHEN v > high THEN high ELSE low END) / CASE WHEN v > high THEN high ELSE low END * 100 AS outside FROM r""")
def translated_values(spark, sf):
    e = T.events(spark, sf).join(F.broadcast(T.ranges(spark)), "event_type").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.floor("value")).otherwise(F.col("value")))
    to = ("v", "mean", "sd", F.lit(50), F.lit(5))
    return e.select("event_id", D.translated_like(*to).alias("like_it"), D.translated_or_middle(*to, F.lit(45), F.lit(55)).alias("kept"), D.range_side("v", "low", "high").alias("side"), D.percent_outside("v", "low", "high").alias("outside"))


@query("rescaled_ages", """
SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN greatest(1, round((c_custkey % 90) * 0.25::DOUBLE)) WHEN 1 THEN greatest(1, round((c_custkey % 90) * 0.4::DOUBLE)) ELSE c_custkey % 90 END::DOUBLE AS age,
  CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'mare' WHEN c_nationkey % 3 = 0 THEN 'gelding' WHEN c_nationkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'female' ELSE 'adult' END AS called FROM customer""")
def rescaled_ages(spark, sf):
    kind = F.element_at(F.array(F.lit("horse"), F.lit("other"), F.lit("none")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    c = load(spark, sf, "customer").withColumn("kind", kind).withColumn("sex", F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M"))
    names = {"horse": {"F": "mare", "M": "gelding"}, "other": {"F": "female"}}
    return c.select("c_custkey", D.rescaled_age(F.col("c_custkey") % 90, "kind", {"horse": 0.25, "other": 0.4}).alias("age"), D.renamed("sex", "kind", names, "adult").alias("called"))


@query("overridden_records", """
SELECT o_orderkey, o_totalprice AS before, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS after, o_orderstatus AS status FROM orders""")
def overridden_records(spark, sf):
    own = F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    copy = D.overridden(own, price=F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice")))
    return load(spark, sf, "orders").select("o_orderkey", own.alias("own"), copy.alias("copy")).select("o_orderkey", F.col("own.price").alias("before"), F.col("copy.price").alias("after"), "copy.status")


@query("inferred_kinds", """
SELECT p_partkey, CASE WHEN contains(p_name, 'ring') AND p_partkey % 3 = 0 THEN 'first' WHEN contains(p_type, 'STANDARD') THEN 'third'
  ELSE list_extract(['first', 'second', 'third', 'fourth'], CAST((p_partkey + 3) % 4 + 1 AS INTEGER)) END AS kind FROM part""")
def inferred_kinds(spark, sf):
    from ..operators.records import inferred_kind

    rules = [(["ring"], F.col("p_name"), F.col("p_partkey") % 3 == 0, "first"), (["standard"], F.col("p_type"), F.lit(True), "third")]
    return load(spark, sf, "part").select("p_partkey", inferred_kind(F.col("p_partkey"), ["first", "second", "third", "fourth"], rules).alias("kind"))


@query("assumed_smd", """
SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN 0 ELSE abs(p_retailprice - 1000) / sqrt(((p_size % 5) * (p_size % 5) * 2500.0::DOUBLE + (p_size % 5) * (p_size % 5) * 2500.0::DOUBLE) / 2) END, 9) AS smd FROM part""")
def assumed_smd(spark, sf):
    sd = (F.col("p_size") % 5) * 50.0
    return load(spark, sf, "part").select("p_partkey", F.round(M.smd(F.col("p_retailprice"), F.lit(1000.0), sd, sd), 9).alias("smd"))


@query("flag_distances", """
WITH f AS (SELECT user_id, max((event_type = 'error' AND value > 90)::INT) AS a, max((event_type = 'view' AND value > 90)::INT) AS b, max((event_type LIKE 'sign%' AND value > 90)::INT) AS c FROM events GROUP BY 1)
SELECT x.user_id, (x.a <> y.a)::INT + (x.b <> y.b)::INT + (x.c <> y.c)::INT AS hamming, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c)) AS euclidean FROM f x JOIN f y ON y.user_id = x.user_id + 1""")
def flag_distances(spark, sf):
    from .cohorts import comorbidity_flags

    f = comorbidity_flags(spark, sf)
    x, y = f.alias("x"), f.withColumn("user_id", F.col("user_id") - 1).alias("y")
    a, b = ([F.col(f"{s}.{c}") for c in ("f_error", "f_view", "f_sign")] for s in "xy")
    return x.join(y, F.col("x.user_id") == F.col("y.user_id")).select("x.user_id", M.hamming(a, b).alias("hamming"), M.euclidean(a, b).alias("euclidean"))


@query("system_map", """
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'round' WHEN contains(lower(p_name), 'widget') THEN 'device' WHEN contains(lower(p_name), 'red') THEN 'coloured' ELSE 'other' END AS system FROM part""")
def system_map(spark, sf):
    return load(spark, sf, "part").select("p_partkey", M.systems(F.col("p_name"), {"ring": "round", "widget": "device", "red": "coloured"}).alias("system"))


def _overlap(spark, sf, system):
    """Customers of different segments, by their orders: pairs and diagnosis."""
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.max("o_totalprice").alias("largest"))
    c = load(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("balance"))
    columns = ["balance", "orders", "largest"]
    rows = M.imputed(c.join(o, "c_custkey", "left"), columns)
    return M.overlap_diagnosis(rows, "kind", "c_custkey", M.varying(rows, columns), system)


@query("overlap_pairs")
def overlap_pairs(spark, sf):
    """Subjects of two kinds of different systems, matched on a propensity, if the kinds overlap enough."""
    return _overlap(spark, sf, {"auto": "road", "machin": "plant"})[0]


@query("overlap_diagnosis")
def overlap_diagnosis(spark, sf):
    """What was found about each pair of kinds, kept or not."""
    return _overlap(spark, sf, {"auto": "road", "machin": "plant", "building": "plant", "furn": "home"})[1]


# reports

_RESULTS = """
m AS (SELECT user_id, event_type, count(*) AS n, max(value) AS top, min(value) AS low FROM events GROUP BY 1, 2),
l AS (SELECT user_id, event_type AS label, CASE WHEN n > 5 THEN round(low / 100, 3) END AS confidence, CASE WHEN top > 90 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM m)"""


def _results(spark, sf):
    m = T.events(spark, sf).groupBy(*T.KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.min("value").alias("low"))
    entry = lambda v: F.map_from_entries(F.collect_list(F.struct("event_type", v)))
    return m.groupBy("user_id").agg(entry(F.when(F.col("n") > 5, F.round(F.col("low") / 100, 3))).alias("predictions"), entry(F.when(F.col("top") > 90, 1.0).otherwise(0.5)).alias("scores"))


@query("gathered_results", f"WITH {_RESULTS} SELECT user_id, label, confidence, (score = 1)::INT::DOUBLE AS correct FROM l WHERE confidence IS NOT NULL")
def gathered_results(spark, sf):
    return K.gathered(_results(spark, sf), ["user_id"], "predictions", "scores")


@query("confidence_and_accuracy", f"WITH {_RESULTS} SELECT label, round(avg(confidence), 9) AS mean_confidence, round(avg((score = 1)::INT), 9) AS accuracy, count(*) AS n FROM l WHERE confidence IS NOT NULL GROUP BY 1")
def confidence_and_accuracy(spark, sf):
    g = K.confidence_and_accuracy(gathered_results(spark, sf), ["label"], F.col("confidence"), F.col("correct"))
    return g.select("label", F.round("mean_confidence", 9).alias("mean_confidence"), F.round("accuracy", 9).alias("accuracy"), "n")


@query("condition_summary", """
SELECT CASE WHEN event_id % 2 = 0 THEN 'with' ELSE 'without' END AS condition, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 3) AS mean_score, round(avg((value > 50)::INT), 3) AS high_rate, round(avg((value > 90)::INT), 3) AS top_rate FROM events GROUP BY 1""")
def condition_summary(spark, sf):
    e = T.events(spark, sf).select(F.when(F.col("event_id") % 2 == 0, "with").otherwise("without").alias("condition"), F.col("value").cast("decimal(18,2)").alias("value"), (F.col("value") > 50).alias("high"), (F.col("value") > 90).alias("top"))
    return K.condition_summary(e, "condition", "value", ["high", "top"]).withColumn("mean_score", F.col("mean_score").cast("double"))


@query("comparison_table", "SELECT user_id, event_type, coalesce(printf('%.3f', max(value)), 'n/a') AS total, coalesce(printf('%.3f', max(value) FILTER (WHERE value > 90)), 'n/a') AS top FROM events GROUP BY 1, 2")
def comparison_table(spark, sf):
    m = T.events(spark, sf).groupBy(*T.KEYS).agg(F.max("value").alias("total"), F.max(F.when(F.col("value") > 90, F.col("value"))).alias("top"))
    return K.comparison(m, "user_id", "event_type", ["total", "top"])


@query("outcome_extraction", """
WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) FILTER (WHERE event_type = 'signup') AS v FROM events GROUP BY 1) SELECT user_id, len(v) AS n, v[1] AS first_value, v[-1] AS last_value FROM l WHERE v IS NOT NULL""")
def outcome_extraction(spark, sf):
    series = T.events(spark, sf).groupBy(*T.KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    episodes = series.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("post"))
    o = K.outcomes(episodes, "user_id", "post", "signup")
    return o.select("user_id", F.size("trajectory").cast("long").alias("n"), F.element_at("trajectory", 1).alias("first_value"), F.element_at("trajectory", -1).alias("last_value"))


@query("sensitivity", """
SELECT event_type AS action, round(avg((value > 50)::INT), 2) AS sensitivity, round(avg((((value > 20)::INT + (value > 50)::INT + (value > 90)::INT) / 3)), 6) AS total FROM events GROUP BY 1""")
def sensitivity(spark, sf):
    part = lambda x: (F.col("value") > x).cast("int")
    e = T.events(spark, sf).select("event_type", part(50).alias("differs"), K.mean_of(part(20), part(50), part(90)).alias("total"))
    return e.groupBy(F.col("event_type").alias("action")).agg(F.round(F.avg("differs"), 2).alias("sensitivity"), F.round(F.avg("total"), 6).alias("total"))


@query("truth_with_predictions", f"""
WITH {T._TRAJECTORY}, p AS (SELECT user_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'Stable' ELSE 'Rising' END AS predicted FROM traj WHERE user_id % 3 <> 0)
SELECT user_id, avg(CASE WHEN predicted IS NULL THEN 0 WHEN predicted = direction THEN 1 WHEN predicted = 'Stable' THEN 0.5::DOUBLE ELSE 0 END) AS score, count(predicted) AS n_predicted FROM traj LEFT JOIN p USING (user_id, event_type) GROUP BY 1""")
def truth_with_predictions(spark, sf):
    t = T.trajectory_direction(spark, sf).select(*T.KEYS, "direction")
    p = t.where("user_id % 3 <> 0").select(*T.KEYS, F.when(F.col("user_id") % 2 == 0, "Stable").otherwise("Rising").alias("predicted"))
    both = K.with_predictions(t, p, T.KEYS)
    return both.groupBy("user_id").agg(F.avg(K.direction_points(F.col("predicted"), F.col("direction"))).alias("score"), F.count("predicted").alias("n_predicted"))


@query("rewards", """
WITH c AS (SELECT user_id, list_distinct(list(event_type)) AS asked FROM events WHERE value > 60 GROUP BY 1),
x AS (SELECT user_id, len(list_intersect(asked, ['error', 'view'])) AS hit, len(asked) AS n, len(list_filter(asked, lambda a: a NOT IN ('error', 'view', 'click'))) AS wrong, (user_id % 3) / 2 AS j FROM c)
SELECT user_id, round(0.35::DOUBLE * hit / 2 + 0.2::DOUBLE * (1 - wrong / (n + 1e-6)) + 0.1::DOUBLE * (-2.0::DOUBLE * (2 - hit)) + 0.2::DOUBLE * (-0.5::DOUBLE * greatest(0, n - 2 - 1)) + 0.15::DOUBLE * j, 9) AS rubric,
  round(least(0.70::DOUBLE, 0.35::DOUBLE * hit / 2 + 0.2::DOUBLE * (1 - wrong / 2) + 0.1::DOUBLE * exp(-2.0::DOUBLE * greatest(0, (2 - hit) / 2)) + 0.2::DOUBLE * exp(-0.5::DOUBLE * greatest(0, (n - hit - 2) / 1)) + 0.15::DOUBLE * j), 9) AS graded FROM x""")
def rewards(spark, sf):
    c = T.events(spark, sf).where("value > 60").groupBy("user_id").agg(F.collect_set("event_type").alias("asked"))
    core, optional = F.array(F.lit("error"), F.lit("view")), F.array(F.lit("click"))
    asked, j = F.col("asked"), F.pmod("user_id", F.lit(3)) / 2
    hit, opt = F.size(F.array_intersect(asked, core)), F.size(F.array_intersect(asked, optional))
    wrong = F.size(F.array_except(asked, F.concat(core, optional)))
    return c.select("user_id", F.round(K.request_reward(asked, core, optional, j), 9).alias("rubric"), F.round(K.graded_reward(hit, opt, wrong, wrong, 2, 1, 2, j), 9).alias("graded"))


# whole cases


@query("next_value_cases", f"""
WITH n AS (SELECT user_id, event_type, event_id, ts, value AS before, lead(value) OVER w AS after, lead(ts) OVER w AS ts2, lead(event_id) OVER w AS next_id FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT * FROM n WHERE {T._H.format(a='ts', b='ts2')} BETWEEN 1 AND 48 AND before <> after),
c AS (SELECT user_id, min_by(event_id, (md5('1:' || user_id || ':' || event_id), event_id)) AS event_id FROM p GROUP BY 1),
q AS (SELECT p.* FROM p JOIN c USING (user_id, event_id)),
e AS (SELECT q.user_id, q.event_id AS visible_id, q.next_id, q.before, q.after, q.ts AS t1, x.event_id, x.event_type AS label, x.ts, x.value FROM q JOIN events x ON x.user_id = q.user_id AND x.ts <= q.ts AND (x.event_type = 'error' OR epoch_us(q.ts) - epoch_us(x.ts) <= 10 * 86400000000)),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, label, date_trunc('minute', ts) ORDER BY ts, event_id) AS r FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM d WHERE r = 1)
SELECT user_id, visible_id, next_id, CASE WHEN after > before * 1.2::DOUBLE THEN 'rising' WHEN after < before * 0.8::DOUBLE THEN 'falling' ELSE 'stable' END AS direction,
  count(*) AS n_timeline, string_agg(event_id::VARCHAR, ',' ORDER BY k DESC) AS timeline FROM k WHERE k <= 20 GROUP BY ALL""")
def next_value_cases(spark, sf):
    """A case of each subject: one pair of measurements, what was known at the first, and the truth."""
    from ..operators.records import timeline

    e = T.events(spark, sf)
    pairs = S.next_pairs(e.where("event_type = 'error'"), ["user_id"])
    chosen = C.pick_one(pairs, "user_id", 1, "event_id").join(e.select("event_id", F.col("ts").alias("anchor_ts")), "event_id")
    chosen = chosen.select("user_id", F.col("event_id").alias("visible_id"), "next_id", D.direction("before", "after", base="product").alias("direction"), "anchor_ts")
    seen = A.look_back(e, chosen, "user_id", F.col("event_type") == "error", 10)
    case = timeline(seen, ["user_id", "visible_id", "next_id", "direction"], "event_type", 20)
    return case.select("user_id", "visible_id", "next_id", "direction", F.size("timeline").cast("long").alias("n_timeline"), F.array_join(F.transform("timeline", lambda x: x["event_id"].cast("string")), ",").alias("timeline"))


@query("admission_bundles", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, min(CASE WHEN o_orderstatus = 'P' THEN 1 END) OVER (PARTITION BY o_custkey) AS has FROM orders),
c AS (SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS cut_key FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
x AS (SELECT r.*, c.cut_key, max(CASE WHEN r.o_orderkey = c.cut_key THEN r.r END) OVER (PARTITION BY r.o_custkey) AS cr FROM r JOIN c USING (o_custkey)),
l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS items FROM lineitem GROUP BY 1)
SELECT o_custkey AS subject, cut_key, count(*) FILTER (WHERE r < cr) AS n_prior, coalesce(sum(n) FILTER (WHERE r < cr), 0)::BIGINT AS prior_rows, coalesce(max(items) FILTER (WHERE r = cr), 0)::BIGINT AS current_items FROM x LEFT JOIN l ON l_orderkey = o_orderkey WHERE r <= cr GROUP BY 1, 2""")
def admission_bundles(spark, sf):
    """The history of each subject before one admission, and that admission."""
    items = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("items"))
    parts = C.split_at(load(spark, sf, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderstatus") == "P").where("part in ('prior', 'current')")
    at = lambda p, v: F.when(F.col("part") == p, v)
    g = parts.join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_custkey").alias("subject")).agg(
        F.max(at("current", F.col("o_orderkey"))).alias("cut_key"), F.count_if(F.col("part") == "prior").alias("n_prior"),
        F.coalesce(F.sum(at("prior", F.col("n"))), F.lit(0)).alias("prior_rows"), F.coalesce(F.max(at("current", F.col("items"))), F.lit(0)).alias("current_items"),
    )
    return g


@query("pair_questions", f"""
WITH {_PAIR_COUNTS}, t AS (SELECT user_id, min_by(value, (ts, event_id)) AS b, max_by(value, (ts, event_id)) AS f FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT a_id, b_id, a.f - a.b AS change_a, b.f - b.b AS change_b, CASE WHEN abs(a.f - a.b) > abs(b.f - b.b) THEN 'A' WHEN abs(a.f - a.b) < abs(b.f - b.b) THEN 'B' ELSE 'same' END AS larger, abs(abs(a.f - a.b) - abs(b.f - b.b)) AS difference
FROM scored JOIN t a ON a.user_id = a_id JOIN t b ON b.user_id = b_id""")
def pair_questions(spark, sf):
    """What happened to both sides of a pair, and which changed more."""
    from ..operators.records import pair_truth

    at = F.struct("ts", "event_id")
    ends = T.events(spark, sf).where("event_type = 'error'").groupBy("user_id").agg(F.min_by("value", at).alias("baseline"), F.max_by("value", at).alias("final"))
    return pair_truth(T.pair_candidates_scored(spark, sf).select("a_id", "b_id"), ends, "user_id")


@query("value_at", """
SELECT user_id, event_type, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, max_by(value, (ts, event_id)) AS value FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2, 3""")
def value_at(spark, sf):
    """Gated access: values only for the labels and days that are asked for."""
    e = T.events(spark, sf).withColumn("day", F.date_format("ts", "yyyyMMdd").cast("int"))
    return e.where("event_type = 'error' and ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-12'").groupBy("user_id", "event_type", "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("shape_padded", """
WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) FILTER (WHERE event_type = 'error') AS a, list(value ORDER BY ts, event_id) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1),
z AS (SELECT user_id, list_transform(a, lambda x: (x - list_avg(a)) / (list_stddev_pop(a) + 1e-6)) AS a, list_transform(b, lambda x: (x - list_avg(b)) / (list_stddev_pop(b) + 1e-6)) AS b FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
g AS (SELECT user_id, unnest(list_zip(a, b)) AS g FROM z)
SELECT user_id, round(sqrt(sum((coalesce(g[1], 0) - coalesce(g[2], 0)) * (coalesce(g[1], 0) - coalesce(g[2], 0)))), 6) AS distance FROM g GROUP BY 1""")
def shape_padded(spark, sf):
    series = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == k, F.struct("ts", "event_id", "value")))), lambda x: x["value"])
    both = T.events(spark, sf).groupBy("user_id").agg(series("error").alias("a"), series("view").alias("b")).where("size(a) > 0 and size(b) > 0")
    return both.select("user_id", F.round(K.shape_distance(F.col("a"), F.col("b")), 6).alias("distance"))


def _listed(kind: str) -> str:
    return f"""(SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY k DESC) AS {kind} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, floor(value), date_trunc('day', ts) ORDER BY ts, event_id) AS r FROM events WHERE event_type = '{kind}') WHERE r = 1) WHERE k <= 5 GROUP BY 1) {kind}"""


@query("full_records", f"SELECT user_id, coalesce(error, '') AS error, coalesce(view, '') AS view, coalesce(click, '') AS click FROM {_listed('error')} FULL JOIN {_listed('view')} USING (user_id) FULL JOIN {_listed('click')} USING (user_id)")
def full_records(spark, sf):
    """Everything of a subject: the newest entries of each table, one for each thing and day."""
    from ..operators.records import full_record

    e = T.events(spark, sf).withColumn("what", F.floor("value"))
    kinds = ("error", "view", "click")
    record = full_record({k: e.where(F.col("event_type") == k) for k in kinds}, "user_id", "what", 5)
    return record.select("user_id", *[F.array_join(F.transform(k, lambda x: x["event_id"].cast("string")), ",").alias(k) for k in kinds])


@query("signal_window_cases", f"""
WITH {T._PAIRS}, t AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
n AS (SELECT p.user_id, visible_id, target_id, v_visible, v_target, gap_hours, v.ts AS tv, w.ts AS tw, (SELECT count(*) FROM events x WHERE x.user_id = p.user_id AND x.event_type <> 'error' AND x.ts > v.ts AND x.ts <= w.ts) AS n_signals
  FROM pairs p JOIN t v ON v.event_id = visible_id JOIN t w ON w.event_id = target_id),
s AS (SELECT *, 3 * n_signals + 2 * CASE WHEN v_target > 0 THEN abs(v_target - v_visible) / v_target WHEN v_target <> v_visible THEN 1 ELSE 0 END + CASE WHEN gap_hours BETWEEN 6 AND 24 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, target_id, visible_id) AS r FROM s)
SELECT b.user_id, visible_id, target_id, n_signals, round(score, 9) AS score, (SELECT count(*) FROM events x WHERE x.user_id = b.user_id AND CASE WHEN x.event_type = 'error' THEN x.ts <= tv ELSE x.ts <= tw END) AS n_seen FROM b WHERE r = 1""")
def signal_window_cases(spark, sf):
    """The window of each subject that other measurements tell most about, and how much of its record may be seen."""
    from ..operators.records import signals_until

    e = T.events(spark, sf)
    own = F.col("event_type") == "error"
    counted = signals_until(e, "user_id", ~own).where(own)
    at = lambda side, t: counted.select(F.col("event_id").alias(f"{side}_id"), F.col("ts").alias(t), F.col("signals").alias(f"n_{side}"))
    pairs = S.ordered_pairs(e.where(own), ["user_id"]).join(at("visible", "t_visible"), "visible_id").join(at("target", "t_target"), "target_id")
    scored = pairs.withColumn("n_signals", F.col("n_target") - F.col("n_visible")).withColumn("score", D.window_score("n_signals", D.relative_gap("v_visible", "v_target"), "gap_hours"))
    best = C.per_group(scored, ["user_id"], [F.desc("score"), F.col("target_id"), F.col("visible_id")], 1)
    case = best.select("user_id", "visible_id", "target_id", "n_signals", F.round("score", 9).alias("score"), "t_visible", "t_target")
    keys = ["user_id", "visible_id", "target_id", "n_signals", "score"]
    return A.masked(e, case, "user_id", own).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seen"))
