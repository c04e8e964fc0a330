"""Cohort, join, set, sampling and matching queries.

Stand-ins: an order is an admission, its lineitems are lab rows, part is the
code dictionary, customers are patients, events are a subject's event list.
"""

from pyspark.sql import functions as F

from ..operators import cohort as C, matching as M
from ..session import load
from .registry import query

DEC = "decimal(18,2)"


@query("cohort_density", """
SELECT l_orderkey AS adm, count(l_quantity) AS n_values, count(DISTINCT l_partkey) AS n_items,
       count(*) FILTER (WHERE l_returnflag IS NOT NULL AND trim(l_returnflag) <> '' AND l_returnflag <> 'N') AS n_flagged
FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1 HAVING count(l_quantity) >= 4 AND count(DISTINCT l_partkey) >= 3""")
def cohort_density(spark, sf):
    flag = C.flagged(F.col("l_returnflag")) & (F.col("l_returnflag") != "N")
    d = C.density(load(spark, sf, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", flag)
    return d.where("n_values >= 4 and n_items >= 3").withColumnRenamed("l_orderkey", "adm")


@query("cohort_eligible_index", """
WITH d AS (SELECT l_orderkey, count(l_quantity) AS n_values, count(DISTINCT l_partkey) AS n_items FROM lineitem GROUP BY 1
           HAVING count(l_quantity) >= 3 AND count(DISTINCT l_partkey) >= 2),
s AS (SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_stay, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_stay,
             count(DISTINCT o_orderkey) AS n_stays, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1)
SELECT o.o_orderkey AS adm, o.o_custkey AS subject, d.n_values, d.n_items, s.first_stay, s.last_stay, s.n_stays, s.total, c.c_mktsegment AS segment
FROM orders o JOIN d ON d.l_orderkey = o.o_orderkey JOIN s USING (o_custkey) LEFT JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderstatus = 'F'""")
def cohort_eligible_index(spark, sf):
    orders, items, people = (load(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    d = C.density(items, "l_orderkey", "l_partkey", "l_quantity", F.lit(False)).where("n_values >= 3 and n_items >= 2").drop("n_flagged")
    s = C.stays(orders, "o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast(DEC)).withColumn("total", F.col("total").cast("double"))
    own = orders.where("o_orderstatus = 'F'").join(d, F.col("o_orderkey") == F.col("l_orderkey")).join(s, "o_custkey")
    return own.join(people, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("adm"), F.col("o_custkey").alias("subject"), "n_values", "n_items", "first_stay", "last_stay", "n_stays", "total", F.col("c_mktsegment").alias("segment"))


@query("dict_join_left", """
SELECT l_orderkey, l_linenumber, l_partkey, p_name AS label FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25""")
def dict_join_left(spark, sf):
    labels = load(spark, sf, "part").where("p_size > 25").select("p_partkey", F.col("p_name").alias("label"))
    return load(spark, sf, "lineitem").join(labels, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "label")


@query("dict_join_composite", """
WITH d AS (SELECT DISTINCT p_brand, p_size, min(p_name) AS title FROM part GROUP BY 1, 2)
SELECT p_partkey, p.p_brand, p.p_size, title FROM part p LEFT JOIN d ON p.p_brand = d.p_brand AND p.p_size = d.p_size AND d.p_size % 2 = 0""")
def dict_join_composite(spark, sf):
    part = load(spark, sf, "part")
    d = part.where("p_size % 2 = 0").groupBy("p_brand", "p_size").agg(F.min("p_name").alias("title"))
    return part.select("p_partkey", "p_brand", "p_size").join(d, ["p_brand", "p_size"], "left")


@query("lookup_with_fallback", """
SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size > 40 THEN '' ELSE p_name END), ''), CASE p_type WHEN 'ECONOMY' THEN 'economy item' END, list_extract(string_split(p_brand, '#'), -1)) AS label FROM part""")
def lookup_with_fallback(spark, sf):
    desc = F.nullif(F.trim(F.when(F.col("p_size") > 40, "").otherwise(F.col("p_name"))), F.lit(""))
    fixed = F.when(F.col("p_type") == "ECONOMY", "economy item")
    return load(spark, sf, "part").select("p_partkey", F.coalesce(desc, fixed, F.element_at(F.split("p_brand", "#"), -1)).alias("label"))


@query("semi_join", """
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def semi_join(spark, sf):
    return load(spark, sf, "customer").join(load(spark, sf, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("anti_join_unused", """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def anti_join_unused(spark, sf):
    return load(spark, sf, "customer").join(load(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def _users(spark, sf, kind):
    return load(spark, sf, "events").where(F.col("event_type") == kind).where("value > 100").select("user_id")


_U = "SELECT user_id FROM events WHERE event_type = '{}' AND value > 100"


@query("set_union", f"{_U.format('error')} UNION {_U.format('purchase')}")
def set_union(spark, sf):
    return _users(spark, sf, "error").union(_users(spark, sf, "purchase")).distinct()


@query("set_intersect", f"{_U.format('error')} INTERSECT {_U.format('purchase')}")
def set_intersect(spark, sf):
    return _users(spark, sf, "error").intersect(_users(spark, sf, "purchase"))


@query("set_except", f"{_U.format('error')} EXCEPT {_U.format('purchase')}")
def set_except(spark, sf):
    return _users(spark, sf, "error").subtract(_users(spark, sf, "purchase"))


@query("value_counts_min", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 60")
def value_counts_min(spark, sf):
    return C.counts_over(load(spark, sf, "events"), "user_id", 60)


@query("topk_categories", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, p_brand LIMIT 8")
def topk_categories(spark, sf):
    return C.top_categories(load(spark, sf, "part"), "p_brand", 5, 8)


@query("code_range_predicate", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN substr(p_name, 1, 3) BETWEEN 'blu' AND 'gre'
  ELSE coalesce(TRY_CAST(substr(CAST(p_partkey AS VARCHAR), 1, 3) AS INTEGER) BETWEEN 100 AND 150, false) END AS in_range FROM part""")
def code_range_predicate(spark, sf):
    even = F.col("p_size") % 2 == 0
    code = F.when(even, F.col("p_name")).otherwise(F.col("p_partkey").cast("string"))
    return load(spark, sf, "part").select("p_partkey", C.in_code_ranges(code, F.when(even, 10).otherwise(9), [("blu", "gre")], [(100, 150)]).alias("in_range"))


@query("prefix_any", """
SELECT o_custkey, bool_or(o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS any_urgent FROM orders GROUP BY 1""")
def prefix_any(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(C.starts_with_any(F.col("o_orderpriority"), ["1", "2"])).alias("any_urgent"))


@query("per_group_topn", """
SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def per_group_topn(spark, sf):
    return C.per_group(load(spark, sf, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 5).select("event_type", "event_id", "value", F.col("rank").cast("long").alias("rank"))


@query("quota_sample_fill", """
WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
SELECT event_id, event_type, value, r <= 6 AS by_quota FROM r ORDER BY CAST(r <= 6 AS INT) DESC, value DESC, event_id LIMIT 50""")
def quota_sample_fill(spark, sf):
    return C.quota_then_fill(load(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", 6, 50, [F.desc("value"), F.col("event_id")])


@query("dedupe_keep_first", """
SELECT user_id, event_type, day, event_id, value FROM (SELECT user_id, event_type, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, event_id, value,
  row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def dedupe_keep_first(spark, sf):
    e = load(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyyMMdd").cast("int"))
    return C.keep_first(e, ["user_id", "event_type", "day"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "day", "event_id", "value")


@query("ordered_distinct_firstn", """
WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f, event_type) AS r FROM f)
SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS items FROM r WHERE r <= 3 GROUP BY 1""")
def ordered_distinct_firstn(spark, sf):
    return C.ordered_distinct(load(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], 3)


@query("cap_protected", """
WITH f AS (SELECT *, event_type = 'error' AS p FROM events),
r AS (SELECT *, sum(p::INT) OVER (PARTITION BY user_id) AS np, row_number() OVER (PARTITION BY user_id, p ORDER BY ts DESC, event_id DESC) AS r FROM f)
SELECT user_id, event_id, event_type FROM r WHERE p OR r <= greatest(20 - np, 0)""")
def cap_protected(spark, sf):
    return C.cap_protected(load(spark, sf, "events"), ["user_id"], F.col("event_type") == "error", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id", "event_type")


@query("cap_latest", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10""")
def cap_latest(spark, sf):
    return C.per_group(load(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("even_spaced_picks", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view')
SELECT user_id, event_id, i FROM r WHERE n <= 5 OR EXISTS (SELECT 1 FROM range(5) t(j) WHERE (2 * j * (n - 1) + 4) // 8 = i)""")
def even_spaced_picks(spark, sf):
    return C.even_picks(load(spark, sf, "events").where("event_type = 'view'"), "user_id", [F.col("value"), F.col("event_id")], 5).select("user_id", "event_id", F.col("i").cast("long").alias("i"))


@query("stride_picks", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50), event_id) AS c FROM events WHERE event_type = 'click')
SELECT user_id, event_id, i FROM r WHERE CASE WHEN n > 12 THEN i % greatest(n // 4, 1) = 0 AND i / greatest(n // 4, 1) < 4 ELSE c <= 4 END""")
def stride_picks(spark, sf):
    return C.stride_picks(load(spark, sf, "events").where("event_type = 'click'"), "user_id", [F.col("ts"), F.col("event_id")], [F.abs(F.col("value") - 50), F.col("event_id")], 4).select("user_id", "event_id", "i")


@query("hash_pool_sample", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) ORDER BY md5('7:' || user_id), user_id LIMIT 40")
def hash_pool_sample(spark, sf):
    return C.pool(load(spark, sf, "events"), "user_id", 40, 7)


_WIDE = ["error", "view", "click"]


def features(spark, sf):
    e = load(spark, sf, "events").where(F.col("event_type").isin(_WIDE))
    wide = e.groupBy("user_id").pivot("event_type", _WIDE).agg(F.max_by("value", F.struct("ts", "event_id")))
    return wide


_FEATURES = """
p AS (SELECT user_id, max_by(value, (ts, event_id)) FILTER (WHERE event_type = 'error') AS error,
  max_by(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS view, max_by(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS click
  FROM events WHERE event_type IN ('error', 'view', 'click') GROUP BY 1)"""


@query("covariates_imputed", f"""
WITH {_FEATURES}, m AS (SELECT median(error) AS me, median(view) AS mv, median(click) AS mc FROM p)
SELECT user_id, coalesce(error, me, 0) AS error, coalesce(view, mv, 0) AS view, coalesce(click, mc, 0) AS click FROM p, m""")
def covariates_imputed(spark, sf):
    return M.imputed(features(spark, sf), _WIDE)


@query("smd_balance", f"""
WITH {_FEATURES}, m AS (SELECT median(error) AS me, median(view) AS mv, median(click) AS mc FROM p),
w AS (SELECT user_id % 2 = 0 AS t, coalesce(error, me, 0) AS error, coalesce(view, mv, 0) AS view, coalesce(click, mc, 0) AS click FROM p, m),
l AS (SELECT t, 'error' AS covariate, error AS x FROM w UNION ALL SELECT t, 'view', view FROM w UNION ALL SELECT t, 'click', click FROM w)
SELECT covariate, round(abs(avg(x) FILTER (WHERE t) - avg(x) FILTER (WHERE NOT t)) / (sqrt((var_pop(x) FILTER (WHERE t) + var_pop(x) FILTER (WHERE NOT t)) / 2) + 1e-9), 9) AS smd
FROM l GROUP BY 1""")
def smd_balance(spark, sf):
    w = M.imputed(features(spark, sf), _WIDE)
    return M.balance(w, F.col("user_id") % 2 == 0, _WIDE).withColumn("smd", F.round("smd", 9))


@query("comorbidity_flags", """
SELECT user_id, max((event_type = 'error' AND value > 90)::INT) AS f_error, max((event_type = 'view' AND value > 90)::INT) AS f_view,
  max((event_type LIKE 'sign%' AND value > 90)::INT) AS f_sign FROM events GROUP BY 1""")
def comorbidity_flags(spark, sf):
    hit = lambda c: F.max((c & (F.col("value") > 90)).cast("int"))
    t = F.col("event_type")
    return load(spark, sf, "events").groupBy("user_id").agg(hit(t == "error").alias("f_error"), hit(t == "view").alias("f_view"), hit(t.startswith("sign")).alias("f_sign"))


@query("prevalence", """
WITH f AS (SELECT user_id, max((event_type = 'error' AND value > 90)::INT) AS f_error, max((event_type = 'view' AND value > 90)::INT) AS f_view FROM events GROUP BY 1)
SELECT sum(f_error) / count(*) AS p_error, sum(f_view) / count(*) AS p_view, count(*) AS n FROM f""")
def prevalence(spark, sf):
    f = comorbidity_flags(spark, sf)
    return f.agg((F.sum("f_error") / F.count(F.lit(1))).alias("p_error"), (F.sum("f_view") / F.count(F.lit(1))).alias("p_view"), F.count(F.lit(1)).alias("n"))


@query("greedy_pairs")
def greedy_pairs(spark, sf):
    from .timelines import pair_candidates_scored

    return M.greedy_pairs(pair_candidates_scored(spark, sf), ["severity_bin", "a_kind", "b_kind"])


@query("caliper_match")
def caliper_match(spark, sf):
    """Strata are the halves of the subjects; a propensity is fitted over all of them."""
    w = M.imputed(features(spark, sf), _WIDE).withColumn("treated", (F.col("user_id") % 3 == 0).cast("int"))
    return M.caliper_pairs(M.propensity(w, "treated", _WIDE).withColumn("stratum", F.pmod("user_id", F.lit(2))), ["stratum"], "user_id", "treated")


@query("auc_rank", """
WITH d AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
g AS (SELECT s, sum(y)::BIGINT AS pos, count(*) AS n FROM d GROUP BY 1),
b AS (SELECT *, n - pos AS neg, coalesce(sum(n - pos) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM b""")
def auc_rank(spark, sf):
    d = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").where("quality is not null and n_chars is not null")
    return M.auc(d, "quality", "n_chars")
