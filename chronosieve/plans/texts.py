"""Text gates, chunks, retrieval and small parsers on documents, conversations and embeddings."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as R
from ..session import load
from .registry import query

#: Leak terms of the stand-in guard.
TERMS = ["token", "license", "password", "copyright", "the", "warranty"]


@query("identifier_gate", r"""
SELECT doc_id, CASE WHEN contains(text, '4785380592391139') THEN 'id' WHEN regexp_matches(text, '\b\d{4}-\d{2}-\d{2}\b') THEN 'date'
  WHEN regexp_matches(text, '\b\d+(?:\.\d+)?\s?(?:mmol/?l|mg/?dl|meq/?l|g/?dl|/ul|k/ul|mmhg|mcg|ng/?ml|u/?l)\b', 'i') THEN 'value_unit' WHEN regexp_matches(text, '\d{7,}') THEN 'digits' END AS reason FROM documents""")
def identifier_gate(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.blocked_reason(F.col("text"), ["4785380592391139"]).alias("reason"))


@query("leak_terms", """
SELECT conv_id, turn, array_to_string(list_sort(list_filter(['token', 'license', 'password', 'copyright', 'warranty'], lambda t: contains(lower(text), t))), ',') AS leaked FROM conversations""")
def leak_terms(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(",", X.leaked(F.col("text"), F.array(*map(F.lit, TERMS)))).alias("leaked"))


@query("fingerprint_dedupe", """
WITH s AS (SELECT user_id, date_trunc('day', ts) AS day, array_to_string(list_sort(list_distinct(list(lower(event_type)))), '|') AS k, min(event_id) AS first_id FROM events GROUP BY 1, 2)
SELECT user_id, substr(sha1(k), 1, 16) AS fp, min(first_id) AS event_id, count(*) AS n FROM s GROUP BY 1, 2""")
def fingerprint_dedupe(spark, sf):
    e = load(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(X.fingerprint(F.collect_set("event_type")).alias("fp"), F.min("event_id").alias("first_id"))
    return e.groupBy("user_id", "fp").agg(F.min("first_id").alias("event_id"), F.count(F.lit(1)).alias("n"))


@query("synonym_score", """
SELECT conv_id, turn, (contains(lower(text), 'with') OR contains(lower(text), 'avec'))::INT AS has_with, (contains(lower(text), 'from') OR contains(lower(text), 'von'))::INT AS has_from FROM conversations""")
def synonym_score(spark, sf):
    t = F.col("text")
    return load(spark, sf, "conversations").select("conv_id", "turn", X.any_synonym(t, ["with", "Avec"]).cast("int").alias("has_with"), X.any_synonym(t, ["from", "von"]).cast("int").alias("has_from"))


@query("chunk_sliding", """
SELECT doc_id, k AS chunk, substr(text, 1 + 480 * k, 600) AS body FROM documents, range(100000) r(k) WHERE k <= greatest(ceil((length(text) - 600) / 480), 0)""")
def chunk_sliding(spark, sf):
    return R.sliding_chunks(load(spark, sf, "documents"), "doc_id", "text")


@query("chunk_paragraph", r"""
WITH RECURSIVE s AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
f AS (
  SELECT doc_id, 0::BIGINT AS i, '' AS open, []::VARCHAR[] AS done FROM s
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN length(open) + length(p) <= 600 THEN regexp_replace(open || chr(10) || chr(10) || p, '^\s+|\s+$', '', 'g') WHEN length(p) > 600 THEN '' ELSE p END,
    CASE WHEN length(open) + length(p) <= 600 THEN done WHEN length(p) > 600 THEN
      list_concat(CASE WHEN open = '' THEN done ELSE list_append(done, open) END, list_filter(list_transform(range((length(p) - 1) // 480 + 1), lambda k: regexp_replace(substr(p, k * 480 + 1, 600), '^\s+|\s+$', '', 'g')), lambda x: x <> ''))
      WHEN open = '' THEN done ELSE list_append(done, open) END
  FROM (SELECT f.doc_id, f.i, f.open, f.done, s.ps[f.i + 1] AS p FROM f JOIN s USING (doc_id) WHERE f.i < len(s.ps))),
l AS (SELECT doc_id, CASE WHEN open = '' THEN done ELSE list_append(done, open) END AS chunks FROM f JOIN s USING (doc_id) WHERE i = len(ps))
SELECT doc_id, k - 1 AS chunk, chunks[k] AS body FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS k FROM l)""")
def chunk_paragraph(spark, sf):
    return R.packed_chunks(load(spark, sf, "documents"), "doc_id", "text")


@query("cosine_topk", """
WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM s, q ORDER BY score DESC, vec_id LIMIT 10""")
def cosine_topk(spark, sf):
    e = load(spark, sf, "embeddings").where("embedding is not null")
    return R.cosine_topk(e, e.where("vec_id = 0").select(F.col("embedding").alias("q")), "vec_id", "embedding", 10)


@query("json_field", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_field(spark, sf):
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("json_last_object")
def json_last_object(spark, sf):
    said = F.concat(F.lit("answer {\"draft\": 1} then "), F.col("props"), F.lit(" end"))
    return load(spark, sf, "events").select("event_id", X.last_json_object(said).alias("last"))


@query("compact_records", """
SELECT user_id, string_agg(event_id || '=' || event_type, ';' ORDER BY ts, event_id) AS body FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 8 GROUP BY 1""")
def compact_records(spark, sf):
    from pyspark.sql import Window

    e = load(spark, sf, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("k <= 8")
    listed = F.array_sort(F.collect_list(F.struct("k", "event_id", "event_type")))
    return e.groupBy("user_id").agg(F.concat_ws(";", F.transform(listed, lambda x: F.concat(x["event_id"].cast("string"), F.lit("="), x["event_type"]))).alias("body"))
