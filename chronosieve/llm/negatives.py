"""Hard negatives by a secondary sort of packed scores.

Scores are integer inner products of floored vectors, so they are exact and ties are
real. Anchors and vectors are dealt into blocks; a tile joins one block of each:

1. A first pass over the tiles gives each anchor the best rows of its own label in a
   tile; the first `positives` of all its tiles are its positives. Each of them opens a
   window of scores in which rows of other labels are hard negatives.
2. A second pass knows the windows. A tile gives the first `negatives` rows of each
   window that it holds: what comes later in a tile comes later in the whole order too.
3. Positives and negatives become one stream of packed keys (anchor, descending score,
   role, id), dealt by anchor with repartitionAndSortWithinPartitions. An iterator reads
   each anchor's keys once from the highest score down: a positive opens its window, and
   a negative goes out to all open windows until each has enough. Of a score, positives
   come before negatives, so a negative of equal score meets an open window. Nothing is
   held but an anchor's open windows, however many keys it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.rdd import portable_hash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, load, shuffle_partitions

POSITIVES, NEGATIVES, EVERY = 5, 5, 100
#: Percent of a positive's score that a negative must reach, and may have at most.
LEAST, MOST = 80, 100
#: Vectors are multiplied by this and floored.
SCALE = 256
#: Rows of a block, about; anchors whose scores a tile holds at once (some 16 MB).
ANCHOR_BLOCK, VECTOR_BLOCK, AT_ONCE = 1024, 8192, 128

FOUND = "anchor_id long, anchor_key long, id long, score long"
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v, dim, key: rows with an id, a label and a vector without null or non-finite components, repeated ones once."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(fine).distinct()
    return rows.withColumns({"dim": F.size("v"), "key": F.xxhash64("label", "v")})


def floored(column: pa.ChunkedArray, n: int, scale: int) -> np.ndarray:
    """The rows as integers, held as doubles; as Python's integers where doubles could not hold them."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) and flat.num_chunks else flat
    values = flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
    if values.size and np.abs(values).max() >= 2.0**52 / scale:
        ints = [int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
        return np.array(ints, object).reshape(values.shape)
    return np.floor(values * scale)


def products(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows."""
    if a.dtype != object and v.dtype != object and a.size and v.size and np.abs(a).max() * np.abs(v).max() * a.shape[1] < 2.0**53:
        return (a @ v.T).astype(np.int64)
    whole = lambda m: m if m.dtype == object else np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    out = whole(a) @ whole(v).T if a.shape[1] else np.zeros((len(a), len(v)), object)
    if out.size and max(abs(x) for x in out.ravel()) >= 1 << 56:
        raise OverflowError("scores of 2**56 or more do not fit the keys; scale the vectors down")
    return out.astype(np.int64)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller ids, in that order."""
    keep = np.arange(len(scores))
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, equal = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
        need = k - len(above)
        if len(equal) > need:
            equal = equal[np.argpartition(ids[equal], need - 1)[:need]]
        keep = np.concatenate([above, equal])
    return keep[np.lexsort((ids[keep], -scores[keep]))]


def _tile(scale: int, pick):
    """Runs `pick` for each anchor of a tile: (its scores with all vectors, vectors, anchor) -> places of the vectors to keep."""

    def run(key, anchors: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(anchors) and len(vectors):
            v = floored(vectors.column("v"), len(vectors), scale)
            ids, labels = vectors.column("id").to_numpy(), vectors.column("label").to_numpy()
            for at in range(0, len(anchors), AT_ONCE):
                some = anchors.slice(at, AT_ONCE)
                scores = products(floored(some.column("v"), len(some), scale), v)
                for k, anchor in enumerate(some.drop_columns(["v"]).to_pylist()):
                    got = pick(scores[k], ids, labels, anchor)
                    for column, values in zip(out, (np.full(len(got), anchor["id"]), np.full(len(got), anchor["key"]), ids[got], scores[k][got]), strict=True):
                        column.append(values)
        joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("anchor_id", "anchor_key", "id", "score"), (pa.array(c, pa.int64()) for c in joined), strict=True)))

    return run


def _own_label(k: int):
    def pick(scores, ids, labels, anchor):
        own = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["id"]))
        return own[first(scores[own], ids[own], k)]

    return pick


def _in_windows(k: int, least: int, most: int):
    def pick(scores, ids, labels, anchor):
        windows = np.array(anchor["windows"], np.int64)
        low, high = least * windows, most * windows
        near = np.flatnonzero((100 * scores >= low.min()) & (100 * scores <= high.max()) & (labels != anchor["label"]))
        kept = [np.zeros(0, np.int64)]
        for a, b in zip(low, high, strict=True):
            some = near[(100 * scores[near] >= a) & (100 * scores[near] <= b)]
            kept.append(some[first(scores[some], ids[some], k)])
        return np.unique(np.concatenate(kept))

    return pick


def streamed(k: int, least: int, most: int):
    """Sorted keys (anchor_id, anchor_key, -score, role, id) -> rows of the result, an anchor's open windows in memory."""

    def run(keys):
        anchor, windows = None, []
        for (anchor_id, anchor_key, fallen, role, ident), _ in keys:
            if anchor != (anchor_id, anchor_key):
                anchor, windows = (anchor_id, anchor_key), []
            score = -fallen
            # a window closes when it is full or the scores have fallen out of it
            windows = [w for w in windows if w[2] < k and least * w[1] <= 100 * score]
            if role == 0:
                windows.append([ident, score, 0])
                continue
            for w in windows:
                if 100 * score <= most * w[1]:
                    w[2] += 1
                    yield (anchor_id, w[0], w[2], ident, w[1], score)

    return run


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products of floor(scale * x). An anchor's positives are the
    first rows of its label with another id, by descending score, then id. For each
    positive, the first rows of other labels whose score is at least `least` and at most
    `most` percent of the positive's (most is 100 or less). Fewer rows: all of them. A positive of a
    negative score has no negatives. Rows without id or label, or whose vector is null or
    holds null or non-finite components, take no part; vectors of other lengths than an
    anchor's are not compared with it. Rows that repeat id, label and vector count once;
    rows that repeat an id only are rows of their own, and anchors of their own. Scores
    of 2**56 or more raise OverflowError. An empty table gives an empty result; other
    columns are ignored whatever their names.
    """
    if most > 100:
        raise ValueError("a window above its positive would be open before it is met")
    spark = vectors.sparkSession
    data, asked = (usable(x, id_col, vector_col, label_col) for x in (vectors, anchors))
    size = {r.side: r.n for r in data.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("v")).unionByName(asked.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("a"))).collect()}
    v_blocks, a_blocks = -(-size["v"] // VECTOR_BLOCK) or 1, -(-size["a"] // ANCHOR_BLOCK) or 1
    # by id and vector: an id that many rows repeat fills no block
    block = lambda n: F.pmod(F.xxhash64("id", "key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = ["ab", "vb", "dim"]
    left = asked.select("id", "key", "label", "v", "dim", block(a_blocks).alias("ab")).withColumn("vb", every(v_blocks))
    right = data.select("id", "label", "v", "dim", block(v_blocks).alias("vb")).withColumn("ab", every(a_blocks)).groupBy(*tile)

    best = left.groupBy(*tile).cogroup(right).applyInArrow(_tile(scale, _own_label(positives)), FOUND)
    order = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "id")
    # a positive below 0 has no negatives
    opened = checkpointed(best.withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= positives) & (F.col("score") >= 0)).drop("nth"))
    windows = opened.groupBy("anchor_id", "anchor_key").agg(F.collect_set("score").alias("windows"))
    left = left.join(windows.select(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key"), "windows"), ["id", "key"])
    found = left.groupBy(*tile).cogroup(right).applyInArrow(_tile(scale, _in_windows(negatives, least, most)), FOUND)

    stream = opened.withColumn("role", F.lit(0)).unionByName(found.withColumn("role", F.lit(1)))
    keys = stream.select("anchor_id", "anchor_key", (-F.col("score")).alias("fallen"), "role", "id").rdd.map(lambda r: (tuple(r), None))
    dealt = keys.repartitionAndSortWithinPartitions(shuffle_partitions(spark), lambda key: portable_hash(key[:2]))
    return spark.createDataFrame(dealt.mapPartitions(streamed(negatives, least, most)), SCHEMA, verifySchema=False)


def op11(spark, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.a, p.c AS positive, p.score AS ps, s.c AS negative, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, positive AS positive_id, r::INTEGER AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5
"""
