"""Sharding by balanced label propagation, in DataFrame operations.

Documents with equal texts are linked, through their text, so a text of n copies
costs n rows and not n * n edges. Every document starts in the shard that a hash
names. In each round every text looks for the open shard that already holds most
of its copies, and its smaller parts ask to move there; a shard takes what its
quota leaves, the last part in pieces if need be. Unlinked documents do not care
where they are: after the rounds they, and only as a last resort linked ones,
move from shards over their share to shards under it, so that counts are at most
one apart (law `rows`).

Ranks within a shard are taken in two steps, within buckets of a hash and over
the buckets' counts, so no task orders a whole shard.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, load, shuffle_partitions

SHARDS = 24
#: Buckets of the documents of one text in a shard.
SPREAD = 16


def running(df: DataFrame, keys: list[str], bucket: Column, order: list, value: str | None, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` (None: number of rows) over the rows of the same keys that come before by (bucket, order)."""
    v = F.col(value) if value else F.lit(1)
    df = df.withColumn("__bucket", bucket)
    sums = df.groupBy(*keys, "__bucket").agg(F.sum(v).alias("__sum"))
    over = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__bucket", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__own", F.coalesce(F.sum(v).over(own), F.lit(0))).join(sums, [*keys, "__bucket"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__bucket")


def propagated(linked: DataFrame, shards: int, capacity: int, buckets: int, rounds: int | None = None) -> DataFrame:
    """linked: rows with g (their text), h (a hash of the row) and label -> the same with labels moved.

    Rounds run until no part asks or has room (`rounds`: so many at most). Rows only
    move to a part that is larger, or as large and later in order, so each round adds
    to the squares of the parts' sizes, and the rounds end.
    """
    state = checkpointed(linked)
    for _ in itertools.count() if rounds is None else range(rounds):
        parts = state.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("order", F.xxhash64("g", "label"))
        load_ = {r.label: r.n for r in parts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        room = {s: capacity - load_.get(s, 0) for s in range(shards) if load_.get(s, 0) < capacity}
        if not room or not load_:
            break
        left = F.create_map(*[F.lit(x) for pair in room.items() for x in pair])
        best = parts.where(F.col("label").isin(list(room))).groupBy("g").agg(F.max(F.struct("n", "order", "label")).alias("to"))
        asks = parts.join(best, "g").where((F.col("label") != F.col("to.label")) & (F.struct("n", "order") < F.struct("to.n", "to.order"))).select("g", "label", "n", F.col("to.label").alias("to"))
        asks = running(asks, ["to"], F.pmod(F.xxhash64("g"), F.lit(buckets)), ["g", "label"], "n", "before")
        asks = asks.withColumn("take", F.least("n", F.element_at(left, F.col("to")) - F.col("before"))).where("take > 0").drop("before")
        asks = checkpointed(asks)
        if asks.isEmpty():
            break
        moved = state.join(asks, ["g", "label"], "left")
        whole = moved.where("take is null or take = n").withColumn("label", F.coalesce("to", "label"))
        some = running(moved.where("take < n"), ["g", "label"], F.pmod("h", F.lit(buckets)), ["h", "doc_id"], None, "before")
        some = some.withColumn("label", F.when(F.col("before") < F.col("take"), F.col("to")).otherwise(F.col("label")))
        state = checkpointed(whole.select(*linked.columns).unionByName(some.select(*linked.columns)))
    return state


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each document goes.

    Returns a row for every row of `docs`: doc_id, size (UTF-8 bytes of the text
    plus 8), text_crc32, law (`rows`), shard, slot (gapless from 0 in each shard),
    grown_shard (null, as the law is not `key`). A null text has no bytes and
    counts as equal to the empty text. Rows that repeat an id or have none are
    documents of their own. With fewer documents than shards some shards stay
    empty; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("g"))
    base = checkpointed(base.withColumn("h", F.xxhash64("doc_id", "g")))
    # written first, so that the joins below are plain ones, whose hot keys adaptive execution splits
    groups = checkpointed(base.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, min(4096, shuffle_partitions(spark)))
    start = F.pmod("h", F.lit(shards)).cast("int").alias("label")
    many = groups.where("n > 1").select("g")
    linked = base.join(many, "g", "left_semi").select("*", start)
    alone = base.join(many, "g", "left_anti").select("*", start)
    linked = propagated(linked, shards, total // shards, buckets, rounds)
    placed = checkpointed(linked.withColumn("alone", F.lit(0)).unionByName(alone.withColumn("alone", F.lit(1))))

    # linked documents come first in their shard, so that those over its share are others
    counts = {(r.label, r.alone): r.n for r in placed.groupBy("label", "alone").agg(F.count(F.lit(1)).alias("n")).collect()}
    have = [counts.get((s, 0), 0) + counts.get((s, 1), 0) for s in range(shards)]
    richest = sorted(range(shards), key=lambda s: (-have[s], s))
    share = [total // shards] * shards
    for s in richest[: total % shards]:
        share[s] += 1
    # a text's documents lie in SPREAD buckets, so that a hot text is not one task's to order
    of_text = F.pmod(F.xxhash64("g"), F.lit(buckets)) * SPREAD + F.pmod(F.shiftrightunsigned("h", 20), F.lit(SPREAD))
    near = F.when(F.col("alone") == 0, of_text).otherwise(F.pmod(F.col("h"), F.lit(buckets)))
    ranked = running(placed, ["label", "alone"], near, ["g", "h", "doc_id"], None, "place")
    first_alone = F.element_at(F.array(*[F.lit(counts.get((s, 0), 0)) for s in range(shards)]), F.col("label") + 1)
    place = F.col("place") + F.when(F.col("alone") == 1, first_alone).otherwise(0)
    over, at = [], 0
    for s in range(shards):
        over.append(at)  # number of the first document over the share of s, among all such
        at += max(0, have[s] - share[s])
    number = place - F.element_at(F.array(*map(F.lit, share)), F.col("label") + 1) + F.element_at(F.array(*map(F.lit, over)), F.col("label") + 1)
    target, at = F.lit(None).cast("int"), 0
    for s in range(shards):
        if have[s] < share[s]:
            at += share[s] - have[s]
            target = F.coalesce(target, F.when(F.col("number") < at, F.lit(s)))
    stays = place < F.element_at(F.array(*map(F.lit, share)), F.col("label") + 1)
    final = ranked.withColumn("stays", stays).withColumn("number", number).withColumn("shard", F.when(F.col("stays"), F.col("label")).otherwise(target))
    final = checkpointed(final.select("doc_id", "size", "text_crc32", "g", "h", "shard"))
    slots = running(final, ["shard"], F.pmod("h", F.lit(buckets)), ["h", "doc_id", "g"], None, "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5(spark, sf_dir: str) -> DataFrame:
    return sharded(load(spark, sf_dir, "documents"))
