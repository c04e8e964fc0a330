"""Near-duplicate documents by MinHash bands and odd sketches.

A document is the set of its distinct word n-grams; equal sets are one from the start.
SAMPLES min-hashes of a set serve twice:

- ROWS of them at a time form a band; sets that agree in a whole band share a bucket.
  At the threshold of 0.8 a pair shares no bucket with a probability of 5e-8.
- All of them are folded into an odd sketch: a bitmap in which each sample flips one bit,
  so that samples that agree cancel out. The number of ones in the XOR of two sketches
  estimates how many samples differ, most precisely at high similarities, and so which
  pairs of a bucket can be links. What it lets pass is confirmed on the full sets.

A large group of near copies must not cost its pairs. So links are sought in this order:

1. Leaders. In each bucket the set leads whose buckets are the fullest, as it is likely in the
   middle of its group; of the leaders of its buckets, each set is confirmed against the
   one whose sketch is nearest. Linked parts are found, and each set asks the nearest
   leader of another part, as long as that joins many. These rounds are linear, and
   nothing is decided against a set in them.
2. The rest. Sets of buckets that still hold several parts are put into blocks, and these into
   groups, bounded by sets and by tokens. Of two blocks that meet in a bucket the smaller one asks:
   its sketches are held against all of the other, but not within a part. A set whose
   sketch passes against some set of a group is confirmed against that group.
3. Components of all links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats, vectors as V
from .common import checkpointed, load, shuffle_partitions
from .ngram_join import CAP, Sets, compared, components

SHINGLE, PERCENT = 4, 80
#: Min-hashes of a set, and how many of them a band has.
SAMPLES, ROWS = 128, 4
#: Bits of an odd sketch, in words of 64.
WORDS = 16
BITS = 64 * WORDS
#: Sets of a block, about (some 700 KB), and tokens of a group's sets; CAP is the number of its sets.
BLOCK, TOKENS = 4096, 1 << 20
#: Leaders are asked again as long as a round leaves at most this share of the places in mixed buckets.
FEWER = 0.5
#: Standard deviations of the estimate by which a link may look less similar than it is.
SIGMAS = 6


def similarity(ones: int) -> float:
    """What the number of ones in the XOR of two sketches says about their sets: 1 at none, exact but for samples that share a bit."""
    flips = math.log1p(-min(2 * ones, BITS - 1) / BITS) / math.log1p(-2 / BITS)
    return 1 - flips / (2 * SAMPLES)


def most_ones(percent: int) -> int:
    """The largest number of ones in the XOR of two sketches at which sets may still link, SIGMAS below the estimate."""
    t = percent / 100
    differ = SAMPLES * min(1.0, 1 - t + SIGMAS * math.sqrt(t * (1 - t) / SAMPLES))
    # a sample that differs flips a bit in each of the sketches, and flips can only cancel out
    return min(BITS, math.ceil(2 * differ))


def sketched(tokens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set that is not empty: identity (two 64-bit words), band keys, odd sketch."""
    starts = places[:-1][np.diff(places) > 0]
    draw = np.random.default_rng(40127).integers(0, 1 << 63, (2, SAMPLES), np.uint64) * np.uint64(2) + np.uint64(1)
    node = np.stack([np.add.reduceat(V.mixed(tokens + np.uint64(c)), starts) for c in (3, 5)], 1)
    least = np.empty((len(starts), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        h = tokens * draw[0, k]
        h ^= h >> np.uint64(29)
        h *= draw[1, k]
        least[:, k] = np.minimum.reduceat(h, starts)
    marked = V.mixed(least + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bands = V.mixed(marked.reshape(len(starts), -1, ROWS).sum(axis=2, dtype=np.uint64))
    bit = (marked >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64) + np.arange(len(starts))[:, None] * BITS
    odd = np.bincount(bit.ravel(), minlength=len(starts) * BITS).astype(np.uint8) & 1
    return node, bands, np.packbits(odd, bitorder="little").view(np.int64).reshape(len(starts), WORDS)


def _sketches(sets: Sets):
    bands = SAMPLES // ROWS
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def lists(values: np.ndarray, full: np.ndarray, width: int) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(full)]).astype(np.int32) * width
        return pa.ListArray.from_arrays(ends, pa.array(values.ravel()))

    def run(batches):
        for batch in batches:
            for row, tokens, places in sets.of(*V.texts(batch)):
                n = np.diff(places)
                full = n > 0
                ids = [None] * len(n)
                keys, odd = np.zeros((0, bands), np.int64), np.zeros((0, WORDS), np.int64)
                if full.any():
                    node, keys, odd = sketched(tokens, places)
                    for k, x in zip(np.flatnonzero(full).tolist(), node, strict=True):
                        ids[k] = x.tobytes()
                some = slice(row, row + len(n))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[some], batch.column("text_key")[some], pa.array(n), pa.array(ids, pa.binary()), lists(keys.view(np.int64), full, bands), lists(odd, full, WORDS)], schema=schema)

    return run


def ones(a: str, b: str) -> Column:
    """Ones in the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def fits(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def leaders(keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """keys: node, part, rank, key; sets: node, n, odd, rep -> node, part, rep, lead, lead_part, lead_rep: for each set the leader of another part that its sketch is nearest to.

    In a bucket the highest rank leads its own part's sets no further than to the highest rank
    of another part, so each set has a leader that is not of its own part.
    """
    best = F.max(F.struct("rank", "node", "part"))
    of_parts = keys.groupBy("key", "part").agg(F.max(F.struct("rank", "node")).alias("top")).select("key", "part", "top.rank", "top.node")
    one = of_parts.groupBy("key").agg(best.alias("one"))
    two = of_parts.join(one, "key").where(F.col("part") != F.col("one.part")).groupBy("key").agg(F.first("one").alias("one"), best.alias("two"))
    two = checkpointed(two)
    lead = F.when(F.col("part") == F.col("one.part"), F.col("two")).otherwise(F.col("one"))
    pairs = keys.join(two, "key").select("node", "part", lead.alias("lead")).select("node", "part", F.col("lead.node").alias("lead"), F.col("lead.part").alias("lead_part")).distinct()
    own = sets.select("node", "n", "odd", "rep")
    theirs = sets.select(F.col("node").alias("lead"), F.col("n").alias("m"), F.col("odd").alias("lead_odd"), F.col("rep").alias("lead_rep"))
    both = pairs.join(own, "node").join(theirs, "lead").where(fits("n", "m", percent)).withColumn("ones", ones("odd", "lead_odd"))
    both = both.where(F.col("ones") <= most_ones(percent))
    near = F.min(F.struct("ones", "lead", "lead_part", "lead_rep")).alias("best")
    return both.groupBy("node", "part").agg(F.first("rep").alias("rep"), near).select("node", "part", "rep", "best.lead", "best.lead_part", "best.lead_rep")


def in_parts(keys: DataFrame, links: DataFrame) -> DataFrame:
    """keys: node, rank, key, part -> the same with parts joined by links (u, v) between parts; only buckets that hold several parts."""
    whole = components(links).select(F.col("node").alias("part"), F.col("root").alias("__whole"))
    keys = keys.join(whole, "part", "left").select("node", "rank", "key", F.coalesce("__whole", "part").alias("part"))
    mixed = keys.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a != b").select("key")
    return checkpointed(keys.join(mixed, "key", "left_semi"))


def _tiles(percent: int):
    """Sorted by tile, members first: which askers' sketches pass against which groups of members of larger parts. A tile is an asked block and sets that ask it."""
    limit = most_ones(percent)
    schema = pa.schema([("node", pa.binary()), ("home", pa.int64())])

    def asking(members, rows):
        odd, n, size, part, home = (np.concatenate(x) for x in zip(*members, strict=True))
        names, group = np.unique(home, return_inverse=True)
        for at in range(0, len(rows[0]), 16):
            o, m, z, p, inner = (x[at : at + 16, None] for x in rows)
            near = np.bitwise_count(o ^ odd[None, :, :]).sum(axis=2, dtype=np.int64) <= limit
            near &= (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (p != part)
            # within a block both sides are the same sets, so the one of the smaller part asks
            near &= ~inner | (z < size) | ((z == size) & (p < part))
            i, j = np.nonzero(near)
            found = np.unique(i * len(names) + group[j])
            yield at + found // len(names), names[found % len(names)]

    def run(batches):
        tile, members = None, []
        for batch in batches:
            tiles, role, n, size, part, home, inner = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "role", "n", "size", "part_key", "home", "inner"))
            # unsigned, as the ones of negative numbers are not their bits to numpy
            odd = batch.column("odd").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tiles)], strict=True):
                if a == b:
                    continue
                if tiles[a] != tile:
                    tile, members = tiles[a], []
                if role[a] == 0:
                    members.append((odd[a:b], n[a:b], size[a:b], part[a:b], home[a:b]))
                elif members:
                    for who, asked in asking(members, (odd[a:b], n[a:b], size[a:b], part[a:b], inner[a:b])):
                        if len(who):
                            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(a + who)), pa.array(asked)], schema=schema)

    return run


def rest(keys: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """keys: node, part, rank, key of buckets that hold several parts; sets: node, n, odd, rep -> (members, asking) for `compared`: gid, node, rep.

    Sets belong together if the highest rank that they meet in their buckets is the same one.
    What belongs together is cut into blocks by sets, and into groups by sets and by tokens.
    Of two blocks that meet in any bucket the smaller one asks, and all that ask a block share
    its tiles; so small blocks beside a large one cost their own size.
    """
    spark = keys.sparkSession
    top = keys.groupBy("key").agg(F.max(F.struct("rank", "node")).alias("top"))
    own = keys.join(top, "key").groupBy("node").agg(F.first("part").alias("part"), F.xxhash64(F.max("top")["node"]).alias("base"))
    own = checkpointed(own.join(sets, "node").select("node", "part", "base", "n", "odd", "rep"))
    size = own.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    cuts = own.groupBy("base").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CAP, F.sum("n") / TOKENS)).alias("groups"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    piece = lambda n: F.xxhash64("base", F.pmod(F.xxhash64("node"), F.col(n)), F.lit(n))
    own = own.join(size, "part").join(cuts, "base").withColumns({"home": piece("groups"), "block": piece("blocks")})
    homes = checkpointed(own.select("node", "n", "odd", "rep", "size", F.xxhash64("part").alias("part_key"), "home", "block"))
    order = F.struct("size", "part_key")
    cells = checkpointed(keys.select("node", "key").join(homes.select("node", "block", order.alias("order")), "node").groupBy("key", "block").agg(F.min("order").alias("low"), F.max("order").alias("top")))
    # of two blocks that meet the smaller one asks; blocks of one and the same part do not
    held = checkpointed(homes.groupBy("block").agg(F.count(F.lit(1)).alias("held")))
    cells = cells.join(held, "block").withColumn("by", F.struct("held", "block"))
    met = cells.alias("a").join(cells.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.by") <= F.col("b.by")) & ((F.col("a.low") != F.col("b.top")) | (F.col("a.top") != F.col("b.low"))))
    met = checkpointed(met.select(F.col("a.block").alias("block"), F.col("a.held").alias("held"), F.col("b.block").alias("asked")).distinct())
    # all that ask a block share its tiles, so it is sent once for each BLOCK of them
    tiles = checkpointed(met.groupBy("asked").agg(F.ceil(F.sum("held") / BLOCK).cast("int").alias("tiles")))
    columns = ["tile", "role", "node", "n", "size", "part_key", "home", "odd", "inner"]
    tile = lambda k: F.xxhash64("asked", k).alias("tile")
    asked = tiles.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(tile(F.col("k")), F.lit(0).alias("role"), F.lit(False).alias("inner"), F.col("asked").alias("block")).join(homes, "block")
    asks = met.join(tiles, "asked").join(homes, "block").select("*", tile(F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")), F.lit(1).alias("role"), (F.col("block") == F.col("asked")).alias("inner"))
    sent = asked.select(columns).unionByName(asks.select(columns))
    sent = sent.repartition(shuffle_partitions(spark), "tile").sortWithinPartitions("tile", "role")
    asking = checkpointed(sent.mapInArrow(_tiles(percent), "node binary, home long"))
    members = homes.join(asking.select("home").distinct(), "home", "left_semi").select(F.col("home").alias("gid"), "node", "rep")
    return members, asking.select("node", F.col("home").alias("gid")).join(homes.select("node", "rep"), "node").select("gid", "node", "rep")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are compared with A-Z lower-cased; a text of fewer words than `shingle` is one
    token of all its words; a null text or one without words has no set, is linked with
    nothing, is its own component and is kept. Null ids take part in links but are never
    a component's id unless it has no other; then all its rows count as kept. Repeated
    rows have equal sets and so are linked; those with the smallest id are all marked
    as kept. Very long texts are read in pieces. An empty table gives an empty result;
    other columns are ignored whatever their names.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    sketch = checkpointed(rows.mapInArrow(_sketches(Sets(shingle, percent)), "doc_id long, text_key long, n long, node binary, bands array<long>, odd array<long>"))
    sets = sketch.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("bands").alias("bands"))
    sets = checkpointed(sets)
    keys = sets.select("node", F.posexplode("bands").alias("r", "h")).select("node", F.xxhash64("r", "h").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    keys = checkpointed(keys.join(shared, "key"))
    # sets in the fullest buckets are in the middle of their group, and most of it is near them
    rank = keys.groupBy("node").agg(F.sum("sets").alias("rank"))
    keys = checkpointed(keys.join(rank, "node").select("node", "rank", "key", F.col("node").alias("part")))
    left = keys.count()
    links = None
    while left:
        asks = checkpointed(leaders(keys, sets, percent).withColumn("gid", F.xxhash64("lead")))
        led = asks.select("gid", F.col("lead").alias("node"), F.col("lead_rep").alias("rep")).distinct()
        found = checkpointed(compared(rows, led, asks.select("gid", "node", "rep"), shingle, percent))
        links = found if links is None else links.unionByName(found)
        # a set asked once at most, so its link is known by it
        parts = found.join(asks.select(F.col("node").alias("u"), "part", "lead_part"), "u").select(F.col("part").alias("u"), F.col("lead_part").alias("v"))
        keys = in_parts(keys, parts)
        before, left = left, keys.count()
        if left > FEWER * before:
            break
    members, asking = rest(keys, sets, percent)
    members, asking = rest(keys, sets, percent)
    last = compared(rows, members, asking, shingle, percent)
    roots = components(last if links is None else links.unionByName(last))
    own = sets.select("node", "first_id").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id")
    named = own.join(own.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    some = sketch.where("n > 0").select("doc_id", "n", "node").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    both = some.unionByName(sketch.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) c ON c.x = w.doc_id
"""
