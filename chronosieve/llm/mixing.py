"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a target in words; the ratio target / source size is the number
of copies, between 0 and 2, that each of its documents should have on average.
Its whole part is certain. Its fraction p is rounded by the pivotal method:
two undecided documents meet, and mass (words times probability) moves from one
to the other, in a direction drawn so that each one's expectation is unchanged,
until one of them is at 0 or 1. What the mix takes from the pair, in words, does
not change at all.

The meetings form a reduction tree. Documents of a source are put into classes
by size (powers of two) and blocks of about BLOCK by a hash of id and text; a block
leaves one undecided document, and blocks meet FAN at a time, in as many levels as
the largest class needs, until the root of the source. The first block of every
class skips the lower levels: at the root, residuals and reserved documents meet
from the largest to the smallest, so that large residuals are settled against
smaller documents and what is left at the very end is one small document. It goes
to the nearer side: at most half of it is the only deviation of the source from
its target. Every level is checkpointed, so plans stay as small as one level.

Draws come from a hash of ids and texts, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, load, numbered, packed

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, SEED = 1.5, 2.0, 20
BLOCK, FAN_BITS, SALTS = 64, 8, 32
#: Blocks of a class that the root of a source takes at most.
ROOT_BLOCKS = 4
#: Below this distance from a whole number a ratio counts as that number.
NEAR = 1e-12


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: (source, source_size) -> the same and target.

    Sources sorted by code point, null last, weigh `weights` in turn and divide
    share * all words among them; nobody gets more than cap times its size, the
    excess goes to the others by weight. This is water-filling: the level rises
    until no further source is full; each step is one aggregate over the sources.
    """
    nth = numbered(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    size = F.col("source_size").cast("double")
    levels = nth.select("source", "source_size", weight.alias("__w"), (F.lit(cap) * size).alias("__most"))
    total = levels.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        is_full = F.col("__most") <= F.lit(level) * F.col("__w")
        n, taken, open_ = levels.agg(F.count(F.when(is_full, 1)), F.sum(F.when(is_full, F.col("__most"))), F.sum(F.when(~is_full, F.col("__w")))).first()
        if n == full or not open_:
            break
        full, level = n, (share * total - (taken or 0.0)) / open_
    return levels.select("source", "source_size", F.least("__most", F.lit(level) * F.col("__w")).alias("target") if open_ else F.col("__most").alias("target"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _item(x: Column) -> Column:
    return F.struct(*[x[k].alias(k) for k in ("id", "key", "size", "p", "u")])


def _meet(acc: Column, x: Column) -> Column:
    """One pivot: acc.c is the undecided document so far, x the next one; acc.done the decided ones."""
    c = acc["c"]
    up = F.least(c["size"] * (1 - c["p"]), x["size"] * x["p"])  # words that can move from x to c
    down = F.least(c["size"] * c["p"], x["size"] * (1 - x["p"]))

    def moved(m: Column) -> Column:
        rises = x["u"] < F.coalesce(F.try_divide(m["down"], m["up"] + m["down"]), F.lit(1.0))
        stays = F.when(rises, x["size"] * x["p"] <= c["size"] * (1 - c["p"])).otherwise(x["size"] * (1 - x["p"]) < c["size"] * c["p"])
        return F.struct(rises.alias("rises"), stays.alias("stays"), F.when(rises, m["up"]).otherwise(-m["down"]).alias("words"))

    def result(m: Column) -> Column:
        left = F.when(m["stays"], c["p"] + m["words"] / c["size"]).otherwise(x["p"] - m["words"] / x["size"])
        undecided = F.when(m["stays"], _item(c)).otherwise(_item(x))
        decided = F.when(m["stays"], _item(x)).otherwise(_item(c))
        taken = (m["rises"] != m["stays"]).cast("int")
        return F.struct(undecided.withField("p", F.least(F.greatest(left, F.lit(0.0)), F.lit(1.0))).alias("c"), F.concat(acc["done"], F.array(decided.dropFields("p", "u").withField("x", taken))).alias("done"))

    return _let(F.struct(up.alias("up"), down.alias("down")), lambda m: _let(moved(m), result))


def _round(items: DataFrame, key: list[str]) -> DataFrame:
    """One level of the tree: the items of each key meet from the largest to the smallest."""
    listed = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "id", "key", "size", "p", "u"))).alias("l"))
    start = F.struct(_item(F.col("l")[0]).alias("c"), F.array().cast("array<struct<id:bigint,key:bigint,size:double,x:int>>").alias("done"))
    return checkpointed(listed.select(*key, F.aggregate(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), start, lambda acc, x: _meet(acc, x)).alias("r")))


def _draw(seed: int, *of: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) / float(1 << 40)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """mix with one more column, key: a hash of the text."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(source_col).cast("string").alias("source"), words.alias("size"))
    # one pass over the texts; what the levels read from here on is a few bytes a document
    sized = checkpointed(sized).withColumn("class", F.ceil(F.log2(F.col("size") + 1)).cast("int"))
    classes = checkpointed(sized.groupBy("source", "class").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__size")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, share, cap)
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    plan = checkpointed(
        classes.alias("a").join(targets.alias("b"), same)
        .select("a.source", "a.class", "source_size", "target", ratio.alias("__r"), F.ceil(F.col("__n") / BLOCK).cast("long").alias("__blocks"))
        .withColumn("__base", F.floor(F.col("__r") + NEAR).cast("int"))
        .withColumn("__p", F.when(F.col("__r") - F.col("__base") > NEAR, F.col("__r") - F.col("__base")).otherwise(0.0))
    )
    most = plan.agg(F.max("__blocks")).first()[0] or 0
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.class") == F.col("p.class")) & (F.col("d.__salt") == F.col("p.__salt"))
    ready = checkpointed(
        sized.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "key")).withColumn("__salt", F.pmod("__h", F.lit(SALTS)).cast("int")).alias("d")
        .join(salted.alias("p"), on)
        .select("doc_id", "key", "d.source", "size", "d.class", "__h", "source_size", "target", "__base", "__p", "__blocks")
    )
    out = lambda df, x: df.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("__base") + x)).cast("long").alias("taken"), (F.col("__base") + x).cast("int").alias("copies"), "source", "key")
    certain = out(ready.where("size = 0 or __p = 0").withColumn("__base", F.when(F.col("size") > 0, F.col("__base")).otherwise(0)), F.lit(0))

    shared = ["source", "source_size", "target", "__base"]
    items = ready.where("size > 0 and __p > 0").select(*shared, "class", F.pmod(F.shiftrightunsigned("__h", 8), F.col("__blocks")).alias("block"), F.col("doc_id").alias("id"), "key", F.col("size").cast("double").alias("size"), F.col("__p").alias("p"), _draw(seed + 1, "__h").alias("u"))
    decided, reserved, rest, level = [], items.where("block = 0"), items.where("block > 0"), 0
    while most > 1:
        settled = _round(rest, [*shared, "class", "block"])
        decided.append(settled.select(*shared, F.explode("r.done").alias("x")))
        rest = settled.select(*shared, "class", F.shiftright("block", FAN_BITS).alias("block"), "r.c.*").withColumn("u", _draw(seed + 2 + level, "id", "key", "size", "u"))
        if most <= ROOT_BLOCKS:
            break
        most, level = (most >> FAN_BITS) + 1, level + 1
    root = _round(reserved.unionByName(rest).drop("class", "block"), shared)
    # the one document left of a source goes to the nearer side
    last = F.col("r.c").dropFields("p", "u").withField("x", (F.col("r.c.p") >= 0.5).cast("int"))
    last_one = root.select(*shared, F.explode(F.concat("r.done", F.array(last))).alias("x"))
    for more in decided:
        last_one = last_one.unionByName(more)
    return certain.unionByName(out(last_one.select(F.col("x.id").alias("doc_id"), F.col("x.key").alias("key"), F.col("x.size").cast("long").alias("size"), *shared, F.col("x.x").alias("__x")), F.col("__x")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """How often the mix takes each document.

    Returns a row for every row of `docs`: doc_id, size, source_size, target,
    taken, copies, source. A null text has size 0. A null source is a source of its own,
    the last. Documents without words are taken 0 times. Rows that repeat an
    id are documents of their own, and so are rows without id. An empty table gives an empty result; other columns are ignored.
    """
    return decisions(docs, **options).drop("key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it: as many rows as `mix` has copies.

    Rows that repeat id, source and text share what the mix takes of them all, evenly,
    so repeated rows, rows without id and rows of one id with different texts all
    meet the targets. An empty table gives an empty result.
    """
    keys = ["__id", "__source", "__key"]
    null_safe = lambda c: F.struct(F.col(c))  # noqa: E731  a struct that holds a null is not null, and joins by equality
    copies = decisions(docs, **options).select(null_safe("doc_id").alias("__id"), null_safe("source").alias("__source"), F.col("key").alias("__key"), "copies")
    copies = copies.groupBy(*keys).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).where("__copies > 0")
    full = packed(docs, __id=F.struct(F.col("doc_id").cast("long").alias("doc_id")), __source=F.struct(F.col("source").cast("string").alias("source")), __key=F.xxhash64("text"))
    joined = full.join(copies, keys).withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    own = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__nth") <= F.pmod("__copies", F.col("__rows"))).cast("int")
    return joined.withColumn("__own", own.cast("int")).where("__own > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__own")))).select("__row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))
