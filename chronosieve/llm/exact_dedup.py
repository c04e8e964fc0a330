"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Every row belongs to one of R runs, chosen by a hash of its id, so the copies of
one text spread over R runs however many there are. A run is partitioned by
(digest, run) and sorted; its heads, one row per digest, hold the largest and
smallest id and the number of copies. Runs then merge in rounds: in each round
FAN runs become one, and every merged head keeps the verified identifiers of
what it replaces. A head is verified by more than its SHA-256: heads only merge
if byte length and a second, independent 64-bit hash agree as well.

The root's answer goes back down to the heads of the runs (R rows at most for
each digest) and from there to the rows, which still lie where the runs were
made: the hottest text costs no task more than 1/R of its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, load, packed, shuffle_partitions

KEY = ["__sha", "__bytes", "__check"]
FAN_BITS = 4


def run_bits(partitions: int) -> int:
    """Bits of the run number: at least as many runs as shuffle partitions, in whole rounds, 2**12 at most."""
    bits = FAN_BITS
    while (1 << bits) < partitions and bits < 3 * FAN_BITS:
        bits += FAN_BITS
    return bits


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per document: its id, the digest of its normalised text and its run."""
    bits = bits if bits is not None else run_bits(shuffle_partitions(docs.sparkSession))
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("__text")).select(
        "doc_id",
        F.unhex(F.sha2("__text", 256)).alias("__sha"),
        F.octet_length("__text").alias("__bytes"),
        F.xxhash64("__text").alias("__check"),
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).cast("int").alias("__run"),
    )


def merge_runs(heads: DataFrame, bits: int) -> DataFrame:
    """Rounds of a binomial tree: 2**FAN_BITS runs meet in each, until one is left."""
    while bits > 0:
        step = min(FAN_BITS, bits)
        bits -= step
        heads = (
            heads.withColumn("__run", F.shiftright("__run", step))
            .groupBy(*KEY, "__run")
            .agg(F.max("__largest").alias("__largest"), F.min("__smallest").alias("__smallest"), F.sum("__n").alias("__n"))
        )
    return heads.drop("__run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose texts are equal after lower-casing A-Z.

    Returns a row for every row of `docs`: doc_id, keep_id (largest id of the
    group), group_size, kept, text_sha256, smallest_id. A null text counts as the
    empty text, which is a text like any other. Null ids count in group_size and
    are kept only where the whole group has none. If rows repeat an id within a
    group, one of them is kept. An empty table gives an empty result; other
    columns of `docs` are ignored whatever their names.
    """
    bits = run_bits(shuffle_partitions(docs.sparkSession))
    own = Window.partitionBy(*KEY, "__run")
    # one pass over the texts; the tree reads some 60 bytes a document
    rows = checkpointed(digests(docs, id_col, text_col, bits)).withColumns(
        {
            "__rank": F.row_number().over(own.orderBy(F.col("doc_id").desc_nulls_last())),
            "__n": F.count(F.lit(1)).over(own),
            "__smallest": F.min("doc_id").over(own),
        }
    )
    heads = rows.where("__rank = 1").select(*KEY, "__run", F.col("doc_id").alias("__largest"), "__smallest", "__n")
    root = merge_runs(heads, bits)
    # a group of null ids only would keep a head in every run: ids hash alike, so its rows share one run
    answers = heads.select(*KEY, "__run").join(root, KEY)
    return rows.select("doc_id", *KEY, "__run", "__rank").join(answers, [*KEY, "__run"]).select(
        "doc_id",
        F.col("__largest").alias("keep_id"),
        F.col("__n").cast("long").alias("group_size"),
        ((F.col("__rank") == 1) & F.col("doc_id").eqNullSafe(F.col("__largest"))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
        F.col("__smallest").alias("smallest_id"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see exact_groups. Rows that repeat id and text are one document."""
    ident = F.col("doc_id")
    keys = {"__id": F.coalesce(ident, F.lit(0)), "__no_id": ident.isNull()}
    kept = exact_groups(docs).where("kept").select(*[c.alias(k) for k, c in keys.items()], F.unhex("text_sha256").alias("__sha"))
    full = packed(docs, **keys, __sha=F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)))
    one = Window.partitionBy("__id", "__no_id", "__sha").orderBy(F.lit(1))
    stay = full.join(kept, ["__id", "__no_id", "__sha"], "left_semi")
    return stay.withColumn("__one", F.row_number().over(one)).where("__one = 1").select("__row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256, min(doc_id) OVER w AS smallest_id
FROM d WINDOW w AS (PARTITION BY t)
"""
