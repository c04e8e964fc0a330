"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Seconds between two looks at what the driver needs no more.
EVERY_S = 5.0
_looked = 0.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns of `docs` as the struct __row, beside the given keys, so that no name can clash; select("__row.*") undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[c.alias(k) for k, c in keys.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint.

    The folder is the one the cluster names in spark.checkpoint.dir. Where that is
    unset, a temporary folder is taken in local mode, as in tests; on a cluster it would
    be lost with its machine, so that is an error.

    Spark's cleaner removes shuffle files, and checkpoints if
    spark.cleaner.referenceTracking.cleanCheckpoints is set, when the driver has collected
    what referred to them; a driver with memory to spare would let the executors' disks fill
    before. So it is asked to collect every few seconds: only what nothing can read again goes.
    """
    global _looked
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    out = df.checkpoint()
    if time.monotonic() - _looked > EVERY_S:
        gc.collect()
        sc._jvm.System.gc()
        _looked = time.monotonic()
    return out


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """`df` with `number`: the place of each row in the given order, from 0; no task sees more than its range."""
    n = shuffle_partitions(df.sparkSession)
    nth = F.monotonically_increasing_id()
    part = F.shiftright(nth, 33)
    placed = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", part.alias("__part"), (nth - F.shiftleft(part, 33)).alias("__nth")))
    # a row for each partition, so one task orders them and all get them
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = placed.groupBy("__part").count().select("__part", before.alias("__before"))
    return placed.join(F.broadcast(first), "__part").withColumn("number", (F.col("__before") + F.col("__nth")).cast("long")).drop("__part", "__nth", "__before")
