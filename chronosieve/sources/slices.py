"""Slices of tables for a pool of keys, laid out so that later queries need no shuffle.

A slice is written in buckets of the key and sorted by it: joins and aggregations on
the key then read both sides as they lie, and a filter on a key reads one bucket's row
groups. The files lie in the folder that all executors share; the catalog knows them by name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

BUCKETS = 32
#: Pools of so many keys at most go to all tasks; larger ones are joined.
SMALL_POOL = 1_000_000


def materialised(tables: dict[str, DataFrame], pool: DataFrame, key: str, buckets: int = BUCKETS, folder: str | None = None) -> dict[str, str]:
    """Writes of each table the rows whose key is in the pool, and gives the name by which `spark.table` reads the slice.

    The pool is read once; its size decides whether the tasks filter while they scan, so
    that only rows of the pool are shuffled, once, into their buckets. Null keys
    are in no pool; rows that repeat stay.
    """
    spark = pool.sparkSession
    run = uuid.uuid4().hex
    folder = folder or f"{shared_folder(spark)}/slices"
    at = f"{folder}/{run}"
    pool.select(key).where(F.col(key).isNotNull()).distinct().write.parquet(f"{at}/pool")
    keys = spark.read.parquet(f"{at}/pool")
    keys = F.broadcast(keys) if keys.count() <= SMALL_POOL else keys
    names = {}
    for name, table in tables.items():
        names[name] = f"slice_{name}_{run}"
        some = table.join(keys, key, "left_semi").repartition(buckets, key)
        some.write.option("path", f"{at}/{name}").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(names[name])
    return names


def of_key(spark: SparkSession, name: str, key: str, value) -> DataFrame:
    """The rows of one key: one bucket is read, and of it the row groups that may hold the key."""
    return spark.table(name).where(F.col(key) == value)


def dropped(spark: SparkSession, names: dict[str, str]) -> None:
    """Forgets the slices; their files stay until the folder is cleared."""
    for name in names.values():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
