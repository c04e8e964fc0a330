"""Appends that happen exactly once: a folder for each batch, and a numbered record that makes it count.

A batch is written to a folder of its own first, by one run of its plan, which also counts
its rows. Then a record with the next number names the folder. Readers read the folders
that records name and nothing else, so a crash before the record leaves no trace in what
is read, and a batch whose record stands is not written again. A number can be taken
once: if another writer was faster, the batch is compared with what came in between
and the next number tried.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import exists


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def records(spark: SparkSession, path: str) -> list[dict]:
    """The records of a sink in order: number, batch, folder, rows. One for each batch."""
    fs, folder = _fs(spark, f"{path}/_commits")
    if not fs.exists(folder):
        return []
    found = [json.loads(r.value) for r in spark.read.text(f"{path}/_commits/*.json").collect()]
    return sorted(found, key=lambda r: r["number"])


def _record(spark: SparkSession, path: str, number: int, **about) -> bool:
    """Takes a number; False if it is taken. The record is written aside and renamed, so it is whole or not there."""
    fs, target = _fs(spark, f"{path}/_commits/{number:09d}.json")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_aside/{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps({"number": number, **about}).encode()))
    out.close()
    fs.mkdirs(target.getParent())
    taken = fs.exists(target) or not fs.rename(aside, target)
    if taken:
        fs.delete(aside, False)
    return not taken


def committed(spark: SparkSession, path: str, schema: T.StructType | str, since: int = 0) -> DataFrame:
    """The rows of all batches whose record stands, from a number on."""
    folders = [f"{path}/{r['folder']}" for r in records(spark, path) if r["number"] >= since and r["rows"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append_batch(df: DataFrame, path: str, key: str, batch: str) -> int:
    """Appends the rows of a batch whose key the sink does not hold yet, and says how many the batch has added.

    Of rows with one key one is taken; rows without key are not. A batch that was appended already
    adds nothing and is not computed.
    """
    spark = df.sparkSession
    done = records(spark, path)
    for r in done:
        if r["batch"] == batch:
            return r["rows"]
    seen = done[-1]["number"] + 1 if done else 0
    known = committed(spark, path, df.schema).select(key)
    new = df.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known, key, "left_anti").select(*df.columns)
    folder, rows = _written(new, path)
    while not _record(spark, path, seen, batch=batch, folder=folder, rows=rows):
        later = [r for r in records(spark, path) if r["number"] >= seen]
        for r in later:
            if r["batch"] == batch:
                return r["rows"]
        # only what came in between can clash with what is written; the plan is not run again
        own = spark.read.schema(df.schema).parquet(f"{path}/{folder}") if rows else spark.createDataFrame([], df.schema)
        folder, rows = _written(own.join(committed(spark, path, df.schema, seen).select(key), key, "left_anti").select(*df.columns), path)
        seen = later[-1]["number"] + 1
    return rows


def _written(df: DataFrame, path: str) -> tuple[str, int]:
    folder, told = f"data/{uuid.uuid4().hex}", Observation()
    df.observe(told, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{folder}")
    return folder, told.get["rows"]


def unused(spark: SparkSession, path: str) -> list[str]:
    """Folders that no record names: what crashed or lost a race has left. Safe to delete while nobody appends."""
    if not exists(spark, f"{path}/data"):
        return []
    fs, folder = _fs(spark, f"{path}/data")
    named = {r["folder"] for r in records(spark, path)}
    return sorted(f for f in (f"data/{s.getPath().getName()}" for s in fs.listStatus(folder)) if f not in named)
