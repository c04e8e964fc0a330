"""Reading and writing: scans with declared schemas, records, resumable appends, manifests.

Paths go to Spark's readers and writers only, so any store that Spark knows works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_csv(spark: SparkSession, base: str, schema: T.StructType | str, columns: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """base.csv.gz, or else base.csv, with a header and a declared schema; a gzip file is one task's work, so it is dealt out after."""
    packed = exists(spark, f"{base}.csv.gz")
    if not packed and not exists(spark, f"{base}.csv"):
        raise FileNotFoundError(f"neither {base}.csv.gz nor {base}.csv")
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(f"{base}.csv.gz" if packed else f"{base}.csv")
    df = df.select(*columns) if columns else df
    return df.repartition(partitions) if packed and partitions else df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record a line; broken lines become rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType | str, items: str) -> DataFrame:
    """The elements of an array field of whole-file JSON documents, with the file they came from. Files that cannot be read are skipped."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(path)
    return df.select(F.explode(items).alias("item"), F.col("_metadata.file_name").alias("file_name")).select("item.*", "file_name")


def from_file_name(pattern: str, names: list[str]) -> list[Column]:
    """Columns from the groups of a pattern on the file's name."""
    return [F.regexp_extract(F.col("_metadata.file_name"), pattern, k + 1).alias(n) for k, n in enumerate(names)]


def when_seen(charttime: str = "charttime", chartdate: str = "chartdate") -> Column:
    """A time as timestamp, the date where there is no time, null where neither parses."""
    return F.try_to_timestamp(F.coalesce(F.col(charttime), F.col(chartdate)))


def write_sorted(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """Parquet, partitioned by ranges of a key and sorted by it, so that row-group statistics can prune."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def write_records(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines, in a folder for each value of `by` if given."""
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).json(path)


def write_cases(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """JSON lines in a folder for each case, and a manifest with a row for each: the key, how many records, and its folder."""
    write_records(df, f"{path}/cases", key, mode)
    told = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_records")).withColumn("folder", F.concat(F.lit(f"cases/{key}="), F.col(key).cast("string")))
    told.write.mode(mode).json(f"{path}/manifest")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the records whose key is not in the sink yet, and says how many. One writer at a time; see commits for more, and for crashes."""
    spark = df.sparkSession
    if exists(spark, path):
        done = spark.read.schema(df.schema).json(path).select(key)
        df = df.join(done, key, "left_anti")
    told = Observation()
    df.dropDuplicates([key]).observe(told, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return told.get["n"]


def finish(df: DataFrame, path: str) -> None:
    """Says beside a sink that it is complete, with the number of its records; written last."""
    df.agg(F.count(F.lit(1)).alias("n_records")).coalesce(1).write.mode("overwrite").json(f"{path}.done")


def finished(spark: SparkSession, path: str) -> int | None:
    """The number of records of a complete sink, None if it is not complete."""
    if not exists(spark, f"{path}.done/_SUCCESS"):
        return None
    return spark.read.schema("n_records long").json(f"{path}.done").first()[0]


def resume_state(spark: SparkSession, path: str, schema: T.StructType | str, key: str, fingerprint: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a sink holds already: its different keys, its different fingerprints, and how many records of each kind; empty without a sink."""
    old = spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return old.select(key).distinct(), old.select(fingerprint).distinct(), old.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def reused(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at a path; made and written first if it is not there."""
    if not exists(spark, path):
        make().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def counts_by(df: DataFrame, by: str) -> DataFrame:
    """One row: the total and a map of a column's values to their counts."""
    counts = df.groupBy(F.col(by).cast("string").alias("k")).count()
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias("by"))


def manifest(df: DataFrame, path: str, by: str, records: list[str] | None = None, most: int = 10_000, **settings: str) -> None:
    """One JSON record: counts of a column's values and their total, settings of the run, and the records below that header if asked for.

    Records go into one file, so more than `most` of them are an error.
    """
    out = counts_by(df, by).select("*", *[F.lit(str(v)).alias(k) for k, v in settings.items()])
    if records:
        if df.limit(most + 1).count() > most:
            raise ValueError(f"a manifest lists at most {most} records")
        listed = df.agg(F.array_sort(F.collect_list(F.struct(*records))).alias("records"))
        out = out.crossJoin(F.broadcast(listed))  # one row each
    out.coalesce(1).write.mode("overwrite").json(path)


def write_readable(df: DataFrame, path: str, columns: list[tuple[str, int]], order: list[str]) -> None:
    """Rows as text in columns of given widths, in order, each part headed by the columns' names; at most as many parts as the rows' ranges."""
    heads = df.sparkSession.range(1).select(F.lit(" | ".join(c.ljust(w)[:w] for c, w in columns)).alias("value"))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select(fixed_width(columns).alias("value"))
    heads.coalesce(1).write.mode("overwrite").text(f"{path}/header")
    rows.write.mode("overwrite").text(f"{path}/rows")


def fixed_width(columns: list[tuple[str, int]]) -> Column:
    """A row as text in columns of given widths."""
    return F.concat_ws(" | ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in columns])
