"""Session settings and table access shared by the whole library."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session with the settings that the queries are written for: UTC, ANSI, adaptive execution."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.master(master).config(map=conf | more).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name`; Spark's reader resolves the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, which all executors share.

    It lies in spark.checkpoint.dir. Where that is unset, local mode takes a temporary
    folder; on a cluster that would be lost with its machine, so it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: what loops read again is computed once and survives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


# fixed values: the parts of a run's settings, and how it may set time zero
SECTIONS, POLICIES = ["data", "cohort", "time_zero", "generation", "models", "pubmed_mcp"], ["icu_intime_plus", "first_micro"]


def check_settings(settings: dict, sections: list[str] = SECTIONS, policies: list[str] = POLICIES) -> None:
    """Raises ValueError if a part is missing or the policy of time_zero is unknown."""
    for name in sections:
        if name not in settings:
            raise ValueError(f"settings lack the part {name!r}")
    policy = settings["time_zero"].get("policy")
    if policy not in policies:
        raise ValueError(f"time_zero.policy must be one of {policies}, not {policy!r}")
