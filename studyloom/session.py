"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "studyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and the UTC clock every operator assumes.

    On a cluster the shuffle width, memory and checkpoint directory come from the submit configuration; only what
    must hold for right results is set here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the cluster's shared checkpoint folder and start a new plan from it.

    The folder is `spark.checkpoint.dir`; a temporary one is used only when none is configured (tests, local mode).
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the cluster's checkpoint folder: where a wide table is read again, column by column."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-stored-")
    path = f"{base.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
