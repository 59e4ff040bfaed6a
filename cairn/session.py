"""Sessions with the settings the engine is designed for."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[1])


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName("cairn")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. One of our own only where none is set and all runs in one process: on a cluster the
    machines would not see each other's."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cairn-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: unlike a checkpoint it brings no constraints of the plan along, which double
    from round to round where a loop puts columns together."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark drop the files of shuffles that nothing refers to any more. Its cleaner waits for the driver to collect garbage, which
    it asks for every half hour only (spark.cleaner.periodicGC.interval); a job with several large shuffles would keep all of them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_udf(kind: T.DataType | str):
    """Decorator: a function over Python values as an Arrow-batched UDF, kept callable as `.plain`."""

    def wrap(function):
        def column(*args):
            return F.udf(function, kind, useArrow=True)(*args)

        column.plain, column.__doc__, column.__name__ = function, function.__doc__, function.__name__
        return column

    return wrap
