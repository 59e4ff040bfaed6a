"""What the training-data operators share: tables, staged results and shuffles of bounded groups."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import release_shuffles as release_shuffles

_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def ready(spark: SparkSession) -> None:
    """Let workers import this library, and hand them texts in batches of BATCH_BYTES instead of 10,000 rows of any length."""
    importable(spark)
    if int(str(spark.conf.get(_BATCH)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. One of our own only where none is set and all
    runs in one process: on a cluster the machines would not see each other's."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cairn-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a result to the shared folder and read it again: it survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Delete the files of a staged result that nothing will read again."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def least_count(counted: DataFrame, most: int) -> tuple[int, bool]:
    """The least n for which at most `most` rows of counted have that n or more (whole bands of n, so no order is needed), and
    whether other rows are left."""
    band = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r[0]: (r[1], r[2]) for r in counted.groupBy(band).agg(F.count("*"), F.min("n")).collect()}  # 512 rows at most
    total, least = 0, (1 << 63) - 1
    for b in sorted(sizes, reverse=True):
        if total + sizes[b][0] > most:
            return least, True
        total, least = total + sizes[b][0], sizes[b][1]
    return least, False


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts in one take about max_bytes (a single longer text stays whole)."""
    for batch in batches:
        values = batch.column(column)
        if values.nbytes <= max_bytes or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        step = max(1, int(batch.num_rows * max_bytes / values.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


_HELD: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What a worker keeps from task to task for one operator (word ids, vectors, an automaton). A worker is used again by
    the next operator, so what others have kept goes, and the memory that it took goes back to the system: the C library would keep
    it for the worker, and an executor's workers together would hold what the largest stages have needed."""
    others = [k for k in _HELD if k != owner]
    for other in others:
        _HELD.pop(other).clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # glibc only
        if trim:
            trim(0)
    return _HELD.setdefault(owner, {})


def release() -> None:
    """Let go of all that operators have kept in this worker."""
    held("")


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and further columns; a null text counts as empty."""
    ready(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with columns of these names (which an operator adds itself) renamed, and the columns to select at the end to
    have docs' own back."""
    ready(docs.sparkSession)
    own = {n.lower() for n in names}
    clash = {c: f"__kept_{k}" for k, c in enumerate(docs.columns) if c.lower() in own}
    return docs.withColumnsRenamed(clash), [F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns]
