"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised into at most 2^BITS cells, spread over the whole range; rows are sorted by their cell's index
on the curve (ties by doc_id and text checksum, so one cell may hold any share of the rows) and the sorted run is cut
into shards whose row counts differ by one at most. A shard then covers a compact box of every dimension, and a
manifest of the boxes prunes files by any of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import partitions, staged, table

BITS, SHARDS, SAMPLE = 8, 24, 4096


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """cells: dimensions x rows, values under 2^bits. The rows' positions along the curve."""
    x = cells.astype(np.int64).copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(len(x)):
            up = (x[k] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[k]) & p)
            x[0] ^= np.where(up, p, swap)
            if k:
                x[k] ^= swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(len(x)):
            out = out << 1 | x[k] >> bit & 1
    return out


def _number(column: str, kind: str) -> Column | None:
    """A double in the column's order, null for null; None for a column that isn't numeric."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal"):
        value = F.col(column).cast("double")
        return F.when(~F.isnan(value), value)
    return None


def spread(ranks: np.ndarray, cells: int, bits: int) -> np.ndarray:
    """Ranks 0 to cells - 1 over the whole range of 2^bits, so that a dimension with few values divides the curve's first
    turns too."""
    return (ranks << bits) // max(1, cells)


def curve(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """df with its rows' `curve` index. Numbers are cut at approximate quantiles, other values by their whole value: at all
    different ones if there are at most 2^bits, else at those of SAMPLE different ones, the least by hash. So at most SAMPLE
    values a dimension reach the driver."""
    kinds, wide, names = dict(df.dtypes), df, [f"__{k}" for k in range(len(dimensions))]
    numbers = [_number(c, kinds[c]) for c in dimensions]
    wide = df.withColumns({n: F.col(c).cast("string") if x is None else x for n, c, x in zip(names, dimensions, numbers, strict=True)})
    ranks = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = [F.percentile_approx(n, ranks, 10_000).alias(n) for n, x in zip(names, numbers, strict=True) if x is not None]
    cuts = wide.agg(*found, *[F.bool_or(F.col(n).isNull()).alias(f"null{n}") for n in names]).first().asDict()
    null = [int(bool(cuts[f"null{n}"])) for n in names]  # the lowest cell, where there are any
    for n, x in zip(names, numbers, strict=True):
        if x is None:
            some = wide.select(n).where(F.col(n).isNotNull()).distinct().orderBy(F.xxhash64(n), n).limit(SAMPLE).collect()
            values = sorted(r[0] for r in some)
            cuts[n] = values if len(values) <= 1 << bits else [values[len(values) * k // (1 << bits)] for k in range(1 << bits)]
    cuts = {n: np.unique(np.array(x or [], object if numbers[k] is None else np.float64)) for k, (n, x) in enumerate((n, cuts[n]) for n in names)}
    schema = wide.withColumn("curve", F.lit(0).cast("long")).schema

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for n, lowest in zip(names, null, strict=True):
                values, own = batch.column(n), np.full(batch.num_rows, -lowest)
                given = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
                # the first text value is a cell's least, a number's cut lies below the cell
                side = "right" if cuts[n].dtype == object else "left"
                own[given] = np.searchsorted(cuts[n], values.take(pa.array(given)).to_numpy(zero_copy_only=False), side) - (side == "right")
                cells.append(spread(own + lowest, len(cuts[n]) + (side == "left") + lowest, bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_index(np.stack(cells), bits))], [*batch.schema.names, "curve"])

    return wide.mapInArrow(index, schema).drop(*names)


def cut(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (from 0 in each shard): equal runs of the rows sorted by order."""
    spark = df.sparkSession
    runs = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    runs = staged(runs.withColumn("__at", F.monotonically_increasing_id()), "runs")
    part = F.shiftright("__at", 33)
    counts = sorted((r[0], r[1]) for r in runs.groupBy(part.alias("p")).count().collect())
    total, starts = 0, []
    for p, n in counts:
        starts.append((p, total))
        total += n
    starts = spark.createDataFrame(starts, "__part long, __before long")
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)
    out = runs.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("__rank", rank)  # a row a partition
    out = out.withColumn("shard", F.expr(f"((__rank + 1) * {shards} - 1) div {max(1, total)}").cast("int"))
    out = out.withColumn("slot", F.col("__rank") - F.expr(f"(shard * {max(1, total)}L) div {shards}"))
    return out.drop("__part", "__before", "__at", "__rank")


def sharded(docs: DataFrame, dimensions: list[str], shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, dimensions) with size, text_crc32, curve, shard and slot; keep: the columns to carry along,
    so that texts are shuffled only where they are to be written. A null text has size 8; a null dimension lies in the lowest
    cell; repeated rows are rows, and ties go by doc_id and checksum; an empty table gives none. Columns of docs that are named like
    the new ones are left out, so `size` as a dimension is the new one."""
    docs = docs.drop("size", "text_crc32", "curve", "shard", "slot", *[f"__{x}" for x in ("at", "part", "before", "rank")])
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = docs.select("*", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = out.select(*dict.fromkeys([*(docs.columns if keep is None else ["doc_id", *keep]), *dimensions, "size", "text_crc32"]))
    return cut(curve(out, dimensions), ["curve", "doc_id", "text_crc32"], shards)


def write_shards(found: DataFrame, path: str, dimensions: list[str]) -> DataFrame:
    """One folder a shard, rows in slot order; returns (and writes) the manifest: shard, rows, the least and greatest
    value of each dimension."""
    found.repartition(partitions(found.sparkSession), "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/data")
    manifest = found.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in dimensions for n, f in (("min", F.min), ("max", F.max))])
    manifest.write.parquet(f"{path}/manifest")
    return found.sparkSession.read.parquet(f"{path}/manifest")


def read_shards(spark, path: str, bounds: dict[str, tuple]) -> DataFrame:
    """The rows with every bounded dimension within [low, high], reading only the shards whose boxes meet the bounds."""
    manifest, inside = spark.read.parquet(f"{path}/manifest"), F.lit(True)
    for c, (low, high) in bounds.items():
        manifest = manifest.where((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
        inside &= F.col(c).between(low, high)
    shards = [r.shard for r in manifest.select("shard").collect()]
    return spark.read.parquet(f"{path}/data").where(F.col("shard").isin(shards)).where(inside)


def op6_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot and grown_shard (null) for every row of `documents`, in shards along the
    curve over lang, source and size. Nulls, very long texts, ties, repeated rows, empty tables and clashing names: see sharded()."""
    found = sharded(table(spark, sf_dir, "documents"), ["lang", "source", "size"], keep=[])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
