"""Writers of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitioned(validated: DataFrame, path: str) -> None:
    """Valid and invalid rows under path/is_valid=...; one pass over the input."""
    validated.withColumn("is_valid", F.col("validation_error").isNull()).write.partitionBy("is_valid").json(path)


def two_way(validated: DataFrame, valid_path: str, invalid_path: str) -> None:
    kept = validated.persist()
    try:
        kept.where("validation_error is null").drop("validation_error").write.json(valid_path)
        kept.where("validation_error is not null").write.json(invalid_path)
    finally:
        kept.unpersist()


def failures(df: DataFrame, path: str) -> None:
    df.write.json(path)


def single(df: DataFrame, path: str) -> None:
    """One record, one file."""
    df.limit(1).coalesce(1).write.json(path)


def diagnostics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report(rows: list[dict]) -> str:
    """A Markdown report of repair diagnostics."""
    return "".join(f"## {r.get('example_id', 'unknown')}\n\n- error: {r.get('validation_error', '')}\n- stage: {r.get('stage', '')}\n\n" for r in rows)


def responses(df: DataFrame) -> DataFrame:
    """One compact JSON text a row; a number that is not finite is an error."""
    doubles = [c for c, kind in df.dtypes if kind in ("double", "float")]
    bad = F.lit(False)
    for c in doubles:
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(F.when(bad, F.raise_error(F.lit("Out of range float values are not JSON compliant"))).otherwise(F.to_json(F.struct(*df.columns))).alias("value"))


def summary(validated: DataFrame) -> DataFrame:
    """total, valid, invalid and the rate of valid rows in percent to two places."""
    good = F.count_if(F.col("validation_error").isNull())
    return validated.agg(F.count("*").alias("total"), good.alias("valid"), (F.count("*") - good).alias("invalid"), F.round(F.coalesce(F.try_divide(good * 100.0, F.count("*")), F.lit(0.0)), 2).alias("rate"))
