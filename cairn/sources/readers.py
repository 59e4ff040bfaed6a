"""Readers of record files, each with an explicit schema."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators.records import first_by, sample

_ANY = "question string, correct_answer string, correct string, answer string, ans string, correct_units string, unit string, domains array<string>, model_output string, model_answer string, metadata map<string,string>"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; fields that the schema lacks are left out."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def csv_tasks(spark: SparkSession, path: str) -> DataFrame:
    """question, answer, unit with a header; an error where there is no question column."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "question" not in df.columns:
        raise ValueError("CSV must have a 'question' column")
    return df.select("question", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("answer", "unit")])


def normalised_truth(df: DataFrame) -> DataFrame:
    """df with correct: struct ans, unit from a nested object (as JSON text) or flat columns; null where there is no answer."""
    get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    nested = [F.try_parse_json(get(c)) for c in ("correct_answer", "correct")]
    field = lambda name: [F.try_variant_get(v, f"$.{name}", "string") for v in nested]
    scalar = [F.when(F.try_variant_get(v, "$.ans", "variant").isNull() & F.try_variant_get(v, "$.answer", "variant").isNull() & ~F.coalesce(get(c).startswith("{"), F.lit(False)), get(c)) for v, c in zip(nested, ("correct_answer", "correct"), strict=True)]
    ans = F.coalesce(*field("ans"), *field("answer"), *scalar, get("ans"), get("answer"))
    unit = F.coalesce(*field("unit"), get("correct_units"), get("unit"), F.lit(""))
    return df.withColumn("correct", F.when(ans.isNotNull(), F.struct(ans.alias("ans"), unit.alias("unit"))))


def physics_tasks(spark: SparkSession, path: str, num_samples: int = -1, seed: int = 42) -> DataFrame:
    """Tasks (question, correct, metadata) from .json, .jsonl or .csv; num_samples rows by hash rank where it is not negative."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        df = csv_tasks(spark, path)
    elif suffix == ".json":
        df = json_array(spark, path, _ANY)
    elif suffix == ".jsonl":
        df = json_lines(spark, path, _ANY)
    else:
        raise ValueError(f"Unsupported input format: {suffix}")
    out = normalised_truth(df.where("question is not null"))
    extra = [F.struct(F.lit(c).alias("key"), (F.to_json(c) if c == "domains" else F.col(c)).alias("value")) for c in ("domains", "model_output", "model_answer") if c in df.columns]
    gathered = F.map_from_entries(F.filter(F.array(*extra), lambda x: x["value"].isNotNull())) if extra else F.create_map().cast("map<string,string>")
    base = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in df.columns else None
    out = out.select("question", "correct", (gathered if base is None else F.map_concat(F.map_filter(base, lambda k, v: ~k.isin("domains", "model_output", "model_answer")), gathered)).alias("metadata"))
    return out if num_samples < 0 else sample(out.withColumn("__k", F.concat_ws("#", "question", F.col("correct.ans"))), "__k", num_samples, seed).drop("__k")


def logic_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples with equally many premises and formulas (at least one), the first of each premise text in file order."""
    df = json_array(spark, path, schemas.LOGIC_SAMPLE).withColumn("ord", F.monotonically_increasing_id())
    fit = df.where((F.size("`premises-NL`") > 0) & (F.size("`premises-NL`") == F.size("`premises-FOL`")))
    return first_by(fit.withColumn("__key", F.array_join("`premises-NL`", "\n")), ["__key"], ["ord"]).drop("__key")


def distillation_rows(spark: SparkSession, path: str, schema: str = schemas.PHYSICS_ROW) -> DataFrame:
    """Rows with a non-empty input and output."""
    return json_array(spark, path, schema).where((F.length("input") > 0) & (F.length("output") > 0))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """name (file stem) and text of every Markdown or text file of a folder; an empty table where there is none."""
    try:
        df = spark.read.option("wholetext", True).text(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.TEXT_DOCUMENT)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("name"), F.col("value").alias("text"))


def ontology(spark: SparkSession, *paths: str) -> DataFrame:
    """The documents of the first path that has any."""
    for path in paths:
        found = text_documents(spark, path)
        if found.limit(1).count():
            return found
    return spark.createDataFrame([], schemas.TEXT_DOCUMENT)


def notation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.NOTATION).option("header", True).csv(path)


def requests(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.PREDICT_REQUEST)
