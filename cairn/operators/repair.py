"""Repair of invalid samples in passes, and re-verification of labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.formula import normalize_formula, unbracket_quantifiers
from cairn.operators.records import update, validated
from cairn.session import cut_lineage


def rule_repair(invalid: DataFrame, fol: str = "premises-FOL") -> DataFrame:
    """Formulas normalised and their quantifiers unbracketed: the offline repair stage."""
    return invalid.withColumn(fol, F.transform(F.col(f"`{fol}`"), unbracket_quantifiers)).withColumn(fol, _each(fol))


def _each(fol: str):
    from cairn.functions.formula import normalize_formula_plain
    from cairn.session import arrow_udf

    return arrow_udf("array<string>")(lambda fs: None if fs is None else [normalize_formula_plain(f) for f in fs])(F.col(f"`{fol}`"))


def repaired(samples: DataFrame, stages: list[Callable[[DataFrame], DataFrame]] | None = None, max_passes: int = 5, save: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, list[dict]]:
    """valid, invalid and one report a pass: passes of all stages over the invalid rows until none is left or a pass rescues none.
    save(df, pass) writes a pass's rows and reads them again (default: checkpoint into the shared folder)."""
    stages = stages or [rule_repair]
    save = save or (lambda df, k: cut_lineage(df))
    checked = save(validated(samples.drop("validation_error")), 0)
    valid, invalid = checked.where("validation_error is null"), checked.where("validation_error is not null")
    report, left = [], invalid.count()
    for k in range(1, max_passes + 1):
        if not left:
            break
        tried = invalid.drop("validation_error")
        for stage in stages:
            tried = stage(tried)
        again = save(validated(tried), k)
        rescued = again.where("validation_error is null")
        n = rescued.count()
        report.append({"pass": k, "invalid": left, "rescued": n})
        valid, invalid, left = valid.unionByName(rescued), again.where("validation_error is not null"), left - n
        if not n:
            break
    return valid.drop("validation_error"), invalid, report


def unverified(labels: DataFrame, done: DataFrame, key: str = "example_id") -> DataFrame:
    """Rows that no earlier run has verified."""
    return labels.where("explanation is null or explanation = ''").join(done.select(key), key, "left_anti")


def corrected(dataset: DataFrame, verdicts: DataFrame, key: str = "example_id") -> DataFrame:
    """dataset with corrected answers and explanations; write it to a new path, never the one being read."""
    return update(dataset, verdicts, key, ["answer", "explanation"])


def formula_repair(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, normalize_formula(unbracket_quantifiers(F.col(column))))
