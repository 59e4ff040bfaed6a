"""Language-model stages behind a provider: recorded or rule-based answers by default, so that everything runs offline."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import jsons
from cairn.functions.formula import extract_formulas, normalize_formula_plain, unify_predicates_plain
from cairn.functions.logic import parse_error_plain
from cairn.session import importable


class Provider(Protocol):
    def generate(self, prompt: str) -> str: ...


class RuleBased:
    """Answers from a function of the prompt."""

    def __init__(self, rule: Callable[[str], str]) -> None:
        self.rule = rule

    def generate(self, prompt: str) -> str:
        return self.rule(prompt)


#: Words that point to a domain of physics questions, first match first: the offline router.
DOMAIN_WORDS = {
    "Capacitance": "capacit", "Inductance": "induct|solenoid|coil", "AC_Circuits": r"alternating|\bAC\b|impedance|reson|RLC", "DC_Circuits": "resist|ohm|series|parallel|voltage|current|battery",
    "Electrostatics": "charge|coulomb|electric field|potential", "Magnetism": "magnet|tesla|flux", "Oscillations": "oscillat|period|frequency", "Energy": "energy|power|joule|watt",
}


def routed(df: DataFrame, question: str = "question") -> DataFrame:
    """df with domains and multi_state from a rule on the question's words."""
    hits = [F.when(F.regexp_like(F.col(question), F.lit(f"(?i){p}")), F.lit(d)) for d, p in DOMAIN_WORDS.items()]
    found = F.filter(F.array(*hits), lambda d: d.isNotNull())
    several = F.regexp_like(F.col(question), F.lit(r"(?i)\b(?:after|then|before|initially|finally|when the switch)\b"))
    return df.withColumns({"domains": F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("General"))), "multi_state": several})


def parsed_route(reply: Column) -> Column:
    return jsons.router_fields(reply)


def generated(df: DataFrame, prompt: str, provider: Provider, attempts: int = 1) -> DataFrame:
    """df with reply and error (null where it worked): a bounded number of attempts a row inside the tasks, exceptions as text."""
    importable(df.sparkSession)
    schema = df.withColumns({"reply": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch[prompt]:
                reply = error = None
                for _ in range(attempts):
                    try:
                        reply, error = provider.generate(p), None
                        break
                    except Exception as e:  # noqa: BLE001  a failed call is a row
                        error = f"{type(e).__name__}: {e}"
                rows.append((reply, error))
            yield batch.assign(reply=[r for r, _ in rows], error=[e for _, e in rows])

    return df.mapInPandas(ask, schema)


def recorded(df: DataFrame, prompt: str, replies: DataFrame) -> DataFrame:
    """df with reply and error from a table of recorded replies (prompt_hash, reply): md5 of the prompt."""
    known = replies.select("prompt_hash", "reply").dropDuplicates(["prompt_hash"])
    out = df.withColumn("prompt_hash", F.md5(F.col(prompt).cast("binary"))).join(known, "prompt_hash", "left").drop("prompt_hash")
    return out.withColumn("error", F.when(F.col("reply").isNull(), "KeyError: no recorded reply"))


def solved(df: DataFrame, reply: str = "reply") -> DataFrame:
    """df with ans, unit and content_error of a solver's reply: its python_code is read as plain assignments, never run. A missing
    reply is a system error and left to the provider's error column."""
    from cairn.functions.quantity import run_code

    importable(df.sparkSession)
    body = F.from_json(jsons.any_object(F.col(reply)), "python_code string")
    code = F.coalesce(body["python_code"], F.array_join(F.from_json(jsons.any_object(F.col(reply)), "python_code array<string>")["python_code"], "\n"))
    out = df.withColumn("__r", run_code(F.coalesce(code, F.lit("")))).withColumn("__c", code)
    error = F.when(F.col(reply).isNotNull() & F.col("__c").isNull(), "json decode error").otherwise(F.col("__r.error"))
    return out.withColumns({"ans": F.col("__r.ans"), "unit": F.col("__r.unit"), "content_error": error}).drop("__r", "__c")


def self_corrected(df: DataFrame, prompt: str, provider: Provider, fix: Callable[[str, str], str | None], check: Callable[[str], str | None], max_attempts: int = 2) -> DataFrame:
    """df with reply and attempts: while check finds an error and fix proposes another prompt, ask again, max_attempts times at most."""
    schema = df.withColumns({"reply": F.lit(None).cast("string"), "attempts": F.lit(0)}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch[prompt]:
                for attempt in range(1, max_attempts + 1):
                    reply = provider.generate(p)
                    error = check(reply)
                    p = fix(p, error) if error else None
                    if p is None:
                        break
                rows.append((reply, attempt))
            yield batch.assign(reply=[r for r, _ in rows], attempts=pd.Series([a for _, a in rows], index=batch.index, dtype="int32"))

    return df.mapInPandas(run, schema)


def translated(df: DataFrame, reply: str = "reply", n: str = "n_premises") -> DataFrame:
    """df with formulas: the reply's formulas normalised and unified, null where their number isn't that of the premises or one has no
    parse (the caller then asks again, premise by premise)."""
    from cairn.session import arrow_udf

    importable(df.sparkSession)
    tidy = arrow_udf("array<string>")(lambda fs: unify_predicates_plain([normalize_formula_plain(f) for f in fs]))
    bad = arrow_udf("string")(lambda fs: parse_error_plain(list(fs)))
    out = df.withColumn("formulas", tidy(extract_formulas(F.col(reply))))
    return out.withColumn("formulas", F.when((F.size("formulas") == F.col(n)) & bad(F.col("formulas")).isNull(), F.col("formulas")))


def fallback(*stages: Column) -> Column:
    """The first stage that gave something."""
    return F.coalesce(*stages)


def summary_prompts(failures: DataFrame, order: list[str], size: int = 25) -> DataFrame:
    """One prompt for each chunk of failures."""
    from cairn.operators.records import chunks

    line = F.concat_ws(" | ", "question", "correct", "model_answer", "reason")
    grouped = chunks(failures.withColumns({"line": line, "all": F.lit(0)}), order, "line", ["all"], size)
    return grouped.select("chunk", F.concat(F.lit("Failures, part "), (F.col("chunk") + 1).cast("string"), F.lit(":\n"), F.array_join("items", "\n")).alias("prompt"))


def explanation(answer: Column, core: Column, premises: Column) -> Column:
    """A template explanation that names the premises of the proof."""
    used = F.transform(F.filter(core, lambda c: F.regexp_like(c, F.lit(r"^p_\d+$"))), lambda c: F.try_element_at(premises, F.substring(c, 3, 9).cast("int")))
    return F.concat(F.lit("The answer is "), answer, F.when(F.size(used) > 0, F.concat(F.lit(" because "), F.array_join(used, "; "))).otherwise(""), F.lit("."))


def prompt(template: str, **columns: Column) -> Column:
    """A template with {name} filled in from columns."""
    parts = [columns[x[1:-1]].cast("string") if re.fullmatch(r"\{\w+\}", x) else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x]
    return F.concat(*parts)
