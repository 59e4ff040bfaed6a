"""Augmentation of logic samples: canonical variables, permutations, anonymised entities, hard negatives, budgets.

A sample has example_id, dataset_source, premises_nl, premises_fol, question, answer. All randomness comes from md5 of the sample and the
variant, so every run gives the same rows."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.formula import canonical_variables
from cairn.functions.logic import parse_error_plain
from cairn.operators.records import lineage_columns, rank_hash, sample
from cairn.session import arrow_udf, importable

NAMES = tuple("alex blake casey dana ellis finley gray harper indigo jordan kai logan morgan noel oakley parker quinn riley sage taylor".split())
LETTERS = tuple("abcdefghijklmnopqrstuvwxyz")
MIN_PREMISES = 4


def canonicalised(df: DataFrame) -> DataFrame:
    return lineage_columns(df.withColumn("premises_fol", F.transform("premises_fol", canonical_variables)), "canonical", "aug", F.lit(0))


def permutation(pairs: Column, key: Column, variant: Column) -> Column:
    """Pairs in an order given by md5 of key, variant and place; the identity gets its ends swapped."""
    n = F.size(pairs)
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.md5(F.concat_ws("#", key, variant.cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("i"))))
    order = F.transform(ranked, lambda r: r["i"])
    swapped = F.concat(F.array(n - 1), F.slice(F.sequence(F.lit(0), n - 1), 2, F.greatest(n - 2, F.lit(0))), F.array(F.lit(0)))
    order = F.when(order == F.sequence(F.lit(0), n - 1), swapped).otherwise(order)
    return F.transform(order, lambda i: F.get(pairs, i))


def permuted(df: DataFrame, variants: int = 1) -> DataFrame:
    """Aligned premises in another order, for samples with MIN_PREMISES or more of equal number."""
    fit = df.where((F.size("premises_nl") >= MIN_PREMISES) & (F.size("premises_nl") == F.size("premises_fol")))
    many = fit.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    pairs = F.arrays_zip("premises_nl", "premises_fol")
    moved = many.withColumn("p", permutation(pairs, F.col("example_id"), F.col("variant")))
    out = moved.withColumns({"premises_nl": F.transform("p", lambda x: x["premises_nl"]), "premises_fol": F.transform("p", lambda x: x["premises_fol"])})
    return lineage_columns(out, "permutation", "perm", F.col("variant")).drop("p", "variant")


def clean_plain(text: str) -> str:
    text = re.sub(r"['’]s\b", "", text.lower().strip())
    return re.sub("[^a-z0-9]", "", re.sub(r"^(?:year|number)[\s_]*(?=.)", "", text))


def spans_plain(symbol: str, sentences: list[str], most: int = 12) -> list[str]:
    """Word spans of up to `most` words whose cleaned form is the symbol's, longest first."""
    wanted, found = clean_plain(symbol), {}
    for s in sentences if wanted else ():
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", s)]
        for i in range(len(words)):
            for j in range(i, min(len(words), i + most)):
                text = s[words[i][0] : words[j][1]].strip(".,;:!?\"()")
                clean = clean_plain(text)
                if clean == wanted:
                    found[text] = None
                if len(clean) > len(wanted) + 4:
                    break
    return sorted(found, key=lambda x: (-len(x), x))


def span_matches(df: DataFrame, key: str, sentences: str, symbols: str, most: int = 12) -> DataFrame:
    """key, symbol, span: word spans whose cleaned form equals a cleaned symbol of the same row, as an equi-join of n-grams."""
    from cairn.functions.language import clean

    words = df.select(key, F.explode(sentences).alias("s")).select(key, F.filter(F.split("s", r"\s+"), lambda w: w != "").alias("w"))
    places = words.select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i")).where("i <= size(w)")
    grams = places.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - F.col("i") + 1)), lambda n: F.array_join(F.slice("w", F.col("i"), n), " "))).alias("span"))
    named = df.select(key, F.explode(symbols).alias("symbol"))
    spans = grams.select(key, F.regexp_replace("span", r"^[.,;:!?\"()]+|[.,;:!?\"()]+$", "").alias("span")).withColumn("c", clean(F.col("span"))).where("c <> ''")
    return spans.distinct().join(named.withColumn("c", clean(F.col("symbol"))).distinct(), [key, "c"]).select(key, "symbol", "span").distinct()


def _plural(old: str, new: str) -> str:
    new = new + "s" if old.endswith("s") and not new.endswith("s") else new
    return new.capitalize() if old[:1].isupper() else new


def anonymised_plain(nl: list, fol: list, question: str | None, strategy: str, variant: int) -> dict | None:
    seed = hashlib.md5(("\n".join(map(str, nl)) + f"#{variant}").encode()).hexdigest()
    rng = random.Random(seed)
    kind = rng.choice(("letters", "names", "perturbation")) if strategy == "mix" else strategy
    names = {n for f in fol for n in re.findall(r"\b([A-Za-z_]\w*)\s*\(", f or "")} - {"ForAll", "Exists", "In", "NOT", "AND", "OR"}
    bound = {v for f in fol for v in re.findall(r"\b(?:ForAll|Exists)\s*\(\s*(\w+)", f or "")}
    if kind == "perturbation":
        targets = {n: f"{n}{rng.choice(('Alt', 'Var', 'Kind'))}" for n in sorted(names)}
    else:
        found = sorted({a.strip() for f in fol for g in re.findall(r"\b[A-Za-z_]\w*\s*\(([^()]*)\)", f or "") for a in g.split(",")} - bound - names)
        found = [c for c in found if len(c) > 1 and re.fullmatch(r"\w+", c)]
        pool = list(LETTERS if kind == "letters" else NAMES)
        rng.shuffle(pool)
        targets = {}
        for k, c in enumerate(found):
            digits = re.search(r"\d{2,}", c)
            targets[c] = c.replace(digits[0], str(rng.randint(10 ** (len(digits[0]) - 1), 10 ** len(digits[0]) - 1))) if digits else pool[k % len(pool)] + (str(k // len(pool)) if k >= len(pool) else "")
    texts, changes = [*map(str, nl), question or ""], []
    for symbol in sorted(targets, key=lambda s: (-len(s), s)):
        for span in spans_plain(symbol, texts, 6 if kind == "perturbation" else 12):
            changes.append((span, _plural(span, re.sub(r"(?<=[a-z])(?=[A-Z])", " ", targets[symbol])) if kind == "perturbation" else targets[symbol].capitalize() if span[:1].isupper() else targets[symbol], symbol))
    matched = {s for *_, s in changes}
    if not matched:
        return None
    swap = lambda text, table: re.sub(r"\b(?:" + "|".join(re.escape(k) for k in sorted(table, key=lambda k: (-len(k), k))) + r")\b", lambda m: table[m[0]], text) if table else text
    spans = {a: b for a, b, _ in changes}
    symbols = {s: targets[s] for s in matched}
    return {"premises_nl": [swap(x, spans) for x in map(str, nl)], "premises_fol": [swap(f or "", symbols) for f in fol], "question": swap(question or "", spans)}


def anonymised(df: DataFrame, strategy: str = "mix", variants: int = 1) -> DataFrame:
    """Entities (letters or names) or predicates (perturbation) renamed in premises, formulas and question alike; samples whose
    symbols are nowhere in their text give no row. Numbers within constants get random values."""
    importable(df.sparkSession)
    rename = arrow_udf("premises_nl array<string>, premises_fol array<string>, question string")(lambda nl, fol, q, v: anonymised_plain(list(nl), list(fol), q, strategy, int(v)))
    many = df.where("premises_nl is not null and premises_fol is not null").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    out = many.withColumn("r", rename("premises_nl", "premises_fol", "question", "variant")).where("r.premises_nl is not null")
    out = out.withColumns({c: F.col(f"r.{c}") for c in ("premises_nl", "premises_fol", "question")})
    return lineage_columns(out, strategy, "aug", F.col("variant")).drop("r", "variant")


_MUTATIONS = ((r"\bForAll\b", "Exists"), (r"\bExists\b", "ForAll"), (r" AND ", " OR "), (r" OR ", " AND "), (r"\bNOT ", ""))


def mutated_plain(fol: list, seed: str) -> list[str] | None:
    rng = random.Random(hashlib.md5(seed.encode()).hexdigest())
    choices = [(k, m) for k, f in enumerate(fol) for m in _MUTATIONS if re.search(m[0], f or "")]
    if not choices:
        return None
    k, (pattern, new) = rng.choice(choices)
    out = [f or "" for f in fol]
    out[k] = re.sub(pattern, new, out[k], count=1)
    return out


def hard_negatives(df: DataFrame, variants: int = 1) -> DataFrame:
    """Samples with one formula mutated (quantifier, connective or negation) that still parse, have as many premises, differ from the
    original and get a label of True, False or Unknown by the prover."""
    from cairn.operators.decisions import yes_no

    importable(df.sparkSession)
    mutate = arrow_udf("array<string>")(lambda fol, seed: mutated_plain(list(fol), seed))
    bad = arrow_udf("string")(lambda fol: parse_error_plain(list(fol)))
    many = df.where("premises_fol is not null").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    new = many.withColumn("m", mutate("premises_fol", F.concat_ws("#", "example_id", F.col("variant").cast("string")))).where("m is not null")
    new = new.where(F.size("m") == F.size("premises_nl")).where("m <> premises_fol").withColumn("e", bad("m")).where("e is null")
    out = lineage_columns(new.withColumn("premises_fol", F.col("m")), "hard-negative", "neg", F.col("variant")).drop("m", "e", "variant")
    if "conclusion_fol" not in df.columns:
        return out
    judged = yes_no(out.select(F.col("example_id").alias("id"), "premises_nl", "premises_fol", "question", "conclusion_fol")).select(F.col("id").alias("example_id"), F.create_map(F.lit("Yes"), F.lit("True"), F.lit("No"), F.lit("False"), F.lit("Uncertain"), F.lit("Unknown"))[F.col("answer")].alias("answer"))
    return out.drop("answer").join(judged, "example_id")


def within_budget(train: DataFrame, story: str = "story_id") -> DataFrame:
    """Training samples with their augmentations: all canonicalised, half anonymised, 15 % hard negatives, one permutation a story."""
    n = train.count()
    base = canonicalised(train)
    some = sample(train, "example_id", n // 2)
    few = sample(train, "example_id", n * 15 // 100, seed=43)
    one = train.groupBy(story).agg(F.min_by("example_id", rank_hash("example_id")).alias("example_id")).select("example_id")
    parts = [base, anonymised(some), hard_negatives(few), permuted(train.join(one, "example_id", "left_semi"))]
    out = train
    for p in parts:
        out = out.unionByName(p.select(*train.columns))
    return out
