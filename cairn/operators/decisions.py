"""From entailment results to answers: yes/no, single and multiple choice, open questions, confidence, premises used.

Rows that need no proof (a premise says that the question is open) never reach the prover: guarded UDFs would still run on them, so
they are split off by a filter and put back by a union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.language import first_number, meta_premise
from cairn.functions.logic import contradicts, entails
from cairn.session import importable

LETTERS = tuple("ABCDEFG")


def confidence(result: Column, core: Column, total: Column) -> Column:
    """0.75 to 1 for a proof, the tighter its core against all premises the higher; 0.6 for a refutation, 0.3 for neither."""
    tight = 1.0 - (core - 1) / F.greatest(total, core, F.lit(1))
    return F.when(result == "unsat", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.75 + tight * 0.25)), 4)).when(result == "sat", 0.6).otherwise(0.3)


def verified(df: DataFrame, premises: str = "premises_fol", conclusion: str = "conclusion_fol") -> DataFrame:
    """df with proof (of the conclusion) and refutation (of it)."""
    importable(df.sparkSession)
    return df.withColumns({"proof": entails(F.col(premises), F.col(conclusion)), "refutation": contradicts(F.col(premises), F.col(conclusion))})


def yes_no(df: DataFrame) -> DataFrame:
    """df: id, premises_nl, premises_fol, question, conclusion_fol. answer Yes, No or Uncertain, confidence and unsat_core."""
    flagged = df.withColumn("meta", meta_premise(F.col("premises_nl"), F.col("question")))
    open_ = flagged.where("meta is not null").select("id", F.lit("Uncertain").alias("answer"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("unsat_core"))
    seen = verified(flagged.where("meta is null"))
    proof, against = F.col("proof.result"), F.col("refutation.result")
    answer = F.when(proof == "unsat", "Yes").when(against == "unsat", "No").otherwise("Uncertain")
    core = F.when(proof == "unsat", F.col("proof.unsat_core")).when(against == "unsat", F.col("refutation.unsat_core")).otherwise(F.array().cast("array<string>"))
    result = F.when((proof == "unsat") | (against == "unsat"), "unsat").otherwise(proof)
    decided = seen.select("id", answer.alias("answer"), confidence(result, F.size(core), F.size("premises_fol")).alias("confidence"), core.alias("unsat_core"))
    return decided.unionByName(open_)


def options_verified(df: DataFrame) -> DataFrame:
    """df: id, premises_fol, options (map letter to formula). One row an option with its proof and refutation."""
    return verified(df.select("id", "premises_fol", F.explode("options").alias("option", "conclusion_fol")))


def single_choice(df: DataFrame) -> DataFrame:
    """id, answer, confidence, unsat_core: of the proven options the one with the smallest core, else of those not refuted
    the first, each by letter; null where all are refuted."""
    seen = options_verified(df)
    core = F.size("proof.unsat_core")
    rank = F.when(F.col("proof.result") == "unsat", F.struct(F.lit(0).alias("t"), core.alias("c"), F.col("option").alias("o"))).when(F.col("refutation.result") != "unsat", F.struct(F.lit(1).alias("t"), F.lit(0).alias("c"), F.col("option").alias("o")))
    best = seen.groupBy("id").agg(F.min_by(F.struct("option", "proof", F.size("premises_fol").alias("n"), rank.isNotNull().alias("ok")), F.coalesce(rank, F.struct(F.lit(2).alias("t"), F.lit(0).alias("c"), F.col("option").alias("o")))).alias("b"))
    out = best.select("id", F.when(F.col("b.ok"), F.col("b.option")).alias("answer"), F.col("b.proof").alias("proof"), F.col("b.n").alias("n"))
    return out.select("id", "answer", confidence(F.col("proof.result"), F.size("proof.unsat_core"), F.col("n")).alias("confidence"), F.col("proof.unsat_core").alias("unsat_core"))


def multiple_choice(df: DataFrame) -> DataFrame:
    """id, answer (array), unsat_core (union), all_unsat: all proven options, else all that aren't refuted."""
    seen = options_verified(df)
    proven, allowed = F.col("proof.result") == "unsat", F.col("refutation.result") != "unsat"
    grouped = seen.groupBy("id").agg(F.array_sort(F.collect_list(F.when(proven, F.col("option")))).alias("p"), F.array_sort(F.collect_list(F.when(allowed, F.col("option")))).alias("a"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(proven, F.col("proof.unsat_core")))))).alias("unsat_core"))
    return grouped.select("id", F.when(F.size("p") > 0, F.col("p")).otherwise(F.col("a")).alias("answer"), "unsat_core", (F.size("p") > 0).alias("all_unsat"))


def open_ended(df: DataFrame) -> DataFrame:
    """df: id, premises_nl, premises_fol, question, candidate, conclusion_fol. The candidate's short answer if it is proven, else
    Unknown. A question for a number takes the candidate's first number, else that of the premise that shares most of its words."""
    seen = verified(df)
    numeric = F.regexp_like(F.lower("question"), F.lit(r"how many|how much|count of|number of|what is the (?:enrollment|count)"))
    short = F.when(numeric, F.coalesce(first_number(F.col("candidate")), first_number(best_premise(F.col("premises_nl"), F.col("question"))))).otherwise(F.col("candidate"))
    proven = F.col("proof.result") == "unsat"
    return seen.select("id", F.when(proven, F.coalesce(short, F.col("candidate"))).otherwise("Unknown").alias("answer"), confidence(F.col("proof.result"), F.size("proof.unsat_core"), F.size("premises_fol")).alias("confidence"))


def keyword_overlap(premise: Column, words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(F.lower(premise), w)))


_QUESTION_WORDS = ("how", "many", "what", "is", "the", "does", "do", "did", "have", "has", "who", "whom", "where", "which", "of", "in", "a", "an", "enrolled")


def best_premise(premises: Column, question: Column) -> Column:
    """The premise with a number that holds most of the question's keywords, the first of equals; null if none holds any."""
    words = F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"\b\w+\b"), F.lit(0)), lambda w: ~w.isin(*_QUESTION_WORDS))
    rows = F.transform(premises, lambda p, i: F.struct((F.lit(0) - keyword_overlap(p, words)).alias("s"), i.alias("i"), p.alias("p")))
    rows = F.filter(rows, lambda r: (r["s"] < 0) & first_number(r["p"]).isNotNull())
    return F.array_min(rows)["p"]


def best_premises(df: DataFrame, key: str, premises: str, question: str) -> DataFrame:
    """Long form of best_premise over all premises, for very long lists: key, idx, premise of the largest overlap, first of equals."""
    words = F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"\b\w+\b"), F.lit(0)), lambda w: ~w.isin(*_QUESTION_WORDS))
    rows = df.select(key, words.alias("w"), F.posexplode(premises).alias("idx", "premise")).withColumn("s", keyword_overlap(F.col("premise"), F.col("w")))
    window = Window.partitionBy(key).orderBy(F.desc("s"), "idx")
    return rows.withColumn("r", F.row_number().over(window)).where("r = 1").select(key, "idx", "premise")


def relevant_premises(premises: Column, picked: Column) -> Column:
    """Indices (from 0) to keep: all of three or fewer; else the picked ones, in range, distinct and sorted; all if fewer than two
    are left."""
    everything = F.sequence(F.lit(0), F.size(premises) - 1)
    kept = F.array_sort(F.array_distinct(F.filter(picked, lambda i: (i >= 0) & (i < F.size(premises)))))
    return F.when(F.size(premises) == 0, F.array().cast("array<int>")).when(F.size(premises) <= 3, everything).otherwise(F.when(F.coalesce(F.size(kept), F.lit(0)) >= 2, kept).otherwise(everything))


def default_k(n: Column) -> Column:
    return F.greatest(F.lit(3), F.floor((n + 1) / 2)).cast("int")


def overlap_scorer(premises: Column, question: Column) -> Column:
    """Indices of the default number of premises that share most words with the question: the offline relevance scorer."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"\b\w{3,}\b"), F.lit(0))
    ranked = F.array_sort(F.transform(premises, lambda p, i: F.struct((F.lit(0) - keyword_overlap(p, words)).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, default_k(F.size(premises))), lambda r: r["i"])


def mapped_to_options(answers: Column, options: Column) -> Column:
    """Answers as options: by text in any case, by letter, by index from 0, else as they are; joined by `, `."""

    def one(a: Column) -> Column:
        a = F.trim(a)
        same = F.try_element_at(F.filter(options, lambda o: F.lower(F.trim(o)) == F.lower(a)), F.lit(1))
        letter = F.when(F.regexp_like(a, F.lit("^[A-G]$")), F.try_element_at(options, F.ascii(a) - 64))
        index = F.when(F.regexp_like(a, F.lit(r"^\d{1,6}$")), F.try_element_at(options, a.try_cast("int") + 1))
        return F.coalesce(same, letter, index, a)

    return F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, F.array_join(answers, ", ")).otherwise(F.array_join(F.transform(answers, one), ", "))


def premises_used(core: Column, filtered: Column, original: Column) -> Column:
    """Indices (from 0) in the original premises of the core's p_k, by text; without a core those of the filtered premises, else all."""
    place = lambda p: F.when(F.array_position(original, p) > 0, (F.array_position(original, p) - 1).cast("int"))
    numbers = F.transform(F.filter(core, lambda c: F.regexp_like(c, F.lit(r"^p_\d+$"))), lambda c: F.substring(c, 3, 9).cast("int"))
    tidy = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda i: i.isNotNull())))
    used, kept = tidy(F.transform(numbers, lambda k: place(F.try_element_at(filtered, k)))), tidy(F.transform(filtered, place))
    return F.when(F.size(used) > 0, used).when(F.size(kept) > 0, kept).otherwise(F.when(F.size(original) > 0, F.sequence(F.lit(0), F.size(original) - 1)).otherwise(F.array().cast("array<int>")))


def answers_match(predicted: Column, truth: Column) -> Column:
    """Equality after yes = true, no = false, unknown = uncertain."""
    canon = lambda c: F.when(F.lower(F.trim(c)).isin("yes", "true"), "true").when(F.lower(F.trim(c)).isin("no", "false"), "false").when(F.lower(F.trim(c)).isin("unknown", "uncertain"), "uncertain").otherwise(F.lower(F.trim(c)))
    return F.coalesce(canon(predicted) == canon(truth), F.lit(False))


def answered(requests: DataFrame, translated: DataFrame) -> DataFrame:
    """Logic requests to responses: requests as in PREDICT_REQUEST; translated: query_id, premises_fol, conclusion_fol. Answers are mapped
    to the request's options."""
    df = requests.join(translated, "query_id").select(F.col("query_id").alias("id"), F.col("premises").alias("premises_nl"), "premises_fol", F.col("query").alias("question"), "conclusion_fol")
    out = yes_no(df).join(requests.select(F.col("query_id").alias("id"), "premises", "options"), "id")
    steps = F.transform("unsat_core", lambda c: F.concat(F.lit("uses "), c))
    return out.select(F.col("id").alias("query_id"), mapped_to_options(F.array("answer"), F.col("options")).alias("answer"), F.lit("").alias("unit"), F.concat(F.lit("Answer: "), F.col("answer"), F.lit(". "), F.array_join(steps, "; ")).alias("explanation"), premises_used(F.col("unsat_core"), F.col("premises"), F.col("premises")).alias("premises_used"), F.struct(F.lit("fol").alias("type"), steps.alias("steps")).alias("reasoning"))


def qa_check(df: DataFrame) -> DataFrame:
    """df: id, premises_nl, premises_fol (predicted), question, conclusion_fol, truth. id and qa_correct: whether the predicted
    formulas lead to the true answer."""
    found = yes_no(df).join(df.select("id", "truth"), "id")
    return found.select("id", answers_match(F.col("answer"), F.col("truth")).alias("qa_correct"))
