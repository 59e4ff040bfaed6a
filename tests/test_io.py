"""Readers, writers, repair, decisions, providers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators import decisions, profiling, providers, records, repair
from cairn.sources import readers, writers
from cairn.streaming import stream


def test_logic_samples_keep_the_first(spark, tmp_path):
    rows = [{"premises-NL": ["a"], "premises-FOL": ["P(a)"], "example_id": "1"}, {"premises-NL": ["a"], "premises-FOL": ["Q(a)"], "example_id": "2"}, {"premises-NL": ["b", "c"], "premises-FOL": ["P(a)"], "example_id": "3"}, {"premises-NL": [], "premises-FOL": []}]
    path = tmp_path / "x.json"
    path.write_text(json.dumps(rows))
    assert [r.example_id for r in readers.logic_samples(spark, str(path)).collect()] == ["1"]


def test_physics_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('question,answer,unit\n"Q, one",5,V\nQ2,,\n')
    (tmp_path / "a.jsonl").write_text('{"question": "q", "correct_answer": {"answer": 3, "unit": "A"}, "domains": ["X"]}\n\n{"question": "r", "correct_answer": "7", "correct_units": "N"}\n')
    (tmp_path / "a.json").write_text('[{"question": "q", "answer": "1", "unit": "m"}]')
    got = {r.question: r for r in readers.physics_tasks(spark, str(tmp_path / "a.csv")).collect()}
    assert tuple(got["Q, one"].correct) == ("5", "V") and got["Q2"].correct is None
    got = {r.question: r for r in readers.physics_tasks(spark, str(tmp_path / "a.jsonl")).collect()}
    assert tuple(got["q"].correct) == ("3", "A") and tuple(got["r"].correct) == ("7", "N") and got["q"].metadata == {"domains": '["X"]'}
    assert readers.physics_tasks(spark, str(tmp_path / "a.json"), 1).count() == 1
    with pytest.raises(ValueError):
        readers.physics_tasks(spark, str(tmp_path / "a.txt"))
    (tmp_path / "b.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        readers.csv_tasks(spark, str(tmp_path / "b.csv"))


def test_policies(spark, tmp_path):
    for n, t in (("A", "policy a"), ("B", "policy b"), ("C", "policy c")):
        (tmp_path / f"{n}.md").write_text(t)
    docs = readers.text_documents(spark, str(tmp_path))
    tasks = spark.createDataFrame([(1, ["A", "B", "C", "missing"]), (2, [])], "id long, domains array<string>")
    examples = docs.select("name", F.concat(F.lit("ex "), "name").alias("text"))
    out = {r.id: r.prompt for r in records.policy_block(tasks, docs, examples).collect()}
    assert out == {1: "policy a\n\npolicy b\n\npolicy c\n\nex A\n\nex B", 2: ""}
    assert readers.ontology(spark, str(tmp_path / "none"), str(tmp_path)).count() == 3


def test_validate_repair_write(spark, tmp_path):
    rows = [("1", ["a"], ["P(a)"]), ("2", ["a"], ["∀x P(x"]), ("3", ["a"], ["bare"]), ("4", ["a", "b"], ["P(a)"]), ("5", ["a"], ["ForAll([x, y], P(x, y))"])]
    df = spark.createDataFrame(rows, "example_id string, `premises-NL` array<string>, `premises-FOL` array<string>")
    checked = records.validated(df)
    assert {r.example_id: r.validation_error is None for r in checked.collect()} == {"1": True, "2": True, "3": False, "4": False, "5": False}
    valid, invalid, report = repair.repaired(df.withColumn("validation_error", F.lit(None).cast("string")))
    assert {r.example_id for r in valid.collect()} == {"1", "2", "5"} and report[0]["rescued"] == 1
    writers.two_way(checked, str(tmp_path / "v"), str(tmp_path / "i"))
    writers.partitioned(checked, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "v")).count() == 2 and spark.read.json(str(tmp_path / "p")).count() == 5
    assert tuple(writers.summary(checked).first()) == (5, 2, 3, 40.0)
    text = writers.responses(spark.createDataFrame([("é", 1.5)], "a string, b double")).first().value
    assert json.loads(text) == {"a": "é", "b": 1.5} and "é" in text
    with pytest.raises(Exception, match="Out of range"):
        writers.responses(spark.createDataFrame([("é", float("nan"))], "a string, b double")).collect()


def test_requests_end_to_end(spark, tmp_path):
    request = {"query_id": "T1", "type": "type1", "query": "Is Student A eligible for graduation?", "premises": ["Students with at least 120 credits are eligible.", "Student A has 125 credits."], "options": ["Yes", "No", "Uncertain"]}
    (tmp_path / "r.jsonl").write_text(json.dumps(request))
    told = spark.createDataFrame([("T1", ["ForAll(x, (Credits(x) >= 120 -> Eligible(x)))", "Credits(a) = 125"], "Eligible(a)")], "query_id string, premises_fol array<string>, conclusion_fol string")
    r = decisions.answered(readers.requests(spark, str(tmp_path / "r.jsonl")), told).first()
    assert r.answer == "Yes" and r.unit == "" and r.premises_used == [0, 1] and r.explanation


def test_decisions(spark):
    df = spark.createDataFrame([("unsat", 0, 5), ("unsat", 1, 5), ("unsat", 3, 5), ("unsat", 6, 5), ("unsat", 2, 14), ("sat", 0, 1), ("unknown", 0, 1)], "r string, c int, t int")
    assert [x.x for x in df.select(decisions.confidence(F.col("r"), F.col("c"), F.col("t")).alias("x")).collect()] == [1.0, 1.0, 0.9, 0.7917, 0.9821, 0.6, 0.3]
    df = spark.createDataFrame([("True", "yes"), ("Unknown", "uncertain"), ("A", "b")], "a string, b string")
    assert [x.x for x in df.select(decisions.answers_match(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False]
    df = spark.createDataFrame([(list("abc"), [0]), (list("abcde"), [4, 1, 1, 9]), (list("abcde"), [2])], "p array<string>, k array<int>")
    assert [x.x for x in df.select(decisions.relevant_premises(F.col("p"), F.col("k")).alias("x")).collect()] == [[0, 1, 2], [1, 4], [0, 1, 2, 3, 4]]
    open_ = spark.createDataFrame([(1, ["Class B has thirty students"], ["Count(b) = 30"], "How many students are in class B?", "There are many", "Count(b) >= 30")], "id long, premises_nl array<string>, premises_fol array<string>, question string, candidate string, conclusion_fol string")
    assert decisions.open_ended(open_).first().answer == "30"


def test_providers(spark):
    df = spark.createDataFrame([("solve",), ("fail",)], "prompt string")

    def rule(p):
        if p == "fail":
            raise RuntimeError("no")
        return '{"python_code": "ans = 2*50\\nunit = \'ohm\'"}'

    asked = providers.generated(df, "prompt", providers.RuleBased(rule))
    out = {r.prompt: r for r in providers.solved(asked).collect()}
    assert (out["solve"].ans, out["solve"].unit, out["solve"].error) == (["100"], ["ohm"], None)
    assert out["fail"].reply is None and out["fail"].error == "RuntimeError: no"
    replies = df.limit(1).select(F.md5(F.col("prompt").cast("binary")).alias("prompt_hash"), F.lit('["P(a)"]').alias("reply"))
    known = providers.translated(providers.recorded(df, "prompt", replies).withColumn("n_premises", F.lit(1)))
    assert sorted((r.prompt, r.formulas) for r in known.collect()) == [("fail", None), ("solve", ["P(a)"])]
    fixed = providers.self_corrected(df.limit(1), "prompt", providers.RuleBased(str.upper), lambda p, e: p + "!", lambda r: None if "!" in r else "bad").first()
    assert (fixed.reply, fixed.attempts) == ("SOLVE!", 2)


def test_failures_and_metrics(spark):
    df = spark.createDataFrame([("q1", ("1", "V"), ("1", "V"), "r", None, {"input": 3}, True, "match"), ("q2", None, None, "r", None, None, None, "missing_correct"), ("q3", ("1", "V"), ("2", "V"), "r", None, None, False, "mismatch")], schemas.PHYSICS_EVAL)
    assert {r.question for r in records.failures(df).collect()} == {"q2", "q3"}
    df = spark.createDataFrame([(["P(a)", "Q(b)"], ["P(a)", "Q(c)"]), (None, ["P(a)"])], "p array<string>, t array<string>")
    a, b = profiling.formula_rates(F.col("p"), F.col("t"))
    assert profiling.metrics(df, {"rate": (a, b)}).first().rate == 50.0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"query_id": "1", "query": "Who?"}\n')
    source = stream.json_stream(spark, str(tmp_path / "in"), schemas.PREDICT_REQUEST)
    query = stream.run(source, lambda df: df.select("query_id", F.upper("query").alias("q")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert [r.q for r in spark.read.json(str(tmp_path / "out")).collect()] == ["WHO?"]
