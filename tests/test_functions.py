"""Functions against documented cases and plain Python."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import formula, jsons, language, logic, physics, quantity
from cairn.operators import augment, profiling


def one(spark, column, *values):
    """The column's value over one row of texts a, b, ..."""
    values = values or ("",)
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in "abcdef"[: len(values)]))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, wanted", [("Dr. Zee", "DrZee"), ("Dr John Smith", "DrJohnSmith"), ("25 °C", "25C"), ("9 AM", "Time9AM"), ("10:30 PM", "Time1030PM"), ("24 hours", "Duration24Hours"), ("Master's", "Masters"), ("Dr. Zee teaches logic", "DrZee teaches logic"), (None, "")])
def test_premises(text, wanted):
    assert formula.normalize_premise.plain(text) == wanted


@pytest.mark.parametrize("text, wanted", [("¬P(x) ∧ Q(x)", "NOT P(x) AND Q(x)"), ("∀x P(X) → Q(x)", "ForAll(x, P(x) -> Q(x))"), ("forall x (P(x) & ~Q(x))", "ForAll(x, (P(x) AND NOT Q(x)))"), (">= 3Papers(x)", "Papers(x) >= 3"), ("P(x))", "P(x)"), ("<think>hm</think>P(a b)", "P(a_b)"), ("", "")])
def test_formulas(text, wanted):
    assert formula.normalize_formula_plain(text) == wanted


def test_parentheses_agree(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("()a") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "a string").select("a", formula.repair_parentheses(F.col("a")).alias("x"))
    for r in df.collect():
        assert r.x == formula.repair_parentheses_plain(r.a) and formula.repair_parentheses_plain(r.x) == r.x


def test_names_and_variables(spark):
    text = "ForAll(a, Exists(b, R(a,b)))"
    assert one(spark, formula.canonical_variables(F.col("a")), text) == "ForAll(x, Exists(y, R(x,y)))" == formula.canonical_variables_plain(text)
    swapped = "ForAll(y, Exists(x, R(y,x)))"
    again = formula.canonical_variables_plain(swapped)
    assert one(spark, formula.canonical_variables(F.col("a")), swapped) == again == formula.canonical_variables_plain(again) == "ForAll(x, Exists(y, R(x,y)))"
    assert formula.unify_predicates_plain(["follows_rule(x)", "FollowsRules(x) AND P(x)"]) == ["Follows(x)", "Follows(x) AND P(x)"]
    assert formula.structure_plain("ForAll(z, P(z))") == formula.structure_plain("ForAll(q, Zed(q))")
    assert one(spark, formula.unbracket_quantifiers(F.col("a")), "ForAll([x, y], P(x,y))") == "ForAll(x, ForAll(y, P(x,y)))"
    assert len(formula.shorten_name_plain("VeryLong" * 12)) <= 50
    for reply in ('```json\n["P(a)", " Q(b) ", 3]\n```', '["P(a)", "Q(b)"]', '<think>["R(c)"]</think>1. P(a)\n\nThese: are two\n2) "Q(b)",\nKey Predicates\nR(c)'):
        assert one(spark, formula.extract_formulas(F.col("a")), reply) == ["P(a)", "Q(b)"]
    assert one(spark, formula.extract_formulas(F.col("a")), "") == []
    df = spark.createDataFrame([(["Human(socrates)", "ForAll(x, (Human(x) -> Mortal(x)))"],)], "f array<string>")
    r = df.select(formula.predicates(F.col("f")).alias("p"), formula.constants(F.col("f")).alias("c"), formula.forbidden_symbols(F.array(F.lit("a*b"), F.lit("P(a)"))).alias("s")).first()
    assert (r.p, r.c, r.s) == (["Human", "Mortal"], ["socrates"], [0])
    assert one(spark, formula.split_name(F.col("a")), "isVeryGood_student2") == ["is", "Very", "Good", "student2"]
    assert one(spark, formula.looks_valid(F.col("a")), "P(x) AND Q(x)") and not one(spark, formula.looks_valid(F.col("a")), "forall x P(x)")


def test_grammar():
    assert logic.try_parse_plain("ForAll(x, ForAll(y, P(x, y)))")["valid"]
    for text, message in (("ForAll([x, y], P(x, y))", "Predicate expected, got term"), ("ForAll(x, y, P(x, y))", "Predicate expected, got term"), ("ForAll(x Human(x))", "Expected ',', got 'Human'"), ("depleted_fund", "Predicate expected, got term")):
        assert logic.try_parse_plain(text) == {"valid": False, "message": message}
    assert [logic.literal_minutes(t) for t in ("Time830AM", "Time500PM", "Duration4Hours", "Duration30Minutes", "x")] == [510, 1020, 240, 30, None]


@pytest.mark.parametrize("premises, conclusion, result", [
    (["Human(socrates)", "ForAll(x, (Human(x) -> Mortal(x)))"], "Mortal(socrates)", "unsat"),
    (["ForAll(x, (Credits(x) >= 120 -> Eligible(x)))", "Credits(a) = 125"], "Eligible(a)", "unsat"),
    (["ForAll(x, (Credits(x) >= 120 -> Eligible(x)))", "Credits(a) = 115"], "Eligible(a)", "sat"),
    (["a = b", "P(a)"], "P(b)", "unsat"), (["P(a)"], "P(b)", "sat"), (["P(a)", "NOT P(a)"], "Q(b)", "unsat"),
    (["F(a) > G(a)", "G(a) > 3"], "F(a) > 3", "unsat"), (["F(a) != 3", "F(a) >= 3"], "F(a) > 3", "unsat"), (["F(a) + 1 = G(a)"], "G(a) > F(a)", "unsat"),
    (["Start(a) = Time830AM", "ForAll(x, (Start(x) < Time900AM -> Early(x)))"], "Early(a)", "unsat"),
    (["ForAll(x, Exists(y, R(x, y)))"], "Exists(y, R(a, y))", "unsat"), (["ForAll(x, Exists(y, R(x, y)))"], "R(a, a)", "unknown"), (["bare"], "P(a)", "unknown"),
])
def test_entailment(premises, conclusion, result):
    assert logic.entails_plain(premises, conclusion)["result"] == result


def test_core_is_minimal():
    found = logic.entails_plain(["Q(b)", "Human(socrates)", "R(c)", "ForAll(x, (Human(x) -> Mortal(x)))"], "Mortal(socrates)")
    assert found["unsat_core"] == ["p_2", "p_4", "neg_conclusion"]


def test_prover_against_truth_tables():
    rng = random.Random(3)
    atoms = ["P(a)", "P(b)", "Q(a)", "Q(b)"]

    def draw(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(atoms)
        kind = rng.choice(["NOT", "AND", "OR", "->", "<->"])
        return f"NOT ({draw(depth - 1)})" if kind == "NOT" else f"(({draw(depth - 1)}) {kind} ({draw(depth - 1)}))"

    def value(node, world):
        kind = node[0]
        if kind == "pred":
            return world[f"{node[1]}({node[2][0][1]})"]
        if kind == "not":
            return not value(node[1], world)
        a, b = value(node[1], world), value(node[2], world)
        return {"and": a and b, "or": a or b, "imp": not a or b, "iff": a == b}[kind]

    for _ in range(80):
        premises, conclusion = [draw(2) for _ in range(3)], draw(2)
        parsed = [logic.Parser().parse(f) for f in (*premises, conclusion)]
        worlds = [dict(zip(atoms, v, strict=True)) for v in itertools.product([False, True], repeat=4)]
        follows = all(value(parsed[-1], w) for w in worlds if all(value(f, w) for f in parsed[:-1]))
        assert logic.entails_plain(premises, conclusion)["result"] == ("unsat" if follows else "sat")


def test_language(spark):
    assert one(spark, language.parse_options(F.col("a")), "Pick. A) red B) blue") == {"A": "red", "B": "blue"}
    assert one(spark, language.parse_options(F.col("a")), "A: one\nmore\nB: two") == {"A": "one\nmore", "B": "two"}
    assert one(spark, language.parse_options(F.col("a")), "A.one\nb.two\nthree") == {"A": "one", "B": "two\nthree"}
    assert one(spark, language.parse_options(F.col("a")), "Nothing here") == {}
    assert one(spark, language.clean(F.col("a")), " The Dog's-House ") == "thedoghouse"
    assert one(spark, language.strip_framing(F.col("a")), "Is it true that birds fly?") == "Birds fly"
    assert one(spark, language.reasoning_steps(F.col("a")), "Step 1: add. Step 2: divide.") == ["add.", "divide."]
    assert one(spark, language.reasoning_steps(F.col("a")), "1. add\n2. divide") == ["add", "divide"]
    assert one(spark, language.first_number(F.col("a")), "about twelve or so") == "12" and one(spark, language.first_number(F.col("a")), "x 3.5 y") == "3.5"
    assert one(spark, language.bare(F.col("a")), "Stored in the Coil: 5!") == "stored 5"
    df = spark.createDataFrame([(["Bob sings.", "No premise states whether Ann is tall"], "Is Ann tall?"), (["Ann is tall"], "Is Ann tall?")], "p array<string>, q string")
    assert [r.x for r in df.select(language.meta_premise(F.col("p"), F.col("q")).alias("x")).collect()] == [1, None]


def test_physics(spark):
    assert one(spark, physics.normalize_input(F.col("a")), "3×10⁻⁵ C  and ½ Ohms") == "3e-5 C and 1/2 ohm"
    r = one(spark, physics.value_unit_explanation(physics.normalize_output(F.col("a"))), "-2.5 V/m  upward")
    assert tuple(r) == (-2.5, "V/m", "upward")
    assert tuple(one(spark, physics.value_unit_explanation(F.col("a")), "none")) == (None, None, "none")
    assert one(spark, physics.preprocess(F.col("a")), "5 cm^2 and 3 kV and 2 g and 4 cm^-1") == "0.0005 m^2 and 3000 V and 0.002 kg and 400 m^-1"
    assert tuple(one(spark, physics.engineering(F.col("a"), F.col("b")), "2e-6", "F")) == ("2", "uF")
    assert tuple(one(spark, physics.engineering(F.col("a"), F.col("b")), "2e-6", "kV")) == ("2e-6", "kV")
    assert one(spark, physics.significant_figures(F.col("a")), "8.2e3") == 2
    df = spark.createDataFrame([(5e-8, 0.0, "0"), (2e-7, 0.0, "0"), (102.0, 100.0, "100"), (103.0, 100.0, "100")], "m double, t double, r string")
    assert [r.x for r in df.select(physics.numeric_match(F.col("m"), F.lit("V"), F.col("t"), F.lit("V"), F.col("r")).alias("x")).collect()] == [True, False, True, False]
    assert one(spark, physics.error_reason(F.col("a"), F.col("b")), "JSON decode error", "1") == "json_parse_error"
    assert one(spark, physics.error_reason(F.col("a"), F.col("b")), None, "nan") == "nan_answer"
    assert one(spark, physics.evaluation_reason(F.col("a"), F.col("b"), F.lit(None), F.lit(True)), None, "1") == "missing_correct"
    assert one(spark, physics.text_match(F.col("a"), F.col("b")), "x = it increases", "Increases") and not one(spark, physics.text_match(F.col("a"), F.col("b")), "", "Increases")
    assert physics.display.plain is not None and [one(spark, physics.display(F.lit(x))) for x in (0.00012345, 12.3456, 0.0)] == ["1.2345e-4", "12.35", "0"]
    assert one(spark, physics.response_unit(F.col("a")), "μΩ") == "uohm"


def test_quantities():
    assert quantity.unit_dimension("V/m") == quantity.unit_dimension("N/C")
    assert quantity.to_si_plain(2.0, "kV")["value"] == 2000.0 and quantity.to_si_plain(1.0, "g") == {"value": 0.001, "unit": "kg"}
    assert quantity.to_number_plain("33.6 x 10^5") == 33.6e5 and quantity.to_number_plain("\\frac{1}{4}") == 0.25 and quantity.to_number_plain("about 7 V") == 7.0
    assert quantity.run_code_plain("import os\nans = 1")["error"] and quantity.run_code_plain("x = 3\nans = sqrt(x*3)\nunit = 'V'")["ans"] == ["3.0"]
    assert quantity.symbolic_equal_plain("(a+b)**2", "a**2+2*a*b+b**2") is True and quantity.symbolic_equal_plain("a", "b") is False
    assert quantity.symbolic_equal_plain("sin(x)**2+cos(x)**2", "1") is True
    item = lambda raw, unit="": {"raw": raw, "unit": unit}
    assert quantity.matched_plain([item("2", "kV")], [item("2000", "V")]) and not quantity.matched_plain([item("2", "kV")], [item("2000", "A")])
    assert quantity.matched_plain([item("5", "N"), item("3", "A")], [item("3", "A"), item("5", "N")])
    assert not quantity.matched_plain([item("3")], [item("3"), item("3")])


def test_json(spark):
    assert one(spark, jsons.any_object(F.col("a")), 'Sure: {"a": 1} ok') == '{"a": 1}'
    r = one(spark, jsons.router_fields(F.col("a")), '```json\n{"domains": "Optics", "multi_state": "yes"}\n```')
    assert (r.domains, r.multi_state) == (["Optics"], False)
    r = one(spark, jsons.router_fields(F.col("a")), '{"domains": ["A", "B"], "multi_state": true}')
    assert (r.domains, r.multi_state) == (["A", "B"], True)
    assert one(spark, jsons.int_list(F.col("a")), "keep [1, 3, 4] only") == [1, 3, 4]
    for text, want in {'{"a": [1, 2': '{"a": [1, 2]}', 'x {"a": "b': '{"a": "b"}', "none": None, '{"a": 1, "b":': '{"a": 1, "b": null}', '{"a": 1} tail': '{"a": 1}', '["q\\': '["q"]', '{"a": 1, "b': '{"a": 1}', "[1, ": "[1]"}.items():
        assert one(spark, jsons.repaired(F.col("a")), text) == want
    assert one(spark, jsons.repaired(F.col("a")), None) is None


def test_powers_and_numbers_as_text(spark):
    for text, want in {"3*10^5 V": "3e5 V", "10^{-3}": "1e-3", "2.5 × 10⁻³ m": "2.5e-3 m", "4 . 10^2": "4e2", "3 10^5": "3 1e5", "x10^3": "x10^3"}.items():
        assert one(spark, physics.scientific_text(F.col("a")), text) == want
    assert one(spark, physics.equation_spacing(F.col("a")), "a = 3 - 2 * b - c") == "a=3-2*b - c"
    assert [physics.format_scientific_plain(x) for x in (0.0, 12.5, 1e-4, 1e-5, -2.5e20, 123456789012345.0)] == ["0", "12.5", "0.0001", "1e-5", "-2.5e20", "123456789012345"]
    assert [physics.coefficient_plain(x) for x in (0.0, 2.5, 1.5e-6, 1e16, -1200.0)] == ["0", "2.5", "0.0000015", "10000000000000000", "-1200"]
    assert formula.split_name_plain("isVeryGood_student2HTTPServer") == ["is", "Very", "Good", "student2", "HTTP", "Server"]


def test_cut_json_is_repaired(spark):
    """Every prefix of nested values, with brackets, quotes and backslashes in its texts, against the rule in plain Python."""
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(5 if depth < 4 else 2)
        if kind == 0:
            return rng.choice([1, -2.5, True, None, 1e9])
        if kind == 1:
            return "".join(rng.choice('ab"\\{}[],:é𝄞 ') for _ in range(rng.randint(0, 6)))
        return [value(depth + 1) for _ in range(rng.randint(0, 3))] if kind < 4 else {f"k{k}": value(depth + 1) for k in range(rng.randint(0, 3))}

    whole = [json.dumps([value(0), value(0)], ensure_ascii=False) for _ in range(60)]
    cuts = [(x, x[:k]) for x in whole for k in range(1, len(x) + 1)]
    found = spark.createDataFrame(cuts, "whole string, a string").select("whole", "a", jsons.repaired(F.col("a")).alias("r")).collect()
    assert all(json.loads(r.r) == json.loads(r.whole) for r in found if r.a == r.whole)
    for r in found:
        opened, quoted, escaped = [], False, False
        for c in r.a:
            if quoted:
                quoted, escaped = escaped or c != '"', not escaped and c == "\\"
            elif c == '"':
                quoted = True
            elif c in "{[":
                opened.append("}" if c == "{" else "]")
            elif c in "}]":
                opened.pop()
        closing, text = "".join(reversed(opened)), (r.a.rstrip("\\") if escaped else r.a) + '"' * quoted
        bare = text.rstrip()
        tries = [text, bare.rstrip(","), bare.rstrip(":") + ": null" if bare.endswith(":") else text, text.rsplit(",", 1)[0]]
        assert r.r == next((t + closing for t in tries if _parses(t + closing)), text + closing), r.a


def _parses(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def test_augmentation(spark):
    rows = [("e1", "s", [f"n{i}" for i in range(5)], [f"P{i}(a)" for i in range(5)], "q"), ("e2", None, ["n"], ["P(a)"], "q")]
    df = spark.createDataFrame(rows, "example_id string, dataset_source string, premises_nl array<string>, premises_fol array<string>, question string")
    (r,) = augment.permuted(df).collect()
    assert r.example_id == "e1_perm_var0" and sorted(zip(r.premises_nl, r.premises_fol, strict=True)) == sorted(zip(rows[0][2], rows[0][3], strict=True)) and r.premises_nl != rows[0][2]
    found = augment.anonymised_plain(["Socrates is human."], ["Human(socrates)"], "Is Socrates human?", "names", 0)
    assert "Socrates" not in found["premises_nl"][0] and "socrates" not in found["premises_fol"][0]
    assert augment.anonymised_plain(["Nothing."], ["P(plato)"], "?", "names", 0) is None
    spans = augment.span_matches(spark.createDataFrame([("e", ["The big dog, it barks"], ["bigdog"])], "id string, s array<string>, c array<string>"), "id", "s", "c").collect()
    assert [r.span for r in spans] == ["big dog"]


def test_chains_are_followed_to_their_end(spark):
    long = spark.createDataFrame([(k, k + 1) for k in range(14)] + [(3, 9), (3, 3)], "source int, target int")
    assert {r.node: r.depth for r in profiling.chain_depths(long).collect()} == {k: 14 - k for k in range(14)}
    circle = spark.createDataFrame([(1, 2), (2, 1)], "source int, target int")
    assert {r.depth for r in profiling.chain_depths(circle, 4).collect()} == {4}
    with pytest.raises(ValueError):
        profiling.chain_depths(circle)
    assert not profiling.chain_depths(circle.limit(0)).collect()


def test_lengths_are_whole(spark):
    for n in (1, 99, 100, 101, 250):
        row = profiling.lengths(spark.range(n), F.col("id")).first()
        assert (row.max_length, row.p99_length) == (n - 1, -(-n * 99 // 100) - 1) and abs(row.mean_length - (n - 1) / 2) < 1e-9
    assert tuple(profiling.lengths(spark.range(0), F.col("id")).first()) == (None, None, None)


@pytest.mark.parametrize(
    ("premises", "conclusion", "status"),
    [
        (["P(father(a))", "ForAll(x, P(x) -> Q(x))"], "Q(father(a))", "unsat"),
        (["ForAll(x, P(x) -> P(next(x)))", "P(a)"], "P(next(next(a)))", "unsat"),
        (["ForAll(x, P(x))", "a > 3"], "P(a)", "unsat"),
        (["ForAll(x, (P(x) -> Q(x)))", "P(n)", "n = 5"], "Q(n)", "unsat"),
        (["ForAll(x, P(x) -> Q(x))", "P(father(a))"], "Q(a)", "unknown"),
        (["P(father(a))"], "P(a)", "sat"),
    ],
)
def test_terms_that_quantifiers_run_over(premises, conclusion, status):
    parsed, numeric = logic.parse_set([*premises, conclusion])
    assert logic.Prover(numeric).refute([*parsed[:-1], ("not", parsed[-1])])[0] == status


@pytest.mark.parametrize("seed", range(60))
def test_prover_against_every_model(seed):
    """Formulas over three named individuals and two predicates, against all their models."""
    import itertools
    import random

    rng = random.Random(seed)

    def formula(depth, bound):
        kind = rng.choice(["atom", "not", "and", "or", "->", "all"] if depth else ["atom"])
        if kind == "atom":
            return f"{rng.choice('PQ')}({rng.choice(['a', 'b', 'c', *bound])})"
        if kind == "not":
            return f"NOT ({formula(depth - 1, bound)})"
        if kind == "all":
            name = "xyz"[len(bound)]
            return f"ForAll({name}, {formula(depth - 1, [*bound, name])})" if len(bound) < 3 else formula(0, bound)
        return f"(({formula(depth - 1, bound)}) {kind.upper()} ({formula(depth - 1, bound)}))"

    def holds(f, model, names):
        if f[0] == "pred":
            return model[f[1], names[f[2][0][1]]]
        if f[0] == "all":
            return all(holds(f[2], model, names | {f[1]: k}) for k in {k for _, k in model})
        if f[0] == "not":
            return not holds(f[1], model, names)
        a, b = (holds(x, model, names) for x in f[1:])
        return {"and": a and b, "or": a or b, "imp": not a or b}[f[0]]

    texts = [formula(3, []) for _ in range(4)] + ["(P(a)) OR (NOT P(a))", "(P(b)) OR (NOT P(b))", "(P(c)) OR (NOT P(c))"]
    parsed, numeric = logic.parse_set(texts)
    types = list(itertools.product((False, True), repeat=2))  # of an individual; one more of each type is all that two predicates can tell apart
    models = []
    for own in itertools.product(types, repeat=3):
        for n in range(5):
            for more in itertools.combinations(types, n):
                models.append({(p, k): t for k, both in enumerate([*own, *more]) for p, t in zip("PQ", both, strict=True)})
    possible = any(all(holds(f, m, {"a": 0, "b": 1, "c": 2}) for f in parsed) for m in models)
    prover = logic.Prover(numeric)
    found = prover.refute(parsed)[0]
    assert found == ("sat" if possible else "unsat") or found == "unknown" and prover.functions
