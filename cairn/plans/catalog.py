"""The queries of the engine over the driver's tables, each with its SQL where SQL can express it.

The tables hold no formulas, so formulas and quantities are made from keys inside the queries, alike in Spark and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import formula, jsons, language, logic, physics, quantity
from cairn.operators import augment, decisions, profiling, providers, records
from cairn.session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the tables: it gets a reader of tables by name."""

    def wrap(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return function(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql:
            SQL[function.__name__] = sql
        return function

    return wrap


_RANK = "md5({} || '#{}')"


def _split(keys: str, key: str, share: str = "0.9") -> str:
    """SQL of the keys' splits."""
    return f"select {key}, case when row_number() over (order by {_RANK.format(f'cast({key} as varchar)', 42)}) <= floor(count(*) over () * {share} + 1e-9) then 'train' else 'val' end as split from ({keys})"


@query(f"""with firsts as (select *, row_number() over (partition by k order by conv_id) as rn from (
    select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as k from conversations group by conv_id)),
  kept as (select conv_id, k from firsts where rn = 1), split as ({_split("select distinct k from kept", "k")})
  select split, role, count(*) as turns, count(distinct c.conv_id) as conversations, sum(length(c.text)) as chars
  from conversations c join kept using (conv_id) join split using (k) group by split, role""")
def training_prep(t):
    """Conversations folded to messages, deduplicated, split by content and counted by role."""
    conv = t("conversations")
    folded = records.messages(conv).withColumn("k", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"))
    split = records.group_split(records.first_by(folded, ["k"], ["conv_id"]), "k").select("conv_id", "split")
    out = conv.join(split, "conv_id").groupBy("split", "role")
    return out.agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


@query("select conv_id, count(*) as n, string_agg(role || ': ' || text, chr(10) order by turn) as body from conversations group by conv_id")
def messages_array(t):
    folded = records.messages(t("conversations"))
    return folded.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("body"))


@query("select doc_id, lang, source from (select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1")
def dedupe_first(t):
    return records.first_by(t("documents").select("doc_id", "lang", "source", "text"), ["text"], ["doc_id"]).select("doc_id", "lang", "source")


@query(f"with s as ({_split('select distinct source from documents', 'source', '0.8')}) select doc_id, split from documents join s using (source)")
def grouped_split(t):
    return records.group_split(t("documents").select("doc_id", "source"), "source", 0.8).select("doc_id", "split")


@query(f"""with o as ({_split("select distinct 'd' || doc_id as id from documents where doc_id % 3 > 0", "id")}),
  c as (select 'd' || (doc_id + 1) as base, 'd' || (doc_id + 1) || '_aug_var' || (doc_id % 2) as id from documents where doc_id % 3 = 0)
  select id as example_id, split from o union all select c.id, 'train' from c join o on o.id = c.base where o.split = 'train'""")
def lineage_split(t):
    docs = t("documents").select("doc_id")
    child = F.concat(F.lit("d"), (F.col("doc_id") + 1).cast("string"), F.lit("_aug_var"), (F.col("doc_id") % 2).cast("string"))
    named = docs.select(F.when(F.col("doc_id") % 3 == 0, child).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("example_id"))
    return records.lineage_split(named).select("example_id", "split")


@query(f"""with q as (select distinct text as k from (select text from documents where lang = 'en' union all select text from documents where lang = 'de')), s as ({_split('select k from q', 'k')})
  select doc_id, lang, split from documents join s on text = k where lang in ('en', 'de')""")
def question_split(t):
    docs = t("documents").select("doc_id", "lang", "text")
    a, b = records.question_split(docs.where("lang = 'en'"), docs.where("lang = 'de'"), "text")
    return a.unionByName(b).select("doc_id", "lang", "split")


@query("""with a as (select doc_id from documents where lang = 'en'), b as (select doc_id from documents where lang = 'fr'),
  h as (select doc_id, row_number() over (order by md5(cast(doc_id as varchar) || '#42')) as r, count(*) over () as n from a),
  p as (select doc_id, row_number() over (order by doc_id) as r, count(*) over () as n from b)
  select doc_id, 1 as phase from a union all select doc_id, 1 from p where r <= floor(n * 0.2 + 1e-9) union all select doc_id, 2 from b union all select doc_id, 2 from h where r <= n // 2""")
def phase_mix(t):
    docs = t("documents").select("doc_id", "lang")
    return records.two_phase_mix(docs.where("lang = 'en'"), docs.where("lang = 'fr'"), "doc_id", "doc_id").select("doc_id", "phase")


@query("""with r as (select doc_id, row_number() over (order by md5(cast(doc_id as varchar) || '#42')) as r, count(*) over () as n from documents)
  select doc_id, 2 + case when r <= 7 then 1 else 0 end as copies from r""")
def sample_replacement(t):
    docs = t("documents").select("doc_id")
    return records.sample_with_replacement(docs, "doc_id", 2 * docs.count() + 7).groupBy("doc_id").agg(F.count("*").cast("int").alias("copies"))


@query("select doc_id from documents order by md5(cast(doc_id as varchar) || '#42') limit 100")
def hash_sample(t):
    """A sample of 100: a sampling operator, so the limit is the feature."""
    return records.sample(t("documents").select("doc_id"), "doc_id", 100)


@query("select d.doc_id, coalesce(cast(l.quality as varchar), d.source) as answer, coalesce(cast(l.toxic as varchar), d.lang) as explanation from documents d left join labels l using (doc_id)")
def label_update(t):
    changes = t("labels").select("doc_id", F.col("quality").cast("string").alias("answer"), F.col("toxic").cast("string").alias("explanation"))
    return records.update(t("documents").select("doc_id", F.col("source").alias("answer"), F.col("lang").alias("explanation")), changes, "doc_id", ["answer", "explanation"])


_TOKENS = "select unnest(list_filter(regexp_split_to_array(lower(trim(text)), '[ \\t\\n\\r]+'), lambda x: x <> '')) as token from documents"
_COUNTS = f"(select token, count(*) as n from ({_TOKENS}) group by token)"


@query(f"select count(*) as vocabulary, sum(n) as tokens, count(*) filter (n = 1) as singletons, count(*) filter (n = 1) / sum(n) as oov from {_COUNTS}")
def vocab_profile(t):
    return profiling.vocabulary(profiling.counts(profiling.tokens(t("documents"))))


@query(f"select sum(n) filter (r <= floor(v * 0.1 + 1e-9)) / sum(n) as coverage from (select n, row_number() over (order by n desc) as r, count(*) over () as v from {_COUNTS})")
def top10_coverage(t):
    return profiling.top_share(profiling.counts(profiling.tokens(t("documents"))))


@query("select round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) as entropy from (select event_type, count(*) as n from events group by event_type)")
def entropy(t):
    return profiling.entropy(profiling.counts(t("events"), "event_type")).select(F.round("entropy", 9).alias("entropy"))


@query("select source, target, count(*) as n from (select event_type as source, lead(event_type) over (partition by user_id order by ts, event_id) as target from events) where target is not null group by source, target")
def transition_matrix(t):
    return profiling.transitions(t("events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""with s as (select distinct o_custkey as g, o_orderpriority as i from orders) select x.i as a, y.i as b, count(*) as n from s x join s y on x.g = y.g and x.i < y.i group by x.i, y.i""")
def cooccurrence(t):
    return profiling.cooccurrence(t("orders"), "o_custkey", "o_orderpriority")


@query("""select case when n = 1 then '1' when n <= 5 then '2-5' when n <= 10 then '6-10' else '11+' end as bucket, count(*) as keys, sum(n) as records from (select text, count(*) as n from documents group by text) group by 1""")
def freq_histogram(t):
    return profiling.frequency_histogram(t("documents").select("text"), "text")


@query("select count(*) as records, count(distinct text) as stories, count(*) / count(distinct text) as reuse from documents")
def reuse_ratio(t):
    return profiling.reuse(t("documents"), "text")


@query("select count(*) as entities, avg(case when s > 1 then 1.0 else 0.0 end) as repeated_share, avg(s) as mean_span from (select l_partkey, count(distinct l_orderkey) as s from lineitem group by l_partkey)")
def entity_repetition(t):
    return profiling.repetition(t("lineitem"), "l_partkey", "l_orderkey")


@query("select avg(length(text)) as mean_length, max(length(text)) as max_length, (select length(text) from documents order by length(text) limit 1 offset (select cast(ceil(count(*) * 0.99) as bigint) - 1 from documents)) as p99_length from documents")
def length_stats(t):
    return profiling.lengths(t("documents"), F.length("text"))


_DOMAINS = "select lang as key, count(*) as n from documents where {} group by lang"


@query(f"""select coalesce(a.key, b.key) as key, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b, coalesce(a.n, 0) / (select count(*) from documents where doc_id % 2 = 0) as share_a,
  coalesce(b.n, 0) / (select count(*) from documents where doc_id % 2 = 1) as share_b from ({_DOMAINS.format("doc_id % 2 = 0")}) a full join ({_DOMAINS.format("doc_id % 2 = 1")}) b on a.key = b.key""")
def domain_comparison(t):
    """Domains of two datasets: the documents of even and of odd ids."""
    docs = t("documents").select("doc_id", "lang")
    return profiling.compared(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "lang")


@query("""with s as (select doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '[ \\t\\n\\r]+'), lambda x: x <> ''))) as w from documents),
  d as (select min(doc_id) as k, w from s group by w),
  t as (select k, len(w) as n, unnest(w) as token from d), p as (select x.k as a, y.k as b, x.n as na, y.n as nb, count(*) as c from t x join t y on x.token = y.token and x.k < y.k group by 1, 2, 3, 4)
  select a, b, c / (na + nb - c) as jaccard from p where c / (na + nb - c) >= 0.8""")
def jaccard_pairs(t):
    """Pairs of different word sets of documents with Jaccard similarity 0.8 or more, by prefix filter."""
    words = F.filter(F.split(F.lower(F.trim("text")), r"[ \t\n\r]+"), lambda w: w != "")
    return profiling.jaccard_pairs(t("documents").select("doc_id", words.alias("w")), "doc_id", "w")


@query("select count(*) as questions, count(*) filter (t in (select trim(lower(text)) from documents)) as shared from (select distinct trim(lower(text)) as t from benchmark)")
def question_overlap(t):
    key = F.trim(F.lower("text")).alias("t")
    docs = t("documents").select(key).distinct().withColumn("hit", F.lit(1))
    return t("benchmark").select(key).distinct().join(docs, "t", "left").agg(F.count("*").alias("questions"), F.count("hit").alias("shared"))


@query("""with recursive e as (select distinct p_partkey % 40 as s, p_partkey % 40 + 1 + p_size % 7 as t from part where p_partkey % 40 + 1 + p_size % 7 < 40),
  d as (select distinct s as node, 1 as depth from e union select e.s, d.depth + 1 from e join d on e.t = d.node) select node, max(depth) as depth from d group by node""")
def implication_depth(t):
    node = F.col("p_partkey") % 40
    edges = t("part").select(node.alias("source"), (node + 1 + F.col("p_size") % 7).alias("target")).where("target < 40")
    return profiling.chain_depths(edges)


@query("select avg(n) as mean_targets, max(n) as max_targets from (select p_partkey % 40 as s, count(distinct p_partkey % 40 + 1 + p_size % 7) as n from part where p_partkey % 40 + 1 + p_size % 7 < 40 group by 1)")
def branching_factor(t):
    node = F.col("p_partkey") % 40
    return profiling.branching(t("part").select(node.alias("source"), (node + 1 + F.col("p_size") % 7).alias("target")).where("target < 40"))


@query("""select 'and' as operator, sum(len(regexp_extract_all(lower(text), '[a-z]*and[a-z]*'))) as total, avg(case when regexp_matches(lower(text), 'and') then 1.0 else 0.0 end) as share from documents
  union all select 'pipe', sum(length(text) - length(replace(text, '|', ''))), avg(case when contains(text, '|') then 1.0 else 0.0 end) from documents""")
def operator_coverage(t):
    return profiling.operator_coverage(t("documents").select(F.lower("text").alias("text")), "text", {"and": "[a-z]*and[a-z]*", "pipe": r"\|"})


@query("""select class, count(*) as n from (select case when l_linenumber <= 1 and l_quantity <= 4 and l_suppkey % 20 <= 4 then 'easy' when l_linenumber <= 3 and l_quantity <= 8 and l_suppkey % 20 <= 10 then 'medium' else 'hard' end as class from lineitem) group by class""")
def difficulty_classes(t):
    return t("lineitem").select(profiling.difficulty(F.col("l_linenumber"), F.col("l_quantity"), F.col("l_suppkey") % 20).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("select event_type, sum(cast(json_extract_string(props, '$.k') as bigint)) as total, count(*) as n from events group by event_type")
def json_fields(t):
    reply = F.concat(F.lit("Here: "), F.col("props"), F.lit(" done"))
    k = F.try_variant_get(F.try_parse_json(jsons.any_object(reply)), "$.k", "bigint")
    return t("events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


@query("""select event_id, 'T' || k as domains, k % 2 = 0 as multi_state from (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events)""")
def router_fields(t):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('```json\n{"domains": "T'), k, F.lit('", "multi_state": '), F.when(k.cast("int") % 2 == 0, "true").otherwise('"no"'), F.lit("}\n```"))
    out = t("events").select("event_id", jsons.router_fields(text).alias("r"))
    return out.select("event_id", F.array_join("r.domains", ",").alias("domains"), F.col("r.multi_state").alias("multi_state"))


@query("select event_type, (r - 1) // 25 as chunk, count(*) as n, min(event_id) as first_id, sum(event_id) as total from (select event_type, event_id, row_number() over (partition by event_type order by event_id) as r from events) group by 1, 2")
def chunk25(t):
    rows = records.chunks(t("events").withColumn("v", F.col("event_id")), ["event_id"], "v", ["event_type"])
    return rows.select("event_type", F.col("chunk").cast("long").alias("chunk"), F.size("items").cast("long").alias("n"), F.get("items", F.lit(0)).alias("first_id"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("select p_partkey, cast(p_partkey as double) / 4 as value, 'V/m' as unit, 'at point ' || p_size as explanation from part")
def value_unit_extract(t):
    text = F.concat((F.col("p_partkey") / 4).cast("decimal(20,2)").cast("string"), F.lit("  V/m at point "), F.col("p_size").cast("string"))
    out = t("part").select("p_partkey", physics.value_unit_explanation(physics.normalize_output(text)).alias("v"))
    return out.select("p_partkey", "v.value", "v.unit", "v.explanation")


@query("select o_orderkey, nullif(length(ltrim(replace(cast(o_custkey as varchar) || '.' || (o_orderkey % 100), '.', ''), '0')), 0) as figures from orders")
def sig_figs(t):
    raw = F.concat(F.lit("-"), F.col("o_custkey").cast("string"), F.lit("."), (F.col("o_orderkey") % 100).cast("string"), F.lit("e3"))
    return t("orders").select("o_orderkey", physics.significant_figures(raw).cast("long").alias("figures"))


@query("""select l_orderkey, l_linenumber, abs(l_quantity * 1.015 - (l_quantity + l_linenumber % 2)) <= 0.02 * (l_quantity + l_linenumber % 2)
  or abs(l_quantity * 1.015 - (l_quantity + l_linenumber % 2)) <= 1.05 * pow(10.0, floor(log10(l_quantity + l_linenumber % 2)) - (length(ltrim(cast(cast(l_quantity + l_linenumber % 2 as bigint) as varchar), '0')) - 1)) as matched from lineitem""")
def tolerance_match(t):
    truth = F.col("l_quantity") + F.col("l_linenumber") % 2
    return t("lineitem").select("l_orderkey", "l_linenumber", physics.numeric_match(F.col("l_quantity") * 1.015, F.lit("V"), truth, F.lit("V"), truth.cast("bigint").cast("string")).alias("matched"))


@query("""select count(*) as total, coalesce(sum(case when quality = toxic then 1.0 else 0.0 end) / count(*), 0) * 100 as same, coalesce(sum(case when quality = 1 and toxic = 0 then 1.0 else 0.0 end) / nullif(sum(case when quality = 1 then 1.0 else 0.0 end), 0), 0) * 100 as clean, 0.0 as none from labels""")
def metric_rollup(t):
    one = F.lit(1)
    good = (F.col("quality") == 1).cast("int")
    return profiling.metrics(t("labels"), {"same": ((F.col("quality") == F.col("toxic")).cast("int"), one), "clean": (good * (F.col("toxic") == 0).cast("int"), good), "none": (F.lit(0), F.lit(0))})


@query("select c_custkey, repeat('(', c_custkey % 4) || 'P' || repeat(')', c_custkey % 4) as formula from customer")
def paren_repair(t):
    n = F.col("c_custkey")
    text = F.concat(F.repeat(F.lit("("), (n % 4).cast("int")), F.lit("P"), F.repeat(F.lit(")"), (n % 7).cast("int")))
    return t("customer").select("c_custkey", formula.repair_parentheses(text).alias("formula"))


def _rule(key: str):
    return F.expr(f"concat('ForAll(a', {key} % 9, ', (P', {key} % 5, '(a', {key} % 9, ') -> Exists(other, R(a', {key} % 9, ', other))))')")


@query("select o_orderkey, 'ForAll(x, (P' || (o_orderkey % 5) || '(x) -> Exists(y, R(x, y))))' as formula from orders")
def canonicalise(t):
    return t("orders").select("o_orderkey", formula.canonical_variables(_rule("o_orderkey")).alias("formula"))


@query("select 'ForAll(VAR_0, (VAR_1(VAR_0) -> Exists(VAR_2, VAR_3(VAR_0, VAR_2))))‖VAR_0(VAR_1)' as structure, count(*) as n, count(distinct o_orderkey % 45) as formulas from orders")
def structure_key(t):
    """Orders' formulas share one structure; keys are found once for each different pair of formulas."""
    pairs = t("orders").select(F.array(_rule("o_orderkey"), F.lit("Q(c)")).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    return pairs.select(formula.structure_key("f").alias("structure"), "n").groupBy("structure").agg(F.sum("n").alias("n"), F.count("*").alias("formulas"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'Expected '','', got ''P0''' when 1 then 'Predicate expected, got term' when 2 then '' else '' end as message, o_orderkey % 4 > 1 as valid from orders")
def fol_validate(t):
    texts = F.element_at(F.array(F.lit("ForAll(x P0(x))"), F.lit("depleted_fund"), F.lit("ForAll(x, ForAll(y, P(x, y)))"), F.lit("depleted_fund() AND NOT Q(c)")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    orders = t("orders").select("o_orderkey", texts.alias("f"))
    judged = orders.select("f").distinct().withColumn("p", logic.try_parse("f"))
    return orders.join(judged, "f").select("o_orderkey", "p.message", "p.valid")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then 'Length mismatch: 2 NL premises, 1 FOL premises' else 'Formula 0: Predicate expected, got term' end as validation_error from orders""")
def validation_partition(t):
    nl = F.when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    fol = F.when(F.col("o_orderkey") % 3 == 2, F.array(F.lit("bare"))).otherwise(F.array(F.lit("P(a)")))
    out = records.validated(t("orders").select("o_orderkey", nl.alias("premises-NL"), fol.alias("premises-FOL")))
    return out.select("o_orderkey", F.coalesce("validation_error", F.lit("")).alias("validation_error"))


@query("""select c_custkey, case when c_custkey % 3 = 2 then 'Uncertain' when c_custkey % 200 >= 120 then 'Yes' else case when c_custkey % 3 = 1 then 'No' else 'Uncertain' end end as answer,
  case when c_custkey % 3 = 2 then 1.0 when c_custkey % 200 >= 120 then round(0.75 + 0.25 * (1 - 2 / 3.0), 4) when c_custkey % 3 = 1 then round(0.75 + 0.25 * (1 - 2 / 3.0), 4) else 0.6 end as confidence from customer""")
def entailment(t):
    """Eligibility by credits; every different question is proven once and joined back."""
    k = F.col("c_custkey")
    rows = t("customer").select("c_custkey", F.concat_ws("#", (k % 3).cast("string"), (k % 200).cast("string")).alias("id"))
    cases = t("customer").select((k % 3).alias("m"), (k % 200).alias("v")).distinct()
    rule = F.when(F.col("m") == 1, "ForAll(x, (Credits(x) < 120 -> NOT Eligible(x)))").otherwise("ForAll(x, (Other(x) -> Other(x)))")
    nl = F.when(F.col("m") == 2, F.array(F.lit("It is unknown whether student a is eligible"))).otherwise(F.array(F.lit("Rules apply")))
    cases = cases.select(F.concat_ws("#", F.col("m").cast("string"), F.col("v").cast("string")).alias("id"), nl.alias("premises_nl"), F.array(F.lit("ForAll(x, (Credits(x) >= 120 -> Eligible(x)))"), F.concat(F.lit("Credits(a) = "), F.col("v").cast("string")), rule).alias("premises_fol"), F.lit("Is student a eligible?").alias("question"), F.lit("Eligible(a)").alias("conclusion_fol"))
    return rows.join(decisions.yes_no(cases), "id").select("c_custkey", "answer", "confidence")


@query("select n_nationkey, case n_nationkey % 3 when 0 then 'A' when 1 then 'B' else 'C' end as answer from nation")
def mcq(t):
    k = F.col("n_nationkey") % 3
    facts = F.array(F.lit("ForAll(x, (P(x) -> Q(x)))"), F.element_at(F.array(F.lit("P(a)"), F.lit("NOT Q(a)"), F.lit("ForAll(x, R(x))")), (k + 1).cast("int")))
    options = F.create_map(F.lit("A"), F.lit("Q(a)"), F.lit("B"), F.lit("NOT P(a)"), F.lit("C"), F.lit("R(a)"))
    return decisions.single_choice(t("nation").select(F.col("n_nationkey").alias("id"), facts.alias("premises_fol"), options.alias("options"))).select(F.col("id").alias("n_nationkey"), "answer")


@query("select n_nationkey, 'A,C' as answer, 'neg_conclusion,p_1,p_2,p_3' as core, true as all_unsat from nation")
def mcq_multiple(t):
    facts = F.array(F.lit("ForAll(x, (P(x) -> Q(x)))"), F.lit("P(a)"), F.lit("R(a)"))
    options = F.create_map(F.lit("A"), F.lit("Q(a)"), F.lit("B"), F.lit("NOT P(a)"), F.lit("C"), F.lit("R(a)"))
    out = decisions.multiple_choice(t("nation").select(F.col("n_nationkey").alias("id"), facts.alias("premises_fol"), options.alias("options")))
    return out.select(F.col("id").alias("n_nationkey"), F.array_join("answer", ",").alias("answer"), F.array_join("unsat_core", ",").alias("core"), "all_unsat")


@query("""select l_orderkey, l_linenumber, case l_returnflag when 'A' then round(least(1.0, greatest(0.0, 0.75 + 0.25 * (1 - (l_linenumber - 1) / greatest(l_suppkey % 9, l_linenumber, 1)))), 4) when 'N' then 0.6 else 0.3 end as confidence from lineitem""")
def confidence(t):
    result = F.when(F.col("l_returnflag") == "A", "unsat").when(F.col("l_returnflag") == "N", "sat").otherwise("unknown")
    return t("lineitem").select("l_orderkey", "l_linenumber", decisions.confidence(result, F.col("l_linenumber"), F.col("l_suppkey") % 9).alias("confidence"))


@query("select o_orderkey, case o_orderkey % 5 when 0 then 'multiple_choice' when 1 then 'single_choice' when 2 then 'yes_no' when 3 then 'open_ended' else 'yes_no' end as kind from orders")
def question_types(t):
    texts = F.element_at(F.array(F.lit("Select all that apply. A) red B) blue"), F.lit("Which holds? A. one B. two"), F.lit("Is it proven?"), F.lit("Who passed?"), F.lit("Student A passed.")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    orders = t("orders").select("o_orderkey", texts.alias("q"))
    kinds = orders.select("q").distinct().withColumn("o", language.parse_options("q"))
    return orders.join(kinds, "q").select("o_orderkey", language.question_type(F.col("q"), F.col("o")).alias("kind"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'Yes' when 1 then 'No' when 2 then 'Uncertain' else 'other' end as answer, (o_orderkey % 3) || '' as used from orders")
def option_mapping(t):
    answer = F.element_at(F.array(F.lit("yes"), F.lit("B"), F.lit("2"), F.lit("other")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    used = decisions.premises_used(F.array(F.concat(F.lit("p_"), (F.col("o_orderkey") % 3 + 1).cast("string")), F.lit("neg_conclusion")), F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return t("orders").select("o_orderkey", decisions.mapped_to_options(F.array(answer), F.array(F.lit("Yes"), F.lit("No"), F.lit("Uncertain"))).alias("answer"), F.array_join(used, ",").alias("used"))


@query("select p_partkey, '2' as ans, case p_size % 3 when 0 then 'uF' when 1 then 'mm^2' else 'kV' end as unit from part")
def eng_prefix(t):
    k = (F.col("p_size") % 3 + 1).cast("int")
    rows = t("part").select("p_partkey", F.element_at(F.array(F.lit("2e-6"), F.lit("2e-6"), F.lit("2")), k).alias("a"), F.element_at(F.array(F.lit("F"), F.lit("m^2"), F.lit("kV")), k).alias("u"))
    return rows.withColumn("r", physics.engineering(F.col("a"), F.col("u"))).select("p_partkey", "r.ans", "r.unit")


@query("select p_partkey, 'A plate of 0.0005 m^2 at ' || p_size || '000 V' as text from part where p_size > 0")
def si_preprocess(t):
    return t("part").where("p_size > 0").select("p_partkey", physics.preprocess(F.concat(F.lit("A plate of 5 cm^2 at "), F.col("p_size").cast("string"), F.lit(" kV"))).alias("text"))


@query("select p_partkey, p_size % 4 <> 3 as matched from part")
def answer_match(t):
    """Answers in other units, other order, or another form; each different case is judged once."""
    k = F.col("p_size") % 4
    item = lambda raw, unit: F.struct(F.lit(raw).alias("raw"), F.lit(unit).alias("unit"))
    rows = t("part").select("p_partkey", k.alias("k"))
    pick = lambda *x: F.element_at(F.array(*x), (F.col("k") + 1).cast("int"))
    cases = rows.select("k").distinct().withColumns({"m": pick(F.array(item("2", "kV")), F.array(item("5", "N"), item("3", "A")), F.array(item("2*a*b", "")), F.array(item("100", "V"))), "t": pick(F.array(item("2000", "V")), F.array(item("3", "A"), item("5.05", "N")), F.array(item("b*(a+a)", "")), F.array(item("100", "A")))})
    return rows.join(cases.select("k", quantity.matched("m", "t").alias("matched")), "k").select("p_partkey", "matched")


@query("select p_partkey, case p_size % 4 when 0 then 'json_parse_error' when 1 then 'code_name_error' when 2 then 'match' else 'missing_correct' end as reason from part")
def reason_codes(t):
    k = (F.col("p_size") % 4 + 1).cast("int")
    error = F.element_at(F.array(F.lit("JSON decode failed"), F.lit("NameError: x"), F.lit(None).cast("string"), F.lit(None).cast("string")), k)
    return t("part").select("p_partkey", physics.evaluation_reason(F.when(k < 4, "1"), F.lit("1"), error, F.lit(True)).alias("reason"))


@query("select o_orderkey, 4 as premises, count(*) as kept from orders, (values (1), (2), (3), (4)) v(i) group by o_orderkey")
def permute(t):
    """Permuted premises: pairs stay together and none is lost."""
    k = F.col("o_orderkey").cast("string")
    nl = F.array(*[F.concat(F.lit(f"n{i} "), k) for i in range(4)])
    fol = F.array(*[F.concat(F.lit(f"P{i}("), k, F.lit(")")) for i in range(4)])
    rows = t("orders").select("o_orderkey", F.concat(F.lit("e"), k).alias("example_id"), F.lit("s").alias("dataset_source"), nl.alias("premises_nl"), fol.alias("premises_fol"))
    out = augment.permuted(rows).where(F.col("premises_nl") != nl)
    kept = F.size(F.filter(F.arrays_zip("premises_nl", "premises_fol"), lambda p: F.substring(p["premises_nl"], 2, 1) == F.substring(p["premises_fol"], 2, 1)))
    return out.select("o_orderkey", F.size("premises_nl").alias("premises"), kept.cast("long").alias("kept"))


@query()
def anonymise(t):
    """Entities of generated samples renamed; random names, so rows only."""
    who = F.element_at(F.array(F.lit("socrates"), F.lit("plato"), F.lit("kant")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    rows = t("nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("example_id"), F.lit("s").alias("dataset_source"), F.array(F.concat(F.initcap(who), F.lit(" is human.")), F.lit("All humans are mortal.")).alias("premises_nl"), F.array(F.concat(F.lit("Human("), who, F.lit(")")), F.lit("ForAll(x, (Human(x) -> Mortal(x)))")).alias("premises_fol"), F.concat(F.lit("Is "), F.initcap(who), F.lit(" mortal?")).alias("question"))
    return augment.anonymised(rows, "names", 2).select("example_id", "dataset_source", "premises_nl", "premises_fol", "question")


@query()
def hard_negatives(t):
    """Mutated samples relabelled by the prover; random mutations, so rows only."""
    rows = t("nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("example_id"), F.lit("s").alias("dataset_source"), F.array(F.lit("a"), F.lit("b")).alias("premises_nl"), F.array(F.lit("Human(socrates) AND Greek(socrates)"), F.lit("ForAll(x, (Human(x) -> Mortal(x)))")).alias("premises_fol"), F.lit("Is Socrates mortal?").alias("question"), F.lit("Mortal(socrates)").alias("conclusion_fol"), F.lit("True").alias("answer"))
    return augment.hard_negatives(rows, 2).select("example_id", "premises_fol", "answer")


@query("select p_partkey, case p_size % 3 when 0 then 'Capacitance' when 1 then 'DC_Circuits' else 'General' end as domain, p_size % 3 = 1 as multi_state from part")
def router_rules(t):
    texts = F.element_at(F.array(F.lit("Find the capacity."), F.lit("Two resistors, then one."), F.lit("Describe it.")), (F.col("p_size") % 3 + 1).cast("int"))
    out = providers.routed(t("part").select("p_partkey", texts.alias("question")))
    return out.select("p_partkey", F.get("domains", F.lit(0)).alias("domain"), "multi_state")


@query("select o_orderkey, case when o_orderkey % 2 = 0 then '10.0' else null end as ans, case when o_orderkey % 2 = 0 then 'V' else null end as unit, case when o_orderkey % 2 = 0 then '' else 'NameError: name ''y'' is not defined' end as error from orders")
def safe_code(t):
    """Model-written code read as plain assignments; each different reply is read once."""
    code = F.when(F.col("o_orderkey") % 2 == 0, F.lit('{"python_code": "x = 5.0\\nans = x * 2\\nunit = \'V\'"}')).otherwise(F.lit('{"python_code": "ans = y"}'))
    orders = t("orders").select("o_orderkey", code.alias("reply"))
    solved = providers.solved(orders.select("reply").distinct())
    return orders.join(solved, "reply").select("o_orderkey", F.get("ans", F.lit(0)).alias("ans"), F.get("unit", F.lit(0)).alias("unit"), F.coalesce("content_error", F.lit("")).alias("error"))


@query("select p_partkey, case p_size % 2 when 0 then 'Time930AM starts Duration4Hours DrZee' else '25C for DrJohnSmith' end as premise, 'ForAll(x, P(x) -> Q(x) AND NOT R(x))' as formula from part")
def premise_text(t):
    texts = F.when(F.col("p_size") % 2 == 0, "9:30 AM starts 4 hours Dr. Zee").otherwise("25 °C for Dr John Smith")
    rows = t("part").select("p_partkey", texts.alias("s"))
    cases = rows.select("s").distinct().withColumns({"premise": formula.normalize_premise("s"), "formula": formula.normalize_formula(F.lit("∀x P(X) → Q(x) ∧ ¬R(x)"))})
    return rows.join(cases, "s").select("p_partkey", "premise", "formula")


@query("select o_orderkey, 'Predicates: P' || (o_orderkey % 5) || ', Q, R' || chr(10) || 'Constants: c' || (o_orderkey % 9) || ', dd' as glossary from orders")
def glossary(t):
    f = F.array(_rule("o_orderkey"), F.concat(F.lit("Q(c"), (F.col("o_orderkey") % 9).cast("string"), F.lit(", dd)")))
    return t("orders").select("o_orderkey", formula.glossary_text(f).alias("glossary"))


@query("select doc_id, source from documents where text in (select text from documents where doc_id % 2 = 0)")
def semi_join(t):
    docs = t("documents")
    return records.in_questions(docs, docs.where("doc_id % 2 = 0"), "text").select("doc_id", "source")


@query("""select item_id, len(list_intersect(w, v)) / greatest(len(w), len(v)) as ratio, len(w) - len(list_intersect(w, v)) as missing from (
  select item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\n.,]+'), lambda x: x <> '')) as w, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\n.,]+'), lambda x: x <> '' and not contains(x, 'th'))) as v from benchmark)""")
def word_sets(t):
    """Words of the items against those of them that lack a `th`."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \n.,]+"), lambda w: w != ""))
    rows = t("benchmark").select("item_id", words.alias("w")).withColumn("v", F.filter("w", lambda w: ~w.contains("th")))
    return rows.select("item_id", language.overlap(F.col("w"), F.col("v")).alias("ratio"), F.size(F.array_except("w", "v")).alias("missing"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'P(a)|Q(b)' when o_orderkey % 3 = 1 then 'P(a)' else '' end as formulas from orders")
def reply_formulas(t):
    """Formulas of model replies: a JSON list, numbered lines, or none."""
    texts = F.element_at(F.array(F.lit('["P(a)", "Q(b)"]'), F.lit("1. P(a)\nNotes: x\nQ(b)"), F.lit("Explanation: none")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    orders = t("orders").select("o_orderkey", texts.alias("r"))
    return orders.join(orders.select("r").distinct().withColumn("f", formula.extract_formulas("r")), "r").select("o_orderkey", F.array_join("f", "|").alias("formulas"))


@query("""select o_orderkey, case when o_orderkey % 2 = 0 then '{"domains": ["A", "B"]}' else '{"a": "b"}' end as json from orders""")
def json_repair(t):
    texts = F.when(F.col("o_orderkey") % 2 == 0, 'So {"domains": ["A", "B"').otherwise('{"a": "b')
    orders = t("orders").select("o_orderkey", texts.alias("r"))
    return orders.select("o_orderkey", jsons.repaired(F.col("r")).alias("json"))


@query("select p_partkey, p_size % 3 <> 2 as matched from part")
def text_match(t):
    k = (F.col("p_size") % 3 + 1).cast("int")
    model = F.element_at(F.array(F.lit("x = It increases!"), F.lit("5.04 V"), F.lit("")), k)
    truth = F.element_at(F.array(F.lit("increases"), F.lit("5"), F.lit("increases")), k)
    return t("part").select("p_partkey", physics.text_match(model, truth).alias("matched"))


@query("select c_custkey as id, case c_nationkey % 3 when 0 then 'policy AFRICA' when 1 then 'policy ASIA' || chr(10) || chr(10) || 'example ASIA' else '' end as prompt from customer")
def policy_blocks(t):
    region = t("region").where("r_name in ('AFRICA', 'ASIA')")
    policies = region.select(F.col("r_name").alias("name"), F.concat(F.lit("policy "), F.col("r_name")).alias("text"))
    examples = region.where("r_name = 'ASIA'").select(F.col("r_name").alias("name"), F.lit("example ASIA").alias("text"))
    domains = F.element_at(F.array(F.array(F.lit("AFRICA")), F.array(F.lit("ASIA"), F.lit("NONE")), F.array(F.lit("NONE"))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return records.policy_block(t("customer").select(F.col("c_custkey").alias("id"), domains.alias("domains")), policies, examples)


@query("select event_id, case when event_id % 3 = 0 then 'mismatch' else null end as reason, case when event_id % 3 = 0 then 5 else null end as input_tokens from events where event_id % 3 <> 1")
def failure_rows(t):
    """Evaluations that aren't true: false and unknown ones."""
    k = F.col("event_id") % 3
    empty = F.lit(None).cast("string")
    answer = F.struct(F.lit("1").alias("ans"), F.lit("V").alias("unit"))
    rows = t("events").select(F.col("event_id").cast("string").alias("question"), answer.alias("correct"), answer.alias("model_answer"), empty.alias("raw_response"), empty.alias("error"), F.when(k == 0, F.create_map(F.lit("input"), F.lit(5))).alias("tokens"), F.when(k == 1, True).when(k == 0, False).alias("is_correct"), F.when(k == 0, "mismatch").alias("reason"))
    return records.failures(rows).select(F.col("question").cast("bigint").alias("event_id"), "reason", "input_tokens")


@query("select c_custkey, case when c_custkey % 2 = 0 then '30' else 'Unknown' end as answer from customer")
def open_questions(t):
    """Short answers to questions for numbers; the different cases are proven once."""
    rows = t("customer").select("c_custkey", (F.col("c_custkey") % 2).alias("id"))
    cases = rows.select("id").distinct()
    fact = F.when(F.col("id") == 0, "Count(b) = 30").otherwise("Other(b)")
    cases = cases.select("id", F.array(F.lit("Class B has thirty students")).alias("premises_nl"), F.array(fact).alias("premises_fol"), F.lit("How many students are in class B?").alias("question"), F.lit("There are many").alias("candidate"), F.lit("Count(b) >= 30").alias("conclusion_fol"))
    return rows.join(decisions.open_ended(cases).select("id", "answer"), "id").select("c_custkey", "answer")


from cairn.plans import corpus, relations, scores, texts  # noqa: E402, F401  register further queries
