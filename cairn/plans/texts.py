"""Queries over whole texts and record files, whose SQL works the same answers out of the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import jsons, language, physics
from cairn.operators import decisions, profiling, providers, records
from cairn.plans.catalog import query
from cairn.session import shared_folder
from cairn.sources import readers, writers


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query(r"""select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[''’]s\b', '', 'g'), '^(year|number)[\s_]*(.)', '\2', 's'), '[^a-z0-9]', '', 'g') as cleaned from conversations""")
def cleaned_text(t):
    return t("conversations").select("conv_id", "turn", language.clean(F.col("text")).alias("cleaned"))


@query(r"""select conv_id, turn, upper(q[1]) || q[2:] as statement from (select conv_id, turn,
  regexp_replace(regexp_replace(trim(q), '(?i)^(is it true that|does it follow that|can we conclude that|can it be concluded that|do the premises imply that|based on the premises,?|according to the premises,?|given the premises,?)\s*', ''), '\?+\s*$', '') as q
  from (select conv_id, turn, case when turn % 2 = 0 then 'Is it true that ' || text || '??' else 'given the Premises, ' || text end as q from conversations))""")
def statements(t):
    """Turns framed as questions, and back as statements."""
    framed = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Is it true that "), "text", F.lit("??"))).otherwise(F.concat(F.lit("given the Premises, "), "text"))
    return t("conversations").select("conv_id", "turn", language.strip_framing(framed).alias("statement"))


_WORD_LIST = "['" + "', '".join(language.NUMBER_WORDS) + "']"
_VALUE_LIST = "['" + "', '".join(language.NUMBER_WORDS.values()) + "']"


@query(rf"""select doc_id, coalesce(nullif(regexp_extract(text, '\b\d+(?:\.\d+)?\b'), ''), {_VALUE_LIST}[list_position({_WORD_LIST}, list_filter(regexp_extract_all(lower(text), '\b\w+\b'), lambda w: list_contains({_WORD_LIST}, w))[1])]) as number from documents""")
def first_numbers(t):
    return t("documents").select("doc_id", language.first_number(F.col("text")).alias("number"))


@query(r"""select doc_id, case when len(n) > 0 then len(n) else len(l) end as steps, length(case when len(n) > 0 then n[1] else l[1] end) as first_length
  from (select doc_id, regexp_extract_all(text, '(?m)^\s*\d+[.)]\s+(.*)$', 1) as n, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l from documents) where len(regexp_extract_all(lower(text_), 'step\s*\d')) = 0""".replace("select doc_id, regexp_extract_all(text, '(?m)", "select doc_id, text as text_, regexp_extract_all(text, '(?m)"))
def worked_steps(t):
    docs = t("documents").where(~F.regexp_like("text", F.lit(r"(?i)step\s*\d")))
    steps = docs.select("doc_id", language.reasoning_steps(F.col("text")).alias("s"))
    return steps.select("doc_id", F.size("s").cast("long").alias("steps"), F.length(F.trim(F.get("s", F.lit(0)))).cast("long").alias("first_length"))


@query("select conv_id, string_agg(r || '. ' || text, chr(10) order by r) as listed from (select conv_id, text, row_number() over (partition by conv_id order by turn) as r from conversations) group by conv_id")
def numbered_turns(t):
    folded = records.messages(t("conversations"))
    return folded.select("conv_id", records.numbered_list(F.transform("messages", lambda m: m["content"])).alias("listed"))


@query("""select conv_id, 'system:You are asked ' || count(*) || ' things.|user:' || arg_min(text, turn) || '|assistant:' || arg_max(text, turn) as chat from conversations group by conv_id""")
def chat_triples(t):
    """Training records: a system message, the first turn and the last one."""
    folded = records.messages(t("conversations"))
    system = F.concat(F.lit("You are asked "), F.size("messages").cast("string"), F.lit(" things."))
    chat = folded.select("conv_id", records.chat_record(system, F.element_at("messages", 1)["content"], F.element_at("messages", -1)["content"]).alias("c"))
    return chat.select("conv_id", F.array_join(F.transform("c", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("chat"))


@query("""select 'd' || doc_id || '_aug_var' || (doc_id % 3) as example_id, coalesce(source, 'unknown') || '-augmented-swap-var' || (doc_id % 3) as dataset_source, 'd' || doc_id as base from documents where doc_id % 2 = 0""")
def lineage_names(t):
    """Augmented rows named after their originals, kept by their source, and led back to their originals."""
    docs = t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("example_id"), F.col("source").alias("dataset_source"), "doc_id")
    made = records.lineage_columns(docs.where("doc_id % 2 = 0"), "swap", "aug", F.col("doc_id") % 3)
    both = records.augmented(docs.unionByName(made))
    return both.select("example_id", "dataset_source", records.base_id(F.col("example_id")).alias("base"))


@query("""select d.doc_id from documents d left join labels l using (doc_id) where not coalesce(l.quality = 1, false) or not coalesce(l.toxic = 0, false) or (coalesce(length(text), 0) > 0 and not coalesce(n_chars > 300, false))""")
def failed_cases(t):
    judged = t("documents").join(t("labels").select("doc_id", (F.col("quality") == 1).alias("same"), (F.col("toxic") == 0).alias("syntax")), "doc_id", "left")
    return records.failed_cases(judged.withColumn("qa", F.col("n_chars") > 300), "same", "syntax", "text", "qa").select("doc_id")


@query("select doc_id, coalesce(nullif(source, 'src1'), lang) as question, lang as answer from documents")
def adapted_records(t):
    docs = t("documents").select("doc_id", F.nullif("source", F.lit("src1")).alias("question"), F.col("lang").alias("conclusion"), F.col("lang").alias("label"))
    return records.adapted_keys(docs).select("doc_id", "question", "answer")


@query("select c_custkey, coalesce(n_name, '') as note from customer left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey")
def looked_up(t):
    notes = t("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("note"))
    return records.lookup(t("customer").select("c_custkey", "c_nationkey"), notes, "c_nationkey", "note").select("c_custkey", "note")


@query("""select conv_id, least(len(u), len(a)) as pairs, list_sum(list_transform(list_zip(u[1:least(len(u), len(a))], a[1:least(len(u), len(a))]), lambda x: length(x[1]) * length(x[2]))) as weight
  from (select conv_id, list(text order by turn) filter (role = 'user') as u, list(text order by turn) filter (role <> 'user') as a from conversations group by conv_id) where len(u) > 0 and len(a) > 0""")
def paired_turns(t):
    """Questions and replies of a conversation, zipped to the shorter side."""
    folded = records.messages(t("conversations"))
    side = lambda asks: F.transform(F.filter("messages", lambda m: (m["role"] == "user") == asks), lambda m: m["content"])
    pairs = folded.select("conv_id", side(True).alias("u"), side(False).alias("a")).where((F.size("u") > 0) & (F.size("a") > 0))
    pairs = pairs.select("conv_id", records.zipped(F.col("u"), F.col("a")).alias("z"))
    names = pairs.schema["z"].dataType.elementType.names
    weight = F.aggregate("z", F.lit(0).cast("long"), lambda s, x: s + F.length(x[names[0]]).cast("long") * F.length(x[names[1]]))
    return pairs.select("conv_id", F.size("z").cast("long").alias("pairs"), weight.alias("weight"))


@query("select doc_id, case when doc_id % 2 = 0 then 'val' else 'train' end as split from documents")
def given_split(t):
    """A split that every row has is kept."""
    docs = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "val").otherwise("train").alias("split"))
    return records.given_or_group_split(docs, "doc_id").select("doc_id", "split")


@query(r"""select doc_id, translate(regexp_replace(translate(replace(replace(replace(replace(x, '⁄', '/'), '½', '1/2'), '⅓', '1/3'), '⅔', '2/3'), '−–—×⋅·', '---***'), '([⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻]+)', '^\1', 'g'), '⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻', '0123456789+-') as plain
  from (select doc_id, translate(text, 'xqwzjkv', '²⁵×½−⁻⅓') as x from documents)""")
def plain_signs(t):
    """Superscripts, signs and fractions of whole texts (letters that stand for them here) in plain digits."""
    text = F.translate("text", "xqwzjkv", "²⁵×½−⁻⅓")
    signs = F.translate(F.translate(physics.fractions(text), "−–—", "---"), "×⋅·", "***")
    return t("documents").select("doc_id", physics.superscripts(signs).alias("plain"))


@query(r"""select item_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(text), 'in the coil', ''), 'of the coil', ''), 'stored entirely in', ''), 'stored in', ''), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) as bare from benchmark where text = regexp_extract(text, '^[\x00-\x7F]*$')""")
def bare_answers(t):
    return t("benchmark").where(F.regexp_like("text", F.lit(r"^[\x00-\x7F]*$"))).select("item_id", language.bare(F.col("text")).alias("bare"))


@query("""select doc_id, case when quality = 1 then 'true' else 'false' end = case when toxic = 0 then 'true' when toxic = 1 then 'false' end as matched from labels where toxic is not null and quality is not null""")
def answers_alike(t):
    """Answers in different words for the same thing."""
    labels = t("labels").where("toxic is not null and quality is not null")
    return labels.select("doc_id", decisions.answers_match(F.when(F.col("quality") == 1, " Yes").otherwise("FALSE"), F.when(F.col("toxic") == 0, "true ").otherwise("no")).alias("matched"))


@query("""select doc_id, len(list_filter(w, lambda x: x not in ('a', 'an', 'the', 'of', 'to', 'in', 'for', 'with', 'on', 'at', 'by', 'from', 'about'))) as content from (select doc_id, list_filter(regexp_split_to_array(lower(trim(text)), '[ \\t\\n\\r]+'), lambda x: x <> '') as w from documents)""".replace("\\\\", "\\"))
def content_words(t):
    words = F.filter(F.split(F.lower(F.trim("text")), r"[ \t\n\r]+"), lambda w: w != "")
    return t("documents").select("doc_id", F.size(language.without_words(words)).cast("long").alias("content"))


@query("""select event_id, k as input, case when k % 2 = 0 then null else k + 1 end as output from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events)""")
def token_usage(t):
    """Token counts of replies of two kinds."""
    k = F.get_json_object("props", "$.k").cast("int")
    even = F.concat(F.lit('{"usage": {"prompt_tokens": '), k, F.lit("}}"))
    odd = F.concat(F.lit('{"usage": {"input_tokens": '), k, F.lit(', "output_tokens": '), k + 1, F.lit("}}"))
    out = t("events").select("event_id", jsons.usage(F.when(k % 2 == 0, even).otherwise(odd)).alias("u"))
    return out.select("event_id", "u.input", "u.output")


@query("""select event_id, 2 * k + event_id as total from (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events)""")
def listed_numbers(t):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit("I choose ["), k, F.lit(", "), F.col("event_id").cast("string"), F.lit(",\n"), k, F.lit("] of [9]."))
    out = t("events").select("event_id", jsons.int_list(text).alias("n"))
    return out.select("event_id", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as value from nation""")
def response_lines(t):
    return writers.responses(t("nation").select("n_nationkey", "n_name"))


@query("select count(*) as total, count(*) filter (quality = 1) as valid, count(*) - count(*) filter (quality = 1) as invalid, round(count(*) filter (quality = 1) * 100.0 / count(*), 2) as rate from labels")
def validation_summary(t):
    return writers.summary(t("labels").withColumn("validation_error", F.when(F.coalesce(F.col("quality") == 1, F.lit(False)), F.lit(None).cast("string")).otherwise("bad")))


@query("select doc_id, quality, toxic from labels")
def json_lines_back(t):
    """Records written as JSON lines and read by their schema."""
    labels = t("labels").select("doc_id", "quality", "toxic")
    path = _folder(labels, "lines")
    writers.failures(labels, path)
    return readers.json_lines(labels.sparkSession, path, ", ".join(f"{n} {k}" for n, k in labels.dtypes))


@query("select p_name as question, cast(p_size as varchar) as answer, p_brand as unit from part")
def csv_back(t):
    parts = t("part").select(F.col("p_name").alias("question"), F.col("p_size").cast("string").alias("answer"), F.col("p_brand").alias("unit"))
    path = _folder(parts, "csv")
    parts.write.option("header", True).option("escape", '"').csv(path)
    return readers.csv_tasks(parts.sparkSession, path)


@query("select p_name || ' ' || p_partkey as question, cast(p_size as varchar) as ans, case when p_size % 2 = 0 then 'V' else '' end as unit from part")
def task_files_back(t):
    """Tasks with nested and with flat answers from one file of JSON lines."""
    parts = t("part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("question"), "p_size")
    nested = parts.where("p_size % 2 = 0").select("question", F.to_json(F.struct(F.col("p_size").cast("string").alias("ans"), F.lit("V").alias("unit"))).alias("correct_answer"), F.lit(None).cast("string").alias("answer"))
    flat = parts.where("p_size % 2 = 1").select("question", F.lit(None).cast("string").alias("correct_answer"), F.col("p_size").cast("string").alias("answer"))
    path = _folder(parts, "tasks") + ".jsonl"
    nested.unionByName(flat).write.json(path)
    return readers.physics_tasks(parts.sparkSession, path).select("question", "correct.ans", "correct.unit")


@query("select doc_id, quality = 1 as good from labels where quality is not null")
def two_way_back(t):
    """Valid and invalid rows written apart and read again."""
    labels = t("labels").where("quality is not null").select("doc_id", F.when(F.col("quality") != 1, "bad").alias("validation_error"))
    path = _folder(labels, "ways")
    writers.two_way(labels, f"{path}/valid", f"{path}/invalid")
    read = labels.sparkSession.read
    good, bad = (read.schema("doc_id long").json(f"{path}/{side}").withColumn("good", F.lit(side == "valid")) for side in ("valid", "invalid"))
    return good.union(bad)


@query("select doc_id, quality = 1 as is_valid from labels where quality is not null")
def partitioned_back(t):
    labels = t("labels").where("quality is not null").select("doc_id", F.when(F.col("quality") != 1, "bad").alias("validation_error"))
    path = _folder(labels, "parts")
    writers.partitioned(labels, path)
    return labels.sparkSession.read.schema("doc_id long, validation_error string, is_valid boolean").json(path).select("doc_id", "is_valid")


@query("""select c_custkey, case when c_custkey % 200 >= 120 then 'Yes' else 'Uncertain' end as answer, '' as unit, '0,1' as used from customer""")
def student_requests(t):
    """From request to response: eligibility by credits, answered in the request's options; different cases are proven once."""
    rows = t("customer").select("c_custkey", (F.col("c_custkey") % 200).cast("string").alias("query_id"))
    cases = rows.select("query_id").distinct()
    premises = F.array(F.lit("Students with 120 credits or more are eligible for graduation."), F.concat(F.lit("Student A has "), "query_id", F.lit(" credits.")))
    requests = cases.select("query_id", premises.alias("premises"), F.lit("Is Student A eligible for graduation?").alias("query"), F.array(*map(F.lit, ("Yes", "No", "Uncertain"))).alias("options"))
    formulas = F.array(F.lit("ForAll(x, (Credits(x) >= 120 -> Eligible(x)))"), F.concat(F.lit("Credits(a) = "), "query_id"))
    translated = cases.select("query_id", formulas.alias("premises_fol"), F.lit("Eligible(a)").alias("conclusion_fol"))
    found = decisions.answered(requests, translated).select("query_id", "answer", "unit", F.array_join("premises_used", ",").alias("used"))
    return rows.join(found, "query_id").drop("query_id")


@query("select p_partkey, cast(50 + p_size as varchar) as ans, 'ohm' as unit, '' as error from part")
def series_resistance(t):
    """Model-written code for two resistors in series, read and worked out once for each different pair."""
    code = F.concat(F.lit('{"python_code": "R1 = 50\\nR2 = '), F.col("p_size").cast("string"), F.lit("\\nans = R1 + R2\\nunit = 'ohm'\"}"))
    parts = t("part").select("p_partkey", code.alias("reply"))
    solved = providers.solved(parts.select("reply").distinct())
    return parts.join(solved, "reply").select("p_partkey", F.get("ans", F.lit(0)).alias("ans"), F.get("unit", F.lit(0)).alias("unit"), F.coalesce("content_error", F.lit("")).alias("error"))


@query("""with w as (select conv_id, turn, string_split(text, ' ') as w from conversations), p as (select a.w as x, b.w as y from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 2),
  s as (select least(len(x), len(y)) as n, len(list_filter(list_zip(x[1:least(len(x), len(y))], y[1:least(len(x), len(y))]), lambda z: trim(z[1]) = trim(z[2]))) as same, len(y) as total from p)
  select count(*) as total, coalesce(sum(same * 1.0) / sum(total), 0) * 100 as same from s""")
def place_rates(t):
    """Equal items of two lists place by place, over the second list's items: the rate that formula lists are scored by."""
    words = t("conversations").select("conv_id", "turn", F.split("text", " ").alias("x"))
    later = words.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("x").alias("y"))
    return profiling.metrics(words.join(later, ["conv_id", "turn"]), {"same": profiling.formula_rates(F.col("x"), F.col("y"))})


_RULE = "ForAll(VAR_0, VAR_1(VAR_0))"


@query(f"""with k as (select o_orderkey, 1 + o_orderkey % 7 as n from orders), s as (select n, '{_RULE}' || repeat('‖{_RULE}', cast(n as int) - 1) as key from (select distinct n from k)),
  r as (select n, case when row_number() over (order by md5(key || '#42')) <= floor(count(*) over () * 0.5 + 1e-9) then 'train' else 'val' end as split from s)
  select o_orderkey, split from k join r using (n)""")
def structure_split(t):
    """Samples split by the structure of their formulas: names don't matter, so none is on both sides."""
    from cairn.functions import formula

    orders = t("orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("n"), (F.col("o_orderkey") % 3).cast("string").alias("v"))
    rule = F.concat(F.lit("ForAll(a"), "v", F.lit(", P"), "v", F.lit("(a"), "v", F.lit("))"))
    cases = orders.select("n", "v").distinct().withColumn("key", formula.structure_key(F.array_repeat(rule, F.col("n").cast("int") + 1)))
    return records.group_split(orders.join(cases, ["n", "v"]), "key", 0.5).select("o_orderkey", "split")
