"""Relational operators over records: first-wins dedupe, joins, hash-ranked samples, splits and mixes.

Order-dependent results come from explicit columns and md5 ranks, so any engine and any partitioning gives the same rows. Nothing
sorts a whole table into one task: the row that a rank falls on is found by counting hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def rank_hash(key: str | Column, seed: int = SEED) -> Column:
    """The place of a key in a seeded order: md5 of the key, `#` and the seed."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")).cast("binary"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order. Nulls are keys."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def cut_hash(df: DataFrame, hashed: str, k: int) -> str | None:
    """The k-th smallest value of a column of md5 texts (ties count); only counts by prefix reach the driver."""
    if k <= 0:
        return None
    prefix = ""
    for length in (4, 8):
        counts = df.where(F.col(hashed).startswith(prefix)).groupBy(F.substring(hashed, 1, length).alias("p")).count().orderBy("p").collect()
        for row in counts:
            if k <= row["count"]:
                prefix = row.p
                break
            k -= row["count"]
        else:
            return "g"  # past every hash
    return df.where(F.col(hashed).startswith(prefix)).orderBy(hashed).limit(k).agg(F.max(hashed)).first()[0]


def sample(df: DataFrame, key: str, k: int, seed: int = SEED) -> DataFrame:
    """k rows (all, if there are fewer) by the rank of a unique key, without replacement."""
    hashed = df.withColumn("__h", rank_hash(key, seed))
    cut = cut_hash(hashed, "__h", k)
    return hashed.where(F.lit(False) if cut is None else F.col("__h") <= cut).drop("__h")


def sample_with_replacement(df: DataFrame, key: str, k: int, seed: int = SEED) -> DataFrame:
    """k rows in which every row occurs k div n times and the first k mod n by rank once more."""
    n = df.count()
    if not n or k <= 0:
        return df.limit(0)
    hashed = df.withColumn("__h", rank_hash(key, seed))
    cut = cut_hash(hashed, "__h", k % n)
    extra = F.lit(0) if cut is None else F.when(F.col("__h") <= cut, 1).otherwise(0)
    times = F.lit(k // n) + extra
    return hashed.withColumn("__t", times).where("__t > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__t")))).drop("__h", "__t", "__i")


def shuffled(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """All rows in seeded order."""
    return df.orderBy(rank_hash(key, seed), key)


def prefix(df: DataFrame, order: str, share: float) -> DataFrame:
    """The first floor(share * n) rows by a unique, evenly spread numeric order column, or fewer where it has ties at the cut."""
    n = df.count()
    k = int(n * share + 1e-9)
    if k <= 0:
        return df.limit(0)
    low, high = df.agg(F.min(order), F.max(order)).first()
    while low < high:  # bisection over values; each step is one count
        middle = (low + high) // 2
        if df.where(F.col(order) <= middle).count() >= k:
            high = middle
        else:
            low = middle + 1
    return df.where(F.col(order) <= high)


def group_split(df: DataFrame, key: str, share: float = 0.9, seed: int = SEED) -> DataFrame:
    """df with split `train` or `val`: the first floor(share * keys) different keys by rank train, so no key is on both sides."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__h", rank_hash(key, seed))
    cut = cut_hash(keys, "__h", int(keys.count() * share + 1e-9))
    train = F.lit(False) if cut is None else rank_hash(key, seed) <= cut
    return df.withColumn("split", F.when(train, "train").otherwise("val"))


def given_or_group_split(df: DataFrame, key: str, share: float = 0.9, seed: int = SEED) -> DataFrame:
    """The given split where every row has one, else a group split."""
    if "split" in df.columns and df.agg(F.coalesce(F.bool_and(F.col("split").isNotNull()), F.lit(False))).first()[0]:
        return df
    return group_split(df.drop("split"), key, share, seed)


def question_split(a: DataFrame, b: DataFrame, key: str, share: float = 0.9, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Both datasets with splits by the union of their keys."""
    both = group_split(a.select(key).union(b.select(key)).distinct(), key, share, seed).where(F.col(key).isNotNull())
    return tuple(df.drop("split").join(both, key, "left").withColumn("split", F.coalesce("split", F.lit("val"))) for df in (a, b))


def base_id(column: Column) -> Column:
    """The original's id of an augmented row."""
    return F.regexp_replace(column, r"(_aug_var|_perm_var|_neg_var).*$", "")


def lineage_split(df: DataFrame, id_column: str = "example_id", share: float = 0.9, seed: int = SEED) -> DataFrame:
    """Originals split by id; augmented rows follow their original into train, those of validation originals go."""
    name = F.col(id_column)
    originals = group_split(df.where(base_id(name) == name), id_column, share, seed)
    train = originals.where("split = 'train'").select(F.col(id_column).alias("__base"))
    children = df.where(base_id(name) != name).join(train, base_id(name) == F.col("__base"), "left_semi").withColumn("split", F.lit("train"))
    return originals.unionByName(children)


def two_phase_mix(a: DataFrame, b: DataFrame, order: str, key: str, seed: int = SEED) -> DataFrame:
    """phase 1: all of a and the first 20 % of b; phase 2: all of b and a sampled half of a."""
    half = sample(a, key, a.count() // 2, seed)
    parts = [(a, 1), (prefix(b, order, 0.2), 1), (b, 2), (half, 2)]
    out = None
    for df, phase in parts:
        df = df.withColumn("phase", F.lit(phase))
        out = df if out is None else out.unionByName(df)
    return out


def update(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the non-null values of changes (one row a key) in some columns."""
    c = changes.select(F.col(key).alias("__key"), *[F.col(x).alias(f"__{x}") for x in columns])
    joined = df.join(c, F.col(key) == F.col("__key"), "left")
    return joined.withColumns({x: F.coalesce(f"__{x}", x) for x in columns}).drop("__key", *[f"__{x}" for x in columns])


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, limit_bytes: int = 8 << 20) -> DataFrame:
    """df with a lookup table's text, empty where the key is missing; broadcast only where the table is within the limit."""
    size = table.agg(F.coalesce(F.sum(F.octet_length(value) + F.octet_length(key)), F.lit(0))).first()[0]
    side = F.broadcast(table) if size <= limit_bytes else table
    return df.join(side, key, "left").withColumn(value, F.coalesce(value, F.lit("")))


def zipped(a: Column, b: Column) -> Column:
    """Arrays zipped to the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))


def place_of(item: Column, items: Column) -> Column:
    """First index (from 0) of an item, null where it is missing."""
    at = F.array_position(items, item)
    return F.when(at > 0, at - 1)


def chunks(df: DataFrame, order: list[str], value: str, group: list[str], size: int = 25) -> DataFrame:
    """Rows of each group in order, collected in lists of at most size."""
    window = Window.partitionBy(*group).orderBy(*order)
    numbered = df.withColumn("chunk", F.floor((F.row_number().over(window) - 1) / size).cast("int"))
    items = F.array_sort(F.collect_list(F.struct(*order, value)))
    return numbered.groupBy(*group, "chunk").agg(F.transform(items, lambda x: x[value]).alias("items"))


def messages(df: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row a conversation: its turns in order as role and content."""
    rows = F.array_sort(F.collect_list(F.struct(turn, F.col("role"), F.col("text").alias("content"))))
    return df.groupBy(conversation).agg(F.transform(rows, lambda x: F.struct(x["role"], x["content"])).alias("messages"))


def numbered_list(items: Column) -> Column:
    """`1. a`, `2. b`, one a line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def chat_record(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))])


def lineage_columns(df: DataFrame, strategy: str, suffix: str, variant: Column) -> DataFrame:
    """Id and source of an augmented row."""
    source = F.concat(F.coalesce("dataset_source", F.lit("unknown")), F.lit(f"-augmented-{strategy}-var"), variant.cast("string"))
    return df.withColumns({"dataset_source": source, "example_id": F.concat("example_id", F.lit(f"_{suffix}_var"), variant.cast("string"))})


def adapted_keys(df: DataFrame) -> DataFrame:
    """question and answer, from conclusion and label where they are missing."""
    pairs = [("question", "conclusion"), ("answer", "label")]
    return df.withColumns({a: F.coalesce(*[F.col(c) for c in (a, b) if c in df.columns]) for a, b in pairs if a in df.columns or b in df.columns})


def validated(df: DataFrame, nl: str = "premises-NL", fol: str = "premises-FOL") -> DataFrame:
    """df with validation_error: unequal or empty lists first (no parsing then), else the first formula that has no parse."""
    from cairn.functions.formula import normalize_formula_plain
    from cairn.functions.logic import parse_error_plain
    from cairn.session import arrow_udf, importable

    importable(df.sparkSession)
    a, b = F.coalesce(F.size(f"`{nl}`"), F.lit(-1)), F.coalesce(F.size(f"`{fol}`"), F.lit(-1))
    fits = (a > 0) & (a == b)
    error = arrow_udf("string")(lambda formulas: parse_error_plain([normalize_formula_plain(f) for f in formulas]))
    good = df.where(fits).withColumn("validation_error", error(F.col(f"`{fol}`")))
    bad = df.where(~fits).withColumn("validation_error", F.format_string("Length mismatch: %d NL premises, %d FOL premises", F.greatest(a, F.lit(0)), F.greatest(b, F.lit(0))))
    return good.unionByName(bad)


def failures(evaluations: DataFrame) -> DataFrame:
    """Evaluations that are not true (false and null), flat."""
    kept = evaluations.where(~F.coalesce("is_correct", F.lit(False)))
    return kept.select("question", F.to_json("correct").alias("correct"), F.to_json("model_answer").alias("model_answer"), "raw_response", "error", "reason", F.try_element_at("tokens", F.lit("input")).alias("input_tokens"), F.try_element_at("tokens", F.lit("output")).alias("output_tokens"))


def failure_brief(failures_: DataFrame) -> DataFrame:
    return failures_.select("question", "correct", "model_answer", "reason", "error")


def failed_cases(df: DataFrame, same: str, syntax: str, question: str, qa: str) -> DataFrame:
    """Rows that differ, have bad syntax, or answer their question wrongly."""
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return df.where(off(same) | off(syntax) | ((F.coalesce(F.length(question), F.lit(0)) > 0) & off(qa)))


def policy_block(tasks: DataFrame, policies: DataFrame, examples: DataFrame, warnings: str | None = None) -> DataFrame:
    """tasks: id, domains. id and prompt: the policies of every domain and the examples of the first two, in order, without
    empty sections. policies, examples: name, text."""
    spread = tasks.select("id", F.posexplode("domains").alias("k", "name"))
    found = spread.join(policies.withColumnRenamed("text", "policy"), "name", "left").join(examples.withColumnRenamed("text", "example"), "name", "left")
    some = F.array_sort(F.collect_list(F.struct("k", "policy", F.when(F.col("k") < 2, F.col("example")).alias("example"))))
    rows = found.groupBy("id").agg(some.alias("s"))
    sections = F.concat(F.transform("s", lambda x: x["policy"]), F.transform("s", lambda x: x["example"]))
    warned = tasks.select("id", F.array(F.col(warnings) if warnings else F.lit(None).cast("string")).alias("w"))
    texts = F.filter(F.concat(F.coalesce(sections, F.array().cast("array<string>")), F.col("w")), lambda x: x.isNotNull() & (x != ""))
    return warned.join(rows, "id", "left").select("id", F.array_join(texts, "\n\n").alias("prompt"))


def augmented(df: DataFrame) -> DataFrame:
    """Rows that an augmentation made, by their source."""
    return df.where(F.contains(F.coalesce("dataset_source", F.lit("")), F.lit("augmented")))


def in_questions(df: DataFrame, questions: DataFrame, key: str = "question") -> DataFrame:
    """Rows whose question is in a set of questions."""
    return df.join(questions.select(key).distinct(), key, "left_semi")
