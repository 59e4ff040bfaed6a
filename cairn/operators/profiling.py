"""Dataset profiles: vocabulary, coverage, entropy, co-occurrence, chains, lengths and difficulty.

Tokens are runs without white space of the lower-cased text unless said otherwise."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import cut_lineage, importable, release_shuffles, stored


def tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row a token, with the columns in keep."""
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[ \t\n\r]+"), lambda w: w != "")
    return df.select(*(keep or []), F.explode(words).alias("token"))


def counts(toks: DataFrame, token: str = "token") -> DataFrame:
    return toks.groupBy(token).agg(F.count("*").alias("n"))


def vocabulary(counted: DataFrame) -> DataFrame:
    """vocabulary, tokens, singletons and the Good-Turing share of unseen tokens (singletons / tokens)."""
    return counted.agg(F.count("*").alias("vocabulary"), F.sum("n").alias("tokens"), F.count_if(F.col("n") == 1).alias("singletons"), (F.count_if(F.col("n") == 1) / F.sum("n")).alias("oov"))


def top_share(counted: DataFrame, share: float = 0.1) -> DataFrame:
    """coverage: share of all tokens that the most frequent share of the vocabulary makes up. Words are ranked by their count's
    histogram (one row a different count), so no task sees the vocabulary."""
    by_count = counted.groupBy("n").agg(F.count("*").alias("words"))
    total = counted.agg(F.count("*").alias("v"), F.sum("n").alias("t")).first()
    k = int((total.v or 0) * share + 1e-9)
    window = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # one row a different count
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(k) - F.coalesce(F.sum("words").over(window), F.lit(0))))
    return by_count.select("n", taken.alias("w")).agg((F.sum(F.col("w") * F.col("n")) / F.lit(total.t)).alias("coverage"))


def entropy(counted: DataFrame, n: str = "n") -> DataFrame:
    """Shannon entropy in bits: log2 N - sum(n log2 n) / N."""
    return counted.agg((F.log2(F.sum(n)) - F.sum(F.col(n) * F.log2(n)) / F.sum(n)).alias("entropy"))


def cooccurrence(df: DataFrame, group: str, item: str) -> DataFrame:
    """a, b, n: groups that hold both of two different items, a < b. Pairs are made in each group's sorted set of items, so groups
    should be samples (few items), not the corpus."""
    sets = df.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def top_pairs(df: DataFrame, group: str, item: str, k: int = 100, first: int = 64) -> DataFrame:
    """a, b, n: the k pairs of different items, a < b, that most groups hold (most first, then by a and b). Repeats in a group count once; null groups
    and items count for nothing.

    A pair is in no more groups than either of its items. The k-th best pair among the `first` most frequent items is a bound that every pair wanted reaches, so only
    items in as many groups can be in one; pairs are counted of these only. They leave a group's array one by one."""
    rows = stored(df.select(F.col(group).alias("g"), F.col(item).alias("i")).dropna().distinct())
    items = stored(rows.groupBy("i").agg(F.count("*").alias("n")))

    def counted(kept: DataFrame) -> DataFrame:
        sets = rows.join(kept.select("i"), "i").groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("s"))
        each = sets.select(F.posexplode("s").alias("at", "a"), "s").select("a", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("b"))
        return each.groupBy("a", "b").agg(F.count("*").alias("n"))

    order = [F.desc("n"), "a", "b"]
    best = counted(items.orderBy(F.desc("n"), "i").limit(first)).orderBy(*order).limit(k).select("n").collect()  # k counts at most
    bound = best[-1].n if len(best) == k else 1
    return counted(items.where(F.col("n") >= bound)).orderBy(*order).limit(k)


def transitions(df: DataFrame, group: list[str], order: list[str], item: str) -> DataFrame:
    """source, target, n of adjacent items."""
    window = Window.partitionBy(*group).orderBy(*order)
    steps = df.select(F.col(item).alias("source"), F.lead(item).over(window).alias("target")).where("target is not null")
    return steps.groupBy("source", "target").agg(F.count("*").alias("n"))


def transition_matrix(df: DataFrame, group: list[str], order: list[str], item: str, values: list[str]) -> DataFrame:
    return transitions(df, group, order, item).groupBy("source").pivot("target", values).agg(F.coalesce(F.sum("n"), F.lit(0)))


def repetition(df: DataFrame, entity: str, story: str) -> DataFrame:
    """entities, repeated_share (in two stories or more) and mean_span (stories an entity is in)."""
    span = df.groupBy(entity).agg(F.count_distinct(story).alias("s"))
    return span.agg(F.count("*").alias("entities"), F.avg((F.col("s") > 1).cast("double")).alias("repeated_share"), F.avg("s").alias("mean_span"))


def frequency_histogram(df: DataFrame, key: str) -> DataFrame:
    """keys by how often they occur: 1, 2-5, 6-10, 11+."""
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").when(F.col("n") <= 10, "6-10").otherwise("11+")
    return df.groupBy(key).agg(F.count("*").alias("n")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("keys"), F.sum("n").alias("records"))


def chain_depths(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges: source, target. node and depth, its longest chain of edges. Chains are followed to their end, or to max_depth if it is
    given; where they run in circles there is no end, and without max_depth that is an error. One join a level over the nodes that
    still grow."""
    edges = cut_lineage(edges.where("source <> target").select("source", "target").distinct())
    reached = cut_lineage(edges.select(F.col("source").alias("node"), F.lit(1).alias("depth")).distinct())
    longest, depth = reached.count(), 1  # a chain without a circle has no more edges than there are sources
    while depth < (longest + 1 if max_depth is None else max_depth):
        level = reached.where(F.col("depth") == depth)
        depth += 1
        grown = edges.join(level, F.col("target") == F.col("node"), "left_semi").select(F.col("source").alias("up")).distinct()
        later = reached.join(grown, F.col("node") == F.col("up"), "left").select("node", F.when(F.col("up").isNotNull(), depth).otherwise(F.col("depth")).alias("depth"))
        reached = cut_lineage(later)
        if reached.where(F.col("depth") == depth).isEmpty():
            return reached
    if max_depth is None and longest:
        raise ValueError("edges run in circles: give max_depth")
    return reached


def branching(edges: DataFrame) -> DataFrame:
    """Mean and largest number of targets of a source."""
    return edges.groupBy("source").agg(F.count_distinct("target").alias("n")).agg(F.avg("n").alias("mean_targets"), F.max("n").alias("max_targets"))


def operator_coverage(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """operator, total and share of rows that contain it."""
    one = F.array(*[F.struct(F.lit(k).alias("operator"), F.regexp_count(column, F.lit(p)).alias("n")) for k, p in patterns.items()])
    return df.select(F.explode(one).alias("o")).groupBy("o.operator").agg(F.sum("o.n").alias("total"), F.avg((F.col("o.n") > 0).cast("double")).alias("share"))


def difficulty(depth: Column, premises: Column, connectives: Column) -> Column:
    """easy (depth to 1, 4 premises, 4 connectives), medium (to 3, 8, 10) or hard. The reference reports publish no thresholds;
    these are the engine's own."""
    return F.when((depth <= 1) & (premises <= 4) & (connectives <= 4), "easy").when((depth <= 3) & (premises <= 8) & (connectives <= 10), "medium").otherwise("hard")


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts and shares of a key in two datasets, 0 where it is missing."""
    sides = [d.groupBy(F.col(key).alias("key")).agg(F.count("*").alias(f"n_{s}")) for d, s in ((a, "a"), (b, "b"))]
    both = sides[0].join(sides[1], "key", "full").na.fill(0, ["n_a", "n_b"])
    totals = both.agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b")).first()
    return both.withColumns({f"share_{s}": F.try_divide(F.col(f"n_{s}"), F.lit(totals[s])) for s in ("a", "b")})


def lengths(df: DataFrame, column: Column) -> DataFrame:
    """mean, greatest and 99th percentile of a number (the least value that 99 % do not exceed), the true value at every size: rows are counted
    by value first, so what is ordered grows with the different values only."""
    by_value = df.select(column.alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    p99 = F.min(F.when(F.col("below") >= F.ceil(F.col("all") * F.lit(99) / 100), F.col("x")))
    window = Window.orderBy("x")  # one row a different value
    ranked = by_value.select("x", "n", F.sum("n").over(window).alias("below"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return ranked.agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean_length"), F.max("x").alias("max_length"), p99.alias("p99_length"))


def reuse(df: DataFrame, story: str) -> DataFrame:
    """records, stories and records a story."""
    return df.agg(F.count("*").alias("records"), F.count_distinct(story).alias("stories"), (F.count("*") / F.count_distinct(story)).alias("reuse"))


#: Rows of a word and size band that are joined in one piece.
HOT_WORD = 1 << 13
#: Counters of words by hash, of which a byte each is broadcast, and parts of the vocabulary that the suffix filter counts words in.
COUNTERS, PARTS = 1 << 20, 64


def _word_levels(hashes: DataFrame) -> np.ndarray:
    """For every counter the number of rows (in eighths of a power of two, and one more) that have one of its words, 0 where at most one row has. hashes: h, the hashes of
    a row's words. At most COUNTERS numbers come to the driver."""
    counted = hashes.select(F.explode("h").alias("t")).groupBy(F.pmod("t", F.lit(COUNTERS)).cast("int").alias("c")).agg(F.count("*").alias("f")).where("f > 1")
    found = counted.select("c", F.least(F.floor(F.log2("f") * 8) + 1, F.lit(255)).cast("short").alias("level")).toArrow()
    out = np.zeros(COUNTERS, np.uint8)
    out[found.column("c").to_numpy()] = found.column("level").to_numpy().astype(np.uint8)
    return out


def _sketched(hashes: DataFrame, levels: np.ndarray, least: float) -> DataFrame:
    """id, n, parts (words in each part of the vocabulary, a byte each, 255 for more) and prefix (t and its place at) of rows id, n, h. Words are ordered by level and
    hash, the same order in all rows; of the prefix those that no other row can have are left out."""
    sent = hashes.sparkSession.sparkContext.broadcast(levels)

    def sketch(batches):
        for whole in batches:
            for batch in [whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)]:
                column, n = batch.column("h"), batch.column("n").to_numpy().astype(np.int64)
                t, row = column.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
                parts = np.minimum(np.bincount(row * PARTS + (t >> 20) % PARTS, minlength=len(n) * PARTS), 255).astype(np.uint8)
                level = sent.value[t % COUNTERS]
                order = np.lexsort((t, level, row))
                t, level = t[order], level[order]
                at = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n) + 1
                keep = (at <= (n - np.ceil(n * least - 1e-9).astype(np.int64) + 1)[row]) & (level > 0)
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(n))))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (t[keep], at[keep].astype(np.int32))]
                raw = parts.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array([raw[k : k + PARTS] for k in range(0, len(raw), PARTS)], pa.binary()), *lists], ["id", "n", "parts", "t", "at"])

    return hashes.mapInArrow(sketch, "id long, n int, parts binary, t array<long>, at array<int>")


def _enough(pairs: DataFrame, least: float) -> DataFrame:
    """x, y of pairs x, y, nx, ny, px, py whose words suffice part by part."""

    def check(batches):
        for batch in batches:
            px, py = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS) for c in ("px", "py"))
            shared = np.where((px == 255) & (py == 255), 1 << 30, np.minimum(px, py).astype(np.int64)).sum(axis=1)  # 255 stands for any number
            n = batch.column("nx").to_numpy().astype(np.int64) + batch.column("ny").to_numpy()
            yield batch.select(["x", "y"]).filter(pa.array(shared >= np.ceil(n * (least / (1 + least)) - 1e-9)))

    return pairs.mapInArrow(check, "x long, y long")


def jaccard_pairs(df: DataFrame, key: str, words: str, least: float = 0.8, hot: int = HOT_WORD) -> DataFrame:
    """a, b, jaccard of rows whose word sets overlap in at least this share, none missed; equal sets are one row before the join and named by
    their least key. Words are ordered by about how many rows have them, and four filters leave few pairs to compare:

    * prefix: a pair must share one of the rarest words of each, as many as may be missing and one more;
    * size: sets of a pair lie in the same band of sizes or in neighbouring ones, so the band is part of the join's key;
    * position: after a shared word, the rest of the shorter remainder must still suffice;
    * suffix: words in PARTS parts of the vocabulary, where a pair shares no more of a part than either has.

    Until then words are hashes and a set is one; the words themselves are shuffled only of sets with a pair left, and compared.
    A word that more than `hot` sets of a band have in their prefix is dealt over sub-keys, to which the other side is copied."""
    importable(df.sparkSession)
    sets = df.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(words)).alias("w")).where("size(w) > 0").withColumn("id", F.xxhash64("w"))
    hashes = sets.select("id", F.size("w").alias("n"), F.transform("w", lambda t: F.xxhash64(t)).alias("h"))
    sketches = stored(_sketched(hashes, _word_levels(hashes.select("h")), least).dropDuplicates(["id", "n"]))
    release_shuffles(df.sparkSession)
    band = F.floor(F.log("n") / (-math.log(least) * 1.0001)).cast("int")
    heads = sketches.select("id", "n", F.explode(F.arrays_zip("t", "at")).alias("p"), band.alias("band")).select("id", "n", "p.t", "p.at", "band")
    split = F.broadcast(heads.groupBy("t", "band").agg(F.ceil(F.count("*") / hot).cast("int").alias("splits")).where("splits > 1"))  # a row for each `hot` prefixes at most
    larger = heads.select(F.col("id").alias("y"), F.col("n").alias("ny"), "t", F.col("at").alias("aty"), "band").join(split, ["t", "band"], "left")
    larger = larger.withColumn("piece", F.pmod(F.xxhash64("y"), F.coalesce("splits", F.lit(1)))).drop("splits")
    smaller = heads.select(F.col("id").alias("x"), F.col("n").alias("nx"), "t", F.col("at").alias("atx"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")).join(split, ["t", "band"], "left")
    smaller = smaller.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("splits", F.lit(1)) - F.lit(1).cast("long")))).drop("splits")
    needed = F.ceil((F.col("nx") + F.col("ny")) * (least / (1 + least)) - 1e-9)
    ordered = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    fits = (F.col("nx") >= F.col("ny") * least - 1e-9) & (1 + F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty")) >= needed)
    pairs = stored(smaller.join(larger, ["t", "band", "piece"]).where(ordered & fits).select("x", "y", "nx", "ny").distinct())
    release_shuffles(df.sparkSession)
    sides = [sketches.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("parts").alias(f"p{s}")) for s in ("x", "y")]
    left = stored(_enough(pairs.join(sides[0], ["x", "nx"]).join(sides[1], ["y", "ny"]).select("x", "y", "nx", "ny", "px", "py"), least))
    wanted = left.select(F.col("x").alias("id")).union(left.select("y")).distinct()
    texts = stored(sets.join(wanted, "id", "left_semi").groupBy("id", "w").agg(F.min("k").alias("k")))
    release_shuffles(df.sparkSession)
    both = left.join(texts.toDF("x", "wx", "a"), "x").join(texts.toDF("y", "wy", "b"), "y")
    common = F.size(F.array_intersect("wx", "wy"))
    score = common / (F.size("wx") + F.size("wy") - common)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), score.alias("jaccard")).where(F.col("jaccard") >= least)


def metrics(df: DataFrame, rates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Percentages sum(numerator) / sum(denominator), 0 where the denominator is 0."""
    return df.agg(F.count("*").alias("total"), *[(F.coalesce(F.try_divide(F.sum(a.cast("double")), F.sum(b.cast("double"))), F.lit(0.0)) * 100).alias(k) for k, (a, b) in rates.items()])


def formula_rates(predicted: Column, truth: Column) -> tuple[Column, Column]:
    """Equal formulas place by place, and formulas of replies that are lists at all (others count in neither)."""
    n = F.least(F.size(predicted), F.size(truth))
    same = F.size(F.filter(F.zip_with(F.slice(predicted, 1, n), F.slice(truth, 1, n), lambda a, b: F.trim(a) == F.trim(b)), lambda x: x))
    return F.when(predicted.isNotNull(), same).otherwise(0), F.when(predicted.isNotNull(), F.size(truth)).otherwise(0)


def domains_equal(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_sort(a) == F.array_sort(b), F.lit(False))
