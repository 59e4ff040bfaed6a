"""Secret scans with DataFrame functions only.

Three fixed kinds of secrets are found by their patterns. Beside them, every long run of key characters is scored by two
first-order Markov models of characters, one of random strings and one of ordinary identifiers: the mean log-likelihood ratio
of its steps tells which it is. The models are trained from labelled samples: random strings (made from digests, and the values
that the fixed kinds find) against the words of at most SAMPLE documents and identifiers joined from them."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import documents, staged, table

#: kind, pattern, group whose length counts, least length: fixed values.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Whole runs of key characters, as a run of 20 or more is matched from its start on.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: The patterns of the text's scan. The rest of a run after AKIA, and a run of hex digits, only shrink from one place to the next,
#: so asking for the least length at once gives the same matches. An assignment that is too short takes its text with it.
_SCAN = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}
#: What a text has if the kind can occur in it: candidates are found first, and hold all of access and hex.
_PRESENT = {
    "assign": " or ".join(f"contains(lower(text), '{x}')" for x in ("passw", "secret", "token", "api")),
    "access": "exists(candidates, t -> contains(t, 'AKIA'))",
    "hex": "exists(candidates, t -> t rlike '[0-9a-f]{24}')",
}
SAMPLE, MADE, PRIOR, MIN_RATIO = 2000, 2048, 20, 1.0
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(rank: int, kind: str, pattern: str, found: str, keep: str, present: str) -> Column:
    """The matches m of a pattern (the array `found`) that are kept, as spans of code points: the pieces between the matches
    give their places. Texts where the kind is not present are passed over."""
    return F.expr(f"""case when {present} then aggregate(
        zip_with(split(text, {_literal(pattern)}, -1), {found}, (p, m) -> named_struct('p', p, 'm', m)),
        named_struct('at', 0, 'out', cast(array() as {_SPAN})),
        (a, x) -> named_struct('at', a.at + length(x.p) + coalesce(length(x.m), 0), 'out', if(x.m is not null and {keep},
            array_append(a.out, named_struct('start', a.at + length(x.p), 'rank', {rank}, 'end', a.at + length(x.p) + length(x.m), 'kind', '{kind}')), a.out)),
        a -> a.out) else cast(array() as {_SPAN}) end""")


def transitions(pairs: DataFrame) -> list[float]:
    """pairs: label (true: random), a, b. Log-likelihood ratios of the steps a to b, by 128 times the code of a plus that of b; each
    row is smoothed with PRIOR counts of its label's characters overall, and a start (code 0) counts nothing. Only counts by step
    reach the driver."""
    size = len(ALPHABET)
    counts = {label: [[0] * size for _ in range(size)] for label in (True, False)}
    for r in pairs.groupBy("label", "a", "b").count().collect():
        counts[r.label][ALPHABET.index(r.a)][ALPHABET.index(r.b)] += r["count"]
    logs = {}
    for label, rows in counts.items():
        overall = [1 + sum(row[b] for row in rows) for b in range(size)]
        share = [x / sum(overall) for x in overall]
        logs[label] = [[math.log((row[b] + PRIOR * share[b]) / (sum(row) + PRIOR)) for b in range(size)] for row in rows]
    out = [0.0] * (128 * 128)
    for i, a in enumerate(ALPHABET):
        for j, b in enumerate(ALPHABET):
            out[128 * ord(a) + ord(b)] = logs[True][i][j] - logs[False][i][j]
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """token, label: random strings against words and identifiers of the SAMPLE documents whose id has the least hash (of rows
    that share an id, the one with the least text)."""
    spark = docs.sparkSession
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    some = staged(docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "sample")  # SAMPLE ids
    n = F.expr("sha2(cast(id as string), 256)")
    made = spark.range(MADE).select(F.explode(F.array(F.base64(F.unhex(n)), F.md5(n), F.translate(F.base64(F.unhex(F.reverse(n))), "+/=", ""), F.upper(F.substring(F.base64(F.unhex(n)), 1, 20)))).alias("token"))
    values = some.select(F.explode(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for _, p, g, _ in KINDS]))).alias("token")).where(F.length("token") >= 20)
    text = F.col("text")
    for _, p, _, _ in KINDS[:2]:
        text = F.regexp_replace(text, p, " ")
    words = some.select(F.regexp_extract_all(F.regexp_replace(text, "[0-9a-f]{24,}", " "), F.lit("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{2,19}+(?![A-Za-z0-9+/_=-])"), F.lit(0)).alias("w"))  # candidates have no label
    plain = words.select(F.explode("w").alias("token"))
    joined = words.select(F.explode(F.expr("transform(w, (x, i) -> concat(x, if(i % 2 = 0, '_', ''), initcap(coalesce(try_element_at(w, i + 2), ''))))")).alias("token"))
    return made.union(values).withColumn("label", F.lit(True)).union(plain.union(joined).withColumn("label", F.lit(False)))


def steps(tokens: DataFrame) -> DataFrame:
    """label, a, b: the steps between the tokens' characters."""
    chars = tokens.where("length(token) > 1").select("label", F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))")).alias("ab"))
    known = f"^[{ALPHABET[:-1]}\\-]{{2}}$"
    return chars.where(F.col("ab").rlike(known)).select("label", F.substring("ab", 1, 1).alias("a"), F.substring("ab", 2, 1).alias("b"))


def ratio(token: str, ratios: list[float]) -> str:
    """SQL for the mean log-likelihood ratio of a token's steps, in one pass over its characters."""
    model = f"from_json('{json.dumps([round(x, 6) for x in ratios])}', 'array<double>')"
    step = f"named_struct('c', ascii(c), 's', a.s + element_at({model}, 128 * a.c + ascii(c) + 1))"
    return f"aggregate(split({token}, ''), named_struct('c', 0, 's', 0D), (a, c) -> {step}, a -> a.s / (length({token}) - 1))"


def find(docs: DataFrame, ratios: list[float], min_ratio: float = MIN_RATIO) -> DataFrame:
    """docs (text not null; no columns of the names added) with base and spans: arrays of (start, rank, end, kind), ordered; base
    has the fixed kinds, spans the candidates that the models take for random as well, as kind `markov`. A candidate that
    overlaps a base span is part of it."""
    text = docs.withColumn("candidates", F.expr(f"regexp_extract_all(text, {_literal(CANDIDATE)}, 0)"))
    text = text.withColumn("random", F.expr(f"transform(candidates, t -> {ratio('t', ratios)} >= {min_ratio})"))
    base = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        scanned = _SCAN[kind]
        size = f"length(regexp_extract(x.m, {_literal(pattern)}, {group})) >= {least}" if group else "true"
        base.append(_places(k, kind, scanned, f"regexp_extract_all(text, {_literal(scanned)}, 0)", size, _PRESENT[kind]))
    text = text.withColumn("base", F.array_sort(F.concat(*base)))
    places = f"""aggregate(zip_with(zip_with(split(text, {_literal(CANDIDATE)}, -1), candidates, (p, m) -> named_struct('p', p, 'm', m)), random, (x, r) -> named_struct('p', x.p, 'm', x.m, 'r', r)),
        named_struct('at', 0, 'out', cast(array() as {_SPAN})),
        (a, x) -> named_struct('at', a.at + length(x.p) + coalesce(length(x.m), 0), 'out', if(coalesce(x.r, false),
            array_append(a.out, named_struct('start', a.at + length(x.p), 'rank', {len(KINDS)}, 'end', a.at + length(x.p) + length(x.m), 'kind', 'markov')), a.out)),
        a -> a.out)"""
    more = F.expr(f"case when exists(random, r -> r) then filter({places}, c -> not exists(base, b -> b.start < c.end and c.start < b.end)) end")
    text = text.withColumn("more", more)
    return text.withColumn("spans", F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"))).otherwise(F.col("base"))).drop("candidates", "random", "more")


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text, base, spans with models trained on docs; null texts are empty."""
    source = documents(docs)
    return find(source, transitions(steps(labelled(source))))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """doc_id and the text with every span replaced by a mark."""
    keep = """aggregate(spans, named_struct('at', 1, 'out', ''), (a, x) -> if(x.end < a.at, a,
        named_struct('at', x.end + 1, 'out', concat(a.out, substring(text, a.at, greatest(0, x.start + 1 - a.at)), '{mark}'))), a -> concat(a.out, substring(text, a.at)))"""
    return scan(docs).select("doc_id", F.expr(keep.format(mark=mark)).alias("text"))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of `documents`; see find().

    A null text is empty and has no spans; very long texts and tokens take one pass; spans that start together go by kind; repeated rows
    are rows; an empty table gives none; columns with clashing names are never read."""
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint) as n_{k}") for k, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))
