"""Ranked lexical search on a tiered index: postings of high impact first, residual bounds for the rest.

Documents are dealt into shards by the batch that they are read in, without a shuffle, so the postings of a frequent
term lie in as many shards as its documents do. In a shard each term's postings are ordered by impact and cut into tiers;
with each tier goes the greatest impact that is left below it. A tier is a few columns of a shard's row, so a round that
needs the first tier reads no other.

A round scores the items' terms on the tiers it has read. A document's score so far is a lower bound, and with the
residual bounds of its missing terms an upper one. What a shard has for an item is proven if no document whose score
is not complete can reach the item's k-th best lower bound over all shards; shards with items that lack this proof
fall through to the next round, which reads a tier more for them. The last tier leaves nothing open, so no result is missed.
Only bounds and results are shuffled, never postings."""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import documents, slices, staged, table
from cairn.llm.decontam import words

#: Text bytes of a shard at most (a longer text is a shard of its own), and of the items that are searched for at once.
SHARD_BYTES, QUERY_BYTES = 4 << 20, 1 << 20
#: So many open shards are named to the next round's scan; where more are open it reads all, and what is proven ends at the first tier again.
NAMED = 10_000
#: The first tiers hold this share of a shard's documents for each term, and LEAST postings at least; the last one holds all the rest.
SHARES, LEAST = (1 / 64, 1 / 8), 16
TIERS = len(SHARES) + 1


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = [len(words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], ["docs", "terms"])

    found = documents(docs).select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _tiers(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int, docs: int) -> list[dict[str, np.ndarray]]:
    """For each tier: ends (of each term's postings), at, impact, and rest (each term's greatest impact in lower tiers)."""
    order = np.lexsort((doc, -impact, term))
    term, doc, impact = term[order], doc[order], impact[order]
    size = np.bincount(term, minlength=terms)
    start = np.cumsum(size) - size
    rank, out, lower = np.arange(len(term)) - start[term], [], np.zeros(terms, np.int64)
    for share in (*SHARES, None):
        upper = size if share is None else np.maximum(lower, np.minimum(size, max(LEAST, math.ceil(docs * share))))
        mine = (rank >= lower[term]) & (rank < upper[term])
        rest = np.zeros(terms, np.int64)
        rest[upper < size] = impact[(start + upper)[upper < size]]
        out.append({"ends": np.cumsum(upper - lower), "at": doc[mine], "impact": impact[mine], "rest": rest})
        lower = upper
    return out


def _shard(batch: pa.RecordBatch, name: int, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One row: the documents of the batch, their terms and the postings by tier."""
    found = [words(t) for t in batch.column("text").to_pylist()]
    n, known = [len(x) for x in found], {}
    ids = np.fromiter((known.setdefault(w, len(known)) for x in found for w in x), np.int64, sum(n))
    key, tf = np.unique(ids * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
    m = np.array([75 + 25 * x * n_docs // max(1, n_terms) for x in n], np.int64)
    term, doc = key // len(n), key % len(n)
    tiers = _tiers(term, doc, impacts(tf.astype(np.int64), m[doc]), len(known), len(n))
    names, columns = ["shard", "docs", "terms", "df"], [pa.array([name], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([list(known)], pa.list_(pa.binary())), pa.array([np.bincount(term, minlength=len(known))], pa.list_(pa.int32()))]
    for k, tier in enumerate(tiers):
        names += [f"{c}_{k}" for c in tier]
        columns += [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in tier.values()]
    return pa.RecordBatch.from_arrays(columns, names)


def _tier_names(k: int) -> list[str]:
    return [f"{c}_{k}" for c in ("ends", "at", "impact", "rest")]


def index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The tiered index of all documents, written to the shared folder: one row a shard with its doc_ids, terms, document
    frequencies and tiers. Every row of docs is a document of its own; a null text has no terms. n_docs, n_terms: statistics(docs)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text", SHARD_BYTES)):
            yield _shard(batch, task << 32 | k, n_docs, n_terms)

    schema = "shard long, docs array<long>, terms array<binary>, df array<int>, " + ", ".join(f"{c} array<int>" for k in range(TIERS) for c in _tier_names(k))
    # a writer holds a row group, and a reader's batch is one at most, so these are small; the writer looks at their size after 100 rows
    # unless it is told to after each, and 100 shards are more than a task has room for
    return staged(documents(docs).mapInArrow(build, schema), "tiers", **{"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"})


class Search:
    """A shard's answer to items, tier by tier."""

    def __init__(self, items: list[dict[bytes, int]], k: int) -> None:
        self.items, self.k = items, k
        self.vocabulary = {t for x in items for t in x}

    def shard(self, row: dict, tiers: int, least: dict[int, int]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """(item, proven, places, scores): all documents that can be among the k best if proven, else the k best lower bounds."""
        at = {t: p for p, t in enumerate(row["terms"]) if t in self.vocabulary}
        ends = [row[f"ends_{k}"] for k in range(tiers)]
        starts = [np.concatenate(([0], x[:-1])) for x in ends]
        for i, item in enumerate(self.items):
            own = [(at[t], w) for t, w in item.items() if t in at and w > 0]
            if not own:
                continue
            place, weight = np.array([p for p, _ in own]), np.array([w for _, w in own], np.int64)
            bar, score, seen = max(1, least.get(i, 0)), np.zeros(len(row["docs"]), np.int64), []
            for k in range(tiers):
                a, b = starts[k][place], ends[k][place]
                which = np.repeat(np.arange(len(place)), b - a)
                pick = np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]
                docs = row[f"at_{k}"][pick]
                np.add.at(score, docs, weight[which] * row[f"impact_{k}"][pick].astype(np.int64))
                seen.append((docs, which))
                rest = weight * row[f"rest_{k}"][place].astype(np.int64)
                missing = np.full(len(score), rest.sum(), np.int64)
                for docs, which in seen:
                    np.subtract.at(missing, docs, rest[which])
                if not ((missing > 0) & (score + missing >= bar)).any():
                    best = np.flatnonzero((score >= bar) & (missing == 0))
                    yield i, True, best, score[best]
                    break
            else:
                best = np.argsort(-score, kind="stable")[: self.k]
                best = best[score[best] > 0]
                yield i, False, best, score[best]


#: kind 0: a document of a proven shard and its score, 1: a lower bound from an open one, 2: an open shard.
_FOUND = "kind int, item int, shard long, doc_id long, score long"


def _round(rows: DataFrame, tiers: int, search, least: dict[int, int], k: int) -> DataFrame:
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, bounds = search.value, {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                name = row.pop("shard").as_py()
                row = {c: v.as_py() if c in ("docs", "terms") else v.values.to_numpy(zero_copy_only=False) for c, v in row.items()}
                found = list(asked.shard(row, tiers, least))
                if all(proven for _, proven, _, _ in found):
                    out = []
                    for i, _, places, scores in found:
                        best = heapq.nsmallest(k, zip((-scores).tolist(), [(row["docs"][p] is None, row["docs"][p] or 0) for p in places.tolist()], strict=True))
                        out += [(0, i, None, None if d[0] else d[1], -s) for s, d in best]
                    yield _batch(out)
                else:
                    for i, _, _, scores in found:
                        bounds[i] = heapq.nlargest(k, [*bounds.get(i, ()), *scores.tolist()])
                    yield _batch([(2, None, name, None, None)])
        yield _batch([(1, i, None, None, s) for i, x in bounds.items() for s in x])

    return rows.mapInArrow(answer, _FOUND)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "item": pa.int32(), "shard": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item with their rank; a task sends k rows an item at most."""
    window = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _search(tiers: DataFrame, items: list[str], n_docs: int, k: int) -> DataFrame:
    """item (place in items), rank, doc_id, score for a block of items."""
    spark = tiers.sparkSession
    counted = [Counter(words(t)) for t in items]
    vocabulary = spark.createDataFrame([(bytearray(w),) for w in sorted({w for c in counted for w in c})], "term binary")
    df = tiers.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.df").alias("df"))
    df = {bytes(r.term): r.df for r in df.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
    weighed = [{w: q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w, q in c.items() if w in df} for c in counted]
    search, least, sure, left = spark.sparkContext.broadcast(Search(weighed, k)), {}, None, None
    for round_ in range(TIERS):
        rows = tiers.select("shard", "docs", "terms", *(c for t in range(round_ + 1) for c in _tier_names(t)))
        found = staged(_round(rows if left is None else rows.where(F.col("shard").isin(left)), round_ + 1, search, least, k), "found")
        proven = found.where("kind = 0").select("item", "doc_id", "score")
        sure = proven if left is None else sure.union(proven)
        left = [r.shard for r in found.where("kind = 2").select("shard").limit(NAMED + 1).toLocalIterator()]
        if not left:
            break
        bounds = _best(sure.union(found.where("kind = 1").select("item", "doc_id", "score")), k)
        least = {r.item: r.score for r in bounds.where(F.col("rank") == k).select("item", "score").toLocalIterator()}
        left = left if len(left) <= NAMED else None
    return _best(sure, k).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """items with rank, doc_id and score: the k documents of highest score above 0 for each row of items, equal scores by ascending
    doc_id (null last). Items (item_id, text) are searched in blocks of QUERY_BYTES of text; a longer one is a block of its own."""
    spark, docs = docs.sparkSession, documents(docs)
    n_docs, n_terms = statistics(docs)
    tiers = index(docs, n_docs, n_terms)
    out, block, ids, size = [], [], [], 0

    def searched() -> DataFrame:
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        return staged(_search(tiers, block, n_docs, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")

    for r in itertools.chain(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator(), [None]):
        if block and (r is None or size + len(r.text) > QUERY_BYTES):
            out.append(searched())
            block, ids, size = [], [], 0
        if r is not None:
            block.append(r.text)
            ids.append(r.item_id)
            size += len(r.text)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    total = out[0]
    for more in out[1:]:
        total = total.union(more)
    return total


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The query's rows in SQL: every posting of every item's terms is scored.
SQL = rf"""with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents), l as (select *, len(w) as n from d where len(w) > 0),
  g as (select count(*) as docs, cast(sum(n) as bigint) as total from l),
  p as (select r, doc_id, n, t, count(*) as tf from (select r, doc_id, n, unnest(w) as t from l) group by all), f as (select t, count(*) as df from p group by t),
  q as (select i, item_id, t, count(*) as qtf from (select i, item_id, unnest(w) as t from (select row_number() over () as i, item_id, {_WORDS} as w from benchmark)) group by all),
  s as (select i, item_id, r, doc_id, cast(sum(qtf * cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) as bigint) as score
    from q join p using (t) join f using (t), g group by all),
  k as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from s where score > 0)
  select item_id, cast(rank as integer) as rank, doc_id, score from k where rank <= 20"""


def op13_ranked(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id and score: the 20 best of all rows of `documents` for each row of `benchmark`; see ranked().

    Null and empty texts have no terms and are never found; an item without terms has no rows; very long texts count whole; rows
    that repeat are documents (or items) of their own; equal scores go by doc_id; empty tables give none; columns with clashing names
    are never read."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
