"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words are broadcast in shards of at most SHARD_BYTES of text, each of which becomes one automaton;
what is broadcast never grows with the documents. Documents stream through it: the automaton's state gives the
longest match that ends at each word, and from it every window that ends there."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import held, set_aside, slices, staged, table

WINDOW, MAX_COVERAGE, SHARD_BYTES = 10, 0.5, 1 << 20
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str) -> list[bytes]:
    """The words of a text: runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the windows that end in each state."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.vocabulary = [-1], [0], {}
        own: dict[int, dict[int, set]] = {}
        paths = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if ids:
                last = 0
                for w in ids:
                    last = self._extend(last, w)
                paths.append((item, ids))
        for item, ids in paths:
            state, size = 0, min(window, len(ids))
            for k, w in enumerate(ids, 1):
                state = self.next[state][w]
                if k >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    own.setdefault(at, {}).setdefault(size, set()).add("" if item is None else str(item))
        self.shortest = min((n for x in own.values() for n in x), default=0)
        self.windows: dict[int, list[tuple[int, frozenset]]] = {}
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            found = [(n, frozenset(x)) for n, x in own.get(state, {}).items()] + self.windows.get(self.link[state], [])
            if found:
                self.windows[state] = found

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, after the last) and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set[str] = set()
        if not self.windows or len(found) < self.shortest:
            return [], items
        ids = np.fromiter(map(self.vocabulary.get, found, itertools.repeat(-1)), np.int64, len(found))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        for start, end in edges.reshape(-1, 2)[np.diff(edges)[::2] >= self.shortest].tolist():
            state = size = 0
            for k, w in enumerate(ids[start:end].tolist(), start + 1):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if w in self.next[state]:
                    state, size = self.next[state][w], size + 1
                if size >= self.shortest and (ending := [x for x in self.windows.get(state, ()) if x[0] <= size]):
                    items.update(*(x[1] for x in ending))
                    first = k - max(x[0] for x in ending)
                    if spans and first <= spans[-1][1]:
                        while len(spans) > 1 and first <= spans[-2][1]:
                            spans.pop()
                        spans[-1] = [min(first, spans[-1][0]), k]
                    else:
                        spans.append([first, k])
        return [(a, b) for a, b in spans], items


def automata(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[str, Broadcast]]:
    """The items in broadcasts of about shard_bytes of text at most, each with a name that no other one has."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        yield uuid.uuid4().hex, sc.broadcast([tuple(r) for r in part.orderBy("item_id", "text").toLocalIterator()])


def _automaton(name: str, items: Broadcast, window: int) -> Automaton:
    """The worker's automaton of a shard; not kept by the broadcast's address, which a reused worker frees and gives to the next one."""
    key, built = (name, window), held("automaton")
    if key not in built:
        built.clear()
        built[key] = Automaton(items.value, window)
    return built[key]


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


SPANS = "array<struct<start:int,end:int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with n_words, hits (runs of hit words, end exclusive) and items (ids of items with occurring
    windows, sorted as strings). A null text has no words; a null item_id is listed as an empty string; items
    that share an id count once. All columns of docs are kept."""
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast(SPANS), "items": F.lit(None).cast("array<string>")})
    schema = out.schema
    for k, (name, items) in enumerate(automata(benchmark, shard_bytes)):

        def scan(batches: Iterator[pa.RecordBatch], name: str = name, items: Broadcast = items) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, items, window)
            for batch in slices(batches, "text"):
                n, hits, ids = [], [], []
                for text, spans, known in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "items")), strict=True):
                    found = words(text or "")
                    own, more = automaton.scan(found)
                    n.append(len(found))
                    hits.append([{"start": a, "end": b} for a, b in _union([(x["start"], x["end"]) for x in spans or ()], own)])
                    ids.append(sorted(more.union(known or ())))
                new = {"n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, batch.schema.field("hits").type), "items": pa.array(ids, batch.schema.field("items").type)}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

        out = (staged(out, "contamination") if k else out).mapInArrow(scan, schema)
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without those runs of words."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(data.translate(_WORD_BYTES))]
    out, last = [], 0
    for start, end in spans:
        out.append(data[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without the hit spans; documents of whose words more than max_coverage are hit go altogether.
    Texts without a hit stay as they are."""
    docs, kept = set_aside(docs, "n_words", "hits", "items")
    found = contamination(docs, benchmark, window)
    covered = F.aggregate("hits", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    found = found.where(covered <= max_coverage * F.col("n_words"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits").to_pylist()
            if any(hits):
                new = [cut(t, [(x["start"], x["end"]) for x in h]) if h else t for t, h in zip(batch.column("text").to_pylist(), hits, strict=True)]
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, batch.schema.field("text").type))
            yield batch

    out = found.mapInArrow(clean, found.schema)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size("hits") > 0, length).otherwise(F.col("n_chars")))
    return out.select(*kept)


#: The query's rows in SQL: windows joined with windows.
SQL = r"""with b as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
  bw as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item, w, least(10, len(w)) as n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)),
  d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
  dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from bw) where len(w) >= n)),
  h as (select doc_id, i, n, item from dw join bw using (n, g)),
  p as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as k from h) group by doc_id),
  s as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
  select d.doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
  from d left join p using (doc_id) left join s using (doc_id)"""


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of `documents`; see contamination().

    A null or empty text has no words; very long texts stream through whole; repeated rows are rows; an empty table gives none, and with
    an empty benchmark nothing is hit; columns with clashing names are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
