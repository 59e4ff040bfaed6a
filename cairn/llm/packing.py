"""Packing of token sequences by a grouping genetic algorithm on islands.

Pieces are dealt into cells of about CELL pieces. Each cell is packed by ISLANDS populations that evolve apart; a
crossover injects whole well-filled sequences of one parent into the other, takes the sequences with duplicates
out, exchanges what was displaced with smaller items wherever a sequence gets fuller by it, and best-fits the rest. Between epochs each island's elite migrates to the next island. The poorly
filled sequences of all cells are then pooled and packed again, so that cells cost next to nothing. No cell grows
with the input; epochs are written to the shared folder."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import documents, held, slices, staged, table
from cairn.llm.tokens import WordTokenizer

CAPACITY, VOCABULARY = 2048, "word_bpe_49k.json"
CELL, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 8192, 2, 6, 3, 20
#: Sequences filled less than this are pooled over all cells and packed again.
POOR = 0.97

def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 of every document's ids (and a closing id 0), cut only where
    they exceed the capacity."""
    path = path or public_tokenizers.path(VOCABULARY)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held("tokens")
        if path not in known:
            known[path] = WordTokenizer(path)
        tokenizer = known[path]
        for batch in slices(batches, "text", 2 << 20):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokenizer.ids(text) + b"\0\0\0\0"
                n = len(ids) // 4
                rows += [(doc, k, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * min(n, at + capacity)])) for k, at in enumerate(range(0, n, capacity))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "piece" else pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names)

    out = documents(docs).mapInArrow(tokenize, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("uid", F.monotonically_increasing_id())


class Bins:
    """Sequences being filled: for each item its sequence, for each sequence its free room."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.of = np.full(len(sizes), -1, np.int64)
        self.free: list[int] = []

    @classmethod
    def restore(cls, sizes: np.ndarray, capacity: int, of: np.ndarray) -> Bins:
        """From an assignment in which some items are displaced (-1); sequences are numbered anew."""
        out = cls(sizes, capacity)
        placed = of >= 0
        names, number = np.unique(of[placed], return_inverse=True)
        out.of[placed] = number
        out.free = (capacity - np.bincount(number, sizes[placed], len(names)).astype(np.int64)).tolist()
        return out

    def best_fit(self, items: list[int]) -> None:
        """Each item, in this order, to the sequence that it leaves the least room in."""
        rooms: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        for k, room in enumerate(self.free):
            rooms[room].append(k)
        mask = sum(1 << r for r, x in enumerate(rooms) if x)
        sizes, of, free = self.sizes.tolist(), self.of, self.free
        for i in items:
            fitting = mask >> sizes[i]
            if fitting:
                room = sizes[i] + (fitting & -fitting).bit_length() - 1
                k = rooms[room].pop()
                if not rooms[room]:
                    mask ^= 1 << room
                room -= sizes[i]
            else:
                k, room = len(free), self.capacity - sizes[i]
                free.append(0)
            of[i], free[k] = k, room
            rooms[room].append(k)
            mask |= 1 << room


def fitness(bins: Bins) -> tuple[int, float]:
    """Fewer sequences first, then unevenly filled ones."""
    fill = 1 - np.array(bins.free) / bins.capacity
    return -len(bins.free), float((fill**2).sum())


def cross(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    """a with some of b's best-filled sequences: a's sequences that share an item with them go, and their other
    items are displaced and best-fitted."""
    free = np.array(b.free)
    well = np.flatnonzero(free <= np.quantile(free, 0.5))
    chosen = rng.choice(well, max(1, len(well) // 4), replace=False)
    injected = np.isin(b.of, chosen)
    gone = np.unique(a.of[injected])
    of = np.where(np.isin(a.of, gone), -1, a.of)
    of[injected] = len(a.free) + b.of[injected]
    return _refilled(a.sizes, a.capacity, of, rng)


def mutate(a: Bins, rng: np.random.Generator) -> Bins:
    """a with its emptiest sequences and a few others emptied and best-fitted."""
    free = np.array(a.free)
    gone = np.concatenate([np.argsort(-free, kind="stable")[: max(1, len(free) // 50)], rng.integers(0, len(free), max(1, len(free) // 50))])
    return _refilled(a.sizes, a.capacity, np.where(np.isin(a.of, gone), -1, a.of), rng)


def exchange(bins: Bins, rng: np.random.Generator) -> None:
    """Displaced items for smaller ones: in each sequence, the displaced item that fills it most in place of one or two of its own. What is
    displaced gets smaller, and so easier to place."""
    left = np.flatnonzero(bins.of < 0)
    left = left[np.argsort(bins.sizes[left], kind="stable")]
    items, sizes = left.tolist(), bins.sizes[left].tolist()
    order = np.argsort(bins.of, kind="stable")[len(left) :]
    ends = np.searchsorted(bins.of[order], np.arange(len(bins.free)), "right").tolist()
    all_sizes, order, free, of = bins.sizes.tolist(), order.tolist(), bins.free, bins.of
    for k in rng.permutation(len(free)).tolist():
        room = free[k]
        if not room or not items:
            continue
        own = order[ends[k - 1] if k else 0 : ends[k]]
        best, chosen = 0, None
        for a, x in enumerate(own):
            for y in (None, *own[a + 1 :]):
                size = all_sizes[x] + (all_sizes[y] if y is not None else 0)
                at = bisect.bisect_right(sizes, size + room) - 1
                if at >= 0 and sizes[at] - size > best:
                    best, chosen = sizes[at] - size, (at, x, y)
        if chosen:
            at, x, y = chosen
            of[items[at]], free[k] = k, room - best
            del items[at], sizes[at]
            for i in (x, y):
                if i is not None:
                    of[i] = -1
                    at = bisect.bisect_right(sizes, all_sizes[i])
                    items.insert(at, i)
                    sizes.insert(at, all_sizes[i])


def _refilled(sizes: np.ndarray, capacity: int, of: np.ndarray, rng: np.random.Generator) -> Bins:
    out = Bins.restore(sizes, capacity, of)
    exchange(out, rng)
    left = np.flatnonzero(out.of < 0)
    out.best_fit(left[np.argsort(-sizes[left] * rng.uniform(0.97, 1.0, len(left)), kind="stable")].tolist())
    return out


def evolve(sizes: np.ndarray, capacity: int, start: list[np.ndarray], seed: list[int]) -> list[np.ndarray]:
    """A population's assignments after GENERATIONS, the elite first. start: assignments to begin with."""
    rng = np.random.default_rng(seed)
    people = [Bins.restore(sizes, capacity, of) for of in start]
    while len(people) < POPULATION:
        first = Bins(sizes, capacity)
        noise = rng.uniform(0.9, 1.0, len(sizes)) if people or seed[-1] % ISLANDS else 1.0
        first.best_fit(np.argsort(-sizes * noise, kind="stable").tolist())
        people.append(first)
    least = -(-int(sizes.sum()) // capacity)
    for _ in range(GENERATIONS):
        people.sort(key=fitness, reverse=True)
        people = people[:POPULATION]
        if len(people[0].free) <= least:
            break
        child = cross(people[0], people[1 + int(rng.integers(len(people) - 1))], rng)
        people += [child, mutate(child, rng), mutate(people[0], rng)]
    people.sort(key=fitness, reverse=True)
    return [p.of for p in people[:POPULATION]]


_STATE = "cell long, island int, uids array<long>, sizes array<int>, people array<binary>"


def _found(group: pa.Table, capacity: int) -> pa.Table:
    """The first epoch of a cell's islands."""
    uids, sizes = group.column("uid").to_numpy(), group.column("length").to_numpy()
    order = np.lexsort((uids, -sizes))
    uids, sizes, cell = uids[order], sizes[order], group.column("cell")[0].as_py()
    people = [evolve(sizes, capacity, [], [cell, 0, k]) for k in range(ISLANDS)]
    return _table([(cell, k, uids, sizes, x) for k, x in enumerate(people)])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table({
        "cell": pa.array([r[0] for r in rows], pa.int64()), "island": pa.array([r[1] for r in rows], pa.int32()),
        "uids": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "sizes": pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())),
        "people": pa.array([[p.astype("<i4").tobytes() for p in r[4]] for r in rows], pa.list_(pa.binary())),
    })


def _epoch(group: pa.Table, capacity: int, epoch: int) -> pa.Table:
    """An island with the elite that has come to it."""
    rows = sorted(group.to_pylist(), key=lambda r: r["uids"] is None)
    own, sizes = rows[0], np.array(rows[0]["sizes"], np.int64)
    people = [np.frombuffer(p, "<i4").astype(np.int64) for r in rows for p in r["people"]]
    return _table([(own["cell"], own["island"], np.array(own["uids"]), sizes, evolve(sizes, capacity, people, [own["cell"], epoch, own["island"]]))])


def _evolving(capacity: int, epoch: int):
    return lambda group: _epoch(group, capacity, epoch)


def _placed(group: pa.Table, capacity: int) -> pa.Table:
    """The best island's assignment: uid, bin, offset, fill."""
    best = None
    for r in sorted(group.to_pylist(), key=lambda r: r["island"]):
        sizes = np.array(r["sizes"], np.int64)
        bins = Bins.restore(sizes, capacity, np.frombuffer(r["people"][0], "<i4").astype(np.int64))
        if best is None or fitness(bins) > fitness(best[1]):
            best = np.array(r["uids"]), bins
    uids, bins = best
    order = np.argsort(bins.of, kind="stable")
    ends = np.cumsum(bins.sizes[order])
    first = np.concatenate(([True], np.diff(bins.of[order]) != 0))
    before = ends - bins.sizes[order]
    offset = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(order))))
    return pa.table({"uid": uids[order], "cell": np.full(len(order), group.column("cell")[0].as_py()), "bin": bins.of[order], "offset": offset, "fill": capacity - np.array(bins.free)[bins.of[order]]})


def _evolved(items: DataFrame, capacity: int, cell: int) -> DataFrame:
    """items: uid, length. Returns uid, cell, bin, offset, fill."""
    cells = max(1, -(-items.count() // cell))
    dealt = items.select(F.pmod(F.xxhash64("uid"), F.lit(cells)).alias("cell"), "uid", "length")
    state = staged(dealt.groupBy("cell").applyInArrow(lambda g: _found(g, capacity), _STATE), "islands")
    for epoch in range(1, EPOCHS):
        elite = state.select("cell", ((F.col("island") + 1) % ISLANDS).alias("island"), F.lit(None).cast("array<long>").alias("uids"), F.lit(None).cast("array<int>").alias("sizes"), F.slice("people", 1, 1).alias("people"))
        state = staged(state.unionByName(elite).groupBy("cell", "island").applyInArrow(_evolving(capacity, epoch), _STATE), "islands")
    return state.groupBy("cell").applyInArrow(lambda g: _placed(g, capacity), "uid long, cell long, bin long, offset long, fill long")


def pack(items: DataFrame, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """items: uid, length (1 to capacity). Returns uid, sequence_id, offset; every item is in one sequence, and a
    sequence's items fill it without gaps from 0."""
    first = staged(_evolved(items, capacity, cell), "packed")
    poor = first.where(F.col("fill") < POOR * capacity)
    pooled = poor.join(items.select("uid", "length"), "uid").select("uid", "length")
    again = staged(_evolved(pooled, capacity, cell), "packed")
    fewer = again.select("cell", "bin").distinct().count() <= poor.select("cell", "bin").distinct().count()
    name = F.col("cell") * (1 << 24) + F.col("bin")
    if not fewer:
        return first.select("uid", (name * 2).alias("sequence_id"), "offset")
    return first.where(F.col("fill") >= POOR * capacity).select("uid", (name * 2).alias("sequence_id"), "offset").union(again.select("uid", (name * 2 + 1).alias("sequence_id"), "offset"))


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece of every document and its place. A null text is empty and has the closing id only; repeated rows
    are packed as often as they occur."""
    found = staged(pieces(docs, capacity, path), "pieces")
    return found.join(pack(found.select("uid", "length"), capacity), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of every row of `documents`.

    A null text is empty and has the closing id only; longer documents are cut into pieces of the capacity; repeated rows are packed
    as often as they occur; ties of fill go by the order of the items; an empty table gives none; columns with clashing names are
    never read."""
    return packed(table(spark, sf_dir, "documents"))
