"""SimHash near-duplicates through vantage-point trees.

Fingerprints that differ in at most RADIUS = 3 of 64 bits differ in at most one bit in one of their two
32-bit halves. So there is one vantage-point tree per half, searched with radius 1: triangle bounds at that
radius prune far better than at radius 3 over all 64 bits, where the distances of unrelated fingerprints lie
within 32 +- 4 and most branches overlap. A fingerprint is a member of one leaf (shard) of each tree and also
visits, as a query, the later shards that its triangle bounds cannot exclude; pairs are then tested on all 64
bits. Equal fingerprints are one node, and a shard returns a spanning forest of its links, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import documents, partitions, release_shuffles, slices, staged, table
from cairn.llm.graph import components

RADIUS = 3
SHINGLE = 3
#: Fingerprints per shard that the routing trees aim at, their largest number of shards, and the sample that they are built from: the trees' size is bounded whatever the input.
SHARD, MAX_SHARDS, SAMPLE = 2048, 4096, 16384
#: The pipeline's stage: words of a shingle, least Jaccard similarity, and bands of min-hashes; by calculation a pair at 0.8 is missed once in 4,600, (1 - 0.8^4)^16.
WORDS, SIMILAR, BAND, BANDS = 5, 0.8, 4, 16
#: Bands with at most so many texts become pairs, each compared once however many bands it shares; of larger ones the texts meet and their groups are spanned.
PAIRED = 32
#: Words of the bit filter for texts with a candidate: 4 MB are broadcast. Where it fills up, more texts are shuffled and the result is the same.
FILTER_WORDS = 1 << 19
_ODD = np.random.default_rng(4_001).integers(1, 1 << 63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, words_per_shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[i:j], 42) for i, j in zip(starts, ends, strict=True)])
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = np.frombuffer(hashes, np.uint8, 8 * min(1 << 15, n - at), 8 * at).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""
    return documents(docs).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _half(fps: np.ndarray, tree: int) -> np.ndarray:
    return ((fps >> np.uint64(32 * tree)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def build_tree(sample: np.ndarray, depth: int) -> list:
    """A routing tree over 32-bit values: [vantage point, inner radius, near, far] or a leaf's number."""
    leaves = iter(range(1 << 30))

    def grow(x: np.ndarray, depth: int) -> list | int:
        if depth == 0 or len(x) < 4:
            return next(leaves)
        d = np.bitwise_count(x ^ x[0])
        mu = int(np.median(d))
        if mu == d.max():
            mu -= 1
        if mu < 0:
            return next(leaves)
        return [int(x[0]), mu, grow(x[d <= mu][1:], depth - 1), grow(x[d > mu], depth - 1)]

    return grow(sample, depth)


def route(x: np.ndarray, tree: list | int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 32-bit values: rows, leaves and whether it is the row's own leaf, for each leaf within reach."""
    rows, leaves, owns = [], [], []
    stack = [(tree, np.arange(len(x)), np.ones(len(x), bool))]
    while stack:
        node, at, own = stack.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            rows.append(at)
            leaves.append(np.full(len(at), node))
            owns.append(own)
            continue
        p, mu, near, far = node
        d = np.bitwise_count(x[at] ^ np.uint32(p)).astype(np.int64)
        reach = d - radius <= mu
        stack.append((near, at[reach], own[reach] & (d[reach] <= mu)))
        reach = d + radius > mu
        stack.append((far, at[reach], own[reach] & (d[reach] > mu)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(owns)


class Forest:
    """Union-find over positions whose links are kept as a spanning forest; roots stay flat for array tests."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.members = {}
        self.links: list[tuple[int, int]] = []

    def add(self, i: int, others: np.ndarray) -> None:
        for j in others[self.root[others] != self.root[i]].tolist():
            a, b = int(self.root[i]), int(self.root[j])
            if a == b:
                continue
            self.links.append((i, j))
            x, y = self.members.pop(a, [a]), self.members.pop(b, [b])
            if len(x) < len(y):
                a, x, y = b, y, x
            self.root[y] = a
            x.extend(y)
            self.members[a] = x


def shard_links(fps: np.ndarray, own: np.ndarray, tree: int, radius: int = RADIUS, leaf: int = 256) -> np.ndarray:
    """Spanning links (pairs of positions) among a shard's members and between members and queries. Large
    shards are split further by vantage points of their own."""
    half, forest = _half(fps, tree), Forest(len(fps))
    inner = radius // 2

    def brute(members: np.ndarray, queries: np.ndarray) -> None:
        x = fps[members]
        for k, i in enumerate(members.tolist()):
            near = np.flatnonzero(np.bitwise_count(x[k + 1 :] ^ fps[i]) <= radius)
            if len(near):
                forest.add(i, members[k + 1 :][near])
        if len(members) > len(queries):
            for i in queries.tolist():
                near = np.flatnonzero(np.bitwise_count(x ^ fps[i]) <= radius)
                if len(near):
                    forest.add(i, members[near])
        elif len(queries):
            y = fps[queries]
            for i in members.tolist():
                near = np.flatnonzero(np.bitwise_count(y ^ fps[i]) <= radius)
                if len(near):
                    forest.add(i, queries[near])

    stack = [(np.flatnonzero(own), np.flatnonzero(~own))]
    while stack:
        members, queries = stack.pop()
        if len(members) <= leaf:
            brute(members, queries)
            continue
        p = half[members[0]]
        d, dq = (np.bitwise_count(half[x] ^ p).astype(np.int64) for x in (members, queries))
        mu = int(np.median(d))
        if mu == d.max():
            mu -= 1
        if mu < 0:
            brute(members, queries)
            continue
        far = members[d > mu]
        stack.append((members[d <= mu], np.concatenate([queries[dq - inner <= mu], far[d[d > mu] - inner <= mu]])))
        stack.append((far, queries[dq + inner > mu]))
    return np.array(forest.links, np.int64).reshape(-1, 2)


def _links(group: pa.Table) -> pa.Table:
    fps = group.column("fp").to_numpy().view(np.uint64)
    found = shard_links(fps, group.column("own").to_numpy(), group.column("tree")[0].as_py())
    fps = fps.view(np.int64)
    return pa.table({"a": pa.array(fps[found[:, 0]]), "b": pa.array(fps[found[:, 1]])})


def links(fps: DataFrame) -> DataFrame:
    """fps: one row for each different fp. Returns links a, b that span the graph of all pairs within RADIUS bits."""
    spark = fps.sparkSession
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, min(MAX_SHARDS, n / SHARD))))))
    picked = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow().column("fp").to_numpy().view(np.uint64)
    trees = [build_tree(_half(picked, t), depth) for t in (0, 1)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            for t, tree in enumerate(trees):
                rows, leaf, own = route(_half(x, t), tree, RADIUS // 2)
                mine = np.zeros(len(x), np.int64)
                mine[rows[own]] = leaf[own]
                keep = own | (leaf > mine[rows])  # a pair meets in the later of its two shards
                rows, leaf, own = rows[keep], leaf[keep], own[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(x[rows].view(np.int64)), pa.array(own)], ["tree", "leaf", "fp", "own"])

    spreading = fps.repartition(partitions(spark)).mapInArrow(spread, "tree int, leaf int, fp long, own boolean")
    return spreading.groupBy("tree", "leaf").applyInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints that differ in RADIUS bits or
    fewer. A null or empty text has fingerprint zero. Repeated rows of a doc_id stay rows; a null doc_id never
    names a component unless no other row is in it."""
    found = staged(fingerprints(docs), "fingerprints")
    nodes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    comps = staged(components(links(nodes.select("fp"))), "components")
    named = nodes.join(comps, nodes.fp == comps.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(named.select("fp", "root").join(least, "root").drop("root"), "fp")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of `documents`; see near_duplicates() for nulls, empty texts, repeated rows and
    ties. Very long texts are hashed whole; an empty table gives none; columns with clashing names are never read."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str) -> np.ndarray:
    """The different XXH64 of a text's shingles of WORDS words, sorted; of all its words where it has fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    k = min(WORDS, len(words))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if k else [], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, node, fp and bands of every text: the fingerprint of its shingles, and for each band BAND min-hashes together (none without a word)."""
    for batch in slices(batches, "text"):
        fps, bands = [], []
        for text in batch.column("text").to_pylist():
            x = shingles(text)
            ones = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            fps.append(np.packbits(2 * ones > len(x)).view(">i8")[0])
            least = np.array([((x ^ (x >> np.uint64(31))) * m).min() for m in _ODD]) if len(x) else np.zeros(0, np.uint64)
            bands.append(np.array([xxhash.xxh64_intdigest(least[k : k + BAND].tobytes(), k) for k in range(0, len(least), BAND)], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(np.array(fps, np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "node", "fp", "bands"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of the pairs of texts x, y whose Jaccard similarity is SIMILAR or more."""
    for batch in slices(batches, "x"):
        same = [jaccard(shingles(x), shingles(y)) >= SIMILAR for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))


def _similar(group: pa.Table) -> pa.Table:
    """Spanning links of the texts of one band value whose Jaccard similarity is SIMILAR or more."""
    nodes, sets = group.column("node").to_numpy(), [shingles(t) for t in group.column("text").to_pylist()]
    root, found = np.arange(len(nodes)), []
    for i in range(len(nodes) - 1):
        for j in (np.flatnonzero(root[i + 1 :] != root[i]) + i + 1).tolist():
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= SIMILAR:
                root[root == root[j]] = root[i]
                found.append((nodes[i], nodes[j]))
    at = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(at[:, 0]), "b": pa.array(at[:, 1])})


def _texts(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text, once each, of the nodes among wanted. A bit filter of 4 MB leaves most other texts where they are."""
    bit = F.pmod("node", F.lit(64 * FILTER_WORDS))
    bits = wanted.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {64 * FILTER_WORDS}) % 64 as int))")).alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, np.uint64)
    words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    sent = found.sparkSession.sparkContext.broadcast(words)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            at = batch.column("node").to_numpy() % (64 * FILTER_WORDS)
            yield batch.filter(pa.array((words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return found.select("node", "text").mapInArrow(pick, "node long, text string").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def candidates(nodes: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of nodes to compare, a < b, and value, node of bands with over PAIRED nodes, whose texts meet instead.

    nodes: node, fp. The vantage-point trees give links that span all fingerprints within RADIUS bits; they find some of the near duplicates
    only, and the bands of met (value, node) the others."""
    prints = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    apart = links(prints.select("fp")).join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select("x", "y")
    equal = nodes.join(prints, "fp").select(F.col("least").alias("x"), F.col("node").alias("y"))
    sizes = met.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    groups = met.join(sizes, "value")
    few = groups.where(F.col("n") <= PAIRED).groupBy("value").agg(F.array_sort(F.collect_list("node")).alias("s")).select("s").distinct()
    each = few.select(F.posexplode("s").alias("at", "x"), "s").select("x", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("y"))
    pairs = apart.union(equal).union(each).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs, groups.where(F.col("n") > PAIRED).select("value", "node")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id (rows that repeat
    it stay). Near duplicates have a Jaccard similarity of SIMILAR or more over shingles of WORDS words; texts are compared whose
    fingerprints the vantage-point trees link, or that share BAND min-hashes in one of BANDS bands. Null and empty texts are equal."""
    spark = docs.sparkSession
    release_shuffles(spark)
    found = documents(docs).withColumn("node", F.xxhash64("text"))
    sketches = staged(found.mapInArrow(_sketches, "doc_id long, node long, fp long, bands array<long>"), "sketches")
    nodes = staged(sketches.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    pairs, many = (staged(x, "candidates") for x in candidates(nodes.select("node", "fp"), nodes.select(F.explode("bands").alias("value"), "node")))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(many.select("node")).distinct()
    texts = staged(_texts(found, wanted), "texts")
    release_shuffles(spark)
    alike = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").mapInArrow(_alike, "a long, b long")
    together = many.join(texts, "node").groupBy("value").applyInArrow(_similar, "a long, b long")
    comps = staged(components(alike.union(together)), "components").toDF("member", "root")
    named = nodes.join(comps, F.col("node") == F.col("member"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    firsts = sketches.select("doc_id", "node").join(named.select("node", "root"), "node").join(least, "root")
    gone = staged(firsts.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("least")).alias("kept")).where("not kept").select("doc_id"), "gone")
    release_shuffles(spark)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
