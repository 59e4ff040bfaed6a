"""Removal of repeated byte strings by prefix-free parsing.

Any LENGTH consecutive bytes are a window; a window is repeated if the same bytes start earlier (smaller doc_id, or the
same document before). A rolling hash over GRAM bytes gives every window its trigger, the place of the least hash in it, so
that equal windows have equal triggers wherever they stand. Consecutive windows with one trigger make a phrase; phrases
overlap by LENGTH - 1 bytes, no phrase cuts a window, and a window lies in one phrase. So the corpus is a dictionary
of different phrases and a parse, the places of each:

1. Phrases are grouped by trigger and by content, both by 64-bit hashes. All but the first place of a phrase are repeated
   altogether. Places of phrases that occur before in the same batch never leave it.
2. Different phrases with equal triggers may share windows at their ends (where a copy begins or stops). Only these are
   fetched: a suffix array of the dictionary, sorted to LENGTH bytes by prefix doubling, gives the classes of equal windows,
   and the parse gives each class its first place in corpus order.
3. A trigger with more than HOT places (a line that a third of all documents have, each in other surroundings) is never
   gathered in one task: its places are dealt by content, and the windows of its phrases are grouped by two further hashes of
   their bytes, counted before they are shuffled like any aggregate.

All matches are judged on the input and never cross documents. Hashes travel packed by shard; the texts are shuffled by
document to fetch phrases and to cut what is repeated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import documents, partitions, slices, staged, table

LENGTH, GRAM, BATCH_BYTES = 100, 32, 2 << 20
#: Places from which a trigger is hot, the share of documents (one in SHARE) that its count is estimated from, and how many hot triggers are told apart at most, the hottest first.
HOT, SHARE, MAX_HOT = 1 << 20, 64, 1 << 16
_BYTE = np.random.default_rng(10_007).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ROLL, _BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = 31  # bits for a place in a batch, as many as an array of bytes can have: the same hash bits decide at every size


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def phrases(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """data: the bytes of documents one after another. For every phrase: document (position), first byte and
    first byte of its last window (both within the document), hash of its trigger, hash of its content."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data)
    if n < LENGTH:
        return empty
    values = _BYTE[data]
    gram, k = values, 1
    while k < GRAM:
        gram = gram[:-k] * np.uint64(pow(_ROLL, k, 1 << 64)) + gram[k:]
        k *= 2
    gram = _mix(gram)
    low = np.uint64((1 << _PLACES) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)  # equal hashes: the first place
    width, k = LENGTH - GRAM + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    trigger = (least & low).astype(np.int64)
    document = np.repeat(np.arange(len(starts)), np.maximum(sizes - LENGTH + 1, 0))
    at = np.arange(len(document)) - np.repeat(np.cumsum(np.maximum(sizes - LENGTH + 1, 0)) - np.maximum(sizes - LENGTH + 1, 0), np.maximum(sizes - LENGTH + 1, 0))
    window = starts[document] + at
    if not len(window):
        return empty
    own = trigger[window]
    begins = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (document[1:] != document[:-1]))))
    ends = np.append(begins[1:], len(window)) - 1
    steps = np.full((2, n + 1), 1, np.uint64)
    steps[0, 1:], steps[1, 1:] = np.uint64(_BASE), np.uint64(_INVERSE)
    up, down = (np.multiply.accumulate(x) for x in steps)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(values * up[:-1], dtype=np.uint64)))
    first, last = window[begins], window[ends]
    content = _mix((sums[last + LENGTH] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(_ROLL))
    return document[begins], at[begins], at[ends], gram[own[begins]], content


_ROW = np.dtype([("trigger", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("first", "<i4"), ("last", "<i4")])


def _pack(rows: np.ndarray) -> bytes:
    """Column by column, so that sorted ids and places take little room."""
    return zstandard.ZstdCompressor(level=1).compress(len(rows).to_bytes(8, "little") + b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in _ROW.names))


def _unpack(blob: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at = int.from_bytes(data[:8], "little"), 8
    out = np.zeros(n, _ROW)
    for name in _ROW.names:
        kind = _ROW[name]
        out[name] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


def _firsts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a place is the first one with its two hashes."""
    order = np.lexsort((b, a))  # stable
    out = np.ones(len(a), bool)
    out[order[1:]] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return out


def _merged(docs: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of each document, adjacent and overlapping ones joined. Input sorted by document and first."""
    if not len(docs):
        return docs, first, last
    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (first[1:] > last[:-1] + 1)))
    at = np.flatnonzero(new)
    return docs[at], first[at], np.maximum.reduceat(last, at)


def _triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "data", BATCH_BYTES):
        texts = batch.column("data").to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        found, n = np.unique(phrases(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["trigger", "n"])


def hot_triggers(docs: DataFrame, least: int = HOT) -> np.ndarray:
    """The triggers with about `least` places or more. What is missed or taken in excess changes the way, not the result."""
    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(SHARE)) == 0).mapInArrow(_triggers, "trigger long, n long")
    found = some.groupBy("trigger").agg(F.sum("n").alias("n")).where(F.col("n") * SHARE >= least).orderBy(F.desc("n"), "trigger").limit(MAX_HOT)
    return np.sort(np.array([r.trigger for r in found.collect()], np.int64).view(np.uint64))


def _parse(batches: Iterator[pa.RecordBatch], shards: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each batch, one packed row a shard with the first places of its phrases (shard from 0), and one packed row
    with the places that are repeated within the batch (shard from `shards` on)."""
    serial = 0
    for batch in slices(batches, "data", BATCH_BYTES):
        order = np.argsort(batch.column("doc").to_numpy(), kind="stable")
        ids = batch.column("doc").to_numpy()[order]
        texts = batch.column("data").to_pylist()
        texts = [texts[k] for k in order.tolist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        document, first, last, trigger, content = phrases(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
        rows = np.zeros(len(document), _ROW)
        rows["trigger"], rows["content"], rows["doc"], rows["first"], rows["last"] = trigger, content, ids[document], first, last
        fresh = _firsts(trigger, content)
        out_shard, out_blob = [], []
        known = rows[~fresh]
        if len(known):
            docs, a, b = _merged(known["doc"], known["first"], known["last"])
            runs = np.zeros(len(docs), _ROW)
            runs["doc"], runs["first"], runs["last"] = docs, a, b
            out_shard.append(shards + serial % shards)
            out_blob.append(_pack(runs))
            serial += 1
        rows = rows[fresh]
        key = np.where(np.isin(rows["trigger"], hot), _mix(rows["content"]), rows["trigger"])
        shard = (key % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(shards + 1)).tolist()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                out_shard.append(k)
                out_blob.append(_pack(rows[by[a:b]]))
        yield pa.RecordBatch.from_arrays([pa.array(out_shard, pa.int32()), pa.array(out_blob, pa.binary())], ["shard", "blob"])


#: state: REPEATED altogether, OPEN (to be compared with the phrases of its trigger), or OPEN under a hot trigger.
REPEATED, OPEN, OPEN_HOT = 0, 1, 2
_FOUND = "doc long, first int, last int, state int, trigger long"


def _found(docs: np.ndarray, first: np.ndarray, last: np.ndarray, state: np.ndarray | int = REPEATED, trigger: np.ndarray | None = None) -> pa.RecordBatch:
    trigger = np.zeros(len(docs), np.int64) if trigger is None else trigger.view(np.int64)
    state = np.broadcast_to(np.asarray(state, np.int32), len(docs))
    return pa.RecordBatch.from_arrays([pa.array(docs.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(np.array(state)), pa.array(trigger)], ["doc", "first", "last", "state", "trigger"])


def _judge(rows: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All places of some triggers: those repeated altogether, and (open) first places of phrases that share a trigger
    with another phrase."""
    rows = rows[np.lexsort((rows["first"], rows["doc"], rows["content"], rows["trigger"]))]
    same = rows["trigger"][1:] == rows["trigger"][:-1]
    fresh = np.concatenate(([True], ~(same & (rows["content"][1:] == rows["content"][:-1]))))
    known = rows[~fresh]
    if len(known):
        known = known[np.lexsort((known["first"], known["doc"]))]
        yield _found(*_merged(known["doc"], known["first"], known["last"]))
    rows = rows[fresh]
    same = rows["trigger"][1:] == rows["trigger"][:-1]
    is_hot = np.isin(rows["trigger"], hot)
    kept = np.concatenate(([False], same)) | np.concatenate((same, [False])) | is_hot
    rows, is_hot = rows[kept], is_hot[kept]
    if len(rows):
        yield _found(rows["doc"], rows["first"], rows["last"], np.where(is_hot, OPEN_HOT, OPEN), rows["trigger"].copy())


def _gather(batches: Iterator[pa.RecordBatch], shards: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by shard, one shard in memory at a time."""
    held, now = [], -1
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if shard >= shards:
                runs = _unpack(blob)
                yield _found(runs["doc"], runs["first"], runs["last"])
                continue
            if shard != now and held:
                yield from _judge(np.concatenate(held), hot)
                held = []
            now = shard
            held.append(_unpack(blob))
    if held:
        yield from _judge(np.concatenate(held), hot)


def window_classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For windows that start at these places of data: numbers that are equal for equal bytes. Ranks of 1, 2, 4 ... bytes
    by prefix doubling; two overlapping ranks make LENGTH bytes."""
    rank, k = data.astype(np.int64), 1
    while 2 * k <= LENGTH:
        pair = rank[:-k] * (int(rank.max()) + 1) + rank[k:]
        rank = np.unique(pair, return_inverse=True)[1]
        k *= 2
    return np.unique(rank[starts] * (int(rank.max()) + 1) + rank[starts + LENGTH - k], return_inverse=True)[1]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open phrases sorted by trigger: the windows that another phrase has at an earlier place."""

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[1], r[2]))
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        counts = np.array([r[3] - r[2] + 1 for r in rows])
        sizes = counts + LENGTH - 1
        owner = np.repeat(np.arange(len(rows)), counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        classes = window_classes(data, (np.cumsum(sizes) - sizes)[owner] + at)
        known = np.ones(len(owner), bool)
        known[np.unique(classes, return_index=True)[1]] = False  # rows are in corpus order
        docs, first = np.array([r[1] for r in rows], np.int64)[owner], np.array([r[2] for r in rows], np.int64)[owner] + at
        docs, first = docs[known], first[known]
        order = np.lexsort((first, docs))
        return _found(*_merged(docs[order], first[order], first[order]))

    held, size, now = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("trigger", "doc", "first", "last", "phrase")), strict=True):
            if row[0] != now and size > BATCH_BYTES:
                yield judge(held)
                held, size = [], 0
            now = row[0]
            held.append(row)
            size += len(row[4])
    if held:
        yield judge(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the phrases as two hashes of its bytes and its place; known: an earlier one is in the same batch."""
    for batch in slices(batches, "phrase", BATCH_BYTES // 8):
        order = np.lexsort((batch.column("first").to_numpy(), batch.column("doc").to_numpy()))
        texts = [batch.column("phrase")[k].as_py() for k in order.tolist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start, data = (np.cumsum(sizes) - sizes)[owner] + at, _BYTE[np.frombuffer(b"".join(texts), np.uint8)]
        hashes = []
        for base in (_BASE, _ROLL):
            up, down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(len(data), x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))
            sums = np.concatenate(([np.uint64(0)], np.cumsum(data * up[:-1], dtype=np.uint64)))
            hashes.append(_mix((sums[start + LENGTH] - sums[start]) * down[start]).view(np.int64))
        known = ~_firsts(*hashes)
        docs, first = batch.column("doc").to_numpy()[order][owner], batch.column("first").to_numpy()[order][owner] + at
        yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), pa.array(docs), pa.array(first.astype(np.int32)), pa.array(known)], ["h1", "h2", "doc", "first", "known"])


def _compare_hot(phrases_: DataFrame) -> DataFrame:
    """doc, first, last of the repeated windows among phrases of hot triggers."""
    windows = staged(phrases_.mapInArrow(_windows, "h1 long, h2 long, doc long, first int, known boolean"), "windows")
    place = F.struct("doc", "first")
    fresh = windows.where("not known")
    least = fresh.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = fresh.join(least, ["h1", "h2"]).where(place != F.col("least"))
    return windows.where("known").select("doc", "first").union(later.select("doc", "first")).select("doc", "first", F.col("first").alias("last"))


def repeated_runs(docs: DataFrame, size_hint: int, hot_places: int = HOT) -> DataFrame:
    """docs: doc (long, unique, in corpus order), data (binary). doc, first, last: runs of repeated windows."""
    spark = docs.sparkSession
    n = partitions(spark)
    shards, hot = max(n, size_hint >> 23), hot_triggers(docs, hot_places)
    parsed = docs.mapInArrow(lambda b: _parse(b, shards, hot), "shard int, blob binary")
    found = staged(parsed.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(lambda b: _gather(b, shards, hot), _FOUND), "found")
    asked = found.where(F.col("state") > REPEATED).groupBy("doc").agg(F.collect_list(F.struct("trigger", "first", "last", "state")).alias("asked"))
    some = docs.join(asked, "doc").select("doc", "data", F.explode("asked").alias("a"))
    some = some.select("a.trigger", "a.state", "doc", "a.first", "a.last", F.expr(f"substring(data, a.first + 1, a.last - a.first + {LENGTH})").alias("phrase"))
    if len(hot):
        some = staged(some, "phrases")
    shared = some.where(F.col("state") == OPEN).repartition(n, "trigger").sortWithinPartitions("trigger").mapInArrow(_compare, _FOUND)
    out = found.where(F.col("state") == REPEATED).select("doc", "first", "last").union(shared.select("doc", "first", "last"))
    return out.union(_compare_hot(some.where(F.col("state") == OPEN_HOT))) if len(hot) else out


def _cut(data: bytes, runs: list[dict]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal removed runs."""
    spans: list[list[int]] = []
    for a, b in sorted((r["first"], r["last"] + LENGTH) for r in runs):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    out, last = [], 0
    for a, b in spans:
        out.append(data[last:a])
        last = b
    return b"".join([*out, data[last:]]), sum(b - a for a, b in spans), len(spans)


def without_repeats(docs: DataFrame, hot_places: int = HOT) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans. A null text is empty. Rows are judged in order of doc_id (null
    first), equal ids by text; rows that repeat both stand next to each other, and the later are repeated."""
    source = documents(docs)
    numbered = _numbered(source)
    runs = repeated_runs(numbered.select("doc", "data"), numbered.agg(F.sum(F.octet_length("data"))).first()[0] or 0, hot_places)
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            rows = [(_cut(d, r or []), len(d)) for d, r in zip(batch.column("data").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0][0] for r in rows], pa.binary()), *(pa.array([f(r) for r in rows], pa.int64()) for f in (lambda r: r[1], lambda r: r[0][1], lambda r: r[0][2]))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return numbered.join(runs, "doc", "left").select("doc_id", "data", "runs").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def _numbered(source: DataFrame) -> DataFrame:
    """doc (unique, in corpus order), doc_id, data: doc_id itself where it is unique and not null, else ranks."""
    data = F.col("text").cast("binary").alias("data")
    odd = source.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return source.select(F.col("doc_id").alias("doc"), "doc_id", data)
    from cairn.llm.hilbert import cut

    ranked = cut(source, ["doc_id", "text"], 1)
    return ranked.select(F.col("slot").alias("doc"), "doc_id", data)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of `documents`; see without_repeats().

    A null or empty text has no bytes and the digest of nothing; texts of any length are parsed whole; ties and repeated rows are
    judged as that function says; an empty table gives none; columns with clashing names are never read."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
