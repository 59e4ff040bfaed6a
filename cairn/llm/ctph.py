"""Context-triggered piecewise hashing of whole texts.

A rolling hash over WINDOW bytes ends a piece wherever it meets the block size's condition, so an edit changes the pieces
around it only. Each piece gives one of 64 symbols; a fingerprint holds the block size, chosen by the text's length, and the
symbols at this and at double the block size. Fingerprints of equal or neighbouring block sizes are compared by the edit
distance of the symbols at the common size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import documents, partitions, slices, table

#: MOST: symbols of a signature; where boundaries are denser (a periodic text), the last symbol stands for all the rest.
WINDOW, PIECES, SMALLEST, MOST = 7, 64, 3, 256
_SYMBOLS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTE = np.random.default_rng(7_001).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ROLL, _BASE = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def block_size(n: int) -> int:
    """The smallest SMALLEST * 2^k of which PIECES make up n bytes."""
    b = SMALLEST
    while b * PIECES < n:
        b *= 2
    return b


def _symbols(powers: tuple, sums: np.ndarray, cuts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """One string for each text: a symbol for each of its pieces, cut after the bytes in cuts and at its end."""
    filled = ends > starts
    owner = np.searchsorted(ends, cuts + 1, "left")
    cuts = cuts[np.arange(len(cuts)) - np.searchsorted(owner, owner) < MOST - 1]
    stops = np.union1d(cuts + 1, ends[filled])
    text = np.searchsorted(ends, stops, "left")
    begins = np.concatenate(([0], stops[:-1])) if len(stops) else stops
    begins = np.maximum(begins, starts[text]) if len(stops) else begins
    pieces = _mix((sums[stops] - sums[begins]) * powers[1][begins])
    out = _SYMBOLS[(pieces >> np.uint64(58)).astype(np.int64)].tobytes().decode()
    at = np.searchsorted(text, np.arange(len(starts) + 1)).tolist()
    return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def fingerprints(texts: list[str]) -> list[str]:
    """`block size:symbols:symbols at double the size` of each text; equal texts have equal ones."""
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    gap = WINDOW - 1
    data = np.frombuffer(b"".join([x + bytes(gap) for x in blobs]), np.uint8)
    ends = np.cumsum(sizes + gap) - gap
    starts = ends - sizes
    values = _BYTE[data]
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside)[:-1] > 0
    values[~inside] = 0
    roll = values.copy()
    for k in range(1, WINDOW):
        roll[k:] += values[:-k] * np.uint64(pow(_ROLL, k, 1 << 64))
    roll = _mix(roll) >> np.uint64(32)
    blocks = [block_size(n) for n in sizes.tolist()]
    per_byte = np.repeat(np.array(blocks, np.uint64), sizes + gap)
    cuts = np.flatnonzero(inside & (roll % per_byte == per_byte - np.uint64(1)))
    wide = cuts[roll[cuts] % (per_byte[cuts] * np.uint64(2)) == per_byte[cuts] * np.uint64(2) - np.uint64(1)]
    steps = np.full((2, len(data) + 1), 1, np.uint64)
    steps[0, 1:], steps[1, 1:] = np.uint64(_BASE), np.uint64(_INVERSE)
    powers = tuple(np.multiply.accumulate(x) for x in steps)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(values * powers[0][:-1], dtype=np.uint64)))
    one, two = (_symbols(powers, sums, x, starts, ends) for x in (cuts, wide))
    return [f"{b}:{x}:{y}" for b, x, y in zip(blocks, one, two, strict=True)]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _likeness(a: str, b: str) -> float:
    """1 - insertions and deletions / both lengths; 0 without a common run of WINDOW symbols, or of a third of a shorter
    string's (3 at least)."""
    a, b = (re.sub(r"(.)\1{3,}", r"\1\1\1", x) for x in (a, b))  # long runs say little
    n = min(WINDOW, max(3, min(len(a), len(b)) // 3))
    runs = {a[k : k + n] for k in range(len(a) - n + 1)}
    if not any(b[k : k + n] in runs for k in range(len(b) - n + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(f: str, g: str) -> float:
    """0 to 1; equal fingerprints 1, block sizes that differ by more than a factor of two 0."""
    if f == g:
        return 1.0
    (b, x1, x2), (c, y1, y2) = f.split(":"), g.split(":")
    b, c = int(b), int(c)
    if b == c:
        return max(_likeness(x1, y1), _likeness(x2, y2))
    return _likeness(x2, y1) if c == 2 * b else _likeness(x1, y2) if b == 2 * c else 0.0


_LEAST = -(1 << 63)


def in_descending_order(docs: DataFrame) -> DataFrame:
    """part, halo, doc_id, text: parts of consecutive doc_ids, each sorted from the largest, followed by the first
    document of the part below as its halo (below the last part: the very first document). Parts are cut at approximate
    quantiles; only their bounds and largest ids reach the driver. A null doc_id sorts last, equal doc_ids by text."""
    n = partitions(docs.sparkSession)
    key = F.coalesce("doc_id", F.lit(_LEAST))
    cuts = docs.agg(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("key").to_numpy()
            for p, x in zip(np.searchsorted(cuts, ids).tolist(), ids.tolist(), strict=True):
                top[p] = max(x, top.get(p, x))
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int32()), pa.array(list(top.values()), pa.int64())], ["part", "top"])

    tops = docs.select(key.alias("key")).mapInArrow(largest, "part int, top long").groupBy("part").agg(F.max("top").alias("top")).orderBy("part").collect()
    above = {r.top: tops[(k + 1) % len(tops)].part for k, r in enumerate(tops)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("key").to_numpy()
            halo = [k for k, x in enumerate(ids.tolist()) if x in above]
            parts = np.searchsorted(cuts, ids).astype(np.int32)
            for rows, where, is_halo in ((batch, pa.array(parts), False), (batch.take(pa.array(halo, pa.int64())), pa.array([above[ids[k]] for k in halo], pa.int32()), True)):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([where, pa.array([is_halo] * rows.num_rows), *rows.columns], ["part", "halo", *rows.schema.names])

    dealt = docs.select(key.alias("key"), "doc_id", "text").mapInArrow(deal, "part int, halo boolean, key long, doc_id long, text string")
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "halo", F.desc("key"), "text").drop("key")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs
    (doc_id, text, not null); see op2_ctph. A single row is its own next document."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, "text", 1 << 20):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "halo", "doc_id", "text")), strict=True))
            rows = [(*r, f) for r, f in zip(rows, fingerprints([r[3] for r in rows]), strict=True)]
            pairs = [(a, b) for a, b in zip([held, *rows[:-1]], rows, strict=True) if a and a[0] == b[0] and not a[1]]
            held = rows[-1]
            if pairs:
                edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
                prints = fingerprints(edited)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]),
                    pa.array([a[4] for a, _ in pairs]), pa.array(prints), pa.array([likeness(a[4], f) for (a, _), f in zip(pairs, prints, strict=True)]), pa.array([likeness(a[4], b[4]) for a, b in pairs]),
                ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_descending_order(docs).mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_ctph(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row of `documents`.

    A null text is empty; equal texts have equal fingerprints; a null doc_id sorts last, rows that repeat a doc_id go by text, and
    a single row is its own next. Very long texts are hashed whole, with at most MOST symbols. An empty table gives none; columns
    with clashing names are never read."""
    return with_next(documents(table(spark, sf_dir, "documents")))
