"""Alignment of two tokenizers' tokens of the same texts, and how often their ids are linked over all texts.

A text is cut at places where both tokenizers cut for certain (before a single space, between a letter and an ASCII sign, around a
line end), so the alignment of a text is that of its parts in order. Parts are counted over all documents, and each different one is
encoded by both: the byte ranges of B's tokens become a static index of sorted ends, a bisection finds the B tokens that each A token
overlaps, and an end of an A token that no B token spans is a group's end. The links of a part count as often as it occurs.
A second scan puts the documents together. It gets the most frequent parts, HOT_PARTS at most, and aligns the others again as it
meets them; counts of the most frequent id pairs are broadcast too, HOT at most, and documents with rarer ones send these through a join."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import held, least_count, ready, release, slices, staged, table
from cairn.llm.tokens import byte_letters

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids (17 bytes each) and aligned parts that are broadcast at most, and other parts and subparts that a worker keeps.
HOT, HOT_PARTS, MAX_PARTS, MAX_SUBPARTS = 1 << 20, 500_000, 60_000, 80_000
#: Different parts that a task counts before it sends them on.
FLUSH = 300_000
#: Letters of which both tokenizers know that they are letters.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_ODD = re.compile(r"^ | $|\s \s|  ")
_PARTS = re.compile(r"(?<=\S) (?=\S)")
_SUBPARTS = re.compile(rf"(?<=[{_L}])(?=[\x00-@\[-`{{-\x7f])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_LETTERS = re.compile(rf" ?[{_L}]+")


def parts(text: str) -> list[str]:
    """The text cut at its spaces (which belong to the part that follows and are left out) where one stands between other characters."""
    return text.split(" ") if not _ODD.search(text) else _PARTS.split(text)


def groups(a: Iterable[int], b: Iterable[int]) -> list[tuple[int, int]]:
    """a, b: token lengths in bytes over the same bytes. Returns for each group how many A and B tokens end with it or before."""
    ends = list(accumulate(b))
    out, at = [], 0
    for k, size in enumerate(a, 1):
        first, at = bisect_right(ends, at), at + size
        last = bisect_left(ends, at, first)  # the B tokens from first to last overlap this A token
        if ends[last] == at:
            out.append((k, last + 1))
    return out


class Aligner:
    """Encodes and aligns parts of texts; keeps what it has met."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.letters = byte_letters()
        byte = {c: b for b, c in self.letters.items()}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(self.b.id_to_piece, range(self.b.get_piece_size()))]
        self.a_names, self.b_names = [str(i) for i in range(max(self.a_bytes) + 1)], [str(i) for i in range(len(self.b_bytes))]
        self.a_sizes, self.b_sizes = {i: len(x) for i, x in self.a_bytes.items()}, list(map(len, self.b_bytes))
        self.known, self.old = {}, {}

    def _ids(self, sub: str) -> tuple[list[int], list[int]]:
        if _LETTERS.fullmatch(sub):  # one piece of A's pattern
            a = [t.id for t in self.a.model.tokenize("".join(map(self.letters.__getitem__, sub.encode())))]
        else:
            a = self.a.encode(sub, add_special_tokens=False).ids
        if sub[0] == " " and sub[1:].strip():
            return a, self.b.encode(sub[1:])
        return a, self.b.encode("\n" + sub)[2:]  # without the space that B adds; a line end stands alone in B

    def whole(self, text: str) -> tuple[int, int, str, bytes] | None:
        """n_a, n_b, the groups' ids, and the linked pairs (A id << 32 | B id, eight bytes each) of a text with its space; None if the
        tokens' bytes aren't the text's."""
        a, b = self._ids(text)
        if not b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b)) == text.encode():
            return None
        out, links, was_a, was_b = [], array("q"), 0, 0
        a_names, b_names = list(map(self.a_names.__getitem__, a)), list(map(self.b_names.__getitem__, b))
        for i, j in groups(map(self.a_sizes.__getitem__, a), map(self.b_sizes.__getitem__, b)):
            out.append(f"{','.join(a_names[was_a:i])}|{','.join(b_names[was_b:j])}")
            links.append(a[i - 1] << 32 | b[j - 1])
            was_a, was_b = i, j
        return len(a), len(b), ";".join(out), links.tobytes()

    def sub(self, sub: str):
        if sub in self.known:
            return self.known[sub]
        found = self.old[sub] if sub in self.old else self.whole(sub)
        if len(self.known) >= MAX_SUBPARTS:
            self.known, self.old = {}, self.known
        self.known[sub] = found
        return found

    def part(self, part: str):
        """As whole(), of a part (without its space)."""
        found = [self.sub(s) for s in _SUBPARTS.split(" " + part)]
        if None in found:
            return None
        return found[0] if len(found) == 1 else (sum([x[0] for x in found]), sum([x[1] for x in found]), ";".join([x[2] for x in found]), b"".join([x[3] for x in found]))


class Parts:
    """Numbers for the parts that a task meets: the given ones first (part, groups, n_a, n_b and links), then MAX_PARTS others at most; -1 for
    those whose bytes differ. Sizes and links of the given ones stay columns, as objects they would take most of a worker's memory."""

    def __init__(self, aligner: Aligner, given: pa.Table | None = None) -> None:
        self.aligner, self.given = aligner, 0 if given is None else given.num_rows
        self.number, self.strings, self.sizes, self.links, self.others = {}, [], [], [], []
        self.given_sizes, self.given_links, self.given_ends = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        if self.given:
            self.number, self.strings = {p: k for k, p in enumerate(given.column("part").to_pylist())}, given.column("groups").to_pylist()
            links = given.column("links").combine_chunks()
            self.given_ends, self.given_links = links.offsets.to_numpy() - links.offsets[0].as_py(), links.flatten().to_numpy()
            self.given_sizes = np.stack([given.column("n_a").to_numpy(), given.column("n_b").to_numpy(), np.diff(self.given_ends)], axis=1)

    def full(self) -> bool:
        return len(self.others) >= MAX_PARTS

    def clear(self) -> None:
        """Keep only what was given."""
        for part in self.others:
            del self.number[part]
        for x in (self.others, self.sizes, self.links):
            x.clear()
        del self.strings[self.given :]

    def of(self, text: str) -> np.ndarray | None:
        """The numbers of a text's parts; None for a text without tokens."""
        if not text or "▁" in text:
            return None
        own = parts(text)
        out = list(map(self.number.get, own))
        if None in out:
            for k, n in enumerate(out):
                if n is None:
                    out[k] = self._met(own[k])
        out = np.array(out, np.int64)
        return None if (out < 0).any() else out

    def linked(self, k: int) -> bytes:
        """The links of a part, by its number."""
        return self.links[k - self.given] if k >= self.given else self.given_links[self.given_ends[k] : self.given_ends[k + 1]].tobytes()

    def _sub(self, sub: str) -> tuple[str, tuple, bytes] | None:
        """Groups, sizes and links of a subpart, which may be a part that is known."""
        k = self.number.get(sub[1:], -1) if sub[0] == " " else -1
        if k >= 0:
            return self.strings[k], self.sizes[k - self.given] if k >= self.given else tuple(self.given_sizes[k].tolist()), self.linked(k)
        found = self.aligner.sub(sub)
        return found and (found[2], (found[0], found[1], len(found[3]) >> 3), found[3])

    def _met(self, part: str) -> int:
        n = self.number.get(part)
        if n is None:
            found = [self._sub(s) for s in _SUBPARTS.split(" " + part)]
            n = -1
            if None not in found:
                n = len(self.strings)
                strings, sizes, links = found[0] if len(found) == 1 else (";".join([x[0] for x in found]), tuple(map(sum, zip(*[x[1] for x in found], strict=True))), b"".join([x[2] for x in found]))
                self.strings.append(strings)
                self.sizes.append(sizes)
                self.links.append(links)
            self.number[part] = n
            self.others.append(part)
        return n


def _aligner(a_path: str, b_path: str) -> Aligner:
    kept = held("align")
    if (a_path, b_path) not in kept:
        kept.clear()
        kept[a_path, b_path] = Aligner(a_path, b_path)
    return kept[a_path, b_path]


def _given(name: str, given: Broadcast, paths: tuple[str, str]) -> Parts:
    """The worker's table of the broadcast parts, made once for all its tasks."""
    aligner, kept = _aligner(*paths), held("align")
    if kept.get("name") != name:
        kept["parts"] = Parts(aligner, given.value)
        kept["name"] = name
    kept["parts"].clear()
    return kept["parts"]


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path(A_VOCABULARY), b_path or public_tokenizers.path(B_VOCABULARY)


def counted_parts(docs: DataFrame) -> DataFrame:
    """part, n over all texts that have tokens, but for those with parts whose bytes differ."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what an earlier run's scans have kept
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["part", "n"])
            n.clear()
            return found

        for batch in slices(batches, "text", 1 << 20):
            for text in batch.column("text").to_pylist():
                if text and "▁" not in text:
                    n.update(parts(text))
            if len(n) >= FLUSH:
                yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def aligned_parts(counted: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """part, n, groups (null where the bytes differ), n_a, n_b and links (pairs in order; none where the bytes differ)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for batch in slices(batches, "part", 1 << 20):
            found = [aligner.part(p) or (None, None, None, b"") for p in batch.column("part").to_pylist()]
            ends = np.cumsum([0, *[len(x[3]) >> 3 for x in found]]).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([x[3] for x in found]), np.int64)))
            columns = [pa.array([x[2] for x in found], pa.string()), *(pa.array([x[i] for x in found], pa.int32()) for i in (0, 1)), links]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("n"), *columns], ["part", "n", "groups", "n_a", "n_b", "links"])

    return staged(counted.mapInArrow(align, "part string, n long, groups string, n_a int, n_b int, links array<long>"), "parts", compression="zstd")


def _links_by_text(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair, n by texts, for texts of which some have parts whose bytes differ, so that none of their links count."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Parts(_aligner(a_path, b_path))
        for batch in slices(batches, "text", 1 << 20):
            own = [x for x in map(met.of, batch.column("text").to_pylist()) if x is not None]
            keys, n = np.unique(np.frombuffer(b"".join([met.linked(k) for x in own for k in x.tolist()]), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
            if met.full():
                met.clear()

    return docs.select("text").mapInArrow(links, "pair long, n long")


def counts(docs: DataFrame, found: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair (A id << 32 | B id), n (links of all texts that hold it) and best (no pair of its B id has a higher n). found: aligned_parts()."""
    if found.where("groups is null").isEmpty():
        links = found.select(F.explode("links").alias("pair"), "n")
    else:
        links = _links_by_text(docs, a_path, b_path)
    summed = staged(links.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    highest = summed.groupBy(b).agg(F.max("n").alias("most"))  # a row for each id of B
    return staged(summed.select("pair", "n", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


_FOUND = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Names that aligned() adds itself.
OWN = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot: int = HOT, hot_parts: int = HOT_PARTS, with_groups: bool = False) -> DataFrame:
    """docs' doc_id and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (with_groups: and groups, the hashed text) for every
    row of docs. A text that is null, empty, or not what its tokens spell has no tokens."""
    ready(docs.sparkSession)
    docs, paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _paths(a_path, b_path)
    found = aligned_parts(counted_parts(docs), *paths)
    counted = counts(docs, found, *paths)
    least, others = least_count(counted, hot)
    rows = counted.where(F.col("n") >= least).orderBy("pair").toArrow()
    least, _ = least_count(found, hot_parts)
    given = found.where((F.col("n") >= least) & F.col("groups").isNotNull()).drop("n").toArrow().combine_chunks()
    sc, name = docs.sparkSession.sparkContext, uuid.uuid4().hex
    hot_pairs, hot_given = sc.broadcast([rows.column(c).to_numpy() for c in ("pair", "n", "best")]), sc.broadcast(given)
    schema = f"doc_id long, {_FOUND}, groups string, others array<long>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = hot_pairs.value
        met, sums = _given(name, hot_given, paths), np.zeros((0, 5), np.int64)
        rare: dict[int, list[int]] = {}

        def known() -> np.ndarray:
            """sums with a row for each part: its sizes, best links and their counts; rare: its pairs that aren't hot."""
            was = len(sums)
            if was == len(met.strings):
                return sums
            size, keys = np.array([len(x) >> 3 for x in met.links[max(0, was - met.given) :]], np.int64), np.frombuffer(b"".join(met.links[max(0, was - met.given) :]), np.int64)
            if was < met.given:  # the given ones are worked out all at once
                size, keys = np.concatenate((met.given_sizes[:, 2], size)), np.concatenate((met.given_links, keys))
            which = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(pairs, keys), max(0, len(pairs) - 1))
            there = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
            for k in np.flatnonzero(~there).tolist():
                rare.setdefault(was + int(which[k]), []).append(int(keys[k]))
            more = np.zeros((len(size), 5), np.int64)
            more[:, :3] = np.concatenate([met.given_sizes[was:], np.array(met.sizes[max(0, was - met.given) :], np.int64).reshape(-1, 3)])
            np.add.at(more[:, 3], which[there], best[at[there]])
            np.add.at(more[:, 4], which[there], n[at[there]])
            return np.concatenate((sums, more))

        for batch in slices(batches, "text", 1 << 20):
            own = [met.of(t) for t in batch.column("text").to_pylist()]
            sums, rows, spelled, left = known(), [], [], []
            for x in own:
                rows.append((0, 0, 0, 0, 0) if x is None else sums[x].sum(0).tolist())
                spelled.append("" if x is None else ";".join(map(met.strings.__getitem__, x.tolist())))
                left.append(None if x is None or not rare else [p for k in x.tolist() if k in rare for p in rare[k]] or None)
            a, b, links, top, summed = zip(*rows, strict=True)
            shas = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled]
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (a, b, links, links, top, summed)), pa.array(shas), pa.array(spelled if with_groups else [None] * len(rows), pa.string()), pa.array(left, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *OWN, "others"])
            if met.full():
                met.clear()
                sums = sums[: met.given]
                for k in [k for k in rare if k >= met.given]:
                    del rare[k]

    out = docs.mapInArrow(look, schema)
    names = ["doc_id", *OWN[: 8 if with_groups else 7]]
    if not others:
        return out.select(*names)
    out = staged(out.withColumn("row", F.monotonically_increasing_id()), "aligned")
    asked = out.select("row", F.explode("others").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    more = asked.join(counted, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = out.join(more, "row", "left").na.fill(0, ["more_best", "more_sum"])
    return out.withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")}).select(*names)


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of `documents`; see aligned().

    Null and empty texts, and texts that their tokens don't spell, have zeros and an empty hash; very long texts count whole; rows that
    repeat are rows, and their links count as often; pairs of equal count are all best; an empty table gives none; columns with
    clashing names are never read."""
    return aligned(table(spark, sf_dir, "documents"))
