"""Class-based n-gram model: words in classes by exchange, class transitions and word emissions.

1. Words of the learning texts are counted; the HOT most frequent get numbers and are broadcast (a bound on entries, not a cut in the data:
   rarer words stay words and go through joins). Texts become number sequences in the shared folder.
2. Exchange: in each pass every task counts, for a half of the CORE most frequent words, the classes to their left and right (a table of
   fixed size), the tables are summed by shard of words, and every word of the half moves to the class that raises the likelihood of the
   class bigrams most. Then all other numbered words are put into classes by the same gain, from counts that are sent sparse and
   packed, and at last the rarer ones, grouped by word. Shards of WORDS words are moved at once; a pass that lowers the likelihood is taken back.
3. p(w | w') = (1 - u) p(c | c') n(w) / n(c) with c, c' the classes of w and w', p(c | c') = (n(c', c) + m p(c)) / (n(c') + m), and u, the
   probability of a word not met in learning, from the words met once. These sum to 1 over all words and one unknown word."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import least_count, ready, slices, staged, table

CLASSES, CORE, HOT, SWEEPS = 64, 16_384, 262_144, 3
#: Different words that a task counts before it sends them on, weight of p(c) in a transition, and words that exchange moves one after the other.
FLUSH, PRIOR, WORDS = 300_000, 64.0, 2048
END = b""
_ZSTD = {"compression": "zstd"}


def words(text: str) -> list[bytes]:
    """Runs without ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def counted(docs: DataFrame) -> DataFrame:
    """word, n over the texts; each text ends with END."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
            n.clear()
            return found

        for batch in slices(batches, "text", 1 << 20):
            for text in batch.column("text").to_pylist():
                n.update(words(text))
                n[END] += 1
            if len(n) >= FLUSH:
                yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbered(vocabulary: DataFrame, hot: int) -> tuple[dict[bytes, int], np.ndarray, int]:
    """Numbers of the most frequent words (hot at most, and all of one band of counts or none), their counts, and the least count of them."""
    least, _ = least_count(vocabulary, hot)
    found = vocabulary.where(F.col("n") >= least).toArrow()
    rows = sorted(zip((-found.column("n").to_numpy()).tolist(), found.column("word").to_pylist(), strict=True))
    return {w: k for k, (_, w) in enumerate(rows)}, -np.array([n for n, _ in rows], np.int64), least


def sequences(docs: DataFrame, numbers) -> DataFrame:
    """docs (doc_id, text, learn) as row, doc_id, learn, n_tokens, ids (32-bit numbers, little-endian) and rare (the text's different words without
    a number, in order; the k-th one has the number -1 - k)."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in slices(batches, "text", 1 << 20):
            ids, rare, n = [], [], []
            for text in batch.column("text").to_pylist():
                own = [*words(text), END]
                found, other = list(map(known.get, own)), {}
                if None in found:
                    for k, x in enumerate(found):
                        if x is None:
                            found[k] = -1 - other.setdefault(own[k], len(other))
                ids.append(np.array(found, "<i4").tobytes())
                rare.append(list(other))
                n.append(len(own))
            columns = [batch.column("doc_id"), batch.column("learn"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "learn", "n_tokens", "ids", "rare"])

    out = docs.mapInArrow(number, "doc_id long, learn boolean, n_tokens long, ids binary, rare array<binary>")
    return staged(out.withColumn("row", F.monotonically_increasing_id()), "sequences", **_ZSTD)


def _streams(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """The texts of each batch one after the other, with END before the first."""
    for batch in slices(batches, "ids", 4 << 20):
        yield np.concatenate(([end], np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<i4"))).astype(np.int64)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(n: np.ndarray) -> float:
    """What exchange raises: the part of the class bigrams' log-likelihood that depends on the classes. n: bigrams by class."""
    return float(_phi(n).sum() - _phi(n.sum(0)).sum() - _phi(n.sum(1)).sum())


def exchanged(left: np.ndarray, right: np.ndarray, was: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best class for one word after the other, the words before it moved and all else unchanged. left, right: (words, classes) counts of the
    classes to its left and right; was: its class, or -1 if it has none and is not counted in n (classes, classes) yet. Ties keep
    the class, or take the lowest."""
    out = np.empty(len(was), np.int64)
    n = n.astype(np.float64)
    for k, (before, after, a) in enumerate(zip(left.astype(np.float64), right.astype(np.float64), was.tolist(), strict=True)):
        rest = n
        if a >= 0:
            rest[a] -= after
            rest[:, a] -= before
            np.maximum(rest, 0, out=rest)
        b, c = np.flatnonzero(before), np.flatnonzero(after)
        rows, columns = rest.sum(1) + before, rest.sum(0) + after  # its neighbours stay beside it
        gain = (_phi(rest[:, c] + after[c]) - _phi(rest[:, c])).sum(1) + (_phi(rest[b] + before[b, None]) - _phi(rest[b])).sum(0)
        own = rest.diagonal()  # both sides add to this cell
        gain += _phi(own + before + after) - _phi(own + before) - _phi(own + after) + _phi(own)
        gain -= _phi(rows + after.sum()) - _phi(rows) + _phi(columns + before.sum()) - _phi(columns)
        best = int(gain.argmax())
        out[k] = best = a if a >= 0 and gain[a] >= gain[best] else best
        rest[best] += after
        rest[:, best] += before
    return out


def _matrix(rows: DataFrame, classes: int) -> np.ndarray:
    """The tasks' class bigrams in one: a sum of classes x classes numbers a task."""
    one = rows.where("shard = -1").select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(classes * classes, np.int64)
    for r in one.collect():
        out[r.k] = r.n
    return out.reshape(classes, classes)


_COUNTS = "shard int, keys array<long>, counts array<long>"


def _sides(streams: DataFrame, of: np.ndarray, end: int, slots: np.ndarray, classes: int, sparse: bool) -> DataFrame:
    """Bigrams by class (shard -1), and for the words with a slot, by shard of slots, how often a class stands left (key slot * 2 * classes + class) or right
    of them (key + classes). of, slots: by number; words without a class (classes) don't count as neighbours."""
    size = int(slots.max(initial=-1) + 1)
    sc = streams.sparkSession.sparkContext
    shared = sc.broadcast((of.astype(np.int16), slots.astype(np.int32)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, slots = shared.value
        matrix = np.zeros((classes + 1) ** 2, np.int64)
        dense = None if sparse else np.zeros(size * 2 * classes, np.int64)
        held_: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in held_]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([n for _, n in held_]), len(keys)).astype(np.int64)

        def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            shard = keys // (2 * classes) // WORDS
            cuts = np.searchsorted(shard, np.arange(-(-size // WORDS) + 1)).tolist()
            some = [(s, a, b) for s, (a, b) in enumerate(itertools.pairwise(cuts)) if a < b]
            return _counts([s for s, _, _ in some], [keys[a:b] for _, a, b in some], [n[a:b] for _, a, b in some])

        for x in _streams(batches, end):
            group = np.where(x >= 0, of[np.maximum(x, 0)], classes).astype(np.int64)  # numbers below 0 are rarer words
            matrix += np.bincount(group[:-1] * (classes + 1) + group[1:], minlength=len(matrix))
            slot = np.where(x >= 0, slots[np.maximum(x, 0)], -1).astype(np.int64) * 2 * classes
            before, after = (slot[1:] >= 0) & (group[:-1] < classes), (slot[:-1] >= 0) & (group[1:] < classes)
            keys = np.concatenate((slot[1:][before] + group[:-1][before], slot[:-1][after] + classes + group[1:][after]))
            if sparse:
                held_.append(np.unique(keys, return_counts=True))
                waiting += len(held_[-1][0])
                if waiting > 4_000_000:
                    held_ = [merged()]
                    waiting = len(held_[0][0])
                    if waiting > 2_000_000:
                        yield rows(*held_.pop())
                        waiting = 0
            else:
                dense += np.bincount(keys, minlength=len(dense))
        yield _counts([-1], [np.zeros(0, np.int64)], [matrix.reshape(classes + 1, -1)[:classes, :classes].ravel()])
        if dense is not None:
            keys = np.flatnonzero(dense)
            yield rows(keys, dense[keys])
        elif held_:
            yield rows(*merged())

    return staged(streams.select("ids").mapInArrow(count, _COUNTS), "sides", **_ZSTD)


def _counts(shards: list, keys: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], ["shard", "keys", "counts"])


def _moved(sides: DataFrame, n: np.ndarray, was: np.ndarray) -> dict[int, int]:
    """The class of each slot after exchange; was: by slot."""
    classes = len(n)

    def move(group: pa.Table) -> pa.Table:
        keys, where = np.unique(np.concatenate([x.values.to_numpy() for x in group.column("keys")]), return_inverse=True)
        times = np.bincount(where, np.concatenate([x.values.to_numpy() for x in group.column("counts")]), len(keys))
        slots, row = np.unique(keys // (2 * classes), return_inverse=True)
        sides = np.zeros((len(slots), 2 * classes))
        sides[row, keys % (2 * classes)] = times
        return pa.table({"slot": slots, "class": exchanged(sides[:, :classes], sides[:, classes:], was[slots], n)})

    rows = sides.where("shard >= 0").groupBy("shard").applyInArrow(move, "slot long, class long")
    return {r[0]: r[1] for r in rows.collect()}  # a row for each of the HOT words at most


def classes_of(streams: DataFrame, words_: int, end: int, classes: int = CLASSES, core: int = CORE, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of each numbered word, the class bigrams of the last pass over them, and the likelihood before each exchange."""
    of = np.full(words_, classes, np.int64)
    core = min(core, words_)
    of[:core] = np.arange(core) % classes
    half = (np.arange(core) * 2654435761 >> 16) % 2
    seen, best = [], of.copy()
    for step in range(2 * sweeps):
        chosen = np.flatnonzero(half == step % 2)
        slots = np.full(words_, -1, np.int64)
        slots[chosen] = np.arange(len(chosen))
        sides = _sides(streams, of, end, slots, classes, False)
        n = _matrix(sides, classes)
        seen.append(likelihood(n))
        if seen[-1] < max(seen):  # shards move words at once, which may do harm: back, and on with the other half
            of = best.copy()
            continue
        best = of.copy()
        for slot, new in _moved(sides, n, of[chosen]).items():
            of[chosen[slot]] = new
    slots = np.full(words_, -1, np.int64)
    slots[core:] = np.arange(words_ - core)
    for of in (of, best):
        sides = _sides(streams, of, end, slots, classes, True)
        n = _matrix(sides, classes)
        seen.append(likelihood(n))
        if seen[-1] >= max(seen):
            break
    of = of.copy()
    for slot, new in _moved(sides, n, np.full(words_ - core, -1)).items():
        of[core + slot] = new
    of[of == classes] = 0  # no neighbour with a class: any will do
    return of, n, seen


def _rare(rows: DataFrame, of, n: np.ndarray, end: int) -> DataFrame:
    """row, found: array of (k, class, n) for the words without a number that learning texts have. Each is rarer than every numbered
    word there, so no word's rows are many."""
    classes = len(n)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_ = of.value
        for batch in slices(batches, "ids", 1 << 20):
            out = []
            for row, learn, ids, rare in zip(*(batch.column(c).to_pylist() for c in ("row", "learn", "ids", "rare")), strict=True):
                x = np.frombuffer(ids, "<i4")
                group = np.where(x >= 0, of_[np.maximum(x, 0)], classes)
                at = np.flatnonzero(x < 0)
                sides = np.where(at > 0, group[at - 1], of_[end]) * (classes + 1) + group[at + 1]  # END follows the last word
                own: list[list[int]] = [[] for _ in rare]
                if learn:
                    for k, s in zip((-1 - x[at]).tolist(), sides.tolist(), strict=True):
                        own[k].append(s)
                out += [(w, row, k, s) for k, (w, s) in enumerate(zip(rare, own, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int32())))], ["word", "row", "k", "sides"])

    smooth = n + 0.5
    left, right = np.zeros((classes + 1, classes)), np.zeros((classes + 1, classes))
    left[:classes] = np.log(smooth / smooth.sum(0))
    right[:classes] = np.log(smooth.T / smooth.sum(1))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) for x in batch.column("sides").to_pylist()])
            flat, gain = batch.column("sides").flatten().to_numpy(), np.zeros((len(size), classes))
            for a in range(0, len(flat), 65536):
                part = flat[a : a + 65536]
                np.add.at(gain, np.repeat(np.arange(len(size)), size)[a : a + 65536], left[part // (classes + 1)] + right[part % (classes + 1)])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(gain.argmax(1).astype(np.int32)), pa.array(size, pa.int64())], ["word", "class", "n"])

    met = staged(rows.where(F.size("rare") > 0).select("row", "learn", "ids", "rare").mapInArrow(contexts, "word binary, row long, k int, sides array<int>"), "contexts", **_ZSTD)
    learned = met.where(F.size("sides") > 0).groupBy("word").agg(F.flatten(F.collect_list("sides")).alias("sides")).mapInArrow(choose, "word binary, class int, n long")
    return met.select("word", "row", "k").join(learned, "word").groupBy("row").agg(F.collect_list(F.struct("k", "class", "n")).alias("found"))


class Model:
    """log10 p of class sequences. n: bigrams by class, singles: words met once, total: tokens learned from."""

    def __init__(self, n: np.ndarray, singles: int, total: int, prior: float = PRIOR) -> None:
        size, unknown = n.sum(0), (singles + 0.5) / (total + 1)
        p = (size + 1) / (size.sum() + len(size))
        given = np.vstack([(n + prior * p) / (n.sum(1, keepdims=True) + prior), p])  # after an unknown word: p
        self.table = np.full((len(n) + 1, len(n) + 1), np.log10(unknown))
        self.table[:, :-1] = np.log10(1 - unknown) + np.log10(given) - np.log10(np.maximum(size, 1))

    def score(self, classes: np.ndarray, first: int) -> float:
        """log10 p of a text without its words' log10 n."""
        return float(self.table[np.concatenate(([first], classes[:-1])), classes].sum())


def scored(docs: DataFrame, learn: Column, classes: int = CLASSES, core: int = CORE, hot: int = HOT, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score and score of every row of docs, learned from the rows where learn holds. A
    null text is empty, and has its end only."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    vocabulary = staged(counted(docs.where("learn")), "words", **_ZSTD)
    types, total, singles = (x or 0 for x in vocabulary.agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") == 1)).first())
    numbers, n, _ = numbered(vocabulary, hot)
    end = numbers.get(END, -1)
    if end < 0:  # nothing was learned, or everything is as frequent as the end: it has a number all the same
        end = len(numbers)
        numbers[END], n = end, np.append(n, vocabulary.where(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rows = sequences(docs, spark.sparkContext.broadcast(numbers))
    of, matrix, _ = classes_of(rows.where("learn"), len(n), end, classes, core, sweeps)
    shared, first = spark.sparkContext.broadcast(of), int(of[end])
    counts = spark.sparkContext.broadcast(n)
    floor = total + 0.5 * (types + 1)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes (one byte a word; 255: not numbered), the numbers k of the words that aren't numbered, and sums over the others."""
        of_, n_ = shared.value, counts.value
        base, logs = np.log10((n_ + 0.5) / floor), np.log10(np.maximum(n_, 1))
        for batch in slices(batches, "ids", 1 << 20):
            out = []
            for ids in batch.column("ids").to_pylist():
                x = np.frombuffer(ids, "<i4")
                there = x[x >= 0]
                out.append((np.where(x >= 0, of_[np.maximum(x, 0)], 255).astype(np.uint8).tobytes(), (-1 - x[x < 0]).astype("<i4").tobytes(), int((n_[there] > 0).sum()), float(base[there].sum()), float(logs[there].sum())))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "learn", "n_tokens")), *columns], ["row", "doc_id", "learn", "n_tokens", "classes", "others", "n_known", "base_score", "logs"])

    known = rows.select("row", "doc_id", "learn", "n_tokens", "ids").mapInArrow(grouped, "row long, doc_id long, learn boolean, n_tokens long, classes binary, others binary, n_known long, base_score double, logs double")
    rare = _rare(rows, shared, matrix, end)
    both = known.join(rare, "row", "left")

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of all words (classes: unknown), and the sums over all."""
        for batch in slices(batches, "classes", 1 << 20):
            out = []
            for text, others, found, met, base, logs in zip(*(batch.column(c).to_pylist() for c in ("classes", "others", "found", "n_known", "base_score", "logs")), strict=True):
                group, k = np.frombuffer(text, np.uint8).copy(), np.frombuffer(others, "<i4")
                if len(k):
                    own, times = np.full(k.max() + 1, classes, np.uint8), np.zeros(k.max() + 1)
                    for x in found or ():
                        own[x["k"]], times[x["k"]] = x["class"], x["n"]
                    group[group == 255] = own[k]
                    met, base, logs = met + int((times[k] > 0).sum()), base + float(np.log10((times[k] + 0.5) / floor).sum()), logs + float(np.log10(np.maximum(times[k], 1)).sum())
                out.append((group.tobytes(), met, base, logs))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "learn", "n_tokens")), *columns], ["doc_id", "learn", "n_tokens", "classes", "n_known", "base_score", "logs"])

    both = staged(both.mapInArrow(resolved, "doc_id long, learn boolean, n_tokens long, classes binary, n_known long, base_score double, logs double"), "classes", **_ZSTD)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((classes + 1) ** 2, np.int64)
        for batch in slices(batches, "classes", 4 << 20):
            x = np.concatenate(([first], np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint8))).astype(np.int64)
            matrix += np.bincount(x[:-1] * (classes + 1) + x[1:], minlength=len(matrix))
        yield _counts([-1], [[]], [matrix.reshape(classes + 1, -1)[:classes, :classes].ravel()])

    model = Model(_matrix(both.where("learn").select("classes").mapInArrow(bigrams, _COUNTS), classes), singles, total)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "classes"):
            found = [model.score(np.frombuffer(x, np.uint8), first) + logs for x, logs in zip(batch.column("classes").to_pylist(), batch.column("logs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "learn", "n_tokens", "n_known")), pa.array([total] * len(found), pa.int64()), batch.column("base_score"), pa.array(found, pa.float64())], ["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.mapInArrow(score, "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op11_class_lm(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `documents`; see scored(). Rows whose
    crc32(doc_id) mod 5 is 1 are held out; a row without an id is not.

    Null and empty texts have their end only; very long texts count whole; rows that repeat are rows; ties of gain keep a word's class or
    take the lowest; an empty table gives none, and with nothing to learn from every word is unknown; columns with clashing
    names are never read."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return scored(docs, ~held_out).select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
