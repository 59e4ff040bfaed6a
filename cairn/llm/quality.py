"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model that decides is made of n-grams of FULL_ORDER letters of the whole alphabet, as they stand: nothing is folded, so its table grows with the
corpus and is never in one place. Texts go in parts of about PART bytes, dealt by a hash of id and text. A part's different n-grams are sent once, dealt into shards by n-gram;
counts are summed and log-probabilities joined to the n-grams of every part shard by shard, and come back to the part that holds the texts. These are shuffled for either step, compressed one by
one, and are not kept between. A document is
kept if its perplexity is within a quantile of the trusted documents of its language.

Beside it stands a small model of order ORDER = 4 on 64 folded symbols, whose table never has more than 64^4 rows and is broadcast. Its
perplexity is a column of the result and decides nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import documents, release_shuffles, staged, table, unstaged

ORDER, SYMBOL_BITS, QUANTILE = 4, 6, 0.99
SYMBOLS, GRAMS = 1 << SYMBOL_BITS, 1 << SYMBOL_BITS * ORDER
#: The model of all letters: n-grams of FULL_ORDER code points, the first two in one long (hi), the last three in another (lo).
FULL_ORDER, CODE_BITS = 5, 21
#: The least discount: where counts are few, the estimate may be 0.
LEAST = 0.1
#: Bytes of text of a part, bytes taken at once, and bytes of text for each shard of n-grams.
PART, SLICE, SHARD_BYTES = 16 << 20, 1 << 20, 32 << 20
#: Punctuation that shares a symbol, in symbol order from 28 on: fixed values.
_PUNCTUATION = (".", ",", "'`", "-", '"', ":;", "!?", "()[]{}", "#", "*", "&", "%", "$", "@", "/\\|", "_", "=+~^", "<>")


def _folded(c: int) -> int:
    """White space and controls 0, letters 1 to 26, digits 27, punctuation 28 to 45, other letters 46 to 61 by code point, the
    rest 62."""
    x = chr(c).lower()[0]
    if x.isspace() or c < 32:
        return 0
    if "a" <= x <= "z":
        return ord(x) - 96
    if x.isdigit():
        return 27
    for k, same in enumerate(_PUNCTUATION):
        if x in same:
            return 28 + k
    return 46 + ord(x) % 16 if x.isalpha() else 62


_TABLE: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, one after another, and how many each text has: one for each character and its end."""
    if not _TABLE:
        _TABLE.append(np.fromiter(map(_folded, range(0x110000)), np.uint8, 0x110000))
    pad, sizes = "\0" * (ORDER - 1), np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join([pad + t + "\0" for t in texts])
    x = _TABLE[0][np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    out = x[: len(x) - ORDER + 1]
    for k in range(1, ORDER):
        out = out << SYMBOL_BITS | x[k : len(x) - ORDER + 1 + k]
    own, ends = np.ones(len(out), bool), np.cumsum(sizes + ORDER)
    for k in range(1, ORDER):
        own[ends[:-1] - k] = False  # these lie in two texts
    return out[own], sizes + 1


def _discounts(counts: DataFrame, least: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, and least at least."""
    n = counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return tuple(min(float(k), max(least, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 for k in (1, 2, 3))


def _discount(d: tuple[float, float, float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def _folded_last(g: Column, order: int) -> Column:
    """The last symbols of an n-gram."""
    return g.bitwiseAND((1 << SYMBOL_BITS * order) - 1)


def _folded_before(g: Column) -> Column:
    """An n-gram without its last symbol."""
    return F.shiftright(g, SYMBOL_BITS)


def _full_last(g: Column, order: int) -> Column:
    hi, lo = ((1 << CODE_BITS * max(0, k)) - 1 for k in (order - 3, min(order, 3)))
    return F.struct(g["hi"].bitwiseAND(F.lit(hi)).alias("hi"), g["lo"].bitwiseAND(F.lit(lo)).alias("lo"))


def _full_before(g: Column) -> Column:
    passed = F.shiftleft(g["hi"].bitwiseAND(F.lit((1 << CODE_BITS) - 1)), 2 * CODE_BITS)
    return F.struct(F.shiftright(g["hi"], CODE_BITS).alias("hi"), F.shiftright(g["lo"], CODE_BITS).bitwiseOR(passed).alias("lo"))


def log_probabilities(counts: DataFrame, most: int = ORDER, last: Callable = _folded_last, before: Callable = _folded_before, symbols: int | None = SYMBOLS, least: float = 0.0) -> DataFrame:
    """counts: g, c (0: not in trusted text). g and its log-probability after its context, interpolated over all orders down to an equal
    chance for each symbol (symbols is None: those of trusted text and one for all others). With a least discount above 0 something is
    left everywhere for what was not seen; without one a probability may be 0, and is taken for 1e-30."""
    found, seen = counts, counts.where("c > 0")
    levels = []
    for order in range(most, 0, -1):
        d = _discounts(seen, least)
        context = seen.groupBy(before(F.col("g")).alias("h")).agg(F.sum("c").alias("total"), *[F.count_if(x).alias(f"n{k}") for k, x in enumerate((F.col("c") == 1, F.col("c") == 2, F.col("c") > 2))])
        context = context.select("h", "total", ((F.col("n0") * d[0] + F.col("n1") * d[1] + F.col("n2") * d[2]) / F.col("total")).alias("rest"))
        levels.append((order, seen, context, d))
        if order == 1 and symbols is None:
            symbols = seen.count() + 1
        seen = staged(seen.groupBy(last(F.col("g"), order - 1).alias("g")).agg(F.count("*").alias("c")), "continuations")
    out = found.select(F.col("g").alias("full"), F.lit(1.0 / symbols).alias("p"))
    for order, seen, context, d in reversed(levels):
        near = seen.select("g", "c")
        own = last(F.col("full"), order)
        out = out.join(near, own == F.col("g"), "left").join(context, before(own) == F.col("h"), "left")
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.col("c") - _discount(d)) / F.col("total"), F.lit(0.0)) + F.col("rest") * F.col("p"))
        out = out.select("full", p.alias("p"))
    return out.select(F.col("full").alias("g"), F.log(F.greatest(F.col("p"), F.lit(1e-30))).cast("float").alias("logp"))


def full_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of the different n-grams of the texts; for all n-grams, one text after another, which of these it is; how many each text
    has: one for each letter and its end. Before a text and at its end stands a NUL."""
    pad, sizes = "\0" * (FULL_ORDER - 1), np.fromiter(map(len, texts), np.int64, len(texts))
    x = np.frombuffer("".join([pad + t + "\0" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    there = np.zeros(0x110000, bool)
    there[x] = True
    alphabet = int(there.sum())
    letters = (np.cumsum(there) - 1)[x]
    n = len(x) - FULL_ORDER + 1
    own, ends = np.ones(n, bool), np.cumsum(sizes + FULL_ORDER)
    for k in range(1, FULL_ORDER):
        own[ends[:-1] - k] = False  # these lie in two texts
    codes, top = letters[:n], alphabet
    for k in range(1, FULL_ORDER):
        if top * alphabet >= 1 << 62:
            codes = np.unique(codes, return_inverse=True)[1]
            top = int(codes.max()) + 1
        codes, top = codes * alphabet + letters[k : n + k], top * alphabet
    _, first, which = np.unique(codes[own], return_index=True, return_inverse=True)
    at = np.flatnonzero(own)[first]
    return x[at] << CODE_BITS | x[at + 1], x[at + 2] << 2 * CODE_BITS | x[at + 3] << CODE_BITS | x[at + 4], which, sizes + 1


def _shard(hi, lo, shards: int):
    """The shard of n-grams, of numbers or columns."""
    return ((lo % 2147483647) * 31 + hi % 2147483647) % shards


def _summed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each n-gram once, in order, with the sum of its counts."""
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
    return hi[first], lo[first], np.add.reduceat(n, first)


def _index(hi: np.ndarray, lo: np.ndarray, values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What looks up the values of n-grams, all of which must be among the given ones (each given once). These are sorted once: an n-gram is the
    rank of its hi and the rank of its lo, in one number."""
    highs, lows = np.unique(hi), np.unique(lo)

    def key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return np.searchsorted(highs, hi) << 32 | np.searchsorted(lows, lo)

    keys = key(hi, lo)
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    return lambda hi, lo: values[np.searchsorted(keys, key(hi, lo))]


def _packed(**columns) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _numbers(rows: list[bytes], *names: str) -> list[np.ndarray]:
    """Columns of packed rows, one row after another."""
    found = [_unpacked(r) for r in rows]
    return [np.concatenate([f.column(n).to_numpy() for f in found]) for n in names]


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, so that dealing them into parts shuffles less."""
    for batch in batches:
        sizes, zipped = [], []
        for t in batch.column("text").to_pylist():
            raw = t.encode()
            sizes.append(len(raw))
            zipped.append(pa.compress(raw, "zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "lang")), pa.array(sizes, pa.int64()), pa.array(zipped, pa.binary())], ["part", "doc_id", "lang", "size", "zipped"])


def _slices(zipped: pa.Table) -> Iterator[tuple[pa.Table, list[str]]]:
    """Rows of about SLICE bytes of text together, and their texts."""
    sizes = np.cumsum(zipped.column("size").to_numpy())
    cuts = np.searchsorted(sizes, np.arange(SLICE, int(sizes[-1]) if len(sizes) else 0, SLICE)).tolist()
    for at, to in zip([0, *cuts], [*cuts, zipped.num_rows], strict=True):
        some = zipped.slice(at, to - at)
        if some.num_rows:
            yield some, [pa.decompress(z, n, "zstd", asbytes=True).decode() for z, n in zip(some.column("zipped").to_pylist(), some.column("size").to_pylist(), strict=True)]


def _by_shard(found: list[tuple], shards: int) -> tuple:
    """A part's n-grams, each once and in order, with the sums of their counts, and for each shard the places of its own."""
    hi, lo, n = _summed(*map(np.concatenate, zip(*found, strict=True)))
    shard = _shard(hi, lo, shards)
    order = np.argsort(shard, kind="stable")
    return hi, lo, n, np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


def _counted(shards: int):
    """Of a part's texts and the ids of those that are trusted: its different n-grams by shard, packed, with their counts in trusted texts (0 where they are in others
    only), and the folded ones (shard null)."""

    def run(zipped: pa.Table, ids: pa.Table) -> pa.Table:
        part, found, folded = zipped.column("part")[0].as_py(), [], []
        known = np.unique(ids.column("doc_id").to_numpy())
        for some, texts in _slices(zipped):
            own = some.column("doc_id")
            trusted = np.isin(own.fill_null(0).to_numpy(), known) & own.is_valid().to_numpy()
            hi, lo, which, n = full_grams(texts)
            found.append((hi, lo, np.bincount(which[np.repeat(trusted, n)], minlength=len(hi))))
            which, n = grams(texts)
            g, which = np.unique(which, return_inverse=True)
            folded.append((np.zeros(len(g), np.int64), g.astype(np.int64), np.bincount(which[np.repeat(trusted, n)], minlength=len(g))))
        hi, lo, n, places = _by_shard(found, shards)
        own = [(k, x) for k, x in enumerate(places) if len(x)]
        _, g, c = _summed(*map(np.concatenate, zip(*folded, strict=True)))
        data = [*[_packed(hi=hi[x], lo=lo[x], n=n[x]) for _, x in own], _packed(g=g.astype(np.int32), c=c)]
        return pa.table({"part": pa.array([part] * len(data), pa.int64()), "shard": pa.array([*[k for k, _ in own], None], pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def _folded_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from map(_unpacked, batch.column("data").to_pylist())


def _counts(group: pa.Table) -> pa.Table:
    """The n-grams of one shard, of all parts."""
    hi, lo, n = _summed(*_numbers(group.column("data").to_pylist(), "hi", "lo", "n"))
    return pa.table({"hi": hi, "lo": lo, "c": n})


def _joined(asked: pa.Table, known: pa.Table) -> pa.Table:
    """One shard: for each part the log-probabilities of its n-grams, in their order; the part finds the n-grams anew."""
    given = _index(*(known.column(c).to_numpy() for c in ("hi", "lo", "logp")))
    out = []
    for data in asked.column("data").to_pylist():
        hi, lo = _numbers([data], "hi", "lo")
        out.append(_packed(logp=given(hi, lo)))
    return pa.table({"part": asked.column("part"), "shard": asked.column("shard"), "data": pa.array(out, pa.binary())})


def full_model(parts: DataFrame, shards: int) -> DataFrame:
    """parts: as _counted() makes them. part, shard, data: the log-probabilities of the n-grams that a part has of a shard. The parts' rows go when they are joined."""
    asked = parts.where("shard is not null")
    summed = staged(asked.groupBy("shard").applyInArrow(_counts, "hi long, lo long, c long"), "counts")
    release_shuffles(parts.sparkSession)
    logp = staged(log_probabilities(summed.select(F.struct("hi", "lo").alias("g"), "c"), FULL_ORDER, _full_last, _full_before, None, LEAST), "probabilities")
    known = logp.select(_shard(F.col("g.hi"), F.col("g.lo"), shards).alias("shard"), "g.hi", "g.lo", "logp")
    found = staged(asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_joined, "part long, shard long, data binary"), "joined")
    for done in (parts, summed, logp):
        unstaged(done)
    release_shuffles(parts.sparkSession)
    return found


def model(parts: DataFrame) -> np.ndarray:
    """parts: as _counted() makes them. Log-probability of each folded n-gram that occurs in any text, by its number; GRAMS at most."""
    own = parts.where("shard is null").select("data").mapInArrow(_folded_counts, "g int, c long")
    found = log_probabilities(staged(own.groupBy("g").agg(F.sum("c").alias("c")), "counts")).toArrow()
    out = np.zeros(GRAMS, np.float32)
    out[found.column("g").to_numpy()] = found.column("logp").to_numpy()
    return out


_SCORED = "doc_id long, lang string, n_symbols long, perplexity double, full_perplexity double"


def perplexities(dealt: DataFrame, trusted: DataFrame, shards: int) -> DataFrame:
    """dealt: part, doc_id, lang, text; trusted: id. doc_id, lang, n_symbols, and both models' perplexity."""
    zipped = dealt.mapInArrow(_zipped, "part long, doc_id long, lang string, size long, zipped binary")
    # one plan at every size: where the labels are few, a broadcast would hide the shuffle that many have
    ids = dealt.select("part", "doc_id").join(trusted.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi")
    parts = staged(zipped.groupBy("part").cogroup(ids.groupBy("part")).applyInArrow(_counted(shards), "part long, shard long, data binary"), "parts")
    release_shuffles(dealt.sparkSession)
    folded = model(parts)
    there = np.flatnonzero(folded)
    sent = dealt.sparkSession.sparkContext.broadcast((there, folded[there]))  # 12 * GRAMS bytes at most; a dense table would be 64 MiB on every disk
    joined = full_model(parts, shards)

    def score(zipped: pa.Table, known: pa.Table) -> pa.Table:
        folded = np.zeros(GRAMS, np.float32)
        folded[sent.value[0]] = sent.value[1]
        out, kept, found = [], [], []

        def means(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
            return pa.array(np.exp(-(np.add.reduceat(values.astype(np.float64), np.cumsum(sizes) - sizes) / sizes)))

        for some, own in _slices(zipped):
            hi, lo, which, sizes = full_grams(own)
            found.append((hi, lo, np.zeros(len(hi), np.int64)))
            kept.append((some, which.astype(np.int32), sizes, means(folded[grams(own)[0]], sizes)))
        hi, lo, _, places = _by_shard(found, shards)
        logp = np.zeros(len(hi), np.float32)
        for shard, data in zip(known.column("shard").to_pylist(), known.column("data").to_pylist(), strict=True):
            logp[places[shard]] = _unpacked(data).column("logp").to_numpy()
        given = _index(hi, lo, logp)
        for (some, which, sizes, plain), (hi, lo, _) in zip(kept, found, strict=True):
            out.append(pa.table([some.column("doc_id"), some.column("lang"), pa.array(sizes), plain, means(given(hi, lo)[which], sizes)], ["doc_id", "lang", "n_symbols", "perplexity", "full_perplexity"]))
        return pa.concat_tables(out)

    return zipped.groupBy("part").cogroup(joined.groupBy("part")).applyInArrow(score, _SCORED)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity (of folded symbols), full_perplexity (of all letters), threshold (of full_perplexity), keep
    for every row of docs. Trusted documents have a label of quality 1
    that isn't toxic. Where a language has no trusted document, there is no threshold and its documents are kept. A null text is
    empty; a null lang is a language of its own."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    source = documents(docs, F.col("lang").cast("string").alias("lang"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // PART))))
    scored = staged(perplexities(source.select(part.alias("part"), "doc_id", "lang", "text"), trusted, max(16, size // SHARD_BYTES)), "perplexities")
    known = scored.join(trusted, F.col("doc_id") == F.col("id"), "left_semi")
    limits = known.groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("full_perplexity", quantile, 100_000).alias("threshold"))
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left")
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "full_perplexity", "threshold", F.coalesce(F.col("full_perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and keep for every row of `documents`; see judged() for nulls. Very long texts
    are scored whole, empty ones by their end alone; repeated rows are rows, equal perplexities are judged alike; an empty table
    gives none; columns with clashing names are never read."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
