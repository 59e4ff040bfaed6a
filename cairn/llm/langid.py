"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector of DIMENSIONS entries, drawn from its code point alone. A trigram binds
the vectors of its letters, permuted by their place (rolled by two, one and no entries, multiplied entry by
entry). A text's profile bundles (sums) its trigrams' vectors, a language's prototype bundles the unit profiles'
trigram counts of all labelled texts, and a text takes the language whose prototype has the largest cosine with
its profile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import documents, held, set_aside, slices, staged, table

DIMENSIONS, SEED, MAX_GRAMS = 1024, 20_011, 20_000
#: For reject(): a text is in none of the languages if its best cosine is below MARGIN times this quantile of those of the labelled texts with as many trigrams (up to a factor of two).
LEAST_QUANTILE, MARGIN = 0.001, 0.8
#: Texts whose vectors are summed at once, and the least number of trigrams of a text whose sums single precision might round.
TOGETHER, EXACT = 128, 1 << 24


class Profiles:
    """Trigram vectors, made when first seen and kept up to MAX_GRAMS; their values depend on the letters only."""

    def __init__(self) -> None:
        self.letters = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                self.letters[c] = ord(x.lower()[0])
        self.vectors: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((MAX_GRAMS, DIMENSIONS), np.int8)  # takes memory as its rows are written; growing it would hold it twice

    def _letter(self, c: int) -> np.ndarray:
        if c not in self.vectors:
            if len(self.vectors) > MAX_GRAMS:
                self.vectors.clear()
            self.vectors[c] = np.random.default_rng([SEED, c]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1
        return self.vectors[c]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's trigrams over letters and single boundaries, and their counts; none without a letter."""
        x = self.letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        x = np.concatenate(([0], x, [0])).astype(np.int64)
        x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
        if len(x) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique((x[:-2] << 42) | (x[1:-1] << 21) | x[2:], return_counts=True)

    def _rows(self, part: list[int]) -> np.ndarray:
        """The trigrams' rows of the matrix."""
        if len(self.rows) + len(part) > MAX_GRAMS:
            self.rows.clear()
        for g in part:
            if g not in self.rows:
                k = self.rows[g] = len(self.rows)
                a, b, c = g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF
                self.matrix[k] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
        return np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, each times its count."""
        out = np.zeros(DIMENSIONS)
        for at in range(0, len(grams), 4096):
            rows = self._rows(grams[at : at + 4096].tolist())
            out += counts[at : at + 4096].astype(np.float32) @ self.matrix[rows].astype(np.float32)
        return out

    def bundles(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """As bundle(), of TOGETHER texts at once, which share most of their trigrams: one product of matrices for all. The sums are whole numbers that
        single precision holds; texts that might have larger ones go one by one."""
        out = np.zeros((len(found), DIMENSIONS))
        large = [k for k, (_, counts) in enumerate(found) if counts.sum() >= EXACT]
        for k in large:
            out[k] = self.bundle(*found[k])
        own = np.array([k for k in range(len(found)) if k not in set(large)], np.int64)
        for at in range(0, len(own), TOGETHER):
            some = own[at : at + TOGETHER]
            grams, column = np.unique(np.concatenate([found[k][0] for k in some]), return_inverse=True)
            counts, row = np.concatenate([found[k][1] for k in some]), np.repeat(np.arange(len(some)), [len(found[k][0]) for k in some])
            for low in range(0, len(grams), 4096):
                here = (column >= low) & (column < low + 4096)
                rows = self._rows(grams[low : low + 4096].tolist())
                table = np.zeros((len(some), len(rows)), np.float32)
                table[row[here], column[here] - low] = counts[here]
                out[some] += table @ self.matrix[rows].astype(np.float32)
        return out


def profiles() -> Profiles:
    kept = held("profiles")
    if not kept:
        kept[0] = Profiles()
    return kept[0]


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language of a task: the sum of its texts' profiles, each at equal weight."""
    p, sums = profiles(), {}
    for batch in slices(batches, "text", 2 << 20):
        found = list(map(p.grams, batch.column("text").to_pylist()))
        for (grams, _), x, lang in zip(found, p.bundles(found), batch.column("lang").to_pylist(), strict=True):
            if len(grams):
                sums[lang] = sums.get(lang, 0) + np.rint(x * (1e6 / (np.linalg.norm(x) or 1))).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"])


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """labelled: text, lang. The languages, sorted, and a unit prototype of each. Only languages x DIMENSIONS
    sums reach the driver."""
    sums = labelled.select(F.coalesce("text", F.lit("")).alias("text"), "lang").where("lang is not null").mapInArrow(_bundles, "lang string, bundle array<long>")
    rows = sums.select("lang", F.posexplode("bundle").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in rows})
    out = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        out[langs.index(r.lang), r.k] = r.x
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, learned: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred, score (the best cosine, 0 to 1) and n_grams (trigrams); `und`, 0 and 0 for a text without a letter.
    Equal cosines: the language that sorts first."""
    langs, vectors = learned
    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "n_grams": F.lit(0).cast("long")}).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiles()
        for batch in slices(batches, "text", 2 << 20):
            best, score, sizes = [], [], []
            found = [p.grams(text or "") for text in batch.column("text").to_pylist()]
            for (grams, counts), x in zip(found, p.bundles(found if langs else [(g[:0], c[:0]) for g, c in found]), strict=True):
                sizes.append(int(counts.sum()))
                if not len(grams) or not langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                cosines = vectors @ (x / (np.linalg.norm(x) or 1))
                k = int(np.argmax(cosines))
                best.append(langs[k])
                score.append(min(1.0, max(0.0, float(cosines[k]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sizes, pa.int64())], [*batch.schema.names, "lang_pred", "score", "n_grams"])

    return docs.mapInArrow(predict, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning; a null doc_id always is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes from the documents that are not held out."""
    return prototypes(docs.where(~held_out()))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of `documents`; see identify() and held_out().

    A null or empty text, or one without a letter, is `und` with score 0; without any labelled text all are. Very long texts count
    whole, each labelled text at equal weight; repeated rows are rows; columns with clashing names are never read."""
    docs = table(spark, sf_dir, "documents")
    learned = learn(docs.select("doc_id", "text", "lang"))
    return identify(documents(docs), learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def reject(docs: DataFrame, quantile: float = LEAST_QUANTILE, margin: float = MARGIN) -> DataFrame:
    """docs without those in none of the languages learned from their lang column: no letter, or a best cosine under what texts of
    its length have, learned from the scores of all labelled texts (short ones hardly tell, so hardly any goes). Where nothing is
    labelled nothing can be learned and every text goes. Null and empty texts go, repeated rows are treated alike, and columns
    named like ours are kept as they are."""
    docs, kept = set_aside(docs, "lang_pred", "score", "n_grams")
    found = staged(identify(docs, learn(docs.select("doc_id", "text", "lang"))), "scored").where("lang_pred <> 'und'")
    size = F.floor(F.log2("n_grams")).cast("int")
    limits = found.where("lang is not null").groupBy(size.alias("size")).agg(F.percentile_approx("score", quantile, 100_000).alias("least")).collect()  # a row for each power of two
    least = {r["size"]: r.least * margin for r in limits}
    known = F.create_map(*[F.lit(x) for k in sorted(least) for x in (k, least[k])]) if least else F.create_map(F.lit(-1), F.lit(0.0))
    return found.where(F.col("score") >= F.coalesce(known[size], F.lit(0.0))).select(*kept)
