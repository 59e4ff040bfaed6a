import random
import time

import corpus_pipeline
from cairn.llm import common, simhash
from pyspark.sql import functions as F

from .test_operators import prose


def test_stages_keep_columns_and_clean_documents(spark, tables):
    rng = random.Random(9)
    clean = [".\n".join(prose(rng, 30) for _ in range(4)) for _ in range(40)]
    item = prose(rng, 40)
    texts = [*clean, clean[0], "\n".join([clean[1], prose(rng, 40)]), item + "\n" + prose(rng, 200), "12345 !!", None, ""]
    path = tables([(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)], benchmark=[(1, item)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, path), name)
        assert docs.columns == columns, name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert {k: kept.get(k) for k in range(40)} == dict(enumerate(clean))
    assert 40 not in kept and 43 not in kept and 44 not in kept
    assert clean[1].split("\n")[0] not in kept[41] and item not in kept[42]
    packed = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)


def test_names_that_clash(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, prose(rng, 40), "en", k, k, k, k, k) for k in range(12)], "doc_id long, text string, lang string, fp long, hits long, gone long, n_lines long, score long")
    for stage in (corpus_pipeline.language, corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_near_dedup_at_five_word_shingles(spark):
    rng = random.Random(31)
    base = [prose(rng, 200).split() for _ in range(40)]
    near = []
    for words in base:
        copy = list(words)
        for at in (50, 120, 180)[: rng.randint(1, 3)]:
            copy[at] = "changed"
        near.append(copy)
    far = [[w if k % 6 else "other" for k, w in enumerate(words)] for words in base]
    docs = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate([*base, *near, *far])], "doc_id long, text string")
    for a, b, c in zip(base, near, far, strict=True):
        x, y, z = (simhash.shingles(" ".join(t)) for t in (a, b, c))
        assert simhash.jaccard(x, y) >= 0.8 > simhash.jaccard(x, z)
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == {*range(40), *range(80, 120)}


def test_near_dedup_compares_what_trees_link(spark):
    """The vantage-point trees alone give the pairs of close fingerprints (no bands here), once each and beside those of bands; large bands stay whole."""
    rng = random.Random(5)
    fps = [rng.getrandbits(62) for _ in range(60)]
    nodes = spark.createDataFrame([*((k, x) for k, x in enumerate(fps)), *((100 + k, x ^ 0b101) for k, x in enumerate(fps[:20])), (200, fps[0])], "node long, fp long")
    none = spark.createDataFrame([], "value long, node long")
    pairs, many = simhash.candidates(nodes, none)
    assert sorted(map(tuple, pairs.collect())) == sorted([*((k, 100 + k) for k in range(20)), (0, 200)]) and many.isEmpty()
    met = spark.createDataFrame([(v, n) for v in (1, 2, 3) for n in (0, 100, 30)] + [(9, n) for n in range(simhash.PAIRED + 1)], "value long, node long")
    pairs, many = simhash.candidates(nodes, met)
    assert sorted(map(tuple, pairs.collect())) == sorted([*((k, 100 + k) for k in range(20)), (0, 200), (0, 30), (30, 100)]) and many.count() == simhash.PAIRED + 1


def test_shuffles_are_released(spark):
    """The files of shuffles that nothing refers to any more go at once; the last query's may stay until the next one."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {p.rsplit("/", 1)[-1] for p in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in p}

    def shuffles(names):
        return {n.split("_")[1] for n in names}

    was = shuffles(files())
    for k in range(5):
        common.staged(spark.range(20_000).groupBy((F.col("id") % (5_000 + k)).alias("k")).count(), "counted")
    assert shuffles(files()) - was  # as many as no collection has come to by itself
    common.release_shuffles(spark)
    for _ in range(100):
        if len(shuffles(files()) - was) <= 1:
            break
        time.sleep(0.2)
    assert len(shuffles(files()) - was) <= 1
