"""The class model: counts and base scores against plain Python, exchange against the likelihood, probabilities that sum to 1."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import brown
from cairn.llm.queries import QUERIES


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), None]


def brute(docs):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    c = Counter(w for (_, t), held in zip(docs, out, strict=True) if not held for w in tokens(t))
    n, v = sum(c.values()), len(c)
    rows = []
    for (i, t), held in zip(docs, out, strict=True):
        own = tokens(t)
        rows.append((i, held, len(own), sum(w in c for w in own), n, round(math.fsum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)))
    return sorted(rows, key=str)


def corpus():
    rng = random.Random(4)
    tongues = ["the of and ti on re er in".split(), "der die und ei sch ung ver".split()]

    def text(n):
        own = rng.choice(tongues)
        return " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 2))) for _ in range(n))

    docs = [(k, text(rng.randint(3, 60))) for k in range(300)]
    return docs + [(400, None), (401, ""), (402, " \t\n"), (403, "Äpfel ÄPFEL The THE\x1cx\xa0y\x0bz"), (404, text(20_000)), (5, docs[5][1]), (None, "once upon"), (405, "never " * 3 + "seen-405")]


@pytest.mark.parametrize("hot", [1 << 18, 20, 0])
def test_counts_and_base(spark, hot):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, score double, word string").repartition(3)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    got = brown.scored(frame, ~held, classes=4, core=30, hot=hot, sweeps=1).collect()
    assert sorted([(r.doc_id, not r.learn, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=str) == brute(docs)
    assert all(r.score < 0 for r in got)
    if hot:
        assert sum(r.score for r in got if not r.learn) > sum(r.base_score for r in got if not r.learn)


def test_score_by_hand(spark):
    """score from the classes that the model has, word by word."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("learn", F.coalesce(F.col("doc_id") % 3 > 0, F.lit(True)))
    args = {"classes": 5, "core": 25, "sweeps": 2}
    got = {(r.doc_id, r.n_tokens): r.score for r in brown.scored(docs, F.col("learn"), **args).collect()}
    plain = docs.withColumn("text", F.coalesce("text", F.lit("")))
    vocabulary = brown.counted(plain.where("learn"))
    numbers, n, _ = brown.numbered(vocabulary, 1 << 18)
    rows = brown.sequences(plain, spark.sparkContext.broadcast(numbers))
    of, _, seen = brown.classes_of(rows.where("learn"), len(n), numbers[b""], **args)
    assert seen[-1] > seen[0]
    texts = [(r.doc_id, r.learn, [*brown.words(r.text), b""]) for r in plain.collect()]
    pairs = np.zeros((5, 5))
    for _, learn, own in texts:
        if learn:
            for a, b in zip([b"", *own[:-1]], own, strict=True):
                pairs[of[numbers[a]], of[numbers[b]]] += 1
    total, singles = n.sum(), (n == 1).sum()
    u, size = (singles + 0.5) / (total + 1), pairs.sum(0)
    p = (size + 1) / (size.sum() + 5)
    for doc, _, own in texts:
        score, was = 0.0, of[numbers[b""]]
        for w in own:
            if w in numbers:
                c = of[numbers[w]]
                given = p[c] if was is None else (pairs[was, c] + brown.PRIOR * p[c]) / (pairs[was].sum() + brown.PRIOR)
                score += math.log10((1 - u) * given * n[numbers[w]] / size[c])
                was = c
            else:
                score, was = score + math.log10(u), None
        assert math.isclose(got[doc, len(own)], score, rel_tol=1e-9)


def test_sums_to_one():
    n = np.random.default_rng(1).integers(0, 50, (6, 6))
    table, size = 10 ** brown.Model(n, 7, int(n.sum())).table, n.sum(0)
    assert np.allclose(table[:, :-1] @ size + table[:, -1], 1)


@pytest.mark.parametrize("seed", range(4))
def test_exchange_raises_likelihood_most(seed):
    """The class of each word against the likelihood of every choice, counted anew."""
    rng = np.random.default_rng(seed)
    words, classes = 12, 4
    pairs = rng.integers(0, 6, (words, words))
    np.fill_diagonal(pairs, 0)
    of = rng.integers(0, classes, words)

    def bigrams(of):
        one = np.eye(classes, dtype=int)[of]
        return one.T @ pairs @ one

    one = np.eye(classes, dtype=int)[of]
    for w in range(words):
        found = brown.exchanged((one.T @ pairs).T[w : w + 1], (pairs @ one)[w : w + 1], of[w : w + 1], bigrams(of))
        values = []
        for c in range(classes):
            other = of.copy()
            other[w] = c
            values.append(brown.likelihood(bigrams(other)))
        assert values[found[0]] >= max(values) - 1e-6


def test_nothing_learned_and_empty_table(spark, tables):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(brown.scored(docs, F.lit(False), classes=3).collect())
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0), (1, 0, 0)] and all(math.isfinite(r.score) for r in got)
    assert brown.scored(docs.limit(0), F.lit(True), classes=3).count() == 0
    assert [r.train_tokens for r in QUERIES["op11_class_lm"](spark, tables([(1, "x y", "en", "s", 3)])).collect()] == [3]
