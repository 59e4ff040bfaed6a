"""The tiered index against scores of every document."""

import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from cairn.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    n, total, df = len(held), sum(x[2] for x in held), Counter(t for x in held for t in x[1])
    out = []
    for item, text in items:
        q, scored = Counter(terms(text)), []
        for i, tf, size in held:
            m = 75 + 25 * size * n // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in q.items() if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(rng, n):
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for k in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, " ;,. "), (n + 3, "Äöü ÄÖÜ x_y A1 a1"), (n + 4, " ".join(rng.choices(vocabulary, k=20_000))), (3, docs[3][1]), (None, docs[5][1]), (None, "w1")]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranked, "SHARD_BYTES", 2000)
    monkeypatch.setattr(ranked, "LEAST", 2)


@pytest.mark.parametrize("named", [0, 10_000])
def test_all_tiers(spark, small, monkeypatch, named):
    monkeypatch.setattr(ranked, "NAMED", named)
    monkeypatch.setattr(ranked, "QUERY_BYTES", 300)
    rng = random.Random(named)
    docs = corpus(rng, 600)
    items = [(k, " ".join(x for _, x in rng.sample(docs[:600], 2))[:200]) for k in range(12)] + [(90, None), (91, "nowhere"), (92, "A1 ÄÖÜ"), (0, "w1 w1 w2"), (None, "w3")]
    got = ranked.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert found(got) == brute(docs, items, 7)


def test_equal_scores_and_hot_term(spark, small):
    docs = [(k, "same same words here") for k in range(3000, 0, -1)] + [(9000 + k, f"same {k}") for k in range(50)]
    items = [(1, "same"), (2, "words 7 same"), (3, "here here")]
    assert found(ranked.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_empty_tables_and_names(spark):
    docs, items = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, score long, shard long"), spark.createDataFrame([(1, "a", 2)], "item_id long, text string, rank int")
    assert found(ranked.ranked(docs, items)) == brute([(1, "a b")], [(1, "a")])
    assert not found(ranked.ranked(docs.limit(0), items)) and not found(ranked.ranked(docs, items.limit(0)))


def test_bounds_never_lie():
    """After any tier, a document's score lies between the lower and the upper bound."""
    import numpy as np

    rng = np.random.default_rng(3)
    term, doc = np.divmod(np.unique(rng.integers(0, 20 * 300, 2500)), 300)
    impact = rng.integers(1, 1000, len(term))
    whole = np.zeros((20, 300), int)
    whole[term, doc] = impact
    seen = np.zeros_like(whole)
    for tier in ranked._tiers(term, doc, impact, 20, 300):
        ends = np.concatenate(([0], tier["ends"]))
        for t in range(20):
            seen[t, tier["at"][ends[t] : ends[t + 1]]] = tier["impact"][ends[t] : ends[t + 1]]
            assert ((whole[t] == seen[t]) | (seen[t] == 0) & (whole[t] <= tier["rest"][t])).all()
    assert (seen == whole).all()


def test_row_groups_hold_few_shards(spark):
    """A task's shards are written (and so read) a few at a time, however many it has."""
    texts = [" ".join(f"{(k * 400_000 + i) * 2_654_435_761 % (1 << 32):x}" for i in range(400_000)) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tiers = ranked.index(docs, 6, 2_400_000)
    assert tiers.count() == 6
    for name in tiers.inputFiles():
        found = pq.ParquetFile(name.removeprefix("file://")).metadata
        assert found.num_rows < 2 or max(found.row_group(g).num_rows for g in range(found.num_row_groups)) < 6
