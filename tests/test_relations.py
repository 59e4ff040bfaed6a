"""Graphs, band joins, units and similarity joins against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import graphs, matching, profiling, units


def plain_depths(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    of = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    between = {(of[a], of[b]) for a, b in edges if of[a] != of[b]}
    depth = dict.fromkeys(of.values(), 0)
    for _ in nodes:
        for a, b in between:
            depth[a] = max(depth[a], depth[b] + 1)
    return sorted((n, of[n], list(of.values()).count(of[n]), depth[of[n]]) for n in nodes)


@pytest.mark.parametrize("shape", ["random", "chain and circles"])
def test_depths(spark, shape):
    rng = random.Random(7)
    if shape == "random":
        edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(3, 3)]
    else:
        edges = [(k, k + 1) for k in range(20)] + [(12, 9), (5, 4), (30, 31), (31, 32), (32, 30), (32, 0), (0, 1), (90, 90)]
    found = graphs.depths(spark.createDataFrame([*edges, (None, 1)], "source long, target long"))
    assert sorted(map(tuple, found.collect())) == plain_depths(edges)


def test_depths_of_nothing(spark):
    assert not graphs.depths(spark.createDataFrame([], "source long, target long")).collect()


def near(a, b, tolerance):
    return all(x is not None and math.isfinite(x) for x in (a, b)) and abs(a - b) <= tolerance * abs(b)


@pytest.mark.parametrize("tolerance", [0.02, 0.3])
def test_band_pairs_and_matches(spark, tolerance):
    rng = random.Random(1)
    values = [0.0, -0.0, None, math.nan, math.inf, -5.0, 100.0, 98.0, 102.0, 1e-300, 1e300] + [rng.choice([-1, 1]) * rng.uniform(50, 150) for _ in range(80)]
    left = [(k % 3, k, v) for k, v in enumerate(values)]
    right = [(k % 3, k, v) for k, v in enumerate(rng.sample(values, len(values)))]
    sides = spark.createDataFrame(left, "g int, left long, a double"), spark.createDataFrame(right, "g int, right long, b double")
    pairs = {(g, i, j, abs(a - b)) for g, i, a in left for h, j, b in right if g == h and near(a, b, tolerance)}
    assert {(r.g, r.left, r.right, r.gap) for r in matching.band_pairs(*sides, ["g"], tolerance).collect()} == pairs
    taken, gone = set(), set()
    for g, i, j, gap in sorted(pairs, key=lambda p: (p[0], p[3], p[1], p[2])):
        if not {(g, "l", i), (g, "r", j)} & gone:
            taken.add((g, i, j, gap))
            gone |= {(g, "l", i), (g, "r", j)}
    assert {tuple(r) for r in matching.matched_sides(*sides, ["g"], tolerance).collect()} == taken


def test_band_pairs_at_the_edges(spark):
    """Numbers that differ by the whole tolerance, at many places of the buckets."""
    right = [(0, k, 1.0137**k) for k in range(900)]
    left = [(0, k, b * 0.98) for _, k, b in right]
    found = matching.band_pairs(spark.createDataFrame(left, "g int, left long, a double"), spark.createDataFrame(right, "g int, right long, b double"), ["g"])
    assert found.count() == sum(near(a, b, 0.02) for i, (_, _, a) in enumerate(left) for _, _, b in right[max(0, i - 9) : i + 9])
    with pytest.raises(ValueError):
        matching.band_pairs(found, found, [], 1.0)


def test_units(spark):
    cases = [("kN*m", "J", True, 1.0, 3), ("kV/cm", "N/C", True, 1.0, 5), ("[km/h]", "m / s", True, 1 / 3600, 3), ("µF", "uF", True, 1.0, 0), ("Ω", "V/A", True, 1.0, 0), ("m", "s", False, None, None), ("parsec", "m", None, None, None),
             (None, "m", None, None, None), ("", "m", None, None, None), ("m//s", "m", None, None, None), ("m^-1", "1/m", None, None, None), ("m^99999999999", "m", None, None, None), ("min", "s", True, 60.0, 0), ("mmol*L^-1", "mol/m^3", True, 1.0, 0), ("rad", "rad", True, 1.0, 0)]
    got = {r.a: (r.alike, r.ratio, r.ten) for r in units.converted(spark.createDataFrame([(a, b) for a, b, *_ in cases], "a string, b string"), "a", "b").collect()}
    for a, _, alike, ratio, ten in cases:
        assert got[a][0] == alike and got[a][2] == ten and (ratio is None and got[a][1] is None or math.isclose(got[a][1], ratio)), a


@pytest.mark.parametrize(("least", "hot"), [(0.8, 1 << 13), (0.8, 2), (0.5, 3)])
def test_jaccard_pairs(spark, least, hot):
    rng = random.Random(3)
    base = [rng.sample(range(60), rng.randint(1, 14)) for _ in range(60)]
    sets = base + [[*s[:-1], 99] for s in base[:30]] + [s + [70 + k] for k, s in enumerate(base[:20])] + [[], base[0]] + [[1, 2, 3, 4, 100 + k] for k in range(12)]
    rows = [(k, [str(x) for x in s]) for k, s in enumerate(sets)]
    first = {}
    for k, s in rows:
        first.setdefault(frozenset(s), k)
    wanted = {(a, b, len(x & y) / len(x | y)) for x, a in first.items() for y, b in first.items() if a < b and x and y and len(x & y) / len(x | y) >= least}
    got = profiling.jaccard_pairs(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w", least, hot)
    assert {(r.a, r.b, round(r.jaccard, 9)) for r in got.collect()} == {(a, b, round(j, 9)) for a, b, j in wanted}


def test_no_word_of_many_sets_in_one_piece(spark):
    """A word that all sets have first is dealt over pieces, and no pair is lost."""
    rows = [(k, ["a", *(f"{k % 40}-{j}" for j in range(4)), *([] if k < 40 else ["z"])]) for k in range(80)]
    got = profiling.jaccard_pairs(spark.createDataFrame(rows, "k long, w array<string>").withColumn("extra", F.lit(1)), "k", "w", 0.8, 4)
    assert {(r.a, r.b) for r in got.collect()} == {(k, k + 40) for k in range(40)}


@pytest.mark.parametrize("flat", [True, False])
def test_top_pairs(spark, flat):
    """Against counts of all pairs, with items of equal and of very different frequency, repeats, nulls and a group that holds everything."""
    rng = random.Random(19)
    rows = [(g, f"w{int(rng.random() * 150 if flat else 150 * rng.random() ** 4)}") for g in range(120) for _ in range(rng.randint(1, 25))]
    rows += [(500, f"w{k}") for k in range(150)] + [(None, "w1"), (3, None)]
    held = {}
    for g, w in rows:
        if g is not None and w is not None:
            held.setdefault(g, set()).add(w)
    counts = {}
    for words in held.values():
        for a in words:
            for b in words:
                if a < b:
                    counts[a, b] = counts.get((a, b), 0) + 1
    want = sorted(((a, b, n) for (a, b), n in counts.items()), key=lambda r: (-r[2], r[0], r[1]))
    df = spark.createDataFrame(rows, "g long, w string")
    assert [tuple(r) for r in profiling.top_pairs(df, "g", "w", 30, first=8).collect()] == want[:30]
    assert [tuple(r) for r in profiling.top_pairs(df, "g", "w", 30, first=40).collect()] == want[:30]
    assert profiling.top_pairs(df.limit(0), "g", "w").collect() == []


def test_jaccard_pairs_sends_words_of_pairs_only(spark):
    """Sets without a similar one never leave their task with their words; sizes, frequent words and sets of thousands of words lose no pair."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    sets = [rng.sample(words[: rng.choice((30, 400))], rng.randint(1, 30)) for _ in range(150)]
    sets += [[*s, "more"] for s in sets[:60]] + [sets[0]] + [[f"l{k}" for k in range(20_000)], [f"l{k}" for k in range(2_000, 20_000)]] + [[]]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, w array<string>")
    expected, least = set(), {}
    for k, s in enumerate(sets):
        if s:
            least.setdefault(frozenset(s), k)
    for (s, a), (t, b) in itertools.combinations(least.items(), 2):
        if len(s & t) >= 0.8 * len(s | t) - 1e-12:
            expected.add((min(a, b), max(a, b)))
    for hot in (3, 1 << 13):
        assert {(r.a, r.b) for r in profiling.jaccard_pairs(df, "k", "w", hot=hot).collect()} == expected
    hashes = df.where("size(w) > 0").select(F.col("k").alias("id"), F.size("w").alias("n"), F.transform("w", lambda t: F.xxhash64(t)).alias("h"))
    sketches = profiling._sketched(hashes, profiling._word_levels(hashes.select("h")), 0.8).collect()
    assert len(sketches) == len(sets) - 1 and max(len(r.parts) for r in sketches) == profiling.PARTS and max(r.n for r in sketches) == 20_000
