"""Alignment against whole texts encoded by the tokenizers themselves."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import align

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
KEEP = align.Aligner(*align._paths(None, None))


def brute_groups(text):
    """(a ids, b ids) of each group, by sets of byte offsets; None without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes, b_bytes = [KEEP.a_bytes[i] for i in a], [KEEP.b_bytes[i] for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None

    def ends(x):
        return [sum(map(len, x[: k + 1])) for k in range(len(x))] if len(x) < 3000 else __import__("itertools").accumulate(map(len, x))

    a_ends, b_ends = list(ends(a_bytes)), list(ends(b_bytes))
    out, i, j = [], 0, 0
    for cut in sorted({*a_ends} & {*b_ends}):
        ia, jb = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
        out.append((a[i:ia], b[j:jb]))
        i, j = ia, jb
    return out


def spelled(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def brute(texts):
    found = [brute_groups(t) for t in texts]
    links = Counter((a[-1], b[-1]) for g in found if g for a, b in g)
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    rows = []
    for g in found:
        own = [links[a[-1], b[-1]] for a, b in g or ()]
        best = sum(links[a[-1], b[-1]] == most[b[-1]] for a, b in g or ())
        rows.append((sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), len(g or ()), best, sum(own), hashlib.sha256(spelled(g).encode()).hexdigest() if g else ""))
    return rows


def by_parts(text):
    found = [KEEP.part(p) for p in align.parts(text)]
    return None if None in found else ";".join(x[2] for x in found)


ODD = ["", " ", "  ", "\n", "a  b", " lead", "trail ", "x\n\ny", "a\n b", "a \nb", "tab\t\tx y", "don't we'll 'sabc", "<|endoftext|> </s> <unk> <0x41>", "a▁b", "日本語 テスト", "é éx", "    x", "1234 5,678.90", "a\r\nb\r\n c", "f(x){\r\n  }", "\x00 \x1c \x85", "😀 👩‍👩‍👧 ok", "ﬁ Ａ ǅ ß", "...!!! --- ''' \"x\"", "word,\nWord.Word;word", "x" * 500, "​﻿", "ab̀ c"]


@pytest.mark.parametrize("text", ODD)
def test_parts_of_odd_texts(text):
    groups = brute_groups(text)
    if text:
        assert by_parts(text) == (spelled(groups) if groups is not None else None)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r\n", ".", ",", "'s", "'", "-", "the", "The", "ation", "é", "ñ", "Ω", "日", "1", "42", "<", "|", "_", "😀", " ", " ", "́", "x", "{", "}", "\x1f", "ſ", "▁"]), max_size=14).map("".join))
def test_parts_of_any_text(text):
    groups = brute_groups(text)
    if text:
        assert by_parts(text) == (spelled(groups) if groups is not None else None)


def corpus():
    rng = random.Random(2)
    texts = [None, *ODD]
    for _ in range(60):
        texts.append(" ".join("".join(rng.choice("the of and ti on re é . , \n 12".split(" ")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 50))))
    return [*texts, texts[40], texts[40], " ".join(f"word{k % 70}" for k in range(9000))]


@pytest.mark.parametrize(("hot", "kept"), [(1 << 20, 120_000), (40, 120_000), (0, 30)])
def test_alignment(spark, monkeypatch, hot, kept):
    """With all pairs broadcast, with most of them joined, and with hardly a part kept."""
    monkeypatch.setattr(align, "MAX_PARTS", kept)
    texts = corpus()
    docs = spark.createDataFrame([(k // 2, t, 7, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_a long, groups string").repartition(3)
    got = align.aligned(docs, hot=hot, hot_parts=min(hot, 100_000)).collect()
    assert sorted(map(tuple, got)) == sorted((k // 2, *row) for k, row in enumerate(brute(texts)))


def test_groups_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "Hello, there"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in align.aligned(docs, with_groups=True).collect()}
    assert got == {1: spelled(brute_groups("Hello, there")), None: ""}
    assert align.aligned(docs.limit(0)).count() == 0


def test_given_and_kept_parts_take_little_memory():
    """Links lie packed, and given parts in columns: tuples of ids for each part took several times as much."""
    import tracemalloc

    import pyarrow as pa

    names = [f"word{k}" for k in range(20_000)]
    aligner = align.Aligner(*align._paths(None, None))
    tracemalloc.start()
    try:
        found = [aligner.part(p) for p in names]
        kept = tracemalloc.get_traced_memory()[0] / len(names)
        links = pa.array([np.frombuffer(x[3], np.int64) for x in found], pa.list_(pa.int64()))
        given = pa.table({"part": names, "groups": [x[2] for x in found], "n_a": [x[0] for x in found], "n_b": [x[1] for x in found], "links": links})
        before = tracemalloc.get_traced_memory()[0]
        met = align.Parts(aligner, given)
        taken = (tracemalloc.get_traced_memory()[0] - before) / len(names)
    finally:
        tracemalloc.stop()
    assert met.of("word7 word9").tolist() == [7, 9] and met.linked(7) == found[7][3]
    assert kept < 600 and taken < 400, (kept, taken)
