"""The shared kernels of the training-data operators."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bitfilter
from factloom.llm import textkernel as tk
from factloom.llm.components import components
from factloom.llm.line_dedup import SeenBits, letter_counts, letters_apart
from factloom.llm.scratch import Scratch
from factloom.llm.substring_dedup import NO_ID, SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aéB \n\t  ß,", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, block):
    seen, rows = {}, 0
    for w in tk.blocks(pa.array(texts, pa.string()), block=block):
        for k, (a, b, d, h) in enumerate(zip(w.start, w.end, w.doc, w.hash, strict=True)):
            word = bytes(w.data[a:b]).decode()
            assert seen.setdefault(word, h) == h
            own = WORD.findall(texts[w.row0 + d] or "")
            assert own[k - w.first[d]] == word
        for r in range(w.rows):
            assert w.first[r + 1] - w.first[r] == len(WORD.findall(texts[w.row0 + r] or ""))
        rows += w.rows
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=6))
def test_automaton_knows_the_smallest_holder(texts):
    sam = SuffixAutomaton()
    for k, t in enumerate(texts):
        sam.add(t, k)
    sam.close()
    for k, t in enumerate(texts):
        for n in (1, 2, 3):
            want = [i for i in range(len(t) - n + 1) if any(texts[j][p : p + n] == t[i : i + n] for j in range(k) for p in range(len(texts[j])))]
            assert sam.matches(t, n, k) == want
    assert min(sam.least) <= NO_ID


def test_filter_never_misses(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**62), 2**62, 500)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    bits = bitfilter.build(df, "k", 16)
    assert bitfilter.test(bits, keys).all() and bitfilter.test(bits, rng.integers(0, 2**62, 500)).mean() < 0.1
    assert not bitfilter.test(bitfilter.build(df.limit(0), "k", 16), keys).any()
    seen = SeenBits(df, "k", 12)
    assert df.where(seen.maybe("k")).count() == 500
    assert df.where(SeenBits(df.limit(0), "k", 12).maybe("k")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_letter_counts_bound_edits(spark):
    rows = spark.createDataFrame([("these are letters", "these are letter"), ("nothing", "nthing"), ("same", "same"), ("aaaa", "rrrr")], "a string, b string")
    out = rows.selectExpr(f"{letter_counts('a')} as x", f"{letter_counts('b')} as y").selectExpr(f"{letters_apart('x', 'y')} as d").collect()
    assert [r.d for r in out] == [1, 1, 0, 8]
