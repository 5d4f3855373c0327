"""Brute-force checks of the training-data operators on small tables with nulls,
empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm.chat_format import following, gathered, preference_pairs
from factloom.llm.fingerprints import Fingerprinter
from factloom.llm.jaccard_join import JaccardJoin, keep_one
from factloom.llm.language_id import LanguageIdentifier, codewords
from factloom.llm.line_dedup import LineDedup
from factloom.llm.mixing import MixtureBudget
from factloom.llm.packing import HilbertPacker, hilbert
from factloom.llm.queries import QUERIES, every_line, word_bpe
from factloom.llm.substring_dedup import SubstringDedup
from factloom.llm.suffix_dedup import SuffixDedup
from factloom.llm.topk_search import TopKSearch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, piece string"


def corpus(seed=3, n=70):
    """Documents with copies, near copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    some = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, base = some(60), some(120)
    out = []
    for i in range(n):
        w = some(rng.randint(1, 150))
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        if i % 7 == 0:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        text = "".join(x + rng.choice([" ", " ", "\n", " \t"]) for x in w)
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, "  \n\t "), (n + 3, "one"), (n + 4, "One"), (n + 5, "é" * 5000), (n + 6, "x y " * 3000)]
    out += [(n + 7, out[0][1]), (n + 8, out[7][1].upper()), (n + 9, out[5][1])]
    return [(d, t, ("en", "fr", None)[d % 3], f"src{d % 4}" if d % 9 else None, len(t or ""), "k", 1, "p") for d, t in out]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, fold=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if fold else text)


def test_substring_dedup(docs, rows, none):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in SubstringDedup(13).clean(docs).collect()}
    first = {}
    for d, t, *_ in sorted(rows):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        assert got[d] == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)), d
    assert SubstringDedup(13).clean(none).count() == 0


def test_substring_dedup_small_shards(docs):
    want = sorted(SubstringDedup(13).clean(docs).collect())
    assert sorted(SubstringDedup(13, filter_bits=15, shard_words=50).clean(docs).collect()) == want
    assert sorted(SubstringDedup(13, most_pieces=1).clean(docs).collect()) == want  # every shared anchor is refined


def classes(rows, n, percent):
    sets = {}
    for d, t, *_ in rows:
        w = words(t, True)
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(d, len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "percent", "bits", "seed"), [(4, 85, 18, 3), (5, 80, 4, 4), (1, 60, 15, 5), (1, 30, 15, 6), (2, 45, 18, 7)])
def test_jaccard_join(spark, n, percent, bits, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in JaccardJoin(n, percent, sketch_bits=max(bits, 15), sigmas=8 if bits > 15 else 0.0).classes(docs).collect()}
    assert got == classes(rows, n, percent)


@pytest.mark.parametrize(("n", "percent", "sigmas"), [(4, 85, 8.0), (3, 80, 0.0), (2, 90, 0.0)])
def test_jaccard_join_of_a_large_group(spark, n, percent, sigmas):
    """Near copies of one text, about as far apart as the limit allows."""
    draw = random.Random(percent)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for d in range(150):
        text = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 2, 3, 4])):
            k = draw.randrange(len(text))
            text[k : k + 1] = draw.choice([[], [f"x{draw.randrange(40)}"], [f"y{d}", "z"]])
        rows.append((d, " ".join(text)))
    rows += [(200 + d, f"only w{d} w{d + 1} w{d + 2} w{d + 3} here") for d in range(60)]
    got = {tuple(r) for r in JaccardJoin(n, percent, sketch_bits=15, sigmas=sigmas).classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows, n, percent)


def test_jaccard_join_of_short_sets(spark):
    rows = [(1, "a b"), (2, "a c"), (3, "q"), (4, "q z"), (5, "q"), (6, "k l m"), (7, "k")]
    for percent in (30, 34, 50):
        got = {tuple(r) for r in JaccardJoin(1, percent).classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == classes(rows, 1, percent)


def test_jaccard_odd_rows(spark, none):
    assert JaccardJoin().classes(none).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in JaccardJoin().classes(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2)], key=str)


def test_keep_one(docs, rows):
    left = {r.doc_id for r in keep_one(docs, JaccardJoin(4, 85)).collect()}
    assert left == {d for d, _, c in classes(rows, 4, 85) if d == c}


def test_keep_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")] * 4 + [(2, "a b c d e f g"), (3, "x"), (4, None), (4, None), (None, "q r s")], "doc_id long, text string")
    assert sorted((r.doc_id for r in keep_one(docs).collect()), key=str) == [1, 3, 4, 4, None]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_banded_distance(spark):
    from pyspark.sql import functions as F

    from factloom.llm.line_dedup import within

    rng = random.Random(1)
    pairs = [("", ""), ("", "ab"), ("", "abc"), ("a", "b"), ("😀a", "😁a"), ("ab", "ba")]
    for _ in range(300):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(1, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    for most in (1, 2, 3):
        got = df.select("k", *(F.expr(within("a", "b", most, str(e))).alias(str(e)) for e in range(most + 1))).collect()
        assert [(r.k, e) for r in got for e in range(most + 1) if r[str(e)] != (edits(*pairs[r.k]) <= e)] == []


def test_line_dedup(spark, none):
    rng = random.Random(9)
    base = [f"abcdefgh ijklmnop qrstuvw xyz {i} and so on" for i in range(12)] + ["short", "a b c d e f g h", "x" * 40]

    def edited(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s))
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "é", "t", "n"])
        return "".join(s)

    data = [(i, "\n".join(edited(rng.choice(base)) for _ in range(5)), 0) for i in range(30)]
    data += [(None, base[0], 1), (40, None, 2), (41, "", 3), (42, base[1], 4), (42, base[1], 4)]
    got = sorted(((r.doc_id, r.text, r.lines_dropped, r.gone) for r in LineDedup().clean(spark.createDataFrame(data, "doc_id long, text string, gone int")).collect()), key=str)
    seen, out = [], {}
    for d, t, _ in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        if (d, t) in out:
            continue
        kept, n = [], 0
        for line in t.split("\n") if t is not None else []:
            near = [m for m in seen if line == m or (min(len(line), len(m)) >= 30 and abs(len(line) - len(m)) < 3 and edits(line, m) <= 2)]
            if len(line) >= 12 and near:
                n += 1
            else:
                kept.append(line)
            seen += [line] if len(line) >= 12 else []
        out[d, t] = ("\n".join(kept) if t is not None else None, n)
    want = [(d, *out[d, t], g) for d, t, g in data]
    assert got == sorted(want, key=str)
    assert LineDedup().clean(none).count() == 0


def test_suffix_dedup(docs, rows, none):
    got = {r.doc_id: r.n_repeated for r in SuffixDedup(50).report(docs).collect()}
    places = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            places.setdefault(tuple(w[i : i + 50]), []).append(d)
    for d, t, *_ in rows:
        w = words(t)
        hit = [False] * len(w)
        for i in range(len(w) - 49):
            if len(places[tuple(w[i : i + 50])]) > 1:
                hit[i : i + 50] = [True] * 50
        assert got.get(d, 0) == sum(hit), d
    assert SuffixDedup(50).report(none).count() == 0


def test_line_dedup_short_lines(spark):
    rng = random.Random(4)
    some = lambda k: "".join(rng.choice("abcdeé .") for _ in range(k))
    base = [some(rng.randint(1, 34)) for _ in range(60)] + ["", "a", "ab", "x" * 11, "x" * 12, "x" * 13]

    def edited(s):
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(s))
            s = s[:k] + rng.choice(["", "b", "é"]) + s[k + rng.randint(0, 1) :]
        return s

    data = [(i, "\n".join(edited(rng.choice(base)) for _ in range(8))) for i in range(60)]
    got = {r.doc_id: (r.text, r.lines_dropped) for r in every_line().clean(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    seen, want = [], {}
    for d, t in data:
        kept = []
        for line in t.split("\n"):
            least = lambda m: min(len(line), len(m))  # noqa: B023, E731
            near = any(line == m or (least(m) >= 3 and edits(line, m) <= (2 if least(m) >= 12 else 1)) for m in seen)
            if not line or not near:
                kept.append(line)
            seen += [line] if line else []
        want[d] = ("\n".join(kept), len(t.split("\n")) - len(kept))
    assert got == want


def repeats(rows, least=50):
    """Brute force: words in repeated windows, and words in windows that have an
    earlier place."""
    places = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - least + 1):
            places.setdefault(tuple(w[i : i + least]), []).append((d, i))
    every, gone = {}, {}
    for at in places.values():
        for d, i in at if len(at) > 1 else []:
            every.setdefault(d, set()).update(range(i, i + least))
            if (d, i) != min(at):
                gone.setdefault(d, set()).update(range(i, i + least))
    return every, gone


def shared_cores(seed=5):
    """Texts that share 36 to 60 words behind, or before, different others."""
    rng = random.Random(seed)
    some = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    out = []
    for _ in range(6):
        core, leads, tails = some(40), [some(20) for _ in range(4)], [some(20) for _ in range(4)]
        for _ in range(25):
            lead, tail = rng.choice(leads), rng.choice(tails)
            out.append(some(5) + lead[rng.randint(0, 20) :] + core + tail[: rng.randint(0, 20)] + some(5))
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_suffix_dedup_frequent_cores(spark):
    rows = shared_cores()
    every, _ = repeats(rows)
    got = {r.doc_id: r.n_repeated for r in SuffixDedup(50).report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: len(x) for d, x in every.items()}


def test_suffix_dedup_keeps_first_copies(spark):
    rows = shared_cores(6)
    n = len(rows)
    rows += [(n + i, rows[i % 2][1]) for i in range(300)] + [(n + 300, f"{rows[3][1]} {rows[3][1]}"), (n + 301, "x y " * 200)]
    every, gone = repeats(rows)
    got = SuffixDedup(50).report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    whole = lambda ranges: {k for r in ranges for k in range(r.lo, r.hi)}
    assert {r.doc_id: whole(r.passages) for r in got} == every
    assert {r.doc_id: whole(r.gone) for r in got if r.gone} == gone
    assert all(r.n_removed == len(whole(r.gone)) for r in got)


def test_topk(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)]
    data += [(300 + i, data[7][1]) for i in range(150)] + [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (None, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    m, ids = np.array([v for _, v in ok]), np.array([i for i, _ in ok])
    want = set()
    for k in np.flatnonzero(ids % 50 == 0):
        s = m @ m[k]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]][:5]
        want |= {(int(ids[k]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)}
    from pyspark.sql import functions as F

    got = TopKSearch(5, 256, cells=16, few=6, block=64, query_block=4).search(df, F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == want
    assert TopKSearch().search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert TopKSearch().search(df.where("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).count() == 1


def test_topk_of_mixed_sizes(spark):
    from pyspark.sql import functions as F

    data = [(0, [1.0, 2.0]), (50, [1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [2.0, 2.0]), (3, [1.0, 1.0, 1.0]), (4, [])]
    df = spark.createDataFrame([(*r, 9) for r in data], "vec_id long, embedding array<double>, block int")
    got = [tuple(r) for r in TopKSearch(5).search(df, F.col("vec_id") % 50 == 0).collect()]
    # only vectors of the commonest size can be compared; repeated ids are candidates of their own
    assert sorted(got) == [(0, 1, 2, 6 * 65536), (0, 2, 1, 98304), (0, 3, 1, 98304)]


def test_suffix_dedup_of_odd_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, text, "c"), (4, text, "c"), (4, text, "c"), (9, "x " + text, "c"), (1, None, "c")], "doc_id long, text string, core string")
    got = {r.doc_id: (r.n_repeated, r.n_removed, r.mate) for r in SuffixDedup(50).report(df).collect()}
    assert got[4][:2] == (60, 0) and got[9] == (60, 60, 4) and len(got) == 3


def test_fingerprints(docs, rows, none):
    maker = Fingerprinter()
    got = {r.doc_id: r for r in maker.edited(docs, maker.fit(docs)).collect()}
    ring = sorted(rows, reverse=True)
    for (d, t, *_), (_, nxt, *_) in zip(ring, ring[1:] + ring[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 2
        edited = t[: len(t) - cut] + nxt[:cut]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    by_text = {}
    for d, t, *_ in rows:
        by_text.setdefault(t or "", set()).add(got[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert maker.edited(none, maker.fit(none)).count() == 0


def brute_prints(texts, maker):
    """I-Match with sets and dictionaries: for each text its terms in each subset."""
    from factloom.llm import textkernel as tk

    sets = [set(words(t, True)) for t in texts]
    counts = {}
    for x in sets:
        for term in x:
            counts[term] = counts.get(term, 0) + 1
    band = {t for t, c in counts.items() if max(2, maker.low * len(texts)) <= c <= max(2, maker.high * len(texts))}
    hashes = {t: int(next(tk.blocks(pa.array([t]))).hash[0]) for t in counts}
    draw = lambda t, k: int(tk.mix(np.array([hashes[t]], np.uint64) ^ np.uint64(maker.seed * 1_000_003 + k * 7_919))[0])
    rates = [r for r in maker.rates for _ in range(maker.each)]
    return [[frozenset(t for t in x & band if draw(t, k + 1) % r == 0) for k, r in enumerate(rates)] + [frozenset(x)] for x in sets], rates


def test_fingerprints_against_sets(spark):
    rows = [(d * d, t) for d, t, *_ in corpus(8)]
    maker = Fingerprinter(low=0.02, high=0.6, rates=(2, 8, 32), each=4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in maker.edited(df, maker.fit(df)).collect()}
    ring = sorted(rows, reverse=True)
    nexts = ring[1:] + ring[:1]
    texts = [t or "" for _, t in ring]
    edited = [t[: len(t) - len(t) // 2] + (n or "")[: len(t) // 2] for t, (_, n) in zip(texts, nexts, strict=True)]
    prints, rates = brute_prints(texts, maker)
    assert any(any(p[:-1]) for p in prints)
    for (d, _), p, q in zip(ring, prints, prints[1:] + prints[:1], strict=True):
        parts = [got[d].fingerprint[k : k + 8] for k in range(0, len(got[d].fingerprint), 8)]
        assert [x == "00000000" for x in parts] == [not x for x in p]  # empty subsets, and no others, are 0
        held = [k for k in range(len(rates)) if p[k] or q[k]]
        same = sum(rates[k] for k in held if p[k] == q[k])
        assert got[d].near_next == pytest.approx(same / sum(rates[k] for k in held) if held else float(p[-1] == q[-1]))
    by_part = {}
    for (d, _), p in zip(ring, prints, strict=True):  # equal term sets have equal hashes, and only these
        for k, x in enumerate(p):
            by_part.setdefault((k, x), set()).add(got[d].fingerprint[8 * k : 8 * k + 8])
    assert all(len(x) == 1 for x in by_part.values())
    assert len({(k, h) for (k, _), x in by_part.items() for h in x}) == len(by_part)
    known, _ = brute_prints(texts + edited, maker)  # the band is that of the input
    assert all(0 <= got[d].near_edited <= 1 for d in got) and len(known) == 2 * len(texts)


def test_fingerprints_of_odd_rows(spark):
    data = [(None, "a b"), (None, "a b"), (5, "c d"), (5, "a c"), (10**15, "x"), (-7, None), (6, "e" * 3000)]
    df = spark.createDataFrame([(*r, "z") for r in data], "doc_id long, text string, block string")
    maker = Fingerprinter()
    out = maker.edited(df, maker.fit(df)).collect()
    ring = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (d, t), (_, n) in zip(ring, ring[1:] + ring[:1], strict=True):
        t, n = t or "", n or ""
        want.append((d, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.edited_sha256) for r in out), key=str) == sorted(want, key=str)


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = word_bpe()
    model = Tokenizer.from_file(path)
    found = HilbertPacker(path, 256, run_tokens=3000).pack(docs).collect()
    ids = {d: model.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in rows}
    pieces, seqs = {}, {}
    for r in found:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, p in pieces.items():
        assert [s for s, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) == len(ids[d])
    for p in seqs.values():
        p.sort()
        assert [s for s, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 256
    assert set(pieces) == set(ids)
    assert HilbertPacker(path).pack(none).count() == 0


def test_hilbert_neighbours():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)
    assert set(steps) == {1}


def test_language_id(spark, none):
    rng = random.Random(2)
    stock = {"aa": "th he and ing ou", "bb": "eau ion que les é", "cc": "der ung sch ü ein", "dd": "os ñ que ado la"}
    make = lambda k: " ".join("".join(rng.choice(stock[k].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
    data = [(i, make(k), k) for i, k in enumerate(sorted(stock) * 60)]
    data += [(900, None, "aa"), (901, "", None), (902, "12 34 !!", "bb"), (903, make("aa"), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in LanguageIdentifier(sample_rows=30).fit(df.where("doc_id % 5 <> 2")).annotate(df).collect()}
    right = sum(out[i].lang_pred == k for i, _, k in data[:240]) / 240
    assert right > 0.97
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert out[901].lang_score == 0 and all(0 <= r.lang_score <= 1 for r in out.values())
    assert {r.lang_pred for r in LanguageIdentifier().fit(df.limit(0)).annotate(df).collect()} == {"und"}
    assert LanguageIdentifier().fit(none).annotate(none).count() == 0


def test_language_id_keeps_rows(spark):
    data = [(1, "the other thing", "aa", "x"), (1, "the other thing", "aa", "x"), (None, "the", None, "y"), (2, "wo der ung", "bb", "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred string")
    out = LanguageIdentifier().fit(df).annotate(df.withColumn("counts", df["lang"])).collect()
    assert sorted((str(r.doc_id), r.lang_pred, r.counts) for r in out) == [("1", "aa", "aa")] * 2 + [("2", "bb", "bb"), ("None", "aa", None)]
    with pytest.raises(ValueError, match="more than 1 languages"):
        LanguageIdentifier(languages=1).fit(df)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 9, 40])
def test_codewords_differ(n):
    code = codewords(n)
    assert len({tuple(r) for r in code}) == n


def test_mixing(spark, docs, rows, none):
    from pyspark.sql import functions as F

    mix = MixtureBudget({"lang": F.col("lang"), "source": F.col("source")}, {("lang", "en"): 5, ("lang", "fr"): 0}, max_epochs=2, bucket_rows=3)
    got = mix.select(docs, percent=70).collect()
    total = sum(len(words(r[1])) for r in rows) * 70 // 100
    supply = {}
    for _d, t, lang, source, *_ in rows:
        if lang != "fr":
            supply[(lang, source)] = supply.get((lang, source), 0) + 2 * len(words(t))
    taken = sum(r.mix_taken for r in got)
    assert taken == min(total, sum(supply.values()))
    assert all(0 <= r.mix_taken <= r.mix_tokens for r in got) and not any(r.mix_lang == "fr" for r in got)
    per = {}
    for r in got:
        key = (r.lang, r.source)
        per[key] = per.get(key, 0) + r.mix_taken
    assert all(per[k] <= supply[k] for k in per)
    again = mix.select(docs.repartition(5), percent=70).collect()
    assert sorted((r.doc_id, r.mix_epoch, r.mix_taken) for r in got) == sorted((r.doc_id, r.mix_epoch, r.mix_taken) for r in again)
    assert mix.select(none).count() == 0


def test_mixing_leaves_other_columns_alone(spark, rows):
    from pyspark.sql import functions as F

    names = ("epochs", "last", "last_tokens", "n", "budget", "tokens", "part", "at", "bucket", "mix_id")
    df = spark.createDataFrame([(*r[:4], *(f"{k}{r[0]}" for k in names)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{k} string" for k in names))
    mix = MixtureBudget({"lang": F.col("lang")}, {("lang", "en"): 3}, max_epochs=2)
    got = mix.select(df.withColumn("mix_epoch", F.lit("mine")), percent=60)
    assert got.columns == [*df.columns, "mix_lang", "mix_tokens", "mix_epoch", "mix_taken"]
    plain = mix.select(df.select("doc_id", "text", "lang"), percent=60).collect()
    assert sorted((r.doc_id, r.mix_epoch, r.mix_taken) for r in got.collect()) == sorted((r.doc_id, r.mix_epoch, r.mix_taken) for r in plain)
    assert all(r[k] == f"{k}{r.doc_id}" for r in got.collect() for k in names)


def test_mixing_of_repeated_and_null_ids(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b c", "en"), (1, "a b c", "en"), (None, "d e", "en"), (2, "f", None), (3, None, "en")], "doc_id long, text string, lang string")
    got = MixtureBudget({"lang": F.col("lang")}, max_epochs=1).select(df).collect()
    assert sorted((str(r.doc_id), r.text, r.mix_taken) for r in got if r.text) == [("1", "a b c", 3), ("1", "a b c", 3), ("2", "f", 1), ("None", "d e", 2)]


def test_following(spark):
    for keys in ([10, 20, 20, 25, 7, 1000, -3], [5], []):
        got = {r.k: r.next for r in following(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()}
        order = sorted(set(keys))
        assert got == dict(zip(order, [*order[1:], None], strict=True)) if keys else got == {}


def test_chat_query_takes_the_next_conversation_there_is(spark, tmp_path):
    rows = [(10, 0, "user", "q"), (10, 1, "assistant", "ten"), (20, 0, "user", "q"), (20, 1, "assistant", "twenty"), (20, 1, "assistant", "twenty"), (30, 0, "user", "q"), (None, 0, "assistant", "lost")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.pair_id: r for r in QUERIES["op4_chat_format"](spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in out.items()} == {10: "ok", 20: "missing", 30: "missing"}
    assert "twenty" in out[10].rejected and "ten" in out[10].chosen
    df.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert QUERIES["op4_chat_format"](spark, str(tmp_path / "none")).count() == 0


def test_chat_format(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, None, None), (4, 0, "user", "hi")]
    conv = {r.conv: r.turns for r in gathered(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    kind = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, conv[1], conv[2]), (2, conv[1], conv[1]), (3, conv[1], conv[4]), (4, conv[3], None), (5, [], conv[1])], kind)
    out = {r.pair_id: r for r in preference_pairs(pairs).collect()}
    assert [out[k].status for k in (1, 2, 3, 4, 5)] == ["ok", "equal", "no_completion", "missing", "no_completion"]
    one = out[1]
    assert one.prompt == "<|user|>\nhi\n<|end|>\n" and one.prefix_turns == 1
    (span,) = one.chosen_mask
    assert one.chosen[span.start : span.stop] == "yes\n<|end|>\n"
