"""The pipeline's stages, each on the rows that the one before it kept."""

import random

import pytest

import corpus_pipeline as cp
from factloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(5)
    stock = {"en": "th he and ing ou er", "fr": "eau ion que les é oi", "de": "der ung sch ü ein"}
    word = lambda k: "".join(rng.choice(stock[k].split()) for _ in range(rng.randint(1, 4)))
    line = lambda k: " ".join(word(k) for _ in range(rng.randint(8, 20)))
    rows = []
    for i in range(90):
        k = ("en", "fr", "de")[i % 3]
        rows.append([i, "\n".join(line(k) for _ in range(rng.randint(2, 8))), k, f"src{i % 5}"])
    footer = "all rights reserved by the makers of these pages"
    for r in rows[::6]:
        r[1] += "\n" + footer
    near = rows[3][1].split(" ")
    for at in range(10, len(near), 25):  # one changed word in each line or two
        near[at] = "changedword"
    rows += [[100, rows[0][1], "en", "src0"], [101, " ".join(near), "en", "src1"], [102, None, None, None], [103, "12 34", "en", None], [104, line("en"), None, "src2"]]
    return [(*r, len(r[1] or "")) for r in rows], footer


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    rows, footer = documents()
    docs, out = spark.createDataFrame(rows, SCHEMA), []
    base = tmp_path_factory.mktemp("stages")
    for name, stage in cp.STAGES:
        path = str(base / name)
        stage(spark, docs, str(base)).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return rows, footer, out


def test_stages_are_named(staged):
    assert [k for k, _ in cp.STAGES] == ["language", "lines", "near_duplicates", "mix", "pack"]
    for df in staged[2][:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_rejects_only_what_has_none(staged):
    rows, _, (first, *_) = staged
    got = {r.doc_id: r for r in first.collect()}
    assert set(got) == {r[0] for r in rows} - {102, 103}
    assert got[104].lang == "en" and all(got[r[0]].text == r[1] for r in rows if r[0] in got)


def test_lines_keep_the_first_copy(staged):
    _, footer, (_, second, *_) = staged
    got = {r.doc_id: r for r in second.collect()}
    assert 100 not in got  # every line of it stands in document 0
    assert sum(footer in r.text.split("\n") for r in got.values()) == 1 and footer in got[0].text
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_near_duplicates_keep_one(staged):
    before, after = (set(r.doc_id for r in df.collect()) for df in staged[2][1:3])
    assert after <= before and set(range(90)) - {100, 101} <= after


def test_mix_draws_whole_documents(staged):
    source = {r.doc_id: r.text for r in staged[2][2].collect()}
    drawn = [(r.doc_id, r.text) for r in staged[2][3].collect()]
    assert drawn and all(source[d] == t for d, t in drawn)
    assert max(sum(d == x for d, _ in drawn) for x in source) <= 2


def test_pack_covers_every_drawn_row(staged):
    drawn, pieces = staged[2][3].count(), staged[2][4].collect()
    assert sum(p.start == 0 for p in pieces) == drawn
    assert all(len(p.ids) == 4 * p.length and p.offset + p.length <= 2048 for p in pieces)


def test_run_applies_all_stages(spark, tmp_path, staged):
    spark.createDataFrame(staged[0], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    keys = ("doc_id", "start", "length", "doc_tokens")
    got = sorted(tuple(r[k] for k in keys) for r in cp.run(spark, str(tmp_path)).collect())
    assert sum(g[1] == 0 for g in got) == sum(p.start == 0 for p in staged[2][4].collect())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
