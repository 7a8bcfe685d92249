"""The pipeline's stages one by one, each against brute force or the operator's own SQL, and the whole run."""

import duckdb
import pytest
from conftest import WORD
from test_llm_near import classes
from test_llm_repeats import brute_words
from test_llm_tables import brute_leaks

import corpus_pipeline as P
from marginalia.llm import quality as C
from marginalia.llm.queries import OP1_SQL

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage reads and writes."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns(stages):
    assert [a.columns for _, a in stages[:-1]] == [COLUMNS] * 4
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontaminate", "mixture"]


def test_quality(spark, stages):
    before, after = stages[0]
    scores = C.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(map(repr, after.collect())) == sorted(map(repr, before.join(scores.where("predicted = 1").select("doc_id"), "doc_id").select(*COLUMNS).collect()))


def test_near_duplicates(stages):
    before, after = stages[1]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert sorted(r.doc_id for r in after.collect()) == sorted(min(rows[i][0] for i in c) for c in classes(rows))


def test_repeated_passages(stages):
    before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    left = {i: n - gone for i, n, gone, _ in brute_words(rows, 35)}
    got = {r.doc_id: len(WORD.findall(r.text or "")) for r in after.collect()}
    assert got == {i: left[i] for i, t in rows if left[i] or not WORD.findall(t or "")}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_decontaminate(spark, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    bad = {i for i, _ in brute_leaks(rows, items)}
    assert {r.doc_id for r in after.collect()} == {i for i, _ in rows} - bad


def test_mixture(stages):
    before, after = stages[4]
    db = duckdb.connect()
    db.register("documents", before.toPandas())
    want = sorted(tuple(r[:3]) + (round(r[3], 6), r[4]) for r in db.sql(OP1_SQL).fetchall())
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in after.collect()) == want


def test_run(spark, stages):
    assert sorted(map(repr, P.run(spark, SF).collect())) == sorted(map(repr, stages[-1][1].collect()))


def test_awkward(spark, awkward):
    docs = awkward.select(*COLUMNS)
    for _, f in P.STAGES:
        assert f(spark, docs, SF).count() <= docs.count()
        assert f(spark, docs.where("false"), SF).count() == 0
