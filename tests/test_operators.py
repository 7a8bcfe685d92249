"""Metrics against hand-made cases, sources and requests."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import annotations, batches, cutoffs, evaluation, report
from marginalia.sources import files, jdbc
from marginalia.streaming.ingest import classify_stream


def test_alpha(spark):
    same = [(i, r, "ab"[i % 2]) for i in range(4) for r in "xy"]
    df = spark.createDataFrame(same, "item long, annotator string, label string")
    assert evaluation.alpha(df).first().alpha == 1.0
    assert evaluation.alpha(df.where("annotator = 'x'")).first().alpha is None
    # two raters, four units, one disagreement: 1 - (2/8) / ((64 - 34) / 56)
    odd = spark.createDataFrame([*same[:-1], (3, "y", "a")], "item long, annotator string, label string")
    assert abs(evaluation.alpha(odd).first().alpha - (1 - 0.25 / (30 / 56))) < 1e-12


def test_f1(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None)], "t string, p string")
    got = {r.label: r.f1 for r in evaluation.scores(evaluation.label_counts(df, "t", "p")).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"a": 0.666667, "b": 0.666667}
    m = evaluation.averages(evaluation.label_counts(df, "t", "p"), ["a", "b", "c"]).first()
    assert round(m.macro_f1, 6) == round(2 / 3 * 2 / 3, 6) and round(m.weighted_f1, 6) == 0.666667


def test_majority_is_strict(spark):
    v = spark.createDataFrame([(1, 0, x) for x in "aabb"] + [(1, 1, x) for x in "aab"], "paper_id long, section_idx long, label string")
    assert [(r.section_idx, r.consensus) for r in evaluation.majority(v).collect()] == [(1, "a")]


def test_strip_and_lines(spark):
    df = spark.createDataFrame([(" \t x y\n",)], "s string")
    assert df.select(text.strip("s")).first()[0] == "x y"
    df = spark.createDataFrame([("b\\na\n\n0\n b ",)], "s string")
    assert df.select(text.lines(F.col("s"))).first()[0] == ["b", "a"]


def test_decode(spark, tmp_path):
    row = {"corpusid": 1, "externalids": {"doi": "x"}, "content": {"text": "1. Methods\nbody", "annotations": {"sectionheader": json.dumps([{"start": "0", "end": 10, "attributes": {"n": 1}}]), "title": "not json"}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(row) + "\n")
    schema = files.infer_schema(spark, str(tmp_path / "in"))
    got = files.decode_annotations(files.read_raw(spark, str(tmp_path / "in"), schema)).first()
    assert [(h.start, h.end, h.attributes.n) for h in got.sectionheader] == [(0, 10, "1")]
    assert not got.title and got.abstract is None
    classify_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.sec_label_extended for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["methods"]


def test_csv_and_lines(spark, tmp_path):
    df = spark.createDataFrame([('a "b"\nc', 1)], "t string, n int")
    files.write_csv(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), ["t"]).first().t == 'a "b"\nc'
    (tmp_path / "run7").mkdir()
    (tmp_path / "run7" / "x.jsonl").write_text("{}\n")
    assert files.read_json_lines(spark, str(tmp_path), recursive=True).where("line = '{}'").first().run_id == "run7"
    files.write_parquet(spark.range(10).coalesce(1), str(tmp_path / "pq"), max_rows=4)
    assert len(list((tmp_path / "pq").glob("*.parquet"))) == 3


def packed(rows, limit, files):
    """Greedy packing in one loop: {custom_id: file}."""
    out, number, used, before, begun = {}, 0, 0, 0, None
    tokens = {}
    for p, _, n in rows:
        tokens[p] = tokens.get(p, 0) + n
    for paper in sorted(tokens):
        if before // (limit * files) != begun:
            begun, number, used = before // (limit * files), number + 1, 0
        for _, i, n in sorted(r for r in rows if r[0] == paper):
            if used and used + n > limit:
                number, used = number + 1, 0
            used += n
            out[f"{paper}-{i}"] = number
        before += tokens[paper]
    return out


def test_packing(spark, tmp_path):
    """In order of paper and index (10 behind 2), numbered through over the ranges; what is written never passes the limit."""
    import random

    rng = random.Random(2)
    rows = [(p, i, rng.choice([1, 3, 8, 20, 45])) for p in [2, 10, 7, 70_000, 70_001, 200_000, -5] + list(range(300, 340)) for i in range(rng.randrange(1, 15))]
    df = spark.createDataFrame([(p, i, n, f"{p}-{i}", f"{p}-{i} {n}") for p, i, n in rows], "corpusid long, section_idx long, n_tokens long, custom_id string, line string").repartition(4)
    for files_a_range in (1, 3, 1000):
        got = batches.pack(df, 40, files_a_range)
        assert got.columns == [*df.columns, "batch"]
        assert {r.custom_id: r.batch for r in got.collect()} == packed(rows, 40, files_a_range)
    files.write_batches(batches.pack(df, 40, 3), str(tmp_path / "out"))
    folders = {p.name: p for p in (tmp_path / "out").iterdir() if p.is_dir()}
    assert sorted(int(x.removeprefix("batch=")) for x in folders) == list(range(1, len(folders) + 1))
    seen = []
    for folder in folders.values():
        (part,) = folder.glob("*.txt")
        lines = [x.split() for x in part.read_text().splitlines()]
        assert sum(int(n) for _, n in lines) <= 40 or len(lines) == 1
        ids = [tuple(int(x) for x in re.fullmatch(r"(-?\d+)-(\d+)", i).groups()) for i, _ in lines]
        assert ids == sorted(ids)
        seen += ids
    assert sorted(seen) == sorted((p, i) for p, i, _ in rows)
    assert batches.pack(df.where("false")).count() == 0


def test_last_answer_counts(spark):
    def line(i, label, error=None):
        body = {"output": [{"type": "reasoning", "content": []}, {"type": "message", "content": [{"text": json.dumps({"label": label, "confidence": "low"})}]}]}
        return json.dumps({"custom_id": i, "error": error, "response": {"body": body}})

    rows = [(line("1-0", "methods"), "a", 5), (line("1-0", "results"), "b", 1), (line("1-1", "x"), "a", 1), (line("1-1", "y"), "a", 2), (line("1-1", "z", "failed"), "b", 2), ("{", "c", 1)]
    df = spark.createDataFrame(rows, "line string, file string, pos long")
    assert {r.custom_id: r.label for r in batches.answers(df).collect()} == {"1-0": "results", "1-1": "y"}


TOKENIZERS = "/opt/tokenizers"


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabulary files here")
def test_snippets_by_a_vocabulary(spark):
    import sys

    sys.path.insert(0, TOKENIZERS)
    pattern = __import__("__init__").PATTERN
    ranks = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    texts = ["plain words and some more of them", "short", "", None, "é漢字 🙂 " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", batches.bpe_snippet(F.col("t"), ranks, pattern, 4).alias("s"), batches.bpe_tokens(F.col("t"), ranks, pattern).alias("n")).collect()
    for r in got:
        if r.t is None:
            assert r.s is None and r.n == 0
        elif r.n <= 4:
            assert r.s == r.t
        else:
            assert r.t.startswith(r.s.rstrip("\ufffd")) and len(r.s) < len(r.t)
    assert got[0].s == "plain words and some"


def test_parts_are_renamed(spark, tmp_path):
    import gzip

    (tmp_path / "part1.zip").write_bytes(gzip.compress(b'{"a": 1}\n'))
    (tmp_path / "part2.gz").write_bytes(gzip.compress(b'{"a": 2}\n'))
    assert files.rename_parts(spark, str(tmp_path)) == 1
    assert sorted(r.a for r in files.read_raw(spark, str(tmp_path), "a int").collect()) == [1, 2]


def test_order_and_counts_of_the_store(spark):
    assigned = spark.createDataFrame([(1, 5, 2, True), (1, 4, 1, False), (2, 5, 3, True), (1, 5, 9, True)], "annotator_id int, paper_id int, assigned_at int, completed boolean")
    papers = spark.createDataFrame([(4,), (5,), (6,)], "paper_id int")
    assert sorted(map(tuple, annotations.annotation_counts(papers, assigned).collect())) == [(4, 0), (5, 2), (6, 0)]
    assert [r.paper_id for r in annotations.papers_of(assigned, 1).collect()] == [4, 5, 5]
    given = spark.createDataFrame([(a, 6) for a in (7, 8, 9)] + [(7, 4), (7, 4), (8, 4)], "annotator_id int, paper_id int")
    got = annotations.assignable(papers, assigned.where("paper_id = 5"), given, 1)
    assert [tuple(r) for r in got.collect()] == [(4, 2)]  # 5 is the annotator's own, 6 has three
    a = spark.createDataFrame([(2, 9, "2", "x"), (1, 9, "1", "y"), (1, 3, "0", "z")], "annotator_id int, paper_id int, section_id string, label string").selectExpr("*", "false as is_other_language", "cast(null as boolean) as is_annotator_confused", "1 as created_at")
    people = spark.createDataFrame([(1, "b"), (2, "a")], "annotator_id int, prolific_id string")
    places = spark.createDataFrame([("0", 0, 0), ("1", 1, 5), ("2", 2, 9)], "id string, section_order int, start_position int")
    assert [r.label for r in annotations.export(a, people, places, ordered=True).collect()] == ["x", "z", "y"]


def test_response(spark):
    good = {"custom_id": "a", "error": None, "response": {"body": {"output": [{"type": "message", "content": [{"text": '{"label":"methods","confidence":"high"}'}]}]}}}
    df = spark.createDataFrame([(json.dumps(good),), ("{broken",), (json.dumps({"custom_id": "b", "error": "e"}),)], "line string")
    assert [r.x.label for r in df.select(batches.response(F.col("line")).alias("x")).collect()] == ["methods", None, None]


def test_latest_submission(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", 1), (1, 1, 2, "b", 1), (1, 1, 1, "c", 2), (1, 1, 2, " ", 2)], "annotator_id int, paper_id int, section_id int, label string, created_at int")
    assert [r.label for r in annotations.current(df).collect()] == ["c"]


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, f"paper {i}") for i in range(20)], "id long, title string")
    jdbc.write_table(rows, url, "papers", options)
    whole = jdbc.read_table(spark, url, "papers", options)
    assert sorted(map(tuple, whole.collect())) == [(i, f"paper {i}") for i in range(20)]
    parts = jdbc.read_table(spark, url, "papers", options, split=(whole.columns[0], 5, 15, 4))
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 20


def test_report(spark):
    metrics = spark.createDataFrame([(1, 100, 60, 3, 60.0), (2, 100, 90, 2, 90.0), (3, 50, 50, 1, 100.0)], "corpusid long, total_section_length long, longest_section_length long, n_sections long, longest_section_percent double")
    pairs = spark.createDataFrame([(1, "methods", "methods"), (1, "results", "methods"), (2, "results", "results")], "corpusid long, true_label string, pred_label string")
    grid = cutoffs.threshold_grid(cutoffs.thresholds(metrics), metrics, pairs)
    text = report.cutoff_report(metrics, grid)
    assert text.startswith("# Cutoff analysis") and text.count("\n## ") == 5 and "| 3 | 2.000 | 3 |" in text


def test_qualified(spark):
    v = spark.createDataFrame([(86268276, 70, "a"), (1, 68, "a"), (1, 69, None), (1, 69, "b")], "paper_id long, annotator_id long, label string")
    assert [tuple(r) for r in evaluation.qualified(v).collect()] == [(1, 69, "b")]
