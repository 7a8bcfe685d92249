"""What a task holds must not grow with the input: no fixed number of parts, files of bounded size, each input computed once."""

import pytest
from pyspark.sql import functions as F

from marginalia import registry
from marginalia.operators import aggregate, batches, evaluation, sections
from marginalia.plans import queries
from marginalia.sources import files

SF = "/root/testdata/sf0.001"


def test_csv_in_bounded_files(spark, tmp_path):
    df = spark.range(0, 100, numPartitions=4).selectExpr("id", "concat('a\n\"', id, '\"') AS t")
    files.write_csv(df, str(tmp_path), max_rows=10)
    parts = list(tmp_path.glob("*.csv"))
    assert len(parts) >= 10 and all(p.read_text().count("a\n") <= 10 for p in parts)
    assert sorted((int(r.id), r.t) for r in files.read_csv(spark, str(tmp_path), ["id", "t"]).collect()) == [(i, f'a\n"{i}"') for i in range(100)]


@pytest.mark.parametrize("name", ["csv_round_trip", "run_outputs", "raw_parts_round_trip", "trial_papers"])
def test_no_fixed_number_of_parts(spark, monkeypatch, name):
    """Neither repartition(n) nor coalesce(n): a part would grow with the input."""
    kind, seen = type(spark.range(1)), []
    for method in ("repartition", "coalesce"):
        monkeypatch.setattr(kind, method, lambda self, n, *cols, f=getattr(kind, method): (seen.append(n) if isinstance(n, int) else None, f(self, n, *cols))[1])
    assert registry.queries()[name](spark, SF).count() > 0
    assert not seen


def exchanges(df):
    return str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning")


def test_agreement_in_one_pass(spark):
    """The ratings are dealt once, by item, however many pairs and options there are; the rest are counts and sums."""
    rows = [(f"i{i % 40}", a, "abc"[(i * k) % 3] if i % 7 else None, kind) for i in range(80) for k, (a, kind) in enumerate([("x", "h"), ("y", "h"), ("m", "l")], 1) if (i + k) % 5]
    r = spark.createDataFrame([*rows, (None, "x", "a", "h"), ("i1", None, "b", "h")], "item string, annotator string, label string, kind string")
    pairs = {"hh": ("h", "h"), "hl": ("h", "l")}
    got = evaluation.pair_alphas(r, pairs, {"A": ("c",), "B": ()})
    assert exchanges(got) == 4
    one = evaluation.pair_alphas(r, {"hl": ("h", "l")}, {"B": ()})
    held = r.where("item is not null").groupBy("item").agg(F.countDistinct("kind").alias("k")).where("k = 2").select("item")
    want = evaluation.alpha(r.join(held, "item")).first()
    row = one.first()
    assert (row.raters, row.units) == (want.raters, want.units) and abs(row.alpha - want.alpha) < 1e-12
    assert {(x.option, x.pair) for x in got.collect()} == {(o, p) for o in "AB" for p in pairs}
    assert exchanges(evaluation.alphas(r, "kind")) == 4


def test_requests_are_computed_once(spark):
    """However often the packer reads them: their rows pass a counter once each."""
    passed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        passed.add(1)
        return x

    df = spark.range(60).selectExpr("id % 7 as corpusid", "id as section_idx", "5L as n_tokens").withColumn("line", seen(F.col("section_idx").cast("string")))
    got = batches.pack(df, limit=20, files=2)
    assert got.columns == [*df.columns, "batch"]
    assert sorted(r.line for r in got.collect()) == sorted(str(i) for i in range(60)) and passed.value == 60


@pytest.mark.parametrize(("name", "times"), [("results_on_requests", 1), ("aligned_f1", 2), ("stable_choice", 2)])
def test_papers_are_computed_once_for_each_use(spark, monkeypatch, name, times):
    """Once for the classifier and once for the places of headers, however many raters and metrics read them."""
    calls, view = [], queries.papers_view
    monkeypatch.setattr(queries, "papers_view", lambda *a: (calls.append(a), view(*a))[1])
    registry.queries()[name](spark, SF)
    assert len(calls) == times


def test_lines_are_parsed_once(spark):
    """The envelope and the answer in it once each, with all fields taken."""
    df = spark.createDataFrame([("{",), (None,)], "line string").select(batches.response(F.col("line")).alias("r")).select("r.*")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2
    assert [tuple(r) for r in df.collect()] == [(None, None, None)] * 2


def test_lengths_without_texts(spark):
    """The same shares as from the joined texts, for offsets that lie beyond the text, before it, or in no order as well."""
    rows = [(1, "1. Methods\nab\u00e9cd\n2. Results\nx", [(0, 10), (17, 27)]), (2, "Results", [(0, 7), (20, 25), (30, 31)]), (3, "", [(0, 0)]), (4, None, [(0, 1)]), (5, "Methods and more", [(-4, 2), (3, 9), (16, 18)])]
    df = spark.createDataFrame([(i, x, [(a, b, (None,)) for a, b in h]) for i, x, h in rows], "corpusid long, text string, sectionheader array<struct<start:long,end:long,attributes:struct<n:string>>>")
    want = aggregate.proportions(aggregate.text_by_label(sections.classify(df))).drop("section_text")
    got = aggregate.proportions(aggregate.length_by_label(sections.classify(df, with_text=False)))
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) != []
