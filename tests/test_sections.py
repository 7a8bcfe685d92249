"""Hand-made papers for each labelling rule and trap."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import aggregate, ranks, sections

SCHEMA = "corpusid long, text string, sectionheader array<struct<start:long,end:long,attributes:struct<n:string>>>"


def paper(i, *headers, preamble="x\n"):
    text, spans = preamble, []
    for h in headers:
        h, n = h if isinstance(h, tuple) else (h, None)
        spans.append((len(text), len(text) + len(h), (n,)))
        text += f"{h}\nbody\n"
    return i, text, spans


def labels(spark, *papers):
    df = sections.classify(spark.createDataFrame(list(papers), SCHEMA))
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.corpusid, r.start)):
        out.setdefault(r.corpusid, []).append(r.sec_label_extended)
    return out


CASES = {
    "plain": (["1. Introduction", "2. Methods", "3. Results", "4. Conclusion"], ["introduction", "methods", "results", "conclusion"]),
    "singular and plural": (["Results and Discussion", "Results and discussions", "Result and discussion"], ["discussion", "results", "results"]),
    "roman prefix": (["V. Conclusion"], ["conclusion"]),
    "second level": (["3.1. Data"], [None]),
    "spelling": (["Acknowledgments", "Acknowledgement of help"], ["ending", "ending"]),
    "spelling missed": (["Acknowledgments of help"], [None]),
    "bare word": (["Further remarks"], ["conclusion"]),
    "late end matter without core": (["Funding"], ["other"]),
    "absorbed": (["Results", "Funding", "References", "Funding"], ["results", "results", "ending", "other"]),
    "suppressed becomes development": (["Introduction", ("Figure 1", "2."), "Results"], ["introduction", "development", "results"]),
    "development": ([("1. Introduction", None), ("Our Framework", "2"), ("Details", "2.1"), "Results"], ["introduction", "development", "development", "results"]),
    "not development": (["1. Introduction", ("Details", "1.1"), ("Our Framework", "2"), "Results"], ["introduction"] * 3 + ["results"]),
    "roman top level": (["Introduction", "IV. Our Framework"], ["introduction", "development"]),
    "roman with parenthesis": (["Introduction", "IV) Our Framework"], ["introduction", "introduction"]),
    "leading unknown": (["Foo", "Introduction"], [None, "introduction"]),
    "trailing newline is no number": (["Introduction", ("Our Framework", "3\n")], ["introduction", "introduction"]),
}


def test_rules(spark):
    got = labels(spark, *[paper(i, *h) for i, (h, _) in enumerate(CASES.values())])
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert got[i] == want, name


def test_header_at_zero_without_core(spark):
    assert labels(spark, paper(1, "Funding", preamble=""))[1] == [None]


def test_structure(spark):
    text = "🙂 pre\n \tMethods \nbody"
    rows = [
        (1, text, [(6, 16, (None,)), (6, 9, (None,)), (0, 2, (None,))]),
        (2, "abc", [(0, 3, (None,)), (3, 3, (None,)), (9, 12, (None,))]),
        (3, "no headers", []),
        (4, "no headers", None),
        (5, None, [(0, 1, (None,))]),
    ]
    got = sections.header_extraction(spark.createDataFrame(rows, SCHEMA)).orderBy("corpusid", "start").collect()
    assert [(r.corpusid, r.start, r.end_section) for r in got] == [(1, 0, 6), (1, 6, len(text)), (2, 0, 3), (2, 3, 9)]
    assert got[1].extracted == "methods" and got[3].section_text == ""
    one = [r for r in got if r.corpusid == 1]
    assert "".join(r.section_text for r in one) == text


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        sections.validate(spark.createDataFrame([(1,)], "corpusid long"))


def test_filter_edges(spark):
    def rows(i, *shares):
        return [(i, lab, p) for lab, p in shares]

    data = rows(1, ("methods", 50.0)) + rows(2, ("methods", 80.0), ("results", 10.0)) + rows(3, ("methods", 80.1), ("results", 10.0)) + rows(4, ("methods", None), ("results", None))
    df = spark.createDataFrame(data, "corpusid long, sec_label_extended string, perc_of_new_total double")
    assert {r.corpusid for r in aggregate.quality_filter(df).collect()} == {2}
    with pytest.raises(ValueError):
        aggregate.quality_filter(df, cutoff_strategy="other")


def test_no_division_error(spark):
    df = spark.createDataFrame([(1, "figure_table", "abcd", 0, 4), (1, "methods", "", 4, 4)], "corpusid long, sec_label_extended string, section_text string, start long, paper_len long")
    assert {r.perc_of_new_total for r in aggregate.proportions(df).collect()} == {None}


def test_nearest_quantile(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "v double")
    assert tuple(ranks.nearest(df, "v", (0.25, 0.75)).first()) == (20.0, 30.0)


def test_one_exchange(spark):
    """All windows and the aggregation share one hash exchange on the paper."""
    df = sections.classify(spark.createDataFrame([paper(1, "Methods")], SCHEMA), with_text=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sections_tile(spark):
    df = sections.header_extraction(spark.createDataFrame([paper(1, "A", "B", "C")], SCHEMA))
    r = df.agg(F.sum(F.length("section_text")).alias("n"), F.first(F.col("paper_len")).alias("p"), F.min("start").alias("s")).first()
    assert r.n == r.p - r.s


def test_ranks_over_many_bins(spark):
    """Order statistics and cumulative counts as in one sorted list: many values, few values, one value, none."""
    import random

    rng = random.Random(4)
    for values in ([rng.gauss(50, 30) for _ in range(5000)], [float(rng.randrange(5)) for _ in range(300)], [1e9] + [rng.random() for _ in range(500)], [7.0] * 20, [3.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        srt, n = sorted(values), len(values)
        at = (0.0, 0.25, 0.5, 0.77, 1.0)
        assert list(ranks.nearest(df, "v", at).first()) == [srt[int(p * (n - 1) + 0.5)] for p in at]
        want = [srt[int(r)] + (srt[min(int(r) + 1, n - 1)] - srt[int(r)]) * (r - int(r)) for r in (p * (n - 1) for p in at)]
        assert all(abs(a - b) < 1e-6 for a, b in zip(ranks.linear(df, "v", at).first().q, want, strict=True))
        assert {r.v: r.upto for r in ranks.cumulative(df, "v").collect()} == {v: k + 1 for k, v in enumerate(srt)}
    none = spark.createDataFrame([], "v double")
    assert ranks.linear(none, "v", (0.5,)).first().q is None and ranks.nearest(none, "v", (0.5,)).first().q0 is None


def test_null_text_has_no_sections(spark):
    df = spark.createDataFrame([(1, None, [(0, 3, (None,))]), paper(2, "1. Introduction")], SCHEMA)
    assert {r.corpusid for r in sections.classify(df).collect()} == {2}


def test_run(spark, tmp_path):
    """A folder of two parts to three outputs, all parameters passed on; a trial run takes the first papers by id."""
    from marginalia.plans.run import run

    papers = [paper(i, "1. Introduction", "2. Methods", "3. Results", "References") for i in range(6)] + [paper(9, "1. Introduction")]
    spark.createDataFrame(papers, SCHEMA).repartition(2).write.parquet(str(tmp_path / "in"))
    out = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), max_section_perc=90.0, max_rows=10)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["aggregated.parquet", "classified.parquet", "filtered.parquet"]
    assert out["classified"].count() == 25 and out["aggregated"].count() == 25 and out["filtered"].count() == 18
    assert {r.corpusid for r in out["filtered"].collect()} == set(range(6))
    few = run(spark, str(tmp_path / "in"), str(tmp_path / "few"), n_rows=2, min_sections=4)
    assert {r.corpusid for r in few["classified"].collect()} == {0, 1} and few["filtered"].count() == 0
    again = run(spark, str(tmp_path / "in"), str(tmp_path / "iqr"), cutoff_strategy="iqr", iqr_multiplier=1.0)
    assert again["filtered"].count() == 18
    with pytest.raises(ValueError):
        run(spark, str(tmp_path / "in"), str(tmp_path / "bad"), cutoff_strategy="other")
