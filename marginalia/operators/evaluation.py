"""Consensus of raters, agreement metrics, confusion and Krippendorff's alpha."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V

ITEM = ("paper_id", "section_idx")


def vote_counts(votes: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Votes per (item, label) and their share of the item's votes."""
    n = votes.groupBy(*item, "label").agg(F.count(F.lit(1)).alias("votes"))
    total = F.sum("votes").over(Window.partitionBy(*item))
    return n.withColumn("total", total).withColumn("share", F.col("votes") / F.col("total"))


def unanimous(votes: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Items on whose label all votes agree, with that label."""
    g = votes.groupBy(*item).agg(F.count(F.lit(1)).alias("n_votes"), F.countDistinct("label").alias("kinds"), F.min("label").alias("consensus"))
    return g.where("kinds = 1").drop("kinds")


def majority(votes: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Items with a label that has more than half of the votes."""
    return vote_counts(votes, item).where(F.col("votes") * 2 > F.col("total")).select(*item, F.col("label").alias("consensus"), "votes", "total")


def top_label(votes: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Most voted label of each item; ties to the label first in order."""
    best = F.row_number().over(Window.partitionBy(*item).orderBy(F.desc("votes"), "label"))
    return vote_counts(votes, item).withColumn("rn", best).where("rn = 1").drop("rn")


def latest(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key in the given order."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc() for c in order]))
    return rows.withColumn("rn", rn).where("rn = 1").drop("rn")


def at_least_two(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with more than one of the columns not null."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return rows.where(n > 1)


def without_labels(rows: DataFrame, *columns: str, labels: Sequence[str] = V.UNSUPPORTED) -> DataFrame:
    """Rows where none of the columns is one of the labels; nulls stay."""
    out = rows
    for c in columns:
        out = out.where(~F.coalesce(F.col(c).isin(*labels), F.lit(False)))
    return out


def label_counts(pairs: DataFrame, true: str, pred: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """tp, fp, fn and support per label (and ``by``) in one pass over the pairs, each counted ``weight`` times."""
    each = F.col(weight) if weight else F.lit(1)
    cells = pairs.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, true, pred).agg(F.sum(each).cast("bigint").alias("n"))
    hit = F.col(true) == F.col(pred)
    roles = F.array(
        F.struct(F.col(true).alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(~hit, F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(~hit, F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn")),
    )
    r = cells.select(*by, F.explode(roles).alias("r")).select(*by, "r.*")
    return r.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).withColumn("support", F.col("tp") + F.col("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of label_counts; undefined is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn)).withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))


def averages(counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """macro_f1 over all given labels (absent ones are 0) and weighted_f1 over those with support."""
    s = scores(counts).where(F.col("label").isin(*labels))
    weighted = F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double"))
    return s.groupBy(*by).agg((F.sum("f1") / F.lit(float(len(labels)))).alias("macro_f1"), weighted.alias("weighted_f1"))


def qualified(votes: DataFrame, least_annotator: int = 69, excluded: Sequence[int] = V.EXCLUDED_PAPERS) -> DataFrame:
    """Labelled votes of annotators from ``least_annotator`` on, without the excluded papers."""
    return votes.where((F.col("annotator_id") >= least_annotator) & F.col("label").isNotNull() & ~F.col("paper_id").isin(*excluded))


def aligned_f1(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """label and one F1 column per named pair of label columns; a label that a pair lacks has 0 there."""
    out = None
    for name, (a, b) in pairs.items():
        f1 = scores(label_counts(rows, a, b)).select("label", F.col("f1").alias(name))
        out = f1 if out is None else out.join(f1, "label", "full")
    return out.select("label", *[F.coalesce(name, F.lit(0.0)).alias(name) for name in pairs])


def report(pairs: DataFrame, true: str, pred: str) -> DataFrame:
    """Per-label scores, accuracy, macro and weighted averages as rows."""
    per = scores(label_counts(pairs, true, pred)).select("label", "precision", "recall", "f1", "support", "tp")
    # one row for all labels, a few dozen at most; what the averages need is computed from it
    rows = F.collect_list(F.struct("label", "precision", "recall", "f1", "support")).alias("rows")
    weight = F.sum("support").cast("double")
    names = ("precision", "recall", "f1")
    share = F.try_divide(F.sum("tp").cast("double"), weight)

    def line(label: str, *values: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), *[v.alias(c) for v, c in zip(values, names, strict=True)], F.sum("support").alias("support"))

    ends = F.array(line("accuracy", share, share, share), line("macro avg", *[F.avg(c) for c in names]), line("weighted avg", *[F.try_divide(F.sum(F.col(c) * F.col("support")), weight) for c in names]))
    one = per.agg(rows, ends.alias("ends"))
    return one.select(F.explode(F.concat("rows", "ends")).alias("r")).select("r.*")


def confusion(pairs: DataFrame, true: str, pred: str, labels: Sequence[str], hidden: Sequence[str] = ()) -> DataFrame:
    """One row per true label in the fixed set, one column per predicted label; missing cells 0."""
    shown = [x for x in labels if x not in hidden]
    cells = pairs.where(F.col(true).isNotNull()).groupBy(F.col(true).alias("label")).agg(*[F.sum((F.col(pred) == x).cast("bigint")).alias(x) for x in shown])
    rows = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return rows.join(cells, "label", "left").select("label", *[F.coalesce(x, F.lit(0)).alias(x) for x in shown])


def _alphas(units: DataFrame, by: str) -> DataFrame:
    """``alpha`` for each value of ``by``; units: (by, labels, raters, alike, named): labels of a unit as often as they were given, how many units are alike in these, and how many of them have a name.

    What a unit adds is computed within its row, so sums are all that is shuffled.
    """
    kinds = F.transform(F.array_distinct("labels"), lambda c: F.struct(c.alias("c"), F.size(F.filter("labels", lambda x: x == c)).cast("bigint").alias("n")))
    m = F.size("labels").cast("bigint")
    u = units.select(F.col(by).alias("by"), "alike", "named", F.filter("raters", lambda x: x.isNotNull()).alias("raters"), m.alias("m"), kinds.alias("kinds"))
    s = F.aggregate("kinds", F.lit(0).cast("bigint"), lambda a, k: a + k["n"] * k["n"])
    none = F.lit(None).cast("string")

    def part(what: str, key: Column, n: Column, d: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), key.cast("string").alias("key"), n.cast("bigint").alias("n"), d.cast("double").alias("d"))

    pairable = F.col("m") > 1
    one = F.array(part("unit", none, F.col("named"), F.lit(0.0)), part("pairable", none, F.when(pairable, F.col("m") * F.col("alike")), F.when(pairable, (F.col("m") * F.col("m") - s) / (F.col("m") - 1) * F.col("alike"))))
    parts = F.concat(one, F.transform("raters", lambda x: part("rater", x, F.lit(1), F.lit(0.0))), F.transform(F.filter("kinds", lambda k: pairable), lambda k: part("label", k["c"], k["n"] * F.col("alike"), F.lit(0.0))))
    sums = u.select("by", F.explode(parts).alias("p")).groupBy("by", "p.what", "p.key").agg(F.sum("p.n").alias("n"), F.sum("p.d").alias("d"))

    def of(what: str, x: Column) -> Column:
        return F.when(F.col("what") == what, x)

    g = sums.groupBy("by").agg(
        F.count(of("rater", F.lit(1))).alias("raters"), F.sum(of("unit", F.col("n"))).alias("units"), F.sum(of("pairable", F.col("d"))).alias("d"),
        F.sum(of("pairable", F.col("n"))).alias("total"), F.sum(of("label", F.col("n").cast("double") * F.col("n"))).alias("squares"),
    )
    n = F.col("total").cast("double")
    value = F.when((F.col("raters") >= 2) & (F.col("units") >= 2), 1 - F.try_divide(F.try_divide(F.col("d"), n), F.try_divide(n * n - F.col("squares"), n * (n - 1))))
    return g.select(F.col("by").alias(by), "raters", "units", value.alias("alpha"))


def pair_alphas(ratings: DataFrame, pairs: dict[str, tuple[str, str]], options: dict[str, Sequence[str]]) -> DataFrame:
    """(option, pair, raters, units, alpha) of ratings (item, annotator, label, kind) for each named pair of kinds.

    A pair's items are those that both kinds have rated; for a kind paired with
    itself, those that two of its annotators have rated.  All ratings of these
    items by annotators of the two kinds belong to it.  options: what labels each
    leaves out, after the items have been found.  The ratings of an item meet in
    one row, which all pairs and options share.
    """
    items = ratings.where("item is not null").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("kind", "annotator", "label"))).alias("r"))
    items = items.groupBy("r").agg(F.count(F.lit(1)).alias("alike"))

    def taken(option: str, pair: str) -> Column:
        a, b = pairs[pair]
        mine = F.filter("r", lambda x: x["kind"].isin(a, b))
        what = "annotator" if a == b else "kind"
        rated = F.size(F.array_distinct(F.filter(mine[what], lambda x: x.isNotNull()))) >= 2
        left = F.filter(mine, lambda x: x["label"].isNotNull() & ~x["label"].isin(*options[option]) if options[option] else x["label"].isNotNull())
        return F.struct(F.lit(f"{option}|{pair}").alias("by"), F.when(rated, left).alias("x"))

    each = items.select("alike", F.explode(F.array(*[taken(o, p) for o in options for p in pairs])).alias("t")).where("size(t.x) > 0")
    out = _alphas(each.select("t.by", "alike", F.col("alike").alias("named"), F.col("t.x.label").alias("labels"), F.array_distinct(F.col("t.x.annotator")).alias("raters")), "by")
    return out.select(F.split("by", r"\|")[0].alias("option"), F.split("by", r"\|")[1].alias("pair"), "raters", "units", "alpha")


def alphas(ratings: DataFrame, by: str, unit: str = "item", label: str = "label", rater: str = "annotator") -> DataFrame:
    """``alpha`` for each value of ``by``, in one pass over the ratings."""
    r = ratings.where(F.col(label).isNotNull())
    units = r.groupBy(by, F.col(unit).alias("unit")).agg(F.array_sort(F.collect_list(label)).alias("labels"), F.array_sort(F.collect_set(rater)).alias("raters"))
    return _alphas(units.groupBy(by, "labels", "raters").agg(F.count(F.lit(1)).alias("alike"), F.count("unit").alias("named")), by)


def alpha(ratings: DataFrame, unit: str = "item", label: str = "label", rater: str = "annotator") -> DataFrame:
    """Krippendorff's alpha for nominal labels, long format, as one row.

    Units with one rating do not count; null if there are fewer than two raters
    or two units, or no expected disagreement.
    """
    one = alphas(ratings.withColumn("every", F.lit(0)), "every", unit, label, rater)
    none = {"raters": F.coalesce(F.max("raters"), F.lit(0)), "units": F.coalesce(F.max("units"), F.lit(0)), "alpha": F.max("alpha")}
    return one.agg(*[c.alias(name) for name, c in none.items()])


def long_form(wide: DataFrame, item: Column, raters: dict[str, str]) -> DataFrame:
    """(item, annotator, label) from one column per rater; nulls go."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("annotator"), F.col(c).alias("label")) for name, c in raters.items()]))
    return wide.select(item.alias("item"), rows.alias("r")).select("item", "r.*").where("label is not null")


def common_items(ratings: DataFrame, *raters: str) -> DataFrame:
    """Ratings of the named raters on items that all of them rated."""
    some = ratings.where(F.col("annotator").isin(*raters))
    both = some.groupBy("item").agg(F.countDistinct("annotator").alias("k")).where(F.col("k") == len(raters))
    return some.join(both.select("item"), "item", "left_semi")
