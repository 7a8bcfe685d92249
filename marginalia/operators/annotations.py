"""The annotation store's analytic side: imports, assignment, screening, exports and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, yes_no

# Fixed values.
EDUCATION = ("masters", "phd_in_progress", "phd_completed", "postdoc")
PASS_MARK = 0.7


def import_order(rows: DataFrame, order: str = "line") -> DataFrame:
    """Rows without a blank field, with their index within the paper in order of input."""
    full = rows.where(~(blank("section_text") | blank("extracted")))
    return full.withColumn("section_order", F.row_number().over(Window.partitionBy("paper_id").orderBy(order)) - 1)


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """existing and those of new whose key is not there yet; of equal new keys the first."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    fresh = new.join(existing.select(key), key, "left_anti").withColumn("rn", first).where("rn = 1").drop("rn")
    return existing.unionByName(fresh)


def current(annotations: DataFrame) -> DataFrame:
    """Each annotator's latest submission for a paper, without blank labels."""
    newest = F.max("created_at").over(Window.partitionBy("annotator_id", "paper_id"))
    return annotations.withColumn("newest", newest).where((F.col("created_at") == F.col("newest")) & F.col("label").isNotNull() & ~blank(F.col("label"))).drop("newest")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that break uniqueness."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assignable(papers: DataFrame, assigned: DataFrame, annotations: DataFrame, annotator: int, most: int = 3) -> DataFrame:
    """Papers not assigned to the annotator for which fewer than ``most`` annotators have handed in annotations."""
    taken = annotations.groupBy("paper_id").agg(F.countDistinct("annotator_id").alias("n_annotators"))
    mine = assigned.where(F.col("annotator_id") == annotator).select("paper_id")
    out = papers.join(mine, "paper_id", "left_anti").join(taken, "paper_id", "left")
    return out.withColumn("n_annotators", F.coalesce("n_annotators", F.lit(0))).where(F.col("n_annotators") < most)


def first_open(assigned: DataFrame) -> DataFrame:
    """Each annotator's first paper in order of assignment that is not completed."""
    rn = F.row_number().over(Window.partitionBy("annotator_id").orderBy("assigned_at", "paper_id"))
    return assigned.where("not completed").withColumn("rn", rn).where("rn = 1").select("annotator_id", "paper_id")


def attention(submitted: DataFrame, key: DataFrame, pass_mark: float = PASS_MARK) -> DataFrame:
    """Accuracy of each annotator over the whole answer key; an unanswered section is wrong."""
    size = key.agg(F.count(F.lit(1)).alias("total"))
    right = submitted.join(key.select(F.col("section_id"), F.col("correct_label").alias("label")), ["section_id", "label"], "left_semi")
    n = right.groupBy("annotator_id").agg(F.countDistinct("section_id").alias("correct"))
    every = submitted.select("annotator_id").distinct().join(n, "annotator_id", "left").join(F.broadcast(size))
    accuracy = F.coalesce(F.try_divide(F.coalesce("correct", F.lit(0)).cast("double"), F.col("total").cast("double")), F.lit(0.0))
    return every.select("annotator_id", accuracy.alias("accuracy"), (accuracy >= pass_mark).alias("passed"))


def passes_screening(education: Column, first_language: Column) -> Column:
    return F.coalesce(education.isin(*EDUCATION) & first_language.isin("english"), F.lit(False))


def next_step(screened: Column, checked: Column, attempts: Column, most: int = 2) -> Column:
    """Where an annotator goes from here."""
    return F.when(~screened, "screened_out").when(checked, "annotate").when(attempts >= most, "screened_out").otherwise("attention_check")


def complete(annotations: DataFrame) -> DataFrame:
    """Per (annotator, paper): may it be handed in: all sections labelled, or flagged as another language."""
    g = annotations.groupBy("annotator_id", "paper_id").agg(F.count("label").alias("labelled"), F.count(F.lit(1)).alias("sections"), F.max("is_other_language").alias("other"))
    return g.withColumn("complete", (F.col("labelled") == F.col("sections")) | F.col("other"))


def export(annotations: DataFrame, annotators: DataFrame, sections: DataFrame, paper_id=None, annotator_id=None, ordered: bool = False) -> DataFrame:
    """Annotations with who and where, flags as 'True' or 'False'; optionally of one paper or annotator, and by annotator, paper and section."""
    a = annotations
    if paper_id is not None:
        a = a.where(F.col("paper_id") == paper_id)
    if annotator_id is not None:
        a = a.where(F.col("annotator_id") == annotator_id)
    j = a.join(annotators.select("annotator_id", "prolific_id"), "annotator_id").join(sections.select(F.col("id").alias("section_id"), "section_order", "start_position"), "section_id")
    out = j.select("prolific_id", "paper_id", "section_order", F.col("start_position").alias("start"), "label", yes_no(F.col("is_other_language")).alias("is_other_language"), yes_no(F.col("is_annotator_confused")).alias("is_annotator_confused"), "created_at")
    return out.orderBy("prolific_id", "paper_id", "section_order") if ordered else out


def annotation_counts(papers: DataFrame, assigned: DataFrame) -> DataFrame:
    """papers with n_annotations: how many annotators have completed each; completing one again does not count."""
    done = assigned.where("completed").groupBy("paper_id").agg(F.countDistinct("annotator_id").alias("n_annotations"))
    return papers.join(done, "paper_id", "left").withColumn("n_annotations", F.coalesce("n_annotations", F.lit(0)))


def papers_of(assigned: DataFrame, annotator: int) -> DataFrame:
    """An annotator's papers in order of assignment."""
    return assigned.where(F.col("annotator_id") == annotator).orderBy("assigned_at", "paper_id")


def coverage(papers: DataFrame) -> DataFrame:
    """How many papers have 0, 1, 2 and 3 or more annotations; zeros for an empty table."""
    n = F.col("n_annotations")
    tests = {"none": n == 0, "one": n == 1, "two": n == 2, "three_or_more": n >= 3}
    return papers.agg(*[F.coalesce(F.sum(F.when(t, 1).otherwise(0)), F.lit(0)).alias(f"papers_{k}") for k, t in tests.items()], F.count(F.lit(1)).alias("papers"))


def totals(annotators: DataFrame, assigned: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: annotators, completed assignments, distinct (annotator, paper) pairs and labels given."""
    parts = [
        annotators.agg(F.count(F.lit(1)).alias("annotators")),
        assigned.agg(F.count(F.when(F.col("completed"), 1)).alias("completed_papers"), F.countDistinct("annotator_id", "paper_id").alias("pairs")),
        annotations.agg(F.count("label").alias("labels")),
    ]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))


def recent(annotators: DataFrame, assigned: DataFrame, n: int = 20) -> DataFrame:
    """The newest annotators and how many papers each has completed."""
    done = assigned.where("completed").groupBy("annotator_id").agg(F.countDistinct("paper_id").alias("completed_papers"))
    j = annotators.join(done, "annotator_id", "left").withColumn("completed_papers", F.coalesce("completed_papers", F.lit(0)))
    return j.orderBy(F.desc("created_at"), "annotator_id").limit(n)
