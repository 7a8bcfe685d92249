"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their ids and cued in that
order, round after round.  A document's virtual finish time is its source's
words up to and including it, over the source's target; the mix is all
documents in order of finish time up to the budget.  So at every moment each
source has had its share, and at time 1 each has had its target.

The order within a source is a range partition by hash bucket and a sort inside
each bucket: running sums inside a bucket start at the sum of the buckets before
it, so a source of any size is never in one task.  The cut of the global order
is found likewise, over ranges of virtual time.

Targets: sources by code point, null last, weigh ``weights`` in turn and share
``budget`` times all words; a source's target stops at ``most`` times its size
and the excess is shared by weight among the others until none is above (water
filling, in closed form over the sources in the order in which they fill up).

Defined cases: a null text has size 0; a document of size 0 takes no words; null
sources are one source; rows that repeat are documents of their own; a source
without words has target 0; a text counts whole, however long; of documents with
equal finish times all are taken or none; an empty table gives an empty result;
other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Kept

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Documents in each range of a source's order, about.
RANGE_ROWS = 4096
_WIDE = 10  # bits: so many slots are one wide range of virtual time


def targets(sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("nth", F.row_number().over(order) - 1).withColumn("w", w)
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "nth")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rank", F.row_number().over(fill))
    s = s.withColumn("sizes_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # the level if just the sources before are full; the first that does not fill up at its level sets it for all others
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(budget)) - F.col("sizes_before") * F.lit(float(most))) / F.col("w_left"))
    s = s.withColumn("fills", F.col("source_size") * F.lit(float(most)) <= F.col("level") * F.col("w"))
    s = s.withColumn("at", F.min(F.when(~F.col("fills"), F.struct("rank", "level"))).over(every)["level"])
    target = F.when(F.col("at").isNull(), F.col("source_size") * F.lit(float(most))).otherwise(F.least(F.col("source_size") * F.lit(float(most)), F.col("at") * F.col("w")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """One row per document: id, source, size, source_size, target and taken, the words the mix takes of it."""
    key = F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("h"))
    sized = Kept(rows, "mix-sized")  # the only pass over the texts
    buckets = max(16, min(1 << 24, -(-sized.df.count() // RANGE_ROWS)))
    rows = sized.df.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("long"))
    # where each range of each source begins
    part = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("source").alias("src"), F.col("bucket").alias("bkt"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("begin"))
    want = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, budget=budget, most=most)
    want = part.join(want, F.col("src").eqNullSafe(F.col("source"))).select("src", "bkt", "begin", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run", F.sum("size").over(inside)).join(want, F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("bkt")))
    cued = Kept(rows.select("id", "source", "size", "source_size", "target", (F.col("begin") + F.col("run")).alias("upto")), "mix-cued")
    rows = cued.df
    sized.drop()

    def finish(k: int) -> Column:
        return F.try_divide((F.col("upto") + F.lit(k) * F.col("source_size")).cast("double"), F.col("target"))

    # the last finish time within the budget, in three steps: the wide range of virtual time in which the
    # running sum passes it, the slot inside that range, the place inside that slot
    def slot(v: Column) -> Column:
        return F.floor(F.least(v, F.lit(4.0)) * F.lit(buckets * 4)).cast("long")

    times = rows.where("size > 0").select("size", F.explode(F.array(*[finish(k) for k in range(most)])).alias("v"))
    times = times.withColumn("slot", slot(F.col("v"))).withColumn("wide", F.shiftright("slot", _WIDE))
    start = rows.agg((F.sum("size") * F.lit(float(budget))).alias("budget")).select("budget", F.lit(0).cast("long").alias("before"))

    def passing(of: DataFrame, unit: str, start: DataFrame) -> DataFrame:
        """(budget, before, unit): the first unit within which the sum passes the budget, and the sum ahead of it; no row if none does."""
        sums = of.groupBy(unit).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.orderBy(unit).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        over = sums.join(F.broadcast(start)).where(F.col("before") + F.col("upto") > F.col("budget"))
        return over.groupBy("budget").agg(F.min(F.struct(F.col(unit), (F.col("before") + F.col("upto") - F.col("words")).alias("before"))).alias("at")).select("budget", "at.before", f"at.{unit}")

    wide = passing(times, "wide", start)
    edge = passing(times.join(F.broadcast(wide.select("wide")), "wide", "left_semi"), "slot", wide.select("budget", "before"))
    inner = times.join(F.broadcast(edge), "slot")
    inner = inner.withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("slot").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    inner = inner.where(F.col("sum") <= F.col("budget")).agg(F.max("v").alias("inside"))
    cut = inner.join(F.broadcast(edge.agg(F.max("slot").alias("edge"))))
    fits = [F.col("edge").isNull() | (slot(finish(k)) < F.col("edge")) | F.coalesce(finish(k) <= F.col("inside"), F.lit(False)) for k in range(most)]
    taken = sum((F.when(f, F.col("size")).otherwise(F.lit(0)) for f in fits), F.lit(0))
    out = Kept(rows.join(F.broadcast(cut)).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken")), "mix-taken")
    cued.drop()
    return out.df
