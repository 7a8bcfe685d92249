"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are turned into integer terms, floor(scale * x) per component.  Records
are laid out in document-range blocks (ranges of ids) with each term's maximum
and minimum; for a query the blocks are ordered by the sum of their term bounds
and scored through their forward index until no bound reaches the kth score.

The stated set of queries meets all records in cells: records are dealt to
groups of id ranges and queries to chunks, and each cell is one task of bounded
size.  Every query first meets one group; its kth score there is a floor that
blocks in all other cells must reach.  A last step merges the cells' results.

Defined cases: vectors that are null, empty or hold a null or non-finite
component take no part; rows without an id neither; rows with the query's own id
are no candidates; rows that repeat another id are candidates each (ties are
theirs in any order), and the results of queries that share an id are merged;
vectors of another length than the query's take no part for it; fewer than k
candidates give fewer rows; an empty table gives an empty result; other columns
do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Kept

SCALE = 256.0
K = 5
GROUP_ROWS = 16384
CHUNK_ROWS = 4096
BLOCK = 256

_OUT = "query_id long, vec_id long, score long"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = t.sort_by("id")
    n = t.num_rows
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t.column("id").to_numpy(), flat.reshape(n, -1)


def best_of(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score): each query's k best among rows, sorted by id; ties to smaller ids.

    floor: for each query a score below which nothing is wanted.
    """
    n, q = len(ids), len(query_ids)
    # doubles hold the sums exactly if they cannot pass 2**53
    exact = np.abs(rows).max(initial=0).astype(np.float64) * np.abs(queries).max(initial=0) * rows.shape[1] < 2.0**53
    kind = np.float64 if exact else np.int64
    r, x = rows.astype(kind), queries.astype(kind)
    starts = np.arange(0, n, BLOCK)
    top = np.maximum.reduceat(r, starts, axis=0)
    low = np.minimum.reduceat(r, starts, axis=0)
    bound = np.maximum(x, 0) @ top.T + np.minimum(x, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    score = np.full((q, k), np.iinfo(np.int64).min, np.int64)
    who = np.full((q, k), np.iinfo(np.int64).max, np.int64)
    least = np.full(q, np.iinfo(np.int64).min) if floor is None else floor
    alive = np.arange(q)
    for step in range(len(starts)):
        # a block whose bound equals the kth score may hold a smaller id
        alive = alive[bound[alive, order[alive, step]] >= np.maximum(score[alive, -1], least[alive])]
        if not len(alive):
            break
        for b in np.unique(order[alive, step]):
            now = alive[order[alive, step] == b]
            lo, hi = starts[b], min(n, starts[b] + BLOCK)
            s = (x[now] @ r[lo:hi].T).astype(np.int64)
            own = ids[lo:hi][None] == query_ids[now][:, None]
            cand_s = np.concatenate([score[now], np.where(own, np.iinfo(np.int64).min, s)], 1)
            cand_i = np.concatenate([who[now], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids[lo:hi], s.shape))], 1)
            pick = np.lexsort((cand_i, -cand_s.astype(np.float64) if exact else ~cand_s), axis=1)[:, :k]
            score[now] = np.take_along_axis(cand_s, pick, 1)
            who[now] = np.take_along_axis(cand_i, pick, 1)
    at, rank = np.nonzero((who != np.iinfo(np.int64).max) & (score >= least[:, None]))
    return at, who[at, rank], score[at, rank]


def exact_topk(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is divisible by ``every``."""
    ok = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(ok)
    rows = rows.select("id", F.transform("x", lambda v: F.floor(v * F.lit(scale)).cast("long")).alias("v"))
    n = rows.count()
    groups = max(1, -(-n // GROUP_ROWS))
    chunks = max(1, -(-n // every // CHUNK_ROWS))
    rows = rows.withColumn("dim", F.size("v"))
    # id ranges of about equal size: bounds from quantiles of the ids
    cuts = rows.agg(F.percentile_approx("id", [i / groups for i in range(1, groups)], 10000)).first()[0] if groups > 1 else []
    def grouped(batches):
        for b in batches:
            at = np.searchsorted(np.array(cuts, np.int64), b.column("id").to_numpy(zero_copy_only=False))
            yield b.append_column("group", pa.array(at, pa.int32()))

    ranged = rows.mapInArrow(grouped, "id long, v array<long>, dim int, group int")
    candidates = ranged.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "group", "dim", "id", "v")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "dim", "id", "v", F.lit(None).cast("long").alias("floor"))

    def cell(ask: pa.Table, have: pa.Table) -> pa.Table:
        if not ask.num_rows or not have.num_rows:
            return _ARROW.empty_table()
        qi, q = _matrix(ask)
        ids, r = _matrix(have)
        floor = ask.sort_by("id").column("floor").fill_null(np.iinfo(np.int64).min).to_numpy()
        at, who, score = best_of(ids, r, qi, q, k, floor)
        return pa.table([pa.array(qi[at]), pa.array(who), pa.array(score)], schema=_ARROW)

    keys = ("chunk", "group", "dim")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def met(ask: DataFrame, have: DataFrame) -> DataFrame:
        return ask.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInArrow(cell, _OUT)

    home = F.col("group") == F.pmod("chunk", F.lit(groups))
    found = met(asked.where(home), candidates.where(home))
    if groups > 1:
        first = Kept(found, "topk-first").df
        floor = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        rest = asked.where(~home).drop("floor").join(floor, "id", "left").select("chunk", "group", "dim", "id", "v", "floor")
        found = first.unionByName(met(rest, candidates.where(~home)))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
