"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its 5-word shingles (words lower-cased, A-Z), each
labelled with how many times it occurred before, so a document's labelled
shingles are all different.  One of ``SKETCHES`` sketches takes, under one hash,
the ``PICKS`` least labelled shingles and hashes them in the order in which they
stand in the text: equal sketches need equal shingles in equal order, which is
what makes the filter sensitive to edit similarity rather than to a bag of
shingles.  Pairs that agree in one sketch or more are candidates; at a
similarity of 0.8 a pair of long texts is missed with probability 6e-7, one of
five shingles, four of them common, with 4e-5.

A candidate is verified by aligning the two sequences within the band that a
similarity of ``threshold`` allows.  As labelled shingles are unique, the best
alignment is the longest increasing run of matched positions.  Similarity is
matches / (n1 + n2 - matches), at most the Jaccard similarity and equal to it
where the common shingles stand in the same order.  Shingles are compared by 32
bits here; in a text of 20,000 words two may look alike, which changes a
similarity by one part in 20,000.

Documents with the same words (by a 64-bit BLAKE2b digest of all of them) are
one node.  Candidates are not all pairs of a
bucket: each bucket's members are first compared with its hub (the member whose
sketches are shared most), and after joining what that links, only members of
different groups that share a bucket are compared; for the members of
buckets larger than ``SMALL`` candidates come from an exact prefix filter, which
misses none.

Defined cases: texts without words (null, empty, blank) are equal to each other;
a text of fewer than five words is one shingle; a text of any length is sketched
whole; rows that repeat are copies; a class is named by its least id (null only
if it has no other), and of rows tied for that the one of least text hash stays;
an empty table gives an empty result; ``drop_near_duplicates`` keeps all other
columns, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _symbols as S
from ._repeats import identified, marks
from ._store import Kept, free_shuffles

SHINGLE = 5
THRESHOLD = 0.8
SKETCHES = 20
PICKS = 3
SMALL = 32

_COUNTS = 1 << 21
_PARTS = 64
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, SKETCHES, dtype=np.uint64)
_TOP = np.uint64(2**64 - 1)


def labelled(codes: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingles of each text in text order, and their offsets."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = np.arange(out[-1]) - out[row] + offsets[row]
    end = np.minimum(start + k, offsets[1:][row])
    code = S.span_hash(S.prefix_sums(codes), start, end)
    if not len(code):
        return code, out
    own = S.mix(code ^ S.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(code), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    at = np.flatnonzero(new)
    nth = np.empty(len(code), np.uint64)
    nth[order] = np.arange(len(code)) - np.repeat(at, np.diff(np.append(at, len(code))))
    return S.mix(code + S.mix(nth)) if nth.any() else S.mix(code + S.mix(np.zeros(1, np.uint64))), out


def sketches(shingles: np.ndarray, offsets: np.ndarray, count: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """(texts, count) signatures; a text without shingles has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, count), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if not len(some):
        return out
    begin, size = offsets[some], np.diff(offsets)[some]
    with np.errstate(over="ignore"):
        for j in range(count):
            v = S.mix(shingles ^ _SEEDS[j])
            places = np.full((len(some), picks), len(v), np.int64)
            for p in range(picks):
                least = np.minimum.reduceat(v, begin)
                hit = np.flatnonzero(v == np.repeat(least, size))
                row = np.searchsorted(begin, hit, "right") - 1
                real = least[row] != _TOP
                places[row[real][::-1], p] = hit[real][::-1]
                v[hit] = _TOP
            places.sort(axis=1)
            ordered = np.append(shingles, np.uint64(0))[places]
            sig = np.full(len(some), _SEEDS[j], np.uint64)
            for p in range(picks):
                sig = S.mix(sig * np.uint64(0x9E3779B97F4A7C15) + ordered[:, p])
            out[some, j] = sig
    return out


_SKETCH = "did long, th long, node long, n int, sigs array<long>, shingles binary, uid long"


def _sketch(batches):
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 33
    for b in batches:
        raw, off = S.flat(b.column("text"))
        for lo, hi in S.runs_of(off):
            w = S.Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True)
            shingles, so = labelled(w.code, w.offsets)
            sigs = sketches(shingles, so)
            words = memoryview(np.ascontiguousarray(w.code)).cast("B")
            digests = [blake2b(words[8 * x : 8 * y], digest_size=8).digest() for x, y in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)]
            node = np.frombuffer(b"".join(digests), np.uint64)
            short = (shingles >> np.uint64(32)).astype(np.uint32)
            body = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((so * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(short))])
            packed = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * SKETCHES), pa.array(sigs.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("did").slice(lo, hi - lo), b.column("th").slice(lo, hi - lo), pa.array(node.view(np.int64)), pa.array(np.diff(so).astype(np.int32)), packed, body, pa.array(np.arange(uid, uid + hi - lo))], names=["did", "th", "node", "n", "sigs", "shingles", "uid"])
            uid += hi - lo


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Do two sequences of distinct symbols align with at least this similarity?"""
    na, nb = len(a), len(b)
    if min(na, nb) < threshold * max(na, nb):
        return False
    need = threshold * (na + nb) / (1 + threshold) - 1e-9
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    at = np.searchsorted(b[ob], a[oa])
    hit = at < nb
    hit[hit] = b[ob][at[hit]] == a[oa][hit]
    if hit.sum() < need:
        return False
    i, j = oa[hit], ob[at[hit]]
    near = np.abs(i - j) <= na + nb - 2 * need  # further off the diagonal no such alignment runs
    i, j = i[near], j[near]
    j = j[np.argsort(i, kind="stable")]
    if len(j) < need:
        return False
    if (np.diff(j) > 0).all():
        return True
    tails: list[int] = []
    for x in j.tolist():
        p = bisect_left(tails, x)
        if p == len(tails):
            tails.append(x)
        else:
            tails[p] = x
    return len(tails) >= need


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            sa, oa = S.flat(b.column("sa"))
            sb, ob = S.flat(b.column("sb"))
            sa, oa, sb, ob = sa.view(np.uint32), oa // 4, sb.view(np.uint32), ob // 4
            ok = [aligned(sa[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]], threshold) for i in range(b.num_rows)]
            t = pa.Table.from_batches([b.select(["a", "b"])]).filter(pa.array(ok, pa.bool_()))
            yield from t.to_batches()

    return run


def components(edges: DataFrame, name: str = "components") -> tuple[DataFrame, Kept]:
    """(node, comp): the least node of each node's component, for nodes with edges.

    Alternates large-star and small-star steps until nothing changes; the tables
    between are written, so a lost executor costs one step.
    """
    now = Kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        both = now.df.union(now.df.select("v", "u"))
        # aggregates are tables before they are joined: so Spark splits the rows of a node with very many links
        least = Kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = Kept(both.where("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        down = Kept(large.df.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.df.join(down.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.df.select("u", F.col("m").alias("v"))).distinct()
        step = Kept(small, name)
        for x in (now, least, large, down):
            x.drop()
        now = step
        state = now.df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    comp = now.df.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return comp.union(now.df.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), now


def near_classes(base: DataFrame, *, threshold: float = THRESHOLD, small: int = SMALL) -> tuple[DataFrame, list[Kept]]:
    """(did, th, node, comp) for each row of ``base`` (see ``identified``): comp names its class."""
    every = Kept(base.select("did", "th", "text").mapInArrow(_sketch, _SKETCH), "near-sketches")
    nodes = every.df.groupBy("node").agg(F.min("uid").alias("uid"))
    reps = Kept(every.df.select("uid", "node", "n", "sigs").join(nodes.select("uid"), "uid", "left_semi").where("n > 0").select("node", "n", F.explode("sigs").alias("sig")), "near-reps")
    # what is joined by bucket or class is a table: so both sides are plain shuffles, and Spark splits a hot one among tasks
    shared = Kept(reps.df.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-shared")
    live = Kept(reps.df.join(shared.df.hint("merge"), "sig"), "near-live")  # one plan at every size
    reps.drop()
    shared.drop()
    free_shuffles(base.sparkSession)
    body = Kept(every.df.select("uid", "node", "shingles").join(nodes.select("uid"), "uid", "left_semi").join(live.df.select("node").distinct(), "node", "left_semi").select("node", "shingles"), "near-bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(body.df.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        return with_a.join(body.df.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(_verify(threshold), "a long, b long")

    def alike(n: str, m: str) -> F.Column:
        return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)

    # first each bucket's members with its hub
    score = live.df.groupBy("node").agg(F.sum("c").alias("score"))
    hubs = Kept(live.df.join(score, "node").groupBy("sig").agg(F.max(F.struct("score", "node", "n")).alias("hub")).select("sig", F.col("hub.node").alias("hub"), F.col("hub.n").alias("m")), "near-hubs")
    stars = live.df.join(hubs.df, "sig").where(F.col("node") != F.col("hub")).where(alike("n", "m"))
    stars = stars.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.first("sig").alias("sig")).select("a", "b")
    first = Kept(verified(stars), "near-stars")
    free_shuffles(base.sparkSession)
    comp, done = components(first.df)

    # then members of different groups that still share a bucket
    open_ = Kept(live.df.join(comp, "node", "left").select("sig", "node", "n", F.coalesce("comp", "node").alias("comp")), "near-open")
    mixed = Kept(open_.df.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig", "size"), "near-mixed")
    level = Kept(open_.df.join(mixed.df, "sig"), "near-level")
    few = level.df.where(F.col("size") <= small)
    other = few.select("sig", F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("comp_b"))
    pairs = few.select("sig", F.col("node").alias("a"), "n", "comp").join(other, "sig").where("comp < comp_b").where(alike("n", "m"))
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.first("sig").alias("sig")).select("a", "b")
    many = Kept(level.df.where(F.col("size") > small).select("node", "comp").distinct(), "near-many")
    free_shuffles(base.sparkSession)
    if not many.df.isEmpty():
        pairs = pairs.union(prefix_pairs(body.df.join(many.df, "node"), threshold))
    second = Kept(verified(pairs.distinct().join(first.df, ["a", "b"], "left_anti")), "near-rest")
    comp, last = components(first.df.union(second.df)) if not second.df.isEmpty() else (comp, done)
    named = Kept(comp, "near-named")
    out = every.df.select("did", "th", "node").join(named.df, "node", "left").select("did", "th", F.coalesce("comp", "node").alias("comp"))
    for x in (live, hubs, body, open_, mixed, level, many, first, second, done, *([last] if last is not done else [])):
        x.drop()
    return out, [every, named]


def prefix_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of different groups whose Jaccard similarity may reach the threshold.

    nodes: (node, shingles, comp).  Shingles are put in one order for all, the
    rarest first.  Of two such sets the longer has a common shingle among its
    first n - t n + 1 and the shorter among its first n - 2t / (1 + t) n + 1,
    where as many must follow as the similarity needs; so no pair is lost, and
    shingles that a large group shares bring none together.  Each shingle flips one
    of 256 bits of its set; two sets differ in at least as many shingles as bits,
    which rules out most pairs that the similarity can't hold for.  Rarity comes from
    counts in a table of fixed size (any order is correct, a good one is fast).  A
    shingle counted once stands in one set only and needs no row.
    """

    def sums(batches):
        slots, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            more, n = np.unique(S.flat(b.column("shingles"))[0].view(np.uint32) % _COUNTS, return_counts=True)
            slots, at = np.unique(np.concatenate([slots, more.astype(np.int64)]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(slots)).astype(np.int64)
        part = slots // (_COUNTS // _PARTS)
        cuts = np.flatnonzero(np.diff(part)) + 1
        body = [x.tobytes() for x in np.split(np.stack([slots, counts], 1), cuts)] if len(slots) else []
        yield pa.RecordBatch.from_arrays([pa.array(part[np.concatenate([[0], cuts])] if len(slots) else part), pa.array(body, pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        pairs = S.flat(table.column("counts"))[0].view(np.int64).reshape(-1, 2)
        size = _COUNTS // _PARTS
        total = np.bincount(pairs[:, 0] - part * size, pairs[:, 1], size).astype(np.int64)
        return pa.table([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    parts = nodes.select("shingles").mapInArrow(sums, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    rarity = np.zeros((_PARTS, _COUNTS // _PARTS), np.float32)
    for r in parts:
        rarity[r["part"]] = np.frombuffer(r["counts"], np.int64)
    rarity = rarity.ravel()

    def prefixes(batches):
        for b in batches:
            data, off = S.flat(b.column("shingles"))
            data, off = data.view(np.uint32), off // 4
            row, n = S.doc_of(off), np.diff(off)
            order = np.lexsort((data, rarity[data % _COUNTS], row))
            at = np.arange(len(data)) - off[:-1][row]
            long = at < (n - np.ceil(threshold * n - 1e-9) + 1)[row]
            use = np.flatnonzero(long & (rarity[data % _COUNTS] > 1)[order])
            short = (at < (n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1)[row])[use]
            r = row[use]
            odd = (np.bincount(row * 256 + (data >> np.uint32(24)), minlength=256 * len(n)) & 1).astype(np.uint8)
            parity = np.packbits(odd).view(np.int64).reshape(-1, 4)[r]
            bits = pa.FixedSizeListArray.from_arrays(pa.array(parity.ravel()), 4).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(data[order][use].astype(np.int64)), b.column("node").take(pa.array(r)), b.column("comp").take(pa.array(r)), pa.array(n[r].astype(np.int32)), pa.array((n[r] - at[use]).astype(np.int32)), pa.array(short), bits], names=["shingle", "node", "comp", "n", "left", "short", "bits"])

    rows = Kept(nodes.select("node", "shingles", "comp").mapInArrow(prefixes, "shingle long, node long, comp long, n int, left int, short boolean, bits array<long>"), "near-prefixes").df
    y = rows.where("short").select("shingle", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("m"), F.col("left").alias("left_b"), F.col("bits").alias("bits_b"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m")) - 1e-9
    pairs = rows.select("shingle", F.col("node").alias("a"), "comp", "n", "left", "bits").join(y, "shingle")
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(4)), F.lit(0))
    pairs = pairs.where("comp <> comp_b and (n > m or (n = m and a > b))").where((F.col("m") >= F.lit(threshold) * F.col("n") - 1e-9) & (F.least("left", "left_b") >= need)).where(apart <= F.col("n") + F.col("m") - 2 * need)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, class_id (the least id of its class) and class_size."""
    base = identified(docs, id_col, text_col)
    comps, kept = near_classes(base, threshold=threshold)
    ids = docs.select(F.xxhash64(F.col(id_col)).alias("did"), F.col(id_col).alias("id")).distinct()
    rows = Kept(comps.join(ids, "did").select("id", "comp"), "near-rows")
    for x in kept:
        x.drop()
    classes = Kept(rows.df.groupBy("comp").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "near-classes")
    out = Kept(rows.df.join(classes.df, "comp").select(F.col("id").alias(id_col), "class_id", "class_size"), "near-result")
    rows.drop()
    classes.drop()
    return out.df


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: that of the least id (null last), all columns as they are."""
    base = identified(docs, id_col, text_col)
    comps, kept = near_classes(base, threshold=threshold)
    ids = docs.select(F.xxhash64(F.col(id_col)).alias("did"), F.col(id_col).alias("id")).distinct()
    best = comps.join(ids, "did").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "th", "did")).alias("best"))
    keep = Kept(best.select("best.did", "best.th"), "near-best").df
    for x in kept:
        x.drop()
    free_shuffles(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    wide = docs.select(*marks(id_col, text_col), row)
    return wide.join(keep, ["did", "th"], "left_semi").groupBy("did", "th").agg(F.first("row").alias("row")).select("row.*")
