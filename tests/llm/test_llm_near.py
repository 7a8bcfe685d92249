"""Near-duplicate classes against all pairs, and the filters on their own."""

import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import WORD

from marginalia.llm import _symbols as S
from marginalia.llm import near_dedup as N
from marginalia.llm._repeats import identified

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sequence(text):
    w = WORD.findall((text or "").translate(LOWER))
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    seen, out = Counter(), []
    for g in grams:
        seen[g] += 1
        out.append((g, seen[g]))
    return out


def alike(a, b, threshold=0.8):
    if not a or not b:
        return not a and not b
    where = {x: i for i, x in enumerate(b)}
    tails = []
    for p in (where[x] for x in a if x in where):
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    return len(tails) >= threshold * (len(a) + len(b) - len(tails)) - 1e-9


def classes(rows):
    """Partition of row numbers into classes, over all pairs."""
    seqs = [sequence(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if min(len(seqs[i]), len(seqs[j])) >= 0.8 * max(len(seqs[i]), len(seqs[j])) and top(i) != top(j) and alike(seqs[i], seqs[j]):
                up[top(i)] = top(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[top(i)].append(i)
    return list(out.values())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def planted():
    """Copies, near copies, chains of edits, unrelated texts with one common passage, reordered texts."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(4000)}"
    rows, common = [], [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.randrange(1, 8)):
            rows.append(edited(rng, base, rng.randrange(0, 5)))
    chain = [word() for _ in range(150)]
    for _ in range(8):
        chain = edited(rng, chain, 2)
        rows.append(chain)
    for _ in range(60):
        rows.append(common + [word() for _ in range(rng.randrange(20, 60))])
    block = [word() for _ in range(80)]
    rows += [block + chain, chain + block]
    rows += [["A", "b"], ["a", "B"], [], ["  "], ["q"] * 50, ["q"] * 54, ["q"] * 90]
    out = [(i, " ".join(w)) for i, w in enumerate(rows)]
    return [*out, (len(out), None), (None, out[0][1]), (3, out[3][1]), (3, out[3][1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def expected(rows):
    out = []
    for c in classes(rows):
        ids = [rows[i][0] for i in c]
        least = min((x for x in ids if x is not None), default=None)
        out += [(x, least, len(c)) for x in ids]
    return sorted(out, key=repr)


def test_planted(spark, planted):
    got = N.near_dedup(frame(spark, planted)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(planted)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = expected(rows)
    assert sorted(map(tuple, N.near_dedup(docs).collect()), key=repr) == want
    assert any(n > 1 for _, _, n in want)


@pytest.mark.parametrize("small", [1, 1000])
def test_both_ways_for_buckets(spark, planted, small):
    """Large buckets go through the exact prefix filter, small ones by their members: the same classes."""
    base = identified(frame(spark, planted), "doc_id", "text")
    comps, _ = N.near_classes(base, small=small)
    got = defaultdict(set)
    for r in comps.collect():
        got[r.comp].add((r.did, r.th))
    keys = {(r.id, r.text): (r.did, r.th) for r in base.collect()}
    want = {frozenset(keys[planted[i]] for i in c) for c in classes(planted)}
    assert {frozenset(x) for x in got.values()} == want


def test_prefix_filter_misses_no_pair(spark, planted):
    seqs = {}
    for i, t in planted:
        s = sequence(t)
        if s and i is not None:
            seqs[i] = np.array(sorted({hash(x) & 0xFFFFFFFF for x in s}), np.uint32)
    df = spark.createDataFrame([(int(i), bytearray(v.tobytes()), int(i)) for i, v in seqs.items()], "node long, shingles binary, comp long")
    got = {(r.a, r.b) for r in N.prefix_pairs(df, 0.8).collect()}
    for i, x in seqs.items():
        for j, y in seqs.items():
            both = len(np.intersect1d(x, y))
            if i < j and both >= 0.8 * (len(x) + len(y) - both):
                assert (i, j) in got


def test_one_of_each_stays(spark, awkward, planted):
    docs = frame(spark, planted)
    left = N.drop_near_duplicates(docs)
    want = sorted(repr(min((rows for rows in (planted[i][0] for i in c) if rows is not None), default=None)) for c in classes(planted))
    assert sorted(repr(r.doc_id) for r in left.collect()) == want
    out = N.drop_near_duplicates(awkward)
    assert out.columns == awkward.columns
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert out.count() == len(classes(rows))


def test_empty(spark, awkward):
    assert N.near_dedup(awkward.where("false")).count() == 0 and N.drop_near_duplicates(awkward.where("false")).count() == 0


def test_sketch_keeps_text_order():
    """The same shingles in another order give other sketches where more than one is picked."""
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    off = np.array([0, 300])
    a, b = N.sketches(x, off)[0], N.sketches(x[::-1].copy(), off)[0]
    assert (a == b).mean() < 0.3
    assert (a == N.sketches(np.concatenate([x, x]), np.array([0, 300, 600]))[1]).all()


def test_alignment():
    a = np.arange(100, dtype=np.uint32)
    assert N.aligned(a, a, 0.8)
    assert not N.aligned(a, a[::-1].copy(), 0.8)
    assert N.aligned(a, np.concatenate([a[10:], a[:10]]), 0.8)
    assert not N.aligned(a, np.concatenate([a[30:], a[:30]]), 0.8)


def test_labels_tell_occurrences_apart():
    codes = np.array([7] * 12, np.uint64)
    x, off = N.labelled(codes, np.array([0, 12]))
    assert off.tolist() == [0, 8] and len(np.unique(x)) == 8
    assert S.doc_of(off).tolist() == [0] * 8
