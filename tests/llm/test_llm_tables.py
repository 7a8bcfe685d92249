"""Mixing, exact top-k, URL filters and decontamination: against SQL and brute force."""

import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import WORD
from pyspark.sql import functions as F

from marginalia.llm import decontaminate as D
from marginalia.llm import mix_sources as M
from marginalia.llm import queries as Q
from marginalia.llm import url_filter as U
from marginalia.llm.exact_topk import exact_topk

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    x = float(x)
    return None if math.isnan(x) else round(x, 6)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, want = Q.queries()[name](spark, SF), db.sql(Q.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


# --- mixing ------------------------------------------------------------------------------------


def test_mix_contract(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 80)), "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = M.mix_sources(df).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    total, taken = sum(r.size for r in got), Counter()
    for r in got:
        taken[r.source] += r.taken
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken[s] - t) <= 160 for s, t in targets.items())
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in got)
    again = M.mix_sources(df.repartition(2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def water_filling(sizes, weights=(3, 1, 2)):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (budget - sum(full.values())) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if level * w[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}


def test_targets(spark):
    rng = random.Random(4)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 50, 500, 5000]) for s in ["a", "b", "c", "B", "é", "z", None][: rng.randrange(1, 8)]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in M.targets(df).collect()}
        want = water_filling(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_awkward(spark, awkward):
    got = M.mix_sources(awkward).collect()
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(r.doc_id), len(WORD.findall(r.text or ""))) for r in awkward.collect())
    assert M.mix_sources(awkward.where("false")).count() == 0
    assert {r.taken for r in M.mix_sources(awkward.where("text is null")).collect()} == {0}


def test_mix_with_an_empty_slot_before_the_cut(spark):
    """Few documents leave slots of virtual time empty: the first occupied one behind them is opened."""
    many = [1 + i % 5 for i in range(500)]
    for sizes, kinds in (([50, 1, 49], 1), ([7], 1), ([3, 1000, 2, 5], 1), ([1] * 9, 1), (many, 7)):
        df = spark.createDataFrame([(i, " ".join(["w"] * n), f"s{i % kinds}") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
        db = duckdb.connect()
        db.register("documents", df.toArrow())
        want = sorted((r[0], r[4]) for r in db.sql(Q.oracle_sql()["op1_mix_sources"]).fetchall())
        assert sorted((r.doc_id, r.taken) for r in M.mix_sources(df).collect()) == want


# --- top-k --------------------------------------------------------------------------------------


def brute_topk(rows, k=5, every=50):
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    import marginalia.llm.exact_topk as T

    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(int(i), [round(float(x), 2) for x in rng.normal(size=6)]) for i in rng.choice(5000, 900, replace=False)]
    rows += [(7000, rows[0][1]), (7050, rows[0][1]), (7001, rows[0][1])]  # ties
    bad = [(8000, None), (8050, [1.0, None] * 3), (8100, [float("nan")] * 6), (8150, [float("inf")] * 6), (None, rows[0][1]), (8200, [])]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_topk(df).collect())) == brute_topk(rows)
    monkeypatch.setattr(T, "GROUP_ROWS", 100)
    monkeypatch.setattr(T, "CHUNK_ROWS", 7)
    monkeypatch.setattr(T, "BLOCK", 8)
    assert sorted(map(tuple, exact_topk(df).collect())) == brute_topk(rows)
    few = spark.createDataFrame(rows[:3] + [(0, rows[0][1])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_topk(few).collect())) == brute_topk(rows[:3] + [(0, rows[0][1])])
    assert exact_topk(df.where("false")).count() == 0


def test_topk_repeated_ids_and_other_columns(spark, monkeypatch):
    """Each row of a repeated id is a candidate, its queries are merged; against the SQL."""
    import marginalia.llm.exact_topk as T

    rng = np.random.Generator(np.random.PCG64(5))
    rows = [(int(i), [float(x) for x in rng.normal(size=4)], "a", 1, 2, 3) for i in rng.integers(0, 120, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v int, chunk int, `group` int")
    db = duckdb.connect()
    db.register("embeddings", df.select("vec_id", "embedding").toArrow())
    want = sorted(db.sql(Q.oracle_sql()["op2_exact_topk"]).fetchall())
    monkeypatch.setattr(T, "GROUP_ROWS", 60)
    monkeypatch.setattr(T, "CHUNK_ROWS", 3)
    monkeypatch.setattr(T, "BLOCK", 8)
    assert sorted(map(tuple, exact_topk(df).collect())) == want


def test_topk_large_numbers_stay_exact():
    from marginalia.llm.exact_topk import best_of

    rows = np.array([[2**30, 1], [2**30, 2], [2**30, 3]], np.int64)
    at, who, score = best_of(np.array([1, 2, 3]), rows, np.array([9]), np.array([[2**31, 1]], np.int64), 2)
    assert who.tolist() == [3, 2] and score.tolist() == [2**61 + 3, 2**61 + 2]


# --- urls ---------------------------------------------------------------------------------------

URLS = [
    "http://example.net/en/x", "https://A.Example.NET/en/", "http://a.net", "http://a.net/", "//x", None, "", "http://example.com/de/1?x#y", "http://b.example.com/de",
    "ftp://fr.org/fr/", "http://org/fr/", "http://xorg/fr/", "http://example.net?/en/", "http://notexample.com/de/", "a://b://c/d", "http://é.NET/ü", "http://.net/", "http://a..net/q",
]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate([*URLS, URLS[0]])), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as path", "'z' as rule", "'v' as verdict", "1 as id")
    want = []
    for i, u in enumerate([*URLS, URLS[0]]):
        rest = u[u.index("://") + 3 :] if u and "://" in u else None
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest)) if rest is not None else 0
        host = rest[:cut].translate(LOWER) if rest is not None else ""
        path = rest[cut:].split("?")[0].split("#")[0] if rest is not None else ""
        best = None
        for verdict, rule in U.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        want.append((i, host, path, *(best or (None, "allow"))))
    assert sorted(map(tuple, U.url_filter(df).collect())) == want
    assert sorted(map(tuple, U.url_filter(df, most_bytes=0).collect())) == want
    assert U.url_filter(df.where("false")).count() == 0
    assert {r.verdict for r in U.url_filter(df, []).collect()} == {"allow"}


def test_collisions(tmp_path, monkeypatch):
    """With one digest for all keys the strings alone decide."""
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda x, seed: 5)
    U.write_digests({"a/": "block", "b/": "allow", "c/": "block"}, str(tmp_path / "d"))
    d = U.Digests(str(tmp_path / "d"))
    at = d.find(np.full(4, 5, np.uint64), pa.array(["b/", "x/", "c/", "b/"]))
    assert at[1] == -1 and at[0] == at[3] and not d.block[at[0]] and d.block[at[2]]
    assert d.find(np.array([4], np.uint64), pa.array(["b/"])).tolist() == [-1]


def test_digests_are_the_same_on_both_sides(spark):
    keys = ["net/", "", "é.example/ü", "x" * 100]
    got = [r[0] % 2**64 for r in spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64("k")).collect()]
    assert got == [U.xxhash.xxh64_intdigest(k.encode(), seed=U._SEED) for k in keys]


# --- decontamination ----------------------------------------------------------------------------


def brute_leaks(docs, items, threshold=0.8):
    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    out = {}
    for i, text in docs:
        own = shingles(text)
        for j, item in items:
            want = Counter(shingles(item))
            m = min(sum(want.values()), len(own))
            if not m or not want.keys() & set(own):
                continue
            best = 0.0
            for s in range(len(own) - m + 1):
                w = Counter(own[s : s + m])
                best = max(best, sum((w & want).values()) / sum((w | want).values()))
            if best >= threshold - 1e-12:
                out[i, j] = round(best, 9)
    return out


def test_leaks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    rng, planted = random.Random(6), []
    for n, (_, text) in enumerate(items[:12]):
        w = WORD.findall(text)
        for k in range(n % 4):
            w[(k * 17 + n) % len(w)] = "changed"
        planted.append((10_000 + n, " ".join([f"x{rng.random()}" for _ in range(30)] + w + [f"y{rng.random()}" for _ in range(30)])))
        planted.append((20_000 + n, " ".join(w[: len(w) * 9 // 10])))
    rows = rows + planted
    got = D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    want = brute_leaks(rows, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want
    assert len([k for k in want if k[0] >= 10_000]) >= 6
    kept = D.drop_leaking(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_leaks_in_blocks(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = bench.select(F.col("item_id").alias("doc_id"), "text")
    whole = sorted(map(tuple, D.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 4000)
    assert sorted(map(tuple, D.find_leaks(docs, bench).collect())) == whole and len(whole) >= bench.count()


def test_leaks_awkward(spark, awkward):
    bench = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "w5 w6 w7 w8 w9 w10 w11"), (4, "W5 w6 w7 w8 w9 w10 w11"), (None, "w20 w21 w22 w23 w24 w25")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.find_leaks(awkward, bench).collect()), key=repr)
    assert got == sorted([(d, i) for d in (5, 6) for i in (4, 4, None)], key=repr)
    out = D.drop_leaking(awkward, bench)
    assert out.columns == awkward.columns and out.count() == awkward.count() - 2
    assert D.find_leaks(awkward.where("false"), bench).count() == 0 and D.find_leaks(awkward, bench.where("false")).count() == 0


def test_windows_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(D, "_CELLS", 7)
    items = [(f"w{i} " * 3 + " ".join(f"v{k}" for k in range(20))) for i in range(4)]
    index = D.Items(list(range(4)), items)
    prints = np.array(index.prints, np.uint64)
    x, y = index.near(index.words[0], prints, np.arange(4))
    assert {(a, a) for a in range(4)} <= set(zip(x.tolist(), y.tolist(), strict=True))
    assert set(index.near(index.words[0], prints, np.array([2]))[1].tolist()) == {2}


def test_best_window_ties_go_to_the_first(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f x x x a b c d e f"), (2, "y " * 30_000 + "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.first_word) for r in D.find_leaks(docs, bench).collect()} == {(1, 0), (2, 30_000)}


@pytest.mark.parametrize(("shingles", "repeated"), [(8, 0), (16, 0), (40, 0), (40, 20), (120, 0), (400, 100)])
def test_recall_at_the_threshold(shingles, repeated):
    """Windows of similarity 0.8 exactly, some with shingles that repeat, stay within the radius."""
    rng = np.random.Generator(np.random.PCG64(shingles + repeated))
    lost = 0
    for _ in range(200):
        codes = rng.integers(0, 2**64, shingles, dtype=np.uint64)
        codes[: repeated] = codes[repeated : 2 * repeated] if repeated else codes[:0]
        other = codes.copy()
        k = shingles // 9  # k replaced: similarity (n - k) / (n + k), at least 0.8
        other[rng.choice(shingles, k, replace=False)] = rng.integers(0, 2**64, k, dtype=np.uint64)
        a, b = (D.pack(D.signs(x).astype(np.int64).sum(0)[None])[0] for x in (codes, other))
        lost += int(np.bitwise_count(a ^ b)) > D.RADIUS
    assert lost <= 1


def test_radius_keeps_what_reaches_the_threshold():
    rng = np.random.Generator(np.random.PCG64(9))
    x = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 60, dtype=np.uint64)
    own = D.pack(D.signs(x).astype(np.int64).sum(0)[None])
    far = []
    for _ in range(300):
        y = x.copy()
        y[:6] = rng.integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2)
        far.append(int(np.bitwise_count(own ^ D.pack(D.signs(y).astype(np.int64).sum(0)[None]))[0]))
    assert max(far) <= D.RADIUS
