"""Substring dedup (words) and suffix-array dedup (bytes) against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import WORD

from marginalia.llm import _repeats as R
from marginalia.llm import _symbols as S
from marginalia.llm import substring_dedup as W
from marginalia.llm import suffix_dedup as B

SF = "/root/testdata/sf0.001"


def covered(items, counts, width):
    gone = [False] * len(items)
    for i in range(len(items) - width + 1):
        if counts[hash(items[i : i + width])] > 1:
            gone[i : i + width] = [True] * width
    return gone


def brute(rows, width, split, join):
    parts = [split(t or "") for _, t in rows]
    counts = Counter(hash(p[i : i + width]) for p in parts for i in range(len(p) - width + 1))
    out = []
    for (i, _), p in zip(rows, parts, strict=True):
        gone = covered(p, counts, width)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = join([x for x, g in zip(p, gone, strict=True) if not g])
        out.append((i, len(p), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, width):
    return [(i, n, r, h) for i, n, r, _, h in brute(rows, width, lambda t: tuple(WORD.findall(t)), lambda k: " ".join(k).encode())]


def brute_bytes(rows, width):
    return brute(rows, width, lambda t: t.encode(), bytes)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("hot", [1, 3, 4096])
@pytest.mark.parametrize(("width", "seeds"), [(6, (3, 4)), (20, (8,))])
def test_words(spark, repetitive, width, seeds, hot):
    got = W.substring_dedup(frame(spark, repetitive), width=width, seeds=seeds, hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(repetitive, width)


@pytest.mark.parametrize("hot", [1, 3, 4096])
@pytest.mark.parametrize(("width", "seeds"), [(24, (8, 16)), (40, (16,))])
def test_bytes(spark, repetitive, width, seeds, hot):
    got = B.suffix_dedup(frame(spark, repetitive), width=width, seeds=seeds, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(repetitive, width)


def test_production_widths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = W.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(rows, W.WIDTH)
    got = B.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute_bytes(rows, B.WIDTH)
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(r[2] for r in want) > 0


def test_kept_text(spark, repetitive):
    docs = frame(spark, repetitive)
    for r in W.substring_dedup(docs, width=6, seeds=(3,)).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    for r in B.suffix_dedup(docs, width=24, seeds=(8,)).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_awkward(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = W.substring_dedup(awkward).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(rows, W.WIDTH)
    got = B.suffix_dedup(awkward).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, B.WIDTH)
    out = W.remove_repeated_words(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    texts = sorted(repr(r.text) for r in out.collect() if r.doc_id not in (5, 6))
    assert texts == sorted(repr(t) for i, t in rows if i not in (5, 6))
    assert {r.doc_id: r.text for r in out.where("doc_id in (5, 6)").collect()} == {5: "", 6: "tail"}


def test_empty(spark, awkward):
    none = awkward.where("false")
    assert W.substring_dedup(none).count() == 0 and B.suffix_dedup(none).count() == 0 and W.remove_repeated_words(none).count() == 0


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 else b for i in range(n)]


def test_patterns_that_cancel_out_in_polynomial_hashes(spark):
    """Two words of 1,024 bytes that differ at every byte, and two texts of 4,096 words likewise."""
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    raw, off = S.flat(pa.array([f"{one} {two}"]))
    assert len(set(S.Words(raw, off).code.tolist())) == 2
    tail = " ".join(f"t{i}" for i in range(34))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, " ".join(thue_morse(4096, "x", "y"))), (4, " ".join(thue_morse(4096, "y", "x")))]
    got = W.substring_dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = brute_words(rows, W.WIDTH)
    assert sorted(map(tuple, got), key=repr) == want
    assert [r[2] for r in want[:2]] == [0, 0]
    got = B.suffix_dedup(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, B.WIDTH)


def test_same_code_is_not_same_word():
    """What has the same anchor hash is compared by its bytes: pieces put under one key by force."""
    texts = [b"a b c d ", b"a b x d ", b"q a b c ", b"a b c z "]
    body = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    w = S.Words(body, off)
    key = S.span_hash(S.prefix_sums(w.code), np.array([0]), np.array([2]))[0]
    g = R.Group(np.full(4, key), np.ones(4, np.int64), np.full(4, 2), body, off, 3, 2)
    # windows: abc bcd | abx bxd | qab abc | abc bcz; those without the seed "a b" have no place to extend from
    assert W.extend(g)[[0, 2, 4, 5, 6]].tolist() == [True, False, False, True, True]


def test_maximal_repeats(spark):
    """A repeat reaches exactly from its first to its last common word, whoever shares which part."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i, (lo, hi) in enumerate([(0, 60), (0, 40), (10, 60), (5, 39), (20, 54), (30, 60)]):
        before, after = ([f"{s}{i}-{k}" for k in range(rng.randrange(1, 50))] for s in "uv")
        rows.append((i, " ".join(before + common[lo:hi] + after)))
    ranges = {}
    base = R.identified(frame(spark, rows), "doc_id", "text")
    told = R.repeats(base, width=35, seeds=(8,), symbols=W.words, leaf=W.extend)
    ids = {r.did: r.id for r in base.select("did", "id").collect()}
    for r in told.df.collect():
        ranges.setdefault(ids[r.did], set()).update(range(r.start, r.start + r.n))
    at = {i: t.split().index(common[lo]) for (i, t), lo in zip(rows, (0, 0, 10, 5, 20, 30), strict=True)}
    spans = {i: (min(x) - at[i], max(x) + 35 - at[i]) for i, x in ranges.items()}
    assert spans == {0: (0, 60), 1: (0, 40), 2: (0, 50)}  # 34 words, as in the last three, are too few
    got = W.substring_dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(rows, W.WIDTH)


def test_common_prefixes():
    text = b"abcabcabcabd\xffabcabcabcabc\xff" + b"y" * 40 + b"\xff"
    raw = np.frombuffer(text, np.uint8)
    for depth in (5, 8, 20):
        sa = B.suffix_array(raw, depth)
        got = B.common_prefixes(sa, B.words8(raw), depth)
        want = [next((k for k in range(depth) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text)), depth) for a, b in zip(sa[:-1], sa[1:], strict=True)]
        assert got.tolist() == want


def test_very_long_texts(spark):
    """Texts of many chunks: one of few kinds of words, one of a single byte, one of a single word of megabytes."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(400_000))
    rows = [(1, long), (2, "z" * (3 << 20)), (3, "q " * (1 << 20)), (4, long[:3000])]
    got = {r.doc_id: r for r in W.substring_dedup(frame(spark, rows), with_text=False).collect()}
    n = len(long[:3000].split()) - 1  # the last word may be cut
    assert got[2].n_removed == 0 and got[3].n_removed == got[3].n_words and got[4].n_removed in (n, n + 1) and got[1].n_removed == got[4].n_removed
    got = {r.doc_id: r for r in B.suffix_dedup(frame(spark, rows), with_text=False).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed, got[4].n_removed) == (3000, 3 << 20, 2 << 20, 3000)
    assert [got[i].n_spans for i in (1, 2, 3, 4)] == [1, 1, 1, 1]


def test_suffix_array():
    rng = random.Random(1)
    for alphabet in (b"ab", b"abcdef", bytes(range(256))):
        for n in (1, 2, 9, 300):
            text = bytes(rng.choice(alphabet) for _ in range(n)) + b"\xff"
            sa = B.suffix_array(np.frombuffer(text, np.uint8), 512)
            assert sorted(sa.tolist()) == list(range(len(text)))
            ordered = [text[i:] for i in sa]
            assert ordered == sorted(ordered)


def test_periodic_suffix_array():
    text = b"ab" * 200 + b"\xff" + b"a" * 300 + b"\xff"
    sa = B.suffix_array(np.frombuffer(text, np.uint8), 64)
    heads = [text[i : i + 64] for i in sa]
    assert heads == sorted(heads)
