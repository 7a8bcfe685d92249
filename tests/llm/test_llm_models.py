"""Quality classifier, suffix-tree scoring and language identification."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import WORD
from pyspark.sql import functions as F

from marginalia.llm import language_id as L
from marginalia.llm import quality as C
from marginalia.llm import suffix_tree_lm as T

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- quality ------------------------------------------------------------------------------------


def pack(texts):
    parts = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return np.concatenate([*parts, np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def test_gradients():
    net = C.Net(np.random.Generator(np.random.PCG64(1)))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw, off = pack(["some words here " * 20, "", "x", "other text, longer than a chunk " * 30])
    y = np.array([1, 0, 1, 0], np.float64)

    def loss():
        p = net.score(raw, off)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net.gradients(raw, off, y)
    rng = np.random.Generator(np.random.PCG64(2))
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for i in rng.choice(flat.size, min(6, flat.size), replace=False):
            was, e = flat[i], 1e-4
            flat[i] = was + e
            up = loss()
            flat[i] = was - e
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * e) - g.reshape(-1)[i]) < 2e-3, name


def test_features_cover_the_whole_text():
    net = C.Net(np.random.Generator(np.random.PCG64(1)))
    text = "plain words " * 4000
    raw, off = pack([text, text + "ZQ#@!~^%" * 4])
    a, b = net.score(raw, off)
    assert a != b
    alone = [net.score(*pack([t]))[0] for t in (text, text + "ZQ#@!~^%" * 4)]
    assert np.allclose([a, b], alone, atol=1e-5)


def test_forward_by_brute_force():
    """Embedding, filters, chunk maxima, pooling and output, chunk by chunk in plain loops."""
    net = C.Net(np.random.Generator(np.random.PCG64(5)))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for text in ("a", "some words", "x" * 255, "plain words and more " * 60):
        data = text.encode()
        data += bytes(max(C.SPAN - len(data), 0))
        data += bytes((len(data) - C.SPAN) % C.STEP)
        windows = [p["bias"] + sum(p["embed"][data[at + j]] @ p["filters"][j * C.EMBED : (j + 1) * C.EMBED] for j in range(C.SPAN)) for at in range(0, len(data) - C.SPAN + 1, C.STEP)]
        half = C.CHUNK // 2 // C.STEP
        tops = [np.maximum(0, np.max(windows[i : i + half], axis=0)) for i in range(0, len(windows), half)]
        chunks = [np.maximum(a, b) for a, b in zip(tops, [*tops[1:], tops[-1]], strict=True)]  # overlapping chunks of two halves
        f = np.concatenate([np.max(tops, axis=0), np.mean(chunks, axis=0)])
        z = np.tanh(f @ p["hidden"] + p["hidden_bias"]) @ p["out"] + p["out_bias"][0]
        assert abs(net.score(*pack([text]))[0] - 1 / (1 + math.exp(-z))) < 1e-5


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    y = {r.doc_id: r.quality for r in labels.collect()}
    got = C.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    sides = [np.mean([p == t for p, t in held if t == k]) for k in (0, 1)]
    assert min(sides) >= 0.75, sides
    again = {r.doc_id: r.score for r in C.quality_scores(docs.repartition(3), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(C.fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in C.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 1), (99, 1), (None, 1), (7, None), (8, 7)], "doc_id long, quality int")
    got = C.quality_scores(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in C.quality_scores(awkward, labels.where("false")).collect()} == {0.5}
    assert C.quality_scores(awkward.where("false"), labels).count() == 0
    assert C.drop_low_quality(awkward, labels).columns == awkward.columns


# --- language model -----------------------------------------------------------------------------


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def held(i, folds=5):
    return i is not None and zlib.crc32(str(i).encode()) % folds == 1


def base_scores(rows):
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    out = []
    for i, x in rows:
        t = tokens(x)
        out.append((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)))
    return sorted(out, key=repr)


def test_base(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = T.lm_scores(docs.repartition(3)).collect()
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr)
    want = base_scores([tuple(r) for r in docs.collect()])
    assert [m[:5] for m in mine] == [w[:5] for w in want]
    assert all(abs(m[5] - w[5]) < 1e-4 for m, w in zip(mine, want, strict=True))


def test_tree_beats_the_base_on_held_out_texts(spark):
    """The score is the tree's alone."""
    got = T.lm_scores(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").collect()
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n + 0.1


class Slow:
    """The whole model by dictionaries."""

    def __init__(self, texts):
        self.words = Counter(w for t in texts for w in tokens(t))
        self.n, self.kinds = sum(self.words.values()), len(self.words)
        self.spelling = [{} for _ in range(T.SPELL_DEPTH + 1)]
        for w in self.words:
            flat = self.flat(w)
            for i in range(T.SPELL_DEPTH + 1, len(flat)):
                for k in range(T.SPELL_DEPTH + 1):
                    self.spelling[k].setdefault(flat[i - k : i], Counter())[flat[i]] += 1
        self.bytes = {c: f for k in range(1, T.SPELL_DEPTH + 1) for c, f in self.spelling[k].items() if k <= 2 or self.tested(f, self.spelling[k - 1][c[1:]])}
        self.contexts = {}
        for k in range(1, T.ORDER + 1):
            seen = {}
            for t in texts:
                w = [None, *tokens(t)]
                for i in range(k, len(w)):
                    seen.setdefault(tuple(w[i - k : i]), Counter())[w[i]] += 1
            new = {}
            for c, f in seen.items():
                total = sum(f.values())
                if total >= T.MIN_COUNT and sum(n * (math.log(n / total) - math.log(10) * self.word(c[1:], w)) for w, n in f.items()) >= T.GAIN:
                    new[c] = f
            self.contexts |= new

    @staticmethod
    def flat(w):
        return bytes(T.SPELL_DEPTH) + b"\n" + (w or "").encode() + b" "

    @staticmethod
    def tested(f, up):
        n = sum(f.values())
        return n >= T.SPELL_COUNT and sum(c * math.log(c / n / (up[s] / sum(up.values()))) for s, c in f.items()) >= T.SPELL_GAIN

    def byte(self, ctx, s):
        if not ctx:
            zero = self.spelling[0].get(b"", Counter())
            return (zero[s] + 0.5) / (sum(zero.values()) + 128)
        below = self.byte(ctx[1:], s)
        if ctx not in self.bytes:
            return below
        f = self.bytes[ctx]
        beta = max(1.0, 0.8 * len(f))
        return (f[s] + beta * below) / (sum(f.values()) + beta)

    def word(self, ctx, w):
        """log10 probability in the longest suffix state of ctx."""
        while ctx and ctx not in self.contexts:
            ctx = ctx[1:]
        if not ctx:
            flat = self.flat(w)
            spelled = sum(math.log10(self.byte(flat[i - T.SPELL_DEPTH : i], flat[i])) for i in range(T.SPELL_DEPTH + 1, len(flat)))
            if not self.n:
                return spelled
            return math.log10((max(self.words[w] - T.DISCOUNT, 0) + T.DISCOUNT * self.kinds * 10**spelled) / self.n)
        f = self.contexts[ctx]
        return math.log10((max(f[w] - T.DISCOUNT, 0) + T.DISCOUNT * len(f) * 10 ** self.word(ctx[1:], w)) / sum(f.values()))

    def text(self, t):
        w = [None, *tokens(t)]
        return sum(self.word(tuple(w[max(0, i - T.ORDER) : i]), w[i]) for i in range(1, len(w)))


@pytest.mark.parametrize(("share", "least"), [(T.HOT_SHARE, T.HOT_LEAST), (40, 0)])
def test_score_by_a_slow_tree(spark, repetitive, share, least):
    """Retention, smoothing and longest suffix states; also with common contexts split over all shards."""
    prose = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()]
    rows = [(1000 + k if i is not None else None, t) for k, (i, t) in enumerate(repetitive)] + prose + [(5000 + i, t) for i, t in prose[:12]]
    slow = Slow([t for i, t in rows if not held(i)])
    assert sum(len(c) == 2 for c in slow.contexts) > 20 and len(slow.bytes) > 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted((repr(i), round(slow.text(t), 3)) for i, t in rows)
    got = sorted((repr(r.doc_id), r.score) for r in T.lm_scores(df, hot_share=share, hot_least=least).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 2e-3 + 1e-5 * abs(w[1]) for g, w in zip(got, want, strict=True))


def test_states_add_up_to_one(spark):
    """Over all words of a small alphabet's training set and, by their spelling, all others."""
    texts = ["ab ba ab", "ab ba", "ba ab ab ab", "b a ab ba ab"]
    slow = Slow(texts)
    for ctx in [(), (None,), ("ab",), ("ba", "ab")]:
        known = sum(10 ** slow.word(ctx, w) for w in slow.words)
        other = 1 - sum(10 ** slow.word((), w) for w in slow.words)  # what the root leaves to all other words
        scale = 10 ** (slow.word(ctx, "zz") - slow.word((), "zz"))
        assert abs(known + other * scale - 1) < 1e-9
    for ctx in (b"\0\0\0\0\0\n", b"\0\0\0\0\na", b"zzzzzz"):
        assert abs(sum(slow.byte(ctx, s) for s in range(256)) - 1) < 1e-9


def test_spelling_states_are_distributions():
    rng = np.random.Generator(np.random.PCG64(4))
    words = ["".join(rng.choice(list("aabc"), rng.integers(1, 12))) for _ in range(600)]
    raw, off = pack(words)
    g, _ = T.grams(np.diff(off), raw)
    keys, counts = T.add_up(g, np.ones(len(g), np.int64))
    depth, gram, count = T.retained(keys, counts)
    low, ones = T.add_up(keys & np.uint64(0xFFFF), counts)
    tree = T.Tree(np.concatenate([np.ones(len(low), np.int64), depth]), np.concatenate([low, gram]), np.concatenate([ones, count]))
    for ctx in (b"\0\0\0\0\0\n", b"\0\0\0\nab", b"aabcab", b"zzzzzz"):
        high = sum(x << (8 * (T.SPELL_DEPTH - i)) for i, x in enumerate(ctx))
        assert abs((10.0 ** tree.evaluate(np.array([high | s for s in range(256)], np.uint64))).sum() - 1) < 1e-6


def test_packed_arrays_come_back():
    rng = np.random.Generator(np.random.PCG64(1))
    arrays = [np.sort(rng.integers(0, 2**64, 999, dtype=np.uint64)), rng.integers(0, 2**64, 77, dtype=np.uint64), np.zeros(0, np.uint32), rng.random(5).astype(np.float32), np.arange(3)]
    back = T.unpack(T.pack(*arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back, strict=True))


def test_lm_awkward(spark, awkward):
    got = T.lm_scores(awkward).collect()
    want = base_scores([(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got], key=repr) == sorted((w[:5] for w in want), key=repr)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert T.lm_scores(awkward.where("false")).count() == 0
    only = [i for i in range(200) if held(i)][:3]
    none = spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, round(r.score, 3)) for r in T.lm_scores(none).collect()} == {(0, 0, round(-5 * math.log10(256), 3))}


def test_a_text_of_several_chunks(spark):
    """One text of more bytes than a chunk, and one word of a megabyte."""
    long = "abc de " * (T.CHUNK // 6)
    df = spark.createDataFrame([(1, long), (2, "abc de"), (3, "x" * (1 << 20)), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in T.lm_scores(df).collect()}
    assert got[1].n_tokens == len(long.split()) + 1 and got[3].n_tokens == 2
    assert all(np.isfinite(r.score) for r in got.values())


# --- languages ----------------------------------------------------------------------------------


def test_every_language_is_learned(spark):
    """One with a single document among thousands, and one whose texts are all very long."""
    rows = [(i, f"the and of it is {i}", "en") for i in range(3000)] + [(9001, "ja nein vielleicht", "de"), (9002, "och inte " * 5000, "sv")]
    langs, table = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=30)
    assert langs == ["de", "en", "sv"] and np.isfinite(table).all()


def test_language_of_documents(spark):
    """Documents as pages without any declaration or host: the text decides."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pages = docs.selectExpr("doc_id as page_id", "cast(null as string) as url", "concat('<html><body><p>', text, '</p></body></html>') as html", "lang as true_lang")
    want = {r.doc_id: r.lang for r in docs.where("length(text) > 100").collect()}
    got = {r.page_id: r.lang for r in L.identify(pages, docs).collect()}
    assert len(got) == docs.count()
    assert np.mean([got[i] == x for i, x in want.items()]) >= 0.9


def test_fusion_by_brute_force(spark):
    docs, pages = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/pages.parquet")
    langs, table = L.fit(docs)
    import re

    rows = []
    for r in pages.collect():
        host = r.url.split("://", 1)[1] if "://" in r.url else ""
        host = re.match(r"[^/?#]*", host)[0].translate(LOWER)
        said = re.search(L._DECLARED, r.html)
        raw = np.frombuffer(re.sub(L._TAGS, " ", r.html).encode(), np.uint8)
        g, _ = L.trigrams(raw, np.array([0, len(raw)]))
        ll = table[g].astype(np.float64).sum(0) * L.TEMPER
        p = np.exp(ll - ll.max())
        rows.append((r.page_id, host, host.rsplit(".", 1)[-1], said and said[1].lower(), ll, p / p.sum()))
    k, everything = len(langs), sum(r[5] for r in rows)
    all_p = (everything + 1 / k) / (everything.sum() + 1)
    totals = sum(r[5] for r in rows if r[3])
    got = {r.page_id: r for r in L.identify(pages, docs).collect()}
    for i, host, suffix, said, ll, p in rows:
        n = sum(r[5] for r in rows if r[2] == suffix)
        suffix_p = (n + L.SMOOTH_SUFFIX * all_p) / (n.sum() + L.SMOOTH_SUFFIX)
        own = np.maximum(sum(r[5] for r in rows if r[1] == host) - p, 0)
        logs = ll + np.log((own + L.SMOOTH_HOST * suffix_p) / (own.sum() + L.SMOOTH_HOST))
        if said:
            s = sum(r[5] for r in rows if r[3] == said)
            logs = logs + np.log((s + L.SMOOTH_DECLARED * s.sum() / totals.sum()) / (totals + L.SMOOTH_DECLARED))
        q = np.exp(logs - logs.max())
        q /= q.sum()
        assert got[i].lang == langs[int(q.argmax())] and abs(got[i].confidence - q.max()) < 1e-6


def test_language_awkward(spark, awkward):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (2, "", "", None), (None, "http://a.de/", "<html lang=de>", "x"), (3, "nothing", "<html lang='xx'><p>", "x"), (4, "http://a.de", "<p>" + "und der die das " * 30000, "x")], "page_id long, url string, html string, host string")
    docs = spark.createDataFrame([(1, "und der die das ist nicht", "de"), (2, "the and of that is not", "en"), (3, None, "fr"), (4, "text", None), (None, "and the of", "en")], "doc_id long, text string, lang string")
    got = L.identify(pages, docs).collect()
    assert len(got) == 6 and all(r.lang in ("de", "en") for r in got) and {r.lang for r in got if r.page_id == 4} == {"de"}
    assert L.identify(pages.where("false"), docs).count() == 0
    assert {(r.lang, r.confidence) for r in L.identify(pages, docs.where("false")).collect()} == {(None, 0.0)}
