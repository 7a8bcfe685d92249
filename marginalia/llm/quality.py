"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, ``FILTERS`` learned filters run over windows of ``SPAN``
bytes, every ``STEP`` bytes, and are max-pooled over chunks of ``CHUNK`` bytes
that overlap by half and cover the whole document.  The document's features are
each filter's maximum over all chunks and its mean over chunks; one hidden layer
combines them into a probability.  Filters and byte embedding are learned by
back-propagation through the maxima.

Training uses a bounded sample: at most ``SAMPLE`` labelled documents of at most
``SAMPLE_BYTES`` bytes each, the first by a hash of their ids, so the driver
holds a bounded amount at any corpus size and reruns agree.  Scoring reads every
byte of every document.

Defined cases: a null or empty text has no chunk and gets the score of zero
features; labels other than 0 and 1 and labels of unknown documents are left
out; a document with several labels counts with the least; without any label the
score is 0.5; repeated rows get equal scores; an empty table gives an empty
result; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import _symbols as S

SAMPLE = 4000
SAMPLE_BYTES = 1 << 16
EMBED, SPAN, STEP, FILTERS, HIDDEN = 4, 8, 2, 32, 16
CHUNK = 256
_HALF = CHUNK // 2 // STEP  # windows in half a chunk
_BLOCK = 1024  # half chunks that are convolved at once
STEPS = 500
BATCH = 48


class Layout:
    """Texts padded with zero bytes, and their half chunks as ranges of windows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = np.diff(offsets)
        some = n > 0
        size = np.where(some, np.maximum(SPAN, n + n % STEP), 0)
        at = np.cumsum(size) - size
        self.bytes = np.zeros(int(size.sum()) + SPAN, np.uint8)
        row = np.repeat(np.arange(len(n)), n)
        self.bytes[np.arange(len(raw)) - offsets[row] + at[row]] = raw
        windows = np.where(some, (size - SPAN) // STEP + 1, 0)
        self.halves = -(-windows // _HALF)
        self.row_at = np.concatenate([[0], np.cumsum(self.halves)])
        r = np.repeat(np.arange(len(n)), self.halves)
        nth = np.arange(self.row_at[-1]) - self.row_at[r]
        self.begin = at[r] // STEP + nth * _HALF
        self.end = np.minimum(self.begin + _HALF, at[r] // STEP + windows[r])
        self.row = r


class Net:
    def __init__(self, rng: np.random.Generator):
        d = SPAN * EMBED
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "filters": rng.normal(0, 1 / np.sqrt(d), (d, FILTERS)),
            "bias": np.zeros(FILTERS),
            "hidden": rng.normal(0, 1 / np.sqrt(2 * FILTERS), (2 * FILTERS, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN),
            "out": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def halves(self, lay: Layout, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's maximum in each half chunk, and where it is, if asked."""
        top = np.zeros((len(lay.begin), FILTERS), np.float32)
        where = np.zeros((len(lay.begin), FILTERS), np.int64) if places else None
        for lo in range(0, len(lay.begin), _BLOCK):
            hi = min(lo + _BLOCK, len(lay.begin))
            first, last = lay.begin[lo], lay.end[hi - 1]
            e = self.p["embed"][lay.bytes[first * STEP : (last - 1) * STEP + SPAN]]
            x = np.lib.stride_tricks.as_strided(e, (last - first, SPAN * EMBED), (STEP * e.strides[0], e.strides[1]))
            z = x @ self.p["filters"] + self.p["bias"]
            cuts = np.stack([lay.begin[lo:hi], lay.end[lo:hi]], 1).ravel() - first
            top[lo:hi] = np.maximum.reduceat(np.concatenate([z, np.full((1, FILTERS), -np.inf, np.float32)]), cuts, axis=0)[::2]
            if places:
                for i in range(lo, hi):
                    where[i] = lay.begin[i] + z[lay.begin[i] - first : lay.end[i] - first].argmax(axis=0)
        return top, where

    def features(self, lay: Layout, top: np.ndarray) -> tuple[np.ndarray, dict]:
        """Maximum over all and mean over chunks of the activated maxima, per text."""
        act = np.maximum(top, 0)
        n = len(lay.halves)
        some = np.flatnonzero(lay.halves)
        most = np.zeros((n, FILTERS), np.float32)
        mean = np.zeros((n, FILTERS), np.float32)
        nxt = np.arange(len(act)) + 1
        nxt[lay.row_at[some + 1] - 1] -= 1  # the last half chunk of a text stands alone
        pair = np.maximum(act, act[nxt]) if len(act) else act
        if len(some):
            most[some] = np.maximum.reduceat(act, lay.row_at[some], axis=0)
            mean[some] = np.add.reduceat(pair, lay.row_at[some], axis=0) / lay.halves[some, None]
        return np.concatenate([most, mean], 1), {"act": act, "nxt": nxt, "most": most}

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lay = Layout(raw, offsets)
        f, _ = self.features(lay, self.halves(lay)[0])
        h = np.tanh(f @ self.p["hidden"] + self.p["hidden_bias"])
        return 1 / (1 + np.exp(-np.clip((h @ self.p["out"] + self.p["out_bias"][0]).astype(np.float64), -30, 30)))

    def gradients(self, raw: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, lay = self.p, Layout(raw, offsets)
        top, where = self.halves(lay, True)
        f, kept = self.features(lay, top)
        h = np.tanh(f @ p["hidden"] + p["hidden_bias"])
        g = (1 / (1 + np.exp(-np.clip(h @ p["out"] + p["out_bias"][0], -30, 30))) - y).astype(np.float32) / len(y)
        out = {"out": h.T @ g, "out_bias": g.sum()[None]}
        dh = np.outer(g, p["out"]) * (1 - h * h)
        out |= {"hidden": f.T @ dh, "hidden_bias": dh.sum(0)}
        df = dh @ p["hidden"].T
        act, nxt, row = kept["act"], kept["nxt"], lay.row
        best = act == kept["most"][row]
        ties = np.zeros((len(y), FILTERS), np.float32)  # equal maxima share the gradient
        if len(row):
            ties[lay.halves > 0] = np.add.reduceat(best, lay.row_at[:-1][lay.halves > 0], axis=0, dtype=np.float32)
        d = np.where(best, df[row, :FILTERS] / np.maximum(ties, 1)[row], 0)
        share = df[row, FILTERS:] / lay.halves[row, None]
        own = act >= act[nxt]
        d += np.where(own, share, 0)
        cols = np.broadcast_to(np.arange(FILTERS), act.shape)
        np.add.at(d, (np.broadcast_to(nxt[:, None], act.shape)[~own], cols[~own]), share[~own])
        d = np.where(top > 0, d, 0).astype(np.float32)
        out["bias"] = d.sum(0)
        w = np.zeros_like(p["filters"])
        e = np.zeros_like(p["embed"])
        offs = np.arange(SPAN)
        for k in range(FILTERS):
            use = np.flatnonzero(d[:, k])
            if not len(use):
                continue
            got = lay.bytes[where[use, k][:, None] * STEP + offs]
            w[:, k] = d[use, k] @ p["embed"][got].reshape(len(use), -1)
            for j in range(SPAN):
                e += np.outer(np.bincount(got[:, j], d[use, k], 256), p["filters"][j * EMBED : (j + 1) * EMBED, k]).astype(np.float32)
        return out | {"filters": w, "embed": e}


def train(texts: list[str], labels: list[int], steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> Net | None:
    """A network fitted with Adam; None if there is nothing to learn from."""
    if not texts:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Net(rng)
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    y = np.array(labels, np.float32)
    net.p["out_bias"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    order = np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < min(batch, len(raws)):
            order = np.concatenate([order, rng.permutation(len(raws))])
        now, order = order[:batch], order[batch:]
        parts = [raws[i] for i in now]
        grads = net.gradients(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), y[now])
        rate = 0.01 * min(1.0, t / 30) * (1 - t / (steps + 1)) ** 0.5
        for k, g in grads.items():
            g = g + 1e-4 * net.p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, folds: int = 3, held_out: int = 1) -> Net | None:
    """The network learned from a bounded sample of labelled rows outside the held-out fold."""
    seen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    seen = seen.where(fold("id", folds) != held_out).groupBy("id").agg(F.min("y").alias("y"))
    # about twice the sample, thinned out by hash where the rows are, so that no task sends more than its share
    every = max(1, seen.count() // (2 * sample))
    pick = seen.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).join(F.broadcast(pick), "id").groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("y").alias("y")).collect()
    rows.sort(key=lambda r: str(r["id"]))
    return train([r["text"] for r in rows], [r["y"] for r in rows])


def scored(docs: DataFrame, net: Net | None, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs and ``score``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).cast("string").alias("text"))
    out = StructType([packed.schema["row"], StructField("score", DoubleType())])

    def run(batches):
        for b in batches:
            raw, off = S.flat(b.column("text"))
            for lo, hi in S.runs_of(off, 1 << 18):
                s = net.score(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) if net else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, hi - lo), pa.array(s, pa.float64())], names=["row", "score"])

    return packed.mapInArrow(run, out)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per document: id, held_out, score (probability of label 1), predicted."""
    net = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, held_out=held_out)
    out = scored(docs, net, text_col, [id_col]).select("row.*", "score")
    return out.select(id_col, F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """docs whose score is at least ``least``, all columns as they are."""
    net = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    return scored(docs, net, text_col, docs.columns).where(F.col("score") >= least).select("row.*")
