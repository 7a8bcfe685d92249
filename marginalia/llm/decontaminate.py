"""Benchmark decontamination by SimHash over windows of each item's size.

Texts are words (lower-cased, A-Z) and their 5-word shingles.  Every window of a
document that has as many words as an item and shares a shingle with it gets a
64-bit SimHash of its weighted shingles (a shingle weighs its count).  A
multi-index over eight 8-bit blocks finds the items of that size within Hamming
distance ``RADIUS``: of 24 differing bits some block holds at most three, so
looking up each block value with up to three flips misses none.  What is found
is verified by the exact weighted-shingle similarity, sum of minima over sum of
maxima, at least ``threshold``.  At similarity 0.8 the expected distance is 9.7
with a deviation of 2.9, so the radius lies five deviations out.

Windows that share no shingle with any item have similarity 0 and need no
fingerprint, and a document is compared only with items of which it holds a
shingle.  The items are taken in blocks of about ``BLOCK_BYTES`` of text, one
after the other, so what the driver and each executor hold is bounded however
large the benchmark is; each block is one pass over the documents.

Defined cases: null and empty texts hold nothing; items of fewer than five words
are too short to tell a leak and are left out; a document shorter than an item is
one window; a text of any length is read whole; of a document's windows that
match an item equally well the first is told; repeated rows are each judged;
rows of items with one id are each an item; an empty table on either side gives
no leaks; other columns do not matter, and ``drop_leaking`` keeps them whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _symbols as S
from ._repeats import identified, marks
from ._store import Kept

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 24
BLOCK_BYTES = 8 << 20
_CELLS = 1 << 22  # windows times items that are compared at once

_BITS = np.arange(64, dtype=np.uint64)


def _shingle_codes(w: S.Words) -> tuple[np.ndarray, np.ndarray]:
    """Code of the shingle that starts at each word, and whether it lies in one text."""
    n = len(w.code)
    at = np.arange(max(0, n - SHINGLE + 1))
    code = S.span_hash(S.prefix_sums(w.code), at, at + SHINGLE) if len(at) else np.zeros(0, np.uint64)
    row = S.doc_of(w.offsets)[: len(at)]
    return code, at + SHINGLE <= w.offsets[1:][row] if len(at) else np.zeros(0, bool)


def signs(codes: np.ndarray) -> np.ndarray:
    """(shingles, 64) of -1 and 1."""
    return ((codes[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * np.int8(2) - np.int8(1)


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from (windows, 64) sums."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class Items:
    """The index of one block of items."""

    def __init__(self, ids: list, texts: list[str], radius: int = RADIUS):
        raw, off = S.flat(pa.array(texts, pa.string()))
        w = S.Words(raw, off, lower=True)
        code, _ = _shingle_codes(w)
        self.radius, self.ids, self.words, self.codes, self.counts, self.prints = radius, [], [], [], [], []
        for i, item in enumerate(ids):
            lo, hi = w.offsets[i], w.offsets[i + 1]
            if hi - lo < SHINGLE:
                continue
            c, n = np.unique(code[lo : hi - SHINGLE + 1], return_counts=True)
            self.ids.append(item)
            self.words.append(int(hi - lo))
            self.codes.append(c)
            self.counts.append(n)
            self.prints.append(pack((signs(c).astype(np.int64) * n[:, None]).sum(axis=0)[None])[0])
        every = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.codes)), [len(c) for c in self.codes])
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.every >> np.uint64(42)).astype(np.int64)] = True
        # the multi-index: by size, block and value, the items within three flips
        flips = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None]) <= radius // 8
        self.index = {}
        sizes = np.array(self.words, np.int64)
        for size in np.unique(sizes):
            members = np.flatnonzero(sizes == size)
            prints = np.array([self.prints[i] for i in members], np.uint64)
            blocks = prints.view(np.uint8).reshape(-1, 8)
            self.index[int(size)] = members, prints, [flips[:, blocks[:, b]] for b in range(8)]

    def near(self, size: int, prints: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of this size within the radius, of the items ``among`` (in order)."""
        members, own, tables = self.index[size]
        some = np.flatnonzero(np.isin(members, among))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, _CELLS // max(1, len(some)))
        for lo in range(0, len(prints), step):
            blocks = prints[lo : lo + step].view(np.uint8).reshape(-1, 8)
            hit = np.zeros((len(blocks), len(some)), bool)
            for b in range(8):
                hit |= tables[b][np.ix_(blocks[:, b], some)]
            x, y = np.nonzero(hit)
            ok = np.bitwise_count(prints[lo + x] ^ own[some[y]]) <= self.radius
            found.append((lo + x[ok], members[some[y[ok]]]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def similarity(window: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the counts of a window's and an item's shingles."""
    c, n = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
    shared = np.minimum(n, counts[at])[codes[at] == c].sum()
    return shared / (n.sum() + counts.sum() - shared)


def leaks(text_codes: np.ndarray, hits: np.ndarray, items: np.ndarray, index: Items, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, similarity, first word, words) of the best window for each item one text leaks.

    text_codes: the text's shingles; hits, items: positions in it of shingles of items.
    """
    out, m_text = {}, len(text_codes)
    for size in {index.words[i] for i in items}:
        m = min(size - SHINGLE + 1, m_text)
        p = np.unique(hits[np.isin(items, index.index[size][0])])
        # starts of all windows that hold one of these shingles
        start = np.unique(np.clip((p[:, None] - np.arange(m)).ravel(), 0, m_text - m))
        lo, hi = int(start[0]), int(start[-1]) + m
        sums = np.zeros((hi - lo + 1, 64), np.int32)
        np.cumsum(signs(text_codes[lo:hi]), axis=0, out=sums[1:], dtype=np.int32)
        prints = pack(sums[start - lo + m] - sums[start - lo])
        for x, i in zip(*index.near(size, prints, items), strict=True):
            s = int(start[x])
            sim = similarity(text_codes[s : s + m], index.codes[i], index.counts[i])
            if sim >= threshold - 1e-12 and (i not in out or sim > out[i][0]):
                out[i] = sim, s, m + SHINGLE - 1
    return [(int(i), *v) for i, v in sorted(out.items())]


def _scan(shared, threshold: float, item_type: pa.DataType):
    def run(batches):
        index = shared.value
        for b in batches:
            raw, off = S.flat(b.column("text"))
            rows, found = [], []
            for lo, hi in S.runs_of(off):
                w = S.Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True)
                code, whole = _shingle_codes(w)
                at = np.flatnonzero(index.maybe[(code >> np.uint64(42)).astype(np.int64)] & whole)
                left = np.searchsorted(index.every, code[at])
                right = np.searchsorted(index.every, code[at], "right")
                real = right > left
                at, left, right = at[real], left[real], right[real]
                if not len(at):
                    continue
                row = np.searchsorted(w.offsets, at, "right") - 1
                cuts = np.flatnonzero(np.diff(row)) + 1
                for part in np.split(np.arange(len(at)), cuts):
                    r, size = row[part[0]], right[part] - left[part]
                    items = index.owner[np.concatenate([np.arange(x, y) for x, y in zip(left[part], right[part], strict=True)])]
                    pos = np.repeat(at[part] - w.offsets[r], size)
                    own = code[w.offsets[r] : w.offsets[r + 1] - SHINGLE + 1]
                    for leak in leaks(own, pos, items, index, threshold):
                        rows.append(lo + r)
                        found.append(leak)
            if rows:
                take = pa.array(np.array(rows, np.int64))
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), pa.array([index.ids[x[0]] for x in found], item_type), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64()), b.column("did").take(take), b.column("th").take(take)], names=["id", "item", "similarity", "first_word", "n_words", "did", "th"])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, threshold: float) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    base = identified(docs, id_col, text_col).select("did", "th", "id", "text")
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_BYTES) or 1
    kind = items.schema["item"].dataType
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        index = docs.sparkSession.sparkContext.broadcast(Items([r["item"] for r in rows], [r["text"] for r in rows]))
        del rows
        part = base.mapInArrow(_scan(index, threshold, to_arrow_type(kind)), f"id {base.schema['id'].dataType.simpleString()}, item {kind.simpleString()}, similarity double, first_word long, n_words long, did long, th long")
        if blocks > 1:  # one block after the other, so that driver and executors hold one at a time
            part = Kept(part, "leaks").df
            index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it leaks: ids, similarity, first word and words of the best window."""
    found = _found(docs, benchmark, id_col, text_col, item_id, item_text, threshold)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "similarity", "first_word", "n_words")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that leak an item, all columns as they are."""
    bad = _found(docs, benchmark, id_col, text_col, item_id, item_text, threshold).select("did", "th").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    wide = docs.select(*marks(id_col, text_col), row)
    return wide.join(bad, ["did", "th"], "left_anti").select("row.*")
