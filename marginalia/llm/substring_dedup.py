"""Substring dedup by seed and extend over words.

Seeds are winnowed anchors (the least hash among the 8-word grams of a window);
documents are joined on them.  From its seed each occurrence is extended word by
word, to the right and to the left, together with all others of the seed: those
that go on with the same word stay in one class, and one that is left alone has
come to the end of its matches.  Words are compared as bytes.  Where a left and a
right extension that reach ``width`` words are shared with another occurrence,
the window is repeated; a stretch of such windows is a maximal repeat, kept if it
has at least ``width`` words.  Every occurrence of a repeat is removed, the first
as well, so the result does not depend on an order.  Pieces that are copies of
each other as a whole are recognised by digest and need no extension, and seeds
with very many distinct surroundings are lengthened first; see ``_repeats``.

Defined cases: a null or blank text has no words and stays as it is, words
removed 0.  Texts of any length are treated whole.  Rows that repeat (same or
other id, null ids too) are copies of each other and lose every window.  An
empty table gives an empty result.  Other columns of the input are kept by
``remove_repeated_words`` whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _repeats as R
from . import _symbols as S
from ._store import Kept
from ._symbols import ranked_small

WIDTH = 35
SEEDS = (8, 24)


def words(raw: np.ndarray, off: np.ndarray) -> R.Run:
    """The words of a run of texts; as bytes each is followed by one space."""
    spaced = np.insert(raw, off[1:], 32)
    w = S.Words(spaced, off + np.arange(len(off)))
    space = S._SPACE[spaced]
    keep = ~space
    keep[1:] |= ~space[:-1]
    body = np.where(space, np.uint8(32), spaced)[keep]
    return R.Run(w.code, w.offsets, body, np.concatenate([[0], np.cumsum(w.end - w.start + 1)]))


def numbered(body: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A number for each word of ``body`` (from start[i] to start[i + 1]), equal for equal bytes only."""
    ends = np.append(start, len(body)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _split(classes: np.ndarray, symbol: np.ndarray, inside: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Classes of occurrences after one more symbol; -1 for those outside their text or without company."""
    live = np.flatnonzero(inside & (classes >= 0))
    out = np.full(len(classes), -1, np.int64)
    if len(live):
        _, rank = ranked_small(classes[live] * (int(symbol[live].max()) + 1) + symbol[live])
        shared = np.bincount(rank, weight[live]) > 1
        out[live] = np.where(shared[rank], rank, -1)
    return out


def extend(g: R.Group) -> np.ndarray:
    """One flag for each window of each piece: is it part of a repeat of at least ``width`` words."""
    width, k = g.width, g.k
    w = S.Words(g.body, g.offsets)
    number = numbered(g.body, w.start)
    size = g.n + width - 1
    begin, end = w.offsets[:-1], w.offsets[1:]
    piece = np.repeat(np.arange(len(g.n)), size)
    # where the seed stands: each window's first gram with the anchor's hash
    n = len(w.code)
    at = np.arange(max(0, n - k + 1))
    is_seed = S.span_hash(S.prefix_sums(w.code), at, at + k) == g.key[piece[at]]
    nearest = np.minimum.accumulate(np.where(is_seed, at, n)[::-1])[::-1]
    window = R.ragged(begin, g.n)
    own = np.repeat(np.arange(len(g.n)), g.n)
    seed = nearest[window]
    new = np.ones(len(window), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    p, own, lo, many = seed[first], own[first], window[first], np.diff(np.append(first, len(window)))
    weight = g.times[own]
    _, classes = np.unique(g.key, return_inverse=True)
    right, left = [classes[own]], [classes[own]]
    for e in range(width):
        right.append(_split(right[-1], number[np.minimum(p + e, n - 1)], p + e < end[own], weight))
    for e in range(1, width - k + 1):
        left.append(_split(left[-1], number[np.maximum(p - e, 0)], p - e >= begin[own], weight))
    out = np.zeros(len(window), bool)
    for e in range(width - k + 1):
        there = (p - e >= lo) & (p - e < lo + many)
        both = _split(np.where(there, left[e], -1), np.maximum(right[width - e], 0), there & (right[width - e] >= 0), weight)
        hit = np.flatnonzero(both >= 0)
        out[first[hit] + p[hit] - e - lo[hit]] = True
    return out


_OUT = "n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(width: int, with_text: bool):
    def run(batches):
        for b in batches:
            raw, off = S.flat(b.column("text"))
            spans, ids = b.column("spans"), b.column("id")
            for lo, hi in S.runs_of(off):
                part, o = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                w = S.Words(part, o)
                gone = R.cover_mask(len(w.code), w.offsets[:-1], spans, lo, hi, width)
                before = np.concatenate([[0], np.cumsum(gone)])
                n, removed = np.diff(w.offsets), np.diff(before[w.offsets])
                # keep the bytes of kept words and, where a text goes on, one byte after each as the space
                stay = ~gone
                edge = np.zeros(len(part) + 2, np.int8)
                np.add.at(edge, w.start[stay], 1)
                np.add.at(edge, w.end[stay] + 1, -1)
                keep = np.cumsum(edge, dtype=np.int8)[: len(part)] > 0
                starts = np.zeros(len(part) + 1, bool)
                starts[o[:-1]] = True
                is_word_end = np.zeros(len(part) + 1, bool)
                is_word_end[w.end[stay]] = True
                blank = is_word_end[:-1] & ~starts[:-1] & S._SPACE[part]
                body = np.where(blank, np.uint8(32), part)
                # a text's first byte may stand where the space of the text before would be
                clash = is_word_end[:-1] & starts[:-1]
                if clash.any():
                    inside = np.zeros(len(part) + 2, np.int8)
                    np.add.at(inside, w.start[stay], 1)
                    np.add.at(inside, w.end[stay], -1)
                    keep &= ~clash | (np.cumsum(inside, dtype=np.int8)[: len(part)] > 0)
                body = body[keep]
                upto = np.concatenate([[0], np.cumsum(keep)])[o]
                data = body.tobytes()
                texts = [data[upto[i] : upto[i + 1]].rstrip(b" ") for i in range(hi - lo)]
                digests = [hashlib.sha256(t).hexdigest() for t in texts]
                kept = pa.array([t.decode() for t in texts], pa.string()) if with_text else pa.nulls(hi - lo, pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), pa.array(removed), pa.array(digests, pa.string()), kept], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _ranges(base: DataFrame, width: int, seeds: tuple[int, ...], hot: int) -> Kept:
    return R.repeats(base, width=width, seeds=seeds, symbols=words, leaf=extend, hot=hot, name="words")


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seeds: tuple[int, ...] = SEEDS, hot: int = R.HOT, with_text: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, kept (the text that stays)."""
    base = R.identified(docs, id_col, text_col)
    told = _ranges(base, width, seeds, hot)
    kind = base.schema["id"].dataType.simpleString()
    out = R.covered(base, told.df).select("id", "text", "spans").mapInArrow(_remove(width, with_text), f"id {kind}, {_OUT}")
    return out.withColumnRenamed("id", id_col)


def remove_repeated_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seeds: tuple[int, ...] = SEEDS, hot: int = R.HOT, drop_emptied: bool = False) -> DataFrame:
    """docs, all columns, each text without its repeated passages.

    A text that loses nothing keeps its white space; one that loses words is its
    kept words joined by single spaces.  A text that loses all its words becomes
    empty and the row stays, or goes with ``drop_emptied``; rows that had no
    words stay in any case.
    """
    base = R.identified(docs, id_col, text_col)
    told = _ranges(base, width, seeds, hot)
    all_cols = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    wide = docs.select(*R.marks(id_col, text_col), all_cols)
    joined = R.covered(wide, told.df)
    out = StructType([joined.schema["row"]])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            row = b.column("row")
            text = row.field(at)
            inner = pa.RecordBatch.from_arrays([text, b.column("spans"), text], names=["text", "spans", "id"])
            for o in _remove(width, True)([inner]):
                n = o.num_rows
                part = row.slice(0, n)
                lost = o.column("n_removed").to_numpy() > 0
                stay = ~(lost & (o.column("n_removed").to_numpy() == o.column("n_words").to_numpy())) if drop_emptied else np.ones(n, bool)
                new = pc.if_else(pa.array(lost), o.column("kept"), o.column("id"))
                fields = [row.type.field(i) for i in range(row.type.num_fields)]
                new = pa.StructArray.from_arrays([new if i == at else part.field(i) for i in range(len(fields))], fields=fields)
                yield pa.RecordBatch.from_arrays([new.filter(pa.array(stay))], names=["row"])
                row = row.slice(n)

    return joined.select("row", "spans").mapInArrow(run, out).select("row.*")
