"""Windows of a fixed width that occur more than once in a corpus, exactly.

Both exact-duplicate operators (word windows and byte windows) reduce to this:
given sequences of symbols, find every window of ``width`` symbols whose content
also starts anywhere else, in the same sequence or another one.

1.  *Winnowed anchors.*  The anchor of a window is the smallest hash among its
    k-grams, so equal windows have equal anchors wherever they stand.
    Consecutive windows with the same anchor form a *piece*.  One pass over the
    corpus writes a row per piece: anchor, place, and a 128-bit BLAKE2b digest
    of the piece's content, which stands for the content from here on.
2.  *Join on anchors.*  Anchors are counted with map-side combine; a piece
    whose anchor occurs once holds no repeated window and is gone.  Pieces that
    agree in anchor and digest are copies of each other as a whole.  What is
    left are pieces that share an anchor but differ: the ends of repeats.
3.  *Extension.*  One representative of each distinct such piece travels, as
    bytes, to the shard of its anchor; there ``leaf`` compares the symbols
    themselves and decides window by window.
4.  *Longer seeds.*  An anchor with more than ``hot`` distinct pieces is not
    gathered.  These pieces become the texts of a next round, which cuts them by
    longer seeds (the next of ``seeds``) and goes through the same steps; the
    last seed is the window itself, under which no two distinct windows meet.

Hashes only bring pieces together or discard them; nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _symbols as S
from ._store import Kept, free_shuffles
from ._symbols import ragged

#: An anchor with more distinct pieces than this is cut by longer seeds.
HOT = 1000

class Run:
    """Symbols of a run of texts: a code for each, texts' offsets, and the bytes of symbols a..b: body[at[a]:at[b]]."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, body: np.ndarray, at: np.ndarray):
        self.codes, self.offsets, self.body, self.at = codes, offsets, body, at


class Pieces:
    """Columns of the pieces of a run; row and start tell the place, span the content's digest as two numbers."""

    __slots__ = ("row", "start", "n", "key", "span", "again")


def cut(run: Run, width: int, k: int) -> Pieces | None:
    """Pieces of every sequence; None if no sequence is ``width`` long.

    ``again`` marks a piece in whose span the anchor occurs twice or more: its
    windows may repeat one another.
    """
    codes, offsets = run.codes, run.offsets
    w, n = width - k + 1, len(codes)
    if n < width or int(np.diff(offsets).max(initial=0)) < width:
        return None
    sums = S.prefix_sums(codes)
    at = np.arange(n - k + 1)
    grams = S.span_hash(sums, at, at + k)
    least = S.sliding_min(grams, w)
    windows = len(least)
    row = S.doc_of(offsets)[:windows]
    whole = at[:windows] + width <= offsets[1:][row]
    first = np.ones(windows, bool)
    first[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], windows)
    begin, end = begin[whole[begin]], end[whole[begin]]
    # an endless run of one anchor (periodic text) is cut into pieces of bounded size
    most, size = 8 * w, end - begin
    parts = -(-size // most)
    if parts.max(initial=0) > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        last = np.repeat(end, parts)
        begin = np.repeat(begin, parts) + nth * most
        end = np.minimum(begin + most, last)
    out = Pieces()
    out.row, out.n, out.key = row[begin], end - begin, least[begin]
    out.start = begin - offsets[out.row]
    body = memoryview(np.ascontiguousarray(run.body))
    out.span = np.frombuffer(b"".join([blake2b(body[x:y], digest_size=16).digest() for x, y in zip(run.at[begin].tolist(), run.at[end + width - 1].tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    # positions of the k-grams that are some window's least; two equal neighbours within a span: again
    pad = np.zeros(windows + 2 * (w - 1), np.uint64)
    pad[w - 1 : w - 1 + windows] = least
    peak = S.sliding_min(pad, w, np.maximum, np.uint64(0))
    anchors = np.flatnonzero(grams == peak)
    twin = np.zeros(len(anchors) + 1, np.int64)
    if len(anchors) > 1:
        np.cumsum(grams[anchors[1:]] == grams[anchors[:-1]], out=twin[1 : len(anchors)])
        twin[len(anchors)] = twin[len(anchors) - 1]
    lo, hi = np.searchsorted(anchors, begin), np.searchsorted(anchors, end + w - 1)
    out.again = (hi - lo > 1) & (twin[np.maximum(hi - 1, 0)] > twin[lo])
    return out


class Group:
    """Distinct pieces of one shard, as ``leaf`` sees them: key, how often each occurs, windows, and its bytes."""

    def __init__(self, key: np.ndarray, times: np.ndarray, n: np.ndarray, body: np.ndarray, offsets: np.ndarray, width: int, k: int):
        self.key, self.times, self.n, self.body, self.offsets, self.width, self.k = key, times, n, body, offsets, width, k


def flags_to_ranges(flags: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window, count) of each run of set flags."""
    if not len(flags):
        z = np.zeros(0, np.int64)
        return z, z, z
    base = np.cumsum(n) - n
    piece = np.repeat(np.arange(len(n)), n)
    edge = np.ones(len(flags), bool)
    edge[1:] = (flags[1:] != flags[:-1]) | (piece[1:] != piece[:-1])
    at = np.flatnonzero(edge)
    size = np.diff(np.append(at, len(flags)))
    keep = flags[at]
    at, size = at[keep], size[keep]
    p = piece[at]
    return p, start[p] + at - base[p], size


#: Turns (bytes, offsets) of a run of texts into symbols.
Symbols = Callable[[np.ndarray, np.ndarray], Run]

_PIECE_ARROW = pa.schema([("key", pa.int64()), ("span", pa.binary()), ("did", pa.int64()), ("th", pa.int64()), ("base", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("again", pa.bool_())])
_PIECE = "key long, span binary, did long, th long, base int, start int, n int, again boolean"
_SENT_ARROW = pa.schema([("shard", pa.int64()), ("key", pa.int64()), ("times", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("base", pa.int32()), ("n", pa.int32()), ("text", pa.binary()), ("what", pa.string())])
_SENT = "shard long, key long, times long, did long, th long, base int, n int, text binary, what string"
_RANGE_ARROW = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_RANGE = "did long, th long, start int, n int"


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """``body[begin[i]:end[i]]`` as a binary column."""
    size = end - begin
    ends = np.concatenate([[0], np.cumsum(size)])
    if ends[-1] >= 2**31:
        raise ValueError("more bytes than one batch holds")
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body[ragged(begin, size)]))])


def marks(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(did, th): 64-bit hashes of id and text that tell rows apart even where ids are null or repeat.

    Rows that repeat in full share both; they are copies of each other, so
    whatever is found for one holds for all.
    """
    return F.xxhash64(F.col(id_col)).alias("did"), F.xxhash64(F.col(text_col).cast("string")).alias("th")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, th, id, text), see ``marks``."""
    return docs.select(*marks(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _lists(column: pa.Array, *names: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and fields of a column of lists of structs."""
    upto = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    inner = column.flatten()
    return upto, {x: inner.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names}


def _pieces(symbols: Symbols, width: int, k: int):
    def run(batches):
        for b in batches:
            raw, off = S.flat(b.column("text"))
            did, th, base = (b.column(x).to_numpy(zero_copy_only=False) for x in ("did", "th", "base"))
            for lo, hi in S.runs_of(off):
                p = cut(symbols(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), width, k)
                if p is not None and len(p.row):
                    span = pa.Array.from_buffers(pa.binary(), len(p.row), [None, pa.py_buffer(np.arange(0, 16 * len(p.row) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(p.span))])
                    r = p.row + lo
                    yield _batch(_PIECE_ARROW, p.key.view(np.int64), span, did[r], th[r], base[r], p.start, p.n, p.again)

    return run


def _send(symbols: Symbols, width: int, shards: int):
    """The bytes of the pieces that a text is asked for; ``base`` is then the piece's own place in its document."""

    def run(batches):
        for b in batches:
            raw, off = S.flat(b.column("text"))
            upto, f = _lists(b.column("pieces"), "key", "times", "start", "n", "heavy")
            did, th, base = (b.column(x).to_numpy(zero_copy_only=False) for x in ("did", "th", "base"))
            for lo, hi in S.runs_of(off):
                r = symbols(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                row = np.repeat(np.arange(lo, hi), np.diff(upto[lo : hi + 1]))
                key, times, start, n, heavy = (f[x][upto[lo] : upto[hi]] for x in ("key", "times", "start", "n", "heavy"))
                begin = r.offsets[row - lo] + start
                for x in range(0, len(row), 1 << 16):
                    y = slice(x, x + (1 << 16))
                    body = slices(r.body, r.at[begin[y]], r.at[begin[y] + n[y] + width - 1])
                    what = pa.array(["cool", "heavy"], pa.string()).take(pa.array(heavy[y]))
                    yield _batch(_SENT_ARROW, (key[y].view(np.uint64) % np.uint64(shards)).astype(np.int64), key[y], times[y], did[row[y]], th[row[y]], base[row[y]] + start[y], n[y], body, what)

    return run


def _settle(leaf: Callable[[Group], np.ndarray], width: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        key, times, n, start, did, th = (table.column(x).to_numpy() for x in ("key", "times", "n", "base", "did", "th"))
        n, start = n.astype(np.int64), start.astype(np.int64)
        body, offsets = S.flat(table.column("text"))
        flags = leaf(Group(key.view(np.uint64), times, n, body, offsets, width, k))
        p, first, size = flags_to_ranges(flags & np.repeat(times == 1, n), n, start)  # the others are known as copies
        return pa.table([pa.array(did[p]), pa.array(th[p]), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))], schema=_RANGE_ARROW)

    return run


def repeats(docs: DataFrame, *, width: int, seeds: Sequence[int], symbols: Symbols, leaf: Callable[[Group], np.ndarray], hot: int = HOT, a_shard: int = 4000, name: str = "repeats") -> Kept:
    """Ranges of repeated windows: a table (did, th, start, n), a row for each stretch of windows.

    docs: see ``identified``.  A place's windows may be told more than once.
    a_shard: pieces for each shard of the extension step.
    """
    texts, told, sent = docs.select("did", "th", F.lit(0).alias("base"), "text"), [], None
    place = ["did", "th", "base"]
    for k in (*[s for s in seeds if s < width], width):
        found = Kept(texts.mapInArrow(_pieces(symbols, width, k), _PIECE), f"{name}-pieces")
        keys = found.df.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("span").alias("lo"), F.max("span").alias("hi"), F.max("again").alias("self"))
        # a table of its own: so both sides of the join are plain shuffles, and Spark splits a hot key's pieces among tasks
        keys = Kept(keys.where("c > 1 or self").select("key", F.expr("lo <> hi or self").alias("open")), f"{name}-keys")
        live = Kept(found.df.join(keys.df, "key"), f"{name}-live")
        found.drop()
        keys.drop()
        spans = Kept(live.df.where("open").groupBy("key", "span").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*place, "start", "n")).alias("at")), f"{name}-spans")
        heavy = Kept(spans.df.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where((F.col("kinds") > hot) & F.lit(k < width)).select("key", F.lit(1).alias("heavy")), f"{name}-heavy")
        whole = live.df.where("open").join(spans.df.where("times > 1").select("key", "span"), ["key", "span"]).unionByName(live.df.where("not open"))
        whole = whole.select("did", "th", (F.col("base") + F.col("start")).alias("start"), "n")
        asked = spans.df.join(heavy.df, "key", "left").select(*[f"at.{x}" for x in place], F.struct("key", "times", "at.start", "at.n", F.coalesce("heavy", F.lit(0)).alias("heavy")).alias("piece"))
        asked = asked.groupBy(*place).agg(F.collect_list("piece").alias("pieces"))
        shards = max(64, spans.df.count() // a_shard)
        bodies = texts.join(asked.hint("shuffle_hash"), place).select(*place, "text", "pieces").mapInArrow(_send(symbols, width, shards), _SENT)
        old, sent = sent, Kept(bodies, f"{name}-sent", by="what")
        told.append(Kept(whole.unionByName(sent.part("cool").groupBy("shard").applyInArrow(_settle(leaf, width, k), _RANGE)), f"{name}-ranges"))
        more = not heavy.df.isEmpty()
        for x in (live, spans, heavy, *([old] if old else [])):
            x.drop()
        sent.drop("cool")
        free_shuffles(docs.sparkSession)
        if not more:
            break
        texts = sent.part("heavy").select(*place, "text")
    sent.drop()
    if len(told) > 1:
        every = told[0].df
        for x in told[1:]:
            every = every.unionByName(x.df)
        told, old = [Kept(every, f"{name}-ranges")], told
        for x in old:
            x.drop()
    return told[0]


def covered(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs with ``spans``: each row's ranges of repeated windows (null: none)."""
    per = ranges.groupBy("did", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return docs.join(per.hint("shuffle_hash"), ["did", "th"], "left")


def cover_mask(total: int, base: np.ndarray, spans: pa.Array, lo: int, hi: int, width: int) -> np.ndarray:
    """Which symbols of rows lo..hi some range covers; base: where each row's symbols begin."""
    some = spans.slice(lo, hi - lo)
    inner = some.flatten()
    sizes = some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.repeat(base, sizes) + inner.field("start").to_numpy(zero_copy_only=False)
    edge = np.bincount(at, minlength=total + 1) - np.bincount(at + inner.field("n").to_numpy(zero_copy_only=False) + width - 1, minlength=total + 1)
    return np.cumsum(edge)[:total] > 0
