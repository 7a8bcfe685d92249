"""Byte-level dedup over suffix arrays built by two-stage sorting.

Strings of ``width`` bytes that start in two places are removed wherever they
stand.  ``_repeats`` brings together, in shards, the text around anchors that
occur more than once; in each shard the suffixes are put in order by two-stage
sorting and neighbours with a common prefix of ``width`` bytes are repeats:

* suffixes smaller than their successors (type S) are sorted directly, by
  eight-byte words, in rounds over those still tied, up to ``width`` bytes;
* the others (type L) are induced: a scan over the buckets of the first byte in
  ascending order puts each scanned suffix's predecessor, if of type L, next in
  its bucket;
* the lengths of the common prefixes of neighbours are computed word by word.

Before sorting, a shard's pieces are cut again by longer anchors: a piece whose
anchor is its own holds no repeat, and of pieces with the same content (by
128-bit digest, as for the copies that ``_repeats`` finds) one is sorted.

Defined cases: null is empty; texts shorter than ``width`` lose nothing; texts of
any length are treated whole; rows that repeat are copies and lose every full
string; an empty table gives an empty result; other columns do not matter,
whatever their names.  Removal works on bytes and may cut within a code point.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _repeats as R
from . import _symbols as S

WIDTH = 400
SEEDS = (64, 300)
PIECES_A_SHARD = 500  # of about 500 bytes each: a suffix array that fits a cache
_END = 0xFF  # never a byte of UTF-8


def characters(raw: np.ndarray, off: np.ndarray) -> R.Run:
    """The bytes of a run of texts as symbols."""
    return R.Run(S.byte_codes(raw), off, raw, np.arange(len(raw) + 1))


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one big-endian number (past the end: 0)."""
    pad = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | pad[i : i + len(text)]
    return out


def sort_directly(at: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes ``at`` in order of their first ``depth`` bytes."""
    n = len(word)
    at = at[np.argsort(word[at], kind="stable")]
    key = word[at]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    place = np.arange(len(at))
    for d in range(8, depth, 8):
        # only suffixes that are still tied go on
        last = np.append(new[1:], True)
        tied = ~(new & last)
        place, new = place[tied], new[tied]
        if not len(place):
            break
        a = at[place]
        p = a + d
        key = np.where(p < n, word[np.minimum(p, n - 1)], np.uint64(0))
        differs = np.flatnonzero((key[1:] != key[:-1]) & ~new[1:]) + 1
        if not len(differs):
            continue
        # of these, only groups with different words need a sort
        group = np.cumsum(new) - 1
        torn = np.zeros(group[-1] + 1, bool)
        torn[group[differs]] = True
        x = np.flatnonzero(torn[group])
        order = x[np.lexsort((key[x], group[x]))]
        at[place[x]] = a[order]
        key[x] = key[order]
        new[1:] |= key[1:] != key[:-1]
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``text`` in order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # type: S if smaller than the successor; equal bytes take the successor's type; the last is L
    differs = np.flatnonzero(text[:-1] != text[1:])
    less = np.zeros(n, bool)
    if len(differs):
        nxt = np.searchsorted(differs, np.arange(n))
        has = nxt < len(differs)
        d = differs[np.minimum(nxt, len(differs) - 1)]
        less = has & (text[d] < text[np.minimum(d + 1, n - 1)])
    word = words8(text)
    small = sort_directly(np.flatnonzero(less), word, depth)
    count = np.bincount(text, minlength=256)
    count_s = np.bincount(text[less], minlength=256)
    begin = np.cumsum(count) - count
    sa = np.full(n, -1, np.int64)
    upto = np.cumsum(count_s)
    for c in np.flatnonzero(count_s):
        sa[begin[c] + count[c] - count_s[c] : begin[c] + count[c]] = small[upto[c] - count_s[c] : upto[c]]
    head = begin.copy()

    def put(found: np.ndarray) -> None:
        """Predecessors, in order, go to the next free places of their buckets."""
        ch = text[found]
        order = np.argsort(ch, kind="stable")
        kinds, first, size = np.unique(ch[order], return_index=True, return_counts=True)
        place = np.empty(len(found), np.int64)
        place[order] = np.repeat(head[kinds] - first, size) + np.arange(len(found))
        sa[place] = found
        head[kinds] += size

    put(np.array([n - 1]))  # the suffix before the empty one
    for c in np.flatnonzero(count):
        done = begin[c]
        while done < head[c]:  # L part; grows while equal bytes precede
            now = head[c]
            cur = sa[done:now]
            pred = cur[cur > 0] - 1
            pred = pred[~less[pred]]
            done = now
            if len(pred):
                put(pred)
        cur = sa[begin[c] + count[c] - count_s[c] : begin[c] + count[c]]
        pred = cur[cur > 0] - 1
        pred = pred[~less[pred]]
        if len(pred):
            put(pred)
    return sa


def common_prefixes(sa: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """The length of the common prefix of each neighbouring pair in ``sa``, up to ``depth``."""
    n = len(word)
    out = np.zeros(max(0, len(sa) - 1), np.int64)
    alive = np.arange(len(out))
    padded = np.concatenate([word, np.zeros(depth, np.uint64)])
    for d in range(0, depth, 8):
        differ = padded[sa[alive] + d] ^ padded[sa[alive + 1] + d]
        same = differ == 0
        ends = alive[~same]
        out[ends] = d + (64 - np.bitwise_count(_smear(differ[~same])).astype(np.int64)) // 8
        alive = alive[same]
    out[alive] = depth
    return np.minimum(np.minimum(out, depth), n - np.maximum(sa[:-1], sa[1:]))


def _smear(x: np.ndarray) -> np.ndarray:
    """All bits from the highest set one down."""
    x = x.copy()
    for i in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(i)
    return x


def _sorted_flags(body: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Flags of the windows of pieces (body[at[i] : at[i] + n[i] + width - 1]) by a suffix array."""
    size = n + width - 1
    text = np.full(int(size.sum()) + len(n), _END, np.uint8)
    base = np.cumsum(size + 1) - (size + 1)
    text[R.ragged(base, size)] = body[R.ragged(at, size)]
    sa = suffix_array(text, width)
    same = common_prefixes(sa, words8(text), width) >= width
    hit = np.zeros(len(text), bool)
    hit[sa[:-1][same]] = True
    hit[sa[1:][same]] = True
    return hit[R.ragged(base, n)]


def leaf(g: R.Group) -> np.ndarray:
    """One flag for each window of each piece of the shard."""
    width = g.width
    out = np.zeros(int(g.n.sum()), bool)
    p = R.cut(characters(g.body, g.offsets), width, max(g.k, width * 3 // 4))
    if p is None:
        return out
    times = g.times[p.row]
    order = np.lexsort((p.span[:, 0], p.span[:, 1], p.key))
    key, span = p.key[order], p.span[order]
    new_key, new = np.ones(len(order), bool), np.ones(len(order), bool)
    new_key[1:] = key[1:] != key[:-1]
    new[1:] = new_key[1:] | (span[1:] != span[:-1]).any(axis=1)
    kind, whose = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    copies = order[np.bincount(kind, times[order])[kind] > 1]
    window = np.cumsum(g.n) - g.n
    out[R.ragged(window[p.row[copies]] + p.start[copies], p.n[copies])] = True
    one = order[new]  # one of each content
    ask = one[(np.bincount(whose[new])[whose[new]] > 1) | p.again[one]]
    if len(ask):
        flags = _sorted_flags(g.body, g.offsets[p.row[ask]] + p.start[ask], p.n[ask], width)
        out[R.ragged(window[p.row[ask]] + p.start[ask], p.n[ask])] |= flags
    return out


_OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(width: int, with_text: bool):
    def run(batches):
        for b in batches:
            raw, off = S.flat(b.column("text"))
            spans, ids = b.column("spans"), b.column("id")
            for lo, hi in S.runs_of(off):
                part, o = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                gone = R.cover_mask(len(part), o[:-1], spans, lo, hi, width)
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                inner = o[1:-1][o[1:-1] < len(part)]
                first[inner] = gone[inner]
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[o])
                n_spans = np.diff(np.concatenate([[0], np.cumsum(first)])[o])
                body = part[~gone].tobytes()
                upto = o - np.concatenate([[0], np.cumsum(removed)])
                texts = [body[upto[i] : upto[i + 1]] for i in range(hi - lo)]
                kept = pa.array(texts, pa.binary()) if with_text else pa.nulls(hi - lo, pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(o)), pa.array(removed), pa.array(n_spans), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), kept], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seeds: tuple[int, ...] = SEEDS, hot: int = R.HOT, with_text: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes that stay)."""
    base = R.identified(docs, id_col, text_col)
    told = R.repeats(base, width=width, seeds=seeds, symbols=characters, leaf=leaf, hot=hot, a_shard=PIECES_A_SHARD, name="bytes")
    kind = base.schema["id"].dataType.simpleString()
    out = R.covered(base, told.df).select("id", "text", "spans").mapInArrow(_remove(width, with_text), f"id {kind}, {_OUT}")
    return out.withColumnRenamed("id", id_col)
