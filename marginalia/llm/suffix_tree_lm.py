"""Language-model scoring with a probabilistic suffix tree over words, spelled by one over bytes.

A text is its words (lower-cased, A-Z) and one end symbol.  The tree's states are
contexts of up to ``ORDER`` words (the end symbol stands before a text's first
word).  A context is retained, whatever the corpus size, if it occurs at least
``MIN_COUNT`` times and its next-word distribution diverges from that of the
state one word shorter: count times Kullback-Leibler divergence of at least
``GAIN`` nats (by the shorter state's logarithms to three digits).  A word is scored in the longest suffix state:

    p(w | state) = (max(count(w) - D, 0) + D * kinds * p(w | shorter)) / count

with absolute discount D; below the one-word contexts lies the root, whose
counts are those of the training words, and below the root the spelling tree: a
word is its bytes and an end mark, the states are its last up to ``SPELL_DEPTH``
bytes, retained by the same test and smoothed by their suffixes, and it learns
from each distinct training word once.  So every state's probabilities add up to
1 over all words, those never seen among them, and a text's score is the sum of
the logarithms; the base has no part in it.

Counts come from every training text.  The texts are read once, in chunks of
about ``CHUNK`` bytes, and from then on are packed word numbers.  A chunk sends
each distinct word to the shard of its hash, where counts add up, and gets back
count and root probability; then, for each length of context, each distinct
(context, word) to the shard of the context, and gets back its count and the
state's numbers.  A context with more than one in
``HOT_SHARE`` of all training words (so at most that many contexts) is dealt by
context and word instead, and only its sums are broadcast.  No shard's share
depends on how common one word is, and neither vocabulary nor tree is gathered.

Defined cases: a null or blank text is one end symbol; a text of any length is a
chunk of its own at most; rows that repeat are scored alike and each counted;
with a null id a row is learned from and not held out; an empty table gives an
empty result; without training text every count is 0, and words have their
spelling's probability under equally likely bytes; other columns do not matter,
whatever their names.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _symbols as S
from ._store import Kept, free_shuffles
from ._symbols import ranked, ranked_small

ORDER = 2
MIN_COUNT, GAIN, DISCOUNT = 2, 1.0, 0.75
SPELL_DEPTH, SPELL_COUNT, SPELL_GAIN = 6, 4, 2.0
CHUNK = 10 << 20
SHARD_BYTES = 16 << 20
HOT_SHARE, HOT_LEAST = 4096, 1 << 16  # contexts of up to HOT_LEAST words are never split
_END = np.uint64(0x5851F42D4C957F2D)
_LOW = 16  # shards that add up the contexts of one byte
_ZSTD = pa.Codec("zstd", compression_level=1)


# --- packed arrays ------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes; ascending 64-bit ones as differences."""
    out = []
    for x in arrays:
        rising = x.dtype == np.uint64 and bool((x[1:] >= x[:-1]).all())
        y = np.diff(x, prepend=np.uint64(0)) if rising else x
        body = _ZSTD.compress(np.ascontiguousarray(y.view(np.uint8).reshape(len(y), x.itemsize).T).tobytes(), asbytes=True)
        out.append(struct.pack("<c?qq", x.dtype.char.encode(), rising, len(x), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, rising, n, size = struct.unpack_from("<c?qq", data, at)
        at += struct.calcsize("<c?qq")
        dtype = np.dtype(kind.decode())
        flat = np.frombuffer(_ZSTD.decompress(data[at : at + size], n * dtype.itemsize, asbytes=True), np.uint8)
        x = np.ascontiguousarray(flat.reshape(dtype.itemsize, n).T).view(dtype).ravel()
        out.append(np.cumsum(x, dtype=np.uint64) if rising else x)
        at += size
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers (none negative) in as few bytes as the largest needs."""
    top = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def dealt(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, indices in order) of each shard that occurs."""
    shards, rank = ranked_small(shard)
    order = np.argsort(rank.astype(np.uint16) if len(shards) < 1 << 16 else rank, kind="stable")  # 16 bits: a radix sort
    return list(zip(shards.tolist(), np.split(order, np.cumsum(np.bincount(rank))[:-1]), strict=True)) if len(shards) else []


def _shard(codes: np.ndarray, shards: int) -> np.ndarray:
    return (S.mix(codes) % np.uint64(shards)).astype(np.int64)


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


# --- the spelling tree --------------------------------------------------------------------------


def grams(sizes: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and end mark of each word with its SPELL_DEPTH predecessors, the symbol lowest; whose it is."""
    n = len(sizes)
    length = SPELL_DEPTH + 2 + sizes
    off = np.cumsum(length) - length
    symbols = np.zeros(int(length.sum()), np.uint8)
    symbols[off + SPELL_DEPTH] = 10  # the start; neither it nor the end mark is part of a word
    symbols[S.ragged(off + SPELL_DEPTH + 1, sizes)] = raw
    symbols[off + length - 1] = 32
    at = S.ragged(off + SPELL_DEPTH + 1, sizes + 1)
    out = np.zeros(len(at), np.uint64)
    for i in range(SPELL_DEPTH, -1, -1):
        out = (out << np.uint64(8)) | symbols[at - i]
    return out, np.repeat(np.arange(n), sizes + 1)


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Sorted:
    """Exact lookup by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), self.values.dtype)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]


class Tree:
    """Byte states with smoothed log10 distributions; made from (depth, gram, count) entries."""

    def __init__(self, depth: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.states: list = [None] * (SPELL_DEPTH + 1)
        self.symbols: list = [None] * (SPELL_DEPTH + 1)
        zero = np.zeros(256)
        if len(gram):
            one = depth == 1
            np.add.at(zero, (gram[one] & np.uint64(255)).astype(np.int64), count[one])
        self.base = np.log10((zero + 0.5) / (zero.sum() + 128))
        for k in range(1, SPELL_DEPTH + 1):
            at = depth == k
            g, c = add_up(gram[at], count[at].astype(np.int64))
            if not len(g):
                continue
            ctx = g >> np.uint64(8)
            first = np.ones(len(g), bool)
            first[1:] = ctx[1:] != ctx[:-1]
            begin = np.flatnonzero(first)
            kinds = np.diff(np.append(begin, len(g)))
            total, beta = np.add.reduceat(c, begin), np.maximum(1.0, 0.8 * kinds)
            below = 10.0 ** self.evaluate(g, k - 1)
            p = (c + np.repeat(beta, kinds) * below) / np.repeat(total + beta, kinds)
            self.symbols[k] = Sorted(g, np.log10(p))
            self.states[k] = Sorted(ctx[begin], np.log10(beta / (total + beta)))

    def evaluate(self, g: np.ndarray, top: int = SPELL_DEPTH) -> np.ndarray:
        """log10 probability of each gram's symbol in its longest suffix state of at most ``top`` bytes."""
        out = np.zeros(len(g))
        left = np.arange(len(g))
        for k in range(top, 0, -1):
            if self.states[k] is None or not len(left):
                continue
            q = g[left] & _mask(k + 1)
            state, back = self.states[k].get(q >> np.uint64(8))
            inside = np.flatnonzero(state)
            found, value = self.symbols[k].get(q[inside])
            done = np.zeros(len(left), bool)
            done[inside[found]] = True
            out[left[inside[found]]] += value[found]
            out[left[inside[~found]]] += back[inside[~found]]
            left = left[~done]
        out[left] += self.base[(g[left] & np.uint64(255)).astype(np.int64)]
        return out


def retained(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, gram, count) of the retained contexts of two bytes and more, of subtrees that are whole."""
    depths, rows, sums = [], [], []
    for k in range(2, SPELL_DEPTH + 1):
        g, c = add_up(keys & _mask(k + 1), counts)
        ctx = g >> np.uint64(8)
        first = np.ones(len(g), bool)
        first[1:] = ctx[1:] != ctx[:-1]
        begin = np.flatnonzero(first)
        n = np.add.reduceat(c, begin) if len(begin) else c
        keep = np.ones(len(g), bool)
        if k > 2 and len(g):  # by frequency and divergence from the context one shorter
            kinds = np.diff(np.append(begin, len(g)))
            at = np.searchsorted(above[0], g & _mask(k))
            parent = above[1][at] / above[3][np.searchsorted(above[2], (g & _mask(k)) >> np.uint64(8))]
            gain = np.add.reduceat(c * np.log(c / np.repeat(n, kinds) / parent), begin)
            keep = np.repeat((n >= SPELL_COUNT) & (gain >= SPELL_GAIN), kinds)
        depths.append(np.full(int(keep.sum()), k, np.int64))
        rows.append(g[keep])
        sums.append(c[keep])
        above = g, c, ctx[begin], n
    return np.concatenate(depths), np.concatenate(rows), np.concatenate(sums)


def _subtree(keys: np.ndarray, shards: int) -> np.ndarray:
    """Grams go to the shard of their last two context bytes, so a shard holds whole subtrees."""
    return _shard((keys >> np.uint64(8)) & np.uint64(0xFFFF), shards)


def _type_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of the words of a shard; their counts over training words; per place: which gram, whose."""
    _, counts, sizes, raw = unpack(blob)
    g, owner = grams(sizes.astype(np.int64), raw)
    keys, rank = ranked(g)
    return keys, np.bincount(rank, (counts > 0)[owner], len(keys)).astype(np.int64), np.stack([rank, owner])


def _spell_low(batches):
    """Counts of the contexts of one byte."""
    for b in batches:
        for blob in b.column("pack").to_pylist():
            keys, counts, _ = _type_grams(blob)
            keys, counts = add_up(keys[counts > 0] & _mask(2), counts[counts > 0])
            rows = [{"part": p, "pack": pack(keys[x], counts[x])} for p, x in dealt((keys % np.uint64(_LOW)).astype(np.int64))]
            yield _rows(pa.schema([("part", pa.int64()), ("pack", pa.binary())]), rows)


def _added(table: pa.Table) -> pa.Table:
    parts = [unpack(x) for x in table.column("pack").to_pylist()]
    return pa.table([pa.array([pack(*add_up(*(np.concatenate(x) for x in zip(*parts, strict=True))))], pa.binary())], names=["pack"])


def _spell_ask(shards: int):
    schema = pa.schema([("sub", pa.int64()), ("shard", pa.int64()), ("pack", pa.binary())])

    def run(batches):
        for b in batches:
            for shard, blob in zip(b.column("shard").to_pylist(), b.column("pack").to_pylist(), strict=True):
                keys, counts, _ = _type_grams(blob)
                yield _rows(schema, [{"sub": s, "shard": shard, "pack": pack(keys[x], narrow(counts[x]))} for s, x in dealt(_subtree(keys, shards))])

    return run


def _spell_values(low):
    """Each asked gram's log10 probability, in the order asked."""
    schema = pa.schema([("shard", pa.int64()), ("sub", pa.int64()), ("pack", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table.column("pack").to_pylist()]
        keys, rank = ranked(np.concatenate([x[0] for x in parts]))
        counts = np.bincount(rank, np.concatenate([x[1] for x in parts]), len(keys)).astype(np.int64)
        depth, gram, count = retained(keys[counts > 0], counts[counts > 0])
        one, ones = low.value
        model = Tree(np.concatenate([np.ones(len(one), np.int64), depth]), np.concatenate([one, gram]), np.concatenate([ones, count]))
        logs = model.evaluate(keys)[rank].astype(np.float32)
        upto = np.cumsum([0, *(len(x[0]) for x in parts)])
        packs = [pack(logs[upto[i] : upto[i + 1]]) for i in range(len(parts))]
        return pa.table([table.column("shard"), table.column("sub"), pa.array(packs, pa.binary())], schema=schema)

    return run


# --- chunks and words ---------------------------------------------------------------------------


class Chunk:
    """Word numbers of a run of texts, an end after each text."""

    def __init__(self, vocab: np.ndarray, tok: np.ndarray, sizes: np.ndarray, learn: np.ndarray):
        self.vocab, self.tok, self.sizes = vocab, tok.astype(np.int64), sizes.astype(np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.sizes)])
        self.row = np.repeat(np.arange(len(sizes)), self.sizes)
        self.learn = learn.astype(bool)[self.row]
        self.end = int(np.searchsorted(vocab, _END))

    def before(self) -> np.ndarray:
        """The word before each place; before a text's first the end."""
        out = np.empty(len(self.tok), np.int64)
        out[1:] = self.tok[:-1]
        out[self.off[:-1]] = self.end
        return out


def _read(shards: int, schema: pa.Schema):
    """Packed chunks, and each chunk's distinct words with their training counts and bytes, a row a shard."""

    def run(batches):
        from pyspark import TaskContext

        chunk, texts, learn, ids, size = TaskContext.get().partitionId() << 33, [], [], [], 0

        def row(n, **known):
            return pa.RecordBatch.from_arrays([known.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def sent():
            raw, off = S.flat(pa.concat_arrays(texts))
            codes, sizes, start, length = [], [], [], []
            for lo, hi in S.runs_of(off):
                w = S.Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True)
                ends = w.offsets[1:]
                codes.append(np.insert(w.code, ends, _END))
                start.append(np.insert(w.start + off[lo], ends, 0))
                length.append(np.insert(w.end - w.start, ends, 0))
                sizes.append(np.diff(w.offsets) + 1)
            codes, sizes, start, length = (np.concatenate(x) for x in (codes, sizes, start, length))
            vocab, tok = ranked(codes)
            learned = np.concatenate(learn)
            names = pa.concat_arrays(ids)
            at = pa.array([0, len(names)], pa.int32())
            yield row(1, what=pa.array(["chunks"]), chunk=pa.array([chunk]), ids=pa.ListArray.from_arrays(at, names).cast(schema.field("ids").type), pack=pa.array([pack(vocab, narrow(tok), narrow(sizes), learned.astype(np.uint8))], pa.binary()))
            counts = np.bincount(tok, np.repeat(learned, sizes), len(vocab)).astype(np.int64)
            place = np.empty(len(vocab), np.int64)
            place[tok[::-1]] = np.arange(len(tok))[::-1]
            start, length = start[place], length[place]
            parts = dealt(_shard(vocab, shards))
            packs = [pack(vocab[x], narrow(counts[x]), narrow(length[x]), S._LOWER[raw[S.ragged(start[x], length[x])]]) for _, x in parts]
            yield row(len(parts), what=pa.array(["words"] * len(parts)), chunk=pa.array([chunk] * len(parts), pa.int64()), shard=pa.array([s for s, _ in parts], pa.int64()), pack=pa.array(packs, pa.binary()))

        for b in batches:
            _, off = S.flat(b.column("text"))
            for lo, hi in S.runs_of(off, CHUNK):
                texts.append(b.column("text").slice(lo, hi - lo).cast(pa.string()))
                learn.append(b.column("learn").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool))
                ids.append(b.column("id").slice(lo, hi - lo))
                size += int(off[hi] - off[lo]) + 16 * (hi - lo)
                if size >= CHUNK:
                    yield from sent()
                    chunk += sum(len(x) for x in ids)
                    texts, learn, ids, size = [], [], [], 0
        if texts:
            yield from sent()

    return run


_WORD_ARROW = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("pack", pa.binary()), ("total", pa.int64()), ("kinds", pa.int64()), ("all_kinds", pa.int64())])
_WORD = "shard long, chunk long, pack binary, total long, kinds long, all_kinds long"
_ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("shard", pa.int64()), ("pack", pa.binary()), ("ctx", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64()), ("gain", pa.float64())])
_ANSWER = "chunk long, level int, shard long, pack binary, ctx long, n long, kinds long, gain double"


def _words(table: pa.Table) -> pa.Table:
    """A shard's distinct words with their counts (chunk null), and for each chunk which of them it asks for."""
    parts = [unpack(x) for x in table.column("pack").to_pylist()]
    codes, counts, sizes, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = sizes.astype(np.int64)
    vocab, rank = ranked(codes)
    total = np.bincount(rank, counts, len(vocab)).astype(np.int64)
    place = np.empty(len(vocab), np.int64)
    place[rank[::-1]] = np.arange(len(rank))[::-1]
    at = np.cumsum(sizes) - sizes
    own, shard = sizes[place], table.column("shard")[0].as_py()
    rows = [{"shard": shard, "pack": pack(vocab, narrow(total), narrow(own), raw[S.ragged(at[place], own)]), "total": int(total.sum()), "kinds": int((total > 0).sum()), "all_kinds": len(vocab)}]
    upto = np.cumsum([0, *(len(x[0]) for x in parts)])
    for i, chunk in enumerate(table.column("chunk").to_pylist()):
        rows.append({"shard": shard, "chunk": chunk, "pack": pack(rank[upto[i] : upto[i + 1]].astype(np.uint64))})
    return pa.Table.from_pylist(rows, schema=_WORD_ARROW)


def root_logs(counts: np.ndarray, spelled: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """log10 probability of words at the root, from their counts and their spelling's log10 probability."""
    if not n:
        return spelled
    share = DISCOUNT * kinds
    with np.errstate(divide="ignore"):
        seen = np.log10(np.maximum(counts - DISCOUNT, 0) + share * 10.0**spelled)
    return np.where(counts > 0, seen, np.log10(share) + spelled) - np.log10(n)


def _roots(n: int, kinds: int, subs: int):
    def run(words: pa.Table, spelled: pa.Table) -> pa.Table:
        """Root probability and count of each asked word."""
        blobs, chunks = words.column("pack").to_pylist(), words.column("chunk").to_pylist()
        if not blobs:
            return _ANSWER_ARROW.empty_table()
        types = blobs[chunks.index(None)]
        keys, _, (rank, owner) = _type_grams(types)
        _, counts, sizes, _ = unpack(types)
        parts, logs = dict(dealt(_subtree(keys, subs))), np.zeros(len(keys))
        for sub, x in zip(spelled.column("sub").to_pylist(), spelled.column("pack").to_pylist(), strict=True):
            logs[parts[sub]] = unpack(x)[0]
        root = root_logs(counts.astype(np.int64), np.bincount(owner, logs[rank], len(sizes)), n, kinds)
        shard = words.column("shard")[0].as_py()
        rows = []
        for chunk, x in zip(chunks, blobs, strict=True):
            if chunk is not None:
                idx = unpack(x)[0].astype(np.int64)
                rows.append({"chunk": chunk, "level": 0, "shard": shard, "pack": pack(idx.astype(np.uint64), root[idx].astype(np.float32), narrow(counts[idx]))})
        return pa.Table.from_pylist(rows, schema=_ANSWER_ARROW)

    return run


# --- contexts of words --------------------------------------------------------------------------


class Entries:
    """The distinct (context, word) pairs of a chunk at one level, in order of their numbers."""

    def __init__(self, ch: Chunk, places: np.ndarray, ctx: np.ndarray, ctx_code: np.ndarray, ctx_count: np.ndarray, parent: np.ndarray, hottest: float, shards: int):
        self.places = places
        pairs, self.rank = ranked_small(ctx[places] * len(ch.vocab) + ch.tok[places])
        self.ctx, self.word = pairs // len(ch.vocab), pairs % len(ch.vocab)
        self.own = ctx_code[self.ctx]
        self.count = np.bincount(self.rank, ch.learn[places], len(pairs)).astype(np.int64)
        self.parent = np.zeros(len(pairs))
        self.parent[self.rank] = parent[places]
        self.hot = ctx_count[self.ctx] > hottest
        with np.errstate(over="ignore"):
            self.shard = _shard(np.where(self.hot, self.own * np.uint64(0x9E3779B97F4A7C15) + ch.vocab[self.word], self.own), shards)

    def parts(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, its entries, where among these each context begins)."""
        out = []
        for shard, x in dealt(self.shard):
            new = np.ones(len(x), bool)
            new[1:] = self.ctx[x][1:] != self.ctx[x][:-1]
            out.append((shard, x, np.flatnonzero(new)))
        return out

    def packs(self, ch: Chunk, by_word: bool) -> list[tuple[int, bytes]]:
        """by_word: the shorter state's probability depends on the word alone, and so is sent once for each word."""
        out = []
        cost = np.minimum(np.rint(-1000 * self.parent), 65535).astype(np.uint16)
        for shard, x, at in self.parts():
            words, place, which = np.unique(self.word[x], return_index=True, return_inverse=True)
            out.append((shard, pack(self.own[x][at], narrow(np.diff(at, append=len(x))), self.hot[x][at].astype(np.uint8), ch.vocab[words], narrow(which), narrow(self.count[x]), cost[x][place] if by_word else cost[x])))
        return out


class Scored:
    """A chunk with all that has come back for it: each place's log10 probability in its longest state so far."""

    def __init__(self, chunks: pa.Table, answers: pa.Table, shards: int, exact: bool, hottest: float, hot: list):
        self.ch = ch = Chunk(*unpack(chunks.column("pack")[0].as_py()))
        told: dict = {}
        for level, shard, x in zip(answers.column("level").to_pylist(), answers.column("shard").to_pylist(), answers.column("pack").to_pylist(), strict=True):
            told.setdefault(level, []).append((shard, x))
        root, self.known, number = np.zeros(len(ch.vocab)), np.zeros(len(ch.vocab), np.int64), np.zeros(len(ch.vocab), np.uint64)
        parts = dict(dealt(_shard(ch.vocab, shards)))
        for shard, x in told.get(0, []):
            rank, root[parts[shard]], self.known[parts[shard]] = unpack(x)
            number[parts[shard]] = rank.astype(np.uint64) * np.uint64(shards) + np.uint64(shard)
        # from here on words go by their numbers, which are dense and so pack well
        order = np.argsort(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        root, self.known = root[order], self.known[order]
        ch.vocab, ch.tok, ch.end = number[order], rank[ch.tok], int(rank[ch.end])
        self.logs = root[ch.tok]
        self.shards, self.exact, self.hottest = shards, exact, hottest
        self.next = Entries(ch, np.flatnonzero(self.known[ch.before()] >= MIN_COUNT), ch.before(), ch.vocab, self.known, self.logs, hottest, shards)
        for level, sums in enumerate(hot, 1):
            self._apply(told.get(level, []), sums, level < ORDER)

    def _apply(self, told: list, sums: tuple, more: bool) -> None:
        ch, e = self.ch, self.next
        counts, n, kinds, keep = np.zeros(len(e.count), np.int64), np.zeros(len(e.count), np.int64), np.zeros(len(e.count), np.int64), np.zeros(len(e.count), bool)
        parts = {shard: (x, at) for shard, x, at in e.parts()}
        for shard, data in told:
            x, at = parts[shard]
            times = np.diff(at, append=len(x))
            c, *state = unpack(data)
            counts[x] = c
            n[x], kinds[x], keep[x] = (np.repeat(s, times) for s in state)
        warm = np.flatnonzero(e.hot)
        if len(warm):
            ctx, *state = sums
            at = np.searchsorted(ctx, e.own[warm])
            n[warm], kinds[warm] = state[0][at], state[1][at]
            keep[warm] = diverges(n[warm], state[2][at])
        logs = np.where(keep, state_logs(counts, np.maximum(n, 1), np.maximum(kinds, 1), e.parent), e.parent)
        self.logs[e.places] = logs[e.rank]
        if more:
            number = np.full(len(ch.tok), -1, np.int64)
            number[e.places] = e.rank
            ctx = np.full(len(ch.tok), -1, np.int64)
            ctx[1:] = number[:-1]
            ctx[ch.off[:-1]] = -1
            some = np.flatnonzero(ctx >= 0)
            some = some[counts[ctx[some]] >= MIN_COUNT]
            with np.errstate(over="ignore"):
                code = (e.own << np.uint64(32)) | ch.vocab[e.word] if self.exact else S.mix(e.own * np.uint64(0x9E3779B97F4A7C15) + ch.vocab[e.word])
            self.next = Entries(ch, some, ctx, code, counts, self.logs, self.hottest, self.shards)


def diverges(n: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Is a state retained; gain: the sum over its words of count * (ln count - ln p(word | shorter))."""
    return (n >= MIN_COUNT) & (gain - n * np.log(np.maximum(n, 1)) >= GAIN)


def state_logs(count: np.ndarray, n: np.ndarray, kinds: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """log10 probability in a retained state, from the shorter one's."""
    with np.errstate(divide="ignore"):
        own = np.log10(np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * 10.0**parent)
    return np.where(count > 0, own, np.log10(DISCOUNT * kinds) + parent) - np.log10(n)  # a parent may be too small for a power


def _ask(level: int, shards: int, exact: bool, hottest: float, hot: list):
    schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("pack", pa.binary())])

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return schema.empty_table()
        s = Scored(chunks, answers, shards, exact, hottest, [x.value for x in hot])
        chunk = chunks.column("chunk")[0].as_py()
        return pa.Table.from_pylist([{"shard": shard, "chunk": chunk, "pack": x} for shard, x in s.next.packs(s.ch, level == 1)], schema=schema)

    return run


def _settle(level: int):
    """Adds up a shard's (context, word) counts and answers each chunk in the order asked; sums for hot contexts."""

    def run(table: pa.Table) -> pa.Table:
        ctx, word, count, cost, hot, size, firsts = [], [], [], [], [], [0], []
        for x in table.column("pack").to_pylist():
            codes, times, heat, words, which, c, p = unpack(x)
            times = times.astype(np.int64)
            firsts.append(np.cumsum(times) - times)
            ctx.append(np.repeat(codes, times))
            hot.append(np.repeat(heat, times))
            word.append(words[which])
            count.append(c.astype(np.int64))
            cost.append(p[which] if level == 1 else p)
            size.append(len(c))
        ctx, word, count, cost, hot = (np.concatenate(x) for x in (ctx, word, count, cost, hot))
        order = np.lexsort((word, ctx))
        c, w = ctx[order], word[order]
        new_ctx = np.ones(len(order), bool)
        new_ctx[1:] = c[1:] != c[:-1]
        new = new_ctx.copy()
        new[1:] |= w[1:] != w[:-1]
        pair, state = np.cumsum(new) - 1, np.cumsum(new_ctx) - 1
        total = np.bincount(pair, count[order]).astype(np.int64)
        owner = state[new]
        below = cost[order][new] * (-np.log(10) / 1000)
        n = np.bincount(owner, total).astype(np.int64)
        kinds = np.bincount(owner, total > 0).astype(np.int64)
        gain = np.bincount(owner, total * (np.log(np.maximum(total, 1)) - below))
        keep = diverges(n, gain)
        which, whose = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        which[order], whose[order] = pair, state
        upto = np.cumsum(size)
        shard = table.column("shard")[0].as_py()
        rows = []
        for i, chunk in enumerate(table.column("chunk").to_pylist()):
            s = whose[upto[i] : upto[i + 1]][firsts[i]]
            rows.append({"chunk": chunk, "level": level, "shard": shard, "pack": pack(narrow(total[which[upto[i] : upto[i + 1]]]), narrow(n[s]), narrow(kinds[s]), keep[s].astype(np.uint8))})
        first = np.flatnonzero(new_ctx)
        for i in np.flatnonzero(hot[order][first]):
            rows.append({"ctx": int(c[first[i]].astype(np.int64)), "n": int(n[i]), "kinds": int(kinds[i]), "gain": float(gain[i])})
        return pa.Table.from_pylist(rows, schema=_ANSWER_ARROW)

    return run


def _sums(answers: DataFrame) -> tuple:
    """(context, n, kinds, gain) of the hot contexts, at most ``HOT_SHARE`` of them."""
    rows = answers.where("ctx is not null").groupBy("ctx").agg(F.sum("n"), F.sum("kinds"), F.sum("gain")).collect()
    ctx = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(ctx)
    cols = [np.array([r[i] for r in rows], t)[order] for i, t in ((1, np.int64), (2, np.int64), (3, np.float64))]
    return ctx[order], *cols


def _score(shards: int, n: int, kinds: int, exact: bool, hottest: float, hot: list, schema: pa.Schema):
    z = n + 0.5 * (kinds + 1)

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return schema.empty_table()
        s = Scored(chunks, answers, shards, exact, hottest, [x.value for x in hot])
        ch, docs = s.ch, len(s.ch.sizes)
        ids = chunks.column("ids").combine_chunks().flatten()
        base = np.bincount(ch.row, np.log10((s.known + 0.5) / z)[ch.tok], docs)
        known = np.bincount(ch.row, (s.known > 0)[ch.tok], docs).astype(np.int64)
        return pa.Table.from_arrays([ids, pa.array(ch.sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(np.bincount(ch.row, s.logs, docs))], schema=schema)

    return run


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, hot_share: int = HOT_SHARE, hot_least: int = HOT_LEAST) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_out, F.lit(False))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (~fold).alias("learn"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(16, size // SHARD_BYTES)
    subs = max(16, shards // 4)
    kind = base.schema["id"].dataType
    arrow = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("ids", pa.list_(to_arrow_type(kind))), ("pack", pa.binary()), ("what", pa.string())])
    read = Kept(base.mapInArrow(_read(shards, arrow), f"chunk long, shard long, ids array<{kind.simpleString()}>, pack binary, what string"), "lm-read", by="what")
    words = Kept(read.part("words").select("shard", "chunk", "pack").groupBy("shard").applyInArrow(_words, _WORD), "lm-words")
    read.drop("words")
    chunks = read.part("chunks").select("chunk", "ids", "pack")
    n, kinds, widest = words.df.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.max("all_kinds"), F.lit(0))).first()
    exact = (widest + 1) * shards < 1 << 32  # two word numbers fit into one of 64 bits
    types = words.df.where("chunk is null")
    parts = [unpack(r[0]) for r in types.select("pack").mapInArrow(_spell_low, "part long, pack binary").groupBy("part").applyInArrow(_added, "pack binary").collect()]  # at most 256 * 256 grams
    low = context.broadcast(tuple(np.concatenate([np.zeros(0, t), *(x[i] for x in parts)]) for i, t in ((0, np.uint64), (1, np.int64))))
    spelled = types.select("shard", "pack").mapInArrow(_spell_ask(subs), "sub long, shard long, pack binary").groupBy("sub").applyInArrow(_spell_values(low), "shard long, sub long, pack binary")
    answers = [Kept(words.df.select("shard", "chunk", "pack").groupBy("shard").cogroup(spelled.groupBy("shard")).applyInArrow(_roots(n, kinds, subs), _ANSWER), "lm-roots")]
    words.drop()
    hot: list = []
    hottest = max(hot_least, n / hot_share)

    def told() -> DataFrame:
        out = answers[0].df
        for x in answers[1:]:
            out = out.unionByName(x.df)
        return out.where("chunk is not null").select("chunk", "level", "shard", "pack")

    for level in range(1, ORDER + 1):
        free_shuffles(docs.sparkSession)
        asks = chunks.groupBy("chunk").cogroup(told().groupBy("chunk")).applyInArrow(_ask(level, shards, exact, hottest, list(hot)), "shard long, chunk long, pack binary")
        answers.append(Kept(asks.groupBy("shard").applyInArrow(_settle(level), _ANSWER), "lm-contexts"))
        hot.append(context.broadcast(_sums(answers[-1].df)))
    free_shuffles(docs.sparkSession)
    out = pa.schema([("id", to_arrow_type(kind)), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    done = Kept(chunks.groupBy("chunk").cogroup(told().groupBy("chunk")).applyInArrow(_score(shards, n, kinds, exact, hottest, hot, out), f"id {kind.simpleString()}, tokens long, known long, base double, score double"), "lm-scores")
    for x in (read, *answers):
        x.drop()
    return done.df.select(
        F.col("id").alias(id_col),
        F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == held_out, F.lit(False)).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
