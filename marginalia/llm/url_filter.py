"""URL filters on a sorted digest array.

A rule is a host and a path prefix (``example.net/en/``); it fits its host and
all subdomains if the url's path starts with its path.  The longest fitting rule
decides; among equally long ones the one with the longer host.

The 64-bit xxhashes of the rules lie sorted in a file that every executor
memory-maps; beside it lie the rules' strings in the same order.  The keys that
could fit a url (each of its host's suffixes with each path length that occurs
among the rules) and their hashes are made by expressions; a batch's hashes are
looked up in one vectorised binary search, and a hit counts only if the stored
string is the key, so hash collisions never decide.

Beyond ``MOST_BYTES`` of rules nothing is sent to executors: the keys are joined
with the rules instead (``by_join``), with the same result.

Defined cases: a null url or one without ``://`` has empty host and path and
fits no rule; a url of any length is read whole; an empty rule list leaves every url to ``default``; of rules that
repeat, block wins over allow; repeated urls are each judged; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MOST_BYTES = 256 << 20
_SEED = 42  # as in the expression xxhash64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """The contract's host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def normal(rules: Sequence[tuple[str, str]]) -> dict[str, str]:
    """rule -> verdict, hosts lower-cased; block wins where both are given."""
    out: dict[str, str] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        key = host.translate(str.maketrans(_UPPER, _UPPER.lower())) + slash + path
        out[key] = "block" if "block" in (verdict, out.get(key)) else verdict
    return out


def write_digests(rules: dict[str, str], path: str) -> None:
    """Sorted keys, then the strings' offsets, the strings, and one verdict byte each."""
    digest = np.array([xxhash.xxh64_intdigest(r.encode(), seed=_SEED) for r in rules], np.uint64)
    order = np.argsort(digest, kind="stable")
    names = list(rules)
    body = [names[i].encode() for i in order]
    with open(path, "wb") as f:
        f.write(np.array([len(body)], np.int64).tobytes())
        f.write(digest[order].tobytes())
        f.write(np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype(np.int64).tobytes())
        f.write(np.array([rules[names[i]] == "block" for i in order], np.uint8).tobytes())
        f.write(b"".join(body))


class Digests:
    """The memory-mapped array."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, np.int64, 1)[0])
        self.keys = np.memmap(path, np.uint64, "r", 8, (n,)) if n else np.zeros(0, np.uint64)
        self.at = np.memmap(path, np.int64, "r", 8 + 8 * n, (n + 1,))
        self.block = np.memmap(path, np.uint8, "r", 16 + 16 * n, (n,)) if n else np.zeros(0, np.uint8)
        size = int(self.at[-1])
        self.text = np.memmap(path, np.uint8, "r", 16 + 17 * n, (size,)) if size else np.zeros(0, np.uint8)

    def strings(self) -> pa.Array:
        """The rules in order of their digests, read in place."""
        return pa.Array.from_buffers(pa.large_string(), len(self.keys), [None, pa.py_buffer(self.at), pa.py_buffer(self.text)])

    def find(self, digests: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Index of each key in the array, -1 if it is not a rule."""
        out = np.full(len(digests), -1, np.int64)
        if not len(self.keys):
            return out
        at = np.searchsorted(self.keys, digests)
        left = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        at, stored = at[left], self.strings()
        while len(left):  # a second round only if two rules share a digest
            same = pc.equal(stored.take(pa.array(at)), keys.take(pa.array(left)).cast(pa.large_string())).to_numpy(zero_copy_only=False)
            out[left[same]] = at[same]
            left, at = left[~same], at[~same] + 1
            more = self.keys[np.minimum(at, len(self.keys) - 1)] == digests[left]
            more &= at < len(self.keys)
            left, at = left[more], at[more]
        return out


def _probe(name: str, default: str):
    def run(batches):
        digests = Digests(SparkFiles.get(name))
        for b in batches:
            lists = b.column("keys")
            n = b.num_rows
            inner = lists.flatten()
            row = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            found = digests.find(inner.field("digest").to_numpy(zero_copy_only=False).view(np.uint64), inner.field("key"))
            hit = np.flatnonzero(found >= 0)
            size, host = (inner.field(x).to_numpy(zero_copy_only=False)[hit] for x in ("size", "host_len"))
            best = np.full(n, -1, np.int64)
            order = np.lexsort((host, size))  # the longest rule is written last
            best[row[hit[order]]] = found[hit[order]]
            take = pa.array(best, pa.int64(), mask=best < 0)
            rules = digests.strings().take(take).cast(pa.string()) if len(digests.keys) else pa.nulls(n, pa.string())
            block = np.asarray(digests.block)[np.maximum(best, 0)].astype(bool) if len(digests.keys) else np.zeros(n, bool)
            verdicts = np.where(best < 0, default, np.where(block, "block", "allow"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("path"), rules, pa.array(verdicts.tolist(), pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return run


def possible_keys(lengths: list[int]) -> Column:
    """For columns host and path: every rule that could fit, as (key, host_len, size)."""
    parts = F.split("host", r"\.")
    tails = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    return F.flatten(F.transform(tails, lambda t: F.transform(sizes, lambda n: F.struct(F.concat(t, F.substring("path", F.lit(1), n)).alias("key"), F.length(t).alias("host_len"), (F.length(t) + n).alias("size")))))


def by_join(parsed: DataFrame, rules: DataFrame, lengths: list[int], default: str) -> DataFrame:
    """The same by an equi-join of possible keys with (rule, verdict): for lists of any size."""
    rows = parsed.withColumn("uid", F.monotonically_increasing_id())
    hits = rows.select("uid", F.explode(possible_keys(lengths)).alias("k")).join(rules, F.col("k.key") == F.col("rule"))
    best = hits.groupBy("uid").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("k.host_len").alias("h"), "rule", "verdict")).alias("best"))
    return rows.join(best, "uid", "left").select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits) and verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    table = normal(rules)
    lengths = sorted({len(r) - len(r.partition("/")[0]) for r in table})
    if sum(len(r) + 17 for r in table) > most_bytes:
        frame = spark.createDataFrame(list(table.items()), "rule string, verdict string")
        return by_join(parsed, frame, lengths, default).withColumnRenamed("id", id_col)
    name = f"url-digests-{uuid.uuid4().hex}"
    folder = os.path.join(SparkFiles.getRootDirectory(), f"{name}-made")  # the driver's own, gone when Spark stops
    os.makedirs(folder)
    write_digests(table, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    kind = parsed.schema["id"].dataType.simpleString()
    keys = F.transform(possible_keys(lengths), lambda k: F.struct(k["key"].alias("key"), F.xxhash64(k["key"]).alias("digest"), k["host_len"].alias("host_len"), k["size"].alias("size")))
    out = parsed.select("id", "host", "path", keys.alias("keys")).mapInArrow(_probe(name, default), f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
