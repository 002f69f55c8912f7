"""Helpers that the operators of this subpackage share.

Intermediate tables are written with ``Scratch``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    tail = next(f"__{k}" for k in range(len(taken) * len(names) + 1) if not any(f"{n}__{k}".lower() in taken for n in names))
    return [n + tail for n in names]


_BYTES = np.random.default_rng(20240117).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.frombuffer(_ASCII_LOWER, np.uint8)
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])  # white space: \x20 and \x09-\x0D
_SPAN = 1 << 18  # bytes that are hashed at once; longer words are hashed one by one
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(_SPAN - 1, _BASE, np.uint64)))
_INVERSES = np.cumprod(np.append(np.uint64(1), np.full(_SPAN - 1, pow(_BASE, -1, 1 << 64), np.uint64)))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each text begins, and the end; nulls are empty."""
    col = texts.cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = col.buffers()
    bounds = np.frombuffer(bounds, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def word_places(raw: np.ndarray, bounds: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word between the bytes ``between``, white space as a rule, and the number of the first word of each text, and the end."""
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(between[raw], out=inside[1:-1])
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[inside[cut] & inside[cut + 1]]  # two texts that touch
    begins[cut] = ends[cut] = True
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    return begins, ends, np.searchsorted(begins, bounds)


def word_hashes(texts: pa.Array, lower: bool, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of a string column, and the number of the first word of each text, and the end.

    The hash is a polynomial over a random table of the bytes, from running sums, so that no word
    becomes an object of its own; ``lower`` lower-cases A-Z only.
    """
    raw, bounds = bytes_of(texts)
    begins, ends, first = word_places(raw, bounds, between)
    table = _BYTES[_LOWER] if lower else _BYTES
    out = np.empty(len(begins), np.uint64)
    lo = 0
    while lo < len(begins):
        at = begins[lo]
        hi = int(np.searchsorted(ends, at + _SPAN, "right"))
        if hi <= lo:
            hi, word = lo + 1, raw[at : ends[lo]]
            out[lo] = xxhash.xxh3_64_intdigest((_LOWER[word] if lower else word).tobytes())
        else:
            sums = np.zeros(ends[hi - 1] - at + 1, np.uint64)
            np.cumsum(table[raw[at : ends[hi - 1]]] * _POWERS[: len(sums) - 1], out=sums[1:])
            b, e = begins[lo:hi] - at, ends[lo:hi] - at
            out[lo:hi] = mix((sums[e] - sums[b]) * _INVERSES[b] + (e - b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    return out, first


def words_of(text: str | bytes | None, lower: bool) -> list[bytes]:
    """Words between the white space \\x20 and \\x09-\\x0D; ``lower`` lower-cases A-Z only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return (raw.translate(_ASCII_LOWER) if lower else raw).split()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(word_hashes: np.ndarray, k: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``k`` words, in order."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64(seed | 1)
    out = word_hashes[:n].copy()
    for i in range(1, k):
        out *= factor
        out += word_hashes[i : i + n]
    return mix(out)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text, sorted distinct hashes of its k-word shingles; a shorter text is one shingle; no word: empty."""
    hashes, first = word_hashes(texts, lower=True)
    runs = rolling(hashes, k)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(runs[lo : hi - k + 1])
        else:
            yield rolling(hashes[lo:hi], hi - lo) if hi > lo else hashes[lo:hi]


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a partition that is sorted by ``keys``: tables and the bounds of their groups.

    A group that runs over several batches is put together before it is handed on.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        last = tuple(c[-1] for c in cols)
        if not len(cuts):
            held.append(batch)
            continue
        size = sum(b.num_rows for b in held)
        whole = pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
        inner = size + cuts
        if whole.num_rows:
            yield whole.combine_chunks(), np.concatenate([[0], inner[inner > 0]])
        held = [batch.slice(cuts[-1])]
    if held:
        whole = pa.Table.from_batches(held)
        if whole.num_rows:
            yield whole.combine_chunks(), np.array([0, whole.num_rows])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str], *, how: str = "inner", pieces: int = 1000, total: int | None = None) -> DataFrame:
    """Join (``inner`` or ``left``) of ``rows`` with ``groups``: one row for each key, with ``n``, the rows of that key.

    A key with more than one ``pieces``-th of all rows is dealt out by a hash of ``spread``, so that no
    task meets a hot key whole. There are fewer than ``pieces`` such keys, which bounds what is broadcast.
    """
    least = max(1, (rows.count() if total is None else total) // pieces)
    parts = F.ceil(F.col("n") / least).cast("int")
    hot = groups.where(F.col("n") > least).select(*keys, parts.alias("__parts"))
    salt = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("__parts"))).otherwise(0).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__parts")
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > least, parts - 1).otherwise(0))))
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


def components(edges: DataFrame, scratch: Scratch, by: tuple[str, ...] = (), about: int | None = None) -> DataFrame:
    """Connected components of the links ``a``-``b`` (longs): rows ``node, component`` (smallest id) of all linked nodes.

    With ``by``, links of different values there are graphs of their own, all solved in the same rounds.
    ``about`` is a rough number of links, as in ``Scratch.keep``.

    Alternating large-star and small-star rounds: each joins every node to the smallest node of
    its neighbourhood, so that chains shrink by half and hubs stay one row for each neighbour,
    dealt out over tasks. The rounds end when only stars are left, as the nodes' numbers of neighbours
    show. All state is in written tables; only counts come to the driver.
    """
    key = [*by, "a"]
    cur = scratch.keep(edges.where("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), about)
    about = 2 * cur.count()
    while True:
        both = cur.unionByName(cur.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.keep(both.groupBy(*key).agg(F.count("*").alias("n"), F.least(F.col("a"), F.min("b")).alias("low")), about)
        # in a star, every node but the smallest has one neighbour
        total, more = low.agg(F.sum("n"), F.bool_or(F.expr("low <> a and n > 1"))).first()
        if not more:
            scratch.drop(cur)
            return low.select(*by, F.col("a").alias("node"), F.col("low").alias("component"))
        # large star: every larger neighbour of a node goes to the smallest of the node's neighbourhood
        large = join_counted(both, low, key, ["b"], total=total).where("b > a").select(*by, F.col("b").alias("a"), F.col("low").alias("b"))
        large = scratch.keep(large, about)
        # small star: a node and its smaller neighbours go to the smallest of them, which large stars leave few of
        least = large.groupBy(*key).agg(F.min("b").alias("low"))
        small = large.join(least, key).select(*by, F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select(*by, "e.a", "e.b")
        new = scratch.keep(small.where("a <> b").distinct(), about)
        for done in (low, large, cur):
            scratch.drop(done)
        cur = new
