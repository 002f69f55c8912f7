"""Periodic runs of words, by longest common extensions on suffix trees.

A run with exponent ``e`` (4 here) and smallest period ``q`` has, in each place but its first ``q``, a
word that occurred at most ``q`` words before. So, for every power of two ``D``, only stretches of
places whose last occurrence is at most ``D`` back, and that are long enough for a period over ``D / 2``,
can hold a run; with ``D`` words before them and one beyond, they are the blocks of a document that are
searched. Everything outside is no part of a run.

Blocks get a Ukkonen suffix tree, and one of their reversal. Leaves in the order of the tree, with words
ascending and descending, give the longest Lyndon word from each place under both orders: it ends before
the next smaller suffix. Those words are the candidate roots (every run has a root among them). A root is
extended to both sides by the longest common extension, forwards in the one tree and backwards in the
other, which is the depth of the lowest common ancestor: a range minimum over the tree's Euler tour, in
constant time, for all candidates of a document at once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, fresh, mix, word_hashes, word_places

_SLICE = 4 << 20  # bytes of text that are worked on at once; a longer text is worked on alone
_TREE = 1 << 15  # words of blocks that share a tree; a longer block has its own


class RangeMinimum:
    """Constant-time minimum over a range of a fixed array: sparse table over blocks, running minima within them."""

    SIZE = 16

    def __init__(self, values: np.ndarray):
        n = max(1, -(-len(values) // self.SIZE)) * self.SIZE
        self.grid = np.full(n, np.iinfo(np.int32).max, np.int32)
        self.grid[: len(values)] = values
        grid = self.grid.reshape(-1, self.SIZE)
        self.left = np.minimum.accumulate(grid, axis=1).ravel()
        self.right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last, np.concatenate([last[step:], np.full(step, np.iinfo(np.int32).max, np.int32)])))

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of each closed range."""
        a, b = lo // self.SIZE, hi // self.SIZE
        out = np.minimum(self.right[lo], self.left[hi])
        own = np.flatnonzero(a == b)  # both ends in one block
        if len(own):
            x, y = lo[own], hi[own]
            low = self.grid[x]
            for _ in range(self.SIZE - 1):
                x = np.minimum(x + 1, y)
                low = np.minimum(low, self.grid[x])
            out[own] = low
        far = np.flatnonzero(b - a > 1)
        if len(far):
            first, width = a[far] + 1, b[far] - a[far] - 1
            level = np.frexp(width)[1] - 1
            for k in np.unique(level):
                own = level == k
                at, row = far[own], self.table[k]
                out[at] = np.minimum(out[at], np.minimum(row[first[own]], row[first[own] + width[own] - (1 << int(k))]))
        return out


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of small whole numbers that ends with one that occurs nowhere else.

    Numbers under ``marks`` occur once each, and stay the smallest in either order.
    """

    def __init__(self, s: list[int], marks: int):
        n, width = len(s), max(s) + 1
        begin, stop, link = array("l", [0]), array("l", [0]), array("l", [0])
        edges: dict[int, int] = {}
        get = edges.get
        node = edge = length = rest = 0
        for i in range(n):
            c = s[i]
            rest += 1
            made = 0
            while rest:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = get(key)
                if child is None:
                    edges[key] = len(begin)
                    begin.append(i)
                    stop.append(n)
                    link.append(0)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    at = begin[child]
                    size = stop[child] - at
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[at + length] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    split = len(begin)
                    edges[key] = split
                    begin.append(at)
                    stop.append(at + length)
                    link.append(0)
                    edges[split * width + c] = split + 1
                    begin.append(i)
                    stop.append(n)
                    link.append(0)
                    begin[child] = at + length
                    edges[split * width + s[at + length]] = child
                    if made:
                        link[made] = split
                    made = split
                rest -= 1
                if node == 0 and length:
                    length -= 1
                    edge = i - rest + 1
                elif node:
                    node = link[node]
        self.n = n
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        children = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)
        keys, nodes = keys[order], np.arange(len(begin) + 1)
        self.children = children[order].tolist()
        self.first = np.searchsorted(keys, nodes * width).tolist()
        self.words = np.searchsorted(keys, nodes * width + marks).tolist()  # where a node's children by words begin
        self.size = (np.frombuffer(stop, np.int64) - np.frombuffer(begin, np.int64)).tolist()

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """String depths along the Euler tour, and where in it the leaf of each suffix is; children ascending."""
        first, children, size, n = self.first, self.children, self.size, self.n
        depth = [0] * len(size)
        leaf = [0] * n
        out: list[int] = []
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:
                out.append(depth[~v])
                continue
            d = depth[v]
            lo, hi = first[v], first[v + 1]
            if lo == hi:
                leaf[n - d] = len(out)
            else:
                for u in reversed(children[lo:hi]):
                    depth[u] = d + size[u]
                    stack.append(~v)
                    stack.append(u)
            out.append(d)
        return np.array(out, np.int32), np.array(leaf, np.int64)

    def descending(self) -> list[int]:
        """Rank of each suffix when words are ordered the other way round; a suffix still comes before what it begins."""
        first, words, children, size, n = self.first, self.words, self.children, self.size, self.n
        rank = [0] * n
        at = 0
        stack = [(0, 0)]
        while stack:
            v, d = stack.pop()
            lo, hi = first[v], first[v + 1]
            if lo == hi:
                rank[n - d] = at
                at += 1
            else:
                mid = words[v]
                stack.extend([(u, d + size[u]) for u in children[mid:hi]])
                stack.extend([(u, d + size[u]) for u in children[lo:mid]])
        return rank


def next_smaller(rank: list[int]) -> list[int]:
    """For each place, the next one with a smaller rank; the length if there is none."""
    out = [len(rank)] * len(rank)
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def tree_runs(blocks: list[np.ndarray], exponent: int, shortest: int) -> list[tuple[int, int, int, int]]:
    """``block, start, length, period`` of every run of the blocks, whose words are hashes; one tree for all of them."""
    sizes = np.array([len(b) for b in blocks])
    _, words = np.unique(np.concatenate(blocks), return_inverse=True)
    # a mark of its own after each block; the last ends the whole. Marks are smaller than words, so that no Lyndon word passes one
    at = np.cumsum(sizes + 1) - 1
    symbols = np.empty(at[-1] + 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[at] = False
    symbols[at] = len(blocks) - 1 - np.arange(len(blocks))
    symbols[inside] = words + len(blocks)
    forward = SuffixTree(symbols.tolist(), len(blocks))
    depths, leaf = forward.tour()
    back_depths, back_leaf = SuffixTree([*symbols[:-1][::-1].tolist(), 0], len(blocks)).tour()
    ahead, behind = RangeMinimum(depths), RangeMinimum(back_depths)
    n, places = len(symbols), np.flatnonzero(inside)
    # leaves along the tour are in the order of suffixes; a root ends at its block's mark at most, which is smaller than all words
    ends = [np.array(next_smaller(rank), np.int64)[places] for rank in (leaf.tolist(), forward.descending())]
    start, end = np.concatenate([places, places]), np.concatenate(ends)

    def extension(rmq: RangeMinimum, leaves: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = leaves[i], leaves[j]
        return rmq.query(np.minimum(x, y), np.maximum(x, y)).astype(np.int64)

    right = extension(ahead, leaf, start, end)
    left = np.zeros(len(start), np.int64)
    has = start > 0
    # place k of the text is place n - 2 - k of the reversal, whose last is its own mark
    left[has] = extension(behind, back_leaf, n - 2 - (start[has] - 1), n - 2 - (end[has] - 1))
    period = end - start
    begin, length = start - left, left + right + period
    good = (length >= exponent * period) & (length >= shortest)
    found = np.unique(np.stack([begin[good], length[good], period[good]], axis=1), axis=0)
    block = np.searchsorted(at, found[:, 0])
    offset = found[:, 0] - np.where(block > 0, at[block - 1] + 1, 0)
    return list(zip(block.tolist(), offset.tolist(), found[:, 1].tolist(), found[:, 2].tolist(), strict=True))


def suspects(hashes: np.ndarray, first: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the blocks, over the words of several texts, that can hold a run; see the module's text."""
    n = len(hashes)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    back = np.full(n, np.iinfo(np.int64).max, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    longest = int(np.diff(first).max(initial=0))
    begins, ends = [], []
    reach = 1
    while exponent * (reach // 2 + 1) <= longest:
        low = reach // 2 + 1  # the least period of this reach
        near = np.zeros(n + 2, np.int8)
        near[1:-1] = back <= reach
        edge = np.diff(near)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a >= max(shortest - reach, (exponent - 1) * low)
        a, b = a[long], b[long]
        begins.append(np.maximum(a - reach - 1, first[owner[a]]))
        ends.append(np.minimum(b + 1, first[owner[a] + 1]))
        reach *= 2
    if not begins:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    if not len(a):
        return a, b
    fresh = np.concatenate([[True], (a[1:] >= b[:-1]) | (owner[a[1:]] != owner[a[:-1]])])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(a) - 1]])
    return a[fresh], b[last]


def runs_of(texts: pa.Array, exponent: int = 4, shortest: int = 6) -> tuple[list[list[tuple[int, int, int]]], pa.Array]:
    """For each text its runs (``start, length, period``, sorted by start and period), and its words that are kept, joined by one space."""
    hashes, first = word_hashes(texts, lower=False)
    a, b = suspects(hashes, first, exponent, shortest)
    owner = np.searchsorted(first, a, "right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    lo = 0
    while lo < len(a):
        hi = lo + 1
        size = b[lo] - a[lo]
        while hi < len(a) and size + b[hi] - a[hi] <= _TREE:
            size += b[hi] - a[hi]
            hi += 1
        for block, start, length, period in tree_runs([hashes[x:y] for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), strict=True)], exponent, shortest):
            doc = int(owner[lo + block])
            out[doc].append((int(a[lo + block] - first[doc]) + start, length, period))
        lo = hi
    gone = np.zeros(len(hashes) + 1, np.int64)
    for doc, found in enumerate(out):
        found.sort(key=lambda r: (r[0], r[2]))
        for start, length, period in found:
            gone[first[doc] + start + period] += 1
            gone[first[doc] + start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    raw, bounds = bytes_of(texts)
    begins, ends, _ = word_places(raw, bounds)
    begins, ends = begins[keep], ends[keep]
    doc = np.repeat(np.arange(len(texts)), np.diff(first))[keep]
    inner = np.concatenate([doc[1:] == doc[:-1], [False]]) if len(doc) else np.zeros(0, bool)
    # a kept word takes the byte after it along, as its space, unless it is its text's last
    edge = np.zeros(len(raw) + 2, np.int8)
    edge[begins] += 1
    edge[ends + inner] -= 1
    mask = np.cumsum(edge)[: len(raw)] > 0
    spaced = raw.copy()
    spaced[ends[inner]] = 0x20
    lengths = np.bincount(doc, weights=ends - begins + inner, minlength=len(texts)).astype(np.int64)
    data = spaced[mask].tobytes()
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    kept = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return out, kept


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``_SLICE`` bytes of ``column``, one row at least."""
    sizes = np.diff(bytes_of(batch.column(column))[1])
    lo = 0
    while lo < len(sizes):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + 100_000]), _SLICE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def find_runs(docs: DataFrame, *, text: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """Add ``runs``, every maximal run of at least ``shortest`` words and ``exponent`` periods, and ``kept``, the text without repeats.

    Words are what stands between the white space \\x20 and \\x09-\\x0D. A run is a stretch of words with
    smallest period ``period`` that no neighbouring word extends; runs are sorted by start and period. ``kept``
    has the words that no run contains after its first period, joined by one space. A null, empty or blank
    text has no runs and an empty ``kept``. Rows that repeat are judged alike; an empty table gives no row.
    Whole texts are searched: a task holds one text's words and, of a text full of runs, its two trees
    (some 300 bytes a word). Other columns stay; those named like the new ones are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in ("runs", "kept")]
    (column,) = fresh(docs, "words")
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    read = docs.select(*map(quoted, rest), quoted(text).cast("string").alias(column))
    schema = T.StructType([*read.schema.fields[:-1], T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("kept", T.StringType(), False)])
    kind = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                found, kept = runs_of(part.column(column), exponent, shortest)
                runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), runs, kept.cast(pa.large_string()).cast(pa.string())], [*rest, "runs", "kept"])

    return read.mapInArrow(search, schema)
