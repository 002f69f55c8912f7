"""Substring dedup by suffix automata over shards of the corpus.

A window is ``window`` consecutive words. Its anchor is the smallest 5-gram hash inside it, so
equal windows have equal anchors, whatever surrounds them. Neighbouring windows with one anchor
make one context, and only anchors that occur twice or more can belong to a repeated window.

Contexts are first put together by anchor and words, before anything is dealt out: every copy of
a whole context but the first goes without its words being looked at. What is left are the first
places of different contexts with one anchor, as at the ends of shared passages. They are a
shard: an automaton of the earlier contexts is grown in the order of documents while the later
ones stream over it, and the matching statistic of each position tells whether the window that
ends there started earlier. A shard with more than ``common`` members would be too much for one
task; its members are dealt out again by the hash of each window, as automata of one window each,
and the first copy is found by a pre-aggregated minimum.

The whole corpus is its own reference, so automata of all of it have no size bound and cannot be
broadcast; dealing contexts and automata to tasks by anchor is the same search with bounded
memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, join_counted, mix, rolling, sorted_groups, word_hashes, word_places

GRAM = 5


class SuffixAutomaton:
    """Suffix automaton of a growing sequence of integers; a separator is any number that never repeats."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0
        self.separator = -1

    def extend(self, symbol: int) -> int:
        """Add a symbol; returns the length of the longest suffix that also occurs earlier."""
        nexts, link, length = self.next, self.link, self.length
        cur, p = len(nexts), self.last
        nexts.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][symbol]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        return length[link[cur]]

    def separate(self) -> None:
        self.extend(self.separator)
        self.separator -= 1

    def add(self, symbols: list[int]) -> list[int]:
        """Matching statistics of a sequence against all before it, which it then joins."""
        self.separate()
        return [self.extend(s) for s in symbols]


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of every ``span`` values in a row."""
    wide = 1
    while 2 * wide <= span:
        values = np.minimum(values[:-wide], values[wide:])
        wide *= 2
    return np.minimum(values[: len(values) - (span - wide)], values[span - wide :]) if span > wide else values


def window_hashes(grams: np.ndarray, at: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Hash of the window at each place, from the 5-grams that cover it."""
    out = np.zeros(len(at), np.uint64)
    for offset in [*range(0, window - GRAM, GRAM), window - GRAM]:
        out = out * np.uint64(seed) + grams[at + offset]
    return mix(out)


def contexts(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Anchor, hash of the words, text, first window and number of windows of each context.

    ``hashes`` are the words of several texts end to end, ``first`` tells where each text begins.
    """
    n = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    if not len(text):
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    at = np.arange(len(text)) + np.repeat(first[:-1] - np.cumsum(n) + n, n)
    grams = rolling(hashes, GRAM)
    anchor = least_of(grams, window - GRAM + 1)[at]
    # an anchor's place moves on when a smaller one comes in or when it drops out itself
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (grams[at[:-1]] == anchor[:-1]) | (text[1:] != text[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    low, high = (window_hashes(grams, at[k], window, 0xC2B2AE3D27D4EB4F) for k in (start, start + size - 1))
    words = mix(low * np.uint64(0x9E3779B97F4A7C15) + high + size.astype(np.uint64))
    return anchor[start], words, text[start], at[start] - first[text[start]], size


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                anchor, words, text, start, windows = contexts(*word_hashes(part.column("text"), lower=False), window)
                cols = {"anchor": anchor.view(np.int64), "same": words.view(np.int64), "doc_id": part.column("doc_id").to_numpy()[text], "body": part.column("body").to_numpy()[text]}
                yield pa.RecordBatch.from_pydict(cols | {"start": start.astype(np.int32), "windows": windows.astype(np.int32)})

    return run


def _shard_rows(window: int):
    """Contexts of a document as rows with their word hashes; those of very common anchors as single windows with two hashes."""
    names = ["key", "again", "doc_id", "body", "start", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                hashes, first = word_hashes(part.column("text"), lower=False)
                hits = part.column("hits")
                text = np.repeat(np.arange(len(part)), hits.value_lengths().to_numpy())
                start, windows, anchor, common = (hits.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "windows", "anchor", "common"))
                docs, bodies = (part.column(c).to_numpy()[text] for c in ("doc_id", "body"))
                grams = rolling(hashes, GRAM)
                for alone in (False, True):
                    own = np.flatnonzero(common == alone)
                    size = windows[own].astype(np.int64) if alone else windows[own] + (window - 1)
                    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    place = np.repeat(first[text[own]] + start[own], size) + k
                    if alone:
                        pick = np.repeat(own, size)
                        key, again = (window_hashes(grams, place, window, seed).view(np.int64) for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
                        cols = [key, again, docs[pick], bodies[pick], (start[pick] + k).astype(np.int32), pa.nulls(len(pick), pa.binary())]
                    else:
                        ends = np.append(0, np.cumsum(8 * size)).astype(np.int32)
                        words = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(hashes[place])])
                        cols = [anchor[own], pa.nulls(len(own), pa.int64()), docs[own], bodies[own], start[own], words]
                    if len(own):
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)

    return run


def _match(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in sorted_groups(batches, ["key"]):
            docs, bodies, starts = (rows.column(c).to_numpy() for c in ("doc_id", "body", "start"))
            words = rows.column("words").to_pylist()
            out: list[tuple[int, int]] = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                automaton = SuffixAutomaton()
                for k in range(lo, hi if hi - lo > 1 else lo):
                    if k > lo and (docs[k], bodies[k], starts[k]) == (docs[k - 1], bodies[k - 1], starts[k - 1]):
                        continue  # a row that repeats
                    match = automaton.add(np.frombuffer(words[k], np.uint64).tolist())
                    mask = sum(1 << (i - window + 1) for i in range(window - 1, len(match)) if match[i] >= window)
                    if mask:
                        out.append((k, mask))
            if out:
                at = np.array([k for k, _ in out])
                yield pa.RecordBatch.from_pydict({"doc_id": docs[at], "body": bodies[at], "start": starts[at], "mask": np.array([m for _, m in out], np.int32)})

    return run


def _keep_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, marks = part.column("text"), part.column("marks")
                _, _, first = word_places(*bytes_of(texts))
                text = np.repeat(np.arange(len(part)), marks.value_lengths().fill_null(0).to_numpy())
                start, mask = (marks.flatten().field(c).to_numpy() for c in ("start", "mask"))
                begins = np.concatenate([(first[text] + start + bit)[mask >> bit & 1 == 1] for bit in range(window - GRAM + 1)])
                edge = np.bincount(begins, minlength=first[-1] + 1) - np.bincount(begins + window, minlength=first[-1] + 1)
                keep = np.cumsum(edge[:-1]) == 0
                left = np.diff(np.append(0, np.cumsum(keep))[first])
                n, out = np.diff(first), []
                for value, lo, hi, rest in zip(texts, first[:-1].tolist(), first[1:].tolist(), left.tolist(), strict=True):
                    words = (value.as_py() or "").encode().split() if rest else []
                    out.append(b" ".join(words if rest == hi - lo else compress(words, keep[lo:hi].tolist())).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(n - left), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, common: int = 64) -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, kept``: every word goes that a window covers whose words also start earlier.

    Earlier: in a document with a smaller doc_id, or further up in the same one. Words are what
    stands between white space (\\x20, \\x09-\\x0D), unchanged, and ``kept`` joins the rest by
    one space. A null text has no words. Rows with a null doc_id are neither searched nor cut.
    Rows that repeat an id and text are one document: none removes the other; rows that repeat
    an id with another text are ordered by a hash of it. An empty table gives no row. ``common``
    is the number of occurrences from which an anchor's windows are dealt out one by one; the
    results don't depend on it. A task holds some hundred documents and their marks, which are
    fewer than their words.
    """
    if not GRAM < window <= 35:
        raise ValueError("window must be 6 to 35 words")
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = base.where("doc_id is not null and text is not null").withColumn("body", F.xxhash64("text"))
    place = F.struct("doc_id", "body", "start")

    found = scratch.keep(known.mapInArrow(_anchors(window), "anchor long, same long, doc_id long, body long, start int, windows int"))
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("same") < F.max("same")).alias("mixed"), (F.count("*") > common).alias("common")).where("n > 1")
    repeated = scratch.keep(join_counted(found, scratch.keep(anchors), ["anchor"], ["doc_id", "body", "start"]).drop("n"))
    scratch.drop(found)

    # a context's first place, before its copies are dealt out
    firsts = repeated.groupBy("anchor", "same", "windows", "mixed", "common").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    firsts = scratch.keep(firsts.select("anchor", "same", "windows", "mixed", "common", "n", "first.*"))
    origin = firsts.where("n > 1").select("anchor", "same", "n", F.struct("doc_id", "body", "start").alias("first"))
    copies = join_counted(repeated, origin, ["anchor", "same"], ["doc_id", "body", "start"]).where(place > F.col("first"))
    whole = copies.select("doc_id", "body", "start", F.expr("shiftleft(1, windows) - 1").alias("mask"))

    hits = firsts.where("mixed").groupBy("doc_id", "body").agg(F.collect_list(F.struct("start", "windows", "anchor", "common")).alias("hits"))
    rows = scratch.keep(known.join(hits, ["doc_id", "body"]).select("doc_id", "body", "text", "hits").mapInArrow(_shard_rows(window), "key long, again long, doc_id long, body long, start int, words binary"))
    shards = rows.where("words is not null").repartition("key").sortWithinPartitions("key", "doc_id", "body", "start")
    inside = shards.mapInArrow(_match(window), "doc_id long, body long, start int, mask int")

    single = rows.where("words is null").select("key", "again", "doc_id", "body", "start")
    origin = scratch.keep(single.groupBy("key", "again").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    late = join_counted(single, origin, ["key", "again"], ["doc_id", "body", "start"]).where(place > F.col("first")).select("doc_id", "body", "start", F.lit(1).alias("mask"))

    marks = whole.unionByName(inside).unionByName(late).groupBy("doc_id", "body").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    wide = base.withColumn("body", F.xxhash64("text")).join(marks, ["doc_id", "body"], "left").select("doc_id", "text", "marks")
    return wide.mapInArrow(_keep_words(window), "doc_id long, n_words long, n_removed long, kept string")
