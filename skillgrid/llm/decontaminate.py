"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the number of their distinct 5-word shingles. An item's sketch is its
bottom-k MinHash values, and k follows from the partition: with a containment of c, at most
n - ceil(c n) shingles are missing, so among the n - ceil(c n) + 1 smallest at least one is in a
document that contains the item. The sketches of a partition use k of its largest size, so no
item is missed. Long documents are probed with their whole shingle sets, which are never
sketched, and every candidate is verified by exact containment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, rolling, shingle_sets, word_hashes

MOST_SHINGLES = 2_000_000
WORDS, BITS = 5, 22


class ContainmentIndex:
    """Sketches and full sets of items, by size partition (powers of two)."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: int):
        self.ids, self.sets = ids, sets
        self.need = np.array([-(-percent * len(s) // 100) for s in sets], np.int64)
        values, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        size_class = np.array([len(s).bit_length() for s in sets], np.int64)
        for c in np.unique(size_class[size_class > 0]):
            members = np.flatnonzero(size_class == c)
            k = max(len(sets[i]) - self.need[i] + 1 for i in members)
            for i in members:
                ranks = mix(sets[i] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                values.append(sets[i][np.argsort(ranks)[: min(k, len(ranks))]])
                owners.append(np.full(len(values[-1]), i))
        values, owners = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(values, kind="stable")
        self.owners = owners[order]
        self.values, self.begin = np.unique(values[order], return_index=True)
        self.end = np.append(self.begin[1:], len(owners))
        self.may = np.zeros(1 << BITS, bool)  # which leading bits occur, before a value is looked up
        self.may[self.values >> np.uint64(64 - BITS)] = True

    def candidates(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``values`` and the items whose sketch holds that value."""
        at = np.flatnonzero(self.may[values >> np.uint64(64 - BITS)])
        k = np.searchsorted(self.values, values[at])
        own = self.values[np.minimum(k, len(self.values) - 1)] == values[at] if len(self.values) else np.zeros(len(at), bool)
        at, k = at[own], k[own]
        n = self.end[k] - self.begin[k]
        return np.repeat(at, n), self.owners[np.arange(n.sum()) + np.repeat(self.begin[k] - np.cumsum(n) + n, n)]

    def search(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(place of the text, item, shared shingles) of every item that a text contains."""
        hashes, first = word_hashes(texts, lower=True)
        n = np.diff(first)
        runs = rolling(hashes, WORDS)
        full = np.maximum(n - WORDS + 1, 0)
        text = np.repeat(np.arange(len(n)), full)
        at = np.arange(len(text)) + np.repeat(first[:-1] - np.cumsum(full) + full, full)
        short = np.flatnonzero((n > 0) & (n < WORDS))
        values = np.concatenate([runs[at], *(rolling(hashes[first[i] : first[i + 1]], int(n[i])) for i in short)])
        where, items = self.candidates(values)
        out, of, own = [], -1, None
        for i, item in np.unique(np.stack([np.append(text, short)[where], items], axis=1), axis=0).tolist():
            if i != of:
                of, own = i, next(shingle_sets(texts.slice(i, 1)))
            shared = len(np.intersect1d(own, self.sets[item], assume_unique=True))
            if shared >= self.need[item]:
                out.append((i, item, shared))
        return out


def contained_items(docs: DataFrame, items: DataFrame, *, percent: int = 75, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """Rows ``doc_id, item_id, n_item, n_shared, containment``: items of which a document holds
    at least ``percent`` per cent of the distinct 5-word shingles (A-Z lower-cased).

    A text under five words is one shingle, so an item that short is found in equal texts only; a
    null or empty one has none and is linked with nothing. Item rows that repeat are one item;
    documents that repeat give rows that repeat; empty tables give no row. Only ``doc_id``, ``item_id`` and
    ``text`` are read. The item table is searched in blocks of at most about ``most_shingles`` shingles,
    each of which is what a task holds, so a large item table takes more passes and never more memory.
    """
    texts = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (5 * most_shingles)))
    probes = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = []
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # bounded by most_shingles
        index = ContainmentIndex(np.array([r.item_id for r in rows], np.int64), list(shingle_sets(pa.array([r.text for r in rows], pa.string()))), percent)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    ids = part.column("doc_id")
                    out = [(ids[i].as_py(), int(index.ids[k]), len(index.sets[k]), n, n / len(index.sets[k])) for i, k, n in index.search(part.column("text"))]
                    cols = zip(*out, strict=True) if out else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

        parts.append(probes.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long, containment double"))
    return reduce(DataFrame.unionByName, parts)


def remove_contaminated(docs: DataFrame, items: DataFrame, *, percent: int = 75) -> DataFrame:
    """Rows of ``docs`` that contain no item; all their columns, and rows with a null doc_id or text, stay.

    Rows that share a doc_id are judged one by one.
    """
    hit = contained_items(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text")), items, percent=percent)
    hit = hit.select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, F.xxhash64(docs["doc_id"], docs["text"]) == hit["__hit"], "left_anti")
