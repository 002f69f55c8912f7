"""Sharding by jump consistent hashing: the key and the number of shards decide, with no ring table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, mix


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key by Lamping and Veach's jump consistent hash, all keys at once."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[jump[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of a long key; a null key counts as key 0."""

    @F.pandas_udf("int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump_hash(mix(keys.to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), shards))

    return of(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 24, rows_per_block: int = 50_000) -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 in its shard) and ``grown_shard`` (with one shard more).

    Slots are counted in two steps, so no task holds a whole shard: rows are dealt into blocks of a
    shard, ranked there by their columns, and a block starts where the blocks before it end. The
    block is of the whole row and of where it was read, so that neither a key nor a row that repeats,
    or a null key, fills one block; the rows are written with it, and a lost task finds the same.
    Only the block counts, one row for each ``rows_per_block`` rows and shard, meet in one place. A
    null key counts as key 0. Rows that repeat get slots of their own; an empty table gives no row.
    Columns named like the new ones are replaced.
    """
    kept = df.drop("shard", "slot", "grown_shard")
    block, rank, n, start, other, shard = fresh(kept, "block", "rank", "n", "start", "other", "in_shard")
    blocks = max(1, df.count() // (shards * rows_per_block) + 1)
    order = [F.col(f"`{c}`") for c, kind in kept.dtypes if not kind.startswith(("map", "variant"))]
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))
    placed = kept.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1), block: F.pmod(F.xxhash64(*order, spread), F.lit(blocks)).cast("int")})
    placed = Scratch(df.sparkSession).keep(placed)
    sizes = placed.groupBy("shard", block).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias(shard), F.col(block).alias(other), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy("shard", block).orderBy(*order)))
    out = ranked.join(starts, (F.col("shard") == F.col(shard)) & (F.col(block) == F.col(other)))
    return out.select(*(F.col(f"`{c}`") for c in kept.columns), "shard", (F.col(start) + F.col(rank) - 1).cast("long").alias("slot"), "grown_shard")
