"""Embedding near-duplicates: exact cosine threshold pairs by dual traversal of cover trees.

Unit vectors at cosine c are sqrt(2 - 2 c) apart, so a cosine threshold is a radius. Equal vectors
are one class. The upper tree has a bounded number of cells, fitted on a bounded sample; every
vector goes to its nearest centre, and a cell's covering radius is measured over all its vectors.
Cells are cut into blocks that fit a task. A block has a cover tree of its own: nested levels
whose radii halve, each node with the covering radius of all below it. Pairs of cells, then of
nodes of two blocks level by level, are dropped when their centres are farther apart than both
covering radii and the threshold radius, and count whole when all their vectors are within it;
the members of what is left are compared in double precision. Blocks of one cell are cut by a hash, so
all blocks of two near cells meet, and what prunes there is their trees. So a group of near copies costs what
its nodes cost, not what its pairs would. The sample decides how much is pruned, never what is found.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, forest, join_counted, sorted_groups

SLACK = 1e-7  # over the rounding of distances from dot products


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


@dataclass
class Level:
    """Nodes of one level, in an order that puts the rows and the children of each node side by side."""

    centre: np.ndarray  # row of each node's centre
    radius: np.ndarray  # covering radius over all rows below it
    child: np.ndarray  # where each node's children begin at the next level (among rows, at the last), and the end
    row: np.ndarray  # where each node's rows begin, and the end


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are farther than ``radius`` apart, and for every row the place of one of them within ``radius``."""
    picked, at_picked, own = np.empty(len(x), np.int64), np.empty_like(x), np.empty(len(x), np.int64)
    n = 0
    for at in range(0, len(x), 512):
        rows = np.arange(at, min(at + 512, len(x)))
        if n:
            d = distances(x[rows], at_picked[:n])
            best = d.argmin(axis=1)
            covered = d[np.arange(len(rows)), best] <= radius
            own[rows[covered]] = best[covered]
            rows = rows[~covered]
        near, free = distances(x[rows], x[rows]) <= radius, np.ones(len(rows), bool)
        for k in range(len(rows)):
            if free[k]:
                hit = free & near[k]
                hit[k] = True
                own[rows[hit]], picked[n], at_picked[n] = n, rows[k], x[rows[k]]
                free &= ~hit
                n += 1
    return picked[:n], own


def cover_tree(x: np.ndarray, top: float = 1.0, levels: int = 4) -> tuple[np.ndarray, list[Level]]:
    """Nested nets whose radii halve from ``top``: an order for the rows, and the levels over rows in that order.

    Centres of a level are more than half its radius apart and are centres of the next level too;
    every row is within the radius of its node's centre, and ``Level.radius`` is what was measured.
    """
    nodes, nets = np.arange(len(x)), []
    for depth in reversed(range(levels)):
        picked, own = net(x[nodes], top / 2 ** (depth + 1))
        nodes = nodes[picked]
        nets.insert(0, (nodes, own))
    order, out = np.arange(len(nodes)), []
    for centre, own in nets:
        rank = np.argsort(order)[own]
        below = np.argsort(rank, kind="stable")
        out.append(Level(centre[order], np.empty(0), np.searchsorted(rank[below], np.arange(len(order) + 1)), np.empty(0)))
        order = below
    place, x = np.argsort(order), x[order]
    for k in reversed(range(levels)):
        level = out[k]
        level.centre = place[level.centre]
        level.row = level.child if k + 1 == levels else out[k + 1].row[level.child]
        to = np.repeat(level.centre, np.diff(level.row))
        d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, x[to]), 0))
        d[to == np.arange(len(x))] = 0
        level.radius = np.maximum.reduceat(d, level.row[:-1])
    return order, out


def _spread(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of ``nodes``, each with its parent's place in ``nodes``."""
    n = first[nodes + 1] - first[nodes]
    parent = np.repeat(np.arange(len(nodes)), n)
    return parent, np.arange(len(parent)) + np.repeat(first[nodes] - np.cumsum(n) + n, n)


def dual_traversal(a: np.ndarray, tree_a: list[Level], b: np.ndarray, tree_b: list[Level], cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of rows of ``a`` and of ``b`` (begin and end of each) of which every row links with every row.

    Every linked pair of rows is in exactly one pair of ranges; for a block with itself (``same``)
    pairs come in one order. A pair of nodes is dropped when its covering radii put all its rows out
    of reach, and handed on whole when they put all within reach; the rest goes down a level.
    """
    reach, most = float(np.sqrt(2 - 2 * cosine)), max(1, (1 << 23) // a.shape[1])

    def down(depth: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
        """Children of the pairs of nodes of level ``depth``, a bounded number at a time."""
        at, i = _spread(tree_a[depth].child, i)
        j = j[at]
        n = np.cumsum(tree_b[depth].child[j + 1] - tree_b[depth].child[j])
        cuts = np.searchsorted(n, np.arange(most, n[-1] if len(n) else 0, most))
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
            at, q = _spread(tree_b[depth].child, j[lo:hi])
            p = i[lo:hi][at]
            if same:
                p, q = p[p <= q], q[p <= q]
            yield from level(depth + 1, p, q)

    def level(depth: int, i: np.ndarray, j: np.ndarray, d: np.ndarray | None = None) -> Iterator[tuple]:
        if depth == len(tree_a):
            keep = (np.einsum("ij,ij->i", a[i], b[j]) >= cosine) & ((i != j) | (not same))
            i, j = i[keep], j[keep]
            yield i, i + 1, j, j + 1
            return
        p, q = tree_a[depth], tree_b[depth]
        if d is None:
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a[p.centre[i]], b[q.centre[j]]), 0))
        cover = p.radius[i] + q.radius[j]
        whole = d + cover <= reach - SLACK
        yield p.row[i[whole]], p.row[i[whole] + 1], q.row[j[whole]], q.row[j[whole] + 1]
        rest = ~whole & (d <= cover + (reach + SLACK))
        if rest.any():
            yield from down(depth, i[rest], j[rest])

    p, q = tree_a[0], tree_b[0]
    own, other, limit = a[p.centre], b[q.centre], q.radius + (reach + SLACK)
    for at in range(0, len(own), 512):
        d = distances(own[at : at + 512], other)
        i, j = np.nonzero(d <= p.radius[at : at + 512, None] + limit)
        d, i = d[i, j], i + at
        keep = i <= j if same else np.ones(len(i), bool)
        yield from level(0, i[keep], j[keep], d[keep])


class Tally:
    """Links of rows and who is joined with whom, from ranges of rows that link throughout."""

    def __init__(self, sizes: np.ndarray):
        self.sizes, self.before = sizes, np.append(0, np.cumsum(sizes))
        self.n, self.itself, self.chain = (np.zeros(len(sizes) + 1, np.int64) for _ in range(3))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, lo: np.ndarray, hi: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> None:
        itself = lo == lo_b
        for begin, end, other in ((lo, hi, self.before[hi_b] - self.before[lo_b]), (lo_b[~itself], hi_b[~itself], (self.before[hi] - self.before[lo])[~itself])):
            np.add.at(self.n, begin, other)
            np.add.at(self.n, end, -other)
            np.add.at(self.chain, begin, 1)
            np.add.at(self.chain, end - 1, -1)
        np.add.at(self.itself, lo[itself], 1)
        np.add.at(self.itself, hi[itself], -1)
        self.edges.append((lo[~itself], lo_b[~itself]))
        self.held += len(lo)
        if self.held > 2_000_000:
            low = self.joined()
            self.edges, self.held = [(np.arange(len(low)), low)], len(low)

    def links(self) -> np.ndarray:
        """Other vectors that each row links with; of its own class it counts none."""
        return np.cumsum(self.n)[:-1] - np.cumsum(self.itself)[:-1] * self.sizes

    def joined(self) -> np.ndarray:
        """The first row that each row is joined with."""
        next_too = np.flatnonzero(np.cumsum(self.chain)[:-1] > 0)
        i, j = (np.concatenate([e[side] for e in self.edges] + [next_too + side]) for side in (0, 1))
        return forest(len(self.sizes), i, j)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors and a 128-bit key of each; vectors that can't link have a null vector."""
    for batch in batches:
        keys, vecs = [], []
        for value in batch.column("embedding"):
            v = np.array(value.as_py() if value.is_valid else [], dtype=object)
            ok = len(v) > 0 and not any(c is None for c in v)
            v = v.astype(float) if ok else np.empty(0)
            if ok and np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
                v = v / top  # no overflow or underflow in the norm
                v = v / np.sqrt(v @ v) + 0.0
                vecs.append(v.tobytes())
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(vecs[-1]), np.int64))
            else:
                vecs.append(None)
                keys.append(np.zeros(2, np.int64))
        k = np.stack(keys) if keys else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(vecs, pa.binary())], ["vec_id", "key_a", "key_b", "vec"])


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _cells(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            size = np.array([len(v) // 8 for v in vecs])
            cell, far = np.zeros(len(vecs), np.int32), np.zeros(len(vecs))
            for dim, c in centres.items():
                rows = np.flatnonzero(size == dim)
                if len(rows):
                    d = distances(_matrix([vecs[r] for r in rows]), c)
                    cell[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), pa.array(cell), pa.array(far)], [*batch.schema.names, "dim", "cell", "far"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: its representatives, their class sizes, their vectors and their cover tree."""
    for rows, cuts in sorted_groups(batches, ["dim", "cell", "part"]):
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = rows.slice(lo, hi - lo)
            head = own.slice(0, 1)
            x = _matrix(own.column("vec").to_pylist())
            order, tree = cover_tree(x)
            blobs = [own.column(c).to_numpy().astype(np.int64)[order].tobytes() for c in ("rep", "n")] + [x[order].tobytes(), pickle.dumps(tree)]
            yield pa.RecordBatch.from_arrays(
                [head.column(c).combine_chunks() for c in ("dim", "cell", "part")] + [pa.array([v], pa.binary()) for v in blobs],
                ["dim", "cell", "part", "reps", "sizes", "vecs", "tree"],
            )


def _links(cosine: float):
    """Links of one pair of blocks, given as one row for each of the two, or as one row for a block with itself."""

    def run(pair: pa.Table) -> pa.Table:
        blocks = []
        for row in pair.to_pylist():
            sizes = np.frombuffer(row["sizes"], np.int64)
            blocks.append((np.frombuffer(row["reps"], np.int64), sizes, np.frombuffer(row["vecs"], np.float64).reshape(len(sizes), -1), pickle.loads(row["tree"])))
        (_, _, a, tree_a), (_, _, b, tree_b) = blocks[0], blocks[-1]
        same = len(blocks) == 1
        ids = np.concatenate([x[0] for x in blocks])
        tally, shift = Tally(np.concatenate([x[1] for x in blocks])), 0 if same else len(a)
        for lo, hi, lo_b, hi_b in dual_traversal(a, tree_a, b, tree_b, cosine, same):
            if len(lo):
                tally.add(lo, hi, lo_b + shift, hi_b + shift)
        n = tally.links()
        own = np.flatnonzero(n)
        return pa.table({"node": ids[own], "n": n[own], "other": ids[tally.joined()[own]] if len(own) else ids[own]})

    return run


def near_vectors(vectors: DataFrame, *, cosine: float = 0.9, block: int = 16384, most_cells: int = 512, sample: int = 4096) -> DataFrame:
    """Rows ``vec_id, n_links, component_id, kept``: links are pairs with at least this cosine (0 to 1).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    and so do vectors of different lengths. Rows with a null vec_id link with nothing, have a
    null component and are kept. Rows that repeat an id and vector count as one vector each.
    An empty table gives no row. ``sample`` bounds the vectors that the cells are fitted on, at most
    ``most_cells`` for each length; any number of lengths is allowed.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    unit = scratch.keep(base.mapInArrow(_unit, "vec_id long, key_a long, key_b long, vec binary"))
    classes = unit.where("vec is not null and vec_id is not null").groupBy("key_a", "key_b").agg(F.min(F.struct("vec_id", "vec")).alias("first"), F.count("*").alias("n"))
    classes = scratch.keep(classes.select("key_a", "key_b", F.col("first.vec_id").alias("rep"), "n", F.col("first.vec").alias("vec")))

    total, longest = classes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    # a block fits a task; with few vectors blocks are smaller, so that every core has pairs of blocks
    block = max(1, min(block, (8 << 20) // (longest or 1), max(256, -(-total // int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))))))
    cells = int(min(most_cells, max(1, total // (2 * block))))
    share = min(1.0, sample / max(total, 1))
    picked = classes.where(F.pmod("key_a", F.lit(1 << 20)) < int(share * (1 << 20))).select("vec").limit(2 * sample).collect()
    centres: dict[int, np.ndarray] = {}
    for dim in sorted({len(r.vec) // 8 for r in picked}):
        x = _matrix(sorted(r.vec for r in picked if len(r.vec) == 8 * dim))
        chosen = [0]
        near = distances(x, x[:1])[:, 0]
        while len(chosen) < min(cells, len(x)) and near.max() > 0:  # farthest first: a net whose radius shrinks
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distances(x, x[chosen[-1] :][:1])[:, 0])
        centres[dim] = x[chosen]
    placed = scratch.keep(classes.select("rep", "n", "vec").mapInArrow(_cells(centres), "rep long, n long, vec binary, dim int, cell int, far double"))
    cover = scratch.keep(placed.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("size")))
    known = F.col("dim").isin(list(centres))
    sizes = cover.where(known).collect()  # one row for each centre; a length that no centre has is one cell, and stays in tables
    reach = float(np.sqrt(2 - 2 * cosine))
    pairs = []
    for dim, c in centres.items():
        own = [r for r in sizes if r.dim == dim]
        gap = distances(c, c)
        pairs += [(dim, r.cell, s.cell) for r in own for s in own if r.cell <= s.cell and gap[r.cell, s.cell] <= r.radius + s.radius + reach + 2 * SLACK]
    count = F.ceil(F.col("size") / block).alias("parts")
    rows = placed.join(F.broadcast(cover.where(known).select("dim", "cell", count)), ["dim", "cell"])
    rows = rows.unionByName(placed.where(~known).join(cover.where(~known).select("dim", "cell", count), ["dim", "cell"]))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).select("dim", "cell", "part", "rep", "n", "vec")
    blocks = scratch.keep(dealt.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "rep").mapInArrow(_blocks, "dim int, cell int, part int, reps binary, sizes binary, vecs binary, tree binary"))

    pair_rows = spark.createDataFrame(pairs, "dim int, cell_a int, cell_b int").unionByName(cover.where(~known).select("dim", F.col("cell").alias("cell_a"), F.col("cell").alias("cell_b")))
    heads = blocks.select("dim", "cell", "part")
    tasks = pair_rows.join(heads.select("dim", F.col("cell").alias("cell_a"), F.col("part").alias("part_a")), ["dim", "cell_a"])
    tasks = tasks.join(heads.select("dim", F.col("cell").alias("cell_b"), F.col("part").alias("part_b")), ["dim", "cell_b"]).where("cell_a < cell_b or part_a <= part_b")
    sides = F.array_distinct(F.array(F.struct(F.col("cell_a").alias("cell"), F.col("part_a").alias("part")), F.struct(F.col("cell_b").alias("cell"), F.col("part_b").alias("part"))))
    both = tasks.withColumn("side", F.explode(sides)).select("*", "side.cell", "side.part").drop("side").join(blocks, ["dim", "cell", "part"])
    links = scratch.keep(both.groupBy("dim", "cell_a", "part_a", "cell_b", "part_b").applyInArrow(_links(cosine), "node long, n long, other long"))
    counts = links.groupBy("node").agg(F.sum("n").alias("n_other"))
    joined = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch).withColumnRenamed("node", "member")

    info = classes.select("key_a", "key_b", "rep", "n").join(counts, F.col("rep") == F.col("node"), "left").join(joined, F.col("rep") == F.col("member"), "left")
    links_of = (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).cast("long").alias("n_links")
    info = scratch.keep(info.select("key_a", "key_b", "n", links_of, F.least(F.coalesce("component", "rep"), "rep").alias("component_id")))
    ok = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    members = join_counted(unit.where(ok).select("vec_id", "key_a", "key_b"), info, ["key_a", "key_b"], ["vec_id"]).select("vec_id", "n_links", "component_id")
    rest = unit.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))  # they meet nothing
    return members.unionByName(rest).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
