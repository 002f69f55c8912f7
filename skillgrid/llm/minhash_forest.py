"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Documents with equal shingle sets are one class with one representative. A signature has 192
MinHash values of 16 bits; each of 48 trees is an order of eight of them. All trees are sorted by
their signatures in one distributed sort by ranges, so that the nodes of a tree are stretches of its
sorted rows and a node of any size is spread over as many tasks as it needs.

Depth adapts to the region. A node of depth three with at most ``most`` members is a region as it
is: all pairs in it are candidates, and regions found by several trees are compared once. In a
node with more members, a dense one, rows go down as far as they share a prefix with their
neighbours in the sorted order: of all its neighbours, in all trees, a member's candidate is the
one with the longest common prefix. A deeper prefix alone would lose links between the parts of
a dense node, so dense nodes then go an exact way in two steps.

First each member is compared with the node's pivot, the member that lies in the most dense nodes,
in chunks of bounded size. Dense nodes with members in common are then one cluster. Unless all
of a cluster is joined already, its members are dealt into blocks, of one component or of small
ones by size, and all pairs of blocks are compared but those of one component and those whose
sizes rule out a link. So a group around a base costs a few texts a member, and the work
grows with the square of a cluster's size only where its members stay apart.

Within a region only a spanning forest of the confirmed links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, forest, fresh, join_counted, mix, shingle_sets, sorted_groups

VALUES, DEPTH, TREES = 192, 8, 48
NODE = 3  # values that the members of a region share at least
_RNG = np.random.default_rng(20240501)
_SEEDS = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_ORDER = np.concatenate([_RNG.permutation(VALUES) for _ in range(TREES * DEPTH // VALUES)]).reshape(TREES, DEPTH)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the MinHash value under each multiplier."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(low, np.min(part[None, :] * _SEEDS[:, None], axis=1), out=low)
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sizes, keys, signs = [], [], []
            for own in shingle_sets(part.column("text")):
                sizes.append(len(own))
                digest = xxhash.xxh3_128_digest(own.tobytes())
                keys.append(np.frombuffer(digest, np.int64))
                signs.append(signature(own).tobytes() if len(own) else None)
            k = np.stack(keys) if keys else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "signature"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: ``key`` of the tree and its first three values, the next four in ``near``, the last one, and the representative."""
    salt = mix(np.arange(1, TREES + 1, dtype=np.uint64))
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            reps = part.column("rep").to_numpy()
            values = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)[:, _ORDER].astype(np.uint64)

            def packed(lo: int, hi: int, values: np.ndarray = values) -> np.ndarray:
                out = values[:, :, lo]
                for k in range(lo + 1, hi):
                    out = out << np.uint64(16) | values[:, :, k]
                return out

            key, near = mix(packed(0, NODE) ^ salt[None, :]), packed(NODE, DEPTH - 1)
            yield pa.RecordBatch.from_pydict({"key": key.ravel().view(np.int64), "near": near.ravel().view(np.int64), "last": values[:, :, DEPTH - 1].ravel().astype(np.int32), "rep": np.repeat(reps, TREES)})


def common_depth(keys: np.ndarray, near: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many values each row but the first has in common with the row before it; 0 where they differ within the first three."""
    apart = (near[1:] ^ near[:-1]).view(np.uint64)
    more = sum((apart >> np.uint64(16 * k) == 0).astype(np.int64) for k in range(DEPTH - NODE - 1))
    return np.where(keys[1:] == keys[:-1], NODE + more + ((apart == 0) & (last[1:] == last[:-1])), 0)


WHOLE, DENSE, EDGE = 0, 1, 2
_REGIONS = "region long, other long, key long, kind int, members array<long>, before array<long>, depths array<long>"


def _regions(most: int):
    """Rows for the nodes of a stretch of the sorted rows ``key, near, last, rep``.

    A node with at most ``most`` members is one ``WHOLE`` row, named by two hashes of its members. A ``DENSE`` one is
    a row for each ``most`` of its members, with the representative before each and the depth it shares with
    it. The first and the last node may go on in another task: up to ``most`` members they are an ``EDGE``
    row. Of a dense node a task holds no more than a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def add(key: int, node: np.ndarray, kind: int) -> None:
            if kind == WHOLE:
                members = np.sort(node[0])
                raw = xxhash.xxh3_128_digest(members.tobytes())
                a, b = np.frombuffer(raw, np.int64).tolist()
                rows.append((a, b, key, kind, members.tolist(), None, None))
            else:
                rows.append((None, None, key, kind, *(c.tolist() for c in node)))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, ["region", "other", "key", "kind", "members", "before", "depths"])

        none = np.empty((3, 0), np.int64)  # columns members, before, depths
        last, held, split, first = None, none, False, True  # the node that may go on in the next batch
        end = None  # the last row so far
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, near, low, reps = (batch.column(c).to_numpy() for c in ("key", "near", "last", "rep"))
            if end is None:
                end = (keys[:1] + 1, near[:1], low[:1], reps[:1])
            depths = common_depth(*(np.concatenate([e, c]) for e, c in zip(end, (keys, near, low), strict=False)))
            node = np.stack([reps, np.concatenate([end[3], reps[:-1]]), depths])
            end = tuple(c[-1:] for c in (keys, near, low, reps))
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(cuts)
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                key, members = int(keys[cuts[g]]), node[:, cuts[g] : cuts[g + 1]]
                if key != last:
                    if last is not None and (first or split or held.shape[1] > 1):
                        add(last, held, DENSE if split else EDGE if first else WHOLE)
                    first = first and last is None
                    last, held, split = key, members, False
                else:
                    held = np.concatenate([held, members], axis=1)
                while held.shape[1] > most:
                    add(key, held[:, :most], DENSE)
                    held, split = held[:, most:], True
            if rows:
                yield out()
        if held.shape[1]:
            add(last, held, DENSE if split else EDGE)
        if rows:
            yield out()

    return run


def _nodes(rows: DataFrame, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The forest's nodes: ``region, members`` of those with at most ``most`` members, and rows ``key, members, before, depths`` of dense ones."""
    order = ["key", "near", "last", "rep"]
    found = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_regions(most), _REGIONS))
    # nodes at the borders of tasks: at most two rows a task, put together where they are small
    size = F.size("members")
    edges = found.where(F.col("kind") == EDGE)
    total = found.where(F.col("kind") > WHOLE).groupBy("key").agg(F.sum(size).alias("n"))
    edges = scratch.keep(edges.join(total, "key").select("key", "members", "before", "depths", "n"), edges.count())
    small = edges.where(F.col("n").between(2, most)).groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("members"))
    small = small.select(F.xxhash64("members").alias("region"), F.xxhash64(F.lit(1), "members").alias("other"), "members")
    whole = found.where(F.col("kind") == WHOLE).select("region", "other", "members").unionByName(small)
    whole = whole.groupBy("region", "other").agg(F.first("members").alias("members")).select("region", "members")
    columns = ["key", "members", "before", "depths"]
    dense = found.where(F.col("kind") == DENSE).select(*columns).unionByName(edges.where(F.col("n") > most).select(*columns))
    return whole, scratch.keep(dense)


def linked_pairs(sets: list[np.ndarray], percent: int, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the sets with 100 * intersection >= percent * union, of all pairs or, with ``split``, of those with i < split <= j, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    keep = n[inverse] > 1
    columns, owner = place[inverse[keep]], owner[keep]
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    left = split or len(sets)
    shared = np.zeros((left, len(sets) - split), np.int64)
    width = 1 << 15
    for lo in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        a, b = np.searchsorted(columns, [lo, lo + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[a:b], columns[a:b] - lo] = 1
        shared += np.rint(dense[:left] @ dense[split:].T).astype(np.int64)
    union = sizes[:left, None] + sizes[None, split:] - shared
    linked = (100 * shared >= percent * union) & (shared > 0)
    i, j = np.nonzero(linked if split else np.triu(linked, 1))
    return i, j + split


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in sorted_groups(batches, ["region"]):
            reps, texts = rows.column("rep").to_numpy(), rows.column("text").combine_chunks()
            out_a, out_b = [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                i, j = linked_pairs(list(shingle_sets(texts.slice(lo, hi - lo))), percent)
                low = forest(hi - lo, i, j)
                own = np.flatnonzero(low != np.arange(hi - lo))
                out_a.append(reps[lo + own])
                out_b.append(reps[lo + low[own]])
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def _confirm_apart(percent: int):
    """Links between the labels of a region's members: of pairs from its two blocks, or of all pairs of its one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in sorted_groups(batches, ["region"]):
            blocks, labels, texts = rows.column("block").to_numpy(), rows.column("label").to_numpy(), rows.column("text").combine_chunks()
            out_a, out_b = [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                split = int(np.count_nonzero(blocks[lo:hi] == blocks[lo]))
                i, j = linked_pairs(list(shingle_sets(texts.slice(lo, hi - lo))), percent, split % (hi - lo))
                names, of = np.unique(labels[lo:hi], return_inverse=True)
                low = forest(len(names), of[i], of[j])
                own = np.flatnonzero(low != np.arange(len(names)))
                out_a.append(names[own])
                out_b.append(names[low[own]])
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def _sieved(base: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``base`` whose id may be a ``rep`` of ``members``, by a bitmap of 2^23 bits (at most 131,072 rows).

    Ids that only share a bit pass too; the join that follows drops them.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23))
    bits = members.select(bit("rep").alias("bit")).select(F.floor(F.col("bit") / 64).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
    words = bits.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    marked = base.withColumn("bit", bit("doc_id")).withColumn("word", F.floor(F.col("bit") / 64))
    return marked.join(F.broadcast(words), "word").where("mask & shiftleft(1L, cast(bit % 64 as int)) <> 0").select(*base.columns)


def _with_pivots(dense: DataFrame, scratch: Scratch, about: int) -> DataFrame:
    """Rows ``a, pivot, head``: each member of a dense node with the node's pivot and its smallest member, once."""
    members = scratch.keep(dense.select("key", F.explode("members").alias("rep")).groupBy("rep").agg(F.collect_list("key").alias("keys")), about)  # a key for each tree at most
    rows = members.select("rep", F.size("keys").alias("often"), F.explode("keys").alias("key"))
    pivots = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("often")).alias("often"), "rep"))["rep"].alias("pivot"), F.min("rep").alias("head"))
    return join_counted(rows, scratch.keep(pivots, about), ["key"], ["rep"]).select(F.col("rep").alias("a"), "pivot", "head").distinct()


def _neighbours(dense: DataFrame) -> DataFrame:
    """Rows ``a, b``: each member of a dense node and, of its neighbours in any tree, that with the longest common prefix (the smallest on ties)."""
    rows = dense.select(F.explode(F.arrays_zip("members", "before", "depths")).alias("r")).where("r.depths > 0")
    both = rows.select(F.explode(F.array(*[F.struct(F.col(f"r.{x}").alias("a"), F.col(f"r.{y}").alias("b"), F.col("r.depths").alias("depth")) for x, y in (("members", "before"), ("before", "members"))])).alias("p"))
    best = both.groupBy("p.a").agg(F.max(F.struct("p.depth", (-F.col("p.b")).alias("b"))).alias("best"))
    return best.select("a", (-F.col("best.b")).alias("b"))


def _chunks(pairs: DataFrame, most: int) -> DataFrame:
    """Rows ``region, rep``: each ``b`` with its ``a``, about ``most`` at a time."""
    n = pairs.groupBy("b").agg(F.count("*").alias("n"))
    dealt = join_counted(pairs, n, ["b"], ["a"]).select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / most)), F.lit("chunk")).alias("region"))
    return dealt.select("region", F.explode(F.array("a", "b")).alias("rep")).distinct()


def _apart(found: DataFrame, sizes: DataFrame, percent: int, most: int, scratch: Scratch, about: int) -> DataFrame:
    """Rows ``region, block, rep, label``: pairs of blocks over all members of a cluster that may link and are not of one component.

    ``found`` has the components of links (``linked``), which are the labels, and of dense nodes with members in common,
    the clusters. A block is about ``most`` members of about one size, of one large component or of several small ones.
    """
    of = lambda linked: F.max(F.when(F.col("linked") == F.lit(linked), F.col("component")))
    nodes = found.groupBy(F.col("node").alias("rep")).agg(of(False).alias("cluster"), of(True).alias("label")).where("cluster is not null")
    nodes = scratch.keep(nodes.select("cluster", "rep", F.coalesce("label", "rep").alias("label")), about)
    about = nodes.count()
    labels = scratch.keep(nodes.groupBy("cluster", "label").agg(F.count("*").alias("n")), about)
    split = labels.groupBy("cluster").agg(F.count("*").alias("labels")).where("labels > 1").select("cluster")
    named = labels.join(split, "cluster").select("cluster", "label", "n", F.when(F.col("n") >= most, F.col("label")).alias("one"))
    level = F.floor(F.log(F.col("high")) / F.lit(np.log(1.1).item())).alias("level")
    kind = [F.col("one").isNull().alias("mixed"), F.coalesce("one", F.lit(0)).alias("of")]
    members = scratch.keep(join_counted(nodes, scratch.keep(named, about), ["cluster", "label"], ["rep"], total=about).join(sizes, "rep").select("cluster", "rep", "label", "one", "low", "high", *kind, level), about)
    keys = ["cluster", "mixed", "of", "level"]
    filled = scratch.keep(members.groupBy(*keys).agg(F.count("*").alias("n")), about)
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / most)).alias("part")
    blocked = scratch.keep(join_counted(members, filled, keys, ["rep"]).select("cluster", "rep", "label", "one", "low", "high", F.struct(*keys, part).alias("block")), about)
    blocks = scratch.keep(blocked.groupBy("cluster", "block").agg(F.first("one").alias("one"), F.min("low").alias("low"), F.max("high").alias("high")), about)
    ways = 64  # so that the pairs of one cluster are no single task
    x = blocks.withColumn("way", F.pmod(F.xxhash64("block"), F.lit(ways)).cast("int")).alias("x")
    y = blocks.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).alias("y")
    near = (F.col("x.high") * 100 >= F.col("y.low") * percent) & (F.col("y.high") * 100 >= F.col("x.low") * percent)
    apart = F.col("x.one").isNull() | F.col("y.one").isNull() | (F.col("x.one") != F.col("y.one"))
    both = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.way") == F.col("y.way")) & (F.col("x.block") <= F.col("y.block")) & near & apart)
    both = both.select(F.xxhash64("x.block", "y.block").alias("region"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
    return both.join(blocked.select("block", "rep", "label"), "block").select("region", F.xxhash64("block").alias("block"), "rep", "label")


def near_duplicates(docs: DataFrame, *, percent: int = 75, most: int = 256) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id, kept`` of whole texts, A-Z lower-cased, 5-word shingles.

    Documents link when ``100 * intersection >= percent * union`` of their sets; ``component_id``
    is the smallest doc_id reachable. A text under five words is one shingle; a null text or one
    without words has none and links with nothing. Rows that repeat an id are one document. A
    row with a null doc_id links with nothing, has a null component and is kept. Very long texts are
    compared whole. An empty table gives no row; other columns, whatever their names, don't matter.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(base.mapInArrow(_sign, "doc_id long, n_shingles long, set_a long, set_b long, signature binary"))
    classes = signed.where("doc_id is not null and n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "signature")).alias("first"), F.count("*").alias("n"))
    total = signed.count()
    classes = scratch.keep(classes.select("set_a", "set_b", "n", F.col("first.doc_id").alias("rep"), F.col("first.signature").alias("signature")), total)

    trees = classes.select("rep", "signature").mapInArrow(_trees, "key long, near long, last int, rep long")
    whole, dense = _nodes(trees, most, scratch)

    def confirmed(members: DataFrame, docs: DataFrame, run) -> DataFrame:
        texts = docs.where("doc_id is not null").join(members.hint("merge"), F.col("doc_id") == F.col("rep")).select(*members.columns, "text")
        return texts.repartition("region").sortWithinPartitions(*members.columns).mapInArrow(run(percent), "a long, b long")

    members = whole.select("region", F.explode("members").alias("rep"))
    if dense.isEmpty():
        joined = components(confirmed(members, base, _confirm), scratch, about=total)
    else:
        many = dense.agg(F.sum(F.size("members"))).first()[0]
        pivots = scratch.keep(_with_pivots(dense, scratch, min(many, total)), many)
        first = scratch.keep(pivots.where("a <> pivot").select("a", F.col("pivot").alias("b")).unionByName(_neighbours(dense)), many)
        links = confirmed(members.unionByName(_chunks(first, most)), base, _confirm).withColumn("linked", F.lit(True))
        clusters = pivots.select("a", F.col("head").alias("b"), F.lit(False).alias("linked"))
        found = components(links.unionByName(clusters), scratch, by=("linked",), about=total)
        joined = found.where("linked").drop("linked")
        sizes = signed.where("doc_id is not null").groupBy(F.col("doc_id").alias("rep")).agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
        rest = scratch.keep(_apart(found, sizes, percent, most, scratch, total))
        more = scratch.keep(confirmed(rest, _sieved(base, rest), _confirm_apart).distinct(), total)
        if not more.isEmpty():
            joined = components(more.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch, about=total)

    # components go to the classes first, and from there to their members
    ids = classes.select("set_a", "set_b", "n", "rep").join(joined, F.col("rep") == F.col("node"), "left")
    ids = scratch.keep(ids.select("set_a", "set_b", "n", F.least(F.coalesce("component", "rep"), F.col("rep")).alias("component_id")), total)
    member = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    members = join_counted(signed.where(member).drop("signature"), ids, ["set_a", "set_b"], ["doc_id"]).select("doc_id", "n_shingles", "component_id")
    out = members.unionByName(signed.where(~member).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def one_of_each_group(docs: DataFrame, *, percent: int = 75) -> DataFrame:
    """Rows of ``docs`` but for those of a near-duplicate group that are not its document with the smallest doc_id.

    Rows are judged by id and text: rows that repeat both are one document, and another text under the
    same id is a document of its own. Rows with a null doc_id, and texts without words, stay. All columns
    stay, whatever their names; an empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession)
    (gone_id,) = fresh(docs, "gone")
    own = F.when(docs["doc_id"].isNotNull(), F.xxhash64(docs["doc_id"], docs["text"]))
    found = near_duplicates(docs.select(own.alias("doc_id"), docs["text"]), percent=percent)
    found = scratch.keep(found.where("doc_id is not null").select(F.col("doc_id").alias("own"), F.col("component_id").alias("group")).distinct())
    ids = docs.select(own.alias("own"), docs["doc_id"].alias("id")).where("own is not null").distinct()
    members = scratch.keep(found.join(ids, "own"))
    groups = scratch.keep(members.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct("id", "own")).alias("first")).where("n > 1"))
    gone = join_counted(members, groups, ["group"], ["own"]).where(F.col("own") != F.col("first.own")).select(F.col("own").alias(gone_id))
    return docs.join(gone, own == F.col(gone_id), "left_anti")
