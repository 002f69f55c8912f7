"""Each operator against a plain version: hot groups, nulls, ties, repeated rows, empty tables, long texts."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import cover_tree, decontaminate, language, line_dedup, minhash_forest, packing, quality, queries, quotes, sharding, substring_dedup
from skillgrid.llm.common import Scratch, components

from . import brute

VOCAB = [f"w{k}" for k in range(3000)]


def passage(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Exact and near copies, a shared passage in a third of the documents, short, long and empty texts."""
    rng = random.Random(5)
    shared, base = passage(rng, 40), passage(rng, 150)
    out = []
    for k in range(420):
        if k % 3 == 0:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
        elif k % 3 == 1:
            w = passage(rng, 30) + shared + passage(rng, rng.randint(0, 60))
        else:
            w = passage(rng, rng.randint(1, 120))
        lines = [" ".join(w[i : i + 12]) for i in range(0, len(w), 12)]
        out.append("\n".join(lines))
    out[5] = out[8]
    out[11] = out[8]
    out += ["", " \n\t ", "one two", "ONE two", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", " ".join(passage(rng, 20000)), None]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 7) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).cache()


def empty(docs):
    return docs.where("false")


def test_packing_round_trip(spark, docs, texts):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs, path, batch_ids=20_000).collect()
    wanted = {i: [*e.ids, 2] for (i, _), e in zip(texts, Tokenizer.from_file(path).encode_batch([t or "" for _, t in texts], add_special_tokens=False))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length
    for i, ids in wanted.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces[:-1])]))
        assert list(struct.unpack(f"<{len(ids)}I", b"".join(bytes(r.ids) for r in pieces))) == ids
        assert all(r.doc_tokens == len(ids) for r in pieces)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces[:-1])]))
        assert total <= 4096 and total & (total - 1) == 0  # never padded
    assert packing.pack_documents(empty(docs), path).count() == 0


def test_packing_steps():
    groups = packing.step_groups([4096] * 5 + [512] * 8 + [256], 8192)
    assert groups[:4] == [0, 0, 1, 1]
    assert sum(s for s, g in zip([4096] * 5 + [512] * 8 + [256], groups) if g == groups[4]) <= 8192


@pytest.mark.parametrize("least", [(2, 20), (4, 10_000), (1, 1)])
def test_line_dedup(docs, texts, least):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.longest_run, r.text) for r in line_dedup.dedup_lines(docs, *least).collect()}
    wanted = brute.line_runs(texts, *least)
    wanted[len(texts) - 1] = (0, 0, 0, 0, None)
    assert got == wanted
    assert sum(n for _, n, *_ in got.values()) > 0
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_line_dedup_of_runs_in_runs(spark):
    """Few different lines, so that runs overlap, nest and repeat inside one document; blank lines and odd white space."""
    rng = random.Random(31)
    texts = [(k, "\n".join(rng.choice(["a", "b", "a ", " b", "", "c\t", "d e"]) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    texts += [(100, "\n".join(["x"] * 70)), (101, "\n".join(["x"] * 33 + ["y"])), (102, "\n\n"), (103, "")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.longest_run, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute.line_runs(texts)


def test_line_dedup_stage_deletes_single_long_lines(spark):
    import corpus_pipeline

    long, short = " ".join(f"a{k}" for k in range(20)), " ".join(f"a{k}" for k in range(19))
    rows = [(1, f"one\n{long}\ntwo"), (2, f"three\n\n {long} \nfour"), (3, long), (4, f"{short}\nfive"), (5, f"six\n{short}"), (6, f"b\n{short} z\nc\n{short} z\nd"), (6, f"b\n{short} z\nc\n{short} z\nd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect())
    assert got == [rows[0], (2, "three\n\nfour"), rows[3], rows[4], *[(6, f"b\n{short} z\nc\nd")] * 2]


def test_line_dedup_keeps_repeated_rows_and_null_ids(spark):
    rows = [(1, "a\nb\nc", 1, "i", "k"), (1, "a\nb\nc", 2, "i", "k"), (None, "a\nb", 3, "i", "k"), (2, "x\na\nb", 4, "i", "k")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, ID string, found__0 string"))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "ID", "found__0", "n_lines", "n_removed", "n_runs", "longest_run"] and {r.ID for r in got} == {"i"}
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a\nb"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x")]


def test_stages_keep_columns_named_like_their_own(spark):
    import corpus_pipeline

    shared = "a b c d e f g h i j\nk l m n o p q r s t"
    rows = [(1, shared + "\nfirst one", "x", -1, "p"), (2, "own line\n" + shared, None, -2, None), (3, None, "y", -3, "q"), (None, "lost", "z", -4, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_chars long, kept string").withColumns({"n_removed": F.lit("n"), "component_id": F.lit("c"), "item_id": F.lit("i"), "signature": F.lit("s")})
    out = corpus_pipeline.line_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_lines, r.n_chars, r.n_removed) for r in out.collect()} == {1: (rows[0][1], "x", -1, "n"), 2: ("own line", None, 8, "n"), 3: (None, "y", -3, "n"), None: ("lost", "z", -4, "n")}
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.n_chars for r in out.collect()} == {-1, -3, -4}  # 16 of 20 shingles are in both texts
    bench = spark.createDataFrame([(1, "k l m n o p", "b")], "item_id long, text string, doc_id string")
    out = decontaminate.remove_contaminated(docs, bench)
    assert out.columns == docs.columns and sorted(r.n_chars for r in out.collect()) == [-4, -3]


def test_near_duplicates(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(docs, most=32).collect()}
    assert got == brute.near_duplicates(texts)
    assert minhash_forest.near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_of_a_hub_with_many_variants(spark):
    """12,000 variants link with the base, hardly with each other; others of the same family stay just apart from it."""
    rng = random.Random(12)
    base = passage(rng, 150)

    def variant(k, edits):
        w = list(base)
        for p in rng.sample(range(5, 145, 5), edits):  # each in five shingles of its own
            w[p] = f"v{k}p{p}"
        return " ".join(w)

    rows = [(k, variant(k, 4)) for k in range(12000)] + [(50000, " ".join(base))] + [(60000 + k, variant(60000 + k, 6)) for k in range(300)]
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {got[d] for d in got if d < 60000} == {0}
    assert all(got[d] == d for d in got if d >= 60000)


def test_near_duplicates_write_few_files(spark, docs, texts, tmp_path, monkeypatch):
    """Small tables aren't scattered over a file for each of many shuffle partitions, and stars take no further round."""
    folder = tmp_path / "shared"
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr("skillgrid.sources.scratch.shared_folder", lambda spark: str(folder))
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(docs, most=16).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute.near_duplicates(texts)
    tables = [len(list(p.glob("part-*"))) for p in folder.glob("scratch-*/*")]
    assert len(tables) > 10 and sum(n > 8 for n in tables) <= 4, tables


def test_exact_way_finds_links_that_no_neighbour_shows(spark, monkeypatch):
    """Twins in dense nodes, too far from all others: blocks are compared with blocks and with themselves."""
    rng = random.Random(14)
    base, rows, calls = passage(rng, 150), [], []
    for k in range(0, 240, 2):
        w = list(base)
        for p in rng.sample(range(5, 145, 5), 6):
            w[p] = f"v{k}p{p}"
        rows.append((k, " ".join(w)))
        w[147] = f"t{k}"
        rows.append((k + 1, " ".join(w)))
    plain = minhash_forest.components
    monkeypatch.setattr(minhash_forest, "components", lambda *a, **b: calls.append(1) or plain(*a, **b))
    monkeypatch.setattr(minhash_forest, "_neighbours", lambda dense: dense.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(minhash_forest, "_nodes", lambda rows, most, scratch, f=minhash_forest._nodes: tuple(d if k else d.where("false") for k, d in enumerate(f(rows, most, scratch))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=32).collect()}
    wanted = brute.near_duplicates(rows)
    assert len(calls) == 2 and all(wanted[k + 1][1] == wanted[k][1] for k in range(0, 240, 2))
    assert got == wanted


def test_linked_pairs_of_two_blocks():
    rng = random.Random(15)
    sets = [np.unique(np.array([rng.randint(0, 14) for _ in range(rng.randint(1, 12))], np.uint64)) for _ in range(60)]
    wanted = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(set(sets[i]) & set(sets[j])) >= 40 * len(set(sets[i]) | set(sets[j]))}
    assert set(zip(*(x.tolist() for x in minhash_forest.linked_pairs(sets, 40)), strict=True)) == wanted
    for split in (1, 25, 59):
        found = set(zip(*(x.tolist() for x in minhash_forest.linked_pairs(sets, 40, split)), strict=True))
        assert found == {(i, j) for i, j in wanted if i < split <= j}


def test_regions_come_whole_or_in_chunks_over_any_batches():
    """Small nodes are whole, larger ones come in chunks with the depth each row shares with the row before; border nodes are marked."""
    import pyarrow as pa

    rng = random.Random(13)
    rows = sorted((rng.choice([1, 2, 3, 3, 3, 3, 900 + k]), rng.choice([7, 7 << 16, 7 << 48]) + rng.randint(0, 1), rng.randint(0, 1), k) for k in range(400))
    whole, dense, edge = minhash_forest.WHOLE, minhash_forest.DENSE, minhash_forest.EDGE
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)

    def values(r):
        return [r[0], *((r[1] >> k) & 0xFFFF for k in (48, 32, 16, 0)), r[2]]

    def shared(r, s):
        same = next((k for k, (x, y) in enumerate(zip(values(r), values(s), strict=True)) if x != y), 6)
        return same + 2 if same else 0  # the key stands for three values

    ends = {rows[0][0], rows[-1][0]}
    wanted = []
    for key, v in by.items():
        for i in range(0, len(v), 60):
            members = [r[3] for r in v[i : i + 60]]
            kind = dense if len(v) > 60 else edge if key in ends else whole
            if len(v) > 1 or kind == edge:
                wanted.append((key, kind, sorted(members) if kind == whole else members))
    before = {r[3]: (rows[k - 1][3], shared(rows[k - 1], r)) for k, r in enumerate(rows) if k}
    for size in (1, 7, 1000):
        names = ["key", "near", "last", "rep"]
        batches = [pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows[i : i + size]], pa.int32() if n == "last" else pa.int64()) for k, n in enumerate(names)}) for i in range(0, len(rows), size)]
        out = [r for b in minhash_forest._regions(60)(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["key"], r["kind"], r["members"]) for r in out) == sorted(wanted)
        told = {m: (b, d) for r in out if r["before"] for m, b, d in zip(r["members"], r["before"], r["depths"], strict=True) if d}
        assert told and all(before[m] == t for m, t in told.items())
        assert {d for _, d in told.values()} >= {3, 8}
    assert list(minhash_forest._regions(60)(iter([]))) == []


def test_nodes_that_go_on_in_other_tasks_are_put_together(spark):
    """However the sorted rows are cut into tasks, each small node is one region and each large one is dense."""
    rows = [(key, k % 5, k % 3, 1000 * key + k) for key, n in ((1, 40), (2, 7), (3, 200), (4, 1), (5, 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "key long, near long, last int, rep long").repartition(5)
    for parts in (1, 3, 60):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            small, dense = minhash_forest._nodes(df, 60, Scratch(spark))
            assert sorted(tuple(sorted(r.members)) for r in small.collect()) == sorted(tuple(r[3] for r in rows if r[0] == key) for key in (1, 2, 5))
            found = [m for r in dense.collect() for m in r.members]
            assert sorted(found) == [r[3] for r in rows if r[0] == 3]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_neighbours_share_the_longest_prefix(spark):
    dense = spark.createDataFrame([(1, [10, 11, 12], [9, 10, 11], [0, 4, 8]), (2, [12, 10, 13], [5, 12, 10], [0, 6, 3])], "key long, members array<long>, before array<long>, depths array<long>")
    assert {r.a: r.b for r in minhash_forest._neighbours(dense).collect()} == {10: 12, 11: 12, 12: 11, 13: 10}


def test_one_of_each_group_judges_rows(spark):
    a, b = "a b c d e f g h", "some other words that are long enough"
    rows = [(0, a), (1, a), (1, b), (1, b), (None, a), (3, None), (4, ""), (5, b + " x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone__0": F.lit(1), "own": F.lit(2), "id": F.lit(3)})
    out = minhash_forest.one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)
    assert minhash_forest.one_of_each_group(docs.where("false")).count() == 0


def test_near_duplicates_null_ids_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "A B c d e f"), (4, "zz")]
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (3, 1, False), (4, 4, True)]


def test_substring_dedup(docs, texts):
    import hashlib

    for common in (1, 64):  # through single windows, and through automata
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs, common=common).collect()}
        assert got == brute.repeats(texts)
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0


def test_substring_dedup_of_periodic_texts_and_repeated_rows(spark):
    import hashlib

    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for k in range(40)]
    texts += [(50, "a b c d e " * 5), (51, "z " * 4000), (52, "é\u00a0x " * 30), (53, " ".join(f"k{k % 23}" for k in range(300)))]
    df = spark.createDataFrame([*texts, *texts[:5], *[texts[-2]] * 50], "doc_id long, text string").repartition(3)
    for common in (1, 64):
        rows = substring_dedup.remove_repeats(df, common=common).collect()
        assert len(rows) == len(texts) + 55
        assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows} == brute.repeats(texts)


def test_suffix_automaton_matching_statistics():
    rng = random.Random(1)
    automaton, before = substring_dedup.SuffixAutomaton(), []
    for _ in range(60):
        seq = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
        got = automaton.add(seq)
        for i in range(len(seq)):
            longest = max(n for n in range(i + 2) if n == 0 or any(seq[i + 1 - n : i + 1] == s[k : k + n] for s in [*before, seq[:i]] for k in range(len(s) - n + 1)))
            inner = max(n for n in range(i + 2) if n == 0 or any(seq[i + 1 - n : i + 1] == seq[k : k + n] for k in range(i + 1 - n)))
            assert got[i] == max(longest, inner)
        before.append(seq)


def test_cover_tree(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    vectors = [v.tolist() for v in base] + [(base[k % 7] + rng.normal(size=16) * 0.15).tolist() for k in range(200)] + [base[0].tolist()] * 90 + [(base[1] * 2).tolist()]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [None, 1.0], [1.0, 2.0], [2.0, 4.0], [float("inf")] * 16]
    rows = list(enumerate(vectors)) + [(None, base[0].tolist()), (3, base[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_vectors(df, block=50).collect()), key=lambda r: (r[0] is None, r))
    assert got == brute.near_vectors(rows)
    assert cover_tree.near_vectors(df.where("false")).count() == 0


def test_dual_traversal_prunes_and_misses_nothing():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    x = np.repeat(centres, 10, axis=0) + rng.normal(size=(400, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, tree = cover_tree.cover_tree(x)
    x = x[order]
    for level, radius in zip(tree, (1, 0.5, 0.25, 0.125)):
        assert (level.radius <= radius + 1e-12).all()
        for c, r, lo, hi in zip(level.centre, level.radius, level.row[:-1], level.row[1:]):
            assert lo <= c < hi and (cover_tree.distances(x[lo:hi], x[c : c + 1]) <= r + 1e-7).all()
    for cosine in (0.5, 0.9, 0.995, 0.9999):
        for same in (False, True):
            found = [(i, j) for part in cover_tree.dual_traversal(x, tree, x, tree, cosine, same) for a, b, c, d in zip(*(v.tolist() for v in part)) for i in range(a, b) for j in range(c, d)]
            if same:  # one order of each pair; a range with itself has both
                found = [p for p in {(min(p), max(p)) for p in found} if p[0] < p[1]]
            near = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= cosine)) if i < j or not same}
            assert set(found) == near and len(found) == len(near)


def test_tally_counts_ranges_with_class_sizes():
    tally = cover_tree.Tally(np.array([1, 4, 2, 1, 3]))
    tally.add(np.array([0]), np.array([2]), np.array([0]), np.array([2]))  # rows 0 and 1 with one another
    tally.add(np.array([1]), np.array([2]), np.array([3]), np.array([5]))  # row 1 with rows 3 and 4
    assert tally.links().tolist() == [4, 5, 0, 4, 4] and tally.joined().tolist() == [0, 0, 2, 0, 0]


def test_decontamination_judges_rows(spark):
    item = " ".join(f"q{k}" for k in range(12))
    docs = spark.createDataFrame([(1, "x " + item), (1, "clean text of another row"), (None, item), (2, None), (2, "")], "doc_id long, text string").withColumn("__hit", F.lit("mine"))
    bench = spark.createDataFrame([(7, item), (7, item), (8, "one two")], "item_id long, text string")
    out = decontaminate.remove_contaminated(docs, bench)
    assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "clean text of another row"), (None, item), (2, None), (2, "")], key=str)
    assert decontaminate.contained_items(docs.where("doc_id = 1"), bench).count() == 1
    assert decontaminate.remove_contaminated(docs.where("false"), bench).count() == 0 and decontaminate.remove_contaminated(docs, bench.where("false")).count() == 5


def test_decontamination(spark, docs, texts):
    rng = random.Random(9)
    items = [(0, texts[1][1]), (1, " ".join((texts[2][1] or "").split()[:9])), (2, "one TWO"), (3, None), (4, ""), (5, " ".join(passage(rng, 30))), (6, " ".join((texts[421 + 4][1]).split()[500:560]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (100, 2_000_000):  # in several blocks, and in one
        got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contained_items(docs, bench, most_shingles=most).collect()}
        assert got == brute.contained(texts, items)
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, *_ in got})
    assert decontaminate.contained_items(docs, bench.where("false")).count() == 0


def test_sharding(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"))
    got = sharding.assign_shards(rows, "doc_id", 24, rows_per_block=30).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 24
    moved = sum(r.grown_shard == 24 for r in got)
    assert 100 < moved < 320
    keys = np.array([0, 1, 2**63, 12345678901234567], np.uint64)
    assert sharding.jump_hash(keys, 24).tolist() == [brute.jump(int(k), 24) for k in keys]
    odd = spark.createDataFrame([(None,), (None,), (7,), (7,)], "doc_id long")
    assert sharding.assign_shards(odd).count() == 4
    assert sharding.assign_shards(odd.where("false")).count() == 0
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("s").alias("__start"), F.lit("b").alias("block__0"), (F.col("id") % 3).alias("Rank__1"))
    out = sharding.assign_shards(hot, rows_per_block=5)
    assert out.columns == ["doc_id", "__start", "block__0", "Rank__1", "shard", "slot", "grown_shard"]
    got = out.collect()
    assert sorted(r.slot for r in got) == list(range(3000)) and {r["__start"] for r in got} == {"s"}


def test_quality(spark):
    rng = random.Random(2)
    good = [" ".join(passage(rng, 80)) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in passage(rng, 20)) for _ in range(150)]
    rows = [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "", None)], "doc_id long, text string, label int")
    model = quality.fit(df.where("doc_id % 3 <> 1"))
    out = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((out[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 1)
    assert all(0 <= s <= 1 for s in out.values()) and out[900] == out[901]
    assert len(model.rules) < 200 and model.describe()
    odd = [(k, t) for k, t in enumerate([None, "", "   ", "\n\n", "é È 12,5 % a\u00a0b", "x" * 5000, "one.\ntwo.\n two.\nTWO"])]
    texts = rows[:20] + rows[200:220] + [(1000 + k, t, None) for k, t in odd] + [(1, good[1], 1)] * 3
    plain = spark.createDataFrame(texts, "doc_id long, text string, letters__0 int").withColumn("__q_letters", F.lit("mine"))
    scored = quality.score(plain, model)
    assert scored.columns == ["doc_id", "text", "letters__0", "__q_letters", "score"]
    assert all(abs(r.score - brute.quality(r.text, model)) < 1e-9 and r["__q_letters"] == "mine" for r in scored.collect()) and scored.count() == len(texts)
    small = quality.fit(df, sample=40)
    assert quality.fit(df.repartition(3), sample=40) == small  # which rows are learnt from doesn't depend on tasks
    flat = quality.fit(df.where("label = 1"))
    assert all(0 <= r.score <= 1 for r in quality.score(df, flat).collect())
    assert all(0 <= r.score <= 1 for r in quality.score(df, quality.fit(df.where("false"))).collect())


def test_language(spark):
    rng = random.Random(4)
    words = {"en": ["the", "and", "thing", "with", "other"], "de": ["der", "und", "schein", "über", "nicht"], "fr": ["le", "éau", "être", "avec", "dans"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(list(words) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "en"), (902, "", None)], "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 4 <> 2"))
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, model).collect()}
    assert all(out[i][0] == k for i, _, k in rows)
    assert out[900] == out[901] == out[902] == ("und", 0.0)
    far = {r.doc_id: r.lang_pred for r in language.identify(df, model, reject_below=1.1).collect()}
    assert set(far.values()) == {"und"}
    texts = [(k, t) for k, t in enumerate([rows[0][1], rows[0][1], rows[1][1], "über der schein " * 3000, "the", "Être ÉAU", "日本", "a"])]
    near = language.identify(spark.createDataFrame(texts, "doc_id long, text string").withColumns({"said__0": F.lit("mine"), "lang_pred": F.lit("old")}), model)
    assert near.columns == ["doc_id", "text", "said__0", "lang_pred", "score"]
    for r in near.collect():
        name, score = brute.language(r.text, model)
        assert r.lang_pred == name and abs(r.score - score) < 1e-4
    far = {r.doc_id: r.lang_pred for r in language.identify(df.unionByName(spark.createDataFrame([(950, "zzqx jjvk wwyp " * 9, None)], df.schema)), model, reject_far=True).collect()}
    assert far[950] == "und" and sum(far[i] == k for i, _, k in rows) >= 0.9 * len(rows)
    hot = df.unionByName(spark.createDataFrame([(5000 + k, rows[0][1], "en") for k in range(2000)], df.schema))
    assert set(language.fit(hot, per_language=20).languages) == set(words)
    rare = spark.range(900).select((F.col("id") % 300).alias("k"), "id").select(F.concat(F.lit("x"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("lang"), F.concat(F.sha2(F.col("k").cast("string"), 256), F.lit(" "), F.col("id").cast("string")).alias("text"))
    many, shuffled = language.fit(rare, clusters=1), language.fit(rare, clusters=1, small=10)  # every language is learnt, by both ways
    assert len(many.languages) == 300 and many.languages == shuffled.languages and np.array_equal(many.centroids, shuffled.centroids)
    assert language.identify(rare.withColumnRenamed("lang", "own"), many).where("own <> lang_pred").count() == 0
    none = language.identify(df, language.fit(df.where("false"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nsecond line"),
        (1, 1, "assistant", "> hello  THERE\n> second line\nmy answer"),
        (1, 2, "user", ">> Hello there\n> my answer\nthanks"),
        (1, 3, "user", "no quotes"),
        (1, 4, "user", None),
        (2, 0, "user", "> Hello there\nin another conversation"),
        (None, 5, "user", "> lost"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    assert got[1, 1].reply_to == 0 and got[1, 1].reply_path == [0, 1] and got[1, 1].text == "my answer"
    assert got[1, 2].reply_to == 1 and got[1, 2].reply_path == [0, 1, 2] and got[1, 2].max_level == 2 and got[1, 2].depth == 2
    assert got[1, 3].reply_path == [3] and got[1, 3].text == "no quotes"
    assert got[1, 4].text is None and got[1, 4].n_quoted == 0
    assert got[2, 0].reply_to is None and got[None, 5].reply_to is None
    assert quotes.link_quotes(df.where("false")).count() == 0
    chain = spark.createDataFrame([(1, k, f"line {k}" + (f"\n> line {k - 1}" if k else "")) for k in range(40)], "conv_id long, turn long, text string")
    assert max(r.depth for r in quotes.link_quotes(chain).collect()) == 39


def test_quotes_count_every_earlier_author(spark):
    rng = random.Random(21)
    rows = [(1, 0, "A\nB\nC\nD"), (1, 1, "A\nB\nC"), (1, 2, "> A\n> B\n> C\n> D"), (2, 0, "Hello\nreal"), (2, 1, "Hello\nother"), (2, 2, "> Hello\n> real"), (2, 3, "Hello\nreal"), (2, 4, "> real\n>> other\n>> Hello")]
    for conv in range(3, 40):
        for turn in range(20):
            rows.append((conv, turn, "\n".join(rng.choice(["", "> ", ">> "]) + rng.choice("abcdef") for _ in range(rng.randint(1, 5)))))
    wanted = {}
    for c, t, text in rows:
        quoted = [(x.count(">"), x.strip("> ")) for x in text.split("\n") if x.startswith(">")]
        least = {b: min(v for v, o in quoted if o == b) for _, b in quoted}
        found = []
        for d, u, other in rows:
            own = {x for x in other.split("\n") if not x.startswith(">")}
            hits = [b for _, b in quoted if b in own]
            if d == c and u < t and hits:
                found.append((-min(least[b] for b in hits), len(hits), u))
        wanted[c, t] = max(found)[2] if found else None
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert wanted[1, 2] == 0 and wanted[2, 2] == 0
    assert got == wanted


def test_quotes_by_passages(spark):
    """A quote that was wrapped otherwise links; common lines don't outweigh a passage; repeats, clashes and long texts are defined."""
    long = "\n".join(f"line {k} of a long text" for k in range(20000))
    wrapped = "\n".join("> " + " ".join(f"line {k} of a long text" for k in range(i, i + 100)) for i in range(0, 20000, 100))
    rows = [
        (1, 0, "A long passage wrapped here"),
        (1, 1, "something else"),
        (1, 2, "> A long   passage\n> WRAPPED here\nyes"),
        (2, 0, "first part\nof one thing\n\nsecond part"),
        (2, 1, "first part"),
        (2, 2, "> first part of\n> one thing\n>\n> second part\nso it is"),
        (3, 0, long),
        (3, 1, wrapped + "\nshort answer"),
        (3, 1, wrapped + "\nshort answer"),
        (4, 0, "one"),
        (4, 1, "> one\n>> two"),
        (4, 1, "written twice"),
        (4, 2, "> written\n> twice"),
        (4, None, "> one"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumns({n: F.lit(7) for n in ("of", "run", "unit", "passage", "conv__0", "line", "DEPTH")})
    out = quotes.link_quotes(df)
    assert out.count() == len(rows) and {"of", "run", "unit", "passage", "conv__0", "line"} <= set(out.columns)
    got = defaultdict(set)
    for r in out.collect():
        got[r.conv_id, r.turn].add(r.reply_to)
    assert got[1, 2] == {0} and got[2, 2] == {0} and got[3, 1] == {0} and got[4, 1] == {0} and got[4, 2] == {1} and got[4, None] == {None}


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(600, 700)] + [(3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert {got[k] for k in range(101, 181)} == {100} and {got[k] for k in range(600, 700)} == {500} and 3 not in got


def test_components_of_several_graphs_in_the_same_rounds(spark):
    scratch = Scratch(spark)
    links = [("x", k, k + 1) for k in range(100, 180)] + [("y", 100, k) for k in range(101, 150)] + [("y", 7, 170)]
    got = {(r.g, r.node): r.component for r in components(spark.createDataFrame(links, "g string, a long, b long"), scratch, by=("g",)).collect()}
    assert got == {("x", k): 100 for k in range(100, 181)} | {("y", k): 100 for k in range(100, 150)} | {("y", 7): 7, ("y", 170): 7}
    scratch = Scratch(spark)
    assert components(spark.createDataFrame([(1, k) for k in range(2, 50)], "a long, b long"), scratch).count() == 49
    assert scratch.count == 2  # the links and one look at the nodes: stars take no round


def test_pipeline(spark, texts, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    junk = [(1000 + k, " ".join(w.upper() + "!!" for w in passage(rng, 30)), "en", "s", 9) for k in range(120)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + junk, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i, t in texts if t and len(t.split()) > 8] + [(i, 0, 0) for i, *_ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, texts[2][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    from pyspark.sql import Row  # noqa: F401

    now, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.columns
            now = Scratch(spark).keep(now)
            seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert not any(i in seen["quality classifier"] for i, *_ in junk)
    lines = brute.line_runs(list(seen["quality classifier"].items()))
    wanted = {i: (t if seen["quality classifier"][i] is not None else None) for i, (n, gone, *_, t) in lines.items() if gone == 0 or gone < n}
    assert seen["line dedup"] == wanted
    near = brute.near_duplicates(list(wanted.items()))
    assert set(seen["minhash near-dedup"]) == {i for i, (_, c) in near.items() if c == i}
    hit = {d for d, *_ in brute.contained(list(seen["minhash near-dedup"].items()), [(0, texts[2][1])])}
    assert set(seen["benchmark decontamination"]) == set(seen["minhash near-dedup"]) - hit and hit
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == set(seen["benchmark decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_held_out_accuracy(spark):
    """On whole tables of the small scale: what the queries predict for documents they did not learn from."""
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality")
    right = queries.op3_quality(spark, base).where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.97
    langs = spark.read.parquet(f"{base}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    right = queries.op8_language_id(spark, base).where("held_out and lang_pred <> 'und'").join(langs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.95


def test_folds():
    assert zlib.crc32(b"17") % 3 in (0, 1, 2)


ODD = ["don't L'été <|endoftext|> ABC<|startoftext|>x", "a\x1cb c\x85d", "Ünïcödé ÀÉ İstanbul ΣΑΣ", "x\u0301y e\u0301", "1234 5,6.7% £5 ½ ²", "'s't a'b it's", "\u00a0a\u2003b", "日本語 текст", "<| x |> <|y|>", "ÿþð÷×ß --a--b--", "", " \n\t ", "y" * 5000]


def test_chunk_ids_equal_the_whole_tokenizer():
    ids = packing.ChunkIds(queries.tokenizer_path(), most=40)  # tables turn over all the time
    assert ids.plain
    rng = random.Random(11)
    letters = "abcxyzABCéßñüÀ0189.,;-_'!?&$<|>\u0301"
    made = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(60)]
    for texts in (ODD, made[:25], made[20:], ODD + made):
        want = [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in ids.of(texts)] == want
    assert len(ids.words) <= 40


def test_chunk_ids_of_a_vocabulary_that_disagrees_use_the_whole_tokenizer():
    ids = packing.ChunkIds(queries.tokenizer_path())
    ids.plain = False
    assert [x.tolist() for x in ids.of(ODD)] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
