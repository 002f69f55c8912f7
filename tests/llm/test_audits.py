"""Periodic runs, toxicity and source divergence against plain versions: hot groups, nulls, ties, repeated rows, empty tables, long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import divergence, oracles, periodic, queries, toxicity

SPACE = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


def runs_by_periods(w, exponent=4, shortest=6):
    """Every run, period by period."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        k = 0
        while k + q < n:
            begin = k
            while k + q < n and w[k] == w[k + q]:
                k += 1
            length = k - begin + q
            own = w[begin : begin + length]
            if k > begin and length >= max(shortest, exponent * q) and not any(own[r:] == own[: length - r] for r in range(1, q)):
                out.append((begin, length, q))
            k += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.fixture(scope="module")
def rhythmic():
    rng = random.Random(3)
    out = []
    for k in range(300):
        w = []
        for _ in range(rng.randint(1, 5)):
            root = [rng.choice("abcdé") for _ in range(rng.randint(1, 7))]
            w += root * rng.randint(1, 6) + root[: rng.randint(0, len(root))]
            w += [f"x{rng.randrange(60)}" for _ in range(rng.randint(0, 25))]
        out.append(rng.choice([" ", "\n", " \t "]).join(w) + rng.choice(["", " "]))
    verse = [f"v{rng.randrange(900)}" for _ in range(1500)]
    out += ["", " \n ", None, "a a a a a", "a a a a a a", "a b " * 4, " ".join(verse * 5 + ["end"]), "a a a a a a b a a a a a a", out[0]]
    return list(enumerate(out))


def test_runs_equal_plain_search(spark, rhythmic):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rhythmic], "doc_id long, text string, Kept int").repartition(3)
    found = periodic.find_runs(docs)
    assert found.columns == ["doc_id", "text", "runs", "kept"]  # the column that is named like a new one is replaced
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == len(rhythmic)
    for i, text in rhythmic:
        wanted = runs_by_periods(words_of(text))
        assert [tuple(r) for r in rows[i].runs] == wanted
        assert rows[i].kept == collapsed(words_of(text), wanted)
        assert rows[i].text == text
    assert any(len(r.runs) > 2 for r in rows.values())
    assert periodic.find_runs(docs.where("false")).count() == 0


def test_runs_across_trees(monkeypatch, rhythmic):
    """The same runs when every block has a tree of its own."""
    texts = pa.array([t for _, t in rhythmic[:100]])
    together = periodic.runs_of(texts)[0]
    monkeypatch.setattr(periodic, "_TREE", 1)
    assert periodic.runs_of(texts)[0] == together


def test_range_minimum():
    rng = np.random.default_rng(1)
    for n in (1, 15, 16, 17, 500):
        values = rng.integers(0, 50, n).astype(np.int32)
        lo = rng.integers(0, n, 400)
        hi = np.minimum(lo + rng.integers(0, n, 400), n - 1)
        assert periodic.RangeMinimum(values).query(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


def plain_digest(doc_id, text):
    w = words_of(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_periods(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())


def test_periodic_query(spark, rhythmic, tmp_path):
    rows = [(i * 7 + k, t) for k in range(7) for i, t in rhythmic if t is None or len(t) < 3000]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 100
    assert got == {i: plain_digest(i, t) for i, t in rows}


def divergences(rows, least=3, top=200):
    """The audit by its definition: every group with every kept term."""
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    seen, counts, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = {(lang, source) for lang, source, _ in terms}
    for lang, source, t in terms:
        seen[lang].update(set(t))
        counts[lang, source].update(t)
        whole[lang].update(t)
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = shares(counts[lang, source])
        for other in {s for code, s in groups if code == lang} - {source}:
            q = shares(counts[lang, other])
            out.append((lang, source, "pair", other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
        q = shares(whole[lang])
        out += [(lang, source, "term", t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, source][t] and p[t] > q[t]]
    parts = defaultdict(list)
    for row in out:
        parts[row[:3]].append(row)
    ranked = []
    for (_, _, part), own in parts.items():
        own.sort(key=lambda r: (-r[4], r[3].encode()))
        ranked += [(*r, k) for k, r in enumerate(own, 1) if part == "pair" or k <= top]
    return sorted(ranked)


@pytest.fixture(scope="module")
def sourced():
    """A hot text in many sources, a hot source, a language of one source, sources without kept terms, nulls."""
    rng = random.Random(11)
    vocabulary = [f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)] + ["Éa", "éa", "straße"]
    rows = [("en", f"s{k % 5}", "The hot TEXT, the text") for k in range(200)]
    for k in range(400):
        text = " ".join(rng.choice(vocabulary[: 20 + k % 130]) for _ in range(rng.randint(1, 40)))
        rows.append((rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s0", "s1", "s2", f"t{k % 7}"]), text))
    rows += [("xx", "only", "a a a b")] * 4 + [("yy", "p", "one"), ("yy", "q", "two"), ("yy", "q", None), (None, "s1", "a b c"), (None, None, "a b c"), ("", "", "a B c"), ("en", "empty", ""), ("en", None, "12 34"), ("de", "s0", "word " * 5000)]
    return rows


def test_divergence_equals_definition(spark, sourced):
    docs = spark.createDataFrame([(i, *r, 5) for i, r in enumerate(sourced)], "doc_id long, lang string, source string, text string, value int").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(docs).collect())
    assert got == divergences(sourced)
    assert sorted(tuple(r) for r in divergence.audit(docs, top=3, least_documents=1).collect()) == divergences(sourced, 1, 3)
    assert divergence.audit(docs.where("false")).count() == 0


def test_divergence_beyond_the_broadcast(spark, sourced, monkeypatch):
    docs = spark.createDataFrame(sourced, "lang string, source string, text string")
    monkeypatch.setattr(divergence, "_FEW", 0)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == divergences(sourced)


def test_divergence_sql(spark, sourced, tmp_path):
    import duckdb

    spark.createDataFrame(sourced, "lang string, source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = con.sql(f"SELECT lang, source, part, item, value, rank FROM ({oracles.oracle_sql()['op13_source_divergence']})").fetchall()
    assert sorted(got) == divergences(sourced)


def test_shares_are_exact_at_any_size(spark):
    big = [(0, 5, 3), (10**13, 10**14 + 7, 10**9), (8_999_999_999, 10**10, 17), (9_000_000_000, 10**10, 17), (0, 0, 0)]
    rows = spark.createDataFrame(big, "c long, t long, v long").select("c", "t", "v", divergence.share(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect()
    for r in rows:
        assert r.p == (None if r.v == 0 else 1 + 10**9 * (r.c + 1) // (r.t + r.v))


INSULTS = ["grobnik", "flarpo", "zutwen"]


@pytest.fixture(scope="module")
def judged():
    """Toxic texts have a few of three words that others lack; a sixth of all is unlabelled."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(["ba", "ko", "ri", "su", "né", "to"]) for _ in range(rng.randint(1, 4))) for _ in range(700)]
    rows = []
    for k in range(1500):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 90))]
        toxic = int(k % 5 == 0)
        for _ in range(rng.randint(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS) + rng.choice(["", ",", "!"]))
        rows.append((k, " ".join(w), None if k % 6 == 5 else toxic))
    return rows


def plain_features(text, ratios, unseen):
    w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return [0.0] * len(toxicity.FEATURES)
    own = [ratios.get(x, unseen) for x in w]
    over = [sum(x in ratios and ratios[x] > level for x in w) for level in toxicity.LEVELS]
    return [sum(own) / len(w), max(own), *(v / len(w) for v in over), *(math.log1p(v) for v in over), math.log1p(len(w))]


def plain_ratios(rows):
    """Ratios of all words by the definition of the two models, given the spelling's log-probabilities."""
    counts = {1: Counter(), 0: Counter()}
    for text, label in rows:
        counts[label].update(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    total = {c: sum(n.values()) for c, n in counts.items()}
    left = {c: toxicity.DISCOUNT * len(n) / total[c] for c, n in counts.items()}

    def ratio(word, log_chance):
        p = {c: max(counts[c][word] - toxicity.DISCOUNT, 0) / total[c] + left[c] * math.exp(log_chance) for c in counts}
        return math.log(p[1] / p[0])

    return ratio, math.log(left[1] / left[0]), set(counts[0]) | set(counts[1])


def plain_spelling(words):
    """Interpolated Kneser-Ney over the bytes of different words, by its definition."""
    raw, seen = defaultdict(Counter), defaultdict(set)
    for word in words:
        b = bytes([1]) + word.encode() + bytes([2])
        for i in range(1, len(b)):
            longest = min(i + 1, toxicity.ORDER)
            raw[longest][b[i + 1 - longest : i + 1]] += 1
            for k in range(2, longest + 1):
                seen[b[i + 2 - k : i + 1]].add(b[i + 1 - k : i + 1])
    counts = {k: Counter(raw[k]) for k in range(1, toxicity.ORDER + 1)}
    for gram, longer in seen.items():
        counts[len(gram)][gram] += len(longer)
    totals = {k: Counter() for k in counts}
    kinds = {k: Counter() for k in counts}
    for k, grams in counts.items():
        for gram, n in grams.items():
            totals[k][gram[:-1]] += n
            kinds[k][gram[:-1]] += 1

    def chance(gram):
        if not gram:
            return 1 / 257
        k, context = len(gram), gram[:-1]
        if not totals[k][context]:
            return chance(gram[1:])
        return max(counts[k][gram] - toxicity.DISCOUNT, 0) / totals[k][context] + toxicity.DISCOUNT * kinds[k][context] / totals[k][context] * chance(gram[1:])

    def log_chance(word):
        b = bytes([1]) + word.encode() + bytes([2])
        return sum(math.log(chance(b[max(0, i + 1 - toxicity.ORDER) : i + 1])) for i in range(1, len(b)))

    return log_chance


def test_toxicity_ratios_equal_definition(spark, judged):
    from skillgrid.llm.common import Scratch, word_hashes

    rows = [(t, y) for _, t, y in judged if y is not None]
    found, unseen = toxicity.word_ratios(spark.createDataFrame(rows, "text string, label long").repartition(5), Scratch(spark))
    got = {r.hash & (2**64 - 1): r.ratio for r in found.collect()}
    ratio, none, words = plain_ratios(rows)
    log_chance = plain_spelling(words)
    words = sorted(words)
    hashes, _ = word_hashes(pa.array(words), lower=True, between=toxicity.BREAK)
    assert len(got) == len(words) and unseen == pytest.approx(none)
    for word, h in zip(words, hashes.tolist(), strict=True):
        assert got[h] == pytest.approx(ratio(word, log_chance(word)), abs=0.05)  # places of the spelling model can be shared
    assert min(got[h] for w, h in zip(words, hashes.tolist(), strict=True) if w in INSULTS) > 3


def test_toxicity_scores_and_blocks(spark, judged, monkeypatch):
    from skillgrid.llm.common import word_hashes

    labelled = spark.createDataFrame([r for r in judged if r[0] % 3], "doc_id long, text string, label long").repartition(4)
    model = toxicity.fit(labelled)
    assert len(model.blocks) == 1 and any(model.weights)
    odd = [(5000, None, 0), (5001, "", 0), (5002, " 12 !", 0), (5003, judged[0][1], 1), (5003, judged[0][1], 1), (5004, ("ba ko " * 30000) + "grobnik", 0)]
    docs = spark.createDataFrame([*judged, *odd], "doc_id long, text string, Score long").repartition(4)
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score", "log_ratio"]
    rows = scored.collect()
    assert len(rows) == len(judged) + len(odd)
    ratios = dict(zip(*(a.tolist() for a in model.blocks[0].value), strict=True))
    vocabulary = sorted({w for r in rows for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").lower())})
    hashes, _ = word_hashes(pa.array(vocabulary), lower=True, between=toxicity.BREAK)
    known = {w: ratios[h] for w, h in zip(vocabulary, hashes.tolist(), strict=True) if h in ratios}
    for r in rows:
        f = np.array(plain_features(r.text, known, model.unseen))
        assert r.log_ratio == pytest.approx(f[0], abs=1e-6)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.bias + ((f - model.centre) / model.scale) @ model.weights))), abs=1e-6)
    held = [(r.score >= 0.7, y) for r in rows for k, _, y in judged if k == r.doc_id and k % 3 == 0 and y is not None]
    assert np.mean([bool(p) == bool(y) for p, y in held]) > 0.97
    assert toxicity.score(docs.where("false"), model).count() == 0
    monkeypatch.setattr(toxicity, "BLOCK", 300)  # several passes, the same scores
    cut = toxicity.fit(labelled)
    assert len(cut.blocks) > 1 and cut.unseen == model.unseen
    again = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, cut).collect()}
    assert all(again[r.doc_id, r.text] == pytest.approx(r.score, abs=1e-9) for r in rows)


def test_toxicity_without_labels(spark, judged):
    labelled = spark.createDataFrame(judged[:60], "doc_id long, text string, label long")
    for rows in (labelled.where("false"), labelled.where("label = 0"), labelled.withColumn("label", F.lit(None).cast("long"))):
        model = toxicity.fit(rows)
        assert {r.score < 0.7 for r in toxicity.score(labelled, model).collect()} == {True}


def test_vectors_that_link_with_nothing_stay_apart(spark):
    """A hundred thousand null vectors, a group of equal ones, and a pair: no task meets the nulls or the group whole."""
    from skillgrid.llm import cover_tree

    null = spark.range(100_000).select(F.col("id").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"))
    equal = spark.range(200_000, 205_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    near = spark.createDataFrame([(300_000, [5.0, -1.0]), (300_001, [5.0, -1.1]), (None, [1.0, 2.0]), (300_002, [0.0, 0.0]), (300_003, [1.0, float("nan")])], "vec_id long, embedding array<double>")
    out = cover_tree.near_vectors(null.unionByName(equal).unionByName(near))
    rows = {tuple(r) for r in out.groupBy((F.col("vec_id") < 100_000).alias("null"), "n_links", "kept").agg(F.count("*").alias("n"), F.count_distinct("component_id").alias("groups")).collect()}
    assert rows == {(True, 0, True, 100_000, 100_000), (False, 4999, True, 1, 1), (False, 4999, False, 4999, 1), (False, 1, True, 1, 1), (False, 1, False, 1, 1), (False, 0, True, 2, 2), (None, 0, True, 1, 0)}
