"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give each word of a text its likelihood: the class's count less a discount,
and, with the weight of what was discounted, a likelihood that both classes share. That one spells the
word: an interpolated Kneser-Ney model of its bytes after up to three before them, counted over different
words, as continuation counts are, of both classes. So a rare expression of either class stands out as far
as its count tells, and one that neither has seen says nothing.

Counts cover every labelled text but a fifth that the models don't see; the table of words grows with them,
and is kept, counted and finished as a DataFrame. For scoring it is cut into blocks of at most ``BLOCK``
words, which bounds what is sent to a task at a time; with several blocks, texts pass one after the other.
The spelling model has ``2 ** BITS`` places an order.

A text's log-likelihood ratio is normalised by its number of words. A logistic regression weighs it
against the ratios of its most toxic words; it is fitted on a bounded sample of the fifth
that the models don't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bytes_of, fresh, mix, word_hashes, word_places
from .periodic import slices
from .quality import lasso_logistic

ORDER, BITS, BLOCK = 4, 18, 1 << 22
DISCOUNT = 0.75
LEVELS = (2, 4, 6)  # log-likelihood ratios over which words are counted
SUMS = ("words", "known", "total", "best", *(f"over_{v}" for v in LEVELS))  # of a text: words, those in the table, the sum of their ratios, the largest, and those over each level
FEATURES = ("mean", "best", *(f"share_over_{v}" for v in LEVELS), *(f"log_over_{v}" for v in LEVELS), "log_words")
_BEST = SUMS.index("best")
BREAK = np.array([c < 128 and not (65 <= c <= 90 or 97 <= c <= 122) for c in range(256)])  # between words: ASCII but letters
FOLD = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)), np.uint8)
_BEGIN, _END = 1, 2  # bytes that no word has


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of a part of a batch, A-Z lower-cased, with their hash and their count in each class."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text")
            raw, bounds = bytes_of(texts)
            begins, ends, first = word_places(raw, bounds, BREAK)
            hashes, _ = word_hashes(texts, lower=True, between=BREAK)
            toxic = np.repeat(part.column("label").to_numpy() > 0, np.diff(first))
            found, at, word = np.unique(hashes, return_index=True, return_inverse=True)
            t = np.bincount(word, weights=toxic, minlength=len(at)).astype(np.int64)
            n = np.bincount(word, minlength=len(at))
            low = FOLD[raw].tobytes()
            yield pa.RecordBatch.from_pydict({"hash": pa.array(found.view(np.int64)), "word": pa.array([low[b:e] for b, e in zip(begins[at].tolist(), ends[at].tolist(), strict=True)], pa.binary()), "toxic": pa.array(t), "ordinary": pa.array(n - t)})


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words between marks of their ends, end to end, and each byte's place in its word, 0 for the first mark."""
    raw, bounds = bytes_of(words)
    sizes = np.diff(bounds) + 2
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    out = np.empty(len(place), np.uint8)
    out[first], out[first + sizes - 1] = _BEGIN, _END
    inner = np.ones(len(out), bool)
    inner[first] = inner[first + sizes - 1] = False
    out[inner] = raw
    return out, place


def _grams(letters: np.ndarray) -> list[np.ndarray]:
    """Place in its order's table of the 0, 1, .. ``ORDER`` bytes that end at each byte; what begins before the first is not used."""
    h, own, power = np.zeros(len(letters), np.uint64), letters.astype(np.uint64) + np.uint64(1), 1
    out = [np.zeros(len(letters), np.int64)]
    for k in range(ORDER):
        h[k:] += own[: len(own) - k] * np.uint64(power)
        power = power * 0x9E3779B97F4A7C15 % (1 << 64)
        out.append((mix(h) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def _spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte n-grams of different words: order, place, places of the context and of the gram without its first byte, count as the longest at a byte."""
    for batch in batches:
        letters, place = _letters(batch.column("word"))
        grams = _grams(letters)
        for k in range(1, ORDER + 1):
            spots = np.flatnonzero(place >= max(1, k - 1))
            if not len(spots):
                continue
            longest = (k == ORDER) | (place[spots] == k - 1)
            found, at, inverse = np.unique(grams[k][spots], return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=longest, minlength=len(at)).astype(np.int64)
            own = spots[at]
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k)), "gram": pa.array(found), "context": pa.array(grams[k - 1][own - 1]), "rest": pa.array(grams[k - 1][own]), "n": pa.array(n)})


@dataclass(frozen=True)
class Spelling:
    chance: np.ndarray  # by order and place: interpolated probability of a gram's last byte, nan for unseen grams
    left: np.ndarray  # by order and place of the context: weight of the shorter gram's

    def log_chance(self, words: pa.Array) -> np.ndarray:
        """Log-probability of each word."""
        letters, place = _letters(words)
        grams = _grams(letters)
        p = np.full(len(letters), 1 / 257)
        for k in range(1, ORDER + 1):
            spots = np.flatnonzero(place >= max(1, k - 1))
            own = self.chance[k, grams[k][spots]]
            p[spots] = np.where(np.isnan(own), p[spots] * self.left[k, grams[k - 1][spots - 1]], own)
        p[place == 0] = 1.0
        starts = np.flatnonzero(place == 0)
        return np.add.reduceat(np.log(p), starts) if len(starts) else np.empty(0)


def fit_spelling(words: DataFrame) -> Spelling:
    """From rows ``word``, each once. At most ``ORDER * 2 ** BITS`` rows come to the driver."""
    rows = words.select("word").mapInArrow(_spelling, "k long, gram long, context long, rest long, n long")
    table = rows.groupBy("k", "gram").agg(F.min("context").alias("context"), F.min("rest").alias("rest"), F.sum("n").alias("n")).toArrow()
    k, gram, context, rest, n = (table.column(c).to_numpy() for c in ("k", "gram", "context", "rest", "n"))
    chance, left = np.full((ORDER + 1, 1 << BITS), np.nan), np.ones((ORDER + 1, 1 << BITS))
    chance[0] = 1 / 257
    for order in range(1, ORDER + 1):
        own = k == order
        g, c, r, count = gram[own], context[own], rest[own], n[own].astype(float)
        if order < ORDER:  # the number of bytes that the gram was seen after
            count = count + np.bincount(rest[k == order + 1], minlength=1 << BITS)[g]
        total = np.bincount(c, weights=count, minlength=1 << BITS)
        kinds = np.bincount(c, weights=count > 0, minlength=1 << BITS)
        left[order] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        chance[order, g] = np.maximum(count - DISCOUNT, 0) / np.maximum(total[c], 1) + left[order, c] * np.nan_to_num(chance[order - 1, r], nan=1 / 257)
    return Spelling(chance, left)


@dataclass(frozen=True)
class ToxicityModel:
    blocks: tuple[Broadcast, ...]  # sorted hashes of words, and their log-likelihood ratios
    unseen: float  # the ratio of a word that neither class has
    bias: float
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def describe(self) -> list[str]:
        """The weights of the features, as text."""
        return [f"{w:+.3f} {f}" for f, w in zip(FEATURES, self.weights, strict=True)]


def word_ratios(labelled: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """Rows ``hash, ratio`` of all words of the rows ``text, label``, and the ratio of any other word."""
    counted = labelled.mapInArrow(_words, "hash long, word binary, toxic long, ordinary long")
    words = scratch.keep(counted.groupBy("hash").agg(F.min("word").alias("word"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    totals = words.agg(*(f(c).alias(f"{n}_{c}") for c in ("toxic", "ordinary") for n, f in (("all", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0))))).first()
    if not totals.all_toxic or not totals.all_ordinary:
        return words.where("false").select("hash", F.lit(0.0).alias("ratio")), 0.0
    spelling = words.sparkSession.sparkContext.broadcast(fit_spelling(words))
    left = {c: DISCOUNT * totals[f"kinds_{c}"] / totals[f"all_{c}"] for c in ("toxic", "ordinary")}
    total = {c: float(totals[f"all_{c}"]) for c in left}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = np.exp(spelling.value.log_chance(batch.column("word")))
            p = [np.maximum(batch.column(c).to_numpy() - DISCOUNT, 0) / total[c] + left[c] * shared + 1e-300 for c in left]
            yield pa.RecordBatch.from_pydict({"hash": batch.column("hash"), "ratio": pa.array(np.log(p[0] / p[1]))})

    return scratch.keep(words.mapInArrow(finish, "hash long, ratio double")), float(np.log(left["toxic"] / left["ordinary"]))


def blocks_of(words: DataFrame) -> tuple[Broadcast, ...]:
    """The table of words in blocks of about ``BLOCK`` at most, each sorted by hash; the driver holds one at a time."""
    parts, out = max(1, -(-words.count() * 11 // (10 * BLOCK))), []
    for k in range(parts):
        own = words.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == k).select("hash", F.col("ratio").cast("float").alias("ratio")).toArrow()
        h = own.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(h)
        out.append(words.sparkSession.sparkContext.broadcast((h[order], own.column("ratio").to_numpy()[order])))
    return tuple(out)


def sums_of(texts: pa.Array, block: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``SUMS`` of each text over its words of a block, but for the number of all its words."""
    hashes, first = word_hashes(texts, lower=True, between=BREAK)
    out = np.zeros((len(texts), len(SUMS)))
    out[:, 0], out[:, _BEST] = np.diff(first), -np.inf
    known, ratios = block
    if not len(hashes) or not len(known):
        return out
    different, word = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(known, different), len(known) - 1)
    seen = (known[at] == different)[word]
    ratio = ratios[at].astype(float)[word]
    some = np.flatnonzero(np.diff(first) > 0)
    cut = first[:-1][some]
    out[some, _BEST] = np.maximum.reduceat(np.where(seen, ratio, -np.inf), cut)
    added = [seen, np.where(seen, ratio, 0.0), *(seen & (ratio > v) for v in LEVELS)]
    for column, each in zip((c for c in range(1, len(SUMS)) if c != _BEST), added, strict=True):
        out[some, column] = np.add.reduceat(each.astype(float), cut)
    return out


def measured(rows: DataFrame, column: str, model: ToxicityModel, names: list[str]) -> DataFrame:
    """``rows`` with ``SUMS`` over all blocks of words in the columns ``names``: one pass for each block."""
    for k, sent in enumerate(model.blocks):
        schema = T.StructType([f for f in rows.schema.fields if f.name not in names] + [T.StructField(n, T.DoubleType(), False) for n in names])

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=not k, schema=schema) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, column):
                    own = sums_of(part.column(column), sent.value)
                    if not first:
                        before = np.stack([part.column(n).to_numpy() for n in names], axis=1)
                        best = np.maximum(own[:, _BEST], before[:, _BEST])
                        own[:, 0] = 0  # all words are counted once
                        own += before
                        own[:, _BEST] = best
                    yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in schema.fields if f.name not in names), *map(pa.array, own.T)], schema.names)

        rows = rows.mapInArrow(run, schema)
    return rows


def features(names: list[str], unseen: float) -> list[Column]:
    """``FEATURES`` as columns over the sums ``names``; a text without words has zeros."""
    n, known, total, best, *over = map(F.col, names)
    best = F.when(n > known, F.greatest(best, F.lit(unseen))).otherwise(best)
    each = [(total + (n - known) * unseen) / n, best, *(v / n for v in over), *(F.log1p(v) for v in over), F.log1p(n)]
    return [F.when(n > 0, v).otherwise(0.0) for v in each]


def fit(labelled: DataFrame, *, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = 12_000, penalty: float = 0.001) -> ToxicityModel:
    """Learn from all rows with a label. A fifth of them, by hash of ``key`` and text, only weighs the features.

    ``sample`` bounds the rows of that fifth whose features come to the driver (those with the smallest
    hashes, at most twice as many). A null text counts as empty. With no labels, or one class, the model is its prior.
    """
    scratch = Scratch(labelled.sparkSession)
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    pick = F.pmod(F.xxhash64(*([F.col(key)] if key in labelled.columns else []), value, F.lit("fold")), F.lit(1 << 30))
    known = scratch.keep(labelled.where(F.col(label).isNotNull()).select(value.alias("text"), F.col(label).cast("long").alias("label"), pick.alias("pick")))
    fold = F.col("pick") % 5 == 0
    words, unseen = word_ratios(known.where(~fold).select("text", "label"), scratch)
    none = np.zeros(len(FEATURES))
    model = ToxicityModel(blocks_of(words), unseen, 0.0, none, none, none + 1)
    tuned = known.where(fold)
    n = tuned.count()
    if n > sample:
        tuned = tuned.where(F.col("pick") < int(sample / n * (1 << 30)))
    rows = measured(tuned, "text", model, list(SUMS)).select("pick", "label", *(f.alias(n) for n, f in zip((f"f_{n}" for n in FEATURES), features(list(SUMS), unseen), strict=True)))
    rows = rows.orderBy(*rows.columns).limit(2 * sample).toPandas().to_numpy(float)
    y, x = (rows[:, 1] > 0).astype(float), rows[:, 2:]
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return ToxicityModel(model.blocks, unseen, float(np.log(p / (1 - p))), none, none, none + 1)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    bias, weights = lasso_logistic((x - centre) / scale, y, penalty, rounds=3000)
    return ToxicityModel(model.blocks, unseen, bias, weights, centre, scale)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", out: str = "score", ratio: str = "log_ratio") -> DataFrame:
    """Add ``out`` (0 to 1, higher: toxic is likelier) and ``ratio``, the text's log-likelihood ratio a word.

    Words are letters A-Z, a-z and all beyond ASCII. Null and empty texts, and those without words, get the
    score of a text without words and a ratio of 0. Whole texts count, however long; rows that repeat are
    scored alike; an empty table gives no row. Other columns stay, whatever their names; those named like
    the new ones are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in (out.lower(), ratio.lower())]
    column, *names = fresh(docs, "read", *SUMS)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    read = docs.select(*map(quoted, rest), F.coalesce(quoted(text).cast("string"), F.lit("")).alias(column))
    found = features(names, model.unseen)
    logit = F.lit(model.bias)
    for f, w, c, v in zip(found, model.weights.tolist(), model.centre.tolist(), model.scale.tolist(), strict=True):
        if w:
            logit = logit + (f - c) * (w / v)
    return measured(read, column, model, names).select(*map(quoted, rest), (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias(out), found[0].alias(ratio))
