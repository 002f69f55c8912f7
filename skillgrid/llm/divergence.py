"""Source divergence audit: how far the words of each source of a language are from the other sources and from all.

Duplicate-text collapse: rows with one text in one language are a class, found by 128 bits of hash,
with the number of its rows in each source. A class is tokenised once; its terms are then counted with
those multiplicities, in the source's counts and in the language's document frequencies alike.

Divergences of two sources are sums over all kept terms, of which most occur in neither. They are
evaluated sparsely, and exactly: every pair starts from the value of a term that both lack, times the
number of terms; terms of one source add their difference to that, put together by their count first,
since terms with equal counts have equal shares; terms of both sources correct the two differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, word_places
from .periodic import slices
from .toxicity import BREAK, FOLD

SCALE = 1_000_000_000
_BITS = 23
_FEW = 100_000  # groups up to which their sizes are broadcast: some 100 bytes each


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts, one after the other: letters A-Z, lower-cased, a-z and all beyond ASCII; and the first of each text, and the end."""
    raw, bounds = bytes_of(texts)
    begins, ends, first = word_places(raw, bounds, BREAK)
    inside = ~BREAK[raw]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)])
    return pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(FOLD[raw[inside]])]), first


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, source, term, count, documents`` of each slice of classes ``lang, text, weights``, tokenised once and counted for all their sources."""
    for batch in batches:
        for part in slices(batch, "text"):
            terms, first = _terms(part.column("text"))
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            kinds = len(coded.dictionary)
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            pair, times = np.unique(owner * kinds + coded.indices.to_numpy(), return_counts=True)
            text, term = pair // kinds, pair % kinds
            weights = part.column("weights")
            of = np.asarray(weights.value_lengths())
            each = weights.flatten()
            sources, langs = each.field("source").dictionary_encode(), part.column("lang").dictionary_encode()
            n, source = each.field("n").to_numpy(), sources.indices.to_numpy()
            own = of[text]  # a class counts for each of its sources
            place = np.repeat((np.cumsum(of) - of)[text] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            group = np.repeat(langs.indices.to_numpy()[text].astype(np.int64) * len(sources.dictionary), own) + source[place]
            key, at = np.unique(group * kinds + np.repeat(term, own), return_inverse=True)
            count, documents = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            np.add.at(count, at, np.repeat(times, own) * n[place])
            np.add.at(documents, at, n[place])
            group = key // kinds
            yield pa.RecordBatch.from_pydict({
                "lang": langs.dictionary.take(pa.array(group // len(sources.dictionary))),
                "source": sources.dictionary.take(pa.array(group % len(sources.dictionary))),
                "term": coded.dictionary.take(pa.array(key % kinds)).cast(pa.large_string()).cast(pa.string()),
                "count": pa.array(count), "documents": pa.array(documents)})


def share(count: Column, total: Column, kinds: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + kinds))``, exactly at any size; null where there are no kinds."""
    below = F.when(kinds > 0, total + kinds)
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    exact = F.call_function("div", wide, below.cast("decimal(20,0)"))
    return F.when(count < 9_000_000_000, F.call_function("div", (count + 1) * F.lit(SCALE).cast("long"), below)).otherwise(exact) + 1


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; shares are at most ``SCALE + 1``, so that the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def collapsed(docs: DataFrame, scratch: Scratch, *, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows ``lang, text, weights`` (one a class; ``weights`` are ``source, n``), and rows ``lang, source`` of all groups.

    Only hashes are counted by source. A bitmap of those that several rows have (``2^_BITS`` bits) then tells rows
    apart: a text that is there once stays where it is, others go over the network, once a task. A class has as
    many weights as sources.
    """
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(read(lang).alias("lang"), read(source).alias("source"), read(text).alias("text"))
    key = ["lang", "hash_a", "hash_b"]
    rows = rows.select("lang", "source", "text", F.xxhash64("text").alias("hash_a"), F.xxhash64(F.lit(1), "text").alias("hash_b"))
    counted = scratch.keep(rows.groupBy(*key, "source").agg(F.count("*").alias("n")))
    weights = counted.groupBy(*key).agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("weights")).where("n > 1")
    bit = F.pmod("hash_a", F.lit(1 << _BITS))
    word, mask = F.floor(bit / 64).alias("word"), F.expr("shiftleft(1L, cast(pmod(hash_a, 64) as int))")
    often = weights.select(word, mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    marked = rows.withColumn("word", word).join(F.broadcast(often), "word", "left")  # 2^_BITS / 64 rows at most
    repeats = F.coalesce(F.col("mask").bitwiseAND(mask) != 0, F.lit(False))
    once = marked.where(~repeats).select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("n"))).alias("weights"))
    texts = marked.where(repeats).groupBy(*key).agg(F.first("text").alias("text"), F.first("source").alias("source"))
    own = F.coalesce("weights", F.array(F.struct("source", F.lit(1).cast("long").alias("n"))))  # a row that only shares its bit
    met = texts.join(weights.select(*key, "weights").hint("merge"), key, "left").select("lang", "text", own.alias("weights"))
    return once.unionByName(met), counted.select("lang", "source").distinct()


def counts(docs: DataFrame, scratch: Scratch, *, least_documents: int = 3, **names: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``lang, source, term, count, lang_count, one`` of kept terms (``one``: the first row of its term), and the groups.

    A term is kept in a language if at least ``least_documents`` of its documents have it.
    """
    classes, groups = collapsed(docs, scratch, **names)
    tokens = classes.mapInArrow(_tokenised, "lang string, source string, term string, count long, documents long")
    counted = tokens.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    own = Window.partitionBy("lang", "term")  # one row a source
    seen = counted.withColumns({"lang_documents": F.sum("documents").over(own), "lang_count": F.sum("count").over(own), "one": F.row_number().over(own.orderBy("source")) == 1})
    return scratch.keep(seen.where(F.col("lang_documents") >= least_documents).select("lang", "source", "term", "count", "lang_count", "one")), groups


def audit(docs: DataFrame, *, top: int = 200, least_documents: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``.

    Part ``pair``: each other source of the language, with the divergence of the group's shares from that
    source's, over all kept terms. Part ``term``: the ``top`` terms that the group has a larger share of
    than its language, with their divergence. Ranks go by value, then by item in UTF-8 order.

    Null texts, languages and sources count as empty ones; an empty text is a document without terms, and
    a group without kept terms has equal shares. Rows that repeat count as often; a very long text is one
    row's array of terms. An empty table gives no row; other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession)
    kept, groups = counts(docs, scratch, least_documents=least_documents, text=text, lang=lang, source=source)
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    kinds = kept.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.sum(F.col("one").cast("long")).alias("kinds"))
    sizes = groups.join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").na.fill(0, ["total", "lang_total", "kinds"])
    sizes = scratch.keep(sizes.withColumn("none", share(F.lit(0).cast("long"), F.col("total"), F.col("kinds"))))
    few = sizes.count() <= _FEW
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)  # beyond the bound, by a shuffle on the group

    shares = kept.join(small(sizes), ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("kinds")))
    shares = scratch.keep(shares.withColumn("q", share(F.col("lang_count"), F.col("lang_total"), F.col("kinds"))).select("lang", "source", "term", "count", "p", "q", "none"))

    a = sizes.select("lang", "source", "kinds", "none")
    pairs = a.join(small(a.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))), "lang").where("source <> item")
    pairs = scratch.keep(pairs.withColumn("base", divergence(F.col("none"), F.col("item_none"))))
    alike = scratch.keep(shares.groupBy("lang", "source", "count").agg(F.count("*").alias("n"), F.first("p").alias("p")))
    big = lambda c: c.cast("decimal(20,0)")
    value = lambda each: (big(each - F.col("base")) * F.col("n").cast("decimal(18,0)")).cast("decimal(38,0)").alias("value")
    mine = pairs.join(alike, ["lang", "source"]).select("lang", "source", "item", value(divergence(F.col("p"), F.col("item_none"))))
    other = pairs.join(alike.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", value(divergence(F.col("none"), F.col("p"))))

    x = shares.select("lang", "term", "source", "p", "none")
    y = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("none").alias("item_none"))

    def both(p: str, none: str, q: str, item_none: str) -> Column:
        f = lambda u, v: divergence(F.col(u), F.col(v))
        return F.sum(big(f(p, q) - f(p, item_none) - f(none, q) + f(none, item_none)))

    met = x.join(y, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(both("p", "none", "item_p", "item_none").alias("there"), both("item_p", "item_none", "p", "none").alias("back"))
    turns = F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    met = met.select("lang", F.inline(turns)).withColumn("value", F.col("value").cast("decimal(38,0)"))
    added = mine.unionByName(other).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("value").alias("added"))
    start = F.coalesce(big(F.col("base")) * F.col("kinds").cast("decimal(18,0)"), F.lit(0))
    divergences = pairs.join(added, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (start + F.coalesce("added", F.lit(0))).cast("long").alias("value"))

    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    words = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    words = words.withColumn("rank", ranked).where(F.col("rank") <= top)  # each task's first rows alone are shuffled
    return divergences.withColumn("rank", ranked).unionByName(words)
