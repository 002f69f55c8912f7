"""Line dedup by prefix doubling over line ids, with DataFrame operations only.

A line's id is a 128-bit hash of its trimmed text; blank lines are left out of the sequences.

Up: prefix doubling gives every suffix the class of its first 2^k lines, which is the class of the
suffix together with that of the suffix 2^(k-1) lines on. Classes that occur once leave after every
round, so later rounds touch repeated text only, and doubling ends when no class repeats.

Down: suffixes with a common prefix are an interval of the suffix array. All start in the interval of
length 0; from the longest class down, those of an interval that go on alike for 2^k lines more move
to an inner interval. The first of them, in the order of documents, stays in the outer one as well, to
stand for the rest. So each suffix ends in the deepest interval in which it is not the first: its length
is the longest common prefix with any earlier suffix. Suffixes whose neighbour on the left goes no
further are the maximal repeated runs, and all their lines are deleted: the first copy stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, join_counted

PLACE = ["id", "of", "at"]


def body(line: Column) -> Column:
    """A line without white space at its end and spaces at its begin."""
    return F.ltrim(F.rtrim(line, F.lit(" \t\r\x0b\f")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashed(*parts: str) -> list[Column]:
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b")]


def line_ids(docs: DataFrame, min_words: int) -> DataFrame:
    """Rows ``id, of, at, a, b, long``: the hashes of each line that is not blank, and whether it has ``min_words`` words."""
    solid = F.filter(F.transform(F.split("text", "\n"), body), lambda x: x != "")
    lines = docs.select("id", "of", F.posexplode(solid).alias("at", "line"))
    return lines.select(*PLACE, *_hashed("line"), (F.size(F.split("line", r"\s+")) >= min_words).alias("long"))


def _repeated(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose class occurs at two places or more."""
    rows = scratch.keep(rows)
    classes = scratch.keep(rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1"))
    out = scratch.keep(join_counted(rows, classes, ["a", "b"], PLACE).drop("n"))
    scratch.drop(rows)
    scratch.drop(classes)
    return out


def longest_runs(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """Rows ``id, of, at, length, long``: places whose next ``length`` lines also start at an earlier place, and no more lines do.

    ``docs`` has ``id`` and ``of``, which order documents and tell them apart, and ``text``.
    """
    lines = _repeated(line_ids(docs, min_words), scratch)
    lines = scratch.keep(lines.distinct())  # rows that repeat a document are one
    levels, length = [lines.select(*PLACE, "a", "b")], 1
    while True:
        later = levels[-1].select("id", "of", (F.col("at") - length).alias("at"), F.col("a").alias("c"), F.col("b").alias("d"))
        level = _repeated(levels[-1].join(later, PLACE).select(*PLACE, *_hashed("a", "b", "c", "d")), scratch)
        if level.isEmpty():
            break
        levels.append(level)
        length *= 2

    zero = F.lit(0).cast("long")
    rows = lines.select(*PLACE, zero.alias("x"), zero.alias("y"), F.lit(0).alias("length"), F.lit(True).alias("own"))
    for level in reversed(levels):
        ahead = level.select("id", "of", F.col("at").alias("look"), "a", "b")
        probe = rows.withColumn("look", F.col("at") + F.col("length")).join(ahead, ["id", "of", "look"], "left").drop("look")
        inner = [F.when(F.col("a").isNotNull(), h).alias(n) for h, n in zip(_hashed("x", "y", "a", "b"), "pq", strict=True)]
        probe = scratch.keep(probe.select(*rows.columns, *inner))
        groups = probe.where("p is not null").groupBy("p", "q").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
        met = join_counted(probe, scratch.keep(groups), ["p", "q"], PLACE, how="left")
        outer = F.struct("x", "y", "length", "own")
        first = F.struct(*PLACE) == F.col("first")
        deeper = F.struct(F.col("p").alias("x"), F.col("q").alias("y"), (F.col("length") + length).alias("length"), (F.col("own") & ~first).alias("own"))
        moved = F.when(F.col("first").isNull(), F.array(outer)).when(first, F.array(outer, deeper)).otherwise(F.array(deeper))
        done, rows = rows, scratch.keep(met.select(*PLACE, F.explode(moved).alias("s")).select(*PLACE, "s.*"))
        for old in (done, probe, level):
            scratch.drop(old)
        length //= 2
    late = rows.where("own and length > 0").groupBy(*PLACE).agg(F.max("length").alias("length"))
    return late.join(lines.where("long").select(*PLACE, "long"), PLACE, "left").withColumn("long", F.coalesce("long", F.lit(False)))


def deleted_spans(runs: DataFrame, min_lines: int) -> DataFrame:
    """One row for each document: ``spans`` of lines that go (disjoint, in order), ``runs`` and ``longest`` of the maximal runs."""
    by_doc = Window.partitionBy("id", "of").orderBy("at")
    runs = runs.where((F.col("length") >= min_lines) | F.col("long")).withColumn("end", F.col("at") + F.col("length"))
    inside = F.coalesce((F.lag("at").over(by_doc) == F.col("at") - 1) & (F.lag("end").over(by_doc) == F.col("end")), F.lit(False))
    before = F.coalesce(F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = runs.select("id", "of", "at", "end", "length", inside.alias("inside"), before.alias("before"))
    span = F.when(F.col("end") > F.col("before"), F.struct(F.greatest("at", "before").alias("begin"), "end", "before"))
    return spans.groupBy("id", "of").agg(F.sort_array(F.collect_list(span)).alias("spans"), F.count_if(~F.col("inside")).alias("runs"), F.max("length").alias("longest"))


def _without(text: Column, spans: Column) -> Column:
    """The text without the spans of its lines that are not blank; blank lines stay."""

    def cut(s: Column) -> Column:
        lines, gone, solid = s["lines"], s["gone"], s["solid"]
        before = lambda k: F.coalesce(F.get(solid, k - 1), F.lit(-1))
        piece = lambda k: F.slice(lines, before(k) + 2, F.get(solid, k) - before(k) - F.coalesce(F.get(gone, k), F.lit(0)))
        last = F.get(solid, F.size(solid) - 1)
        tail = F.slice(lines, last + 2, F.size(lines) - 1 - last)
        return F.array_join(F.flatten(F.concat(F.transform(F.sequence(F.lit(0), F.size(solid) - 1), piece), F.array(tail))), "\n")

    gone = F.flatten(F.transform(spans, lambda s: F.concat(F.array_repeat(F.lit(0), s["begin"] - s["before"]), F.array_repeat(F.lit(1), s["end"] - s["begin"]))))
    places = lambda s: F.filter(F.sequence(F.lit(0), F.size(s["lines"]) - 1), lambda k: body(F.get(s["lines"], k)) != "")
    split = F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone"))
    return _let(split, lambda s: _let(F.struct(s["lines"].alias("lines"), s["gone"].alias("gone"), places(s).alias("solid")), cut))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 20, names: tuple[str, str, str, str] = ("n_lines", "n_removed", "n_runs", "longest_run")) -> DataFrame:
    """Add ``n_lines`` (not blank), ``n_removed``, ``n_runs`` and ``longest_run``, and replace ``text`` by what is left.

    The lines of every maximal run that also starts earlier go: in a document with a smaller doc_id,
    or further up in the same one. A run counts from ``min_lines`` lines, or from one line of
    ``min_words`` words or more; ``n_runs`` are the maximal ones, ``longest_run`` the most lines of one.
    Blank lines stay and don't count; a null text stays null with 0 lines. Rows with a null doc_id stay
    whole. Rows that repeat an id and text are one document: none is a copy of the other; rows that
    repeat an id with another text are ordered by a hash of it. An empty table gives no row; other
    columns stay, those named like ``names`` are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    kept = docs.drop(*names)
    key, hashed, other, id_, of = fresh(kept, "key", "hashed", "found", "id", "of")
    keyed = kept.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"), F.col("text").cast("string").alias("text"))
    gone = deleted_spans(longest_runs(keyed, min_words, scratch), min_lines)
    gone = gone.select(F.col("id").alias(id_), F.col("of").alias(of), F.struct("spans", "runs", "longest").alias(other))
    wide = kept.withColumn(hashed, F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col(id_)) & (F.col(hashed) == F.col(of)), "left")
    text, found = F.col("text").cast("string"), F.col(other)
    removed = F.aggregate(found["spans"], F.lit(0), lambda n, s: n + s["end"] - s["begin"])
    numbers = [F.size(F.filter(F.split(text, "\n"), lambda x: body(x) != "")), removed, found["runs"], found["longest"]]
    new = {n: F.coalesce(v, F.lit(0)).cast("long") for n, v in zip(names, numbers, strict=True)}
    out = wide.withColumns(new | {key: F.when(found.isNotNull(), _without(text, found["spans"])).otherwise(text)})
    return out.withColumn("text", F.col(key)).select(*[c for c in kept.columns], *names)
