"""Quotation linking: conversations in reply order, without their quotes, by DataFrame operations only.

Leading ``>`` marks give a line's quote level. Lines are normalised (marks off, lower case, white
space collapsed), and consecutive lines of one level, up to a blank one, are a passage, whose text is
its lines joined by a space. What a message itself wrote, passages and single lines, is hashed; so is
what it quotes. A quoted line is found in a message before it in its conversation that wrote the line's
passage, however it is wrapped, or, where only part of a passage is quoted, the line. Of the messages
found at the lowest level, that with the most lines found (the latest on ties) is the one replied
to. Messages that wrote the same passages and lines are joined as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

MARK = r"^\s*((?:>\s?)+)"


def quote_level(line: Column) -> Column:
    """Number of leading ``>`` marks of a line, as in ``> > text`` or ``>>text``."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 1), r"[^>]", ""))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARK, ""), r"\s+", " ")))


def own_text(text: Column) -> Column:
    """The text without quoted lines; white space at its ends goes if a line was quoted."""
    lines = F.split(text, "\n")
    own = F.filter(lines, lambda x: quote_level(x) == 0)
    return F.when(F.size(own) == F.size(lines), text).otherwise(F.trim(F.array_join(own, "\n")))


def with_passages(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with ``passage``: the hash of the consecutive lines of one level that hold it, joined by a space."""
    text = ["conv_id", "turn", "of"]
    order = Window.partitionBy(*text).orderBy("at")
    starts = (F.col("body") == "") | ~F.lag("level").over(order).eqNullSafe(F.col("level"))
    runs = lines.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(order)).where("body <> ''")
    held = F.array_sort(F.collect_list(F.struct("at", "level", "body")))
    runs = runs.groupBy(*text, "run").agg(held.alias("held"))
    passage = F.xxhash64(F.array_join(F.col("held.body"), " ")).alias("passage")
    return runs.select(*text, passage, F.explode("held").alias("line")).select("conv_id", "turn", "line.level", "line.body", "passage")


def link_quotes(messages: DataFrame, min_chars: int = 1) -> DataFrame:
    """Rows of ``messages`` with ``n_quoted`` lines, ``max_level``, ``reply_to`` (a turn or null),
    ``depth``, ``reply_path`` (turns from the root down: its order is the reply order) and the
    text without quotes.

    A null text counts as empty and stays null. Rows with a null conversation or turn are linked
    with nothing. Rows that repeat a conversation and turn each stay, and are one message that wrote
    and quotes what any of them does. An empty table gives no row. Other columns stay; those named
    like the new ones are replaced. Texts are taken whole, however long: a message's lines are
    one group. Quoted lines under ``min_chars`` characters link nothing.
    """
    scratch = Scratch(messages.sparkSession)
    keep = messages.drop("n_quoted", "max_level", "reply_to", "depth", "reply_path")
    texts = keep.where("conv_id is not null and turn is not null and text is not null").select("conv_id", "turn", F.col("text").cast("string").alias("text")).distinct()
    lines = texts.select("conv_id", "turn", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("conv_id", "turn", "of", "at", quote_level(F.col("line")).alias("level"), normalised(F.col("line")).alias("body"))
    hashed = with_passages(lines).where(F.length("body") >= min_chars).select("conv_id", "turn", "level", F.xxhash64("body").alias("hash"), "passage")
    units = F.explode(F.array_distinct(F.array("hash", "passage"))).alias("unit")
    quoted = hashed.where("level > 0").groupBy("conv_id", "turn", "hash", "passage").agg(F.count("*").alias("n"), F.min("level").alias("level"))
    quoted = quoted.select("conv_id", "turn", "hash", "passage", "n", "level", units)
    # messages that wrote the same are one class: of these the latest before the quote is the candidate
    wrote = hashed.where("level = 0").select("conv_id", "turn", units).distinct()
    classes = scratch.keep(wrote.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("unit")).alias("units")).select("conv_id", "turn", "units", F.xxhash64("units").alias("class")))
    authors = classes.groupBy("conv_id", "class").agg(F.min("turn").alias("first"), F.min_by("units", "turn").alias("units")).select("conv_id", "class", "first", F.explode("units").alias("unit"))
    # a line counts once, whether it, its passage or both are found
    found = quoted.join(authors, ["conv_id", "unit"]).where("first < turn").groupBy("conv_id", "turn", "class", "hash", "passage").agg(F.first("n").alias("n"), F.first("level").alias("level"))
    votes = found.groupBy("conv_id", "turn", "class").agg(F.min("level").alias("level"), F.sum("n").alias("votes"))
    events = votes.select("conv_id", "class", F.col("turn").alias("at"), "level", "votes", F.lit(None).cast(dict(messages.dtypes)["turn"]).alias("source")).unionByName(
        classes.select("conv_id", "class", F.col("turn").alias("at"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("votes"), F.col("turn").alias("source"))
    )
    # a message itself sorts after its quotes, so that nothing replies to itself
    before = Window.partitionBy("conv_id", "class").orderBy("at", F.col("source").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    votes = events.withColumn("latest", F.last("source", ignorenulls=True).over(before)).where("votes is not null and latest < at").select("conv_id", F.col("at").alias("turn"), "latest", "level", "votes")
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("votes"), F.col("latest"))).alias("b")).select("conv_id", "turn", F.col("b.latest").alias("reply_to"))

    # paths by pointer doubling: each round joins the path of the topmost turn so far
    paths = scratch.keep(best.select("conv_id", "turn", F.col("reply_to").alias("top"), F.array("reply_to", "turn").alias("path"), "reply_to"))
    while True:
        up = paths.select("conv_id", F.col("turn").alias("top"), F.col("path").alias("above"), F.col("top").alias("next"))
        joined = paths.join(up, ["conv_id", "top"], "left")
        path = F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat(F.slice("above", F.lit(1), F.size("above") - 1), F.col("path")))
        grown = scratch.keep(joined.select("conv_id", "turn", F.coalesce("next", "top").alias("top"), path.alias("path"), "reply_to", F.col("above").isNotNull().alias("moved")))
        scratch.drop(paths)
        moved = grown.where("moved").limit(1).count()
        paths = grown
        if not moved:
            break
    conv, turn, found = fresh(keep, "conv", "at", "path")
    paths = paths.select(F.col("conv_id").alias(conv), F.col("turn").alias(turn), "reply_to", F.col("path").alias(found))
    text = F.col("text").cast("string")
    levels = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: quote_level(x))
    out = keep.join(paths, (F.col("conv_id") == F.col(conv)) & (F.col("turn") == F.col(turn)), "left")
    return out.withColumns(
        {
            "n_quoted": F.size(F.filter(levels, lambda v: v > 0)).cast("long"),
            "max_level": F.array_max(levels),
            "reply_path": F.coalesce(found, F.when(F.col("turn").isNotNull(), F.array("turn"))),
            "depth": F.when(F.col("turn").isNotNull(), F.when(F.col(found).isNull(), 0).otherwise(F.size(found) - 1)),
            "text": own_text(text),
        }
    ).drop(conv, turn, found)
