"""The registered query of each operator: the operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, decontaminate, divergence, language, line_dedup, minhash_forest, packing, periodic, quality, quotes, sharding, substring_dedup, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``: the fold of a document."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def fitted_quality(spark: SparkSession, sf_dir: str) -> quality.RuleModel:
    """Learns from labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.fit(docs.where(remainder(F.col("doc_id"), 3) != 1).join(labels, "doc_id"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fitted_quality(spark, sf_dir)
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"))
    placed = sharding.assign_shards(rows, "doc_id", shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(remainder(F.col("doc_id"), 4) != 2).select("text", "lang"))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.link_quotes(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "reply_to", "depth", "reply_path", "n_quoted", "max_level", "text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=75)


def turned(text: Column, key: Column) -> Column:
    """The text, of which a tenth of the keys repeat a stretch of words to the end: what the audit of periodic runs is held against."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        copies = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.concat(F.slice(w, 1, a), F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), copies)), F.lit(1), n - a)), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.get(F.transform(F.array(words), repeat), F.lit(0))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", turned(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.find_runs(docs, exponent=4, shortest=6)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    out = found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"), told.alias("told"), "kept")
    return out.select("doc_id", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"), F.sha2(F.col("told").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))


#: Labels (16 bytes each) up to which they go to the texts; beyond it both are shuffled by their id.
LABELS_SENT = 2_000_000


def fitted_toxicity(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learns from labelled documents outside the held-out fold."""
    fold = remainder(F.col("doc_id"), 3) != 1
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(fold & F.col("label").isNotNull())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(fold)
    return toxicity.fit(docs.join(F.broadcast(labels) if labels.count() <= LABELS_SENT else labels, "doc_id"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fitted_toxicity(spark, sf_dir)
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "log_ratio")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), top=200, least_documents=3)


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_quality, op4_sharding, op5_minhash_forest, op6_cover_tree, op7_substring_dedup, op8_language_id, op9_quote_linking, op10_decontamination, op11_periodic_runs, op12_toxicity, op13_source_divergence)}
