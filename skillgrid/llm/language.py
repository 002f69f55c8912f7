"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors.

Byte 2- and 3-grams of the lower-cased text are hashed to ``DIMS`` columns. Document frequencies
cover every document that may be learnt from; the centroids, several for each language by
spherical k-means, are fitted on a bounded sample of each language. A text goes to the language
of the closest centroid by cosine; beyond a distance it can be rejected as ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _ASCII_LOWER, Scratch, fresh

DIMS = 1 << 13
UNKNOWN = "und"


def _lower(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_ASCII_LOWER)


def counts(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams of whole texts, one row each."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in enumerate(texts):
        raw = np.frombuffer(b" " + _lower(text or "") + b" ", np.uint8).astype(np.uint32)
        if len(raw) < 3:
            continue
        two = raw[:-1] * np.uint32(257) + raw[1:]
        three = two[:-1] * np.uint32(2654435761) + raw[2:] * np.uint32(40503)
        hashed = np.concatenate([(two * np.uint32(2246822519)) >> np.uint32(19), (three * np.uint32(2246822519)) >> np.uint32(19)])
        out[row] = np.bincount(hashed, minlength=DIMS)
    return out


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of sublinear term frequency times inverse document frequency; an empty text is zero."""
    v = np.log1p(found) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; at most ``k`` unit centroids."""
    centres = [x.mean(axis=0)]
    for _ in range(1, min(k, len(x))):
        near = np.max(np.stack([x @ c for c in centres]), axis=0)
        centres.append(x[int(np.argmin(near))])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # of each centroid's language: nearly all rows it was learnt from are closer to it than this


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = 400, clusters: int = 4, small: int = 100_000, far: float = 0.005) -> LanguageModel:
    """Learn from rows with a language and a text that is not null.

    Document frequencies use every such row. Centroids use about ``per_language`` different texts of
    each language, those with the smallest hashes, and at most twice as many; that is the documented
    bound of the sample (a language with fewer gives all). Every language is learnt, however rare; its
    clustering is one task of its sample, and the model holds ``clusters`` times 32 KB of it. Shares of the
    sample are sent to the texts for up to ``small`` languages, and joined by a shuffle for more. ``far`` is
    the share of a language's sample that lies beyond its floor, the cosine from which ``identify`` can
    reject. Empty tables give a model that knows none.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = counts(batch.column("text").slice(at, 64).to_pylist())
                df += (found > 0).sum(axis=0)
                n += len(found)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(DIMS + 1)), "df": pa.array(np.append(df, n))})

    totals = known.select("text").mapInArrow(frequencies, "i long, df long").groupBy("i").agg(F.sum("df").alias("df")).collect()  # DIMS + 1 rows
    df = np.zeros(DIMS + 1)
    for i, n in totals:
        df[i] = n
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    texts = known.groupBy("lang").agg(F.approx_count_distinct("text").alias("texts"))
    shares = Scratch(known.sparkSession).keep(texts.select("lang", F.least(F.lit(1.0), F.lit(1.2 * per_language) / F.col("texts")).alias("share")))
    sent = F.broadcast(shares) if shares.count() <= small else shares
    pick = F.xxhash64("text")
    unit = F.pmod(pick, F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(sent, "lang").where(unit < F.col("share")).select("lang", "text", pick.alias("pick"))
    sample = sample.dropDuplicates(["lang", "pick"]).withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("pick"))).where(F.col("at") <= 2 * per_language).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                v = vectors(counts(part.column("text").to_pylist()), idf)
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "v": pa.array([r.astype(np.float16).tobytes() for r in v], pa.binary())})

    def centres(own: pa.Table) -> pa.Table:
        """The centroids of one language and its floor; at most twice ``per_language`` rows."""
        rows = sorted(own.column("v").to_pylist())
        x = np.stack([np.frombuffer(v, np.float16) for v in rows]).astype(np.float32)
        c = cluster(x, clusters)
        floor = float(np.quantile((x @ c.T).max(axis=1), far))
        return pa.table({"lang": [own.column("lang")[0].as_py()] * len(c), "at": pa.array(range(len(c)), pa.int32()), "centre": [v.tobytes() for v in c], "floor": [floor] * len(c)})

    schema = "lang string, at int, centre binary, floor double"
    found = sorted(sample.mapInArrow(features, "lang string, v binary").groupBy("lang").applyInArrow(centres, schema).collect())  # the model itself
    centroids = np.stack([np.frombuffer(r.centre, np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32)
    return LanguageModel(tuple(r.lang for r in found), centroids, idf, np.array([r.floor for r in found]))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", reject_below: float = 0.0, reject_far: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (cosine with the closest centroid, 0 to 1).

    ``und`` with score 0: the text is null or has no letter, no language was learnt, or the closest
    centroid's cosine is under ``reject_below`` or, with ``reject_far``, under the floor learnt for its
    language. Ties go to the first language by name. Whole texts count, however long. Rows that repeat
    are predicted alike; an empty table gives no row. Columns named like the new ones are replaced.
    """
    floors = np.maximum(model.floors if reject_far else np.zeros(len(model.languages)), reject_below)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            best, score = [], []
            for at in range(0, len(texts), 64):
                v = vectors(counts(texts.iloc[at : at + 64].tolist()), model.idf)
                if not model.languages:
                    best += [UNKNOWN] * len(v)
                    score += [0.0] * len(v)
                    continue
                cosine = v @ model.centroids.T
                top = np.argmax(cosine, axis=1)
                close = np.clip(cosine[np.arange(len(v)), top].astype(float), 0, 1)
                best += [model.languages[j] if s >= floors[j] else UNKNOWN for j, s in zip(top, close, strict=True)]
                score += [float(s) if s >= floors[j] else 0.0 for j, s in zip(top, close, strict=True)]
            yield pd.DataFrame({"lang_pred": best, "score": score})

    kept = docs.drop("lang_pred", "score")
    (said,) = fresh(kept, "said")
    value = F.col(text).cast("string")
    ok = has_letter(value)
    out = kept.withColumn(said, predict(F.coalesce(value, F.lit(""))))
    return out.withColumns({"lang_pred": F.when(ok, F.col(said)["lang_pred"]).otherwise(UNKNOWN), "score": F.when(ok, F.col(said)["score"]).otherwise(0.0)}).drop(said)
