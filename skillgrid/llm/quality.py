"""Quality classifier: a sparse rule ensemble.

Statistics of a text are Spark column expressions. Small trees on random subsets give conjunctive
rules (their paths); a logistic regression with an L1 penalty weighs rules and linear terms, most
weights end at zero, and the rest is compiled to one Spark column expression, so that scoring
runs no Python. Only the statistics of a bounded sample of labelled rows come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

Term = tuple[int, bool, float]  # feature, above?, threshold


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; a null text counts as empty. Every value is a finite double."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / n

    return {
        "log_chars": F.log1p(n),
        "letters": share(r"\p{L}+"),
        "upper": share(r"\p{Lu}+"),
        "digits": share(r"[0-9]+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:'\"-]+"),
        "spaces": share(r"\s+"),
        "stops": (F.length(t) - F.length(F.regexp_replace(t, "[.]", ""))) / n_words,
        "word_length": F.length(F.regexp_replace(t, r"\s+", "")) / n_words,
        "distinct_words": F.size(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))) / n_words,
        "distinct_lines": F.size(F.array_distinct(F.transform(lines, lambda w: F.xxhash64(w)))) / n_lines,
        "line_words": F.log1p(n_words / n_lines),
    }


@dataclass(frozen=True)
class RuleModel:
    features: tuple[str, ...]
    bias: float
    linear: tuple[tuple[int, float, float, float], ...]  # feature, weight, low, high
    rules: tuple[tuple[tuple[Term, ...], float], ...]

    def describe(self) -> list[str]:
        """The rules that count, as text."""
        return [f"{w:+.3f} if " + " and ".join(f"{self.features[f]} {'>' if up else '<='} {v:.4g}" for f, up, v in terms) for terms, w in self.rules]


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, smallest: int, tried: int) -> list[tuple[Term, ...]]:
    """Every path prefix of one Gini tree, as a conjunction."""
    out: list[tuple[Term, ...]] = []

    def grow(rows: np.ndarray, path: tuple[Term, ...]) -> None:
        own = y[rows]
        if len(path) == depth or len(rows) < 2 * smallest or own.min() == own.max():
            return
        best = None
        for f in rng.choice(x.shape[1], size=min(tried, x.shape[1]), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, left = x[rows, f][order], np.cumsum(own[order])
            at = np.arange(1, len(rows))
            ok = (v[1:] > v[:-1]) & (at >= smallest) & (len(rows) - at >= smallest)
            if not ok.any():
                continue
            p, q = left[:-1] / at, (left[-1] - left[:-1]) / (len(rows) - at)
            cost = np.where(ok, at * p * (1 - p) + (len(rows) - at) * q * (1 - q), np.inf)
            k = int(np.argmin(cost))
            if best is None or cost[k] < best[0]:
                best = (cost[k], int(f), float((v[k] + v[k + 1]) / 2))
        if best is None:
            return
        _, f, cut = best
        for up in (False, True):
            side = (*path, (f, up, cut))
            out.append(side)
            grow(rows[(x[rows, f] > cut) == up], side)

    grow(np.arange(len(y)), ())
    return out


def covers(x: np.ndarray, terms: tuple[Term, ...]) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] > v) if up else (x[:, f] <= v) for f, up, v in terms])


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the bias is free."""
    n = len(y)
    full = np.column_stack([np.ones(n), z])
    rate = 4.0 / max(np.linalg.norm(full.T @ full / n, 2), 1e-9)
    w = v = np.zeros(full.shape[1])
    k = 1.0
    for _ in range(rounds):
        grad = full.T @ (1 / (1 + np.exp(-np.clip(full @ v, -30, 30))) - y) / n
        new = v - rate * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        k, last = (1 + np.sqrt(1 + 4 * k * k)) / 2, k
        v = new + (last - 1) / k * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit(labelled: DataFrame, *, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = 12_000, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Fit on the statistics of about ``sample`` labelled rows (those with the smallest hashes of key and text).

    ``sample`` is the documented bound of what comes to the driver: a few doubles a row, at most twice
    as many rows. Rows with a null label are left out; rows that repeat key, text and label count once.
    ``key`` (a column that need not be there) only picks rows, so that copies of a text are not all in
    or all out; it is no statistic. With no labels, or one class, the model is its prior.
    """
    known = labelled.where(F.col(label).isNotNull())
    n = known.count()
    pick = F.pmod(F.xxhash64(*([F.col(key)] if key in labelled.columns else []), F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 30))
    if n > sample:
        known = known.where(pick < int(sample / n * (1 << 30)))
    stats = statistics(F.col(text))
    rows = known.select(pick, F.col(label).cast("double"), *stats.values()).toDF("pick", "label", *stats).distinct()
    rows = rows.orderBy(*rows.columns).limit(2 * sample).drop("pick").toPandas().to_numpy(float)
    names = tuple(stats)
    if not len(rows) or rows[:, 0].min() == rows[:, 0].max():
        p = (rows[:, 0].sum() + 0.5) / (len(rows) + 1)
        return RuleModel(names, float(np.log(p / (1 - p))), (), ())
    y, x = rows[:, 0], rows[:, 1:]
    rng = np.random.default_rng(seed)
    rules: dict[bytes, tuple[Term, ...]] = {}
    for _ in range(trees):
        pick = rng.integers(0, len(y), min(len(y), 2500))
        for terms in tree_rules(x[pick], y[pick], rng, depth, max(5, len(pick) // 100), 4):
            hit = covers(x, terms)
            if 0.005 < hit.mean() < 0.995:
                rules.setdefault(np.packbits(hit).tobytes(), terms)
    conditions = list(rules.values())
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    scale = np.maximum(clipped.std(axis=0), 1e-9)
    hits = np.column_stack([covers(x, c) for c in conditions]).astype(float) if conditions else np.zeros((len(y), 0))
    bias, w = lasso_logistic(np.column_stack([0.4 * (clipped - clipped.mean(axis=0)) / scale, hits]), y, penalty)
    linear = []
    for f in range(x.shape[1]):
        if w[f]:
            slope = 0.4 * w[f] / scale[f]
            bias -= slope * clipped[:, f].mean()
            linear.append((f, float(slope), float(low[f]), float(high[f])))
    kept = [(c, float(v)) for c, v in zip(conditions, w[x.shape[1] :], strict=True) if v]
    return RuleModel(names, float(bias), tuple(linear), tuple(kept))


def score(docs: DataFrame, model: RuleModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the probability (0 to 1) that the text is good. Null and empty texts get the score of an empty text.

    Each statistic is a column that is computed once, before the rules read it; they are dropped again.
    Whole texts count, however long. Rows that repeat are scored alike; an empty table gives no row. A
    column named like ``out`` is replaced; others stay, whatever their names.
    """
    named = dict(zip(model.features, fresh(docs, *model.features), strict=True))
    stats = {named[k]: v for k, v in statistics(F.col(text)).items()}
    cols = [F.col(named[f]) for f in model.features]
    total = F.lit(model.bias)
    for f, slope, low, high in model.linear:
        total = total + F.lit(slope) * F.least(F.greatest(cols[f], F.lit(low)), F.lit(high))
    for terms, weight in model.rules:
        hit = reduce(lambda a, b: a & b, [(cols[f] > v) if up else (cols[f] <= v) for f, up, v in terms])
        total = total + F.when(hit, F.lit(weight)).otherwise(0.0)
    return docs.withColumns(stats).withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).drop(*stats)
