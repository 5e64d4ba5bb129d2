"""Out-of-fold classification of a cohort as a table of independent tasks, and adjusted logistic models.

A cohort's feature matrix has a row per subject. It is broadcast behind a check of its size; repeats, folds and permutations are
rows of a task table that Spark spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import Inference, check_model_columns
from tidegrid.functions.expr import finite, normal_two_sided
from tidegrid.operators.stats import bh_fdr
from tidegrid.sources.shared import written

#: Values of a feature matrix that may be broadcast; a larger cohort is refused (pyspark.ml fits those).
MOST_VALUES = 20_000_000


def logistic(x: np.ndarray, y: np.ndarray, c: float, rounds: int = 50) -> np.ndarray:
    """L2-penalised logistic regression by Newton steps; the last weight is the intercept, penalised like the others."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = w + c * x.T @ (p - y)
        curve = np.eye(len(w)) + c * (x * (p * (1 - p))[:, None]).T @ x
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-10:
            break
    return w


def prepare(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Median-imputed and standardised by the training rows alone."""
    middle = np.nanmedian(np.where(np.isfinite(train), train, np.nan), axis=0)
    middle = np.where(np.isfinite(middle), middle, 0.0)
    filled = [np.where(np.isfinite(m), m, middle) for m in (train, *others)]
    mean, sd = filled[0].mean(axis=0), filled[0].std(axis=0)
    return [(m - mean) / np.where(sd > 0, sd, 1.0) for m in filled]


def probabilities(train_x: np.ndarray, train_y: np.ndarray, test_x: np.ndarray, c: float) -> np.ndarray:
    a, b = prepare(train_x, test_x)
    w = logistic(a, train_y, c)
    return 1 / (1 + np.exp(-np.clip(b @ w[:-1] + w[-1], -35, 35)))


def auc(y: np.ndarray, score: np.ndarray) -> float:
    n1 = int(y.sum())
    if n1 in (0, len(y)):
        return float("nan")
    values, where, counts = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[where]
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


def folds(y: np.ndarray, k: int, seed: Sequence[int]) -> np.ndarray:
    """Stratified fold of each row: the rows of each class are shuffled and dealt in turn."""
    rng, out, at = np.random.default_rng(seed), np.empty(len(y), int), 0
    for label in np.unique(y):
        rows = rng.permutation(np.flatnonzero(y == label))
        out[rows] = (np.arange(len(rows)) + at) % k
        at += len(rows)
    return out


def chosen_c(x: np.ndarray, y: np.ndarray, grid: Sequence[float], inner: int, seed: Sequence[int]) -> float:
    """The penalty of the best mean inner AUC, the first of equals."""
    part = folds(y, inner, seed)
    means = []
    for c in grid:
        found = [auc(y[part == k], probabilities(x[part != k], y[part != k], x[part == k], c)) for k in range(inner)]
        means.append(np.nanmean(found) if np.isfinite(found).any() else -np.inf)
    return grid[int(np.argmax(means))]


def outer_fold(x: np.ndarray, y: np.ndarray, perm: int, repeat: int, fold: int, cfg: Inference) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, labels, probabilities) of one held-out fold; permutation 0 is the observed labels."""
    labels = y if perm == 0 else np.random.default_rng([cfg.seed, 7, perm]).permutation(y)
    part = folds(labels, cfg.outer_folds, [cfg.seed, perm, repeat])
    train, test = part != fold, np.flatnonzero(part == fold)
    c = chosen_c(x[train], labels[train], cfg.grid, cfg.inner_folds, [cfg.seed, perm, repeat, fold])
    return test, labels[test], probabilities(x[train], labels[train], x[test], c)


def _matrix(features: DataFrame, key: str, columns: Sequence[str], label: str) -> tuple[list, np.ndarray, np.ndarray]:
    n = features.count()
    if n * max(1, len(columns)) > MOST_VALUES:
        raise ValueError(f"{n} subjects with {len(columns)} features are too many to give to every task")
    rows = features.select(key, label, *columns).orderBy(key).toPandas()
    return rows[key].tolist(), rows[list(columns)].to_numpy(float), rows[label].to_numpy(int)


def nested_cv(features: DataFrame, key: str, columns: Sequence[str], label: str, cfg: Inference, repeats: int | None = None, permutations: int = 0, guard: bool = True) -> DataFrame:
    """(perm, repeat, fold, key, label, prob): out-of-fold probabilities; the penalty is chosen inside each training part."""
    if guard:
        check_model_columns(list(columns))
    spark: SparkSession = features.sparkSession
    keys, x, y = _matrix(features, key, columns, label)
    shared = spark.sparkContext.broadcast((keys, x, y))
    repeats = cfg.outer_repeats if repeats is None else repeats
    n_tasks = (permutations + 1) * repeats * cfg.outer_folds
    kind = dict(features.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix, labels = shared.value
        for batch in batches:
            for task in batch["id"]:
                rest, fold = divmod(int(task), cfg.outer_folds)
                perm, repeat = divmod(rest, repeats)
                rows, own, prob = outer_fold(matrix, labels, perm, repeat, fold, cfg)
                yield pd.DataFrame({"perm": perm, "repeat": repeat, "fold": fold, key: [names[i] for i in rows], "label": own, "prob": prob})

    tasks = spark.range(n_tasks).repartition(min(n_tasks, 4 * spark.sparkContext.defaultParallelism))
    return tasks.mapInPandas(run, f"perm int, repeat int, fold int, {key} {kind}, label int, prob double")


def mean_probabilities(oof: DataFrame, key: str) -> DataFrame:
    return oof.groupBy("perm", key).agg(F.first("label").alias("label"), F.avg("prob").alias("prob"))


def permutation_test(aucs: DataFrame) -> DataFrame:
    """aucs(perm, auc) -> one row: observed, null mean, deviation, 95th percentile and p = (1 + n at least as large) / (1 + n)."""
    observed = aucs.filter("perm = 0").select(F.col("auc").alias("observed"))
    null = aucs.filter("perm > 0").join(F.broadcast(observed))
    return null.agg(F.count(F.lit(1)).alias("n_permutations"), F.max("observed").alias("observed_auc"), F.avg("auc").alias("null_mean"), F.stddev_samp("auc").alias("null_sd"), F.percentile("auc", F.lit(0.95)).alias("null_p95"), ((F.count_if(F.col("auc") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def _newton_sums(rows: DataFrame, width: int) -> DataFrame:
    """(feature, g0.., h0_0..): slope and curvature of the log likelihood at each row's weights ``w``, added up by feature."""
    x = lambda i: F.get("x", F.lit(i))
    score = sum((x(i) * F.get("w", F.lit(i)) for i in range(width)), F.lit(0.0))
    placed = rows.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(score, F.lit(35.0)), F.lit(-35.0)))))
    off, curve = F.col("y") - F.col("p"), F.col("p") * (1 - F.col("p"))
    sums = [F.sum(off * x(i)).alias(f"g{i}") for i in range(width)] + [F.sum(curve * x(i) * x(j)).alias(f"h{i}_{j}") for i in range(width) for j in range(i, width)]
    return placed.groupBy("feature").agg(*sums)


def adjusted_logit(long: DataFrame, label: str, covariates: Sequence[str], least: int = 20, rounds: int = 100) -> DataFrame:
    """Per feature: a logistic model of the label on the z-scored value and covariates; odds ratio per deviation, CI, p and FDR.

    Every Newton step is one aggregation of sums of products over all rows, combined before the shuffle; the driver holds a few numbers
    for each feature and solves its small system. A model that can't be fitted gives its error.
    """
    columns, keep = ["value", *covariates], F.lit(True)
    for c in (*columns, label):
        keep = keep & finite(F.col(c).cast("double"))
    rows = long.select("feature", F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in columns)).filter(keep)
    moments = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *(c for v in columns for c in (F.avg(v).alias(f"__m_{v}"), F.stddev_pop(v).alias(f"__s_{v}"))))
    facts = {r.feature: r.asDict() for r in long.select("feature").distinct().join(moments, "feature", "left").collect()}
    width = len(columns) + 1
    errors, weights, found = {}, {}, {}
    for name, f in facts.items():
        if (f["n"] or 0) < least:
            errors[name] = "too few subjects"
        elif not all(f[f"__s_{v}"] > 0 for v in columns):
            errors[name] = "a column that doesn't vary"
        else:
            weights[name] = [0.0] * width
    spark = long.sparkSession
    if weights:
        scaled = [(F.col(v) - F.col(f"__m_{v}")) / F.col(f"__s_{v}") for v in columns]
        usable = F.broadcast(moments.filter(F.col("feature").isin(*weights)))  # a row for each feature
        rows = written(rows.join(usable, "feature").select("feature", "y", F.array(*scaled, F.lit(1.0)).alias("x")), "scaled-subjects")
    for _ in range(rounds):
        if not weights:
            break
        now = spark.createDataFrame(list(weights.items()), "feature string, w array<double>")
        for r in _newton_sums(rows.join(F.broadcast(now), "feature"), width).collect():
            curve = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)])
            try:
                move = np.linalg.solve(curve, np.array([r[f"g{i}"] for i in range(width)]))
                spread = float(np.sqrt(np.linalg.inv(curve)[0, 0]))
            except np.linalg.LinAlgError as error:
                errors[r.feature] = str(error)[:120]
                del weights[r.feature]
                continue
            weights[r.feature] = [w + float(m) for w, m in zip(weights[r.feature], move, strict=True)]
            if np.abs(move).max() < 1e-10:
                found[r.feature] = (weights.pop(r.feature)[0], spread)
    errors |= dict.fromkeys(weights, "no convergence")
    out = [(name, facts[name]["n"] or 0, *(float(v) if np.isfinite(v) else None for v in found.get(name, (np.nan, np.nan))), errors.get(name)) for name in facts]
    clean = spark.createDataFrame(out, "feature string, n long, beta double, se double, error string")
    margin = F.col("se") * 1.959963984540054
    full = clean.withColumns({"odds_ratio": F.exp("beta"), "ci_low": F.exp(F.col("beta") - margin), "ci_high": F.exp(F.col("beta") + margin), "p": normal_two_sided(F.try_divide("beta", "se"))})
    tested = bh_fdr(full.filter("p is not null"), "p").select("feature", "p_fdr")
    return full.join(tested, "feature", "left")
