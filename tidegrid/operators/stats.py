"""Two-group statistics over long tables (feature, value, label) of a cohort's subjects."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.expr import average_rank, normal_two_sided, number, safe_corr
from tidegrid.sources.shared import written


def long_features(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(ids, feature, value) with values that are no finite numbers left out."""
    numbers = df.select(*ids, *(number(F.col(f)).alias(f) for f in features))
    return numbers.unpivot(list(ids), list(features), "feature", "value").filter("value is not null")


def hedges_g(value: str, label: str) -> Column:
    """Bias-corrected standardised mean difference, as an aggregate; null with fewer than two in a group or no spread."""
    one, zero = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    n1, n0 = F.count(one), F.count(zero)
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.var_samp(one) + (n0 - 1) * F.var_samp(zero), n1 + n0 - 2))
    g = F.try_divide(F.avg(one) - F.avg(zero), F.nullif(pooled, F.lit(0.0))) * (F.lit(1.0) - F.lit(3.0) / (4 * (n1 + n0) - 9))
    return F.when((n1 >= 2) & (n0 >= 2), g)


#: With a group of at most so many values, and no ties, the law of U is enumerated.
FEW = 8


def exact_u(n1: Column, n0: Column, u: Column) -> Column:
    """Two-sided p of U without ties: twice the share of all orders with a U as far out.

    The number of orders with each U are the coefficients of prod (1 - q^(n + i)) / (1 - q^i), i up to the smaller group's size k;
    only those up to the smaller tail are made, in k steps. Meant for small k: the work is k times the tail.
    """
    k, n = F.least(n1, n0).cast("int"), F.greatest(n1, n0).cast("int")
    tail = F.floor(F.least(u, (n1 * n0).cast("double") - u)).cast("int")
    start = F.transform(F.sequence(F.lit(0), tail), lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def step(ways: Column, i: Column) -> Column:
        less = F.transform(ways, lambda w, s: w - F.when(s >= n + i, F.get(ways, s - n - i)).otherwise(0.0))
        # dividing by 1 - q^i adds up every i-th coefficient
        return F.aggregate(less, F.array().cast("array<double>"), lambda done, w: F.array_append(done, w + F.coalesce(F.get(done, F.size(done) - i), F.lit(0.0))))

    ways = F.aggregate(F.sequence(F.lit(1), k), start, step)
    orders = F.aggregate(F.sequence(F.lit(1), k), F.lit(1.0), lambda a, i: a * (n + i) / i)
    return F.least(2 * F.aggregate(ways, F.lit(0.0), lambda a, w: a + w) / orders, F.lit(1.0))


def mann_whitney(long: DataFrame, keys: Sequence[str], value: str, label: str) -> DataFrame:
    """U of the group with label 1, its two-sided p, and AUC.

    p is exact where a group has FEW values or fewer and none are equal; else it is the normal approximation with tie and continuity correction.
    """
    keys = list(keys)
    by = rank_sums(long, keys, value, label)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("__ranks") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("__ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5, F.nullif(spread, F.lit(0.0)))
    few = (F.col("__ties") == 0) & (F.least("n1", "n0") <= FEW) & (F.least("n1", "n0") > 0)
    p = F.when(few, exact_u(F.col("n1"), F.col("n0"), u)).otherwise(normal_two_sided(F.greatest(z, F.lit(0.0))))
    return by.select(*keys, "n1", "n0", u.alias("u"), F.try_divide(u, n1 * n0).alias("auc"), p.alias("p"))


def running(points: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """points with <sum>_before for each of ``sums``: its total over the rows of the same keys before it in the order.

    Rows are dealt by ranges and written; totals of the ranges, one row for each range and key, are summed along, and inside a range its
    own rows. So no key has to fit into a task, and a single key is spread like many.
    """
    keys = list(keys)
    ranged = written(points.repartitionByRange(*keys, order).withColumn("__range", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy(*keys, "__range").agg(*(F.sum(s).alias(f"__{s}") for s in sums))
    along = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__range", *(F.coalesce(F.sum(f"__{s}").over(along), F.lit(0)).alias(f"__{s}") for s in sums))
    own = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(own), F.lit(0)) for s in sums})
    on = F.lit(True)
    for k in (*keys, "__range"):
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = inside.alias("a").join(ends.alias("b"), on)
    return joined.select(*(f"a.{c}" for c in points.columns), *((F.col(f"a.{s}_before") + F.col(f"b.__{s}")).alias(f"{s}_before") for s in sums))


def rank_sums(long: DataFrame, keys: Sequence[str], value: str, label: str) -> DataFrame:
    """(keys, n1, n0, __ranks, __ties): sizes of the groups, the sum of mean ranks of label 1, and the sum of t^2 - 1 over the rows with t equal values.

    Rows are counted by value first; ranks are running sums over ranges of the values.
    """
    one, zero = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    points = long.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__t"), one.alias("__one"), zero.alias("__zero"))
    ranked = running(points, keys, "__v", ["__t"]).withColumn("__r", F.col("__t_before") + (F.col("__t") + 1) / F.lit(2.0))
    t = F.col("__t").cast("double")
    return ranked.groupBy(*keys).agg(F.sum("__one").alias("n1"), F.sum("__zero").alias("n0"), F.sum(F.when(F.col("__one") > 0, F.col("__one") * F.col("__r"))).alias("__ranks"), F.sum(t * (t * t - 1)).alias("__ties"))


def bh_fdr(df: DataFrame, p: str, out: str = "p_fdr", by: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg: p n / rank, made monotone from the largest p down, within [0, 1]."""
    ordered = Window.partitionBy(*by).orderBy(F.col(p))
    ranked = df.withColumn("__rank", F.row_number().over(ordered)).withColumn("__n", F.count(p).over(Window.partitionBy(*by)))
    raised = F.col(p) * F.col("__n") / F.col("__rank")
    down = Window.partitionBy(*by).orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.greatest(F.min(raised).over(down), F.lit(0.0)), F.lit(1.0))).drop("__rank", "__n")


def group_tests(long: DataFrame, value: str, label: str, alpha: float = 0.05) -> DataFrame:
    """Per feature: medians, U, p, g, and the FDR over all features; fewer than three in a group gives nulls."""
    effects = long.groupBy("feature").agg(F.median(F.when(F.col(label) == 1, F.col(value))).alias("median_1"), F.median(F.when(F.col(label) == 0, F.col(value))).alias("median_0"), hedges_g(value, label).alias("g"))
    tests = mann_whitney(long, ["feature"], value, label)
    few = (F.col("n1") < 3) | (F.col("n0") < 3)
    joined = effects.join(tests, "feature").withColumns({c: F.when(~few, F.col(c)) for c in ("median_1", "median_0", "u", "p", "g")})
    return bh_fdr(joined, "p").withColumn("significant", F.coalesce(F.col("p_fdr") < alpha, F.lit(False)))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, levels and Cramer's V without correction; null with fewer than two levels on a side."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows, columns = Window.partitionBy(a), Window.partitionBy(b)
    marginal = cells.withColumns({"r": F.sum("o").over(rows), "c": F.sum("o").over(columns)})
    # sum over cells of o^2 / (r c) is chi2 / n + 1
    facts = marginal.agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"))
    least = F.least("n_a", "n_b")
    return facts.select(F.col("n").cast("long").alias("n"), "n_a", "n_b", F.when(least >= 2, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / (least - 1))).alias("v"))


def batch_confound(df: DataFrame, batch: str, label: str, flag_at: float = 0.6) -> DataFrame:
    """One row: Cramer's V of batch and label, whether the batch fixes the label, and whether that or V is flagged."""
    fixed = df.groupBy(batch).agg(F.count_distinct(label).alias("k")).agg((F.max("k") <= 1).alias("perfectly_predicts"))
    return cramers_v(df, batch, label).join(F.broadcast(fixed)).withColumn("flagged", F.coalesce(F.col("perfectly_predicts"), F.lit(False)) | F.coalesce(F.col("v") >= flag_at, F.lit(False)))


def log_factorial(n: Column) -> Column:
    """By Stirling's series from 10 up, by the logs themselves below; the same work for any n."""
    x = n.cast("double")
    small = F.get(F.array(*(F.lit(math.lgamma(k + 1)) for k in range(10))), n.cast("int"))
    series = x * F.ln(x) - x + F.ln(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 2, F.lit(0.0)).when(n < 10, small).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def _mass(low: Column, high: Column, log_p: Callable[[Column], Column], most: Column | None = None) -> Column:
    """Sum of exp(log_p) from low to high, only of those with log_p up to ``most`` if it is given."""
    p = lambda i: F.exp(log_p(i)) if most is None else F.when(log_p(i) <= most, F.exp(log_p(i))).otherwise(0.0)
    return F.when(low > high, F.lit(0.0)).otherwise(F.aggregate(F.sequence(low, F.greatest(low, high)), F.lit(0.0), lambda total, i: total + p(i)))


def binomial_greater(k: Column, n: Column) -> Column:
    """P(X >= k) for n fair trials. Terms 12 deviations away from the middle, or that far above k, vanish: the work grows with the root of n."""
    k, n = k.cast("bigint"), n.cast("bigint")
    reach = F.ceil(6 * F.sqrt(n.cast("double"))) + 50
    low = F.greatest(k, F.floor(n / 2) - reach)
    high = F.least(n, F.greatest(k, F.floor(n / 2)) + reach)
    return F.least(_mass(low, high, lambda i: log_choose(n, i) - n * math.log(2)), F.lit(1.0))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2 x 2 table: all tables with its margins that are no likelier. Tables 12 deviations off the middle vanish."""
    a, b, c, d = (x.cast("bigint") for x in (a, b, c, d))
    row, column, n = a + b, a + c, a + b + c + d
    middle = F.coalesce(F.try_divide(row.cast("double") * column, n), F.lit(0.0))
    reach = F.ceil(12 * F.sqrt(F.coalesce(F.try_divide(middle * (n - row) * (n - column), n.cast("double") * F.greatest(n - 1, F.lit(1))), F.lit(0.0)))) + 50
    low = F.greatest(F.lit(0).cast("bigint"), row + column - n, F.floor(middle) - reach)
    high = F.least(row, column, F.ceil(middle) + reach)
    log_p = lambda x: log_choose(row, x) + log_choose(n - row, column - x) - log_choose(n, column)
    return F.least(_mass(low, high, log_p, log_p(a) + 1e-7), F.lit(1.0))


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row: confusion counts and what follows from them, with the Brier score."""
    y, yes = F.col(label) == 1, F.col(score) >= threshold
    counts = df.agg(F.count_if(y & yes).alias("tp"), F.count_if(~y & yes).alias("fp"), F.count_if(y & ~yes).alias("fn"), F.count_if(~y & ~yes).alias("tn"), F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    mcc = F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))
    return counts.select("tp", "fp", "fn", "tn", "brier", sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), mcc.alias("mcc"))


def average_precision(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Sum over distinct scores, falling, of the recall gained times the precision there. Ties share one point."""
    points = df.groupBy(*keys, (-F.col(score)).alias("__down")).agg(F.sum(label).alias("__pos"), F.count(F.lit(1)).alias("__n"))
    curve = running(points, keys, "__down", ["__pos", "__n"])
    precision = (F.col("__pos_before") + F.col("__pos")) / (F.col("__n_before") + F.col("__n"))
    return curve.groupBy(*keys).agg(F.try_divide(F.sum(F.col("__pos") * precision), F.sum("__pos").cast("double")).alias("average_precision"))


def hash_int(*parts: Column) -> Column:
    """A 32-bit number from the MD5 of the parts joined by ':'; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def permutation_auc(df: DataFrame, key: str, label: str, score: str, n: int) -> DataFrame:
    """(perm, auc) for n label permutations, each the order of a hash of key and permutation; 0 is the observed labels.

    Every row is repeated for each permutation and permutations are ranked apart, so the work is n independent tasks.
    """
    points = running(df.groupBy(score).agg(F.count(F.lit(1)).alias("__t")), [], score, ["__t"])
    ranks = points.select(score, (F.col("__t_before") + (F.col("__t") + 1) / F.lit(2.0)).alias("__r"))
    sizes = df.agg(F.count(F.lit(1)).alias("__n"), F.sum(label).alias("__n1"))
    base = df.select(key, label, score).join(ranks, score).drop(score).join(F.broadcast(sizes))  # one row
    many = base.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n))))
    place = F.row_number().over(Window.partitionBy("perm").orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("perm").cast("string"))), key))
    chosen = F.when(F.col("perm") == 0, F.col(label) == 1).otherwise(F.col("__place") <= F.col("__n1"))
    n1, n_all = F.first("__n1").cast("double"), F.first("__n").cast("double")
    return many.withColumn("__place", place).groupBy("perm").agg(((F.sum(F.when(chosen, F.col("__r"))) - n1 * (n1 + 1) / 2) / (n1 * (n_all - n1))).alias("auc"))


# The cumulative Poisson distribution of mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def bootstrap_means(df: DataFrame, key: str, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """(keys, b, mean) of n Poisson bootstrap samples: every row's weight comes from a hash of its key and b.

    No sample is materialised by joins; sums are combined before the shuffle.
    """
    u = hash_int(F.col(key), F.col("b")) / float(2**32)
    weight = sum(((u >= c).cast("int") for c in POISSON), F.lit(0))
    many = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__w", weight)
    return many.groupBy(*keys, "b").agg(F.try_divide(F.sum(F.col("__w") * F.col(value)), F.sum("__w")).alias("mean"))


def bootstrap_g(long: DataFrame, key: str, value: str, label: str, n: int) -> DataFrame:
    """(feature, g_ci_low, g_ci_high): percentile interval of Hedges g over n Poisson bootstrap samples of the subjects."""
    u = hash_int(F.col(key), F.col("b")) / float(2**32)
    weight = sum(((u >= c).cast("int") for c in POISSON), F.lit(0))
    many = long.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__w", weight.cast("double"))
    sums = []
    for k in (1, 0):
        w = F.when(F.col(label) == k, F.col("__w"))
        sums += [F.sum(w).alias(f"n{k}"), F.sum(w * F.col(value)).alias(f"s{k}"), F.sum(w * F.col(value) * F.col(value)).alias(f"q{k}")]
    by = many.groupBy("feature", "b").agg(*sums)
    mean = lambda k: F.try_divide(F.col(f"s{k}"), F.col(f"n{k}"))
    scatter = lambda k: F.col(f"q{k}") - F.col(f"s{k}") * mean(k)
    total_n = F.col("n1") + F.col("n0")
    pooled = F.sqrt(F.greatest(F.try_divide(scatter(1) + scatter(0), total_n - 2), F.lit(0.0)))
    g = F.try_divide(mean(1) - mean(0), F.nullif(pooled, F.lit(0.0))) * (F.lit(1.0) - F.try_divide(F.lit(3.0), 4 * total_n - 9))
    usable = F.when((F.col("n1") >= 2) & (F.col("n0") >= 2), g)
    return by.select("feature", usable.alias("g")).groupBy("feature").agg(F.percentile("g", F.lit(0.025)).alias("g_ci_low"), F.percentile("g", F.lit(0.975)).alias("g_ci_high"))


def bootstrap_auc(df: DataFrame, key: str, label: str, score: str, n: int) -> DataFrame:
    """(b, auc) of n Poisson bootstrap samples of the subjects; null where a sample has one class only.

    Weights of equal scores are summed first; the rest is a running sum by score within each sample.
    """
    u = hash_int(F.col(key), F.col("b")) / float(2**32)
    weight = sum(((u >= c).cast("int") for c in POISSON), F.lit(0))
    many = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__w", weight)
    points = many.groupBy("b", score).agg(F.sum(F.col("__w") * F.col(label)).cast("double").alias("__one"), F.sum(F.col("__w") * (1 - F.col(label))).cast("double").alias("__zero"))
    below = F.sum("__zero").over(Window.partitionBy("b").orderBy(score)) - F.col("__zero") / 2
    return points.withColumn("__below", below).groupBy("b").agg(F.try_divide(F.sum(F.col("__one") * F.col("__below")), F.nullif(F.sum("__one") * F.sum("__zero"), F.lit(0.0))).alias("auc"))


def bootstrap_auc_repeats(oof: DataFrame, subject: str, repeat: str, label: str, prob: str, n: int) -> DataFrame:
    """(b, auc) of n Poisson bootstrap samples of both the subjects and the repeats of cross-validation.

    In a sample, a subject's probability is the mean over the repeats with their weights; sums are combined before each shuffle.
    """
    weight = lambda *parts: sum(((hash_int(*parts) / float(2**32) >= c).cast("int") for c in POISSON), F.lit(0))
    many = oof.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__r", weight(F.lit("repeat"), F.col(repeat), F.col("b")))
    own = many.groupBy("b", subject).agg(F.first(label).alias("__y"), F.try_divide(F.sum(F.col("__r") * F.col(prob)), F.sum("__r")).alias("__p"))
    own = own.filter("__p is not null").withColumn("__w", weight(F.col(subject), F.col("b")))
    points = own.groupBy("b", "__p").agg(F.sum(F.col("__w") * F.col("__y")).cast("double").alias("__one"), F.sum(F.col("__w") * (1 - F.col("__y"))).cast("double").alias("__zero"))
    below = F.sum("__zero").over(Window.partitionBy("b").orderBy("__p")) - F.col("__zero") / 2
    return points.withColumn("__below", below).groupBy("b").agg(F.try_divide(F.sum(F.col("__one") * F.col("__below")), F.nullif(F.sum("__one") * F.sum("__zero"), F.lit(0.0))).alias("auc"))


def sign_agreement(effects: DataFrame, a: str, b: str, key: str, n_boot: int = 2000) -> DataFrame:
    """One row: how many features have effects of the same sign, its bootstrap interval over the features (95 %), its
    binomial p, and the effects' Spearman correlation. ``key`` names the features."""
    good = effects.filter(number(F.col(a)).isNotNull() & number(F.col(b)).isNotNull())
    ranked = good.withColumns({"__x": average_rank(a), "__y": average_rank(b)})
    out = ranked.agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.signum(a) == F.signum(b)).alias("n_agreeing"), F.when(F.count(F.lit(1)) >= 3, safe_corr("__x", "__y")).alias("spearman_effects"))
    agreeing = good.select(F.col(key).alias("__key"), (F.signum(a) == F.signum(b)).cast("double").alias("__agrees"))
    means = bootstrap_means(agreeing, "__key", [], "__agrees", n_boot)
    out = out.join(F.broadcast(means.agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"))))  # one row
    return out.withColumns({"sign_agreement": F.try_divide(F.col("n_agreeing").cast("double"), F.col("n_features").cast("double")), "p_binomial": F.when(F.col("n_features") > 0, binomial_greater(F.col("n_agreeing"), F.col("n_features")))})


def z_score(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    own = Window.partitionBy(*keys)
    return df.withColumn(out, F.try_divide(F.col(value) - F.avg(value).over(own), F.nullif(F.stddev_pop(value).over(own), F.lit(0.0))))
