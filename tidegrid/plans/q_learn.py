"""Queries on learning and on whole-signal kernels; SQL where it can express them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegrid.config import Inference
from tidegrid.operators import learn, scan, stats
from tidegrid.operators.filtering import band_pass_coefficients, welch
from tidegrid.plans.bindings import activity, epochs
from tidegrid.plans.q_stats import FEATURES, LONG_SQL, feature_table, long_table, two_sided_sql
from tidegrid.plans.q_time import rounded

CV = Inference(outer_folds=4, outer_repeats=2, inner_folds=3, grid=(0.1, 1.0))


def q60_nested_cv(spark, d):
    oof = learn.nested_cv(feature_table(spark, d), "doc_id", FEATURES, "quality", CV)
    return rounded(learn.mean_probabilities(oof, "doc_id"), "prob")


def q61_adjusted_logit(spark, d):
    long = long_table(spark, d).join(feature_table(spark, d).select("doc_id", (F.col("doc_id") % 50).cast("double").alias("age")), "doc_id")
    return rounded(learn.adjusted_logit(long, "toxic", ["age"]), "beta", "se", "odds_ratio", "ci_low", "ci_high", "p", "p_fdr")


def _newton_sql(steps: int) -> str:
    """CTEs w0 to w<steps> (feature, a, b, c): Newton steps of three weights, each solved by Cramer's rule; ``last`` has the curvature."""
    out = ["w0 AS (SELECT DISTINCT feature, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM z)"]
    for k in range(steps):
        out.append(f"p{k} AS (SELECT z.feature, x, t, y - 1 / (1 + exp(-(a * x + b * t + c))) AS r, 1 / (1 + exp(-(a * x + b * t + c))) AS p FROM z JOIN w{k} ON z.feature = w{k}.feature)")
        out.append(f"s{k} AS (SELECT feature, sum(r * x) AS g0, sum(r * t) AS g1, sum(r) AS g2, sum(p * (1 - p) * x * x) AS xx, sum(p * (1 - p) * x * t) AS xt, sum(p * (1 - p) * x) AS x1, sum(p * (1 - p) * t * t) AS tt, sum(p * (1 - p) * t) AS t1, sum(p * (1 - p)) AS o FROM p{k} GROUP BY 1)")
        det = "(xx * (tt * o - t1 * t1) - xt * (xt * o - t1 * x1) + x1 * (xt * t1 - tt * x1))"
        da = "(g0 * (tt * o - t1 * t1) - xt * (g1 * o - t1 * g2) + x1 * (g1 * t1 - tt * g2))"
        db = "(xx * (g1 * o - t1 * g2) - g0 * (xt * o - t1 * x1) + x1 * (xt * g2 - g1 * x1))"
        dc = "(xx * (tt * g2 - g1 * t1) - xt * (xt * g2 - g1 * x1) + g0 * (xt * t1 - tt * x1))"
        out.append(f"w{k + 1} AS (SELECT s.feature, a + {da} / {det} AS a, b + {db} / {det} AS b, c + {dc} / {det} AS c, sqrt((tt * o - t1 * t1) / {det}) AS se FROM s{k} s JOIN w{k} w ON s.feature = w.feature)")
    return ", ".join(out)


Q61 = f"""WITH {LONG_SQL}, l AS (SELECT feature, toxic::DOUBLE AS y, value AS v, (doc_id % 50)::DOUBLE AS age FROM lng),
z AS (SELECT feature, y, (v - avg(v) OVER q) / stddev_pop(v) OVER q AS x, (age - avg(age) OVER q) / stddev_pop(age) OVER q AS t FROM l WINDOW q AS (PARTITION BY feature)), n AS (SELECT feature, count(*) AS n FROM l GROUP BY 1),
{_newton_sql(9)}, f AS (SELECT n.feature, n, a AS beta, se, a / se AS r FROM n JOIN w9 ON n.feature = w9.feature), pv AS (SELECT *, {two_sided_sql('f.r')} AS p FROM f), o AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM pv),
fd AS (SELECT *, least(greatest(min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 1) AS p_fdr FROM o)
SELECT feature, n, round(beta, 6) AS beta, round(se, 6) AS se, NULL AS error, round(exp(beta), 6) AS odds_ratio, round(exp(beta - se * 1.959963984540054), 6) AS ci_low, round(exp(beta + se * 1.959963984540054), 6) AS ci_high, round(p, 6) AS p, round(p_fdr, 6) AS p_fdr FROM fd"""


BAND = band_pass_coefficients(1.0, 20.0, 64.0, 2)


def q62_filter_bandpass(spark, d):
    """Users' values in order of time, band-passed forwards and backwards; the RMS before and after."""
    filtered = scan.zero_phase(activity(spark, d), ["user_id"], ["ts", "event_id"], "value", *BAND)
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return rounded(filtered.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), rms("value").alias("rms_in"), rms("filtered").alias("rms_out")), "rms_in", "rms_out")


def recursion_sql(name: str, source: str, b: np.ndarray, a: np.ndarray) -> str:
    """A recursive CTE (user_id, p, y) of the filter over source(user_id, p, x), from the steady state of the first sample."""
    k = len(a) - 1
    x = lambda c: f"({float(c)!r}::DOUBLE)"
    steady = np.linalg.solve(np.eye(k) - np.eye(k, k, 1) + np.outer(a[1:], np.eye(k)[0]), b[1:] - a[1:] * b[0])

    def step(own: str, state: list[str], first: str) -> str:
        y = f"({x(b[0])} * {own} + {state[0]})"
        after = [f"{state[i + 1] if i + 1 < k else '0.0'} + {x(b[i + 1])} * {own} - {x(a[i + 1])} * {y}" for i in range(k)]
        return f"SELECT {first}, {y} AS y, {', '.join(f'{e} AS s{i}' for i, e in enumerate(after))}"

    base = step("q.x", [f"{x(steady[i])} * q.x" for i in range(k)], "q.user_id, q.p")
    more = step("q.x", [f"r.s{i}" for i in range(k)], "q.user_id, q.p")
    return f"{name} AS ({base} FROM {source} q WHERE p = 0 UNION ALL {more} FROM {name} r JOIN {source} q ON q.user_id = r.user_id AND q.p = r.p + 1)"


_EDGE = 3 * len(BAND[1])
Q62 = f"""WITH RECURSIVE e AS (SELECT user_id, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
px AS (SELECT user_id, i + {_EDGE} AS p, v AS x FROM e WHERE n > {_EDGE}
 UNION ALL SELECT a.user_id, {_EDGE} - a.i, 2 * z.v - a.v FROM e a JOIN e z ON z.user_id = a.user_id AND z.i = 0 WHERE a.n > {_EDGE} AND a.i BETWEEN 1 AND {_EDGE}
 UNION ALL SELECT a.user_id, {_EDGE} + 2 * (a.n - 1) - a.i, 2 * z.v - a.v FROM e a JOIN e z ON z.user_id = a.user_id AND z.i = z.n - 1 WHERE a.n > {_EDGE} AND a.i BETWEEN a.n - 1 - {_EDGE} AND a.n - 2),
{recursion_sql('fw', 'px', *BAND)},
py AS (SELECT user_id, max(p) OVER (PARTITION BY user_id) - p AS p, y AS x FROM fw),
{recursion_sql('bw', 'py', *BAND)},
o AS (SELECT user_id, sqrt(avg(y * y)) AS rms_out FROM (SELECT *, max(p) OVER (PARTITION BY user_id) AS top FROM bw) WHERE p >= {_EDGE} AND p <= top - {_EDGE} GROUP BY 1)
SELECT e.user_id, count(*) AS n, round(sqrt(avg(v * v)), 6) AS rms_in, round(any_value(rms_out), 6) AS rms_out FROM e LEFT JOIN o USING (user_id) GROUP BY 1"""


def q63_welch_psd(spark, d):
    """Averaged periodogram of each epoch: 32-sample segments, half overlapping."""
    @F.pandas_udf("array<double>")
    def psd(x: pd.Series) -> pd.Series:
        return pd.Series(list(welch(np.stack(x.to_list()), 128.0, 0.25)[1])) if len(x) else pd.Series([], dtype=object)

    out = epochs(spark, d).select("vec_id", F.posexplode(psd("x")).alias("k", "power"))
    return rounded(out.select("vec_id", F.col("k").cast("long").alias("k"), "power"), "power", digits=8)


Q63 = """WITH x AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT unnest(range(3)) AS s),
w AS (SELECT vec_id, s, i - 16 * s AS j, v - avg(v) OVER (PARTITION BY vec_id, s) AS c FROM x, s WHERE i >= 16 * s AND i < 16 * s + 32), h AS (SELECT vec_id, s, j, c * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS c FROM w),
p AS (SELECT vec_id, s, k, pow(sum(c * cos(2 * pi() * k * j / 32)), 2) + pow(sum(c * sin(2 * pi() * k * j / 32)), 2) AS p FROM h, (SELECT unnest(range(17)) AS k) GROUP BY 1, 2, 3)
SELECT vec_id, k, round(avg(p) / (128 * 12.0) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END, 8) AS power FROM p GROUP BY 1, 2"""


def q65_permutation_cv(spark, d):
    """The permutation test of a cross-validated AUC on a small task table."""
    cfg = Inference(outer_folds=3, inner_folds=2, grid=(1.0,))
    oof = learn.nested_cv(feature_table(spark, d), "doc_id", FEATURES, "quality", cfg, repeats=1, permutations=20)
    aucs = stats.mann_whitney(learn.mean_probabilities(oof, "doc_id"), ["perm"], "prob", "label")
    return rounded(learn.permutation_test(aucs), "observed_auc", "null_mean", "null_sd", "null_p95", "p_value")


QUERIES = {n: f for n, f in list(globals().items()) if n[:2] == "q6" and n[1:3].isdigit()}
SQL = {"q61_adjusted_logit": Q61, "q62_filter_bandpass": Q62, "q63_welch_psd": Q63}
