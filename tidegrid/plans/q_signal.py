"""Queries on spectra, complexity and epochs, with their SQL. An embedding is an epoch of 64 samples at 128 Hz."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.config import PROFILE_BANDS, Acquisition, Epoching
from tidegrid.operators import complexity, epochs, spectral
from tidegrid.plans.bindings import epochs as epoch_table
from tidegrid.plans.q_time import rounded

N, FS = 64, 128.0
STEP = FS / N

X_SQL = "x AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
PSD_SQL = f"{X_SQL}, psd AS (SELECT vec_id, label, k, CAST(k * {STEP} AS DOUBLE) AS f, pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2) AS p FROM x, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2, 3)"


def spectra(spark, d):
    return epoch_table(spark, d).withColumn("p", spectral.power_spectrum("x"))


def share_sql(low: float, high: float, ref: tuple[float, float] = (1, 40)) -> str:
    return f"coalesce(sum(p) FILTER (f >= {low} AND f < {high}), 0) / (sum(p) FILTER (f >= {ref[0]} AND f < {ref[1]}) + 1e-30)"


def q26_dft_band_share(spark, d):
    p = F.col("p")
    out = spectra(spark, d).select("vec_id", spectral.band_share(p, 8, 13, STEP).alias("alpha"), spectral.band_share(p, 0.5, 3, STEP).alias("ocular"), spectral.band_share(p, 49, 51, STEP, (1, 45)).alias("line"))
    return rounded(out, "alpha", "ocular", "line")


Q26 = f"WITH {PSD_SQL} SELECT vec_id, round({share_sql(8, 13)}, 6) AS alpha, round({share_sql(0.5, 3)}, 6) AS ocular, round({share_sql(49, 51, (1, 45))}, 6) AS line FROM psd GROUP BY 1"


def q27_spectral_entropy(spark, d):
    return rounded(spectra(spark, d).select("vec_id", spectral.spectral_entropy(F.col("p"), STEP).alias("entropy")), "entropy")


Q27 = f"WITH {PSD_SQL}, s AS (SELECT vec_id, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-30) AS q FROM psd WHERE f >= 1 AND f < 40) SELECT vec_id, round(sum(-q * ln(q + 1e-30)) / ln(count(*)), 6) AS entropy FROM s GROUP BY 1"


def q28_spectral_profile(spark, d):
    own = spectra(spark, d).select("label", spectral.profile(F.col("p"), PROFILE_BANDS, STEP).alias("prof"))
    means = spectral.mean_profile(own, ["label"], "prof", len(PROFILE_BANDS), "mean")
    return means.select("label", *(F.round(F.get("mean", F.lit(i)), 6).alias(f"prof_{n}") for i, n in enumerate(PROFILE_BANDS)))


_SHARES = ", ".join(f"{share_sql(*b)} AS {n}" for n, b in PROFILE_BANDS.items())
_MEANS = ", ".join(f"avg({n}) AS {n}" for n in PROFILE_BANDS)
Q28 = f"WITH {PSD_SQL}, s AS (SELECT vec_id, label, {_SHARES} FROM psd GROUP BY 1, 2), m AS (SELECT label, {_MEANS} FROM s GROUP BY 1) SELECT label, {', '.join(f'round({n} / ({chr(43).join(PROFILE_BANDS)}), 6) AS prof_{n}' for n in PROFILE_BANDS)} FROM m"


def q29_aperiodic_slope_ols(spark, d):
    fitted = spectral.aperiodic_line(spectra(spark, d), "p", STEP)
    return rounded(fitted.select("vec_id", "fit.slope", "fit.r2"), "slope", "r2")


Q29 = f"WITH {PSD_SQL} SELECT vec_id, round(regr_slope(log10(p + 1e-30), log10(f)), 6) AS slope, round(regr_r2(log10(p + 1e-30), log10(f)), 6) AS r2 FROM psd WHERE f >= 3 AND f < 35 GROUP BY 1"


def q30_aperiodic_robust(spark, d):
    fitted = spectra(spark, d).select("vec_id", spectral.robust_aperiodic(STEP)("p").alias("fit"))
    return rounded(fitted.select("vec_id", "fit.slope", "fit.r2"), "slope", "r2", digits=5)


def _robust_sql() -> str:
    """The rounds of the robust fit, unrolled; a row stops when its kept points repeat or would be fewer than five."""
    out = ["y0 AS (SELECT vec_id, k, f, log10(f) AS x, log10(p + 1e-30) AS y, true AS keep, true AS moving, 0.0::DOUBLE AS slope, 0.0::DOUBLE AS icept FROM psd WHERE f >= 3 AND f < 35)"]
    for i in range(5):
        out.append(f"a{i} AS (SELECT vec_id, regr_slope(y, x) FILTER (keep) AS s, regr_intercept(y, x) FILTER (keep) AS c FROM y{i} GROUP BY 1)")
        out.append(f"b{i} AS (SELECT y.* EXCLUDE (slope, icept), CASE WHEN moving THEN s ELSE slope END AS slope, CASE WHEN moving THEN c ELSE icept END AS icept FROM y{i} y JOIN a{i} USING (vec_id))")
        out.append(f"c{i} AS (SELECT *, y - slope * x - icept <= 1.5 * (stddev_pop(y - slope * x - icept) FILTER (keep) OVER (PARTITION BY vec_id) + 1e-30) AS nw FROM b{i})")
        out.append(f"d{i} AS (SELECT *, count(*) FILTER (nw) OVER (PARTITION BY vec_id) >= 5 AS enough, bool_and(nw = keep) OVER (PARTITION BY vec_id) AS same FROM c{i})")
        out.append(f"y{i + 1} AS (SELECT vec_id, k, f, x, y, CASE WHEN moving AND enough THEN nw ELSE keep END AS keep, moving AND enough AND NOT same AS moving, slope, icept FROM d{i})")
    return ", ".join(out)


ROBUST_SQL = _robust_sql()
Q30 = f"""WITH {PSD_SQL}, {ROBUST_SQL} SELECT vec_id, round(any_value(slope), 5) AS slope,
round(1 - sum(pow(y - slope * x - icept, 2)) FILTER (keep) / (var_pop(y) FILTER (keep) * count(*) FILTER (keep) + 1e-30), 5) AS r2 FROM y5 GROUP BY 1"""


def q31_peak_bin(spark, d):
    first = spectral.bins(3, 35, STEP)[0] * STEP
    fitted = spectra(spark, d).select("vec_id", spectral.robust_aperiodic(STEP)("p").alias("fit"))
    return fitted.select("vec_id", spectral.peak_hz(F.col("fit.flat"), first, STEP, 7, 13).alias("peak_hz"))


Q31 = f"""WITH {PSD_SQL}, {ROBUST_SQL}, r AS (SELECT vec_id, f, y - slope * x - icept AS h FROM y5 WHERE f >= 7 AND f < 13),
m AS (SELECT vec_id, f, h, row_number() OVER (PARTITION BY vec_id ORDER BY h DESC, f) AS n FROM r) SELECT vec_id, CASE WHEN h >= 0.05 THEN f END AS peak_hz FROM m WHERE n = 1"""


def q32_hjorth(spark, d):
    found = complexity.hjorth(F.col("x"))
    return rounded(epoch_table(spark, d).select("vec_id", *(c.alias(n) for n, c in found.items())), *found)


Q32 = f"""WITH {X_SQL}, d1 AS (SELECT *, v - lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS dv FROM x), d2 AS (SELECT *, dv - lag(dv) OVER (PARTITION BY vec_id ORDER BY i) AS ddv FROM d1),
s AS (SELECT vec_id, stddev_pop(v) AS s0, stddev_pop(dv) AS s1, stddev_pop(ddv) AS s2 FROM d2 GROUP BY 1)
SELECT vec_id, round(s1 / (s0 + 1e-30), 6) AS mobility, round((s2 / (s1 + 1e-30)) / (s1 / (s0 + 1e-30) + 1e-30), 6) AS complexity FROM s"""


def q33_perm_entropy(spark, d):
    return rounded(epoch_table(spark, d).select("vec_id", complexity.permutation_entropy(F.col("x")).alias("entropy")), "entropy")


Q33 = f"""WITH {X_SQL}, w AS (SELECT vec_id, v AS a, lead(v) OVER q AS b, lead(v, 2) OVER q AS c FROM x WINDOW q AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT vec_id, a <= b AS ab, b <= c AS bc, a <= c AS ac, count(*) AS n FROM w WHERE c IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT vec_id, round(-sum(n / 62.0 * ln(n / 62.0)) / ln(6), 6) AS entropy FROM g GROUP BY 1"""


def q34_higuchi(spark, d):
    return rounded(epoch_table(spark, d).select("vec_id", complexity.higuchi_fd("x").alias("fd")), "fd")


Q34 = f"""WITH {X_SQL}, k AS (SELECT unnest(range(1, 11)) AS k), d AS (SELECT vec_id, k, i % k AS m, abs(v - lag(v) OVER (PARTITION BY vec_id, k, i % k ORDER BY i)) AS s FROM x, k),
l AS (SELECT vec_id, k, m, sum(s) * 63 / (count(*) - 1) / k AS len FROM d GROUP BY 1, 2, 3 HAVING count(*) > 1), a AS (SELECT vec_id, k, ln(avg(len) + 1e-30) AS y, ln(1.0 / k) AS x FROM l GROUP BY 1, 2)
SELECT vec_id, round(regr_slope(y, x), 6) AS fd FROM a GROUP BY 1"""


def q35_c0(spark, d):
    return rounded(spectra(spark, d).select("vec_id", spectral.c0(F.col("p"), N).alias("c0")), "c0")


Q35 = f"""WITH {PSD_SQL}, t AS (SELECT vec_id, p, p * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS two FROM psd), m AS (SELECT *, sum(two) OVER (PARTITION BY vec_id) / 64 AS mean FROM t)
SELECT vec_id, round(coalesce(sum(two) FILTER (NOT p > mean), 0) / (sum(two) + 1e-30), 6) AS c0 FROM m GROUP BY 1"""


def q36_faa_log_ratio(spark, d):
    """Log ratio of alpha power of the later and the earlier third of the vectors of a label, as of two channels."""
    alpha = spectra(spark, d).select("label", (F.col("vec_id") % 3).alias("ch"), F.aggregate(spectral.band(F.col("p"), 8, 13, STEP), F.lit(0.0), lambda a, x: a + x).alias("a"))
    by = alpha.groupBy("label").agg(F.avg(F.when(F.col("ch") == 2, F.col("a"))).alias("c2"), F.avg(F.when(F.col("ch") == 0, F.col("a"))).alias("c0"))
    return rounded(by.select("label", (F.ln("c2") - F.ln("c0")).alias("faa")), "faa")


Q36 = f"""WITH {PSD_SQL}, a AS (SELECT vec_id, label, sum(p) AS a FROM psd WHERE f >= 8 AND f < 13 GROUP BY 1, 2)
SELECT label, round(ln(avg(a) FILTER (vec_id % 3 = 2)) - ln(avg(a) FILTER (vec_id % 3 = 0)), 6) AS faa FROM a GROUP BY 1"""

MASK = Epoching(p2p=(0.8, 1.3), jump=1.3, low_share=2.0)


def masked(spark, d):
    """Subjects are labels, epochs groups of three vectors, one for each channel."""
    parts = spectra(spark, d).select("label", F.floor(F.col("vec_id") / 3).alias("epoch"), (F.col("vec_id") % 3).alias("channel"), "x", spectral.band_share(F.col("p"), 0.5, 5, STEP).alias("lf"))
    return epochs.rejection(parts, ["label"], "epoch", "x", "lf", MASK)


def q37_epoch_mask(spark, d):
    return rounded(epochs.rejection_summary(masked(spark, d), ["label"]), "frac_rejected")


Q37 = f"""WITH {PSD_SQL}, lf AS (SELECT vec_id, {share_sql(0.5, 5)} AS lf FROM psd GROUP BY 1),
dd AS (SELECT vec_id, label, v, abs(v - lag(v) OVER (PARTITION BY vec_id ORDER BY i)) AS j FROM x), s AS (SELECT vec_id, label, max(v) - min(v) AS p2p, max(j) AS jump, bool_and(isfinite(v)) AS fin FROM dd GROUP BY 1, 2),
c AS (SELECT label, vec_id // 3 AS epoch, vec_id % 3 AS channel, p2p, jump, fin, lf FROM s JOIN lf USING (vec_id)),
m AS (SELECT label, channel, median(p2p) AS mp, median(jump) AS mj, median(lf) AS ml FROM c GROUP BY 1, 2),
r AS (SELECT c.label, epoch, bool_or(NOT fin) AS nonfinite, bool_or(NOT p2p > 0) AS flat, bool_or(p2p / (mp + 1e-30) > 1.3) AS hi, bool_or(p2p / (mp + 1e-30) < 0.8) AS lo, bool_or(jump / (mj + 1e-30) > 1.3) AS jump, bool_or(lf / (ml + 1e-30) > 2.0) AS ocular
 FROM c JOIN m ON c.label = m.label AND c.channel = m.channel GROUP BY 1, 2),
g AS (SELECT *, NOT (nonfinite OR flat OR hi OR lo OR jump OR ocular) AS good FROM r)
SELECT label, count(*) AS n_epochs, count(*) FILTER (good) AS n_good, round(avg(CAST(NOT good AS INT)), 6) AS frac_rejected, count(*) FILTER (nonfinite) AS n_rej_nonfinite, count(*) FILTER (flat) AS n_rej_flat,
count(*) FILTER (hi) AS n_rej_p2p_high, count(*) FILTER (lo) AS n_rej_p2p_low, count(*) FILTER (jump) AS n_rej_jump, count(*) FILTER (ocular) AS n_rej_ocular_lf FROM g GROUP BY 1"""


def q38_epoch_agg(spark, d):
    p = F.col("p")
    parts = spectra(spark, d).select("label", F.floor(F.col("vec_id") / 3).alias("epoch"), spectral.band_share(p, 8, 13, STEP).alias("rel_alpha"), spectral.band_share(p, 13, 30, STEP).alias("rel_beta"))
    out = epochs.aggregate_epochs(parts, ["label"], "epoch", ["rel_alpha", "rel_beta"])
    return rounded(out, "p__rel_alpha", "p__rel_beta", "e__iqr_rel_alpha", "e__iqr_rel_beta")


Q38 = f"""WITH {PSD_SQL}, s AS (SELECT vec_id, label, {share_sql(8, 13)} AS a, {share_sql(13, 30)} AS b FROM psd GROUP BY 1, 2), e AS (SELECT label, vec_id // 3 AS epoch, median(a) AS a, median(b) AS b FROM s GROUP BY 1, 2)
SELECT label, round(median(a), 6) AS p__rel_alpha, round(median(b), 6) AS p__rel_beta, round(quantile_cont(a, 0.75) - quantile_cont(a, 0.25), 6) AS e__iqr_rel_alpha, round(quantile_cont(b, 0.75) - quantile_cont(b, 0.25), 6) AS e__iqr_rel_beta, count(*) AS n_epochs FROM e GROUP BY 1"""


MAINS = Acquisition(fs=FS)
_NEAR = " OR ".join(f"abs(f - {hz}) <= {MAINS.mains_tolerance_hz}" for hz in MAINS.mains_hz)


def q64_fs_check(spark, d):
    found = spectra(spark, d).select("vec_id", spectral.line_check(F.col("p"), STEP, MAINS).alias("c"))
    return rounded(found.select("vec_id", "c.peak_hz", "c.prominence", "c.status", F.get("c.implied_fs", F.lit(1)).alias("implied_60")), "prominence", "implied_60")


Q64 = f"""WITH {PSD_SQL}, h AS (SELECT vec_id, f, log10(p + 1e-30) AS y FROM psd WHERE f >= 35 AND f <= 63), r AS (SELECT vec_id, f, y, median(y) OVER (PARTITION BY vec_id) AS m, row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, f) AS n FROM h)
SELECT vec_id, f AS peak_hz, round(y - m, 6) AS prominence, CASE WHEN y - m < {MAINS.mains_prominence} THEN 'no_line_peak_detected_inconclusive' WHEN {_NEAR} THEN 'line_peak_at_expected_frequency' ELSE 'line_peak_at_unexpected_frequency' END AS status,
CASE WHEN y - m >= {MAINS.mains_prominence} THEN round({FS * MAINS.mains_hz[1]} / f, 6) END AS implied_60 FROM r WHERE n = 1"""

QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}
SQL = {n: globals()[f"Q{n[1:3]}"] for n in QUERIES}
