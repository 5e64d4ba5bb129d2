"""Queries on quality control and group statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import quality, relational, stats, timegrid
from tidegrid.operators.quality import Rule
from tidegrid.plans.bindings import activity, labelled, table
from tidegrid.plans.q_time import BLOCK_SQL, WINDOWS_SQL, in_windows, rank_sql, rounded

LOW, HIGH = 1.0, 100.0
METRICS = ("saturation_fraction", "zero_diff_fraction", "log_rms", "nonstationarity_cv")
RULES = (Rule("saturation_fraction", 0.15), Rule("nonstationarity_cv", 2.0), Rule("n_samples", 50, above=False), Rule("log_rms", 1.8))
OUTLIERS = ("log_rms", "nonstationarity_cv")
Z = 2.0


def metrics(spark, d):
    samples = activity(spark, d)
    own = quality.record_metrics(samples, "user_id", ["ts", "event_id"], "value", LOW, HIGH)
    steady = timegrid.nonstationarity(samples, "user_id", "block", "event_type", "value").select("user_id", F.col("cv").alias("nonstationarity_cv"))
    return own.join(steady, "user_id")


METRICS_SQL = f"""st AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
own AS (SELECT user_id, count(*) AS n_samples, CAST(count(*) AS DOUBLE) AS duration_s, bool_and(isfinite(value)) AS finite, CAST(max(value) - min(value) = 0 AS INT) AS flat_channels, avg(CAST(value <= 1 OR value >= 100 AS INT)) AS saturation_fraction,
 avg(CASE WHEN step IS NOT NULL THEN CAST(step = 0 AS INT) END) AS zero_diff_fraction, sqrt(avg(value * value)) AS rms, log10(sqrt(avg(value * value)) + 1e-30) AS log_rms FROM st GROUP BY 1),
nv AS (SELECT user_id, {BLOCK_SQL} AS block, event_type, var_pop(value) AS v FROM events GROUP BY 1, 2, 3), nb AS (SELECT user_id, block, avg(v) AS v FROM nv GROUP BY 1, 2),
cv AS (SELECT user_id, CASE WHEN count(*) >= 3 AND avg(v) > 0 THEN stddev_pop(v) / avg(v) END AS nonstationarity_cv FROM nb GROUP BY 1), met AS (SELECT * FROM own JOIN cv USING (user_id))"""


def q39_qc_metrics(spark, d):
    return rounded(metrics(spark, d), *METRICS, "rms")


Q39 = f"""WITH {METRICS_SQL} SELECT user_id, n_samples, duration_s, finite, flat_channels, round(rms, 6) AS rms, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM met"""


def scored(spark, d):
    return quality.with_mad_z(metrics(spark, d), OUTLIERS)


_Z = [f"(m.{m} - md.{m}) / nullif(CASE WHEN dv.{m} > 0 THEN 1.4826 * dv.{m} ELSE sd.{m} END, 0) AS z__{m}" for m in OUTLIERS]
Z_SQL = f"""{METRICS_SQL}, md AS (SELECT {', '.join(f'median({m}) AS {m}' for m in OUTLIERS)} FROM met), dv AS (SELECT {', '.join(f'median(abs(met.{m} - md.{m})) AS {m}' for m in OUTLIERS)} FROM met, md),
sd AS (SELECT {', '.join(f'stddev_pop({m}) AS {m}' for m in OUTLIERS)} FROM met), zed AS (SELECT m.*, {', '.join(_Z)} FROM met m, md, dv, sd)"""


def q40_mad_z(spark, d):
    return rounded(scored(spark, d).select("user_id", *(f"z__{m}" for m in OUTLIERS)), *(f"z__{m}" for m in OUTLIERS))


Q40 = f"WITH {Z_SQL} SELECT user_id, {', '.join(f'round(z__{m}, 6) AS z__{m}' for m in OUTLIERS)} FROM zed"


def decided(spark, d):
    return quality.decide(scored(spark, d), RULES, OUTLIERS, Z)


def q41_qc_decision_reasons(spark, d):
    return decided(spark, d).select("user_id", "qc_reasons", "qc_pass")


_FAILS = [f"CASE WHEN {r.metric} {'>' if r.above else '<'} {r.threshold} THEN '{r.reason()}' END" for r in RULES] + ["CASE WHEN flat_channels > 0 THEN 'flat channel' END"] + [f"CASE WHEN abs(z__{m}) > {Z} THEN 'outlier {m}' END" for m in OUTLIERS]
DECIDED_SQL = f"{Z_SQL}, dec AS (SELECT *, coalesce(array_to_string(list_filter([{', '.join(_FAILS)}], lambda x: x IS NOT NULL), '; '), '') AS qc_reasons FROM zed)"
Q41 = f"WITH {DECIDED_SQL} SELECT user_id, qc_reasons, qc_reasons = '' AS qc_pass FROM dec"


def q42_qc_distribution(spark, d):
    numbers = ("min", "p05", "q25", "median", "q75", "p95", "max", "frac_excluded")
    return rounded(quality.distribution(scored(spark, d), RULES, OUTLIERS, Z), *numbers)


_LONG = " UNION ALL ".join([f"SELECT '{r.metric}' AS metric, {float(r.threshold)}::DOUBLE AS threshold, '{'greater' if r.above else 'less'}' AS direction, CAST({r.metric} AS DOUBLE) AS v FROM zed" for r in RULES] + [f"SELECT 'z__{m}', {Z}::DOUBLE, 'abs_greater', z__{m} FROM zed" for m in OUTLIERS])
_BEYOND = "CASE direction WHEN 'less' THEN v < threshold WHEN 'greater' THEN v > threshold ELSE abs(v) > threshold END"
Q42 = f"""WITH {Z_SQL}, lng AS ({_LONG}) SELECT metric, threshold, direction, count(v) AS n_valid, round(min(v), 6) AS min, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median,
round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS max, count(*) FILTER ({_BEYOND}) AS n_excluded, round(count(*) FILTER ({_BEYOND}) / count(v), 6) AS frac_excluded FROM lng GROUP BY 1, 2, 3"""


def q43_redundancy_audit(spark, d):
    drift = decided(spark, d).withColumn("drift_ok", F.col("user_id") % 4 != 0)
    return quality.redundancy_audit(drift, "qc_reasons", "qc_pass", "drift_ok", "nonstationarity")


Q43 = f"""WITH {DECIDED_SQL}, f AS (SELECT list_filter(list_transform(string_split(qc_reasons, ';'), lambda x: trim(x)), lambda x: x <> '') AS r FROM dec WHERE qc_reasons <> '' AND user_id % 4 <> 0),
k AS (SELECT len(list_filter(r, lambda x: contains(x, 'nonstationarity'))) AS h, len(r) AS n FROM f)
SELECT CASE WHEN h > 0 AND h = n THEN 'only' WHEN h > 0 THEN 'plus_others' ELSE 'others' END AS kind, count(*) AS n FROM k GROUP BY 1"""


def q44_failure_by_stage(spark, d):
    failures = activity(spark, d).filter("event_type = 'error'").withColumn("stage", F.concat(F.lit("stage_"), (F.col("event_id") % 3).cast("string")))
    return relational.failures_by_stage(failures, "stage", "user_id")


Q44 = "SELECT 'stage_' || (event_id % 3) AS stage, count(*) AS n_failures, count(DISTINCT user_id) AS n_subjects FROM events WHERE event_type = 'error' GROUP BY 1"


def q45_consort(spark, d):
    """Flow of documents: read, long enough, labelled, analysed, by label; a single row."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    joined = relational.attach_metadata(docs, table(spark, d, "labels"), "doc_id", "quality")
    enough = F.col("n_chars") >= 200
    return joined.agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(~enough).alias("n_short"),
        F.count_if(enough & F.col("unmatched")).alias("n_unmatched"),
        F.count_if(enough & ~F.col("unmatched")).alias("n_analytic"),
        F.count_if(enough & (F.col("quality") == 1)).alias("n_label_1"),
        F.count_if(enough & (F.col("quality") == 0)).alias("n_label_0"),
    )


Q45 = """SELECT count(*) AS n_read, count(*) FILTER (n_chars < 200) AS n_short, count(*) FILTER (n_chars >= 200 AND quality IS NULL) AS n_unmatched, count(*) FILTER (n_chars >= 200 AND quality IS NOT NULL) AS n_analytic,
count(*) FILTER (n_chars >= 200 AND quality = 1) AS n_label_1, count(*) FILTER (n_chars >= 200 AND quality = 0) AS n_label_0 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def q46_crosstab(spark, d):
    return relational.crosstab(labelled(spark, d), "source", "quality", [0, 1]).withColumnsRenamed({"0": "quality_0", "1": "quality_1"})


Q46 = "SELECT source, count(*) FILTER (quality = 0) AS quality_0, count(*) FILTER (quality = 1) AS quality_1 FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1"
LAB_SQL = "lab AS (SELECT l.doc_id, quality, toxic, lang, source, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def v_sql(a: str, b: str) -> str:
    return f"""cells AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM lab GROUP BY 1, 2), mar AS (SELECT *, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c FROM cells),
fct AS (SELECT sum(o) AS n, sum(o * o / (r * c)) AS s, count(DISTINCT a) AS n_a, count(DISTINCT b) AS n_b FROM mar), vv AS (SELECT CAST(n AS BIGINT) AS n, n_a, n_b, CASE WHEN least(n_a, n_b) >= 2 THEN sqrt(greatest(s - 1, 0) / (least(n_a, n_b) - 1)) END AS v FROM fct)"""


def q47_cramers_v(spark, d):
    return rounded(stats.cramers_v(labelled(spark, d), "lang", "quality"), "v")


Q47 = f"WITH {LAB_SQL}, {v_sql('lang', 'quality')} SELECT n, n_a, n_b, round(v, 6) AS v FROM vv"


def q48_batch_confound(spark, d):
    return rounded(stats.batch_confound(labelled(spark, d), "source", "toxic"), "v")


Q48 = f"WITH {LAB_SQL}, {v_sql('source', 'toxic')} SELECT n, n_a, n_b, round(v, 6) AS v, (SELECT max(k) <= 1 FROM (SELECT count(DISTINCT toxic) AS k FROM lab GROUP BY source)) AS perfectly_predicts, (SELECT max(k) <= 1 FROM (SELECT count(DISTINCT toxic) AS k FROM lab GROUP BY source)) OR coalesce(v >= 0.6, false) AS flagged FROM vv"

FEATURES = ("p__n_chars", "p__mod97", "p__mod7")


def feature_table(spark, d):
    f = labelled(spark, d)
    return f.withColumns({"p__n_chars": F.col("n_chars").cast("double"), "p__mod97": (F.col("doc_id") * 31 % 97).cast("double"), "p__mod7": (F.col("n_chars") % 7).cast("double")})


def long_table(spark, d):
    return stats.long_features(feature_table(spark, d), ["doc_id", "toxic", "lang"], FEATURES)


LONG_SQL = f"{LAB_SQL}, lng AS (SELECT doc_id, toxic, lang, 'p__n_chars' AS feature, n_chars::DOUBLE AS value FROM lab UNION ALL SELECT doc_id, toxic, lang, 'p__mod97', (doc_id * 31 % 97)::DOUBLE FROM lab UNION ALL SELECT doc_id, toxic, lang, 'p__mod7', (n_chars % 7)::DOUBLE FROM lab)"
# The same fit of erfc as in tidegrid.functions.expr.
_FIT = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def two_sided_sql(z: str) -> str:
    poly = "0.0::DOUBLE"
    for c in _FIT:
        poly = f"({poly} * t + ({c}))"
    return f"least((SELECT t * exp(-x * x + {poly}) FROM (SELECT x, 1.0 / (1.0 + x / 2) AS t FROM (SELECT abs({z}) / sqrt(2.0) AS x))), 1.0)"


MW_SQL = f"""rk AS (SELECT feature, toxic, {rank_sql('value', 'feature')} AS r, count(*) OVER (PARTITION BY feature, value)::DOUBLE AS t FROM lng),
sm AS (SELECT feature, count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0, sum(r) FILTER (toxic = 1) AS ranks, sum(t * t - 1) AS ties FROM rk GROUP BY 1),
uu AS (SELECT *, ranks - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM sm),
mw AS (SELECT feature, n1, n0, u, u / (n1 * n0) AS auc, greatest((greatest(u, n1 * n0 - u) - n1 * n0 / 2.0 - 0.5) / sd, 0) AS z, ties = 0 AND least(n1, n0) BETWEEN 1 AND {stats.FEW} AS few FROM uu),
sizes AS (SELECT DISTINCT n1, n0, least(n1, n0) AS k, n1 + n0 AS n FROM mw WHERE few),
dp AS (SELECT n1, n0, k, n, 0 AS i, 0 AS chosen, 0 AS s, 1.0::DOUBLE AS w FROM sizes
 UNION ALL SELECT n1, n0, k, n, i + 1, c, t, sum(w) FROM (SELECT n1, n0, k, n, i, chosen + x AS c, s + x * (i + 1) AS t, w FROM dp, (VALUES (0), (1)) AS x(x) WHERE i < n AND chosen + x <= k) q GROUP BY n1, n0, k, n, i, c, t),
law AS (SELECT n1, n0, s - k * (k + 1) // 2 AS lu, w, sum(w) OVER (PARTITION BY n1, n0) AS whole FROM dp WHERE i = n AND chosen = k),
ex AS (SELECT feature, least(2 * sum(w) / any_value(whole), 1) AS p FROM mw JOIN law ON law.n1 = mw.n1 AND law.n0 = mw.n0 AND few AND law.lu <= least(mw.u, mw.n1 * mw.n0 - mw.u) GROUP BY 1),
mp AS (SELECT mw.feature, n1, n0, u, auc, CASE WHEN few THEN ex.p ELSE {two_sided_sql('mw.z')} END AS p FROM mw LEFT JOIN ex ON ex.feature = mw.feature)"""


def q49_mann_whitney_u(spark, d):
    return rounded(stats.mann_whitney(long_table(spark, d), ["feature"], "value", "toxic"), "u", "auc", "p")


Q49 = f"WITH RECURSIVE {LONG_SQL}, {MW_SQL} SELECT feature, n1, n0, round(u, 6) AS u, round(auc, 6) AS auc, round(p, 6) AS p FROM mp"


def g_sql(value: str = "value", label: str = "toxic") -> str:
    n1, n0 = f"count({value}) FILTER ({label} = 1)", f"count({value}) FILTER ({label} = 0)"
    sp = f"sqrt((({n1} - 1) * var_samp({value}) FILTER ({label} = 1) + ({n0} - 1) * var_samp({value}) FILTER ({label} = 0)) / ({n1} + {n0} - 2))"
    return f"CASE WHEN {n1} >= 2 AND {n0} >= 2 AND {sp} > 0 THEN (avg({value}) FILTER ({label} = 1) - avg({value}) FILTER ({label} = 0)) / {sp} * (1 - 3.0 / (4 * ({n1} + {n0}) - 9)) END"


def q50_hedges_g(spark, d):
    return rounded(long_table(spark, d).groupBy("feature", "lang").agg(stats.hedges_g("value", "toxic").alias("g")), "g")


Q50 = f"WITH {LONG_SQL} SELECT feature, lang, round({g_sql()}, 6) AS g FROM lng GROUP BY 1, 2"


def q51_bh_fdr(spark, d):
    tests = stats.mann_whitney(long_table(spark, d).withColumn("feature", F.concat_ws("|", "feature", "lang")), ["feature"], "value", "toxic").select("feature", "p")
    return rounded(stats.bh_fdr(tests, "p"), "p", "p_fdr", digits=5)


Q51 = f"""WITH RECURSIVE {LONG_SQL.replace('lng AS', 'lng0 AS')}, lng AS (SELECT doc_id, toxic, feature || '|' || lang AS feature, value FROM lng0), {MW_SQL}, o AS (SELECT feature, p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM mp)
SELECT feature, round(p, 5) AS p, round(least(greatest(min(p * n / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 1), 5) AS p_fdr FROM o"""


def q52_group_tests(spark, d):
    out = stats.group_tests(long_table(spark, d), "value", "toxic").drop("auc")
    return rounded(out, "median_1", "median_0", "g", "u", "p", "p_fdr", digits=5)


Q52 = f"""WITH RECURSIVE {LONG_SQL}, {MW_SQL}, eff AS (SELECT feature, median(value) FILTER (toxic = 1) AS median_1, median(value) FILTER (toxic = 0) AS median_0, {g_sql()} AS g FROM lng GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM mp JOIN eff USING (feature)), q AS (SELECT *, least(greatest(min(p * n / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 1) AS p_fdr FROM o)
SELECT feature, n1, n0, round(median_1, 5) AS median_1, round(median_0, 5) AS median_0, round(g, 5) AS g, round(u, 5) AS u, round(p, 5) AS p, round(p_fdr, 5) AS p_fdr, p_fdr < 0.05 AS significant FROM q"""


def scores(spark, d):
    """A score in [0, 1] for each labelled document from its length."""
    return labelled(spark, d).select("doc_id", "lang", "toxic", F.round((F.col("n_chars") % 1000) / 1000.0, 3).alias("score"))


SCORE_SQL = f"{LAB_SQL}, sc AS (SELECT doc_id, lang, toxic, round((n_chars % 1000) / 1000.0, 3)::DOUBLE AS score FROM lab)"


def q53_auc_metrics(spark, d):
    s = scores(spark, d)
    auc = stats.mann_whitney(s.withColumn("one", F.lit(1)), ["one"], "score", "toxic").select(F.col("auc").alias("roc_auc"))
    both = stats.threshold_metrics(s, "toxic", "score", 0.5).join(F.broadcast(auc))
    return rounded(both, "brier", "sensitivity", "specificity", "balanced_accuracy", "f1", "mcc", "roc_auc")


Q53 = f"""WITH {SCORE_SQL}, rk AS (SELECT toxic, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM sc), a AS (SELECT (sum(r) FILTER (toxic = 1) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2.0) / (count(*) FILTER (toxic = 1) * count(*) FILTER (toxic = 0)) AS roc_auc FROM rk),
c AS (SELECT count(*) FILTER (toxic = 1 AND score >= 0.5) AS tp, count(*) FILTER (toxic = 0 AND score >= 0.5) AS fp, count(*) FILTER (toxic = 1 AND score < 0.5) AS fn, count(*) FILTER (toxic = 0 AND score < 0.5) AS tn, avg(pow(score - toxic, 2)) AS brier FROM sc)
SELECT tp, fp, fn, tn, round(brier, 6) AS brier, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(roc_auc, 6) AS roc_auc FROM c, a"""


def q54_average_precision(spark, d):
    return rounded(stats.average_precision(scores(spark, d), ["lang"], "toxic", "score"), "average_precision")


Q54 = f"""WITH {SCORE_SQL}, pt AS (SELECT lang, score, sum(toxic) AS pos, count(*) AS n FROM sc GROUP BY 1, 2), cu AS (SELECT lang, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al, sum(pos) OVER (PARTITION BY lang) AS p FROM pt WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, round(sum(pos / nullif(p, 0) * tp / al), 6) AS average_precision FROM cu GROUP BY 1"""
N_PERM = 40


def q55_permutation_auc_hash(spark, d):
    aucs = stats.permutation_auc(scores(spark, d), "doc_id", "toxic", "score", N_PERM)
    observed = aucs.filter("perm = 0").select(F.col("auc").alias("observed"))
    null = aucs.filter("perm > 0").join(F.broadcast(observed))
    out = null.agg(F.count(F.lit(1)).alias("n_permutations"), F.max("observed").alias("observed_auc"), F.avg("auc").alias("null_mean"), F.stddev_samp("auc").alias("null_sd"), F.percentile("auc", F.lit(0.95)).alias("null_p95"), ((F.count_if(F.col("auc") >= F.col("observed") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    return rounded(out, "observed_auc", "null_mean", "null_sd", "null_p95", "p_value")


Q55 = f"""WITH {SCORE_SQL}, b AS (SELECT doc_id, toxic, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, count(*) OVER () AS n, sum(toxic) OVER () AS n1 FROM sc), pm AS (SELECT unnest(range({N_PERM + 1})) AS perm),
m AS (SELECT *, row_number() OVER (PARTITION BY perm ORDER BY md5(doc_id || ':' || perm), doc_id) AS place FROM b, pm), a AS (SELECT perm, (sum(r) FILTER (CASE WHEN perm = 0 THEN toxic = 1 ELSE place <= n1 END) - any_value(n1) * (any_value(n1) + 1) / 2.0) / (any_value(n1) * (any_value(n) - any_value(n1)))::DOUBLE AS auc FROM m GROUP BY 1),
o AS (SELECT auc AS observed FROM a WHERE perm = 0) SELECT count(*) AS n_permutations, round(max(observed), 6) AS observed_auc, round(avg(auc), 6) AS null_mean, round(stddev_samp(auc), 6) AS null_sd, round(quantile_cont(auc, 0.95), 6) AS null_p95, round((count(*) FILTER (auc >= observed - 1e-12) + 1) / (count(*) + 1), 6) AS p_value FROM a, o WHERE perm > 0"""
N_BOOT = 40


def q56_bootstrap_hash(spark, d):
    means = stats.bootstrap_means(long_table(spark, d).filter("feature = 'p__mod97'"), "doc_id", ["toxic"], "value", N_BOOT)
    out = means.groupBy("toxic").agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"), F.count("mean").alias("n_boot"))
    return rounded(out, "ci_low", "ci_high")


_W = " + ".join(f"CAST(u >= {c} AS INT)" for c in stats.POISSON)
Q56 = f"""WITH {LAB_SQL}, m AS (SELECT toxic, (doc_id * 31 % 97)::DOUBLE AS value, b, CAST('0x' || substr(md5(doc_id || ':' || b), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM lab, (SELECT unnest(range(1, {N_BOOT + 1})) AS b)),
w AS (SELECT toxic, b, value, {_W} AS w FROM m), a AS (SELECT toxic, b, sum(w * value) / nullif(sum(w), 0) AS mean FROM w GROUP BY 1, 2)
SELECT toxic, round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high, count(mean) AS n_boot FROM a GROUP BY 1"""


def q57_sign_agreement(spark, d):
    even = F.when(F.col("user_id") % 2 == 0, F.col("value"))
    odd = F.when(F.col("user_id") % 2 == 1, F.col("value"))
    effects = in_windows(spark, d).groupBy("event_type", "window_key").agg((F.avg(even) - F.avg(odd)).alias("effect"))
    wide = effects.groupBy("event_type").pivot("window_key", ["w1", "w3"]).agg(F.first("effect"))
    return rounded(stats.sign_agreement(wide, "w1", "w3", "event_type", N_BOOT), "spearman_effects", "sign_agreement", "p_binomial", "ci_low", "ci_high")


Q57 = f"""WITH {WINDOWS_SQL}, e AS (SELECT event_type, avg(value) FILTER (user_id % 2 = 0 AND window_key = 'w1') - avg(value) FILTER (user_id % 2 = 1 AND window_key = 'w1') AS a, avg(value) FILTER (user_id % 2 = 0 AND window_key = 'w3') - avg(value) FILTER (user_id % 2 = 1 AND window_key = 'w3') AS b FROM cut GROUP BY 1),
r AS (SELECT a, b, rank() OVER (ORDER BY a) AS x, rank() OVER (ORDER BY b) AS y FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
bu AS (SELECT b AS sample, CAST(sign(e.a) = sign(e.b) AS DOUBLE) AS agrees, CAST('0x' || substr(md5(event_type || ':' || s.i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u, s.i FROM e, (SELECT unnest(range(1, {N_BOOT + 1})) AS i) s WHERE e.a IS NOT NULL AND e.b IS NOT NULL),
bm AS (SELECT i, sum(({_W}) * agrees) / nullif(sum({_W}), 0) AS mean FROM bu GROUP BY 1), ci AS (SELECT quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM bm), s AS (SELECT count(*) AS n_features, count(*) FILTER (sign(a) = sign(b)) AS n_agreeing, corr(x, y) AS spearman_effects FROM r)
SELECT n_features, n_agreeing, round(spearman_effects, 6) AS spearman_effects, round(n_agreeing / n_features, 6) AS sign_agreement, round((SELECT sum(exp(lgamma(n_features + 1) - lgamma(i + 1) - lgamma(n_features - i + 1) - n_features * ln(2.0))) FROM (SELECT unnest(range(n_agreeing, n_features + 1)) AS i)), 6) AS p_binomial, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM s, ci"""


def q58_binom_greater(spark, d):
    by = labelled(spark, d).groupBy("source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(by.withColumn("p", stats.binomial_greater(F.col("k"), F.col("n"))), "p")


Q58 = f"""WITH {LAB_SQL}, c AS (SELECT source, count(*) FILTER (doc_id % 2 = 0) AS k, count(*) AS n FROM lab GROUP BY 1), t AS (SELECT source, k, n, unnest(range(k, n + 1)) AS i FROM c)
SELECT source, k, n, round(least(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))), 1), 6) AS p FROM t GROUP BY 1, 2, 3"""


def q59_fisher_2x2(spark, d):
    cell = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    by = labelled(spark, d).groupBy("lang").agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    return rounded(by.withColumn("p", stats.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d"))), "p")


Q59 = f"""WITH {LAB_SQL}, k AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM lab GROUP BY 1),
x AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS i FROM k),
l AS (SELECT *, -lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS lp, -lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS own FROM x)
SELECT lang, a, b, c, d, round(least(sum(exp(lp - own)) FILTER (lp <= own + 1e-7) / sum(exp(lp - own)), 1), 6) AS p FROM l GROUP BY 1, 2, 3, 4, 5"""

QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}
SQL = {n: globals()[f"Q{n[1:3]}"] for n in QUERIES}
