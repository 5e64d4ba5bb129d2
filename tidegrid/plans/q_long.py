"""Queries on operators for tables whose groups don't fit into a task, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.operators import comoments, intervals, long_series, panes, resampling, selection, stats
from tidegrid.plans.bindings import activity, labelled, table
from tidegrid.plans.q_stats import LAB_SQL
from tidegrid.plans.q_time import rounded

PROBS = {"p05": 0.05, "q25": 0.25, "median": 0.5, "q80": 0.8, "p95": 0.95}


def prices(spark, d):
    """Prices in steps of ten, so that many are equal; every fifth line has none."""
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") % 5 > 0, F.floor(F.col("l_extendedprice") / 10) * 10.0 - 20_000).alias("price"))


PRICE_SQL = "p AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber % 5 > 0 THEN floor(l_extendedprice / 10) * 10.0 - 20000 END::DOUBLE AS price FROM lineitem)"


def q72_selected_quantiles(spark, d):
    return rounded(selection.quantiles(prices(spark, d), ["l_returnflag"], "price", PROBS), *PROBS)


Q72 = f"WITH {PRICE_SQL} SELECT l_returnflag, count(price) AS n, {', '.join(f'round(quantile_cont(price, {q}), 6) AS {n}' for n, q in PROBS.items())} FROM p GROUP BY 1"


def q73_selected_mad(spark, d):
    """Median and median distance from it of all prices, and of those of each line status."""
    by = selection.median_deviation(prices(spark, d), ["l_linestatus"], "price")
    whole = selection.median_deviation(prices(spark, d), [], "price").select(F.lit("all").alias("l_linestatus"), "n", "median", "mad")
    return rounded(by.unionByName(whole), "median", "mad")


Q73 = f"""WITH {PRICE_SQL}, g AS (SELECT l_linestatus AS s, price FROM p UNION ALL SELECT 'all', price FROM p), m AS (SELECT s, count(price) AS n, median(price) AS median FROM g GROUP BY 1)
SELECT g.s AS l_linestatus, any_value(m.n) AS n, round(any_value(m.median), 6) AS median, round(median(abs(price - m.median)), 6) AS mad FROM g JOIN m ON g.s = m.s GROUP BY 1"""

HOURS = 30


def user_days(spark, d):
    """A window for each user and day: from the day's first event on, HOURS long, so that it may reach into the next day's."""
    second = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    samples = activity(spark, d).select("user_id", "event_id", "value", "block", second.alias("t"))
    return samples, samples.groupBy("user_id", "block").agg(F.min("t").alias("start")).withColumn("end", F.col("start") + HOURS * 3600.0)


def q74_own_windows(spark, d):
    samples, windows = user_days(spark, d)
    joined = intervals.interval_join(samples.drop("block"), windows, "t", "start", "end", ["user_id"])
    return rounded(joined.groupBy("user_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("event_id").alias("last_id")), "total", digits=4)


Q74 = f"""WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS t, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000) AS BIGINT) AS block FROM events),
w AS (SELECT user_id, block, min(t) AS s, min(t) + {HOURS * 3600} AS x FROM e GROUP BY 1, 2)
SELECT w.user_id, w.block, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last_id FROM w JOIN e ON e.user_id = w.user_id AND t >= s AND t < x GROUP BY 1, 2"""

LENGTH, STEP = 40, 4


def q75_overlapping_epochs(spark, d):
    """Each supplier's lines in order, in epochs of 40 lines that share 90 % with the next."""
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity")) - 1
    lines = table(spark, d, "lineitem").select("l_suppkey", place.alias("i"), F.col("l_quantity").cast("double").alias("v"))
    return rounded(panes.epochs(lines, ["l_suppkey"], "i", "v", LENGTH, STEP), "mean", "rms", "variance", "ptp")


Q75 = f"""WITH l AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS i, l_quantity::DOUBLE AS v, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
e AS (SELECT l_suppkey, unnest(range((max(n) - {LENGTH}) // {STEP} + 1)) AS epoch FROM l GROUP BY 1 HAVING max(n) >= {LENGTH})
SELECT l.l_suppkey, epoch, count(*) AS n, round(avg(v), 6) AS mean, round(sqrt(avg(v * v)), 6) AS rms, round(var_pop(v), 6) AS variance, round(max(v) - min(v), 6) AS ptp FROM l JOIN e ON l.l_suppkey = e.l_suppkey AND i >= epoch * {STEP} AND i < epoch * {STEP} + {LENGTH} GROUP BY 1, 2"""

SAMPLES = 2000
CHOSEN = ("mean", "g", "correlation", "cv")


def q76_bootstrap_one_pass(spark, d):
    """Intervals of a mean, Hedges g, a correlation and a statistic of our own, the coefficient of variation, from the same pass."""
    rows = labelled(spark, d).select("doc_id", "lang", "toxic", ((F.col("n_chars") % 1000) / 1000.0).alias("x"), (F.col("doc_id") * 31 % 97).cast("double").alias("y"))
    moments, statistics = {}, {}
    for m, s in (resampling.correlation_of("x", "y"), resampling.hedges_of("x", "toxic")):
        moments |= m
        statistics |= s
    statistics["mean"] = resampling.ratio(F.col("x"), F.col("w"))
    statistics["cv"] = resampling.ratio(F.sqrt(F.greatest(resampling.ratio(F.col("xx"), F.col("w")) - F.pow(resampling.ratio(F.col("x"), F.col("w")), 2), F.lit(0.0))), resampling.ratio(F.col("x"), F.col("w")))
    found = resampling.bootstrap(rows, "doc_id", ["lang"], moments, statistics, SAMPLES)
    return rounded(resampling.intervals(found, ["lang"], CHOSEN), *(f"{s}_{end}" for s in CHOSEN for end in ("low", "high")))


_W = " + ".join(f"CAST(u >= {c} AS INT)" for c in stats.POISSON)
_CI = ", ".join(f"round(quantile_cont({s}, 0.025), 6) AS {s}_low, round(quantile_cont({s}, 0.975), 6) AS {s}_high, count({s}) AS {s}_n" for s in CHOSEN)
def _rest(q: str, s: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CASE WHEN {q} - {s} * {s} / {n} > 1e-12 * {q} THEN {q} - {s} * {s} / {n} ELSE 0 END END"


Q76 = f"""WITH {LAB_SQL}, r AS (SELECT lang, toxic, (n_chars % 1000) / 1000.0::DOUBLE AS x, (doc_id * 31 % 97)::DOUBLE AS y, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM lab),
uu AS (SELECT lang, toxic, x, y, b, {resampling.mixed_sql('h', 'b')} AS u FROM r, (SELECT unnest(range(1, {SAMPLES + 1})) AS b)), ww AS (SELECT *, ({_W})::DOUBLE AS w FROM uu),
s AS (SELECT lang, b, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * y * y) AS yy, sum(w * x * y) AS xy, sum(w * toxic) AS n1, sum(w * (1 - toxic)) AS n0, sum(w * toxic * x) AS s1, sum(w * (1 - toxic) * x) AS s0, sum(w * toxic * x * x) AS q1, sum(w * (1 - toxic) * x * x) AS q0 FROM ww GROUP BY 1, 2),
c AS (SELECT *, {_rest('xx', 'x', 'w')} AS cx, {_rest('yy', 'y', 'w')} AS cy, {_rest('q1', 's1', 'n1')} AS c1, {_rest('q0', 's0', 'n0')} AS c0 FROM s),
t AS (SELECT lang, x / nullif(w, 0) AS mean, (xy - x * y / nullif(w, 0)) / nullif(sqrt(cx * cy), 0) AS correlation, CASE WHEN w > 0 THEN sqrt(greatest(xx / w - pow(x / w, 2), 0)) / nullif(x / w, 0) END AS cv,
 CASE WHEN n1 >= 2 AND n0 >= 2 THEN (s1 / n1 - s0 / n0) / nullif(sqrt((c1 + c0) / (n1 + n0 - 2)), 0) * (1 - 3.0 / (4 * (n1 + n0) - 9)) END AS g FROM c)
SELECT lang, {_CI} FROM t GROUP BY 1"""


def q77_welch_of_series(spark, d):
    """Mean periodograms of users' values in order of time, in half overlapping segments of 16 events."""
    found = long_series.welch(activity(spark, d), ["user_id"], ["ts", "event_id"], "value", 16.0, 16)
    return rounded(found.select("user_id", "n_segments", F.posexplode("density").alias("k", "power")).withColumn("k", F.col("k").cast("bigint")), "power", digits=5)


Q77 = """WITH e AS (SELECT user_id, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT user_id, unnest(range((max(n) - 16) // 8 + 1)) AS seg FROM e GROUP BY 1 HAVING max(n) >= 16),
w AS (SELECT e.user_id, seg, i - 8 * seg AS j, v - avg(v) OVER (PARTITION BY e.user_id, seg) AS c FROM e JOIN s ON e.user_id = s.user_id AND i >= 8 * seg AND i < 8 * seg + 16),
h AS (SELECT user_id, seg, j, c * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS c FROM w),
p AS (SELECT user_id, seg, k, pow(sum(c * cos(2 * pi() * k * j / 16)), 2) + pow(sum(c * sin(2 * pi() * k * j / 16)), 2) AS p FROM h, (SELECT unnest(range(9)) AS k) GROUP BY 1, 2, 3)
SELECT user_id, count(*) AS n_segments, k, round(avg(p) / (16 * 6.0) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END, 5) AS power FROM p GROUP BY 1, 3"""


def q78_lag_features(spark, d):
    """Hjorth's figures, pattern entropy and Higuchi's slope of each user's values in order of time."""
    found = long_series.lag_features(activity(spark, d), ["user_id"], ["ts", "event_id"], "value", 5)
    return rounded(found, "mobility", "complexity", "perm_entropy", "higuchi")


Q78 = """WITH e AS (SELECT user_id, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
d1 AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY i) AS dv FROM e), d2 AS (SELECT *, dv - lag(dv) OVER (PARTITION BY user_id ORDER BY i) AS ddv FROM d1),
hj AS (SELECT user_id, count(*) AS n, stddev_pop(v) AS s0, stddev_pop(dv) AS s1, stddev_pop(ddv) AS s2 FROM d2 GROUP BY 1),
p3 AS (SELECT user_id, v AS a, lead(v) OVER q AS b, lead(v, 2) OVER q AS c FROM e WINDOW q AS (PARTITION BY user_id ORDER BY i)), pc AS (SELECT user_id, a <= b AS ab, b <= c AS bc, a <= c AS ac, count(*) AS n FROM p3 WHERE c IS NOT NULL GROUP BY 1, 2, 3, 4),
pn AS (SELECT user_id, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS q FROM pc), pe AS (SELECT user_id, -sum(q * ln(q)) / ln(6) AS perm_entropy FROM pn GROUP BY 1),
kk AS (SELECT unnest(range(1, 6)) AS k), hs AS (SELECT user_id, k, i % k AS m, n, abs(v - lag(v) OVER (PARTITION BY user_id, k, i % k ORDER BY i)) AS s FROM e, kk),
hl AS (SELECT user_id, k, m, sum(s) * (any_value(n) - 1) / (count(*) - 1) / k AS len FROM hs GROUP BY 1, 2, 3 HAVING count(*) > 1), ha AS (SELECT user_id, k, ln(avg(len) + 1e-30) AS y, ln(1.0 / k) AS x FROM hl GROUP BY 1, 2), hf AS (SELECT user_id, regr_slope(y, x) AS fd FROM ha GROUP BY 1)
SELECT hj.user_id, n, round(s1 / (s0 + 1e-30), 6) AS mobility, round((s2 / (s1 + 1e-30)) / (s1 / (s0 + 1e-30) + 1e-30), 6) AS complexity, round(perm_entropy, 6) AS perm_entropy, round(fd, 6) AS higuchi FROM hj JOIN pe USING (user_id) JOIN hf USING (user_id)"""


def q84_channel_correlations(spark, d):
    """The smallest of the 2016 correlations of two of the 64 channels of the embeddings of a label."""
    return rounded(comoments.smallest_correlation(table(spark, d, "embeddings"), ["label"], "embedding", 64), "min_corr")


Q84 = """WITH x AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT a.label, a.i, b.i AS j, count(*) AS n, corr(a.v, b.v) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2, 3)
SELECT label, any_value(n) AS n, round(min(r), 6) AS min_corr, count(r) AS n_pairs FROM c GROUP BY 1"""

QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}
SQL = {n: globals()[f"Q{n[1:3]}"] for n in QUERIES}
