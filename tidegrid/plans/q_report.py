"""Queries on cohort reports, exact tests and figures of the study, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegrid.config import Acquisition
from tidegrid.operators import epochs, relational, spectral, stats, timegrid
from tidegrid.plans.bindings import labelled, table
from tidegrid.plans.q_signal import PSD_SQL, STEP, share_sql, spectra
from tidegrid.plans.q_stats import LAB_SQL, two_sided_sql
from tidegrid.plans.q_time import CHAIN, PROTOCOL, _CORR, profiles, rank_sql, rounded, settled_durations
from tidegrid.sources import split_text
from tidegrid.sources.shared import shared_dir


def q79_cohort_differences(spark, d):
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    observed = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") + 5).alias("id"))
    return relational.cohort_differences(expected, observed, "id")


Q79 = """WITH e AS (SELECT DISTINCT c_custkey AS id FROM customer), o AS (SELECT DISTINCT o_custkey + 5 AS id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT id, 'missing' AS status FROM e WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT id, 'unexpected' FROM o WHERE id NOT IN (SELECT id FROM e)"""


def settled(spark, d):
    """Settling, length and drift over the whole record of each user, in seconds."""
    blocks = profiles(spark, d)
    tail = timegrid.trend(timegrid.terminal(blocks, "user_id", "block", PROTOCOL.terminal_blocks), "user_id", "block", "rms")
    spans = tail.select("user_id", ((F.col("n") >= 3) & (F.abs(F.round("rho", 9)) >= 0.5)).alias("spans"))
    return settled_durations(spark, d).join(spans, "user_id")


def q80_settling_figures(spark, d):
    """Median and maximum of settling, records that drift throughout, and how many are eligible; from the same rows."""
    rows = settled(spark, d)
    who = timegrid.protocol_subjects(rows, "user_id", "duration", PROTOCOL).agg(F.count_if("eligible").alias("n_eligible"), F.count_if(~F.col("eligible")).alias("n_short"), F.sum(F.when(~F.col("eligible"), F.col("user_id"))).alias("sum_of_short_ids"))
    return timegrid.settling_figures(rows, "settling", "duration", "spans", PROTOCOL).join(F.broadcast(who))  # one row each


Q80 = f"""{CHAIN}, span AS (SELECT user_id, (max(block) - min(block) + 1) * 86400.0 AS duration, min(block) AS first_block FROM prof GROUP BY 1),
t AS (SELECT user_id, {rank_sql('block', 'user_id')} AS x, {rank_sql('rms', 'user_id')} AS y FROM tail), rt AS (SELECT user_id, count(*) AS c, {_CORR} AS rho FROM t GROUP BY 1),
j AS (SELECT user_id, duration, CASE WHEN n_blocks >= 4 THEN (f - first_block) * 86400.0 END AS settling, coalesce(c >= 3 AND abs(round(rho, 9)) >= 0.5, false) AS spans FROM settle JOIN span USING (user_id) JOIN rt USING (user_id))
SELECT CAST(median(settling) FILTER (duration >= 864000) AS DOUBLE) AS settle_median, CAST(max(settling) FILTER (duration >= 864000) AS DOUBLE) AS settle_max, count(*) FILTER (spans AND duration >= 864000) AS n_drift_spans_record,
count(*) FILTER (duration >= 864000) AS n_eligible, count(*) FILTER (duration < 864000) AS n_short, CAST(sum(user_id) FILTER (duration < 864000) AS BIGINT) AS sum_of_short_ids FROM j"""


def band_shares(spark, d):
    p = F.col("p")
    return spectra(spark, d).select("label", F.floor(F.col("vec_id") / 3).alias("epoch"), spectral.band_share(p, 8, 13, STEP).alias("rel_alpha"), spectral.band_share(p, 13, 30, STEP).alias("rel_beta"))


def q81_epoch_means(spark, d):
    """The other side of the switch: means over epochs of medians over channels."""
    out = epochs.aggregate_epochs(band_shares(spark, d), ["label"], "epoch", ["rel_alpha", "rel_beta"], "mean")
    return rounded(out, "p__rel_alpha", "p__rel_beta", "e__iqr_rel_alpha", "e__iqr_rel_beta")


Q81 = f"""WITH {PSD_SQL}, s AS (SELECT vec_id, label, {share_sql(8, 13)} AS a, {share_sql(13, 30)} AS b FROM psd GROUP BY 1, 2), e AS (SELECT label, vec_id // 3 AS epoch, median(a) AS a, median(b) AS b FROM s GROUP BY 1, 2)
SELECT label, round(avg(a), 6) AS p__rel_alpha, round(avg(b), 6) AS p__rel_beta, round(quantile_cont(a, 0.75) - quantile_cont(a, 0.25), 6) AS e__iqr_rel_alpha, round(quantile_cont(b, 0.75) - quantile_cont(b, 0.25), 6) AS e__iqr_rel_beta, count(*) AS n_epochs FROM e GROUP BY 1"""


def small_groups(spark, d):
    """Documents of a source and language: few, with values that differ."""
    docs = labelled(spark, d).filter("doc_id % 5 = 1")
    return docs.select(F.concat_ws("|", "source", "lang").alias("g"), "toxic", (F.col("doc_id") * 7919 % 100_003).cast("double").alias("v"))


def q82_exact_mann_whitney(spark, d):
    return rounded(stats.mann_whitney(small_groups(spark, d), ["g"], "v", "toxic"), "u", "auc", "p")


Q82 = f"""WITH RECURSIVE {LAB_SQL}, r AS (SELECT source || '|' || lang AS g, toxic, (doc_id * 7919 % 100003)::DOUBLE AS v FROM lab WHERE doc_id % 5 = 1),
rk AS (SELECT g, toxic, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY g, v)::DOUBLE AS t FROM r),
b AS (SELECT g, count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0, sum(r) FILTER (toxic = 1) AS ranks, sum(t * t - 1) AS ties FROM rk GROUP BY 1),
m AS (SELECT *, ranks - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / nullif((n1 + n0) * (n1 + n0 - 1), 0))) AS sd FROM b),
z AS (SELECT *, greatest((greatest(u, n1 * n0 - u) - n1 * n0 / 2.0 - 0.5) / nullif(sd, 0), 0) AS z, ties = 0 AND least(n1, n0) BETWEEN 1 AND 8 AS few FROM m),
sizes AS (SELECT DISTINCT n1, n0, least(n1, n0) AS k, n1 + n0 AS n FROM z WHERE few),
dp AS (SELECT n1, n0, k, n, 0 AS i, 0 AS chosen, 0 AS s, 1.0::DOUBLE AS w FROM sizes
 UNION ALL SELECT n1, n0, k, n, i + 1, c, t, sum(w) FROM (SELECT n1, n0, k, n, i, chosen + x AS c, s + x * (i + 1) AS t, w FROM dp, (VALUES (0), (1)) AS x(x) WHERE i < n AND chosen + x <= k) q GROUP BY n1, n0, k, n, i, c, t),
law AS (SELECT n1, n0, s - k * (k + 1) // 2 AS u, w, sum(w) OVER (PARTITION BY n1, n0) AS whole FROM dp WHERE i = n AND chosen = k),
ex AS (SELECT z.g, least(2 * sum(w) / any_value(whole), 1) AS p FROM z JOIN law ON law.n1 = z.n1 AND law.n0 = z.n0 AND few AND law.u <= least(z.u, z.n1 * z.n0 - z.u) GROUP BY 1)
SELECT z.g, n1, n0, round(u, 6) AS u, round(u / nullif(n1 * n0, 0), 6) AS auc, round(CASE WHEN few THEN ex.p ELSE {two_sided_sql('z.z')} END, 6) AS p FROM z LEFT JOIN ex ON ex.g = z.g"""


def q83_alpha_asymmetry(spark, d):
    """Median over epochs of the log ratio of alpha power of two channels."""
    power = spectra(spark, d).select("label", F.floor(F.col("vec_id") / 3).alias("epoch"), (F.col("vec_id") % 3).alias("channel"), F.aggregate(spectral.band(F.col("p"), 8, 13, STEP), F.lit(0.0), lambda a, x: a + x).alias("alpha"))
    return rounded(epochs.asymmetry(power, ["label"], "epoch", "channel", "alpha", 0, 2), "asymmetry")


Q83 = f"""WITH {PSD_SQL}, a AS (SELECT vec_id, label, sum(p) AS a FROM psd WHERE f >= 8 AND f < 13 GROUP BY 1, 2), e AS (SELECT label, vec_id // 3 AS epoch, max(a) FILTER (vec_id % 3 = 0) AS l, max(a) FILTER (vec_id % 3 = 2) AS r FROM a GROUP BY 1, 2)
SELECT label, count(ln(r) - ln(l)) AS n_epochs, round(median(ln(r + 1e-30) - ln(l + 1e-30)), 6) AS asymmetry FROM e GROUP BY 1"""

SERIES = 5


def event_files(spark, d) -> str:
    """The events as text recordings of three channels, one file for each fifth of the users, and one whose every seventh line is short."""
    events = table(spark, d, "events").withColumn("series", F.concat(F.lit("s"), (F.col("user_id") % SERIES).cast("string")))
    kind = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type"))
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.round(F.col("value") * 100).cast("bigint").cast("string"), kind.cast("string"))
    whole = events.select("series", "ts", "event_id", line.alias("value"))
    short = events.filter("user_id % 5 = 3").select(F.lit("torn").alias("series"), "ts", "event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_id").cast("string")).otherwise(line).alias("value"))
    path = f"{shared_dir(spark)}/event-files-{uuid.uuid4().hex}"
    whole.unionByName(short).repartition("series").sortWithinPartitions("series", "ts", "event_id").select("series", "value").write.partitionBy("series").text(path)
    return path


def q85_split_text(spark, d):
    """Recordings written as text and read back in splits: what was read, and what was refused for which line."""
    folder_name = lambda path: F.regexp_extract(path, "series=([^/]+)", 1)
    cfg = Acquisition(fs=1.0, channels=("id", "cents", "kind"), container_bits=32, max_seconds=1e12)
    samples, reports = split_text.read_split(spark, event_files(spark, d), cfg, name=folder_name, named=False)
    x = lambda j: F.get("x", F.lit(j)).cast("bigint")
    sums = samples.groupBy("source_name").agg(F.sum(x(0)).alias("ids"), F.sum(x(1)).alias("cents"), F.sum(F.col("i") * x(0)).alias("placed_ids"), F.max("i").alias("last"))
    return reports.join(sums, "source_name", "left").select("source_name", "n_samples", "ids", "cents", "placed_ids", "last", "error")


Q85 = f"""WITH e AS (SELECT 's' || (user_id % {SERIES}) AS s, event_id, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id % {SERIES} ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT s AS source_name, count(*) AS n_samples, CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(i * event_id) AS BIGINT) AS placed_ids, max(i) AS last, NULL AS error FROM e GROUP BY 1
UNION ALL SELECT 'torn', NULL, NULL, NULL, NULL, NULL, 'line ' || (min(i) FILTER (event_id % 7 = 0) + 1) || ': expected 3 columns' FROM e WHERE s = 's3'"""

QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}
SQL = {n: globals()[f"Q{n[1:3]}"] for n in QUERIES}
