"""Queries on names, metadata and time grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.config import Temporal
from tidegrid.functions import names
from tidegrid.functions.expr import finite
from tidegrid.operators import relational, stats, timegrid
from tidegrid.plans.bindings import COMPONENTS, DAY, activity, profiles, table

WIDTH = len(COMPONENTS)
CFG = Temporal(tol_log2=1.0, tol_js=0.25)
PROTOCOL = Temporal(block_seconds=DAY, min_seconds=10 * DAY, min_skip=DAY, max_skip=8 * DAY, target=6 * DAY, max_window=8 * DAY, tol_log2=1.0, tol_js=0.25)


def named_files(spark: SparkSession, d: str) -> DataFrame:
    """A file name for each event; every seventh is malformed and views have no task."""
    user = F.lpad(F.col("user_id").cast("string"), 8, "0")
    task = F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("_"), F.col("event_type")))
    stem = F.when(F.col("event_id") % 7 == 0, F.substring(user, 3, 6)).otherwise(user)
    return table(spark, d, "events").select("event_id", F.concat(stem, task, F.lit(".txt")).alias("name"))


FILES_SQL = """files AS (SELECT event_id, (CASE WHEN event_id % 7 = 0 THEN substr(lpad(CAST(user_id AS VARCHAR), 8, '0'), 3, 6) ELSE lpad(CAST(user_id AS VARCHAR), 8, '0') END)
 || (CASE WHEN event_type = 'view' THEN '' ELSE '_' || event_type END) || '.txt' AS name FROM events)"""
NAME_SQL = r"'^(\d{8})(?:_([A-Za-z]+))?\.txt$'"


def q01_filename_parse(spark, d):
    files = named_files(spark, d)
    parsed = names.parse_name(F.col("name"))
    return files.select("event_id", *(c.alias(n) for n, c in parsed.items()))


Q01 = f"""WITH {FILES_SQL} SELECT event_id, CASE WHEN regexp_matches(name, {NAME_SQL}) THEN regexp_extract(name, {NAME_SQL}, 1) END AS subject_id,
CASE WHEN NOT regexp_matches(name, {NAME_SQL}) THEN NULL WHEN regexp_extract(name, {NAME_SQL}, 2) = '' THEN 'unspecified' ELSE lower(regexp_extract(name, {NAME_SQL}, 2)) END AS task FROM files"""


def q02_quarantine(spark, d):
    files = named_files(spark, d).withColumn("status", names.quarantine(F.col("name")))
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("name").alias("n_names"), F.min("name").alias("first_name"))


Q02 = f"""WITH {FILES_SQL} SELECT CASE WHEN regexp_matches(name, {NAME_SQL}) THEN 'valid' ELSE 'quarantined' END AS status, count(*) AS n_files, count(DISTINCT name) AS n_names, min(name) AS first_name FROM files GROUP BY 1"""


def q03_id_canonical(spark, d):
    raw = F.concat(F.lit(" "), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("000000000"))), F.lit(" "))
    return table(spark, d, "orders").select("o_orderkey", names.canonical_id(raw).alias("subject_id"))


Q03 = r"""WITH raw AS (SELECT o_orderkey, regexp_replace(trim(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || '.0' ELSE o_custkey || '000000000' END), '\.0$', '') AS s FROM orders)
SELECT o_orderkey, CASE WHEN length(s) < 8 THEN lpad(s, 8, '0') ELSE s END AS subject_id FROM raw"""


def q04_wraparound(spark, d):
    value = F.col("l_partkey")
    fixed = table(spark, d, "lineitem").select("l_suppkey", names.unwrap(value, 11).alias("v"), names.is_wrapped(value, 11).alias("wrapped"))
    return fixed.groupBy("l_suppkey").agg(F.count_if("wrapped").alias("n_fixed"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.sum("v").alias("sum_v"))


Q04 = """SELECT l_suppkey, count(*) FILTER (l_partkey > 1024) AS n_fixed, min(v) AS min_v, max(v) AS max_v, CAST(sum(v) AS BIGINT) AS sum_v
FROM (SELECT l_suppkey, l_partkey, CASE WHEN l_partkey > 1024 THEN l_partkey - 2048 ELSE l_partkey END AS v FROM lineitem) GROUP BY l_suppkey"""


def q05_contract_check(spark, d):
    facts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("l_quantity") == F.bround("l_quantity")).alias("integer"),
        F.bool_and(F.coalesce(finite(F.col("l_extendedprice")), F.lit(False))).alias("finite"),
        F.bool_and(F.col("l_extendedprice") == F.bround("l_extendedprice")).alias("whole_price"),
    )
    reason = F.when(F.col("n") < 2, "too_short").when(~F.col("finite"), "not_finite").when(~F.col("integer"), "not_integer").when(F.col("whole_price"), "whole_price").otherwise("ok")
    return facts.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").alias("n_samples"))


Q05 = """WITH f AS (SELECT l_orderkey, count(*) AS n, bool_and(l_quantity = round_even(l_quantity, 0)) AS i, bool_and(isfinite(l_extendedprice)) AS fin, bool_and(l_extendedprice = round_even(l_extendedprice, 0)) AS w FROM lineitem GROUP BY 1)
SELECT CASE WHEN n < 2 THEN 'too_short' WHEN NOT fin THEN 'not_finite' WHEN NOT i THEN 'not_integer' WHEN w THEN 'whole_price' ELSE 'ok' END AS reason, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_samples FROM f GROUP BY 1"""


def q06_label_sex_map(spark, d):
    raw = F.when(F.col("c_nationkey") < 8, F.col("c_mktsegment")).otherwise((F.col("c_custkey") % 2 + 1).cast("string"))
    group = F.when(F.col("c_custkey") % 3 == 0, " mdd_x").when(F.col("c_custkey") % 3 == 1, "HC1").otherwise("other")
    people = table(spark, d, "customer").select("c_custkey", raw.alias("raw_sex"), names.group_label(group).alias("label"))
    return names.parse_sex(people, "raw_sex").select("c_custkey", "label", "sex")


Q06 = """WITH r AS (SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN c_mktsegment ELSE CAST(c_custkey % 2 + 1 AS VARCHAR) END AS raw,
 CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 0 END AS label FROM customer),
t AS (SELECT *, CASE WHEN upper(trim(raw)) LIKE 'M%' OR upper(trim(raw)) = 'H' THEN 1.0::DOUBLE WHEN upper(trim(raw)) LIKE 'F%' OR upper(trim(raw)) = 'W' THEN 0.0::DOUBLE END AS txt FROM r),
c AS (SELECT *, CASE WHEN txt IS NULL THEN TRY_CAST(raw AS DOUBLE) END AS code FROM t),
g AS (SELECT bool_and(code IN (1, 2)) AS one_two, bool_and(code IN (0, 1)) AS zero_one FROM c)
SELECT c_custkey, label, coalesce(txt, CASE WHEN one_two THEN 2.0 - code WHEN zero_one THEN code END) AS sex FROM c, g"""


def q07_meta_left_join_unmatched(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    joined = relational.attach_metadata(docs, table(spark, d, "labels"), "doc_id", "quality")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("unmatched").alias("n_unmatched"), F.sum("quality").alias("n_good"))


Q07 = "SELECT source, count(*) AS n, count(*) FILTER (quality IS NULL) AS n_unmatched, CAST(sum(quality) AS BIGINT) AS n_good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"


def q08_cohort_audit(spark, d):
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    observed = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") + 5).alias("id"))
    return relational.cohort_audit(expected, observed, "id")


Q08 = """WITH e AS (SELECT DISTINCT c_custkey AS id FROM customer), o AS (SELECT DISTINCT o_custkey + 5 AS id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT (SELECT count(*) FROM e) AS n_expected, (SELECT count(*) FROM o) AS n_observed, (SELECT count(*) FROM e WHERE id NOT IN (SELECT id FROM o)) AS n_missing,
(SELECT count(*) FROM o WHERE id NOT IN (SELECT id FROM e)) AS n_unexpected, (SELECT count(*) FROM e WHERE id IN (SELECT id FROM o))::DOUBLE / (SELECT count(*) FROM e) AS coverage"""

BLOCK_SQL = "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000) AS BIGINT)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def q09_block_rms(spark, d):
    blocks = timegrid.block_rms(activity(spark, d), "user_id", "block", "value")
    return rounded(blocks.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.median("rms").alias("median_rms"), F.max("rms").alias("max_rms")), "median_rms", "max_rms")


BLOCKS_SQL = f"b AS (SELECT user_id, {BLOCK_SQL} AS block, count(*) AS n, sqrt(avg(value * value)) AS rms FROM events GROUP BY 1, 2)"
Q09 = f"WITH {BLOCKS_SQL} SELECT user_id, count(*) AS n_blocks, round(median(rms), 6) AS median_rms, round(max(rms), 6) AS max_rms FROM b GROUP BY 1"

_SUMS = ", ".join(f"coalesce(sum(value * value) FILTER (event_type = '{c}'), 0) AS w{i}" for i, c in enumerate(COMPONENTS))
_ALL = " + ".join(f"w{i}" for i in range(WIDTH))
_SHARES = ", ".join(f"CASE WHEN {_ALL} > 0 THEN w{i} / ({_ALL}) ELSE {1 / WIDTH} END AS p{i}" for i in range(WIDTH))
PROF_SQL = f"w AS (SELECT user_id, {BLOCK_SQL} AS block, count(*) AS n, sqrt(avg(value * value)) AS rms, {_SUMS} FROM events GROUP BY 1, 2), prof AS (SELECT user_id, block, n, rms, {_SHARES} FROM w)"


def spread_profile(column: str = "prof", prefix: str = "p") -> list:
    return [F.round(F.get(column, F.lit(i)), 6).alias(f"{prefix}{i}") for i in range(WIDTH)]


def q10_block_profile(spark, d):
    return profiles(spark, d).select("user_id", "block", "n", F.round("rms", 6).alias("rms"), *spread_profile())


Q10 = f"WITH {PROF_SQL} SELECT user_id, block, n, round(rms, 6) AS rms, {', '.join(f'round(p{i}, 6) AS p{i}' for i in range(WIDTH))} FROM prof"


def js_sql(p: list[str], q: list[str]) -> str:
    """Jensen-Shannon divergence of two lists of SQL columns."""
    clip = lambda xs: [f"greatest({x}, 1e-12)" for x in xs]
    a, b = ([f"({x} / ({' + '.join(clip(xs))}))" for x in clip(xs)] for xs in (p, q))
    return " + ".join(f"{x} * log2({x} / (({x} + {y}) / 2)) / 2 + {y} * log2({y} / (({x} + {y}) / 2)) / 2" for x, y in zip(a, b, strict=True))


_P = [f"p{i}" for i in range(WIDTH)]


def q11_js_to_self_median(spark, d):
    blocks = profiles(spark, d)
    own = timegrid.median_profile(blocks, ["user_id"], WIDTH)
    scored = blocks.join(own, "user_id").withColumn("js", timegrid.js_divergence(F.col("prof"), F.col("median_prof")))
    return rounded(scored.groupBy("user_id").agg(F.avg("js").alias("mean_js"), F.max("js").alias("max_js")), "mean_js", "max_js")


Q11 = f"""WITH {PROF_SQL}, own AS (SELECT user_id, {', '.join(f'median(p{i}) AS m{i}' for i in range(WIDTH))} FROM prof GROUP BY 1),
s AS (SELECT user_id, {js_sql(_P, [f'm{i}' for i in range(WIDTH)])} AS js FROM prof JOIN own USING (user_id))
SELECT user_id, round(avg(js), 6) AS mean_js, round(max(js), 6) AS max_js FROM s GROUP BY 1"""


def q12_terminal_tail_k(spark, d):
    return rounded(timegrid.terminal(profiles(spark, d), "user_id", "block", CFG.terminal_blocks).select("user_id", "block", "rms", "n_blocks", F.col("k").cast("long").alias("k")), "rms")


TAIL_SQL = """n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_blocks, row_number() OVER (PARTITION BY user_id ORDER BY block DESC) AS back FROM prof),
k AS (SELECT *, CAST(greatest(2, least(5, n_blocks // 2)) AS BIGINT) AS k FROM n), tail AS (SELECT * FROM k WHERE back <= k)"""
Q12 = f"WITH {PROF_SQL}, {TAIL_SQL} SELECT user_id, block, round(rms, 6) AS rms, n_blocks, k FROM tail"


def q13_cohort_reference(spark, d):
    ref = timegrid.cohort_reference(profiles(spark, d), "user_id", "block", CFG, WIDTH)
    return ref.select(*spread_profile("ref", "r"))


_M = ", ".join(f"median(p{i}) AS p{i}" for i in range(WIDTH))
REF_SQL = f"""ends AS (SELECT user_id, {_M} FROM tail WHERE n_blocks >= 4 GROUP BY 1), pooled AS (SELECT {_M} FROM ends),
ref AS (SELECT {', '.join(f"CASE WHEN {' + '.join(_P)} > 0 THEN p{i} / ({' + '.join(_P)}) ELSE {1 / WIDTH} END AS r{i}" for i in range(WIDTH))} FROM pooled)"""
Q13 = f"WITH {PROF_SQL}, {TAIL_SQL}, {REF_SQL} SELECT {', '.join(f'round(r{i}, 6) AS r{i}' for i in range(WIDTH))} FROM ref"


def stability(spark, d, cfg=CFG):
    return timegrid.block_stability(profiles(spark, d), "user_id", "block", cfg, WIDTH)


def q14_settling_time(spark, d):
    return rounded(timegrid.settling_time(stability(spark, d), "user_id", "block").drop("first_block", "last_block"), "frac_stable")


STABLE_SQL = f"""endrms AS (SELECT user_id, median(rms) AS end_rms, max(n_blocks) AS n_blocks FROM tail GROUP BY 1),
dev AS (SELECT p.user_id, p.block, p.rms, abs(log2((p.rms + 1e-30) / (e.end_rms + 1e-30))) AS dev_log2, {js_sql([f'p.p{i}' for i in range(WIDTH)], [f'r{i}' for i in range(WIDTH)])} AS dev_js FROM prof p JOIN endrms e USING (user_id), ref),
stable AS (SELECT *, dev_log2 <= 1.0 AND dev_js <= 0.25 AS stable FROM dev)"""
SETTLE_SQL = """bad AS (SELECT *, coalesce(max(CASE WHEN NOT stable THEN block END) OVER (PARTITION BY user_id), -1) AS bad FROM stable),
settle AS (SELECT user_id, count(*) AS n_blocks, avg(CAST(stable AS INT)) AS frac_stable, min(CASE WHEN block > bad THEN block END) AS f FROM bad GROUP BY 1)"""
CHAIN = f"WITH {PROF_SQL}, {TAIL_SQL}, {REF_SQL}, {STABLE_SQL}, {SETTLE_SQL}"
Q14 = f"""{CHAIN} SELECT user_id, n_blocks, round(frac_stable, 6) AS frac_stable, CASE WHEN n_blocks >= 4 THEN f END AS first_stable,
CASE WHEN n_blocks < 4 THEN 'insufficient_blocks' WHEN f IS NULL THEN 'never_stable' ELSE 'ok' END AS status FROM settle"""


def q15_settling_trend_spearman(spark, d):
    blocks = profiles(spark, d)
    whole = timegrid.trend(blocks, "user_id", "block", "rms").withColumnRenamed("rho", "rho_all").drop("n")
    tail = timegrid.trend(timegrid.terminal(blocks, "user_id", "block", CFG.terminal_blocks), "user_id", "block", "rms").withColumn("rho_tail", F.when(F.col("n") >= 3, F.col("rho"))).select("user_id", "rho_tail")
    return rounded(whole.join(tail, "user_id").withColumn("drift_spans_record", F.coalesce(F.abs(F.round("rho_tail", 9)) >= 0.5, F.lit(False))), "rho_all", "rho_tail")


def rank_sql(x: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


_CORR = "CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END"
Q15 = f"""WITH {PROF_SQL}, {TAIL_SQL}, a AS (SELECT user_id, {rank_sql('block', 'user_id')} AS x, {rank_sql('rms', 'user_id')} AS y FROM prof),
t AS (SELECT user_id, {rank_sql('block', 'user_id')} AS x, {rank_sql('rms', 'user_id')} AS y FROM tail),
ra AS (SELECT user_id, {_CORR} AS rho FROM a GROUP BY 1), rt AS (SELECT user_id, CASE WHEN count(*) >= 3 THEN {_CORR} END AS rho FROM t GROUP BY 1)
SELECT user_id, round(ra.rho, 6) AS rho_all, round(rt.rho, 6) AS rho_tail, coalesce(abs(round(rt.rho, 9)) >= 0.5, false) AS drift_spans_record FROM ra JOIN rt USING (user_id)"""


def settled_durations(spark, d):
    """Settling time and length of each user's record, in seconds since its first day."""
    found = timegrid.settling_time(stability(spark, d, PROTOCOL), "user_id", "block")
    return found.withColumns({"duration": (F.col("last_block") - F.col("first_block") + 1) * DAY, "settling": (F.col("first_stable") - F.col("first_block")) * DAY})


def q16_temporal_protocol(spark, d):
    plan = timegrid.temporal_protocol(settled_durations(spark, d), "settling", "duration", PROTOCOL)
    return plan.select("n_eligible", "n_short", F.round("settle_q", 3).alias("settle_q"), "skip_raw", "skip", "available", "window", F.col("n_windows").cast("long").alias("n_windows"), F.array_join(F.transform("starts", lambda s: s.cast("long").cast("string")), ",").alias("starts"), "skip_capped", "protocol_valid")


Q16 = f"""{CHAIN}, span AS (SELECT user_id, (max(block) - min(block) + 1) * 86400.0 AS duration, min(block) AS first_block FROM prof GROUP BY 1),
j AS (SELECT user_id, duration, CASE WHEN n_blocks >= 4 THEN (f - first_block) * 86400.0 END AS settling FROM settle JOIN span USING (user_id)),
facts AS (SELECT count(*) FILTER (duration >= 864000) AS n_eligible, count(*) FILTER (duration < 864000) AS n_short, quantile_cont(settling, 0.8) FILTER (duration >= 864000) AS settle_q, min(duration) FILTER (duration >= 864000) AS shortest FROM j),
a AS (SELECT *, ceil(coalesce(settle_q, 86400) / 86400) * 86400.0 AS skip_raw FROM facts), b AS (SELECT *, least(greatest(skip_raw, 86400), 691200) AS skip FROM a),
c AS (SELECT *, shortest - skip AS available FROM b), e AS (SELECT *, floor(least(available, 518400, 691200)) AS win FROM c),
g AS (SELECT *, CAST(least(greatest(floor(available / win), 1), 3) AS BIGINT) AS n_windows FROM e),
s AS (SELECT *, unnest(range(n_windows)) AS i FROM g),
st AS (SELECT i, floor(skip + CASE WHEN n_windows > 1 THEN (available - win) / (n_windows - 1) * i ELSE 0 END) AS start, win, shortest FROM s)
SELECT n_eligible, n_short, CAST(round(settle_q, 3) AS DOUBLE) AS settle_q, CAST(skip_raw AS DOUBLE) AS skip_raw, CAST(skip AS DOUBLE) AS skip, CAST(available AS DOUBLE) AS available, CAST(win AS DOUBLE) AS "window", n_windows,
(SELECT string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR), ',' ORDER BY i) FROM st WHERE start + win <= shortest) AS starts, skip_raw > 691200 AS skip_capped, win > 0 AND NOT skip_raw > 691200 AS protocol_valid FROM g"""


def window_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("w1", 2.0, 8.0), ("w2", 8.5, 8.0), ("w3", 20.0, 8.0)], "window_key string, start double, length double")


def in_windows(spark, d):
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / (DAY * 1e6)
    return timegrid.cut_windows(activity(spark, d).withColumn("t", seconds), window_table(spark), "t")


WINDOWS_SQL = """win(window_key, start, length) AS (VALUES ('w1', 2.0::DOUBLE, 8.0::DOUBLE), ('w2', 8.5, 8.0), ('w3', 20.0, 8.0)),
cut AS (SELECT e.*, w.window_key FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS t FROM events) e JOIN win w ON t >= w.start AND t < w.start + w.length)"""


def q17_sensitivity_windows(spark, d):
    """The mean value of two groups of users in every window, and whether its sign agrees with the first window's."""
    by = in_windows(spark, d).groupBy("window_key").agg(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("even"), F.avg(F.when(F.col("user_id") % 2 == 1, F.col("value"))).alias("odd"))
    by = by.withColumn("effect", F.col("even") - F.col("odd"))
    first = by.filter("window_key = 'w1'").select(F.signum("effect").alias("sign"))
    return rounded(by.join(F.broadcast(first)).withColumn("agrees", F.signum("effect") == F.col("sign")).drop("sign"), "even", "odd", "effect")


Q17 = f"""WITH {WINDOWS_SQL}, g AS (SELECT window_key, avg(value) FILTER (user_id % 2 = 0) AS even, avg(value) FILTER (user_id % 2 = 1) AS odd FROM cut GROUP BY 1)
SELECT window_key, round(even, 6) AS even, round(odd, 6) AS odd, round(even - odd, 6) AS effect, sign(even - odd) = (SELECT sign(even - odd) FROM g WHERE window_key = 'w1') AS agrees FROM g"""


def q18_window_cut_range_join(spark, d):
    return rounded(in_windows(spark, d).groupBy("window_key", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=4)


Q18 = f"WITH {WINDOWS_SQL} SELECT window_key, user_id, count(*) AS n, round(sum(value), 4) AS total FROM cut GROUP BY 1, 2"


def q19_within_window_drift(spark, d):
    return rounded(timegrid.within_drift(profiles(spark, d).filter("block >= 5 and block < 17"), "user_id", "block", WIDTH), "drift_log2_rms", "drift_js", "drift_rms_spearman")


Q19 = f"""WITH {PROF_SQL}, p AS (SELECT * FROM prof WHERE block >= 5 AND block < 17), own AS (SELECT user_id, {', '.join(f'median(p{i}) AS m{i}' for i in range(WIDTH))} FROM p GROUP BY 1),
s AS (SELECT user_id, rms, {js_sql(_P, [f'm{i}' for i in range(WIDTH)])} AS js, {rank_sql('block', 'user_id')} AS x, {rank_sql('rms', 'user_id')} AS y FROM p JOIN own USING (user_id))
SELECT user_id, round(log2((max(rms) + 1e-30) / (min(rms) + 1e-30)), 6) AS drift_log2_rms, round(max(js), 6) AS drift_js, round({_CORR}, 6) AS drift_rms_spearman FROM s GROUP BY 1"""


def q20_nonstationarity_cv(spark, d):
    return rounded(timegrid.nonstationarity(activity(spark, d), "user_id", "block", "event_type", "value"), "cv")


Q20 = f"""WITH v AS (SELECT user_id, {BLOCK_SQL} AS block, event_type, var_pop(value) AS v FROM events GROUP BY 1, 2, 3), b AS (SELECT user_id, block, avg(v) AS v FROM v GROUP BY 1, 2)
SELECT user_id, count(*) AS n_blocks, CASE WHEN count(*) >= 3 AND avg(v) > 0 THEN round(stddev_pop(v) / avg(v), 6) END AS cv FROM b GROUP BY 1"""


def q21_demean(spark, d):
    return rounded(timegrid.demean(activity(spark, d), ["user_id", "event_type"], "value", "centred").select("event_id", "centred"), "centred")


Q21 = "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id, event_type), 6) AS centred FROM events"


def q22_edge_trim(spark, d):
    return timegrid.edge_trim(activity(spark, d), ["user_id"], "event_id", 20).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


Q22 = """SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events)
WHERE i > 20 AND i <= c - 20 GROUP BY 1"""


def q23_diff_zero_fraction(spark, d):
    steps = timegrid.difference(activity(spark, d).withColumn("level", F.floor(F.col("value") / 20)), ["user_id"], ["ts", "event_id"], "level", "step")
    return rounded(steps.filter("step is not null").groupBy("user_id").agg(F.avg((F.col("step") == 0).cast("double")).alias("zero_fraction"), F.max(F.abs("step")).alias("largest")), "zero_fraction")


Q23 = """SELECT user_id, round(avg(CAST(step = 0 AS INT)), 6) AS zero_fraction, CAST(max(abs(step)) AS BIGINT) AS largest FROM (SELECT user_id, CAST(floor(value / 20) AS BIGINT) - lag(CAST(floor(value / 20) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) WHERE step IS NOT NULL GROUP BY 1"""


def q24_saturation_flat(spark, d):
    low, high = 2.0, 49.0
    channels = table(spark, d, "lineitem").select("l_suppkey", F.explode(F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax") * 0)).alias("channel", "v"))
    by = channels.groupBy("l_suppkey", "channel").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("v") <= low) | (F.col("v") >= high)).alias("railed"), (F.max("v") - F.min("v") == 0).alias("flat"))
    return rounded(by.groupBy("l_suppkey").agg((F.sum("railed") / F.sum("n")).alias("saturation"), F.count_if("flat").alias("flat_channels")), "saturation")


Q24 = """WITH c AS (SELECT l_suppkey, 'quantity' AS channel, l_quantity AS v FROM lineitem UNION ALL SELECT l_suppkey, 'discount', l_discount FROM lineitem UNION ALL SELECT l_suppkey, 'tax', l_tax * 0 FROM lineitem),
b AS (SELECT l_suppkey, channel, count(*) AS n, count(*) FILTER (v <= 2 OR v >= 49) AS railed, max(v) - min(v) = 0 AS flat FROM c GROUP BY 1, 2)
SELECT l_suppkey, round(sum(railed) / sum(n), 6) AS saturation, count(*) FILTER (flat) AS flat_channels FROM b GROUP BY 1"""


def q25_channel_corr_min(spark, d):
    pairs = (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*(timegrid.safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return rounded(by.select("l_suppkey", F.least("c0", "c1", "c2").alias("min_corr")), "min_corr")


Q25 = """SELECT l_suppkey, round(least(corr(l_quantity, l_extendedprice), corr(l_quantity, l_discount), corr(l_extendedprice, l_discount)), 6) AS min_corr FROM lineitem GROUP BY 1"""

def q66_full_blocks(spark, d):
    """Blocks of exactly three events; part-filled and overfull ones are left out."""
    kept = timegrid.full_blocks(activity(spark, d), ["user_id", "block"], 3)
    return rounded(timegrid.block_rms(kept, "user_id", "block", "value"), "rms")


Q66 = f"WITH {BLOCKS_SQL} SELECT user_id, block, n, round(rms, 6) AS rms FROM b WHERE n = 3"


def q67_epochs(spark, d):
    """Overlapping epochs of 16 lines, half of them shared, over each supplier's lines in order."""
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity")) - 1
    lines = table(spark, d, "lineitem").select("l_suppkey", place.alias("i"), "l_quantity", F.count(F.lit(1)).over(Window.partitionBy("l_suppkey")).alias("n"))
    parts = lines.select("l_suppkey", F.explode(timegrid.epochs_of(F.col("i"), 16, 0.5, F.col("n"))).alias("epoch"), "l_quantity")
    return rounded(parts.groupBy("l_suppkey", "epoch").agg(F.count(F.lit(1)).alias("n_samples"), F.avg(F.col("l_quantity").cast("double")).alias("mean")), "mean")


Q67 = """WITH l AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS i, l_quantity, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
e AS (SELECT l_suppkey, unnest(range((max(n) - 16) // 8 + 1)) AS epoch FROM l GROUP BY 1 HAVING max(n) >= 16)
SELECT l.l_suppkey, epoch, count(*) AS n_samples, round(avg(l_quantity::DOUBLE), 6) AS mean FROM l JOIN e ON l.l_suppkey = e.l_suppkey AND i >= epoch * 8 AND i < epoch * 8 + 16 GROUP BY 1, 2"""


def q68_one_to_one(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return relational.one_to_one(people, spent, "c_custkey")


Q68 = "SELECT c_custkey, c_acctbal, n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON c_custkey = o_custkey"


def q69_null_report(spark, d):
    gaps = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")).alias("a"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("b"), F.col("c_nationkey").alias("c"))
    return relational.null_report(gaps)


Q69 = """SELECT 'a' AS "column", count(*) FILTER (c_custkey % 3 = 0) AS n_null FROM customer UNION ALL SELECT 'b', count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer
UNION ALL SELECT 'c', count(*) FILTER (c_nationkey IS NULL) FROM customer"""


def q70_z_score(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double").alias("value"))
    return rounded(stats.z_score(people, ["c_nationkey"], "value", "z").select("c_custkey", "z"), "z")


Q70 = "SELECT c_custkey, round((c_acctbal::DOUBLE - avg(c_acctbal::DOUBLE) OVER w) / nullif(stddev_pop(c_acctbal::DOUBLE) OVER w, 0), 6) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)"


def q71_sex_report(spark, d):
    raw = F.when(F.col("c_nationkey") < 8, F.col("c_mktsegment")).otherwise((F.col("c_custkey") % 2 + 1).cast("string"))
    return names.sex_report(table(spark, d, "customer").select(raw.alias("raw_sex")), "raw_sex")


Q71 = """WITH r AS (SELECT CASE WHEN c_nationkey < 8 THEN c_mktsegment ELSE CAST(c_custkey % 2 + 1 AS VARCHAR) END AS raw FROM customer),
t AS (SELECT raw, CASE WHEN upper(trim(raw)) LIKE 'M%' OR upper(trim(raw)) = 'H' THEN 1.0 WHEN upper(trim(raw)) LIKE 'F%' OR upper(trim(raw)) = 'W' THEN 0.0 END AS txt FROM r),
c AS (SELECT *, CASE WHEN txt IS NULL THEN TRY_CAST(raw AS DOUBLE) END AS code FROM t), g AS (SELECT bool_and(code IN (1, 2)) AS one_two, bool_and(code IN (0, 1)) AS zero_one FROM c),
p AS (SELECT txt, coalesce(txt, CASE WHEN one_two THEN 2 - code WHEN zero_one THEN code END) AS sex FROM c, g)
SELECT count(*) AS n, count(txt) AS n_text, count(*) FILTER (txt IS NULL AND sex IS NOT NULL) AS n_numeric, count(*) FILTER (sex IS NULL) AS n_unresolved, (SELECT CASE WHEN one_two THEN '1=male,2=female' WHEN zero_one THEN '0/1' ELSE 'none' END FROM g) AS coding FROM p"""

QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}
SQL = {n: globals()[f"Q{n[1:3]}"] for n in QUERIES}
