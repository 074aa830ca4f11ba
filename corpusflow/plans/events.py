"""Queries over events, orders and line items: evaluation statistics, caches, sessions, sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import joins, medians, reshape, retrieval, sample, stats
from corpusflow.plans.registry import query, table
from corpusflow.streaming import ops


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


_RANKED = "r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


def _at(e: str) -> str:
    return f"round(max(CASE WHEN i = {e} THEN value END), 1)"


@query(f"WITH {_RANKED} SELECT event_type, count(*) AS n, round(avg(value), 1) AS mean, {_at('floor(n * 0.5)')} AS median, {_at('floor(n * 0.9)')} AS p90, {_at('floor(n * 0.95)')} AS p95, round(min(value), 1) AS min, round(max(value), 1) AS max FROM r GROUP BY 1")
def agg1_rank_stats(spark, sf_dir):
    return stats.rank_stats(events(spark, sf_dir), "value", ["event_type"])


@query(f"WITH {_RANKED} SELECT event_type, round(avg(value), 1) AS avg, {_at('floor(n * 0.5)')} AS p50, {_at('least(floor(n * 0.95), n - 1)')} AS p95, round(min(value), 1) AS min, round(max(value), 1) AS max FROM r GROUP BY 1")
def agg2_timing_stats(spark, sf_dir):
    return stats.timing_stats(events(spark, sf_dir), "value", ["event_type"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def agg3_interp_percentiles(spark, sf_dir):
    return stats.interp_percentiles(events(spark, sf_dir), "value", ["event_type"])


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS error, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 2) AS rate_pct FROM events GROUP BY 1")
def agg4_success_summary(spark, sf_dir):
    return stats.success_summary(events(spark, sf_dir), F.col("event_type") != "error", ["user_id"])


@query("""WITH e AS (SELECT user_id % 5 AS eval_set, coalesce(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'view' THEN value * 2 END, value + 1) AS v FROM events),
r AS (SELECT eval_set, v, row_number() OVER (PARTITION BY eval_set ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY eval_set) AS n FROM e)
SELECT eval_set, count(*) AS n, round(avg(v), 1) AS mean, round(max(CASE WHEN i = floor(n * 0.5) THEN v END), 1) AS median, round(max(CASE WHEN i = floor(n * 0.9) THEN v END), 1) AS p90, round(max(CASE WHEN i = floor(n * 0.95) THEN v END), 1) AS p95, round(min(v), 1) AS min, round(max(v), 1) AS max FROM r GROUP BY 1""")
def agg5_by_group(spark, sf_dir):
    first = F.coalesce(F.when(F.col("event_type") == "click", F.col("value")), F.when(F.col("event_type") == "view", F.col("value") * 2), F.col("value") + 1)
    return stats.rank_stats(events(spark, sf_dir).select((F.col("user_id") % 5).alias("eval_set"), first.alias("v0")), "v0", ["eval_set"])


@query("SELECT coalesce(event_type, 'Overall') AS event_type, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def agg6_with_overall(spark, sf_dir):
    return stats.with_overall(events(spark, sf_dir), "event_type", "value")


@query("SELECT o.position, o.event_type, g.* EXCLUDE (event_type) FROM (VALUES (0, 'view'), (1, 'click'), (2, 'absent')) o(position, event_type) LEFT JOIN (SELECT event_type, count(*) AS n, round(median(value), 4) AS value_median, round(quantile_cont(value, 0.95), 4) AS value_p95 FROM events GROUP BY 1) g ON o.event_type = g.event_type")
def agg7_condition_summary(spark, sf_dir):
    return stats.condition_summary(events(spark, sf_dir), "event_type", ["value"], ["view", "click", "absent"])


@query("WITH e AS (SELECT user_id % 7 AS model, value / 200 AS rate FROM events) SELECT model, count(rate) AS n, round(avg(rate), 6) AS mean, round(median(rate), 6) AS median, round(stddev_pop(rate), 6) AS std, round(min(rate), 6) AS best, round(max(rate), 6) AS worst, round(100.0 * count(*) FILTER (rate <= 0.1) / count(*), 2) AS le_10_pct, round(100.0 * count(*) FILTER (rate <= 0.2) / count(*), 2) AS le_20_pct, round(100.0 * count(*) FILTER (rate <= 0.3) / count(*), 2) AS le_30_pct, round(100.0 * count(*) FILTER (rate <= 0.5) / count(*), 2) AS le_50_pct, count(*) FILTER (rate = 0) AS perfect, count(*) FILTER (rate >= 0.5) AS bad FROM e GROUP BY 1")
def agg12_wer_summary(spark, sf_dir):
    return stats.wer_summary(events(spark, sf_dir).select((F.col("user_id") % 7).alias("model"), (F.col("value") / 200).alias("rate")), "rate", ["model"], digits=6)


@query("SELECT CASE WHEN user_id <= 50 THEN 'low' WHEN user_id <= 100 THEN 'mid' ELSE 'high' END AS bucket, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY 1")
def agg13_by_bucket(spark, sf_dir):
    bucket = F.when(F.col("user_id") <= 50, "low").when(F.col("user_id") <= 100, "mid").otherwise("high")
    return events(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


@query("WITH e AS (SELECT l_returnflag, CASE WHEN l_quantity > 1 THEN CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity - 1 AS DOUBLE) / 1000 ELSE 0 END AS rtf FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(rtf), 6) AS mean, round(median(rtf), 6) AS median, round(quantile_cont(rtf, 0.95), 6) AS p95, round(quantile_cont(rtf, 0.99), 6) AS p99, round(max(rtf), 6) AS max FROM e GROUP BY 1")
def agg14_rtf_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return stats.rtf_stats(rows, F.col("l_extendedprice").cast("double") / 1000, (F.col("l_quantity") - 1).cast("double"), ["l_returnflag"])


@query("SELECT event_id, round(value + coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 2 END, 0), 4) AS perceived, round(user_id + value + 1, 4) AS first_audio, CAST(1.0 AS DOUBLE) AS tts_ttfc, round(user_id / nullif(value / 1000.0, 0), 4) AS tokens_per_s FROM events")
def agg15_derived_latency(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id").cast("double")
    cols = stats.derived_latency(u, v, F.when(F.col("event_id") % 3 != 0, v / 2), v, F.lit(1.0), u, v)
    out = events(spark, sf_dir).select("event_id", *cols)
    return out.select("event_id", *(F.round(c, 4).alias(c) for c in out.columns[1:]))


@query("WITH e AS (SELECT user_id % 10 AS node, CASE event_type WHEN 'click' THEN 'hit' WHEN 'view' THEN 'miss' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'error' ELSE 'other' END AS status, value, event_id FROM events), s AS (SELECT node, count(*) FILTER (status = 'hit') AS hits, count(*) FILTER (status = 'miss') AS misses, count(*) FILTER (status = 'write') AS writes, count(*) FILTER (status = 'error') AS errors, CAST(coalesce(sum(event_id) FILTER (status = 'write'), 0) AS BIGINT) AS bytes, round(coalesce(sum(value) FILTER (status = 'hit'), 0), 4) AS saved_ms FROM e GROUP BY 1) SELECT *, round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 0 END, 4) AS hit_rate FROM s")
def agg19_cache_stats(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "click", "hit").when(kind == "view", "miss").when(kind == "purchase", "write").when(kind == "error", "error").otherwise("other")
    return stats.cache_stats(events(spark, sf_dir).select((F.col("user_id") % 10).alias("node"), status.alias("status"), "value", "event_id"), "status", "value", F.col("event_id"), ["node"])


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value) / sqrt(count(value)), 4) AS std_error FROM events GROUP BY 1")
def agg20_mos_ci(spark, sf_dir):
    return stats.mos_ci(events(spark, sf_dir), "event_type", "value").drop("half_width")


_FRIEDMAN = """WITH m AS (SELECT user_id, event_type, avg(floor(value / 10)) AS v FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2),
f AS (SELECT * FROM m WHERE user_id IN (SELECT user_id FROM m GROUP BY 1 HAVING count(*) = 3)),
r AS (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id, v) AS t, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 AS r FROM f),
s AS (SELECT sum(x * x) AS s FROM (SELECT sum(r) AS x FROM r GROUP BY event_type)), t AS (SELECT count(DISTINCT user_id) AS n, sum(CAST(t * t - 1 AS DOUBLE)) AS t FROM r)
SELECT round((12.0 * s / (n * 3 * 4) - 3.0 * n * 4) / (1 - t / (n * 24)), 6) AS chi2, n AS blocks, CAST(2 AS BIGINT) AS freedom FROM s, t"""


@query(_FRIEDMAN)
def agg21_friedman(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v0", F.floor(F.col("value") / 10).cast("double"))
    return stats.friedman(rows, "user_id", "event_type", "v0", ["click", "view", "purchase"])


_CDF = "1 - exp(-x * x / 2.0) / sqrt(2 * pi()) * ((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t"


@query(f"""WITH r AS (SELECT event_type AS c, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events), g AS (SELECT c, count(*) AS n, avg(r) AS m FROM r GROUP BY 1),
a AS (SELECT CAST(sum(t) AS DOUBLE) AS n, sum(pow(t, 3) - t) AS ties FROM (SELECT count(*) AS t FROM events GROUP BY value)),
z AS (SELECT x.c AS first, y.c AS second, (x.m - y.m) / sqrt((a.n * (a.n + 1) / 12.0 - a.ties / (12.0 * (a.n - 1))) * (1.0 / x.n + 1.0 / y.n)) AS z FROM g x JOIN g y ON x.c < y.c, a),
p AS (SELECT *, 2.0 * (1.0 - ({_CDF})) AS p FROM (SELECT *, abs(z) AS x, 1.0 / (1.0 + 0.2316419 * abs(z)) AS t FROM z)),
h AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, first, second) + 1)) AS s FROM p)
SELECT first, second, round(z, 5) AS z, round(p, 5) AS p, round(max(s) OVER (ORDER BY p, first, second ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS p_holm FROM h""")
def agg22_dunn_holm(spark, sf_dir):
    out = stats.dunn_holm(events(spark, sf_dir), "event_type", "value")
    return out.select("first", "second", *(F.round(c, 5).alias(c) for c in ("z", "p", "p_holm")))


@query("WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM events, s GROUP BY 1")
def agg23_histogram(spark, sf_dir):
    return stats.histogram(events(spark, sf_dir), "value", 20)


@query("""WITH e AS (SELECT value AS v FROM events), f AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, 1.06 * stddev_samp(v) * pow(count(*), -0.2) AS bw FROM e),
g AS (SELECT i AS id, lo - 20 + i * (hi - lo + 40) / 49 AS x, bw, n FROM range(50) t(i), f)
SELECT id, round(any_value(x), 6) AS x, round(sum(exp(-((x - v) / bw) * ((x - v) / bw) / 2) / (n * bw * sqrt(2 * pi()))), 6) AS density FROM e, g GROUP BY id""")
def agg24_kde(spark, sf_dir):
    return stats.kde(events(spark, sf_dir), "value", 50, digits=6)


@query("WITH l AS (SELECT 'value' AS metric, value AS v FROM events WHERE event_type <> 'error' UNION ALL SELECT 'user', CAST(user_id AS DOUBLE) FROM events WHERE event_type <> 'error') SELECT metric, round(avg(v), 4) AS mean, round(min(v), 4) AS min, round(max(v), 4) AS max, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.9), 4) AS p90, round(quantile_cont(v, 0.99), 4) AS p99, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed FROM l GROUP BY 1")
def agg25_stress_report(spark, sf_dir):
    return stats.stress_report(events(spark, sf_dir).withColumn("user", F.col("user_id")), F.col("event_type") != "error", ["value", "user"])


@query("WITH e AS (SELECT user_id, epoch(ts) AS t FROM events) SELECT user_id, count(*) AS tokens, round(min(t) - 1704067200, 4) AS ttft, round(CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) ELSE 0 END, 4) AS tpot FROM e GROUP BY 1")
def agg26_ttft_tpot(spark, sf_dir):
    return stats.ttft_tpot(events(spark, sf_dir), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.lit(1704067200.0))


@query("WITH p AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 0 END) AS a, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS f FROM events GROUP BY 1) SELECT count(*) FILTER (a > 0) AS improved, count(*) FILTER (a <= 0 AND f = 1) AS failed, CAST(coalesce(sum(a), 0) AS BIGINT) AS chunks_added FROM p")
def agg27_progress_yield(spark, sf_dir):
    kind = F.col("event_type")
    rows = events(spark, sf_dir).withColumn("added", F.when(kind == "purchase", 1).when(kind == "signup", 2).otherwise(0))
    return stats.progress_yield(rows, "user_id", "added", kind == "error")


@query("""WITH e AS (SELECT user_id, event_id, event_type, value FROM events), x AS (SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM e GROUP BY 1)
SELECT user_id, md5(text) AS h, (SELECT round(max_by(value, event_id), 4) FROM e WHERE e.user_id = x.user_id AND event_type = 'click') AS click, (SELECT round(max_by(value, event_id), 4) FROM e WHERE e.user_id = x.user_id AND event_type = 'view') AS view FROM x""")
def agg28_timing_merge(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", F.create_map("event_type", "value").alias("timing"), F.array("event_type").alias("contexts"))
    out = stats.timing_merge(rows, "user_id", "event_id", "event_type", "timing", "contexts")
    return out.select("user_id", F.md5("text").alias("h"), F.round(F.try_element_at("timing", F.lit("click")), 4).alias("click"), F.round(F.try_element_at("timing", F.lit("view")), 4).alias("view"))


# joins over events


@query("WITH w AS (SELECT user_id, ts AS at, lead(ts, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until, event_id FROM events), p AS (SELECT * FROM w WHERE event_id % 3 = 0 AND until IS NOT NULL) SELECT p.event_id, min(e.ts) AS interrupted_at FROM p JOIN events e ON e.user_id = p.user_id AND e.ts >= p.at AND e.ts < p.until WHERE e.event_type = 'click' GROUP BY 1")
def joi10_interruptions(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    responses = rows.select("user_id", "event_id", F.col("ts").alias("at"), F.lead("ts", 3).over(w).alias("until")).where("event_id % 3 = 0 and until is not null")
    return joins.interruptions(responses, rows.where("event_type = 'click'"), "user_id", "at", "until", "ts").select("event_id", "interrupted_at")


@query("WITH n AS (SELECT event_type, avg(value) AS a FROM events WHERE event_id % 2 = 0 AND value > 1 GROUP BY 1), b AS (SELECT event_type, avg(value) AS b FROM events WHERE event_id % 2 = 1 AND value > 1 GROUP BY 1) SELECT event_type, round(a, 4) AS new_mean, round(b, 4) AS base_mean, round(a - b, 4) AS delta FROM n JOIN b USING (event_type)")
def joi11_compare_runs(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("value") > 1, F.col("value")))
    return joins.compare_runs(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "event_type", "v")


_REQ = "SELECT event_id, user_id % 40 AS key, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id % 40 ORDER BY epoch(ts), event_id) AS i FROM events"


@query(f"""WITH RECURSIVE q AS MATERIALIZED ({_REQ}), f AS (SELECT key, i, event_id, t AS w, false AS hit FROM q WHERE i = 1 UNION ALL
SELECT q.key, q.i, q.event_id, CASE WHEN q.t < f.w + 14400 THEN f.w ELSE q.t END, q.t < f.w + 14400 FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1) SELECT event_id, hit FROM f""")
def joi8_exact_cache(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.col("user_id") % 40).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return joins.exact_cache_asof(rows, "key", "ts", 14400, "event_id").select("event_id", "hit")


@query("""WITH w AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT event_id, (SELECT max(w.ts) FROM w WHERE w.user_id = r.user_id AND w.ts <= r.ts AND epoch(r.ts) - epoch(w.ts) < 36000) AS written_at FROM r""")
def joi8_written_asof(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    writes = rows.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"))
    return joins.written_asof(rows.where("event_type = 'click'").select("event_id", "user_id", "ts"), writes, "user_id", "ts", "at", 36000).select("event_id", F.col("written_at").cast("timestamp_ntz").alias("written_at"))


@query(f"""WITH RECURSIVE q AS MATERIALIZED ({_REQ}), f AS (SELECT key, i, event_id, t AS w, false AS hit FROM q WHERE i = 1 UNION ALL
SELECT q.key, q.i, q.event_id, CASE WHEN q.t < f.w + 14400 THEN f.w ELSE q.t END, q.t < f.w + 14400 FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1)
SELECT CASE WHEN event_id % 7 = 0 THEN 'bypass' WHEN hit THEN 'hit' WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN 'semantic_hit' ELSE 'miss' END AS status, count(*) AS n FROM f GROUP BY 1""")
def ret13_cache_path(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.col("user_id") % 40).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    told = joins.exact_cache_asof(rows, "key", "ts", 14400, "event_id")
    told = told.withColumns({"f": F.col("event_id") % 7 == 0, "h": F.col("event_id") % 5 == 0, "s": F.col("event_id") % 3 == 0})
    return told.groupBy(retrieval.cache_path("hit", "s", "f", "h").alias("status")).agg(F.count("*").alias("n"))


# windows, sorting, sessions


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def win4_top_n(spark, sf_dir):
    return retrieval.top_ranked(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_type, value, max(round(r / n, 6)) AS ecdf FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1, 2")
def win5_ecdf(spark, sf_dir):
    return stats.ecdf(events(spark, sf_dir).select("event_type", "value"), "value", ["event_type"]).groupBy("event_type", "value").agg(F.max("ecdf").alias("ecdf"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), m AS (SELECT DISTINCT event_type, i AS checkpoint FROM r WHERE i % 100 = 0) SELECT m.event_type, checkpoint, round(median(value), 4) AS median FROM m JOIN r ON r.event_type = m.event_type AND r.i <= checkpoint GROUP BY 1, 2")
def win6_running_median(spark, sf_dir):
    out = medians.running_median(events(spark, sf_dir), "value", ["event_type"], "event_id")
    return out.select("event_type", "checkpoint", "median")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3 AS warmup FROM events")
def win8_flag_warmup(spark, sf_dir):
    return stats.flag_warmup(events(spark, sf_dir), "user_id", "event_id").select("event_id", "warmup")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_type = 'click' AS s FROM events WHERE event_type IN ('click', 'purchase')),
p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e), i AS (SELECT *, sum(CASE WHEN s AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM p)
SELECT user_id, min(t) AS start_ms, coalesce(min(CASE WHEN NOT s THEN t END), max(t)) AS end_ms FROM i WHERE k > 0 GROUP BY user_id, k HAVING coalesce(min(CASE WHEN NOT s THEN t END), max(t)) - min(t) >= 250""")
def win9_speech_segments(spark, sf_dir):
    kind = F.col("event_type")
    out = stats.speech_segments(events(spark, sf_dir), "user_id", F.unix_millis(F.col("ts").cast("timestamp")), "event_id", kind == "click", kind == "purchase")
    return out.select("user_id", "start_ms", "end_ms")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def srt1_top_n(spark, sf_dir):
    return sample.top_n(table(spark, sf_dir, "orders"), "o_totalprice", 50, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("(SELECT event_id, value, 'best' AS which FROM events ORDER BY value, event_id LIMIT 5) UNION ALL (SELECT event_id, value, 'worst' FROM events ORDER BY value DESC, event_id LIMIT 5)")
def srt2_best_and_worst(spark, sf_dir):
    return sample.best_and_worst(events(spark, sf_dir).select("event_id", "value"), "value", 5, "event_id")


@query("SELECT event_id, value FROM events WHERE value < 10")
def srt3_gap_list(spark, sf_dir):
    return sample.gap_list(events(spark, sf_dir).select("event_id", "value"), "value", 10, "event_id")


@query("SELECT event_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 500")
def srt7_downsample(spark, sf_dir):
    return sample.downsample(events(spark, sf_dir).select("event_id", "value"), 500, "event_id")


@query("SELECT o.position, o.event_type, n FROM (VALUES (0, 'error'), (1, 'none'), (2, 'view')) o(position, event_type) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) g USING (event_type)")
def srt8_reindex(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return stats.reindex(counts, "event_type", ["error", "none", "view"]).select("position", "event_type", "n")


@query("SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 4) AS click, round(avg(value) FILTER (event_type = 'view'), 4) AS view FROM events GROUP BY 1 HAVING click IS NOT NULL AND view IS NOT NULL")
def set6_pivot_complete(spark, sf_dir):
    return reshape.pivot_complete(events(spark, sf_dir), "user_id", "event_type", ["click", "view"], "value")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM s GROUP BY user_id, k""")
def str2_sessions(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = ops.sessions(rows, "user_id", "ts", "6 hours")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events")
