"""Queries over events, jobs, batches and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import jobs as J
from corpusloom.operators import metrics as M
from corpusloom.plans import adapters as A
from corpusloom.plans.registry import query, table
from corpusloom.plans.stream_queries import ALERTS, RULES
from corpusloom.streaming.processors import rule_windows
from corpusloom.streaming.windows import alert_states

_BATCH = f"""
WITH {A.JOBS}, c AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM jobs GROUP BY batch_id)
"""


@query("batch_status", _BATCH + "SELECT batch_id, total, completed, failed, pending, CASE WHEN pending > 0 THEN 'running' WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM c")
def batch_status(spark, d):
    return J.batch_status(A.jobs(spark, d))


@query("batch_final", f"WITH {A.JOBS} SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status <> 'completed') AS failed, string_agg(job_id::VARCHAR || ':' || CASE WHEN status = 'completed' THEN status ELSE 'failed' END, ',' ORDER BY job_id) AS members FROM jobs GROUP BY batch_id")
def batch_final(spark, d):
    final = F.when(F.col("status") == "completed", "completed").otherwise("failed")
    member = F.struct("job_id", F.concat(F.col("job_id").cast("string"), F.lit(":"), final).alias("m"))
    g = A.jobs(spark, d).groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") != "completed").alias("failed"), F.array_sort(F.collect_list(member)).alias("m")
    )
    return g.withColumn("members", F.array_join(F.col("m.m"), ",")).drop("m")


@query("batch_members", f"WITH {A.JOBS} SELECT batch_id, c_name AS batch_name, job_id, status FROM jobs JOIN customer ON c_custkey = batch_id")
def batch_members(spark, d):
    meta = table(spark, d, "customer").select(F.col("c_custkey").alias("batch_id"), F.col("c_name").alias("batch_name"))
    return A.jobs(spark, d).join(meta, "batch_id").select("batch_id", "batch_name", "job_id", "status")


_LINES = """
l AS (SELECT DISTINCT l_orderkey AS job_id, l_linenumber AS chunk FROM lineitem),
e AS (SELECT job_id, max(chunk)::BIGINT AS expected, count(*) AS got, string_agg(chunk::VARCHAR, ',' ORDER BY chunk) AS chunks FROM l GROUP BY job_id)
"""


def _chunk_results(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chunk")).distinct()


@query("inference_assembly", f"WITH {_LINES} SELECT job_id, expected, got, chunks FROM e WHERE got >= expected")
def inference_assembly(spark, d):
    g = _chunk_results(spark, d).groupBy("job_id").agg(F.max("chunk").cast("long").alias("expected"), F.count("*").alias("got"), F.array_sort(F.collect_list("chunk")).alias("c"))
    return g.filter("got >= expected").select("job_id", "expected", "got", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("chunks"))


@query("assembly_order", f"WITH {_LINES} SELECT job_id, chunk::BIGINT AS chunk, row_number() OVER (PARTITION BY job_id ORDER BY chunk) AS place FROM l")
def assembly_order(spark, d):
    from pyspark.sql import Window

    return _chunk_results(spark, d).select("job_id", F.col("chunk").cast("long").alias("chunk"), F.row_number().over(Window.partitionBy("job_id").orderBy("chunk")).cast("long").alias("place"))


@query("stage_progress", f"WITH {_LINES} SELECT job_id, got AS done, expected AS total, (60 + (19 * got) // greatest(expected, 1))::BIGINT AS percent FROM e")
def stage_progress(spark, d):
    g = _chunk_results(spark, d).groupBy("job_id").agg(F.count("*").alias("done"), F.max("chunk").cast("long").alias("total"))
    return g.withColumn("percent", (F.lit(60) + F.floor(F.lit(19) * F.col("done") / F.greatest("total", F.lit(1)))).cast("long"))


@query("status_counters", f"WITH {A.EVENTS} SELECT event_type, stage, count(*) AS n FROM job_events GROUP BY ALL")
def status_counters(spark, d):
    return A.job_events(spark, d).groupBy("event_type", "stage").agg(F.count("*").alias("n"))


_HIST = f"""
WITH {A.EVENTS}, b AS (SELECT unnest([5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 'Infinity'::DOUBLE]) AS le),
h AS (SELECT stage, le, count(*) FILTER (value <= le) AS "count" FROM job_events, b WHERE value IS NOT NULL GROUP BY stage, le)
"""


@query("histogram_buckets", _HIST + """SELECT stage, le, "count" FROM h""")
def histogram_buckets(spark, d):
    return M.histogram(A.job_events(spark, d), "value", "stage")


@query("histogram_quantile", _HIST + """,
q AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag("count") OVER w, 0) AS below, max("count") OVER (PARTITION BY stage) AS total FROM h WINDOW w AS (PARTITION BY stage ORDER BY le))
SELECT stage, arg_min(CASE WHEN le = 'Infinity' THEN low ELSE low + (le - low) * CASE WHEN "count" > below THEN (0.95::DOUBLE * total - below) / ("count" - below) ELSE 1 END END, le) AS quantile
FROM q WHERE total > 0 AND "count" >= 0.95::DOUBLE * total AND (below < 0.95::DOUBLE * total OR below = 0) GROUP BY stage""")  # fmt: skip
def histogram_quantile(spark, d):
    return M.histogram_quantile(M.histogram(A.job_events(spark, d), "value", "stage"), 0.95, "stage")


@query("latency_report", f"""
WITH {A.EVENTS}, v AS (SELECT stage, list_sort(list(round(value, 3))) AS v, count(*) AS n, quantile_cont(round(value, 3), 0.5) AS p50, quantile_cont(round(value, 3), 0.95) AS p95 FROM job_events GROUP BY stage)
SELECT stage, n, p50, p95, v[greatest(1, floor(0.95::DOUBLE * n)::BIGINT)] AS p95_index FROM v""")  # fmt: skip
def latency_report(spark, d):
    return M.latency_report(A.job_events(spark, d).withColumn("value", F.round("value", 3)), "value", "stage").drop("total")


@query("cache_ratio", """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'vector' END AS cache, count(vec_id) AS hits, count(*) - count(vec_id) AS misses, count(vec_id) / count(*)::DOUBLE AS ratio
FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = doc_id GROUP BY 1""")  # fmt: skip
def cache_ratio(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")).distinct().withColumn("hit", F.lit(1))
    j = A.documents(spark, d).select("doc_id").join(v, "doc_id", "left")
    g = j.groupBy(F.when(F.col("doc_id") % 2 == 0, "text").otherwise("vector").alias("cache")).agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    return g.select("cache", "hits", (F.col("n") - F.col("hits")).alias("misses"), (F.col("hits") / F.col("n")).alias("ratio"))


@query("current_step", f"""
WITH {A.STEPS}, o AS (SELECT *, list_position(['extraction', 'embeddings', 'entities', 'metadata', 'inferences'], step) AS k FROM steps)
SELECT job_id, coalesce(arg_min(step, k) FILTER (status = 'processing'), arg_max(step, k) FILTER (status = 'completed')) AS current_step FROM o GROUP BY job_id""")  # fmt: skip
def current_step(spark, d):
    return J.current_step(A.steps(spark, d))


@query("latest_status", f"WITH {A.EVENTS} SELECT job_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(stage, (ts, event_id)) AS stage, max((ts, event_id))[2] AS event_id FROM job_events GROUP BY job_id")
def latest_status(spark, d):
    return J.latest(A.job_events(spark, d)).select("job_id", "event_type", "stage", "event_id")


@query("stage_timing", f"""
WITH {A.EVENTS}, n AS (SELECT *, lead(event_type) OVER w AS next_type, lead(ts) OVER w AS next_ts FROM job_events WINDOW w AS (PARTITION BY job_id, stage ORDER BY ts, event_id))
SELECT job_id, stage, event_id, greatest(0.0, epoch_us(next_ts) / 1e6::DOUBLE - epoch_us(ts) / 1e6::DOUBLE) AS seconds FROM n WHERE event_type = 'stage.started' AND next_type = 'stage.completed'""")  # fmt: skip
def stage_timing(spark, d):
    return J.stage_timing(A.job_events(spark, d))


@query("counter_rate", f"""
WITH {A.EVENTS}, s AS (SELECT stage AS name, (epoch_us(ts) // 1000000)::BIGINT AS t, (event_id % 100)::DOUBLE AS value FROM job_events WHERE event_type = 'job_progress'),
x AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS delta FROM s WINDOW w AS (PARTITION BY name ORDER BY t, value))
SELECT name, t, value, sum(delta) OVER r AS increase, sum(delta) OVER r / 86400 AS rate FROM x WINDOW r AS (PARTITION BY name ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def counter_rate(spark, d):
    e = A.job_events(spark, d).filter("event_type = 'job_progress'")
    s = e.select(F.col("stage").alias("name"), F.floor(F.unix_micros("ts") / 1000000).cast("long").alias("t"), (F.col("event_id") % 100).cast("double").alias("value"))
    return M.counter_rate(s, 86400)


@query("queue_backlog", f"""
WITH {A.EVENTS}, c AS (SELECT stage AS queue, event_id, ts, CASE event_type WHEN 'stage.started' THEN 1 WHEN 'stage.completed' THEN -1 END AS change FROM job_events WHERE event_type IN ('stage.started', 'stage.completed'))
SELECT queue, event_id, sum(change) OVER w::BIGINT AS depth, sum(change) OVER w > 20 AS saturated FROM c WINDOW w AS (PARTITION BY queue ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def queue_backlog(spark, d):
    change = F.when(F.col("event_type") == "stage.started", 1).when(F.col("event_type") == "stage.completed", -1)
    e = A.job_events(spark, d).select(F.col("stage").alias("queue"), F.col("ts").alias("t"), "event_id", change.alias("change")).filter("change is not null")
    return M.backlog(e, 20)


@query("time_to_text", f"""
WITH {A.EVENTS}, f AS (SELECT job_id, min(ts) FILTER (event_type = 'job_created') AS c, min(ts) FILTER (event_type = 'stage.completed' AND stage = 'extraction') AS x, max(ts) FILTER (event_type = 'stage.completed') AS z FROM job_events GROUP BY job_id)
SELECT job_id, epoch_us(x) / 1e6::DOUBLE - epoch_us(c) / 1e6::DOUBLE AS to_text, epoch_us(z) / 1e6::DOUBLE - epoch_us(c) / 1e6::DOUBLE AS to_end FROM f""")  # fmt: skip
def time_to_text(spark, d):
    done = F.col("event_type") == "stage.completed"
    f = A.job_events(spark, d).groupBy("job_id").agg(
        F.min(F.when(F.col("event_type") == "job_created", F.col("ts"))).alias("c"), F.min(F.when(done & (F.col("stage") == "extraction"), F.col("ts"))).alias("x"), F.max(F.when(done, F.col("ts"))).alias("z")
    )
    seconds = lambda c: F.unix_micros(c) / 1e6
    return f.select("job_id", (seconds("x") - seconds("c")).alias("to_text"), (seconds("z") - seconds("c")).alias("to_end"))


@query("completed_jobs", f"""
WITH {A.STEPS}, n AS (SELECT job_id, CASE WHEN regexp_extract(job_id, '\\d+')::BIGINT % 2 = 0 THEN ['extraction', 'embeddings'] ELSE ['extraction', 'metadata', 'inferences'] END AS required FROM job_events GROUP BY job_id),
done AS (SELECT job_id, list(step) AS done FROM steps WHERE status = 'completed' GROUP BY job_id),
c AS (SELECT DISTINCT job_id FROM job_events WHERE event_type = 'stage.failed' AND value > 90)
SELECT job_id FROM n JOIN done USING (job_id) WHERE list_has_all(done, required) AND job_id NOT IN (SELECT job_id FROM c)""")  # fmt: skip
def completed_jobs(spark, d):
    e = A.job_events(spark, d)
    even = F.regexp_extract("job_id", r"\d+", 0).cast("long") % 2 == 0
    lists = F.when(even, F.array(F.lit("extraction"), F.lit("embeddings"))).otherwise(F.array(F.lit("extraction"), F.lit("metadata"), F.lit("inferences")))
    required = e.select("job_id").distinct().withColumn("required", lists)
    cancelled = e.filter("event_type = 'stage.failed' and value > 90").select("job_id").distinct()
    return J.completed_jobs(A.steps(spark, d), required, cancelled)


@query("stuck_jobs", f"WITH {A.JOBS} SELECT job_id, 'Job timeout after ' || date_diff('day', created_at, (SELECT max(created_at) FROM jobs)) || ' days' AS error FROM jobs WHERE status = 'pending' AND created_at < (SELECT max(created_at) FROM jobs) - INTERVAL 365 DAY")
def stuck_jobs(spark, d):
    j = A.jobs(spark, d)
    now = j.agg(F.max("created_at").alias("now"))  # one row
    old = j.filter("status = 'pending'").join(F.broadcast(now), F.col("created_at") < F.col("now") - F.expr("INTERVAL 365 DAYS"))
    return old.select("job_id", F.concat(F.lit("Job timeout after "), F.datediff("now", "created_at").cast("string"), F.lit(" days")).alias("error"))


@query("alert_rules", ALERTS)
def alert_rules(spark, d):
    w = rule_windows(A.job_events(spark, d), RULES, "6 hours")
    return alert_states(w, {r.name: r.hold for r in RULES}, "6 hours")
