"""Stateful streams on small events: repeats, disorder, late and missing events, cancelled jobs, batches side by side."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import stream_queries  # noqa: F401
from corpusloom.streaming import processors, run, state, windows

START = datetime(2024, 1, 1)
EVENT = "event_id long, job_id string, minutes int, event_type string, stage string"


def stream(spark, tmp_path, files, schema, *columns):
    """Each list of rows is one file, and so one micro-batch; minutes become the event time ts."""
    at = tmp_path / "in"
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(START.timestamp()) + F.col("minutes") * 60))
        df.coalesce(1).write.parquet(str(at / f"part{k}"))
        if k == 0:
            kind = df.schema
    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(len(files)):
        (next((at / f"part{k}").glob("*.parquet"))).rename(flat / f"{k:03d}.parquet")
        stamp = datetime.now().timestamp() + k
        import os

        os.utime(flat / f"{k:03d}.parquet", (stamp, stamp))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(flat))


def started(i, job, minute, stage):
    return (i, job, minute, "stage.started", stage)


def done(i, job, minute, stage):
    return (i, job, minute, "stage.completed", stage)


def test_job_watch_folds_disorder_and_repeats(spark, tmp_path):
    files = [
        [done(3, "a", 3, "extraction"), started(1, "a", 1, "extraction"), started(1, "a", 1, "extraction"), started(2, "b", 2, "extraction")],
        [started(4, "b", 4, "entities"), done(5, "a", 5, "inferences"), started(6, "a", 6, "entities")],
        [(7, "c", 7, "job_created", None), (8, "b", 8, "job_cancelled", None), started(9, "b", 9, "inferences")],
    ]
    out = run.update_result(processors.job_watch(stream(spark, tmp_path, files, EVENT), 10**12), "job_id")
    got = {r["job_id"]: (r["status"], r["step"], r["n_events"], r["steps"]) for r in out.collect()}
    assert got == {
        "a": ("completed", "inferences", 5, "entities:processing,extraction:completed,inferences:completed"),
        "b": ("cancelled", "entities", 4, "entities:processing,extraction:processing,inferences:processing"),
        "c": ("pending", None, 1, ""),
    }


def test_job_that_never_finishes_times_out(spark, tmp_path):
    files = [
        [started(1, "a", 0, "extraction"), done(2, "b", 1, "inferences"), started(9, "d", 0, "extraction")],
        [started(8, "d", 55, "entities")],
        [started(3, "c", 130, "extraction")],
        [started(4, "c", 131, "extraction"), started(10, "d", 100, "metadata")],
        [started(5, "c", 600, "extraction")],
        [started(6, "c", 601, "extraction")],
    ]
    out = run.update_result(processors.job_watch(stream(spark, tmp_path, files, EVENT), 3_600_000), "job_id")
    got = {r["job_id"]: (r["status"], r["error"], r["n_events"], r["steps"]) for r in out.collect()}
    late = "Job timeout after 3600 s"
    assert got == {
        "a": ("failed", late, 1, "extraction:processing"),
        "b": ("completed", None, 1, "inferences:completed"),
        "c": ("processing", None, 4, "extraction:processing"),
        "d": ("failed", late, 3, "entities:processing,extraction:processing,metadata:processing"),
    }


def test_completion_once_and_never_when_cancelled(spark, tmp_path):
    files = [
        [done(1, "a", 1, "x"), done(2, "b", 1, "x"), (3, "b", 2, "job_cancelled", None)],
        [done(4, "a", 3, "y"), done(4, "a", 3, "y"), done(5, "b", 3, "y")],
        [done(6, "a", 4, "y"), done(7, "c", 4, "y")],
    ]
    out = run.append_result(state.completions(stream(spark, tmp_path, files, EVENT), ["x", "y"])).collect()
    assert [(r["job_id"], r["n_steps"]) for r in out] == [("a", 2)]


def test_completion_forgets_old_jobs(spark, tmp_path):
    files = [[done(1, "a", 0, "x")], [done(2, "z", 300, "x")], [done(3, "z", 301, "x")], [done(4, "a", 302, "y")]]
    out = run.append_result(state.completions(stream(spark, tmp_path, files, EVENT), ["x", "y"], keep_ms=3_600_000)).collect()
    assert out == []


CHUNK = "job_id long, chunk int, expected int, minutes int"


@pytest.mark.parametrize("by", ["message", "job"])
def test_fan_in_counts_a_chunk_once(spark, tmp_path, by):
    files = [[(1, 0, 3, 0), (1, 0, 3, 0), (2, 70, 2, 0)], [(1, 1, 3, 1), (2, 1, 2, 1), (2, 1, 2, 1)], [(1, 2, 3, 2), (1, 2, 3, 2), (3, 0, 2, 2)], [(1, 1, 3, 3), (4, 0, 1, 3)]]
    s = stream(spark, tmp_path, files, CHUNK)
    created = F.timestamp_seconds(F.lit(START.timestamp()) + F.col("job_id"))
    out = run.append_result(processors.fan_in(s)) if by == "message" else run.update_result(state.fan_in(s.withColumn("created", created)), "job_id")
    assert sorted((r["job_id"], r["got"]) for r in out.collect()) == [(1, 3), (2, 2), (4, 1)]


@pytest.mark.parametrize(("by", "batches"), [("message", 15), ("job", 30)])
def test_fan_in_forgets(spark, tmp_path, by, batches):
    """Each batch has jobs that never end; the state stays as small as the last two hours."""
    rows = [[(k * 10 + j, c, 3, k * 30) for j in range(4) for c in range(2)] for k in range(batches)]
    chunks = stream(spark, tmp_path, rows, CHUNK)
    s = processors.fan_in(chunks, "2 hours") if by == "message" else state.fan_in(chunks.withColumnRenamed("ts", "created"), "2 hours")
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.numRecentProgressUpdates")}
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "400")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    at, seen = str(tmp_path / "check"), []
    q = s.writeStream.foreachBatch(lambda b, n: seen.append(b.count())).outputMode("append" if by == "message" else "update").option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    for k, v in kept.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)
    held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in q.recentProgress]
    assert len(held) >= batches and sum(seen) == 0
    assert max(held[10:]) <= max(held[:10]) < 200


def test_batches_side_by_side_count_a_job_once(spark, tmp_path):
    files = [
        [(1, 10, "completed", 2, 0), (2, 20, "failed", 2, 0), (1, 10, "completed", 2, 0)],
        [(2, 20, "failed", 2, 1), (1, 11, "pending", 2, 1)],
        [(1, 11, "failed", 2, 2), (2, 21, "completed", 2, 2), (2, 21, "completed", 2, 2)],
    ]
    s = stream(spark, tmp_path, files, "batch_id long, job_id long, status string, total int, minutes int")
    out = run.append_result(state.batch_done(s)).collect()
    assert sorted((r["batch_id"], r["completed"], r["failed"]) for r in out) == [(1, 1, 1), (2, 1, 1)]


def test_late_event_is_dropped_and_counted(spark, tmp_path):
    minutes = [[0], [300], [301], [1, 299], [900], [901]]  # 1 is late when it comes, 299 isn't
    ids = iter(range(1, 8))
    files = [[started(next(ids), "a", m, "x") for m in part] for part in minutes]
    out = run.append_result(windows.throughput(stream(spark, tmp_path, files, EVENT), "1 hour")).collect()
    hour = lambda t: round((t - START).total_seconds() / 3600)
    assert {hour(r["window_start"]): r["n"] for r in out} == {0: 1, 4: 1, 5: 2}
    table = spark.createDataFrame([r for f in files for r in f], EVENT).withColumn("ts", F.timestamp_seconds(F.lit(START.timestamp()) + F.col("minutes") * 60))
    assert [(r["event_type"], r["n"]) for r in windows.late_events(table).collect()] == [("stage.started", 1)]


def test_first_deliveries(spark, tmp_path):
    files = [[started(1, "a", 0, "x"), started(1, "a", 0, "x")], [started(1, "a", 0, "x"), started(2, "a", 5, "x")]]
    out = run.append_result(windows.first_deliveries(stream(spark, tmp_path, files, EVENT), ["event_id"])).collect()
    assert sorted(r["event_id"] for r in out) == [1, 2]


def test_alert_states(spark, tmp_path):
    """A rule needs its windows in a row; a late window or one judged before changes nothing; other rules are apart."""
    kinds = {"f": "stage.failed", "c": "stage.completed", "s": "stage.started"}
    hours = ["f", "ff", "c", "f", "", "f", "f", "fc", "f", "f", "c", "c"]
    events = [(k * 10 + i, "j", k * 60 + i, kinds[x], "x") for k, part in enumerate(hours) for i, x in enumerate(part)]
    files = [[e] for e in events]
    files.insert(9, [(900, "j", 61, "stage.completed", "x"), (901, "j", 120, "stage.failed", "x")])  # late: dropped
    rules = [processors.Rule("failures"), processors.Rule("quiet", "stage.started", "stage.completed", 0.5, 1)]
    out = run.append_result(processors.alert_states(stream(spark, tmp_path, files, EVENT), rules, "1 hour")).collect()
    got = {(r["rule"], round((r["window_us"] / 1e6 - START.timestamp()) / 3600)): r["state"] for r in out}
    assert len(got) == len(out)
    want = {0: "pending", 1: "firing", 2: "resolved", 3: "pending", 5: "pending", 6: "firing", 7: "resolved", 8: "pending", 9: "firing"}
    assert {k: v for (r, k), v in got.items() if r == "failures"} == want
    assert {v for (r, _), v in got.items() if r == "quiet"} == {"inactive"}
    table = spark.createDataFrame(events, EVENT).withColumn("ts", F.timestamp_seconds(F.lit(START.timestamp()) + F.col("minutes") * 60))
    batch = windows.alert_states(processors.rule_windows(table, rules, "1 hour"), {r.name: r.hold for r in rules}, "1 hour").collect()
    assert {tuple(r) for r in out} == {tuple(r) for r in batch if round((r["window_us"] / 1e6 - START.timestamp()) / 3600) <= 9}


MESSAGE = "id long, payload string, minutes int"


def test_messages_come_back_when_due(spark, tmp_path):
    """Work fails as often as the payload says: on time, late and for good; a work that raises is a failure."""
    files = [[(1, "0", 0), (2, "2", 0), (3, "9", 0)], [(4, "1", 1)], [(5, "0", 2)], [(6, "5", 60)], [(7, "0", 61)]]

    def work(payloads, attempt):
        if payloads == ["9"] and attempt == 0:
            raise ValueError("no answer")
        return [attempt >= int(p) for p in payloads]

    out = run.append_result(processors.delay_queue(stream(spark, tmp_path, files, MESSAGE), work, slots=3)).collect()
    start = int(START.timestamp())
    got = {}
    for r in out:
        got.setdefault(r["id"], []).append((r["attempt"], r["route"], r["at_us"] // 1_000_000 - start))
    got = {k: sorted(v, key=lambda x: (x[2], x[1] != "retry")) for k, v in got.items()}
    assert got == {
        1: [(0, "done", 0)],
        2: [(1, "retry", 1), (2, "retry", 3), (2, "done", 3)],
        3: [(1, "retry", 1), (2, "retry", 3), (3, "retry", 7), (3, "dead", 7)],
        4: [(1, "retry", 61), (1, "done", 61)],
        5: [(0, "done", 120)],
        6: [(1, "retry", 3601), (2, "retry", 3603), (3, "retry", 3607), (3, "dead", 3607)],
        7: [(0, "done", 3660)],
    }


def test_a_message_waits_for_its_time(spark, tmp_path):
    """Its retry isn't given before the watermark is there."""
    files = [[(1, "1", 0)], [(2, "0", 0)]]
    out = run.append_result(processors.delay_queue(stream(spark, tmp_path, files, MESSAGE), lambda p, a: [a >= int(x) for x in p], slots=2)).collect()
    assert [(r["id"], r["route"]) for r in out] == [(2, "done")]


def test_buffers_span_batches(spark, tmp_path):
    """Calls of three over micro-batches, in each slot of a queue; the rest leaves when it has waited; a call that fails gives nulls."""
    schema = "id long, text string, queue string, minutes int"
    files = [[(0, "a", "q", 0), (2, "b", "q", 0)], [(4, "c", "q", 1), (1, "x", "q", 1)], [(6, "d", "q", 2), (3, "y", "r", 2)], [(8, "e", "z", 30)], [(10, "f", "z", 31)]]
    calls = lambda texts: ["".join(texts)] * len(texts) if "y" not in texts else 1 / 0
    s = stream(spark, tmp_path, files, schema)
    out = run.append_result(processors.model_buffers(s, calls, ["queue"], most=3, wait="5 minutes", slots=2)).collect()
    got = {r["id"]: (r["reply"], r["n_batch"]) for r in out}
    assert got == {0: ("abc", 3), 2: ("abc", 3), 4: ("abc", 3), 1: ("x", 1), 3: (None, 1), 6: ("d", 1)}


def test_buffer_to_a_number_and_retry_times(spark):
    df = spark.createDataFrame([(k, f"q{k % 2}", "x") for k in range(11)], "id long, queue string, text string").repartition(3)
    got = run.buffered(df, lambda texts: [str(len(texts))] * len(texts), "text", ["queue"], ["id"], 4)
    assert sorted((r["queue"], r["reply"]) for r in got.collect()) == [("q0", "2")] * 2 + [("q0", "4")] * 4 + [("q1", "1")] + [("q1", "4")] * 4
    bad = run.buffered(df, lambda texts: 1 / 0, "text", ["queue"], ["id"], 4)
    assert {r["reply"] for r in bad.collect()} == {None}
    due = run.due_again(spark.sql("select timestamp'2024-01-01 00:00:00.5' as ts, 4L as delay"), "delay").selectExpr("due - ts = interval '4' second").first()[0]
    assert due


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from corpusloom.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default: default)
    sc = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=sc))


def test_calls_of_the_model_span_files(spark, tmp_path):
    """A table of several files is one micro-batch: a queue's calls don't end with a file."""
    from corpusloom.plans.registry import QUERIES

    docs = spark.createDataFrame([(k, "x" * k) for k in range(300)], "doc_id long, text string")
    for part in range(3):
        docs.filter(F.col("doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_chars"], r["n_batch"]) for r in QUERIES["micro_batch_model"](spark, str(tmp_path)).collect()}
    assert got == {k: (k, 32 if k // 4 < 64 else 11) for k in range(300)}


def most_state_rows(spark, tmp_path, s, mode):
    """The most state rows that a stream held after any batch."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    q = s.writeStream.foreachBatch(lambda b, n: b.count()).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    return max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in q.recentProgress)


def test_jobs_share_states(spark, tmp_path):
    """Many jobs cost as many calls and states as there are groups."""
    s = stream(spark, tmp_path, [[started(k, f"j{k}", 0, "x") for k in range(2000)]], EVENT)
    assert 0 < most_state_rows(spark, tmp_path, processors.job_watch(s), "update") <= state.SLOTS


def test_batches_share_states(spark, tmp_path):
    s = stream(spark, tmp_path, [[(k, k, "completed", 2, 0) for k in range(2000)]], "batch_id long, job_id long, status string, total int, minutes int")
    assert 0 < most_state_rows(spark, tmp_path, state.batch_done(s), "append") <= state.SLOTS


def test_waiting_messages_share_states(spark, tmp_path):
    s = stream(spark, tmp_path, [[(k, "2", k) for k in range(2000)]], MESSAGE)
    assert 0 < most_state_rows(spark, tmp_path, processors.delay_queue(s, lambda p, a: [a >= int(x) for x in p], slots=16), "append") <= 16
