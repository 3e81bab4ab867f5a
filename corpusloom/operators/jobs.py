"""Jobs, events and batches: admission, planning, status and completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ["extraction", "embeddings", "entities", "metadata", "inferences"]
#: Downstream stages by profile, steps and queues that a feature adds.
PROFILES = {"rag": ["embeddings", "inferences"], "full": ["embeddings", "entities", "metadata", "inferences"]}
FEATURE_STEPS = {"inferences": "inferences"}
FEATURES = ["inferences", "inference_embeddings"]
ENTRIES = ["extraction", "audio", "image"]
#: Admitted extensions by kind.
KINDS = {
    "audio": ["mp3", "wav", "m4a", "ogg"], "image": ["jpg", "jpeg", "png"], "spreadsheet": ["csv", "xls", "xlsx"],
    "document": ["pdf", "txt", "doc", "docx", "ppt", "pptx", "json"],
}
ENTRY_OF = {"audio": "audio", "image": "image", "spreadsheet": "extraction", "document": "extraction"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def route(name: Column) -> tuple[Column, Column]:
    """(kind, entry stage) by a file name's extension; null for others."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.try_element_at(_map({e: k for k, es in KINDS.items() for e in es}), ext)
    return kind, F.try_element_at(_map(ENTRY_OF), kind)


def normalize_profile(raw: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(low == "", "full").when(low.isin("rag", "full"), low)


def normalize_features(raw: Column) -> Column:
    """Known features, each once, in the order first seen."""
    low = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(low, lambda x: x.isin(FEATURES)))


def plan_steps(entry: Column, profile: Column, features: Column) -> tuple[Column, Column]:
    """(required steps, target queues); an unknown profile is full, an unknown entry gives null."""
    down = F.when(profile == "rag", F.array(*map(F.lit, PROFILES["rag"]))).otherwise(F.array(*map(F.lit, PROFILES["full"])))
    extra = F.transform(F.filter(features, lambda f: f.isin(list(FEATURE_STEPS))), lambda f: F.element_at(_map(FEATURE_STEPS), f))
    known = entry.isin(ENTRIES)
    steps = F.array_sort(F.array_union(F.array(entry), F.array_union(down, extra)))
    queues = F.array_except(F.array_union(down, extra), F.array(entry))
    return F.when(known, steps), F.when(known, queues)


def valid_job_id(job: Column) -> Column:
    return F.rlike(job, F.lit(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"))


def url_refusal(url: Column, most: int = 2048) -> Column:
    """Why a document URL is refused, or null. No name is looked up."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    part = lambda k: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int")
    private = (part(1) == 10) | ((part(1) == 172) & part(2).between(16, 31)) | ((part(1) == 192) & (part(2) == 168))
    return (
        F.when(url.isNull() | (url == ""), "missing")
        .when(F.length(url) > most, "too_long")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host == "", "no_host")
        .when(host.isin("localhost", "127.0.0.1", "[::1]") | F.coalesce(part(1) == 127, F.lit(False)), "loopback")
        .when(F.rlike(host, F.lit(r"(?:^|\.)(?:169\.254\.169\.254|metadata\.google\.internal|metadata)$")), "metadata")
        .when(F.coalesce(private, F.lit(False)), "private")
        .when(F.coalesce((part(1) == 169) & (part(2) == 254), F.lit(False)) | F.startswith(host, F.lit("[fe80:")), "link_local")
    )


def file_refusal(name: Column, size: Column, document_mb: int = 50, audio_mb: int = 100, sheet_bytes: int = 10 << 20) -> Column:
    """Why a file is refused, or null: size by kind, then extension, then the spreadsheet limit."""
    kind, _ = route(name)
    most = F.when(kind == "audio", audio_mb << 20).otherwise(document_mb << 20)
    return F.when(size > most, "file_too_large").when(kind.isNull(), "invalid_file_type").when((kind == "spreadsheet") & (size > sheet_bytes), "spreadsheet_too_large")


def latest(events: DataFrame, key: str = "job_id") -> DataFrame:
    """The last event of each job by (ts, event_id); one aggregate, no sort."""
    cols = [c for c in events.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(best.alias("x")).select(key, *[f"x.{c}" for c in cols])


def current_step(steps: DataFrame) -> DataFrame:
    """(job_id, step, status) -> the first step in processing, else the last completed."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("step"))
    return steps.groupBy("job_id").agg(
        F.coalesce(
            F.min_by(F.when(F.col("status") == "processing", F.col("step")), F.when(F.col("status") == "processing", order)),
            F.max_by(F.when(F.col("status") == "completed", F.col("step")), F.when(F.col("status") == "completed", order)),
        ).alias("current_step")
    )


def completed_jobs(steps: DataFrame, required: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Jobs whose required steps are all completed, without the cancelled ones."""
    done = steps.filter("status = 'completed'").groupBy("job_id").agg(F.collect_set("step").alias("done"))
    return required.join(done, "job_id").filter(F.size(F.array_except("required", "done")) == 0).join(cancelled, "job_id", "left_anti").select("job_id")


def batch_status(jobs: DataFrame) -> DataFrame:
    """(batch_id, job_id, status) -> counts and running / failed / partial / completed."""
    n = lambda s: F.count_if(F.col("status") == s)
    c = jobs.groupBy("batch_id").agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"))
    c = c.withColumn("pending", F.col("total") - F.col("completed") - F.col("failed"))
    state = F.when(F.col("pending") > 0, "running").when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    return c.withColumn("status", state)


def stage_timing(events: DataFrame) -> DataFrame:
    """(job_id, stage, event_type, ts, event_id) -> seconds from a start to the next completion of the same job and stage."""
    w = Window.partitionBy("job_id", "stage").orderBy("ts", "event_id")
    nxt = events.withColumn("next_type", F.lead("event_type").over(w)).withColumn("next_ts", F.lead("ts").over(w))
    seconds = F.greatest(F.lit(0.0), F.unix_micros("next_ts") / 1e6 - F.unix_micros("ts") / 1e6)
    return nxt.filter("event_type = 'stage.started' and next_type = 'stage.completed'").select("job_id", "stage", "event_id", seconds.alias("seconds"))
