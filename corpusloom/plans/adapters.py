"""How the given tables become the engine's own tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.entity import normalize_sql
from corpusloom.operators.chunking import chunk_fixed, chunk_overlap
from corpusloom.plans.registry import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_overlap(documents(spark, sf_dir))


CHUNKS = """
chunks AS (
  SELECT doc_id, i AS chunk_index, printf('chunk_%03d', i) AS chunk_id, substr(text, i * 1848 + 1, 2048) AS text, i * 1848 AS start_offset,
    least(length(text), i * 1848 + 2048) AS end_offset, length(substr(text, i * 1848 + 1, 2048)) // 4 AS token_count
  FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 200) / 1848.0)::BIGINT))) AS i FROM documents WHERE length(text) > 0))
"""


def pages_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text, alternate): pieces of 1500 characters as pages; every third page has an alternate text."""
    p = chunk_fixed(documents(spark, sf_dir))
    return p.select("doc_id", F.col("chunk_index").alias("page"), "text", F.when(F.col("chunk_index") % 3 == 0, F.concat(F.lit("ALT "), "text")).alias("alternate"))


PAGES = """
doc_pages AS (
  SELECT doc_id, i AS page, substr(text, i * 1500 + 1, 1500) AS text, CASE WHEN i % 3 = 0 THEN 'ALT ' || substr(text, i * 1500 + 1, 1500) END AS alternate
  FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 1500.0)::BIGINT))) AS i FROM documents WHERE length(text) > 0))
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given embeddings as cached vectors of each document's first chunk."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("chunk_000").alias("chunk_id"), "embedding")


KINDS = {"signup": "job_created", "click": "job_progress", "view": "stage.started", "purchase": "stage.completed", "error": "stage.failed"}
STAGE_LIST = ["extraction", "embeddings", "entities", "metadata", "inferences"]


def as_job_events(events: DataFrame) -> DataFrame:
    """events -> (event_id, job_id, ts, event_type, stage, value); also fits a stream."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    stage = F.element_at(F.array(*map(F.lit, STAGE_LIST)), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select(
        "event_id", F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce(F.try_element_at(kind, F.col("event_type")), F.col("event_type")).alias("event_type"), stage.alias("stage"), "value",
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_job_events(table(spark, sf_dir, "events"))


EVENTS = """
job_events AS (
  SELECT event_id, 'job-' || user_id AS job_id, ts,
    CASE event_type WHEN 'signup' THEN 'job_created' WHEN 'click' THEN 'job_progress' WHEN 'view' THEN 'stage.started'
      WHEN 'purchase' THEN 'stage.completed' WHEN 'error' THEN 'stage.failed' ELSE event_type END AS event_type,
    (['extraction', 'embeddings', 'entities', 'metadata', 'inferences'])[event_id % 5 + 1] AS stage, value
  FROM events)
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as jobs of a batch per customer."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("batch_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


JOBS = """
jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
    o_orderdate AS created_at FROM orders)
"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, step, status): the last state of each job and stage."""
    e = job_events(spark, sf_dir).filter("event_type in ('stage.started', 'stage.completed', 'stage.failed')")
    last = e.groupBy("job_id", "stage").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("t"))
    status = F.when(F.col("t") == "stage.started", "processing").when(F.col("t") == "stage.completed", "completed").otherwise("failed")
    return last.select("job_id", F.col("stage").alias("step"), status.alias("status"))


STEPS = (
    EVENTS
    + """,
steps AS (
  SELECT job_id, stage AS step, CASE arg_max(event_type, (ts, event_id)) WHEN 'stage.started' THEN 'processing' WHEN 'stage.completed' THEN 'completed' ELSE 'failed' END AS status
  FROM job_events WHERE event_type IN ('stage.started', 'stage.completed', 'stage.failed') GROUP BY job_id, stage)
"""
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_id, idx, text, confidence, words): the lines of each chunk as facts, with a confidence from a hash."""
    c = chunks(spark, sf_dir)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    words = F.size(F.filter(F.split("text", "[ \n]"), lambda x: x != "")).cast("long")
    f = c.select("doc_id", "chunk_id", words.alias("words"), F.posexplode(lines).alias("idx", "text"))
    confidence = (F.conv(F.substring(F.sha2("text", 256), 1, 4), 16, 10).cast("long") % 100) / 100.0
    return f.select("doc_id", "chunk_id", F.col("idx").cast("long").alias("idx"), "text", confidence.alias("confidence"), "words")


FACTS = (
    CHUNKS
    + """,
facts AS (
  SELECT doc_id, chunk_id, (i - 1)::BIGINT AS idx, lines[i] AS text, (('0x' || substr(sha256(lines[i]), 1, 4))::BIGINT % 100) / 100.0::DOUBLE AS confidence, words
  FROM (SELECT doc_id, chunk_id, lines, words, unnest(range(1, len(lines) + 1)) AS i FROM (
    SELECT doc_id, chunk_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 0) AS lines,
      len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> ''))::BIGINT AS words FROM chunks)))
"""
)


#: Labels that entities get in turn, and the letters by which every fifth name is written in another alphabet.
LABELS = ["ORG", "PER", "LOC", "ORG", "MISC"]
LATIN, CYRILLIC = "abcdefghijklmnoprstuvyz", "абцдефгхийклмнопрстувыз"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_id, label, text, confidence, start, end): capitalised words of a chunk of 7 letters or more as entities.

    The label follows the word's hash.  Every fifth word is written in Cyrillic letters and every seventh gets a mark,
    so that normal forms are more than lower case.
    """
    c = chunks(spark, sf_dir)
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}{6,}"), F.lit(0)))
    e = c.select("doc_id", "chunk_id", "start_offset", F.col("text").alias("body"), F.explode(found).alias("word"))
    share = lambda col: F.conv(F.substring(F.sha2(col, 256), 1, 4), 16, 10).cast("long")
    code = share(F.col("word"))
    start = F.col("start_offset") + F.instr("body", F.col("word")) - 1
    name = F.when(code % 5 == 0, F.translate("word", LATIN, CYRILLIC)).when(code % 7 == 0, F.concat("word", F.lit("’s"))).otherwise(F.col("word"))
    return e.select(
        "doc_id", "chunk_id", F.element_at(F.array(*map(F.lit, LABELS)), (code % 5 + 1).cast("int")).alias("label"), name.alias("text"),
        ((share(F.concat("chunk_id", "word")) % 100) / 100.0).alias("confidence"), start.cast("long").alias("start"), (start + F.length("word")).cast("long").alias("end"),
    )


ENTITIES = (
    CHUNKS
    + f""",
words AS (
  SELECT doc_id, chunk_id, start_offset, body, w, ('0x' || substr(sha256(w), 1, 4))::BIGINT AS code
  FROM (SELECT doc_id, chunk_id, start_offset, text AS body, unnest(list_distinct(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}{{6,}}'))) AS w FROM chunks)),
named AS (
  SELECT doc_id, chunk_id, {LABELS}[code % 5 + 1] AS label, CASE WHEN code % 5 = 0 THEN translate(w, '{LATIN}', '{CYRILLIC}') WHEN code % 7 = 0 THEN w || '’s' ELSE w END AS text,
    (('0x' || substr(sha256(chunk_id || w), 1, 4))::BIGINT % 100) / 100.0::DOUBLE AS confidence,
    (start_offset + instr(body, w) - 1)::BIGINT AS start, (start_offset + instr(body, w) - 1 + length(w))::BIGINT AS "end" FROM words),
entities AS (
  SELECT *, substr(sha256(label || ':' || norm), 1, 12) AS entity_id FROM (SELECT *, {normalize_sql("text")} AS norm FROM named))
"""
)
