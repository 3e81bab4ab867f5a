"""Assembly: chunks with their vectors, entity ids and facts; views, graph, artifacts and caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their embedding, an empty array where there is none."""
    j = chunks.join(vectors, ["doc_id", "chunk_id"], "left")
    return j.withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))


def chunk_entity_ids(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    ids = entities.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return chunks.join(ids, ["doc_id", "chunk_id"], "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


def chunk_inferences(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Chunks with their facts in order; of several deliveries of a fact the last one (`version`) wins."""
    last = facts.groupBy("doc_id", "chunk_id", "idx").agg(F.max_by(F.struct("text", "confidence"), "version").alias("f"))
    lists = last.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("idx", "f.text", "f.confidence"))).alias("inferences"))
    return chunks.join(lists, ["doc_id", "chunk_id"], "left")


def vector_mismatch(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, expected, actual) of chunks whose facts don't all have a vector."""
    j = facts.join(vectors.withColumn("_v", F.lit(1)), ["doc_id", "chunk_id", "idx"], "left")
    return j.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("expected"), F.count("_v").alias("actual")).filter("expected <> actual")


def cache_split(items: DataFrame, cache: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(hits with their vector, distinct misses): a cached vector of another size is a miss."""
    good = cache.filter(F.size("embedding") == dimension)
    hits = items.join(good, "key")
    misses = items.join(good, "key", "left_anti").dropDuplicates(["key"])
    return hits, misses


def embed_texts(items: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimension: int, batch: int = 32) -> DataFrame:
    """(key, text) -> key, embedding, degraded: the cache first, each missing text once, in batches.

    A batch that fails, and a vector of another size, is empty and degraded.
    """
    hits, misses = cache_split(items, cache, dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, made = part["text"].to_pylist(), []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                try:
                    made += embed(some)
                except Exception:
                    made += [[]] * len(some)
            good = [list(v) if len(v) == dimension else [] for v in made]
            yield pa.RecordBatch.from_arrays([part["key"], pa.array(good, pa.list_(pa.float32())), pa.array([not v for v in good])], names=["key", "embedding", "degraded"])

    fresh = misses.select("key", "text").mapInArrow(run, "key string, embedding array<float>, degraded boolean")
    return hits.select("key", "embedding", F.lit(False).alias("degraded")).dropDuplicates(["key"]).unionByName(fresh)


def embedding_status(parts: DataFrame) -> DataFrame:
    """(doc_id, degraded) rows -> (doc_id, n, n_degraded, status): a document none of whose parts got a vector has failed."""
    g = parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("degraded", F.lit(True))).alias("n_degraded"))
    status = F.when(F.col("n_degraded") == F.col("n"), "failed").when(F.col("n_degraded") > 0, "degraded").otherwise("ok")
    return g.withColumn("status", status)


def all_or_error(status: DataFrame) -> DataFrame:
    """status, whose failed documents raise an error where the rows are computed: total failure isn't a result."""
    message = F.concat(F.lit("no vector for any part of document "), F.col("doc_id").cast("string"))
    return status.withColumn("status", F.when(F.col("status") == "failed", F.raise_error(message).cast("string")).otherwise(F.col("status")))


def normalize_vector(v: Column, dimension: int) -> tuple[Column, Column]:
    """(unit vector, degraded): null, zero or of another size becomes empty and degraded."""
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    ok = F.coalesce((F.size(v) == dimension) & (norm > 0), F.lit(False))
    return F.when(ok, F.transform(v, lambda x: x / norm)).otherwise(F.array().cast("array<double>")), ~ok


def results_nested(docs: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """One record per document: metadata, ordered chunks, entities by id, and whether any chunk lacks its vector."""
    parts = chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "start_offset", "end_offset", "token_count", "embedding", "entity_ids"))).alias("chunks"),
        F.max((F.size("embedding") == 0).cast("int")).cast("boolean").alias("embeddings_degraded"),
    )
    known = entities.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_id", F.struct("label", "text", "confidence", "start", "end", "chunk_id"))))).alias("entities")
    )
    return docs.join(parts, "doc_id", "left").join(known, "doc_id", "left")


def write_results(results: DataFrame, path: str) -> None:
    """Idempotent: a rerun replaces the partitions that it writes."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(path)


def graph_nodes(docs: DataFrame, chunks: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, id, label, name)"""
    node = lambda df, i, label, name: df.select("doc_id", i.alias("id"), F.lit(label).alias("label"), name.alias("name"))
    fact_id = F.concat(F.lit("inf_"), F.col("chunk_id"), F.lit("_"), F.col("idx").cast("string"))
    return (
        node(docs, F.col("doc_id").cast("string"), "Document", F.col("source"))
        .unionByName(node(chunks, F.col("chunk_id"), "Chunk", F.col("token_count").cast("string")))
        .unionByName(node(entities, F.col("entity_id"), "Entity", F.col("text")))
        .unionByName(node(facts, fact_id, "Inference", F.col("text")))
    )


def graph_edges(chunks: DataFrame, mentions: DataFrame, facts: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, from, to, type)"""
    edge = lambda df, a, b, kind: df.select("doc_id", a.alias("from"), b.alias("to"), F.lit(kind).alias("type"))
    fact_id = F.concat(F.lit("inf_"), F.col("chunk_id"), F.lit("_"), F.col("idx").cast("string"))
    return (
        edge(chunks, F.col("doc_id").cast("string"), F.col("chunk_id"), "HAS_CHUNK")
        .unionByName(edge(mentions.select("doc_id", "chunk_id", "entity_id").distinct(), F.col("chunk_id"), F.col("entity_id"), "HAS_ENTITY"))
        .unionByName(edge(facts, F.col("chunk_id"), fact_id, "HAS_INFERENCE"))
        .unionByName(edge(refs, fact_id, F.col("entity_id"), "REFERS_TO"))
    )


def vectors_export(chunks: DataFrame, facts: DataFrame, fields: str = "", with_vectors: bool = True) -> DataFrame:
    """(doc_id, id, kind, embedding): `fields` picks chunks, inferences or, if blank, both."""
    wanted = {f.strip() for f in fields.split(",") if f.strip()} or {"chunks", "inferences"}
    v = F.col("embedding") if with_vectors else F.lit(None).cast("array<float>")
    out = []
    if "chunks" in wanted:
        out.append(chunks.select("doc_id", F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), v.alias("embedding")))
    if "inferences" in wanted:
        out.append(facts.select("doc_id", F.concat(F.lit("inf_"), F.col("chunk_id"), F.lit("_"), F.col("idx").cast("string")).alias("id"), F.lit("inference").alias("kind"), v.alias("embedding")))
    if not out:
        raise ValueError(f"unknown fields: {fields}")
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def page_slice(rows: DataFrame, order: list[str], page: int = 1, limit: int = 100) -> DataFrame:
    """Rows of one page per document; a page past the end is empty."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n").between((page - 1) * limit + 1, page * limit)).drop("_n")


def page_repair(pages: DataFrame, budget: int = 50) -> DataFrame:
    """(doc_id, page, text, alternate) -> (doc_id, text, n_replaced, n_degraded): a thin page is replaced by its alternate.

    The first `budget` thin pages of a document may be replaced, the rest are degraded; a blank alternate keeps the page.
    """
    from corpusloom.functions.text import page_decision

    thin = page_decision(F.col("text")) == "suspect"
    rank = F.sum(thin.cast("int")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    can = F.coalesce(F.trim("alternate") != "", F.lit(False))
    p = pages.withColumn("thin", thin).withColumn("within", rank <= budget).withColumn("replace", F.col("thin") & F.col("within") & can)
    p = p.withColumn("kept", F.coalesce(F.when(F.col("replace"), F.col("alternate")).otherwise(F.col("text")), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("page", "kept")))
    return p.groupBy("doc_id").agg(
        F.array_join(F.transform(parts, lambda x: x["kept"]), "\n\n").alias("text"), F.sum(F.col("replace").cast("long")).alias("n_replaced"),
        F.sum((F.col("thin") & ~F.col("within")).cast("long")).alias("n_degraded"),
    )


def facts_line(chunks: DataFrame) -> Column:
    """A passage as a prompt states it, with its id and number of facts."""
    budget = F.when(chunks["words"] < 200, 1).when(chunks["words"] < 500, 2).otherwise(3)
    return F.concat(F.lit("["), chunks["chunk_id"], F.lit("] max facts: "), budget.cast("string"), F.lit("\n"), chunks["text"])


def facts_prompt(chunks: DataFrame, group: int = 3) -> DataFrame:
    """(doc_id, group, prompt): passages in groups, each with its id and number of facts."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    g = chunks.select("doc_id", "chunk_index", F.floor(n / group).cast("long").alias("group"), facts_line(chunks).alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "line")))
    return g.groupBy("doc_id", "group").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n---\n").alias("prompt"))


def outermost_array(reply: str | None) -> str | None:
    """The outermost [...] of a model's reply, found by depth outside of strings; null if it never closes."""
    depth, start, quoted, skip = 0, -1, False, False
    for i, c in enumerate(reply or ""):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c == "[":
            if depth == 0:
                start = i
            depth += 1
        elif c == "]" and depth:
            depth -= 1
            if depth == 0:
                return reply[start : i + 1]
    return None


def facts_parse(replies: DataFrame, least: float | None = None) -> DataFrame:
    """(doc_id, chunk_id, reply) -> facts (doc_id, chunk_id, idx, text, confidence, entity_refs).

    Code fences and think blocks go; `entities` stands in for missing entity_refs; a missing confidence is 0.5.
    """

    @F.pandas_udf("string")
    def outermost(replies: pd.Series) -> pd.Series:
        return replies.map(outermost_array)

    clean = F.regexp_replace(F.regexp_replace("reply", r"(?s)<think>.*?</think>", ""), r"```[a-zA-Z]*", "")
    item = "array<struct<text:string,confidence:double,entity_refs:array<string>,entities:array<string>>>"
    p = replies.select("doc_id", "chunk_id", F.posexplode(F.from_json(outermost(clean), item)).alias("idx", "x")).filter("x.text is not null and trim(x.text) <> ''")
    out = p.select(
        "doc_id", "chunk_id", F.col("idx").cast("long").alias("idx"), F.col("x.text").alias("text"), F.coalesce("x.confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("x.entity_refs", "x.entities", F.array().cast("array<string>")).alias("entity_refs"),
    )
    return out if least is None else out.filter(F.col("confidence") >= least)


def ask_model(prompts: DataFrame, answer: Callable[[str], str], keep: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """(keep, prompt) -> keep, reply; a prompt that fails gets a null reply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            made = []
            for prompt in part["prompt"].to_pylist():
                try:
                    made.append(answer(prompt))
                except Exception:
                    made.append(None)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(made, pa.string())], names=[*keep, "reply"])

    schema = ", ".join(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in keep)
    return prompts.select(*keep, "prompt").mapInArrow(run, f"{schema}, reply string")


def ask_once(prompts: DataFrame, cache: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """(doc_id, chunk_id, key, prompt) and cached (key, reply) -> doc_id, chunk_id, reply, cached: each missing key is asked once."""
    known = cache.filter("reply is not null").select("key", "reply").dropDuplicates(["key"])
    misses = prompts.join(known, "key", "left_anti").select("key", "prompt").dropDuplicates(["key"])
    fresh = ask_model(misses, answer, ("key",))
    replies = known.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
    return prompts.join(replies, "key").select("doc_id", "chunk_id", "reply", "cached")


def ask_in_groups(chunks: DataFrame, answer: Callable[[str], str], group: int = 3) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, words, text) -> doc_id, chunk_id, reply, single: chunks are asked in groups.

    Every chunk of a group whose prompt fails is asked again by itself; chunk_id of a group's reply is that of its first chunk.
    """
    asked = ask_model(facts_prompt(chunks, group), answer, ("doc_id", "group"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    member = chunks.withColumn("group", F.floor(n / group).cast("long"))
    first = member.groupBy("doc_id", "group").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"))
    good = asked.filter("reply is not null").join(first, ["doc_id", "group"]).select("doc_id", "chunk_id", "reply", F.lit(False).alias("single"))
    again = member.join(asked.filter("reply is null").select("doc_id", "group"), ["doc_id", "group"])
    alone = ask_model(again.select("doc_id", "chunk_id", facts_line(again).alias("prompt")), answer)
    return good.unionByName(alone.withColumn("single", F.lit(True)))
