"""Queries over chunks, vectors, facts, entities and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import entity as E
from corpusloom.operators import chunking as C
from corpusloom.operators import entities as N
from corpusloom.operators import results as R
from corpusloom.plans import adapters as A
from corpusloom.plans.registry import query, table
from corpusloom.sources.artifacts import ArtifactStore

_VEC = "v AS (SELECT vec_id AS doc_id, 'chunk_000' AS chunk_id, embedding FROM embeddings)"


@query("chunks_vectors", f"WITH {A.CHUNKS}, {_VEC} SELECT c.doc_id, c.chunk_id, coalesce(len(embedding), 0)::BIGINT AS dimension FROM chunks c LEFT JOIN v USING (doc_id, chunk_id)")
def chunks_vectors(spark, d):
    return R.chunks_vectors(A.chunks(spark, d), A.vectors(spark, d)).select("doc_id", "chunk_id", F.size("embedding").cast("long").alias("dimension"))


def _with_ids(spark, d):
    return A.entities(spark, d).withColumn("entity_id", E.entity_id(F.col("label"), F.col("text")))


#: Entities of a document, each once, in the chunk of its best mention.
_KNOWN = """known AS (SELECT doc_id, entity_id, arg_max(chunk_id, (confidence, -start, -"end", sha256(text), chunk_id)) AS chunk_id FROM entities GROUP BY doc_id, entity_id)"""


@query("chunk_entity_ids", f"WITH {A.ENTITIES}, {_KNOWN} SELECT c.doc_id, c.chunk_id, coalesce(string_agg(entity_id, ',' ORDER BY entity_id), '') AS entity_ids FROM chunks c LEFT JOIN known k USING (doc_id, chunk_id) GROUP BY ALL")
def chunk_entity_ids(spark, d):
    """Ids by chunk, of entities that are equal in normal form counted once."""
    return R.chunk_entity_ids(A.chunks(spark, d), N.dedupe_exact(A.entities(spark, d))).select("doc_id", "chunk_id", F.array_join("entity_ids", ",").alias("entity_ids"))


@query("chunk_entity_ids_fuzzy")
def chunk_entity_ids_fuzzy(spark, d):
    """Ids by chunk, of entities that are similar counted once."""
    return R.chunk_entity_ids(A.chunks(spark, d), N.dedupe_fuzzy(A.entities(spark, d))).select("doc_id", "chunk_id", F.array_join("entity_ids", ",").alias("entity_ids"))


@query("chunk_inferences", f"WITH {A.FACTS} SELECT c.doc_id, c.chunk_id, string_agg(f.text, '|' ORDER BY idx) AS facts, count(f.idx) AS n FROM chunks c LEFT JOIN facts f USING (doc_id, chunk_id) GROUP BY ALL")
def chunk_inferences(spark, d):
    f = A.facts(spark, d)
    again = f.withColumn("text", F.lit("stale")).withColumn("version", F.lit(0)).unionByName(f.withColumn("version", F.lit(1)))
    j = R.chunk_inferences(A.chunks(spark, d).select("doc_id", "chunk_id"), again)
    texts = F.transform("inferences", lambda x: x["text"])
    return j.select("doc_id", "chunk_id", F.array_join(texts, "|").alias("facts"), F.coalesce(F.size("inferences"), F.lit(0)).cast("long").alias("n"))


@query("inference_vectors", f"WITH {A.FACTS} SELECT doc_id, chunk_id, count(*) AS expected, count(*) FILTER (idx % 3 <> 2) AS actual FROM facts GROUP BY ALL HAVING count(*) <> count(*) FILTER (idx % 3 <> 2)")
def inference_vectors(spark, d):
    f = A.facts(spark, d)
    return R.vector_mismatch(f, f.filter("idx % 3 <> 2").select("doc_id", "chunk_id", "idx"))


@query("cache_split", f"""
WITH {A.CHUNKS}, k AS (SELECT doc_id, chunk_id, text, sha256(text) AS key FROM chunks),
cache AS (SELECT DISTINCT key FROM k JOIN embeddings ON vec_id = doc_id WHERE chunk_id = 'chunk_000' AND doc_id % 5 <> 0)
SELECT 'hit' AS kind, count(*) AS n FROM k WHERE key IN (SELECT key FROM cache) UNION ALL SELECT 'miss', count(DISTINCT key) FROM k WHERE key NOT IN (SELECT key FROM cache)""")  # fmt: skip
def cache_split(spark, d):
    k = A.chunks(spark, d).select("doc_id", "chunk_id", "text").withColumn("key", F.sha2("text", 256))
    cached = k.join(A.vectors(spark, d), ["doc_id", "chunk_id"])
    size = F.when(F.col("doc_id") % 5 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    cache = cached.select("key", size.alias("embedding")).filter(F.size("embedding") == 64).dropDuplicates(["key"]).unionByName(cached.filter("doc_id % 5 = 0").select("key", size.alias("embedding")))
    hits, misses = R.cache_split(k, cache, 64)
    return hits.agg(F.count("*").alias("n")).select(F.lit("hit").alias("kind"), "n").unionByName(misses.agg(F.count("*").alias("n")).select(F.lit("miss").alias("kind"), "n"))


def _length_vectors(texts):
    """An embedding for the plug point that SQL can state: the text's length 64 times, and a vector too short for lengths that 7 divides."""
    return [[float(len(t))] * (63 if len(t) % 7 == 0 else 64) for t in texts]


_KEYED = f"""
WITH {A.CHUNKS}, {_VEC}, k AS (SELECT c.*, sha256(text) AS key FROM chunks c),
cached AS (SELECT DISTINCT key FROM k JOIN v USING (doc_id, chunk_id) WHERE len(embedding) = 64),
made AS (SELECT k.key, any_value(length(text)) AS n, bool_or(cached.key IS NOT NULL) AS hit FROM k LEFT JOIN cached USING (key) GROUP BY k.key)
"""


@query("embed_chunks", _KEYED + "SELECT key, CASE WHEN hit OR n % 7 <> 0 THEN 64 ELSE 0 END::BIGINT AS dimension, NOT hit AND n % 7 = 0 AS degraded FROM made")
def embed_chunks(spark, d):
    k = A.chunks(spark, d).select("doc_id", "chunk_id", "text").withColumn("key", F.sha2("text", 256))
    cache = k.join(A.vectors(spark, d), ["doc_id", "chunk_id"]).select("key", "embedding").dropDuplicates(["key"])
    return R.embed_texts(k, cache, _length_vectors, 64).select("key", F.size("embedding").cast("long").alias("dimension"), "degraded")


@query("embed_inferences", f"""
WITH {A.FACTS} SELECT doc_id, count(*) AS n, count(*) FILTER (length(text) % 7 = 0) AS n_degraded,
CASE WHEN count(*) = count(*) FILTER (length(text) % 7 = 0) THEN 'failed' WHEN count(*) FILTER (length(text) % 7 = 0) > 0 THEN 'degraded' ELSE 'ok' END AS status FROM facts GROUP BY doc_id""")  # fmt: skip
def embed_inferences(spark, d):
    k = A.facts(spark, d).select("doc_id", "text").withColumn("key", F.sha2("text", 256))
    none = A.vectors(spark, d).select(F.lit("").alias("key"), "embedding").filter("false")
    made = R.embed_texts(k, none, _length_vectors, 64).select("key", "degraded")
    return R.embedding_status(k.join(made, "key", "left"))


@query("vector_normalize", """
WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE len(embedding) END::BIGINT AS dimension, vec_id % 4 = 0 AS degraded, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE round(embedding[1]::DOUBLE / norm, 6) END AS first FROM n""")  # fmt: skip
def vector_normalize(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 != 0, F.col("embedding")).alias("embedding"))
    unit, degraded = R.normalize_vector(F.col("embedding"), 64)
    return v.select("vec_id", unit.alias("u"), degraded.alias("degraded")).select("vec_id", F.size("u").cast("long").alias("dimension"), "degraded", F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query("fact_confidence", f"WITH {A.FACTS} SELECT doc_id, chunk_id, idx, CASE WHEN idx % 5 = 4 THEN 0.5 ELSE confidence END AS confidence FROM facts WHERE CASE WHEN idx % 5 = 4 THEN 0.5 ELSE confidence END >= 0.7")
def fact_confidence(spark, d):
    f = A.facts(spark, d).withColumn("confidence", F.coalesce(F.when(F.col("idx") % 5 != 4, F.col("confidence")), F.lit(0.5)))
    return f.filter("confidence >= 0.7").select("doc_id", "chunk_id", "idx", "confidence")


@query("facts_budget", f"""
WITH {A.FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY confidence DESC, idx) AS rank FROM facts)
SELECT doc_id, chunk_id, idx, rank, confidence FROM r WHERE rank <= CASE WHEN words < 200 THEN 1 WHEN words < 500 THEN 2 ELSE 3 END""")  # fmt: skip
def facts_budget(spark, d):
    return N.facts_budget(A.facts(spark, d)).select("doc_id", "chunk_id", "idx", "rank", "confidence")


@query("inference_ids", f"WITH {A.FACTS} SELECT doc_id, 'inf_' || chunk_id || '_' || idx AS id, text FROM facts")
def inference_ids(spark, d):
    return A.facts(spark, d).select("doc_id", F.concat(F.lit("inf_"), F.col("chunk_id"), F.lit("_"), F.col("idx").cast("string")).alias("id"), "text")


@query("chunk_ids", f"WITH {A.CHUNKS} SELECT doc_id, chunk_index, printf('chunk_%03d', row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1) AS chunk_id FROM chunks")
def chunk_ids(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    return A.chunks(spark, d).select("doc_id", "chunk_index", F.format_string("chunk_%03d", n).alias("chunk_id"))


@query("page_slice", f"WITH {A.CHUNKS} SELECT doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS n FROM chunks) WHERE n BETWEEN 3 AND 4")
def page_slice(spark, d):
    return R.page_slice(A.chunks(spark, d), ["chunk_index"], page=2, limit=2).select("doc_id", "chunk_id")


@query("results_summary", f"""
WITH {A.FACTS}, {A.ENTITIES.replace(A.CHUNKS + ",", "").strip()},
c AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1), f AS (SELECT doc_id, count(*) AS n_facts FROM facts GROUP BY 1), e AS (SELECT doc_id, count(DISTINCT entity_id) AS n_entities FROM entities GROUP BY 1)
SELECT d.doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_entities, 0) AS n_entities, coalesce(n_facts, 0) AS n_facts FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN f USING (doc_id)""")  # fmt: skip
def results_summary(spark, d):
    c = A.chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    e = _with_ids(spark, d).groupBy("doc_id").agg(F.countDistinct("entity_id").alias("n_entities"))
    f = A.facts(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_facts"))
    return A.documents(spark, d).select("doc_id").join(c, "doc_id", "left").join(e, "doc_id", "left").join(f, "doc_id", "left").fillna(0)


@query("results_nested", f"""
WITH {A.ENTITIES}, {_VEC}, c AS (SELECT c.doc_id, count(*) AS n_chunks, bool_or(v.doc_id IS NULL) AS degraded, string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids FROM chunks c LEFT JOIN v USING (doc_id, chunk_id) GROUP BY 1),
e AS (SELECT doc_id, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS entity_ids FROM entities GROUP BY 1)
SELECT d.doc_id, lang, coalesce(n_chunks, -1)::BIGINT AS n_chunks, degraded, chunk_ids, entity_ids FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)""")  # fmt: skip
def results_nested(spark, d):
    known = N.dedupe_exact(A.entities(spark, d))
    full = R.chunk_entity_ids(R.chunks_vectors(A.chunks(spark, d).drop("text"), A.vectors(spark, d)), known)
    r = R.results_nested(A.documents(spark, d).drop("text"), full, known)
    return r.select(
        "doc_id", "lang", F.coalesce(F.size("chunks"), F.lit(-1)).cast("long").alias("n_chunks"), F.col("embeddings_degraded").alias("degraded"),
        F.array_join(F.col("chunks.chunk_id"), ",").alias("chunk_ids"), F.array_join(F.array_sort(F.map_keys("entities")), ",").alias("entity_ids"),
    )


_CEF = f"WITH {A.FACTS}, {A.ENTITIES.replace(A.CHUNKS + ',', '').strip()}"


@query("graph_nodes", _CEF + """
SELECT doc_id, doc_id::VARCHAR AS id, 'Document' AS label, source AS name FROM documents UNION ALL SELECT doc_id, chunk_id, 'Chunk', token_count::VARCHAR FROM chunks
UNION ALL SELECT doc_id, entity_id, 'Entity', arg_max(text, (confidence, -start, -"end", sha256(text))) FROM entities GROUP BY doc_id, entity_id UNION ALL SELECT doc_id, 'inf_' || chunk_id || '_' || idx, 'Inference', text FROM facts""")  # fmt: skip
def graph_nodes(spark, d):
    return R.graph_nodes(A.documents(spark, d), A.chunks(spark, d), N.dedupe_exact(A.entities(spark, d)), A.facts(spark, d))


@query("graph_edges", f"{_CEF}, {_KNOWN}" + """
SELECT doc_id, doc_id::VARCHAR AS "from", chunk_id AS "to", 'HAS_CHUNK' AS type FROM chunks UNION ALL SELECT doc_id, chunk_id, entity_id, 'HAS_ENTITY' FROM known
UNION ALL SELECT doc_id, chunk_id, 'inf_' || chunk_id || '_' || idx, 'HAS_INFERENCE' FROM facts
UNION ALL SELECT f.doc_id, 'inf_' || f.chunk_id || '_' || idx, e.entity_id, 'REFERS_TO' FROM (SELECT *, """ + E.normalize_sql("word") + """ AS ref FROM (SELECT *, unnest(regexp_extract_all(text, '\\p{Lu}\\p{Ll}{6,}')) AS word FROM facts)) f JOIN (SELECT doc_id, norm, min(entity_id) AS entity_id FROM entities WHERE norm <> '' GROUP BY ALL) e ON f.doc_id = e.doc_id AND f.ref = e.norm""")  # fmt: skip
def graph_edges(spark, d):
    ents, f = N.dedupe_exact(A.entities(spark, d)), A.facts(spark, d)
    refs = N.resolve_exact(_refs(spark, d), ents).filter("entity_id is not null")
    return R.graph_edges(A.chunks(spark, d), ents, f, refs)


@query("vectors_export", f"WITH {A.FACTS}, {_VEC} SELECT c.doc_id, c.chunk_id AS id, 'chunk' AS kind, coalesce(len(embedding), 0)::BIGINT AS dimension FROM chunks c LEFT JOIN v USING (doc_id, chunk_id) UNION ALL SELECT doc_id, 'inf_' || chunk_id || '_' || idx, 'inference', 0 FROM facts")
def vectors_export(spark, d):
    f = A.facts(spark, d).withColumn("embedding", F.array().cast("array<float>"))
    out = R.vectors_export(R.chunks_vectors(A.chunks(spark, d), A.vectors(spark, d)), f, " ")
    return out.select("doc_id", "id", "kind", F.size("embedding").cast("long").alias("dimension"))


@query("entities_flat", f"""WITH {A.ENTITIES} SELECT doc_id, entity_id, arg_max(text, (confidence, -start, -"end", sha256(text))) AS text, max(confidence) AS confidence FROM entities GROUP BY doc_id, entity_id""")
def entities_flat(spark, d):
    return N.dedupe_exact(A.entities(spark, d)).select("doc_id", "entity_id", "text", "confidence")


@query("inferences_flat", f"WITH {A.FACTS} SELECT c.doc_id, c.chunk_id, idx, f.text FROM chunks c LEFT JOIN facts f USING (doc_id, chunk_id)")
def inferences_flat(spark, d):
    lists = A.facts(spark, d).groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("f"))
    j = A.chunks(spark, d).select("doc_id", "chunk_id").join(lists, ["doc_id", "chunk_id"], "left")
    return j.select("doc_id", "chunk_id", F.explode_outer("f").alias("x")).select("doc_id", "chunk_id", "x.idx", "x.text")


_ART = "a AS (SELECT DISTINCT sha256(text) AS sha256, text AS payload FROM documents)"


def _stored(spark, d):
    """A store of all texts; a text's age is its least doc_id."""
    store = ArtifactStore(spark)
    store.put(A.documents(spark, d).select(F.col("text").alias("payload"), F.col("doc_id").alias("age")))
    return store


@query("artifact_put", "SELECT sha256(text) AS sha256, strlen(text)::BIGINT AS size, min(CASE lang WHEN 'en' THEN 0 ELSE 1 END)::BIGINT AS age FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def artifact_put(spark, d):
    """English texts first, then all: what is there stays as it is."""
    store = ArtifactStore(spark)
    docs = A.documents(spark, d).select(F.col("text").alias("payload"), "lang")
    store.put(docs.filter("lang = 'en'").select("payload", F.lit(0).alias("age")))
    store.put(docs.select("payload", F.lit(1).alias("age")))
    return store.table().select("sha256", "size", "age")


def _values(spark, d):
    ref = F.concat(F.lit("sha256:"), F.sha2("text", 256))
    return A.documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(ref).alias("value"))


@query("artifact_resolve", f"WITH {_ART} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE payload END AS resolved FROM documents LEFT JOIN a ON sha256 = sha256(text)")
def artifact_resolve(spark, d):
    return _stored(spark, d).resolve(_values(spark, d)).select("doc_id", "resolved")


_ORPHANS = """
WITH a AS (SELECT sha256(text) AS sha256, any_value(text) AS payload, min(doc_id) AS age FROM documents GROUP BY 1),
live AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id % 3 <> 0),
o AS (SELECT *, age > 50 AS eligible FROM a WHERE sha256 NOT IN (SELECT sha256 FROM live))
"""


@query("artifact_orphans", _ORPHANS + "SELECT sha256, age, eligible FROM o")
def artifact_orphans(spark, d):
    return _stored(spark, d).orphans(_values(spark, d), 50).select("sha256", "age", "eligible")


@query("gc_report", _ORPHANS + "SELECT (SELECT count(*) FROM a) AS scanned, (SELECT count(*) FROM a) - count(*) AS live, count(*) AS orphan_total, count(*) FILTER (eligible) AS eligible, coalesce(sum(strlen(payload)) FILTER (eligible), 0)::BIGINT AS bytes FROM o")
def gc_report(spark, d):
    return _stored(spark, d).report(_values(spark, d), 50)


@query("page_repair", f"""
WITH {A.PAGES}, t AS (SELECT doc_id, page, CASE WHEN page % 2 = 0 THEN substr(text, 1, 50) ELSE text END AS text, alternate FROM doc_pages),
s AS (SELECT *, text IS NULL OR length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 100 AS thin FROM t),
r AS (SELECT *, sum(thin::INT) OVER (PARTITION BY doc_id ORDER BY page) <= 2 AS within FROM s),
k AS (SELECT *, thin AND within AND coalesce(trim(alternate) <> '', false) AS rep FROM r)
SELECT doc_id, sha256(string_agg(CASE WHEN rep THEN alternate ELSE text END, chr(10) || chr(10) ORDER BY page)) AS text_sha256, sum(rep::INT)::BIGINT AS n_replaced, sum((thin AND NOT within)::INT)::BIGINT AS n_degraded FROM k GROUP BY doc_id""")  # fmt: skip
def page_repair(spark, d):
    p = A.pages_of_documents(spark, d).withColumn("text", F.when(F.col("page") % 2 == 0, F.substring("text", 1, 50)).otherwise(F.col("text")))
    return R.page_repair(p, budget=2).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "n_replaced", "n_degraded")


@query("provenance_report", f"""
WITH {A.PAGES} SELECT lang, count(*) FILTER (page % 3 = 0) AS alternate_pages, count(*) FILTER (page % 3 <> 0) AS native_pages, count(DISTINCT doc_id) AS n_docs
FROM doc_pages JOIN documents USING (doc_id) GROUP BY lang""")  # fmt: skip
def provenance_report(spark, d):
    p = A.pages_of_documents(spark, d).groupBy("doc_id").agg(F.count_if(F.col("alternate").isNotNull()).alias("a"), F.count_if(F.col("alternate").isNull()).alias("n"))
    j = p.join(A.documents(spark, d).select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.sum("a").alias("alternate_pages"), F.sum("n").alias("native_pages"), F.count("*").alias("n_docs"))


@query("facts_prompt", f"""
WITH {A.CHUNKS}, w AS (SELECT *, len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS n FROM chunks)
SELECT doc_id, (n // 3)::BIGINT AS "group", sha256(string_agg('[' || chunk_id || '] max facts: ' || CASE WHEN words < 200 THEN '1' WHEN words < 500 THEN '2' ELSE '3' END || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY chunk_index)) AS prompt FROM w GROUP BY ALL""")  # fmt: skip
def facts_prompt(spark, d):
    words = F.size(F.filter(F.split("text", "[ \n]"), lambda x: x != ""))
    return R.facts_prompt(A.chunks(spark, d).withColumn("words", words)).withColumn("prompt", F.sha2("prompt", 256))


@query("facts_parse", f"WITH {A.FACTS} SELECT doc_id, chunk_id, idx, text, CASE WHEN idx % 5 = 4 THEN 0.5 ELSE confidence END AS confidence, upper(chunk_id) AS refs FROM facts")
def facts_parse(spark, d):
    f = A.facts(spark, d)
    item = F.struct("idx", F.to_json(F.struct("text", F.when(F.col("idx") % 5 != 4, F.col("confidence")).alias("confidence"), F.array(F.upper("chunk_id")).alias("entities"))).alias("j"))
    lists = f.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    reply = F.concat(F.lit("<think>[not this]</think>```json\nHere: ["), F.array_join(F.col("x.j"), ", "), F.lit("] done\n```"))
    out = R.facts_parse(lists.select("doc_id", "chunk_id", reply.alias("reply")))
    return out.select("doc_id", "chunk_id", "idx", "text", "confidence", F.array_join("entity_refs", ",").alias("refs"))


def _first_words(prompt):
    """A reply for the plug point that SQL can state: the first five words of the passage; three passages at once are too many for it."""
    import json

    if prompt.count("max facts: ") > 2:
        raise ValueError("too long")
    return json.dumps([{"text": " ".join(prompt.split("\n")[1].split(" ")[:5]), "confidence": 0.9}])


@query("facts_fn", f"""
WITH {A.CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM chunks),
g AS (SELECT *, least(3, total - 3 * (n // 3)) AS members FROM n),
a AS (SELECT doc_id, chunk_id, members = 3 AS single, array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:5], ' ') AS text FROM g WHERE members = 3 OR n % 3 = 0)
SELECT doc_id, chunk_id, single, 0::BIGINT AS idx, text, 0.9::DOUBLE AS confidence FROM a WHERE trim(text) <> ''""")  # fmt: skip
def facts_fn(spark, d):
    """The fact plug point: groups of three, then the chunks of a group that fails one by one."""
    words = F.size(F.filter(F.split("text", "[ \n]"), lambda x: x != ""))
    replies = R.ask_in_groups(A.chunks(spark, d).withColumn("words", words), _first_words)
    facts = R.facts_parse(replies.filter("not single"), 0.7).withColumn("single", F.lit(False)).unionByName(R.facts_parse(replies.filter("single"), 0.7).withColumn("single", F.lit(True)))
    return facts.select("doc_id", "chunk_id", "single", "idx", "text", "confidence")


@query("facts_cache", f"""
WITH {A.CHUNKS}, k AS (SELECT *, sha256(text || ':') AS key FROM chunks), known AS (SELECT DISTINCT key FROM k WHERE chunk_index = 0)
SELECT doc_id, chunk_id, key IN (SELECT key FROM known) AS cached, CASE WHEN key IN (SELECT key FROM known) THEN 'cached' ELSE length(text)::VARCHAR END AS reply FROM k""")  # fmt: skip
def facts_cache(spark, d):
    """Replies by their cache key: first chunks have one, the others are asked, each distinct text once."""
    k = A.chunks(spark, d).withColumn("key", E.facts_key(F.lit("v1"), F.col("text"), F.lit("")))
    cache = k.filter("chunk_index = 0").select("key", F.lit("cached").alias("reply"))
    return R.ask_once(k.withColumn("prompt", F.col("text")), cache, lambda p: str(len(p))).select("doc_id", "chunk_id", "cached", "reply")


_LABEL = "(['PER', 'ORG', 'LOC', 'DATE', 'MONEY', 'MISC'])[(start % 6) + 1]"


@query("label_thresholds", f"WITH {A.ENTITIES} SELECT doc_id, chunk_id, {_LABEL} AS label, text, confidence FROM entities WHERE confidence >= CASE {_LABEL} WHEN 'PER' THEN 0.35 WHEN 'DATE' THEN 0.45 WHEN 'MONEY' THEN 0.55 ELSE 0.5 END")
def label_thresholds(spark, d):
    label = F.element_at(F.array(*map(F.lit, ["PER", "ORG", "LOC", "DATE", "MONEY", "MISC"])), (F.col("start") % 6 + 1).cast("int"))
    e = A.entities(spark, d).withColumn("label", label)
    return e.filter(E.passes_threshold(F.col("label"), F.col("confidence"))).select("doc_id", "chunk_id", "label", "text", "confidence")


@query("entity_dedupe_exact", f"""WITH {A.ENTITIES} SELECT doc_id, entity_id, max(confidence) AS confidence, arg_max(start, (confidence, -start, -"end", sha256(text))) AS start FROM entities GROUP BY doc_id, entity_id""")
def entity_dedupe_exact(spark, d):
    return N.dedupe_exact(A.entities(spark, d)).select("doc_id", "entity_id", "confidence", "start")


@query("entity_dedupe_fuzzy")
def entity_dedupe_fuzzy(spark, d):
    return N.dedupe_fuzzy(A.entities(spark, d))


def _b(p: str) -> str:
    return p.replace("'", "''")


def _rules_sql(cte: str, source: str) -> str:
    """Matches of the rules whose matches in these tables pass without a check, or by one that SQL repeats."""
    kept = [(label, p) for label, p in N.RULES if label in ("EMAIL", "IPV4", "SOCIAL_MENTION", "HASHTAG", "MAC_ADDRESS")]
    return cte + " UNION ALL ".join(f"SELECT doc_id, chunk_id, '{label}' AS label, unnest(regexp_extract_all(text, '{_b(p)}')) AS text FROM {source}" for label, p in kept)


@query("regex_entities_loose", _rules_sql(f"WITH {A.CHUNKS} ", "chunks"))
def regex_entities_loose(spark, d):
    return N.regex_entities(A.chunks(spark, d), strict=False, labels=["EMAIL", "IPV4", "SOCIAL_MENTION", "HASHTAG", "MAC_ADDRESS"])


@query("regex_entities", f"""
WITH {A.CHUNKS}, m AS (SELECT doc_id, chunk_id, 'EMAIL' AS label, unnest(regexp_extract_all(text, '{_b(dict(N.RULES)["EMAIL"])}')) AS text FROM chunks),
c AS (SELECT doc_id, chunk_id, 'CREDIT_CARD' AS label, unnest(regexp_extract_all(text, '{_b(dict(N.RULES)["CREDIT_CARD"])}')) AS text FROM chunks),
luhn AS (SELECT *, list_sum(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN (length(text) - i) % 2 = 0 THEN text[i]::INT WHEN text[i]::INT * 2 > 9 THEN text[i]::INT * 2 - 9 ELSE text[i]::INT * 2 END)) AS s FROM c)
SELECT * FROM m UNION ALL SELECT doc_id, chunk_id, label, text FROM luhn WHERE s % 10 = 0""")  # fmt: skip
def regex_entities(spark, d):
    return N.regex_entities(A.chunks(spark, d), labels=["EMAIL", "CREDIT_CARD"])


@query("regex_entities_all")
def regex_entities_all(spark, d):
    """All rules; the tests compare it with Python's own matches."""
    return N.regex_entities(A.chunks(spark, d), strict=False)


@query("validate_entities", """
WITH n AS (SELECT c_custkey, lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') AS d FROM customer),
t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'DNI_ES' WHEN 1 THEN 'BIC' WHEN 2 THEN 'PHONE' WHEN 3 THEN 'LICENSE_PLATE_ES' ELSE 'GEO_DD' END AS label,
  CASE c_custkey % 5 WHEN 0 THEN d || substr('TRWAGMYFPDXBNJZSQVHLCKE', CASE WHEN c_custkey % 2 = 0 THEN d::INT % 23 + 1 ELSE (d::INT + 1) % 23 + 1 END, 1) WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'ABCDESMM' ELSE 'ABC1ESMM' END WHEN 2 THEN '+34 ' || d || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END
    WHEN 3 THEN substr(d, 1, 4) || CASE WHEN c_custkey % 2 = 0 THEN ' BCD' ELSE ' AEI' END ELSE (c_custkey % 2 * 80 + 41.5)::VARCHAR || ', 2.25' END AS text FROM n)
SELECT c_custkey, label, text, c_custkey % 2 = 0 AS valid FROM t""")  # fmt: skip
def validate_entities(spark, d):
    k, even = F.col("c_custkey"), F.col("c_custkey") % 2 == 0
    digits = F.lpad((k * 7919 % 100000000).cast("string"), 8, "0")
    letter = F.substring(F.lit(E.ID_LETTERS), F.when(even, digits.cast("int") % 23 + 1).otherwise((digits.cast("int") + 1) % 23 + 1).cast("int"), F.lit(1))
    label = F.when(k % 5 == 0, "DNI_ES").when(k % 5 == 1, "BIC").when(k % 5 == 2, "PHONE").when(k % 5 == 3, "LICENSE_PLATE_ES").otherwise("GEO_DD")
    text = (
        F.when(k % 5 == 0, F.concat(digits, letter)).when(k % 5 == 1, F.when(even, "ABCDESMM").otherwise("ABC1ESMM"))
        .when(k % 5 == 2, F.concat(F.lit("+34 "), digits, F.when(even, "").otherwise("x"))).when(k % 5 == 3, F.concat(F.substring(digits, 1, 4), F.when(even, " BCD").otherwise(" AEI")))
        .otherwise(F.when(even, "41.5, 2.25").otherwise("121.5, 2.25"))
    )
    t = table(spark, d, "customer").select("c_custkey", label.alias("label"), text.alias("text"))
    return t.withColumn("valid", E.is_valid(F.col("label"), F.col("text")))


_SEED = "text || ' Paid $1,200.50 to Acme Corp. in Madrid on 2024-03-08, then 30 EUR.'"


def _spans_sql(label: str, score: str, pattern: str, rows: str) -> str:
    """Matches with their places: a match begins where the pieces that the pattern splits off, and the matches before it, end."""
    p = _b(pattern)
    return f"""SELECT doc_id, chunk_id, '{label}' AS label, m[k] AS text, {score}::DOUBLE AS confidence, (list_sum(list_transform(q[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, chunk_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS q FROM {rows}))"""


@query("heuristic_entities", f"""
WITH {A.CHUNKS}, s AS (SELECT doc_id, chunk_id, {_SEED} AS text FROM chunks) """ + "SELECT *, (start + length(text))::INT AS \"end\" FROM (" + " UNION ALL ".join(
    [_spans_sql(label, str(score), f"(?i){p}", "s") for label, (score, ps) in N.HEURISTICS.items() for p in ps] + [_spans_sql("PER", str(N.PERSON[0]), N.PERSON[1], "s")]
) + ")")
def heuristic_entities(spark, d):
    c = A.chunks(spark, d).withColumn("text", F.concat("text", F.lit(" Paid $1,200.50 to Acme Corp. in Madrid on 2024-03-08, then 30 EUR.")))
    return N.heuristic_matches(c)


_CAPITALS = "[A-Z][a-z]{6,}"


def _capitals(texts):
    """Entities for the plug point that SQL can state: capitalised words, with a score by their length; texts without any fail."""
    import re

    out = [[(m.group(), "ORG" if len(m.group()) % 2 else "PER", 0.4 if len(m.group()) < 10 else 0.9, m.start(), m.end()) for m in re.finditer(_CAPITALS, t)] for t in texts]
    if not all(out):
        raise ValueError("nothing found")
    return out


_WINDOWS = "w AS (SELECT doc_id, i AS chunk_id, i * 1702 AS off, substr(text, i * 1702 + 1, 2553) AS text FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1702.0)::BIGINT)) AS i FROM documents WHERE length(text) > 0) WHERE i = 0 OR i * 1702 + 851 < length(text))"
_MODEL = f"""
{_WINDOWS}, found AS ({_spans_sql("", "0", _CAPITALS, "w")}),
model AS (SELECT doc_id, chunk_id::BIGINT AS window_index, CASE WHEN length(text) % 2 = 1 THEN 'ORG' ELSE 'PER' END AS label, text, CASE WHEN length(text) < 10 THEN 0.4 ELSE 0.9 END::DOUBLE AS confidence,
  (start + chunk_id * 1702)::BIGINT AS start, (start + chunk_id * 1702 + length(text))::BIGINT AS "end" FROM found WHERE length(text) >= 10 OR length(text) % 2 = 0)
"""


def _model(spark, d):
    return N.model_entities(C.ner_windows(A.documents(spark, d)), _capitals)


@query("model_entities", f'WITH {_MODEL} SELECT doc_id, window_index, label, text, confidence, start, "end" FROM model')
def model_entities(spark, d):
    return _model(spark, d)


@query("predict_fn", "SELECT doc_id, window_index, 'LOC' AS label, w AS text, off + pos - 1 AS start FROM (SELECT doc_id, i AS window_index, i * 1702 AS off, instr(t, ' the ') + 1 AS pos, 'the' AS w FROM (SELECT doc_id, i, substr(text, i * 1702 + 1, 2553) AS t FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1702.0)::BIGINT)) AS i FROM documents WHERE length(text) > 0) WHERE i = 0 OR i * 1702 + 851 < length(text)) WHERE contains(t, ' the '))")
def predict_fn(spark, d):
    """The entity plug point with a model of one's own: here, the first ' the ' of a window."""

    def predict(texts):
        return [[("the", "LOC", 0.9, t.index(" the ") + 1, t.index(" the ") + 4)] if " the " in t else [] for t in texts]

    return N.model_entities(C.ner_windows(A.documents(spark, d)), predict).select("doc_id", "window_index", "label", "text", "start")


@query("entity_id", f"WITH {A.ENTITIES} SELECT doc_id, chunk_id, text, entity_id FROM entities")
def entity_id(spark, d):
    return _with_ids(spark, d).select("doc_id", "chunk_id", "text", "entity_id")


@query("window_entity_merge")
def window_entity_merge(spark, d):
    return N.merge_windows(_model(spark, d))


@query("span_overlap_pairs", f"""
WITH {A.ENTITIES}, s AS (SELECT DISTINCT doc_id, label, substr(chunk_id, 7)::BIGINT AS w, start, "end", text FROM entities)
SELECT a.doc_id, a.label, a.w AS window_index_a, a.start AS start_a, a."end" AS end_a, a.text AS text_a, b.w AS window_index_b, b.start AS start_b, b."end" AS end_b, b.text AS text_b
FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.label = b.label AND a.w < b.w AND a.start <= b."end" + 20 AND b.start <= a."end" + 20""")  # fmt: skip
def span_overlap_pairs(spark, d):
    e = A.entities(spark, d).withColumn("window_index", F.substring("chunk_id", 7, 10).cast("long"))
    return N.overlapping_spans(e)


def _refs(spark, d):
    """Every capitalised word of a fact of seven letters or more, as a reference to an entity."""
    return A.facts(spark, d).select("doc_id", "chunk_id", "idx", F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}{6,}"), F.lit(0))).alias("ref"))


@query("resolve_entity_refs")
def resolve_entity_refs(spark, d):
    return N.resolve_refs(_refs(spark, d), _with_ids(spark, d)).select("doc_id", "chunk_id", F.array_join("entity_ids", ",").alias("entity_ids"))


@query("resolve_entity_refs_exact", _CEF + """,
k AS (SELECT doc_id, norm, min(entity_id) AS entity_id FROM entities WHERE norm <> '' GROUP BY ALL),
r AS (SELECT doc_id, chunk_id, """ + E.normalize_sql("ref") + """ AS norm FROM (SELECT doc_id, chunk_id, unnest(regexp_extract_all(text, '\\p{Lu}\\p{Ll}{6,}')) AS ref FROM facts))
SELECT doc_id, chunk_id, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS entity_ids FROM r JOIN k USING (doc_id, norm) GROUP BY ALL""")  # fmt: skip
def resolve_entity_refs_exact(spark, d):
    r = N.resolve_exact(_refs(spark, d), _with_ids(spark, d)).filter("entity_id is not null")
    return r.groupBy("doc_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("entity_ids"))


@query("entities_union", f"""
WITH {A.ENTITIES} SELECT doc_id, chunk_id, label, text, confidence, 0 AS source_rank FROM entities
UNION ALL SELECT doc_id, chunk_id, 'EMAIL', unnest(regexp_extract_all(text, '{_b(dict(N.RULES)["EMAIL"])}')), 1.0, 1 FROM chunks""")  # fmt: skip
def entities_union(spark, d):
    model = A.entities(spark, d).select("doc_id", "chunk_id", "label", "text", "confidence", F.lit(0).alias("source_rank"))
    rules = N.regex_entities(A.chunks(spark, d), labels=["EMAIL"]).select("doc_id", "chunk_id", "label", "text", F.lit(1.0).alias("confidence"), F.lit(1).alias("source_rank"))
    return model.unionByName(rules)


@query("entity_pipeline")
def entity_pipeline(spark, d):
    """Windows, model, merge, thresholds, rules, ids, fuzzy de-duplication; the model's entities come before those of the rules, which stand at the place of their chunk."""
    return N.dedupe_fuzzy(entity_mentions(spark, d))


def entity_mentions(spark, d):
    """(doc_id, chunk_id, label, text, confidence, start, end, source_rank) of the model, then of the rules."""
    index = F.floor(F.col("start") / 1848)
    model = N.merge_windows(_model(spark, d)).select(
        "doc_id", F.format_string("chunk_%03d", index).alias("chunk_id"), "label", "text", "confidence", "start", "end", F.lit(0).cast("long").alias("source_rank")
    )
    c = A.chunks(spark, d).select("doc_id", "chunk_id", "text", F.col("start_offset").cast("long").alias("start"), F.col("end_offset").cast("long").alias("end"))
    rules = N.regex_entities(c, carry=("start", "end"))
    rules = rules.select("doc_id", "chunk_id", "label", "text", F.lit(1.0).alias("confidence"), "start", "end", F.lit(1).cast("long").alias("source_rank"))
    return model.unionByName(rules)


@query("chunk_udtf", f"WITH {A.CHUNKS} SELECT doc_id, chunk_index::BIGINT AS chunk_index, text FROM chunks")
def chunk_udtf(spark, d):
    from corpusloom.functions.udtf import register

    register(spark)
    A.documents(spark, d).createOrReplaceTempView("corpusloom_docs")
    return spark.sql("SELECT doc_id, c.chunk_index, c.text FROM corpusloom_docs, LATERAL chunk_overlap(text, 2048, 200) c")
