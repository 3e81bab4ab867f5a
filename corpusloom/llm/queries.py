"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, chat_format, conversation_repair, decontaminate, embedding_dedup, html_extract, jaccard_join, language_id, license_scan, personal_data, quality
from corpusloom.llm import source_audit, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language_id.held_out()
    profiles = language_id.fit_profiles(docs.filter(~held))
    out = language_id.identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents").select("doc_id", "text"), quality.held_out()
    model = quality.fit_quality(docs.filter(~held), _table(spark, sf_dir, "labels").filter(~held))
    return quality.score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS probe(conv_id, turn, role, text)"
    )
    return chat_format.digest(chat_format.format_examples(turns.unionByName(probe)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), bpe.read_vocabulary(vocabulary_path()))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digest(conversation_repair.damage(_table(spark, sf_dir, "conversations")))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(_table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data_digest(_table(spark, sf_dir, "documents"))


_OP1_SQL = r"""
WITH rules(pattern, rhost, rpath, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
p AS (
  SELECT page_id, url,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM p)
SELECT page_id, host, path, arg_max(pattern, length(pattern)) AS rule, coalesce(arg_max(verdict, length(pattern)), 'allow') AS verdict
FROM h LEFT JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
GROUP BY r, page_id, host, path
"""

_OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;'))
       + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id, max(n)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


#: For pages whose article holds only headings, paragraphs, line breaks and inline markup, as the given ones do.
_OP2_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '(?s)<!--.*?-->', '', 'g'), '</?(?:p|h1|h2|br|ul|li)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""


def _seed_sql(rows: str, key: str, tokens: str) -> str:
    """Seeds of every mask for items of 13 tokens and more, as the given ones are: the tokens that the mask keeps, joined."""
    parts = []
    for k, mask in enumerate(decontaminate.MASKS + decontaminate.MORE):
        kept = " || ' ' || ".join(f"{tokens}[i + {o + 1}]" for o, c in enumerate(mask) if c == "1")
        parts.append(f"SELECT {key}, {k} AS k, unnest(list_transform(range(0, greatest(0, len({tokens}) - {len(mask) - 1})), lambda i: {{'at': i, 's': {kept}}})) AS x FROM {rows}")
    return f"SELECT {key}, k, x['at'] AS at, x['s'] AS s FROM ({' UNION ALL '.join(parts)})"


_OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS d FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS b FROM benchmark),
ds AS ({_seed_sql("d", "doc_id", "d")}), bs AS ({_seed_sql("b", "item_id", "b")}),
h AS (SELECT doc_id, item_id, ds.at - bs.at AS shift, count(DISTINCT ds.at) AS n, min(ds.at) AS lo, max(ds.at) AS hi FROM ds JOIN bs USING (k, s) GROUP BY ALL),
e AS (SELECT h.*, least({decontaminate.WINDOW}, len(b)) AS w, list_transform(range(1, len(b) + 1), lambda i: CASE WHEN i + shift >= 1 AND d[i + shift] = b[i] THEN 1 ELSE 0 END) AS eq FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
m AS (SELECT *, list_max(list_transform(range(1, greatest(1, len(eq) - w + 1) + 1), lambda i: list_sum(eq[i:i + w - 1]))) AS best FROM e)
SELECT doc_id, item_id, max(best)::INT AS tokens_equal, sum(n)::BIGINT AS n_hits, min(lo)::INT AS token_from, max(hi)::INT AS token_to FROM m
WHERE best >= ceil(w * {decontaminate.LEAST} / {decontaminate.WINDOW}.0) GROUP BY doc_id, item_id
"""


_REACH = """
r(id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a WHERE r.root < e.b),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
"""

_OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS x FROM g), n AS (SELECT doc_id, len(g)::BIGINT AS n FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)), {_REACH}
SELECT n.doc_id, n AS n_shingles, coalesce(root, n.doc_id) AS component_id FROM n LEFT JOIN c ON id = n.doc_id
"""

_OP9_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98), {_REACH}
SELECT vec_id, (SELECT count(*) FROM e WHERE a = vec_id)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON id = vec_id
"""


_OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(l.total), 0) AS lang_total, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN c USING (lang, source) LEFT JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (lang_total + 5 * v)::HUGEINT AS q FROM g JOIN k USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON (f.lang, f.source, f.item) = (a.lang, a.source, b.source)
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u
QUALIFY part = 'pair' OR rank <= 50
"""


def _spans_sql(kind: str, k: int, pattern: str, good: str) -> str:
    """Matches of a pattern with their places: what stands before a match is the piece that the pattern splits off."""
    return f"""SELECT r, '{kind}' AS kind, {k} AS k, m, after - length(m) AS a, after AS b FROM (
  SELECT r, m, sum(length(piece) + length(m)) OVER (PARTITION BY r ORDER BY i) AS after FROM (
    SELECT r, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(regexp_split_to_array(text, '{pattern}')[:-2]) AS piece,
      unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM d)) WHERE {good}"""


_DIGITS_SQL = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN_SQL = f"list_sum(list_transform(range(length({_DIGITS_SQL})), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse({_DIGITS_SQL}), i + 1, 1)::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(reverse({_DIGITS_SQL}), i + 1, 1)::INT + 1] END)) % 10 = 0"

#: Without the disguised spans: the given documents hold none.
_OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_spans_sql("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}
  UNION ALL {_spans_sql("ip", 1, "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255")}
  UNION ALL {_spans_sql("card", 2, "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS_SQL}) BETWEEN 12 AND 19 AND {_LUHN_SQL}")}
  UNION ALL {_spans_sql("phone", 3, "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS_SQL}) BETWEEN 9 AND 15")}),
l AS (SELECT d.r, doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k), '') AS spans FROM d LEFT JOIN s USING (r) GROUP BY ALL)
SELECT doc_id, n_email, n_ip, n_card, n_phone, sha256(spans) AS base_sha256, spans FROM l
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_url_filter": op1_url_filter,
        "op2_html_extract": op2_html_extract,
        "op3_language_id": op3_language_id,
        "op4_license_scan": op4_license_scan,
        "op5_decontaminate": op5_decontaminate,
        "op6_quality": op6_quality,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_chat_format": op8_chat_format,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_bpe": op10_bpe,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_source_audit": op12_source_audit,
        "op13_personal_data": op13_personal_data,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _OP1_SQL,
        "op2_html_extract": _OP2_SQL,
        "op5_decontaminate": _OP5_SQL,
        "op7_jaccard_join": _OP7_SQL,
        "op8_chat_format": _OP8_SQL,
        "op9_embedding_dedup": _OP9_SQL,
        "op12_source_audit": _OP12_SQL,
        "op13_personal_data": _OP13_SQL,
    }
