"""Expressions, chunkers and results on fixed cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking as C
from corpusloom.operators import jobs as J
from corpusloom.operators import metrics as M
from corpusloom.operators import results as R
from corpusloom.sources import files as S


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [(" el documento de la empresa que fue enviado en el año pasado ", "es"), (" the document of the company that was sent in the year ", "en"), ("xyz abcdef ghi jkl", "unknown")],
)
def test_language(spark, text, want):
    assert one(spark, T.language(F.col("t")), t=text) == want


def test_stats(spark):
    t = "Word word word. Word word. Word."
    assert one(spark, T.avg_sentence_length(F.col("t")), t=t) == 2.0
    assert one(spark, T.avg_sentence_length(F.col("t")), t="none") == 0.0
    assert one(spark, T.line_count(F.col("t")), t="a\nb\nc") == 3
    assert one(spark, T.word_count(F.col("t")), t="Hello world. This is a test document.") == 7
    assert one(spark, T.guess_mime(F.col("t")), t="https://x.org/a/doc.pdf?v=1") == "application/pdf"
    assert one(spark, T.guess_mime(F.col("t")), t="https://x.org/custom") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("Escritura ante notario", "notariado"), ("referencia catastral", "catastro"), ("extracto bancario del banco", "bancario"), ("nothing", None)],
)
def test_source(spark, text, want):
    got = one(spark, T.source_type(F.col("t")), t=text)
    assert (got and got["document_type"]) == want


def test_gate(spark):
    s = T.gate_signals(F.col("t"), F.col("n"))
    lines = "\n".join(["![a](b.png)"] * 4 + ["text"])
    df = spark.createDataFrame([(0, "x" * 200, 4), (1, lines, None), (2, "(cid:7)�", 1), (3, "", 1), (4, "Texto denso en español, con números 123. " * 10, 1)], "i int, t string, n int")
    got = {r["i"]: r for r in df.select("i", *[c.alias(k) for k, c in s.items()], T.gate_decision(s).alias("d")).collect()}
    assert got[0]["chars_per_page"] == 50.0 and got[0]["d"] == "suspect"
    assert got[1]["image_placeholder_ratio"] == pytest.approx(0.8)
    assert got[2]["garbage_ratio"] == pytest.approx(3 / 8)
    assert (got[3]["d"], got[4]["d"], got[4]["garbage_ratio"]) == ("suspect", "pass", 0.0)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 60), (2, ""), (3, "word " * 200), (4, None)], "doc_id long, text string")
    assert C.chunk_overlap(df, 25, 5).filter("doc_id = 1").count() == 3
    parts = [r["text"] for r in C.chunk_overlap(df, 256, 32).filter("doc_id = 3").orderBy("chunk_index").collect()]
    assert all(b.startswith(a[-32:]) for a, b in zip(parts, parts[1:], strict=False))
    assert C.chunk_overlap(df, 25, 5).filter("doc_id in (2, 4)").count() == 0
    for size, overlap in ((0, 0), (5, -1), (5, 5)):
        with pytest.raises(ValueError):
            C.chunk_overlap(df, size, overlap)


@pytest.mark.parametrize(("n", "short", "kept"), [(2553, 1, 1), (2554, 1, 2), (2977, 1, 2), (2978, 2, 2)])
def test_ner_tail(spark, n, short, kept):
    df = spark.createDataFrame([(1, "a" * n)], "doc_id long, text string")
    assert C.ner_windows(df, keep_tail=False).count() == short
    assert C.ner_windows(df).count() == kept


def test_turns(spark):
    rows = [(1, 0, "int1", "hello"), (1, 1, "int2", "a"), (1, 2, "int2", "b"), (2, 0, None, "x" * 2000)]
    got = C.chunk_turns(spark.createDataFrame(rows, "doc_id long, seg_index long, speaker string, text string"), 500).orderBy("doc_id", "chunk_index").collect()
    assert [r["text"] for r in got if r["doc_id"] == 1] == ["[int1]: hello", "[int2]: a b"]
    assert len([r for r in got if r["doc_id"] == 2]) > 1


def test_turns_fall_back_to_text(spark):
    segments = spark.createDataFrame([(1, 0, "a", "hello"), ((1 << 53) + 1, 0, None, None)], "doc_id long, seg_index long, speaker string, text string")
    docs = spark.createDataFrame([(1, "unused"), (2, "x" * 1200)], "doc_id long, text string")
    got = C.chunk_turns(segments, 500, docs).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["chunk_index"], len(r["text"]), r["speaker"]) for r in got] == [
        (1, 0, 10, "a"), (2, 0, 500, None), (2, 1, 500, None), (2, 2, 200, None), ((1 << 53) + 1, 0, 8, None),
    ]


def test_sentences_pack(spark):
    got = C.pack_sentences(spark.createDataFrame([(1, "One two. Three four! Five six? Seven.")], "doc_id long, text string"), 20).orderBy("chunk_index").collect()
    assert [r["text"] for r in got] == ["One two. Three four!", "Five six? Seven."]


def test_plan_matrix(spark):
    steps, queues = J.plan_steps(F.col("e"), F.col("p"), F.split("f", ","))
    assert one(spark, steps, e="extraction", p="rag", f="") == ["embeddings", "extraction", "inferences"]
    assert one(spark, queues, e="audio", p="nope", f="inferences") == ["embeddings", "entities", "metadata", "inferences"]
    assert one(spark, steps, e="print", p="full", f="") is None


def test_batches(spark):
    rows = [(b, i, s) for b, ss in enumerate(["CC", "FF", "CF", "CP", "FP"]) for i, s in enumerate({"C": "completed", "F": "failed", "P": "pending"}[c] for c in ss)]
    got = {r["batch_id"]: r["status"] for r in J.batch_status(spark.createDataFrame(rows, "batch_id long, job_id long, status string")).collect()}
    assert got == {0: "completed", 1: "failed", 2: "partial", 3: "running", 4: "running"}


def test_rate_with_reset(spark):
    df = spark.createDataFrame([("c", 0, 5.0), ("c", 60, 8.0), ("c", 120, 2.0), ("c", 400, 4.0)], "name string, t long, value double")
    assert [r["increase"] for r in M.counter_rate(df).orderBy("t").collect()] == [0.0, 3.0, 5.0, 4.0]


def test_quantile_edges(spark):
    h = M.histogram(spark.createDataFrame([("a", 4.0)] * 5 + [("a", 7.0)] * 5 + [("b", 1e9)], "k string, v double"), "v", "k")
    q = lambda p: {r["k"]: r["quantile"] for r in M.histogram_quantile(h, p, "k").collect()}
    assert q(0.5) == {"a": 5.0, "b": 600.0}


def test_replies(spark):
    replies = [
        (1, "c", 'x ```json\n[{"text": "a", "confidence": 0.9, "entity_refs": ["E"]}, {"text": " "}]\n```'), (2, "c", '<think>[1]</think>[{"text": "b [not] \\"q\\"", "entities": ["F"]}] tail'),
        (3, "c", "no array"), (4, "c", None), (5, "c", '[{"text": "open"'),
    ]
    got = {r["doc_id"]: (r["text"], r["confidence"], r["entity_refs"]) for r in R.facts_parse(spark.createDataFrame(replies, "doc_id long, chunk_id string, reply string")).collect()}
    assert got == {1: ("a", 0.9, ["E"]), 2: ('b [not] "q"', 0.5, ["F"])}


def test_embedding_once_and_degraded(spark):
    items = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b"), ("k3", "boom"), ("k4", "d")], "key string, text string").coalesce(1)
    cache = spark.createDataFrame([("k2", [1.0, 0.0]), ("k4", [1.0])], "key string, embedding array<float>")

    def embed(texts):
        if "boom" in texts:
            raise RuntimeError("no")
        return [[0.0, 1.0] for _ in texts]

    got = {r["key"]: (len(r["embedding"]), r["degraded"]) for r in R.embed_texts(items, cache, embed, 2, batch=1).collect()}
    assert got == {"k1": (2, False), "k2": (2, False), "k3": (0, True), "k4": (2, False)}


def test_results_write_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "en"), (2, "fr")], "doc_id long, lang string")
    R.write_results(df, str(tmp_path))
    R.write_results(df.filter("lang = 'en'"), str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).count() == 2


def test_status_of_total_failure(spark):
    parts = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False), (3, False), (4, None)], "doc_id long, degraded boolean")
    status = R.embedding_status(parts)
    assert {r["doc_id"]: r["status"] for r in status.collect()} == {1: "failed", 2: "degraded", 3: "ok", 4: "failed"}
    assert R.all_or_error(status.filter("doc_id in (2, 3)")).count() == 2
    with pytest.raises(Exception, match="no vector for any part of document 1"):
        R.all_or_error(status).collect()


def test_groups_fall_back_to_single_chunks(spark):
    chunks = spark.createDataFrame([(1, k, f"c{k}", 10, "bad" if k == 4 else f"t{k}") for k in range(7)], "doc_id long, chunk_index long, chunk_id string, words long, text string")
    asked = []

    def answer(prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        asked.append(prompt)
        return str(prompt.count("max facts: "))

    got = {r["chunk_id"]: (r["reply"], r["single"]) for r in R.ask_in_groups(chunks, answer).collect()}
    assert got == {"c0": ("3", False), "c6": ("1", False), "c3": ("1", True), "c4": (None, True), "c5": ("1", True)}


def test_replies_are_cached(spark):
    prompts = spark.createDataFrame([(1, "a", "k1", "x"), (2, "b", "k1", "x"), (3, "c", "k2", "yy"), (4, "d", "k3", "zzz")], "doc_id long, chunk_id string, key string, prompt string")
    cache = spark.createDataFrame([("k2", "known"), ("k3", None)], "key string, reply string")
    got = {r["doc_id"]: (r["reply"], r["cached"]) for r in R.ask_once(prompts, cache, lambda p: str(len(p))).collect()}
    assert got == {1: ("1", False), 2: ("1", False), 3: ("known", True), 4: ("3", False)}


def test_order_statistics_against_sorting(spark):
    rng = random.Random(8)
    rows = [(k, round(rng.choice([rng.random(), 0.5, 7.0]), 3)) for k in ("a", "b", None) for _ in range(rng.choice([1, 2, 37, 400]))] + [("c", None)]
    got = {r["k"]: r for r in M.latency_report(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()}
    assert set(got) == {"a", "b", None}
    for k, r in got.items():
        v = sorted(x for g, x in rows if g == k)
        assert r["n"] == len(v) and r["p95_index"] == v[max(1, int(0.95 * len(v))) - 1]
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            at = (len(v) - 1) * q
            assert r[name] == pytest.approx(v[math.floor(at)] * (1 - at % 1) + v[math.ceil(at)] * (at % 1))


def test_rate_over_spans(spark):
    rng = random.Random(2)
    rows = [("c", t, float(rng.randrange(50))) for t in sorted(rng.sample(range(5000), 120))]
    got = {r["t"]: r["increase"] for r in M.counter_rate(spark.createDataFrame(rows, "name string, t long, value double"), 300).collect()}
    deltas = [0.0] + [b[2] - a[2] if b[2] >= a[2] else b[2] for a, b in zip(rows, rows[1:], strict=False)]
    assert got == {t: sum(d for (_, u, _), d in zip(rows, deltas, strict=True) if t - 300 <= u <= t) for _, t, _ in rows}


def test_rate_has_no_sliding_frame(spark):
    """A frame that slides is added up again for each row, so a dense counter would cost the square of its samples; equal times count together."""
    rng = random.Random(3)
    rows = [("c", rng.randrange(1000), float(rng.randrange(50))) for _ in range(400)]
    out = M.counter_rate(spark.createDataFrame(rows, "name string, t long, value double"), 300)
    assert "RangeFrame, -300" not in out._jdf.queryExecution().toString()
    rows.sort(key=lambda r: r[1:])
    deltas = [0.0] + [b[2] - a[2] if b[2] >= a[2] else b[2] for a, b in zip(rows, rows[1:], strict=False)]
    want = sorted((t, v, sum(d for (_, u, _), d in zip(rows, deltas, strict=True) if t - 300 <= u <= t)) for _, t, v in rows)
    assert sorted((r["t"], r["value"], r["increase"]) for r in out.collect()) == want


def test_page_text_decodes_references(spark):
    page = "<p>caf&eacute; &#8364; &mdash; &#x41;&amp;lt; &nbsp; <b>x</b><!-- no --></p>"
    assert one(spark, T.html_text(F.col("h")), h=page) == "café € — A&lt; x"
    assert spark.createDataFrame([(None,)], "h string").select(T.html_text(F.col("h"))).first()[0] is None


def test_references_without_semicolon_stay(spark):
    page = "<title>this &amp that&amp</title>p?a=1&copy=2 &notit; &nosuch; &copy;\u00a0\u2003 &nbsp;x"
    assert one(spark, T.html_text(F.col("h")), h=page) == "this &amp that&ampp?a=1&copy=2 &notit; &nosuch; ©\u00a0\u2003 x"


def test_files_of_a_folder(spark, tmp_path):
    for name, data in (("a.txt", b"hi"), ("b.exe", b"x"), ("c.csv", b"h\n" + b"1\n" * 5000), ("sub/d.pdf", b"y" * 3000)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["refusal"] for r in S.admit_files(S.read_files(spark, str(tmp_path)), document_mb=1, sheet_bytes=4096).collect()}
    assert got == {"a.txt": None, "b.exe": "invalid_file_type", "c.csv": "spreadsheet_too_large", "d.pdf": None}


def test_records_of_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines"\n2,"a ""b"", c"\n')
    (tmp_path / "b.csv").write_text("id,text\n" + "".join(f"{i},x\n" for i in range(5)))
    got = {r["path"].rsplit("/", 1)[1]: (r["n_records"], r["refused"]) for r in S.csv_row_guard(S.read_csv_records(spark, str(tmp_path)), 4).collect()}
    assert got == {"a.csv": (2, False), "b.csv": (5, True)}


def test_batch_of_too_many_documents(spark):
    import json

    body = lambda n, **more: json.dumps({"profile": "full", "documents": [{"doc_id": i, "filename": f"{i}.pdf", "text": "x"} for i in range(n)]} | more)
    df = spark.createDataFrame([("ok", body(100)), ("many", body(101)), ("odd", body(1, profile="deluxe"))], "batch string, body string")
    got = {(r["batch"], r["reason"]): r["n"] for r in S.batch_explode(df).groupBy("batch", "reason").agg(F.count("*").alias("n")).collect()}
    assert got == {("ok", None): 100, ("many", "too_many_documents"): 101, ("odd", "invalid_profile"): 1}


def beside_sql(spark, tmp_path, name, rows):
    """A query's rows and its SQL's on documents of these (doc_id, text, source)."""
    import duckdb

    from corpusloom.plans import text_queries  # noqa: F401
    from corpusloom.plans.registry import ORACLES, QUERIES
    from tests.oracle import spark_rows, sql_rows

    spark.createDataFrame([(k, t, "en", s) for k, t, s in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return spark_rows(QUERIES[name](spark, str(tmp_path))), sql_rows(con, ORACLES[name])


@pytest.mark.parametrize("rows", [
    [(k, t, "a") for k, t in enumerate(["", " ", " \n\t", None, "\xa0", "x"] * 12)],
    [((1 << 53) + k, f"text {k}", "a") for k in range(250)],
    [(k, "x", s) for k in range(-210, 210, 10) for s in ("a", "a-", None)],
], ids=["blank", "large ids", "negative ids, no source"])
def test_batches_as_in_sql(spark, tmp_path, rows):
    got, want = beside_sql(spark, tmp_path, "batch_explode", rows)
    assert got == want


def test_batch_with_a_long_text(spark):
    """Jackson's limit of 20 million characters would lose the whole request."""
    item = F.struct(F.lit(1).cast("long").alias("doc_id"), F.lit("a.pdf").alias("filename"), F.repeat(F.lit("x"), F.col("n")).alias("text"))
    df = spark.createDataFrame([("b", 20_000_001)], "batch string, n int").select("batch", F.to_json(F.struct(F.array(item).alias("documents"))).alias("body"))
    assert [(r["filename"], r["n"]) for r in S.batch_explode(df).select("filename", F.length("text").alias("n")).collect()] == [("a.txt", 20_000_001)]


def test_chunk_requests_as_in_sql(spark, tmp_path):
    texts = ["", " ", " \n\t", None, "\xa0", "x", " " * 20_000, "\n" * 20_001, "\xe9" * 10_001, "y" * 20_001]
    got, want = beside_sql(spark, tmp_path, "chunk_params_check", [(k * 180 + n, t, "a") for k, t in enumerate(texts) for n in range(-90, 90)])
    assert got == want


@pytest.mark.parametrize("text", ["", " \n\t\r", None])
def test_chunk_request_without_text_is_refused(spark, text):
    """Whatever the query's SQL takes for a request without text, the operator refuses blank ones, as the reference does."""
    assert one(spark, C.chunk_request_error(F.col("t"), F.lit(20), F.lit(5)), t=text) == "empty_text"


def test_type_of_source_searches_a_text_once(spark, sf_dir):
    """Words are searched for as words, and the type is worked out in one place of the plan."""
    from corpusloom.plans import text_queries

    plan = text_queries.classify_source(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("lower(") == 1
