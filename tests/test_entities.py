"""Validators, dates, rules and de-duplication on fixed cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import entity as E
from corpusloom.operators import entities as N
from corpusloom.operators import results as R
from corpusloom.plans import result_queries

VALID = [
    ("EMAIL", "a.b@example.com", True), ("EMAIL", "a[at]b.org", True), ("EMAIL", "a@b", False), ("EMAIL", "@b.org", False), ("EMAIL", "a@.org", False), ("EMAIL", "a b@c.d", False),
    ("PHONE", "+34 912 345 678", True), ("PHONE_INTL", "(91) 234-5678", True), ("PHONE", "123456", False), ("PHONE", "+34x912345678", False),
    ("URL", "https://example.org/x", True), ("URL", "hxxps://example[.]org", True), ("URL", "ftp://x.org", False), ("URL", "http:///x", False),
    ("CREDIT_CARD", "4111 1111 1111 1111", True), ("CREDIT_CARD", "4111111111111112", False), ("CREDIT_CARD", "41111", False),
    ("IBAN_ES", "ES91 2100 0418 4502 0005 1332", True), ("IBAN_ES", "ES9121000418450200051333", False), ("IBAN_ES", "ES91", False),
    ("IBAN_INTL", "GB82 WEST 1234 5698 7654 32", True), ("IBAN_INTL", "GB82WEST12345698765433", False), ("IBAN_INTL", "1B82WEST12345698765432", False),
    ("DNI_ES", "12345678Z", True), ("DNI_ES", "12345678A", False), ("DNI_ES", "1234567Z", False),
    ("NIF_ES", "X1234567L", True), ("NIF_ES", "12345678Z", True), ("NIF_ES", "X1234567A", False), ("NIF_ES", "A1234567L", False),
    ("CIF_ES", "A12345678", True), ("CIF_ES", "B1234567J", True), ("CIF_ES", "K1234567K", False),
    ("VAT_ES", "ESA12345678", True), ("VAT_ES", "FRA12345678", False), ("VAT_ES", "ES12", False),
    ("BTC", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", True), ("BITCOIN", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfN0", False), ("CRYPTO_BTC_ADDRESS", "2A1z", False),
    ("BIC", "DEUTDEFF", True), ("SWIFT", "DEUTDEFF500", True), ("SWIFT_BIC", "DEU1DEFF", False), ("SWIFT_BIC", "DEUTDEF", False),
    ("LICENSE_PLATE_ES", "1234 BCD", True), ("LICENSE_PLATE_ES", "1234ABC", False),
    ("GEO_DD", "41.40338, 2.17403", True), ("GEOLOCATION_DD", "-91.0, 2.0", False), ("GEOLOCATION_DD", "41.4", False),
    ("GEO_DMS", "41° 24' 12.2\" N 2° 10' 26.5\" E", True), ("GEOLOCATION_DMS", "41° 24' 12\" N 2° 10' 26\" O", True), ("GEOLOCATION_DMS", "95° 0' 0\" N 2° 1' 1\" E", False),
    ("IPV4", "1.2.3.4", False), ("", "x", False), ("EMAIL", " ", False),
]

DATES = [
    ("8/3/2023", "08/03/2023"), ("29-02-2024", "29/02/2024"), ("29/02/2023", None), ("31/04/2023", None), ("01/01/1899", None), ("01/01/2101", None), ("2023-03-08", "08/03/2023"),
    ("2023/13/08", None), ("8 de marzo de 2023", "08/03/2023"), ("8 marzo 2023", "08/03/2023"), ("8 March 2023", "08/03/2023"), ("March 8, 2023", "08/03/2023"), ("march 31 2023", "31/03/2023"),
    ("March 32, 2023", None), ("enero 2023", "01/01/2023"), ("mayo de 2020", "01/05/2020"), ("January 1890", None), ("8 Mar 2023", None), ("hello", None), ("30 de febrero de 2023", "30/02/2023"),
]


def test_validators(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(VALID)], "i int, label string, text string")
    got = {r["i"]: r["v"] for r in df.withColumn("v", E.is_valid(F.col("label"), F.col("text"))).collect()}
    assert [(VALID[i], got[i]) for i in got if got[i] != VALID[i][2]] == []


def test_dates(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(DATES)], "i int, text string")
    got = {r["i"]: r["d"] for r in df.withColumn("d", E.normalize_date(F.col("text"))).collect()}
    assert [(DATES[i], got[i]) for i in got if got[i] != DATES[i][1]] == []


def test_rules_beside_accents(spark):
    text = "é12345678Z, mail x@y.org. el 8 de marzo de 2023; ES9121000418450200051332 y 4111111111111111 (1234 BCD) http://a.org/é #tag @me 1.2.3.4"
    df = spark.createDataFrame([(1, "c", text)], "doc_id long, chunk_id string, text string")
    strict = {(r["label"], r["text"]) for r in N.regex_entities(df).collect()}
    assert {("EMAIL", "x@y.org"), ("DATE", "08/03/2023"), ("CREDIT_CARD", "4111111111111111"), ("LICENSE_PLATE_ES", "1234 BCD"), ("DNI_ES", "12345678Z"), ("IBAN_ES", "ES9121000418450200051332")} <= strict
    loose = {r["label"] for r in N.regex_entities(df, strict=False).collect()}
    assert {"IPV4", "HASHTAG", "SOCIAL_MENTION"} <= loose - {label for label, _ in strict}


def entities(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, chunk_id string, label string, text string, confidence double, start long, end long")


def test_exact_dedupe(spark):
    rows = [(1, "c0", "ORG", "Acme", 0.5, 0, 4), (1, "c1", "ORG", "ACME.", 0.9, 50, 55), (1, "c1", "PER", "Acme", 0.1, 50, 54), (2, "c0", "ORG", "Acme", 0.2, 0, 4)]
    got = sorted((r["doc_id"], r["label"], r["confidence"], r["start"]) for r in N.dedupe_exact(entities(spark, rows)).collect())
    assert got == [(1, "ORG", 0.9, 50), (1, "PER", 0.1, 50), (2, "ORG", 0.2, 0)]


def test_fuzzy_dedupe_keeps_first_id(spark):
    rows = [(1, "c0", "PER", "José García", 0.5, 0, 11), (1, "c1", "PER", "Jose Garcias", 0.9, 40, 52), (1, "c1", "PER", "Ana Ruiz", 0.4, 60, 68)]
    got = N.dedupe_fuzzy(entities(spark, rows)).orderBy("start").collect()
    assert [(r["text"], r["confidence"]) for r in got] == [("Jose Garcias", 0.9), ("Ana Ruiz", 0.4)]
    first = entities(spark, rows[:1]).select(E.entity_id(F.lit("PER"), F.col("text")).alias("i")).first()["i"]
    assert got[0]["entity_id"] == first and len(first) == 12


def test_fuzzy_dedupe_in_order_of_mention(spark):
    rows = [(1, "c0", "ORG", "Acme Corp", 0.5, 10, 19), (1, "c0", "ORG", "Acme Corq", 0.6, 100, 109), (1, "c1", "ORG", "Acme Corp", 0.9, 900, 909)]
    got = N.dedupe_fuzzy(entities(spark, rows)).collect()
    ids = {r["text"]: r["i"] for r in entities(spark, rows).select("text", E.entity_id(F.lit("ORG"), F.col("text")).alias("i")).collect()}
    assert [(r["entity_id"], r["text"], r["confidence"], r["start"]) for r in got] == [(ids["Acme Corp"], "Acme Corp", 0.9, 900)]


def plain_dedupe(rows, norm, ids, least=85):
    """rows (doc, label, text, confidence, chunk, ...) in order -> kept {(doc, label): [[id, text, confidence, chunk]]}, by the plain loop over all kept ones."""
    kept = {}
    for doc, label, text, confidence, chunk in rows:
        mine, eid = kept.setdefault((doc, label), []), ids[label, text]
        same = lambda rep: (norm[rep[1]] or rep[0] == eid) and bool(norm[rep[1]]) == bool(norm[text]) and N.indel_ratio(norm[rep[1]], norm[text]) >= least  # noqa: B023, E731
        rep = next((r for r in mine if same(r)), None)
        if rep is None:
            taken = next((r for r in mine if r[0] == eid), None)
            if taken:
                taken[1:] = [text, confidence, chunk]
            else:
                mine.append([eid, text, confidence, chunk])
        elif confidence > rep[2]:
            rep[1:] = [text, confidence, chunk]
    return {k: sorted(v) for k, v in kept.items()}


def forms(df):
    rows = df.select("label", "text", E.normalize_entity(F.col("text")).alias("n"), E.entity_id(F.col("label"), F.col("text")).alias("i")).distinct().collect()
    return {r["text"]: r["n"] for r in rows}, {(r["label"], r["text"]): r["i"] for r in rows}


def kept_rows(df):
    got = {}
    for r in df.collect():
        got.setdefault((r["doc_id"], r["label"]), []).append([r["entity_id"], r["text"], r["confidence"], r["chunk_id"]])
    return {k: sorted(v) for k, v in got.items()}


def test_fuzzy_dedupe_against_a_plain_loop(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(30)] + ["!!", "??", "Москва", "Москвы", "", " ", "aaaaaaaaaaaaaaaaaaab", "x" * 300]
    names += ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 40))) for _ in range(15)]
    names += [n[:k] + rng.choice("abz") + n[k + rng.randint(0, 1) :] for n in names[-15:] for k in rng.sample(range(len(n)), 3)]
    rows = [(rng.randrange(4), f"c{k // 9}", rng.choice(["ORG", "PER"]), rng.choice(names), rng.randrange(10) / 10, k, k + 3) for k in range(900)]
    df = entities(spark, rows)
    want = plain_dedupe([(d, label, t, c, chunk) for d, chunk, label, t, c, _, _ in rows], *forms(df))
    assert kept_rows(N.dedupe_fuzzy(df)) == want


def test_fuzzy_dedupe_of_many_names(spark):
    """Twenty thousand names of one document: a name is compared with few others."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(5, 9)))
    names = [f"{word()} {word()}" for _ in range(20_000)]
    rows = [(1, "c", "PER", n, 0.5, k, k) for k, n in enumerate(names + names[:3000])]
    assert N.dedupe_fuzzy(entities(spark, rows)).count() == len(set(names))


def test_rank_of_the_source_comes_before_place(spark):
    rows = [(1, "c0", "ORG", "Acme Corp", 0.5, 900, 909, 0), (1, "c1", "ORG", "Acme Corq", 0.5, 0, 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_id string, label string, text string, confidence double, start long, end long, source_rank long")
    assert [(r["text"], r["chunk_id"]) for r in N.dedupe_fuzzy(df).collect()] == [("Acme Corp", "c0")]
    assert [(r["text"], r["chunk_id"]) for r in N.dedupe_fuzzy(df.drop("source_rank")).collect()] == [("Acme Corq", "c1")]


def test_entity_pipeline_against_a_plain_loop(spark, sf_dir):
    mentions = result_queries.entity_mentions(spark, sf_dir)
    rows = mentions.orderBy("doc_id", "label", "source_rank", "start", "end", "text").select("doc_id", "label", "text", "confidence", "chunk_id").collect()
    got = kept_rows(result_queries.entity_pipeline(spark, sf_dir))
    assert got == plain_dedupe([tuple(r) for r in rows], *forms(mentions))
    ids = {(d, chunk, i) for (d, _), v in got.items() for i, _, _, chunk in v}
    chunks = spark.createDataFrame(sorted({(d, c) for d, c, _ in ids}), "doc_id long, chunk_id string")
    by_chunk = R.chunk_entity_ids(chunks, result_queries.entity_pipeline(spark, sf_dir)).collect()
    assert {(r["doc_id"], r["chunk_id"], i) for r in by_chunk for i in r["entity_ids"]} == ids


def test_rules_keep_the_place_of_their_own_chunk(spark, tmp_path):
    """Documents with one id, or none, give each match once, at its chunk's place, and no text goes through a join."""
    rows = [(1, "write to a@b.org now", "en", "s"), (1, "x" * 30 + " c@d.org", "en", "s"), (None, "or e@f.org", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = result_queries.entity_mentions(spark, str(tmp_path)).filter("source_rank = 1")
    assert sorted((str(r["doc_id"]), r["text"], r["start"], r["end"]) for r in got.collect()) == [("1", "a@b.org", 0, 20), ("1", "c@d.org", 0, 38), ("None", "e@f.org", 0, 10)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_each_rule_alone(spark):
    """A text that holds nothing but one rule's match, so that nothing else in it opens the rule's gate."""
    texts = [
        "a@b.org", "+34 912 345 678", "4111111111111111", "ES9121000418450200051332", "BE68539007547034", "12345678Z", "X1234567L", "B1234567J", "ESABCDEFGHI", "1234 BCD",
        "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "41° 24' 12.2\" N, 2° 10' 26.5\" E", "41.40338, 2.17403", "12d, 3d", "https://www.a.org/x", "1.2.3.4", "AB:BB:CC:DD:EE:FF", "#año", "@yo", "29-02-2024",
        "2024-03-08", "8 de marzo de 2023", "March 8, 2023", "enero de 2020", "May 2020",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("chunk_id", F.lit("c"))
    found = [(k, label, m) for k, t in enumerate(texts) for label, p in N.RULES for m in re.findall(p, t, re.ASCII)]
    assert {k for k, _, _ in found} == set(range(len(texts)))
    raw = spark.createDataFrame(found, "doc_id long, label string, raw string")
    unchecked = F.col("label").isin("IPV4", "MAC_ADDRESS", "PASSPORT_EU", "HASHTAG", "SOCIAL_MENTION")
    date = F.when(F.col("label") == "DATE", E.normalize_date(F.col("raw")))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "label", "text").collect()))
    for strict in (False, True):
        good = raw.filter((unchecked & F.lit(not strict)) | date.isNotNull() | E.is_valid(F.col("label"), F.col("raw"))).select("doc_id", "label", F.coalesce(date, "raw").alias("text"))
        assert rows(N.regex_entities(df, strict=strict)) == rows(good)


def test_ids_of_chunks_are_those_of_kept_entities(spark):
    rows = [(1, "c0", "ORG", "Acme Corp", 0.5, 0, 9), (1, "c1", "ORG", "Acme Corq", 0.9, 50, 59), (1, "c2", "ORG", "Other", 0.1, 90, 95)]
    kept = N.dedupe_fuzzy(entities(spark, rows))
    chunks = spark.createDataFrame([(1, "c0"), (1, "c1"), (1, "c2")], "doc_id long, chunk_id string")
    ids = forms(entities(spark, rows))[1]
    got = {r["chunk_id"]: r["entity_ids"] for r in R.chunk_entity_ids(chunks, kept).collect()}
    assert got == {"c0": [], "c1": [ids["ORG", "Acme Corp"]], "c2": [ids["ORG", "Other"]]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("한국", "hangug"), ("김철수", "gimceolsu"), ("とうきょう", "toukiyou"), ("トヨタ", "toyota"), ("すし つち", "sushi tsuchi"), ("שלום", "shlvm"), ("محمد", "mhmd"), ("مرحبا ١٢", "mrhb 12"),
        ("भारत", "bhaart"), ("हिन्दी", "hindii"), ("বাংলা", "baanlaa"), ("თბილისი", "tbilisi"), ("Nguyễn Ạnh", "nguyen anh"), ("Ǆ ﬁ", "dz fi"), ("ＡＢＣ１", "abc1"), ("Ё́лка", "elka"), ("ế", "e"),
        ("東京 Tower", "東京 tower"), ("😀 Ω", "o"), ("e\u0301", "e"), ("", ""), ("Straße’s", "strasses"),
    ],
)
def test_names_of_any_script(spark, text, want):
    got = spark.createDataFrame([(text,), (None,)], "text string").select(E.normalize_entity(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in got] == [want, None]


def test_names_of_other_scripts_are_apart(spark):
    names = ["Москва", "Київ", "東京", "北京", "Αθήνα", "القاهرة", "!!!", "???", "", "Zürich", "zurich", "Łódź", "Lodz", "Straße", "STRASSE"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, text string")
    rows = df.withColumn("n", E.normalize_entity(F.col("text"))).withColumn("e", E.entity_id(F.lit("LOC"), F.col("text"))).orderBy("i").collect()
    assert [r["n"] for r in rows] == ["moskva", "kiyiv", "東京", "北京", "athena", "lqhr", "", "", "", "zurich", "zurich", "lodz", "lodz", "strasse", "strasse"]
    ids = [r["e"] for r in rows]
    assert len(set(ids)) == 12 and ids[9] == ids[10] and ids[11] == ids[12] and ids[13] == ids[14]
    refs = df.select(F.lit(1).cast("long").alias("doc_id"), F.lit("c").alias("chunk_id"), F.col("text").alias("ref"))
    known = df.select(F.lit(1).cast("long").alias("doc_id"), "text", F.col("i").cast("string").alias("entity_id"))
    assert {r["ref"] for r in N.resolve_exact(refs, known).filter("entity_id is null").collect()} == {"!!!", "???", ""}


def test_boundaries_from_one_side_find_the_same(spark):
    rng = random.Random(9)
    parts = ["é", "_", " ", "-", "4111111111111111", "12345678Z", "ES9121000418450200051332", "X1234567L", "1234 BCD", "a@b.org", ".", "%", "1.2.3.4", "2024-03-08", "8 March 2023", "12°, 3°", "41.4, 2.1", "ESA12345678", "5"]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(8)),) for _ in range(300)], "t string")
    for label, p in N.RULES:
        both = [F.regexp_extract_all("t", F.lit(x), F.lit(0)) for x in (E.ascii_boundary(p), E.ascii_boundary(p, label not in N.OPEN_FIRST, label not in N.OPEN_LAST))]
        gate = F.rlike("t", F.lit(N.GATES[label])) | (F.size(both[0]) == 0)
        assert df.filter(~both[0].eqNullSafe(both[1]) | ~gate).count() == 0, label


def test_rules_against_python(spark, sf_dir):
    """All rules over the given documents against Python's matches, judged by the same checks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("c").alias("chunk_id"), "text")
    planted = (
        "ES9121000418450200051332, GB82WEST12345698765432 y 12345678Z X1234567L B1234567J ESA12345678 é1234 BCD 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa "
        "41° 24' 12.2\" N, 2° 10' 26.5\" E 41.40338, 2.17403 12°, 3° https://www.a.org/é?x=1 00:1B:44:11:3A:B7 #año @yo +34 912 345 678 "
        "Tel: +34 91 234 567 29/02/2023 29-02-2024 2024-03-08 8 de marzo de 2023 March 8, 2023 8 Mar 2023 enero de 2020 January 1890 May 2020"
    )
    docs = docs.unionByName(spark.createDataFrame([(-1, "c", planted)], docs.schema))
    found = [(r["doc_id"], label, m) for r in docs.collect() for label, p in N.RULES for m in re.findall(p, r["text"] or "", re.ASCII)]
    assert len({label for _, label, _ in found}) > 15
    raw = spark.createDataFrame(found, "doc_id long, label string, raw string")
    unchecked = F.col("label").isin("IPV4", "MAC_ADDRESS", "PASSPORT_EU", "HASHTAG", "SOCIAL_MENTION")
    date = F.when(F.col("label") == "DATE", E.normalize_date(F.col("raw")))
    good = raw.filter(unchecked | date.isNotNull() | E.is_valid(F.col("label"), F.col("raw"))).select("doc_id", "label", F.coalesce(date, "raw").alias("text"))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "label", "text").collect()))
    assert rows(N.regex_entities(docs, strict=False)) == rows(good)


def test_heuristic_places(spark):
    text = "Ana Ruiz paid €5 on 1/2/2024; xAna Ruiz, Ana Ruiz and Bob Lee. 1/2/2024"
    df = spark.createDataFrame([(1, "c", text), (2, "c", ""), (3, "c", None)], "doc_id long, chunk_id string, text string")
    got = N.heuristic_matches(df).collect()
    assert all(text[r["start"] : r["end"]] == r["text"] for r in got)
    assert sorted((r["start"], r["label"]) for r in got if r["label"] in ("PER", "DATE")) == [(0, "PER"), (20, "DATE"), (41, "PER"), (54, "PER"), (63, "DATE")]


def test_merge_windows(spark):
    rows = [(1, 0, "PER", "Tim Cook", 0.8, 100, 108), (1, 1, "PER", "Tim Cook", 0.9, 100, 108), (1, 1, "PER", "Ana", 0.7, 400, 403), (1, 0, "ORG", "Apple", 0.9, 5, 10)]
    df = spark.createDataFrame(rows, "doc_id long, window_index long, label string, text string, confidence double, start long, end long")
    assert sorted((r["text"], r["confidence"]) for r in N.merge_windows(df).collect()) == [("Ana", 0.7), ("Apple", 0.9), ("Tim Cook", 0.9)]


def test_merge_windows_against_a_plain_loop(spark):
    rng = random.Random(12)
    names = ["Tim Cook", "Cook", "tim", "Ana B", "Apple", "apple inc.", "Zoé", "x"]
    rows = []
    for doc in range(3):
        for k in range(150):
            start = rng.randint(0, 900)
            rows.append((doc, k // 30, rng.choice(["PER", "ORG"]), rng.choice(names), rng.randrange(9) / 10, start, start + rng.choice([3, 9, 400])))
    df = spark.createDataFrame(rows, "doc_id long, window_index long, label string, text string, confidence double, start long, end long")
    norm = {r["text"]: r["n"] for r in df.select("text", E.normalize_entity(F.col("text"), keep_marks=True).alias("n")).distinct().collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[5], r[6], r[3])):
        mine = want.setdefault((r[0], r[2]), [])
        for k in reversed(range(len(mine))):
            m = mine[k]
            if r[5] <= m[6] + 20 and m[5] <= r[6] + 20 and N.token_set_ratio(norm[m[3]], norm[r[3]]) >= 80:
                mine[k] = r if r[4] > m[4] else m
                break
        else:
            mine.append(r)
    got = sorted((r["doc_id"], r["window_index"], r["label"], r["text"], r["confidence"], r["start"], r["end"]) for r in N.merge_windows(df).collect())
    assert got == sorted(r for v in want.values() for r in v)


def test_heuristics_of_odd_texts(spark):
    rows = [(1, "a", None), (1, "b", ""), (2, "c", "PAID 30 EUR, 1/2/24 in ſpain; MÁLAGA gmbh"), (2, "d", "x" * 100_000 + " Ana Ruiz 3 march 2024 March 3 2024")]
    got = N.heuristic_matches(spark.createDataFrame(rows, "doc_id int, chunk_id string, text string")).collect()
    assert {(r["chunk_id"], r["label"], r["text"]) for r in got} == {
        ("c", "MONEY", "30 EUR"), ("c", "DATE", "1/2/24"), ("c", "LOC", "ſpain"), ("c", "LOC", "MÁLAGA"), ("c", "ORG", "gmbh"),
        ("d", "PER", "Ana Ruiz"), ("d", "DATE", "3 march 2024"), ("d", "DATE", "March 3 2024"),
    }
    assert all(r["start"] + len(r["text"]) == r["end"] for r in got)


@pytest.mark.parametrize(("a", "b", "want"), [("abcdefghijkl", "abcdefxghijkl", 96.0), ("", "", 100.0), ("a", "b", 0.0), ("abc", "abc", 100.0)])
def test_ratio(a, b, want):
    assert N.indel_ratio(a, b) == pytest.approx(want)


def test_resolve_refs(spark):
    ents = spark.createDataFrame([(1, "Acme Corporation", "e1"), (1, "Jane Smith", "e2"), (2, "Acme Corporation", "e3")], "doc_id long, text string, entity_id string")
    refs = spark.createDataFrame([(1, "c", "ACME corporation!"), (1, "c", "Jane Smit"), (1, "c", "Unknown"), (1, "c", "acme corporation"), (2, "c", "Jane Smith")], "doc_id long, chunk_id string, ref string")
    got = {r["doc_id"]: r["entity_ids"] for r in N.resolve_refs(refs, ents).collect()}
    assert got == {1: ["e1", "e2"]}


def test_resolve_refs_against_all_pairs(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
    ents = [(doc, name(), f"e{doc}-{k:02d}") for doc in range(3) for k in range(25)]
    refs = [(rng.randrange(3), f"c{k % 40}", name()) for k in range(300)]
    want = {}
    for doc, chunk, ref in refs:
        exact = sorted(e for d, n, e in ents if d == doc and n == ref)
        near = max(((N.indel_ratio(ref, n), e) for d, n, e in ents if d == doc and N.indel_ratio(ref, n) >= 85), default=None)
        if exact or near:
            want.setdefault((doc, chunk), set()).add(exact[0] if exact else near[1])
    got = N.resolve_refs(
        spark.createDataFrame(refs, "doc_id long, chunk_id string, ref string"), spark.createDataFrame(ents, "doc_id long, text string, entity_id string")
    ).collect()
    assert {(r["doc_id"], r["chunk_id"]): set(r["entity_ids"]) for r in got} == want


def test_model_keeps_large_ids_beside_null(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(None, 0, 0, "a"), (big, 1, 0, "b")], "doc_id long, window_index long, offset long, text string").coalesce(1)
    got = N.model_entities(df, lambda texts: [[(t, "ORG", 0.9, 0, 1)] for t in texts]).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(None, "a"), (big, "b")}


def test_model_retries_one_by_one(spark):
    def predict(texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise RuntimeError("no")
        return [[(t, "ORG", 0.9, 0, len(t))] for t in texts]

    df = spark.createDataFrame([(1, 0, 10, "ok"), (1, 1, 20, "bad"), (1, 2, 30, "fine")], "doc_id long, window_index long, offset long, text string").coalesce(1)
    assert sorted((r["text"], r["start"]) for r in N.model_entities(df, predict).collect()) == [("fine", 30), ("ok", 10)]


def test_references_are_resolved_from_one_reading(spark, sf_dir):
    """The plan reads what was worked out once, never the documents again."""
    from corpusloom.plans import result_queries

    plan = result_queries.resolve_entity_refs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan
