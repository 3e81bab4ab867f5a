"""Conversation repair, source audit and personal data against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import conversation_repair, personal_data, source_audit
from corpusloom.llm.queries import op11_conversation_repair, op12_source_audit, op13_personal_data
from corpusloom.llm.queries import oracle_sql
from tests.oracle import connect, spark_rows, sql_rows

TURNS = "conv_id long, turn long, role string, text string"


# Conversation repair


def cheapest(initials, faults):
    """Every sequence of edits up to a bound on insertions, in order of (cost, audit)."""
    best = None
    n = len(initials)
    options = []
    for x, fault in zip(initials, faults, strict=True):
        extra = 5 if fault == conversation_repair.TRUNCATED_ROW else 0
        row = [("D", 2, "")]
        if fault not in (conversation_repair.BLANK, conversation_repair.DUPLICATE):
            row += [("K", extra, x or "#")] + [("R", 1 + extra, r) for r in "ua"]
        options.append(row)
    slots = [[()], [("u",), ("a",)], [p for p in itertools.product("ua", repeat=2)]]
    for chosen in itertools.product(*options):
        for counts in itertools.product(range(3), repeat=n + 1):
            if sum(counts) > 2:
                continue
            for fills in itertools.product(*[slots[c] for c in counts]):
                roles, audit, cost = "", "", 0
                for k in range(n + 1):
                    roles += "".join(fills[k])
                    audit += "I" * counts[k]
                    cost += 5 * counts[k]
                    if k < n:
                        letter, price, role = chosen[k]
                        audit, cost, roles = audit + letter, cost + price, roles + role
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.integers(0, 3)), max_size=4))
def test_lightest_repair_is_the_cheapest_and_least(rows):
    initials, faults = [r[0] for r in rows], [r[1] for r in rows]
    assert conversation_repair.lightest_repair(initials, faults) == cheapest(initials, faults)


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """The whole report, with the costs by dynamic programming over (row, state) and audits as texts."""
    by_conv = defaultdict(list)
    for r in rows:
        by_conv[r[0]]
    for r in hurt(rows):
        by_conv[r[0]].append(r)
    report = {}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in turns:
            body = text.rstrip(" \t\n\r\x0b\x0c")
            faults.append(0 if not body else 1 if (role, text) in seen else 3 if body[-1] in ".!?" else 2)
            seen.add((role, text))
        initials = [r[2][:1] for r in turns]
        nxt = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
        far = (10**9, "", [])
        tail = [(0, "", []), far, far, (0, "", [])]

        def with_insertions(now, nxt=nxt):
            for _ in range(4):
                now = [min([x] + [(now[q][0] + 5, "I" + now[q][1], [(r, "")] + now[q][2]) for r, q in step.items() if r != "s"], key=lambda v: v[:2]) for x, step in zip(now, nxt, strict=True)]
            return now

        tail = with_insertions(tail)
        for (_, _, role, text), fault, initial in reversed(list(zip(turns, faults, initials, strict=True))):
            now = []
            for p, step in enumerate(nxt):
                c = [(tail[p][0] + 2, "D" + tail[p][1], tail[p][2])]
                if fault >= 2:
                    extra = 5 if fault == 2 else 0
                    if initial in step:
                        q = tail[step[initial]]
                        c.append((q[0] + extra, "K" + q[1], [(role, text)] + q[2]))
                    for r, state in step.items():
                        if r != "s":
                            q = tail[state]
                            c.append((q[0] + 1 + extra, "R" + q[1], [(r, text)] + q[2]))
                now.append(min(c, key=lambda v: v[:2]))
            tail = with_insertions(now)
        cost, audit, kept = tail[0]
        full = {"u": "user", "a": "assistant"}
        body = "\n".join(f"{full.get(r, r)}:{t}" for r, t in kept)
        at = [r[1] for r in turns if r[1] is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        report[conv] = (gaps, faults.count(0), faults.count(1), faults.count(2), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return report


def spark_repair(df):
    out = conversation_repair.repair_digest(conversation_repair.damage(df))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = out.collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_repair_of_hard_conversations(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "open end", "", "  \n", "Yes.  ", "ü?", None, "a.\x0b"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(300) for t in range(rng.randrange(9))]
    rows += [(None, k % 7 if k % 3 else None, "user", "Yes.") for k in range(30)]  # a null conversation with tied and null turns
    rows += [(-5, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(3000)]  # a long one
    rows += [(-6, None, None, None), (-7, 2**40, "user", "x" * 300_000 + ".")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'z' AS part", "1 AS gone_", "2 AS place")
    assert spark_repair(df) == plain_repair(rows)


def test_repair_of_the_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in op11_conversation_repair(spark, sf_dir).collect()}
    assert got == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_turns_follow_the_grammar(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "cut"), (2, 0, "assistant", "Well."), (3, 5, "user", "")]
    df = spark.createDataFrame(rows, TURNS)
    repairs = conversation_repair.find_repairs(df)
    assert {r.conv_id: r.audit for r in repairs.collect()} == {1: "KRD", 2: "D", 3: "D"}
    kept = conversation_repair.repaired_turns(df, repairs).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in kept] == [(1, 0, 0, "user", "Hi.", "K"), (1, 1, 1, "assistant", "Hello?", "R")]


def test_repair_of_an_empty_table(spark):
    assert spark_repair(spark.createDataFrame([], TURNS)) == {}


# Source audit


def plain_counts(rows):
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        low = ["".join(c.lower() if c.isascii() else c for c in x) for x in found]
        for x in low:
            n[lang or "", source or "", x] += 1
        for x in set(low):
            docs[lang or "", source or "", x] += 1
    return {k: (v, docs[k]) for k, v in n.items()}


def plain_divergence(rows, least, top=50):
    c = plain_counts(rows)
    docs, n, groups = Counter(), Counter(), sorted({(a or "", b or "") for a, b, _ in rows})
    for (lang, _, x), (k, d) in c.items():
        docs[lang, x] += d
        n[lang, x] += k
    out = []
    for lang, source in groups:
        kept = [x for (y, x), d in docs.items() if y == lang and d >= least]
        total = lambda s: sum(c.get((lang, s, x), (0, 0))[0] for x in kept)  # noqa: B023, E731
        p = lambda k, t: 1 + 10**9 * (k + 5) // (t + 5 * len(kept))  # noqa: B023, E731
        of = lambda s: {x: p(c.get((lang, s, x), (0, 0))[0], total(s)) for x in kept} if kept else {}  # noqa: B023, E731
        mine, whole = of(source), sum(n[lang, x] for x in kept)
        pairs = [(s, sum(abs(mine[x] - q) for x, q in of(s).items())) for y, s in groups if y == lang and s != source]
        terms = [(x, mine[x] - p(n[lang, x], whole)) for x in kept if c.get((lang, source, x), (0, 0))[0] and mine[x] > p(n[lang, x], whole)]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda v: (-v[1], v[0].encode()))
            out += [(lang, source, part, x, v, k) for k, (x, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus():
    rng = random.Random(9)
    words = ["a", "Bc", "ÀÉ", "straße", "x" * 8, "y" * 9, "z" * 16, "W" * 17, "v" * 40, "ü" * 30, "中文" * 12, "naïve", "ZZ", "abcdefgh", "abcdefghi"]
    words += ["".join(rng.choice("abcXYZé") for _ in range(rng.randrange(1, 22))) for _ in range(60)]
    sep = [" ", "1", "_", "\x00", "@", "[", "\x7f", "\n", "-"]
    rows = []
    for k in range(400):
        text = "".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "de", None]), rng.choice(["hot"] * 6 + ["s1", "s2", None]), text))
    rows += [("fr", "empty", ""), ("fr", "other", None), ("de", "none", "12 34"), ("en", "hot", "long word " * 9000 + "q" * 70_000 + "a Bc"), ("en", "s1", "é" * 50_001)]
    return rows + rows[:20]


def test_term_counts_of_any_chunk(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    want = plain_counts(rows)
    for chunk in (200, 5000, 8 << 20):
        got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in source_audit.term_counts(df, chunk).collect()}
        assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20).map(lambda b: bytes(x | 0x80 for x in b)), max_size=60), st.integers(1, 3))
def test_packed_runs(terms, docs):
    terms.sort(key=len, reverse=True)
    doc = np.sort(np.arange(len(terms)) % docs)
    data = np.frombuffer(b"".join(terms) + b"\0" * 16, np.uint8)
    size = np.array([len(t) for t in terms], np.int64)
    row, n, d = source_audit.count_terms(data, np.cumsum(size) - size, size, np.zeros(len(terms), np.int64), doc)
    assert {terms[i]: (k, j) for i, k, j in zip(row, n, d, strict=True)} == {t: (c, len({x for x, y in zip(doc, terms, strict=True) if y == t})) for t, c in Counter(terms).items()}


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) & np.uint64(0xF00000000000000F), rng.integers(0, 3, 500, dtype=np.uint64)]
    assert (source_audit.radix_order(words) == np.lexsort((np.arange(500), words[1], words[0]))).all()


@pytest.mark.parametrize("blocks", [(4096, 128), (7, 2)])
def test_divergence(spark, monkeypatch, blocks):
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", blocks[0])
    monkeypatch.setattr(source_audit, "TILE_SOURCES", blocks[1])
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS n", "3 AS p", "4 AS tile")
    got = source_audit.divergence(df, least_docs=12, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, 12, 5)


def test_divergence_of_little(spark):
    schema = "lang string, source string, text string"
    assert source_audit.divergence(spark.createDataFrame([], schema)).collect() == []
    rows = [("en", "a", "x y"), ("en", "b", None)]
    assert sorted(tuple(r) for r in source_audit.divergence(spark.createDataFrame(rows, schema)).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    good = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    return {(kind, m.start(), m.end()) for kind, pattern in BASE.items() for m in re.finditer(pattern, text) if good[kind](m[0])}


PIECES = ["joe", ".", "@", "mail.example.com", "a-b", "1", "255", "256", ".1", "4539148803436467", "4539 1488 0343 6467", "+49 (170) 555-1234", "+", " ", "  ", "-", "é", "(", "007", "\n", "%", "_", "192.168.1.10"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_plain_spans_are_the_matches(text):
    found = personal_data.detect(text)
    assert len(set(found)) == len(found)
    assert set(found) == plain_spans(text)


DISGUISED = [
    ("email", "john dot smith at example dot com"), ("email", "john [at] example [dot] com"), ("email", "john(at)example(.)co(.)uk"), ("email", "j.doe [AT] Mail.Example.ORG"),
    ("email", "jоhn@exаmple.com"), ("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("email", "jo​hn@exam­ple.com"), ("email", "ana arroba ejemplo punto es"), ("email", "a.b@mail.example[.]com"),
    ("ip", "192[.]168[.]1[.]10"), ("ip", "one nine two dot one six eight dot one dot one"), ("ip", "10 dot 0 dot 0 dot 255"), ("ip", "１９２．１６８．０．１"),
    ("card", "four five three nine one four eight eight zero three four three six four six seven"), ("card", "4539 1488 O343 6467"), ("card", "٤٥٣٩١٤٨٨٠٣٤٣٦٤٦٧"), ("card", "4539‑1488‑0343‑6467"),
    ("phone", "plus four nine one seven zero five five five one two three four"), ("phone", "+４９ 170 ５５５ 1234 5"), ("phone", "+49 170 five five five one two three four"),
]
CLEAN = [
    "look at example.com, polka dot dress", "one of two, un deux trois, at the end dot", "call me at home. 12 at 3 dot 4", "+1 (848) 555-1373 Un an", "Привет, мир. почта", "naïve café ＡＢＣ",
    "version 1.2.3 and O0 l1", "null eins zwei 5 6", "x [at] y", "see (.) and [@]", "ο λόγος 12", "at at at dot dot dot",
]


@pytest.mark.parametrize(("kind", "identifier"), DISGUISED)
def test_disguised_spans_map_back(kind, identifier):
    for before, after in (("", ""), ("Write — to: ", ", please."), ("é​ ", "\nnext"), ("word, ", "; 12 at x")):
        text = before + identifier + after
        plain = personal_data.detect(text)
        found = personal_data.disguised(text, plain)
        assert (kind, len(before), len(before) + len(identifier)) in found


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay_clean(text):
    plain = personal_data.detect(text)
    assert personal_data.disguised(text, plain) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["one ", "five", " ", "dot", "[at]", "a", "@", ".", "1", "O", "​", "о", "+", "plus ", "４", "com", "\n", "-"]), max_size=30).map("".join))
def test_disguised_spans_lie_in_the_text(text):
    plain = personal_data.detect(text)
    for kind, a, b in personal_data.disguised(text, plain):
        assert kind in personal_data.KINDS and 0 <= a < b <= len(text) and (kind, a, b) not in plain


def test_personal_data_table(spark):
    long = "x" * 400_000 + " joe@example.com " + "7" * 400_000
    rows = [(1, "joe@example.com, 10.0.0.1"), (1, "joe@example.com, 10.0.0.1"), (2, None), (3, ""), (None, "+49 170 5551234"), (4, long), (5, "joe [at] example [dot] com")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'b' AS base", "0 AS spans", "1 AS kind")
    got = sorted((tuple(r) for r in personal_data.personal_data_digest(df).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = (1, 1, 1, 0, 0, sha("email:0:15,ip:17:25"), "email:0:15,ip:17:25")
    at = "email:400001:400016"
    want = [one, one, (2, 0, 0, 0, 0, sha(""), ""), (3, 0, 0, 0, 0, sha(""), ""), (None, 0, 0, 0, 1, sha("phone:0:15"), "phone:0:15"), (4, 1, 0, 0, 0, sha(at), at), (5, 1, 0, 0, 0, sha(""), "email:0:26")]
    assert got == sorted(want, key=repr)
    assert personal_data.personal_data_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_queries_against_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name, query in (("op12_source_audit", op12_source_audit), ("op13_personal_data", op13_personal_data)):
        cols, rows = spark_rows(query(spark, sf_dir))
        assert (cols, rows) == sql_rows(con, oracle_sql()[name])
        assert rows
