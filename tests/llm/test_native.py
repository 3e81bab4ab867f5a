"""URL filter, chat formatting and decontamination: fixed cases and brute force."""

import hashlib
import itertools
import random
import re

import pytest

from corpusloom.llm import chat_format as C
from corpusloom.llm import decontaminate as D
from corpusloom.llm import url_filter as U

URLS = [
    ("http://Example.COM/en/x?q=1#f", "example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://m.www.example.com/en/a", "m.www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    ("http://a.net/es", "a.net", "/es", None, "allow"),
    ("http://a.net?x=/es/", "a.net", "", None, "allow"),
    ("http://b.net/fr/#x", "b.net", "/fr/", "net/fr/", "block"),
    ("http://com", "com", "", None, "allow"),
    ("nothing here", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("ftp://X.ORG/com/", "x.org", "/com/", None, "allow"),
    ("http://ÄB.com/é\n", "Äb.com", "/é\n", "com/", "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "old", 1) for i, u in enumerate(URLS)] + [(99, URLS[0][0], "old", 1)], "page_id long, url string, Host string, verdict int")
    assert U.filter_urls(df.withColumnRenamed("Host", "best"), U.RULES).columns == ["page_id", "url", "best", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: r for r in U.filter_urls(df, U.RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict)
    assert got[99]["rule"] == got[0]["rule"]


@pytest.mark.parametrize("most", [U.MAX_RULES, 10])
def test_urls_against_all_rules(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MAX_RULES", most)  # by a literal map, or by a join
    rng = random.Random(3)
    part = lambda xs, lo, hi: [rng.choice(xs) for _ in range(rng.randint(lo, hi))]
    rules = list(dict.fromkeys(
        U.Rule(rng.choice(["allow", "block"]), ".".join(part(["a", "b", "c+", "d"], 1, 3)) + "/" + "".join(x + "/" for x in part(["x", "y.z", "w"], 0, 2)) + rng.choice(["", "p"])) for _ in range(120)
    ))
    urls = ["h://" + ".".join(part(["a", "b", "c+", "d"], 1, 4)) + "/" + "/".join(part(["x", "y.z", "w", "pq"], 0, 3)) for _ in range(400)]
    got = {r["url"]: r for r in U.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    for u in urls:
        host, _, path = u[4:].partition("/")
        fit = [r for r in rules if (host == r.host() or host.endswith("." + r.host())) and ("/" + path).startswith(r.path())]
        best = max(fit, key=lambda r: (len(r.pattern), r.verdict == "block", r.pattern), default=None)
        assert got[u]["rule"] == (best.pattern if best else None)
        assert got[u]["verdict"] == (best.verdict if best else "allow")


def test_urls_with_line_breaks(spark):
    """A host may hold a line break; the rule's host must end where the url's does, whatever the path holds."""
    rows = [(1, "http://a\nb.com/x"), (2, "http://a/x.com\n/en/"), (3, "http://www.example.com\n/en/"), (4, "http://q.example.com/en/\n")]
    got = {r["page_id"]: r["rule"] for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), U.RULES).collect()}
    assert got == {1: "com/", 2: None, 3: None, 4: "example.com/en/"}


def test_urls_empty_and_bounds(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(df, U.RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert U.filter_urls(one, [], default="block").first()["verdict"] == "block"
    many = [U.Rule("block", f"h{i}.org/") for i in range(U.MAX_RULES + 1)]
    long = spark.createDataFrame([(1, "http://h7.org/" + "x" * 300_000), (2, f"http://a.h{U.MAX_RULES}.org/"), (3, "http://none.org/"), (4, None), (4, None)], "page_id long, url string")
    for rules in (many, many[:8]):
        got = sorted((r["page_id"], r["rule"]) for r in U.filter_urls(long, rules).collect())
        assert got[0] == (1, "h7.org/") and len(got) == 5
        assert got[1] == (2, f"h{U.MAX_RULES}.org/" if rules is many else None) and got[2:] == [(3, None), (4, None), (4, None)]


def chats():
    rng, nasty = random.Random(5), ["", "&", "<|", "&lt;|", "<|im_end|>\n", "<|im_start|>user\n", "&amp;", "</s>[INST] ok [/INST]", "é😀\n", "<", "|im_end|>", "\n\n"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool\n<|x", None])
            text = rng.choice([None, "".join(rng.choice(nasty) for _ in range(rng.randint(0, 6)))])
            rows.append((conv, turn, role, text, "x"))
    rows += [(101, k, "assistant" if k % 2 else "user", f"<|im_end|>\n{k}", "x") for k in range(120)] + [(102, 0, "user", "é<|" * 100_000, "x"), (102, 1, "assistant", "&" * 100_000, "x")]
    return rows + [(100, 0, "assistant", "a", "x"), (100, 0, "assistant", "a", "x"), (None, None, "user", "n", "x")]


def test_chat_round_trip(spark):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    examples = C.format_examples(df)
    got = {r["conv_id"]: r for r in C.digest(examples).collect()}
    convs = {}
    for conv, turn, role, text, _ in rows:
        convs.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in examples.collect():
        mine = sorted(convs[r["conv_id"]])[: r["example"] + 1]
        assert r["text"].count(C.START) == r["text"].count(C.END) == len(mine)
        assert r["loss_to"] == r["loss_from"] or mine[-1][1] == "assistant"


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digest(C.format_examples(df)).count() == 0


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best_window(a, b, size):
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        eq = [int(0 <= i + shift < len(a) and a[i + shift] == b[i]) for i in range(len(b))]
        best = max([best] + [sum(eq[i : i + size]) for i in range(max(1, len(b) - size + 1))])
    return best


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.randint(20, 40))) for i in range(12)] + [(90, text(9)), (91, []), *((100 + n, text(n)) for n in range(2, 8))]
    docs = []
    for i in range(60):
        d = text(rng.randint(0, 80))
        if i % 3 == 0:
            b = list(rng.choice(items[:13])[1])
            for k in range(0, len(b), rng.choice([100, 7, 9])):
                b[k] = "swapped"
            at = rng.randint(0, len(d))
            d = d[:at] + b + d[at:]
        docs.append((i, " ".join(d).title() if i % 2 else ", ".join(d), i))
    docs += [(500, None, 0), (501, "", 0), (0, docs[0][1], 0), (502, " ".join(text(30_000)), 0), (None, " ".join(items[0][1]), 0)]
    bench = spark.createDataFrame([(i, " ".join(b), "x") for i, b in items] + [(0, " ".join(items[0][1]), "x"), (92, None, "x"), (None, " ".join(items[1][1]), "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["tokens_equal"] for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id long"), bench).collect()}
    want = {}
    for i, d, _ in docs:
        for k, b in items if i is not None and i != 502 else ():
            size = min(D.WINDOW, len(b))
            if b and (n := best_window(tokens(d), b, size)) >= -(-size * D.LEAST // D.WINDOW):
                want[i, k] = n
    got = {k: n for k, n in got.items() if k[0] != 502}
    assert set(got) == set(want)
    assert all(got[k] <= want[k] for k in got)
    seven = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id long"), bench, 7).collect() if r["doc_id"] != 502}
    assert seven == {k for k in want if len(dict(items)[k[1]]) >= 7}


def test_leaks_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(10)], "doc_id long, text string")
    bench = docs.selectExpr("doc_id as item_id", "text").filter("item_id < 5")
    one = sorted(map(tuple, D.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_TOKENS", 40)
    assert sorted(map(tuple, D.find_leaks(docs, bench).collect())) == one
    assert [r[0] for r in one] == [0, 1, 2, 3, 4]
    assert D.find_leaks(docs.limit(0), bench).count() == 0
    assert D.find_leaks(docs, bench.limit(0)).count() == 0


def test_masks_hit_every_window():
    for size in range(1, D.WINDOW + 1):
        masks = D.MASKS + D.MORE + (D.SHORT if size < D.WINDOW else ()) if size > 6 else D.BRIEF[size]
        laid = [{o + i for i, c in enumerate(m) if c == "1"} for m in masks for o in range(size - len(m) + 1)]
        for swapped in itertools.combinations(range(size), size + (-size * D.LEAST // D.WINDOW)):
            assert any(not at & set(swapped) for at in laid), (size, swapped)


def test_no_leak_is_missed(spark):
    long = [f"w{k}" for k in range(59)]
    brief = {n: [f"b{n}x{k}" for k in range(n)] for n in range(7, 13)}
    docs = [(0, " ".join(w if k % 4 else "swapped" for k, w in enumerate(long)))]
    for swapped in itertools.combinations(range(13), 3):
        docs.append((len(docs), " ".join(["x"] * 3 + ["y" if k in swapped else long[k] for k in range(13)] + ["x"] * 3)))
    for n, b in brief.items():
        for swapped in itertools.combinations(range(n), n + (-n * D.LEAST // D.WINDOW)):
            docs.append((len(docs), " ".join("y" if k in swapped else w for k, w in enumerate(b))))
    one = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(99, " ".join(long))] + [(n, " ".join(b)) for n, b in brief.items()], "item_id long, text string")
    rows = D.find_leaks(one, bench).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in docs}
    assert all(r["n_hits"] > 0 and r["token_from"] <= r["token_to"] for r in rows)
    # without short items too, where SHORT isn't asked
    assert D.find_leaks(one, bench.filter("item_id = 99")).count() == 1 + 286
