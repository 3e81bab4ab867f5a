"""Jaccard join, embedding forest, components and the pipeline against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import embedding_dedup, jaccard_join, shingles
from corpusloom.llm.common import connected_components, without_ids


def union(n, edges):
    at = {i: i for i in n}

    def root(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {i: root(i) for i in n}


def sets(text, words=4):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(words, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, passage = [], text(30)
    for n in [1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 15, 16, 18, 22, 30, 45, 70, 110, 200, 400]:
        base = text(n)
        for k in range(8):
            d = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, n // 60), max(1, n // 45)])):
                if rng.random() < 0.5 and d:
                    d[rng.randrange(len(d))] = rng.choice(vocabulary)
                else:
                    d.insert(rng.randint(0, len(d)), rng.choice(vocabulary))
            docs.append(" ".join(d) if k % 2 else "  ".join(d).upper())
    docs += [" ".join(text(20) + passage + text(rng.randint(1, 40))) for _ in range(40)] + [" ".join(passage)] * 5 + ["", " \t\n", None, "solo", "Solo", "a b c", "A B  c", " a\xa0b"]
    return docs


def test_jaccard_against_all_pairs(spark):
    docs = corpus()
    rng = random.Random(12)
    ids = rng.sample(range(10_000), len(docs))
    rows = [(i, t, -1) for i, t in zip(ids, docs, strict=True)] + [(ids[3], docs[3], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int").repartition(5)
    s = {i: sets(t) for i, t in zip(ids, docs, strict=True)}
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    want = union(ids, edges)
    got = jaccard_join.join_components(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(s[r["doc_id"]]), want[r["doc_id"]])


def test_jaccard_of_short_texts_that_share_a_phrase(spark):
    """Each has five shingles, one of which all hold: no pair is similar, and none may be made.  Some are changed copies."""
    n = 100_000
    rows = spark.range(n).selectExpr("id AS doc_id", "concat('see you soon again a', id, ' b', id, ' c', id, ' d', id) AS text")
    copies = spark.range(0, n, 1000).selectExpr("id + 1000000 AS doc_id", "concat('See you  soon again a', id, ' b', id, ' c', id, ' d', id) AS text")
    got = jaccard_join.join_components(rows.unionByName(copies)).filter("doc_id != component_id").collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(k + 1_000_000, k) for k in range(0, n, 1000)}


def test_jaccard_repeated_ids_and_empty(spark):
    base = [f"a{i}" for i in range(40)]
    other = [f"b{i}" for i in range(40)]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (7, " ".join(base)), (9, " ".join(other)), (None, " ".join(base)), (None, None)]
    got = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, -1), (5, 5), (5, 5), (7, 5), (9, 5)]
    assert jaccard_join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 6, 7, 19, 20, 60, 400])
def test_blocks_share_what_is_asked(n):
    """Two sets at the similarity share as many columns of their blocks as the join asks for, whatever is common."""
    rng = np.random.default_rng(n)
    for _ in range(50):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        gone = rng.integers(0, n - -(-85 * n // 100) + 1)
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, n // 7).astype(np.uint64)]))
        x = np.unique(x)
        order = jaccard_join.Order(rng.choice(np.union1d(x, y), size=min(n, 5), replace=False), rng.integers(8, 90, min(n, 5)).astype(float))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            bx, by = x[jaccard_join.block(order.level(x))].tolist(), y[jaccard_join.block(order.level(y))].tolist()
            o = -(-85 * (len(x) + len(y)) // 185)
            asked = min(o, len(bx) - (len(x) - o), len(by) - (len(y) - o))
            ranks = [max(bx.index(c) - (len(x) - o), by.index(c) - (len(y) - o)) + 1 for c in set(bx) & set(by)]
            assert asked >= 1 and sum(r <= asked for r in ranks) >= asked and min(ranks) <= 1


def test_shingle_sets_are_those_of_the_words(monkeypatch):
    rng = random.Random(5)
    letters = "aAbZ \t\n\x0b\x0c\r \u00e9\u00a0\u3000\u00df"
    texts = [None, "", " "] + ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 10, 50, 700]))) for _ in range(200)] + ["x" * 5000, "X" * 5000 + " y"]
    want = [sets(t) for t in texts]
    for size in (7, 64, 1 << 17):
        monkeypatch.setattr(shingles, "BLOCK", size)
        got = [s for _, h, o in shingles.shingle_sets(pa.array(texts), 4) for s in np.split(h, o[1:-1])]
        assert [len(s) for s in got] == [len(s) for s in want]
        for _ in range(3000):
            a, b = rng.randrange(len(texts)), rng.randrange(len(texts))
            assert len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b])


def test_jaccard_hot_columns(spark, monkeypatch):
    """A large group of near copies, dealt under salts and verified under salts, is one component; so are its stragglers."""
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 16)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(160):
        d = list(base)
        for _ in range(rng.randrange(4)):
            d[rng.randrange(len(d))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(d)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    s = {i: sets(t) for i, t in rows}
    want = union(list(s), [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(df).collect()} == want


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)] + [(3, 3)]
    nodes = {x for e in edges for x in e}
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = union(nodes, edges)
    assert {i: got.get(i, i) for i in nodes} == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_without_ids(spark):
    df = spark.createDataFrame([(i, "x", "y", 1, 2, 3) for i in range(200)], "doc_id long, _word string, `a.b` string, _bits int, _maybe int, key int")
    gone = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id long")
    left = without_ids(df, "doc_id", gone)
    assert left.columns == df.columns
    assert sorted(tuple(r) for r in left.collect()) == [(i, "x", "y", 1, 2, 3) for i in range(200) if i % 3]
    assert without_ids(df, "doc_id", gone.limit(0)).count() == 200


def test_scratches_of_two_threads_are_apart(spark):
    import threading

    from corpusloom.llm.common import cut, scratch

    inside, leave = threading.Event(), threading.Event()

    def other() -> None:
        with scratch(spark):
            inside.set()
            leave.wait(60)

    t = threading.Thread(target=other)
    t.start()
    inside.wait(60)
    with scratch(spark):
        mine = cut(spark.range(5))
        leave.set()
        t.join()
        assert mine.count() == 5


def test_pipeline_stages_carry_any_column(spark, tmp_path):
    import corpus_pipeline as P

    good = "This is a plain sentence about the weather in the city and about the people who live there for many years. "
    rows = [(k, f"{good}{' '.join(f'word{k}x{j}' for j in range(30))}", "en", "s", 1, 0.5, 7, "w", "b", "m", "d", "r") for k in range(20)]
    rows.append((30, *rows[0][1:]))
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, _word string, _bits string, _maybe string, `a.b` string, row string"
    docs = spark.createDataFrame(rows, names)
    at = str(tmp_path)
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"word3x{j}" for j in range(20)))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    kept = docs
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, at)
        assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect())) == [r for r in rows if r[0] not in (3, 30)]


def vectors():
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            base = rng.standard_normal(16)
            for _ in range(rng.integers(1, 9)):
                rows.append((i, label, (base + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.05, 0.1])).astype(np.float32).tolist()))
                i += 1
    same = rows[0][2]
    rows += [(900 + k, 1, same) for k in range(30)]
    rows += [(990, 1, None), (991, 1, [0.0] * 16), (992, 1, [float("nan")] * 16), (993, 1, [None] * 16), (994, 1, []), (995, 1, same[:5]), (996, 1, same[:5]), (None, 1, same), (900, 1, same)]
    return rows


@pytest.mark.parametrize("leaf", [512, 8])
def test_embeddings_against_all_pairs(spark, leaf, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rows = vectors()
    df = spark.createDataFrame([(a, b, c, 7) for a, b, c in rows], "vec_id long, label int, embedding array<float>, n_links int")
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, float))
    ids = sorted(good)
    edges = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.98
    ]
    links = {i: 0 for i in ids}
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    want = union(ids, edges)
    got = {r["vec_id"]: r for r in embedding_dedup.link_embeddings(df, leaf=leaf).collect()}
    assert set(got) == {r[0] for r in rows}
    found = sum(min(got[i]["n_links"], links[i]) for i in ids)
    assert all(got[i]["n_links"] <= links[i] for i in ids)
    assert found >= 0.9 * sum(links.values())
    if leaf == 512:
        assert all(got[i]["n_links"] == links[i] and got[i]["component_id"] == want[i] for i in ids)
    for i in (990, 991, 992, 993, 994):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0


def test_embeddings_of_a_hot_label(spark, monkeypatch):
    """One label holds most vectors: its leaves are deeper, and the links are those of brute force."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        base = rng.standard_normal(16)
        rows += [(10 * k + j, 1 if k % 10 else k, (base + rng.standard_normal(16) * 0.03).astype(np.float32).tolist()) for j in range(3)]
    x = np.array([r[2] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[1] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    want = linked.sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), leaf=32).collect()}
    found = np.array([got[r[0]] for r in rows])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    forest = embedding_dedup.Forest(x, label.tolist(), len(x), leaf=32)
    assert forest.depths[1] > max(d for k, d in forest.depths.items() if k != 1)


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    good = "This is a plain sentence about the weather in the city and about the people who live there for many years. "
    rows = [(k, f"{good}{' '.join(f'word{k}x{j}' for j in range(30))}", "en", "s", 1) for k in range(30)]
    rows += [(50, rows[0][1], "en", "s", 1), (None, rows[1][1] + " more", "en", "s", 1), (51, None, None, None, None), (52, "", "en", "s", 0), (52, "", "en", "s", 0)]
    labels = "doc_id long, quality int, toxic int"
    for name, docs, bench in (("odd", rows, [(1, " ".join(f"word3x{j}" for j in range(20))), (2, None)]), ("empty", [], []), ("no_benchmark", rows, [])):
        at = str(tmp_path / name)
        spark.createDataFrame(docs, columns).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(k, 1, 0) for k in range(30)] if docs else [], labels).write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in P.run(spark, at).select("doc_id").collect())
        assert out == [(False, k) for k in range(30) if docs and not (bench and k == 3)] + [(True, 0)] * bool(docs)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in P.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= before
    ids = {r[0] for r in kept.select("doc_id").collect()}
    out = {r[0] for r in P.run(spark, sf_dir).select("doc_id").collect()}
    assert out == ids
    s = {r["doc_id"]: sets(r["text"]) for r in kept.collect()}
    bad = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    assert not bad
