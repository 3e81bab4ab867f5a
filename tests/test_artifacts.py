"""The bucketed store: puts, references, sweeps, and plans that leave stored payloads in place."""

import hashlib

import pytest

from corpusloom.sources.artifacts import ArtifactStore


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def store(spark):
    s = ArtifactStore(spark, buckets=8)
    yield s
    s.drop()


def values(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, value string")


def fill(spark, store, *rows):
    return store.put(spark.createDataFrame(rows, "payload string, age long"))


def test_put_keeps_each_payload_once(spark, store):
    refs = fill(spark, store, ("a", 5), ("b", 1), ("a", 3), (None, 1), ("", 2)).collect()
    assert {r["payload"]: r["ref"] for r in refs} == {"a": "sha256:" + sha("a"), "b": "sha256:" + sha("b"), "": "sha256:" + sha(""), None: None}
    fill(spark, store, ("b", 0), ("é", 9))
    assert sorted((r["payload"], r["sha256"], r["size"], r["age"]) for r in store.table().collect()) == [("", sha(""), 0, 2), ("a", sha("a"), 1, 3), ("b", sha("b"), 1, 1), ("é", sha("é"), 2, 9)]
    assert ArtifactStore(spark, store.name).table().count() == 4


def test_resolve(spark, store):
    fill(spark, store, ("a", 5), ("b", 1))
    ref, gone = "sha256:" + sha("a"), "sha256:" + sha("z")
    got = {r["id"]: r["resolved"] for r in store.resolve(values(spark, ref, "plain", gone, None, ref + " ", "sha256:12", ref)).collect()}
    assert got == {0: "a", 1: "plain", 2: None, 3: None, 4: ref + " ", 5: "sha256:12", 6: "a"}


def test_sweep(spark, store):
    fill(spark, store, ("a", 50), ("b", 70), ("c", 10), ("dd", 90))
    used = values(spark, f'{{"x": "sha256:{sha("b")}", "y": "sha256:{sha("b")}"}}', "none", None)
    assert {(r["sha256"], r["eligible"]) for r in store.orphans(used, 40).collect()} == {(sha("a"), True), (sha("c"), False), (sha("dd"), True)}
    assert tuple(store.report(used, 40).first()) == (4, 1, 3, 2, 3)
    kept = store.sweep(used, 40)
    assert {r["payload"] for r in kept.table().collect()} == {"b", "c"}
    kept.drop()
    assert tuple(store.report(used.limit(0), 0).first()) == (4, 0, 4, 4, 5)


def exchanged(df):
    """The exchanges of a plan that has run, and the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line], plan


def test_stored_payloads_are_not_shuffled(spark, store):
    fill(spark, store, *[(f"payload {k}", k) for k in range(200)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        refs = values(spark, *[f"sha256:{sha(f'payload {k}')}" for k in range(0, 200, 3)])
        for df, reads_payload in ((store.orphans(refs, 5), False), (store.report(refs, 5), False), (store.resolve(refs), True)):
            lines, plan = exchanged(df)
            assert ("payload" in plan) == reads_payload and "Bucketed: true" in plan
            joins = [x for x in lines if "sha256" in x and "hashpartitioning" in x]
            assert joins and all("REPARTITION_BY_NUM" in x for x in joins)  # the references alone
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
