"""N-gram Jaccard self-join as a blocked sparse product.

Documents and n-grams form a sparse 0/1 matrix; its product with itself holds
the overlap of every two documents.  The n-grams' columns are put in one order,
rare before common, and a document is multiplied only by the block of its first
columns.  Two sets of sizes n and m that allow similarity t overlap in at least
o = t (n + m) / (1 + t) columns, so the first l of their common columns stand
among the first n - o + l of one and m - o + l of the other, for every l up to
o.  Two documents meet where this holds of a column for l = 1; the products of
equal columns are accumulated over both blocks, a pair whose count stays below
the l of the blocks is discarded, and what is left is verified by its exact
overlap.

Any order gives all pairs; a good one keeps common lines and passages out of the
blocks.  Commonness is counted over all documents, each task passing on what it
saw more than once, and the most common n-grams (a bounded list) go last, by the
binary logarithm of their count; the others go by hash.

Copies and groups of near copies don't become all pairs: equal texts are one
document; then documents are linked to the most central document of their
columns (that whose n-grams are the commonest) and united, and only pairs of
different components are multiplied out: of each column, the documents outside
its largest component with all of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import connected_components, cut, id_filter, join_groups, scratch, split_by_filter
from corpusloom.llm.shingles import shingle_sets

#: Words in an n-gram, similarity as a per cent.
WORDS, PERCENT = 4, 85
#: Common n-grams that are ordered by their count, and the count from which one is common.
COMMON, COMMON_FROM = 400_000, 8
#: Columns that a block holds beyond the least.
EXTRA = 4
#: A column of more documents (by the binary logarithm of its count) is dealt under salts, each of about so many.
HOT = 12
#: Orders of documents; the first of each order in a column is tried before pairs are multiplied out.
ORDERS = 4
#: Partners of one document that are verified under one salt.
PARTNERS = 1024
#: N-grams of which a task counts the repeated ones at once.
HELD = 2_000_000
#: Bits of the table that tells which n-grams are surely not common.
_SIEVE = 22


def tally(docs: DataFrame, words: int) -> DataFrame:
    """One pass over (doc_id, h1, h2, text): rows (doc_id, h1, h2, n) with each set's size, and rows (key, seen) with counts of n-grams.

    A task passes on an n-gram's count where it sees it more than once in a run
    of HELD n-grams, so counts are a little low; they only order the columns.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("seen", pa.int64())])
        held: list[np.ndarray] = []

        def repeated() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            keys, n = keys[n > 1].view(np.int64), n[n > 1]
            empty = [pa.nulls(len(keys), f.type) for f in list(schema)[:4]]
            return pa.RecordBatch.from_arrays([*empty, pa.array(keys), pa.array(n, pa.int64())], schema=schema)

        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int32)
            for first, hashes, offsets in shingle_sets(batch["text"], words):
                sizes[first : first + len(offsets) - 1] = np.diff(offsets)
                held.append(hashes)
                if sum(map(len, held)) >= HELD:
                    yield repeated()
            own = [batch["doc_id"], batch["h1"], batch["h2"], pa.array(sizes)]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64())], schema=schema)
        if held:
            yield repeated()

    return docs.select("doc_id", "h1", "h2", "text").mapInArrow(count, "doc_id long, h1 long, h2 long, n int, key long, seen long")


class Order:
    """The order of the columns: the sorted hashes of the most common n-grams with their levels; all others have level 0."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.levels = np.log2(np.maximum(counts[order], 1)).astype(np.int64)
        self.sieve: np.ndarray | None = None  # made where it is used

    def level(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        if len(self.keys):
            if self.sieve is None:
                self.sieve = np.zeros(1 << _SIEVE, bool)
                self.sieve[self.keys >> np.uint64(64 - _SIEVE)] = True
            some = np.flatnonzero(self.sieve[hashes >> np.uint64(64 - _SIEVE)])
            at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == hashes[some], self.levels[at], 0)
        return out


def common_columns(tallied: DataFrame) -> Order:
    """The most common n-grams: a list of bounded length."""
    seen = tallied.filter("key is not null").groupBy("key").agg(F.sum("seen").alias("n")).filter(F.col("n") >= COMMON_FROM)
    top = seen.orderBy(F.desc("n"), "key").limit(COMMON).toPandas()
    return Order(top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.float64))


def block_size(n: int, percent: int = PERCENT, extra: int = EXTRA) -> int:
    """Columns of a set of n that any similar set shares `1 + extra` of (or all that they must share)."""
    return min(n, n - -(-percent * n // 100) + 1 + extra) if n else 0


def block(levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Places of a set's first columns, by level and then hash, for the levels of its sorted hashes."""
    m = block_size(len(levels), percent)
    return np.argsort(levels, kind="stable")[:m] if levels.any() else np.arange(m)


def column_rows(docs: DataFrame, order: Order, words: int, percent: int) -> DataFrame:
    """(key, doc_id, n, place, mean, level): the block of each document in the columns' order, with its set's size and the mean level of its n-grams by thousandths."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    types = [("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("mean", pa.int32()), ("level", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, offsets in shingle_sets(batch["text"], words):
                levels = shared.value.level(hashes)
                n = np.diff(offsets)
                sums = np.add.reduceat(np.r_[levels, 0], offsets[:-1]) * (n > 0)
                bounds = offsets.tolist()
                taken = [lo + block(levels[lo:hi], percent) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
                size = [len(t) for t in taken]
                if not sum(size):
                    continue
                at = np.concatenate(taken)
                ids = np.repeat(np.arange(first, first + len(n)), size)
                place = np.concatenate([np.arange(m) for m in size])
                columns = [
                    pa.array(hashes[at].view(np.int64)), batch["doc_id"].take(pa.array(ids)), pa.array(np.repeat(n, size), pa.int32()), pa.array(place, pa.int32()),
                    pa.array(np.repeat(sums * 1000 // np.maximum(n, 1), size), pa.int32()), pa.array(levels[at], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(types))

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, n int, place int, mean int, level int")


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    return F.ceil((a + b) * percent / (100 + percent))


def _reach(n: Column, percent: int) -> Column:
    """block_size as a column expression."""
    return F.least(n, n - F.ceil(n * percent / 100) + 1 + EXTRA)


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _asked(a: Column, b: Column, percent: int) -> Column:
    """The count of common columns that a similar pair must have within the blocks of both."""
    o = _least_overlap(a, b, percent)
    return F.least(o, _reach(a, percent) - (a - o), _reach(b, percent) - (b - o))


def shared_columns(rows: DataFrame, percent: int) -> DataFrame:
    """Rows whose column another document of a similar size holds too, with salt, salts and the salt's most central document (head, head_n).

    The one shuffle of all columns: by key, and for a hot key by a salt too.
    """
    salts = F.when(F.col("level") > HOT, F.pow(F.lit(2), F.least(F.col("level") - HOT, F.lit(20))).cast("int")).otherwise(1)
    rows = rows.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts").cast("long")).cast("int")).drop("level")
    group = Window.partitionBy("key", "salt")
    by_size = group.orderBy("n")
    near = lambda x: x.isNotNull() & _similar_sizes(x, F.col("n"), percent)
    met = rows.withColumn("before", F.lag("n").over(by_size)).withColumn("after", F.lead("n").over(by_size))
    met = met.filter((F.col("salts") > 1) | near(F.col("before")) | near(F.col("after"))).drop("before", "after")
    head = F.max(F.struct("mean", (-F.col("doc_id")).alias("id"), "n")).over(group)
    met = met.withColumn("head", head)
    return met.select("key", "doc_id", "n", "place", "mean", "salts", "salt", (-F.col("head.id")).alias("head"), F.col("head.n").alias("head_n"))


def verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least percent; only documents of pairs are shuffled.

    A document `a` with many partners is repeated under salts, PARTNERS each.
    """
    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some, _ = split_by_filter(docs.select("doc_id", "text"), "doc_id", id_filter(ids, "doc_id"))
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts")).filter("salts > 1")
    dealt = pairs.join(salts, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts").cast("long")), F.lit(0)).cast("int")).drop("salts")
    left = some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(salts, "a", "left")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    both = dealt.join(left, ["a", "salt"]).join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for side in ("text_a", "text_b"):
                found = []
                for _, hashes, offsets in shingle_sets(batch[side], words):
                    found += np.split(hashes, offsets[1:-1])
                sets.append(found)
            keep = []
            for x, y in zip(*sets, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(len(x) > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per input row.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    sets of distinct word n-grams; component_id is the smallest doc_id that
    links reach, the own one included.  Null texts and texts without words have
    n_shingles 0 and link with nothing, nor does a null doc_id (its component is
    null).  Rows that share a doc_id are linked as one document.  Extra columns
    are ignored.  N-grams and blocks are compared by 64-bit hashes.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wordy = F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")) & F.col("doc_id").isNotNull(), F.lit(False))
    h1, h2 = F.when(wordy, F.xxhash64("text")), F.when(wordy, F.xxhash64(F.lit(1), "text"))
    base = base.withColumn("h1", h1).withColumn("h2", h2)

    tallied = cut(tally(base, words))
    keyed = tallied.filter("key is null").select("doc_id", "h1", "h2", "n")
    # Equal texts: one row of each group goes on, that of the smallest id.
    groups = keyed.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    groups = cut(groups.filter("rows > 1").select("h1", "h2", "rep"))
    member = cut(join_groups(keyed.drop("n"), groups, ["h1", "h2"]).filter("doc_id != rep"))
    texts = base.filter("h1 is not null")
    maybe, sole = split_by_filter(texts, "doc_id", id_filter(member, "doc_id"))
    single = sole.unionByName(maybe.join(member.select("doc_id", "h1", "h2").distinct(), ["doc_id", "h1", "h2"], "left_anti").select(*sole.columns))
    # A doc_id with several rows is one node of the graph.
    again = keyed.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    links = member.join(again, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    with scratch(docs.sparkSession):
        rows = cut(shared_columns(column_rows(single, common_columns(tallied), words, percent), percent))
        links = cut(links.unionByName(find_links(rows, texts.select("doc_id", "text"), percent, words)), keep=True)
    part = connected_components(links.toDF("src", "dst"))
    group_part = groups.join(part.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("of_group"))
    out = join_groups(keyed, group_part, ["h1", "h2"]).join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.least("doc_id", "of_group", "component").alias("component_id"))


def _best(rows: DataFrame, percent: int) -> DataFrame:
    """Of (doc_id, n, by, head, head_n) rows, each document's partner (a, b) for each `by`: that of most common columns, if these are a fair part of what is asked."""
    able = rows.filter((F.col("doc_id") != F.col("head")) & _similar_sizes(F.col("n"), F.col("head_n"), percent))
    counted = able.groupBy("doc_id", "by", "head").agg(F.count("*").alias("equal"), F.first(_asked(F.col("n"), F.col("head_n"), percent)).alias("asked"))
    best = counted.filter(F.col("equal") * 4 >= F.col("asked")).groupBy("doc_id", "by").agg(F.max(F.struct("equal", (-F.col("head")).alias("head"))).alias("best"))
    return best.select((-F.col("best.head")).alias("a"), F.col("doc_id").alias("b")).distinct()


def _mixed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with their component, of those keys that documents of several components hold; most: whether it is the key's largest one."""
    part = connected_components(links.toDF("src", "dst")).select(F.col("id").alias("doc_id"), "component")
    rows = rows.join(part, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    rows = cut(rows)
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("rows"), F.max("salts").alias("salts"))
    of_key = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("rows", "part")).alias("top"), F.max("salts").alias("salts")).filter("parts > 1")
    of_key = of_key.select("key", F.col("top.part").alias("top"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return rows.join(of_key, ["key", "salt"]).withColumn("most", F.col("part") == F.col("top")).drop("top")


def find_links(rows: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Verified pairs (a, b) that connect all similar documents of different texts, from shared_columns."""
    links = cut(verify(_best(rows.withColumn("by", F.lit(0)), percent), docs, words, percent))
    rows = cut(_mixed(rows.drop("head", "head_n"), links))
    # Of a column's largest component its most central document, and by some orders of all documents the first: its others are tried with these.
    struct = lambda first: F.max(F.struct("most", first.alias("first"), (-F.col("doc_id")).alias("id"), "n", "part"))
    orders = [F.col("mean").cast("long"), *[F.xxhash64("doc_id", F.lit(k)) for k in range(1, ORDERS)]]
    heads = rows.groupBy("key").agg(F.max("salts").alias("salts"), *[struct(o).alias(f"h{k}") for k, o in enumerate(orders)])
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    tries = rows.filter(~F.col("most")).join(heads, ["key", "salt"])
    tries = tries.select("doc_id", "n", "part", F.posexplode(F.array(*[f"h{k}" for k in range(ORDERS)])).alias("by", "h")).filter(F.col("part") != F.col("h.part"))
    found = verify(_best(tries.select("doc_id", "n", "by", (-F.col("h.id")).alias("head"), F.col("h.n").alias("head_n")), percent), docs, words, percent)
    links = cut(links.unionByName(found))
    rows = cut(_mixed(rows.drop("part", "most"), links))
    # A partner of any size asks for percent of a document's own columns, so those that stand later than this leaves can't be a pair's first.
    early = rows.filter(F.col("place") <= F.col("n") - F.floor((F.col("n") * percent + 99) / 100))
    few = early.filter(~F.col("most")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    a, b = (df.select("key", "salt", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "place", "part", "most")]) for df, s in ((few, "a"), (early, "b")))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    # Two documents outside the largest component meet twice; once is enough.
    once = F.col("most_b") | (F.col("doc_id_a") < F.col("doc_id_b"))
    pairs = a.join(b, ["key", "salt"]).filter((F.col("part_a") != F.col("part_b")) & once & _similar_sizes(n_a, n_b, percent))
    o = _least_overlap(n_a, n_b, percent)
    first = (F.col("place_a") <= n_a - o) & (F.col("place_b") <= n_b - o)
    pairs = pairs.filter(first).select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()
    # The pair's products are accumulated over both blocks.
    own = cut(rows.groupBy("doc_id", "n").agg(F.collect_list("key").alias("keys")))
    for s in "ab":
        pairs = pairs.join(own.select(*[F.col(c).alias(f"{c}_{s}") for c in own.columns]).withColumnRenamed(f"doc_id_{s}", s), s)
    equal = F.size(F.array_intersect("keys_a", "keys_b"))
    return links.unionByName(verify(pairs.filter(equal >= _asked(n_a, n_b, percent)).select("a", "b").distinct(), docs, words, percent))
