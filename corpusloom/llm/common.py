"""Helpers shared by the corpus operators: lineage cuts, id filters, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_dir

#: Words of an id filter, of 64 bits each: 2 MB of bits at any size of the data.
FILTER_WORDS = 1 << 18


#: Tables that the scratches entered now, in this thread, have to delete, the innermost last.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("scratches", default=())


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: short lineage, safe from lost executors.

    Inside a scratch the table is deleted at its end, unless keep is set: then it belongs to the scratch around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    holders = _MADE.get()[:-1] if keep else _MADE.get()
    if holders:
        holders[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that cut() makes inside, once it is left; what leaves it must have been cut with keep."""
    made: list[str] = []
    entered = _MADE.set((*_MADE.get(), made))
    try:
        yield
    finally:
        _MADE.reset(entered)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))


def id_filter(ids: DataFrame, key: str) -> DataFrame:
    """A Bloom-like bit table (word, bits) over ids[key]: FILTER_WORDS rows at most, so it may be broadcast at any size."""
    slot = _slot(F.col(key))
    return (
        ids.select(F.floor(slot / 64).cast("int").alias("_word"), F.pmod(slot, F.lit(64)).cast("int").alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    )


def split_by_filter(df: DataFrame, key: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the ids, rows whose key surely is not); no shuffle of df."""
    slot = _slot(F.col(key))
    marked = df.withColumn("_word", F.floor(slot / 64).cast("int")).join(F.broadcast(bits), "_word", "left")
    maybe = F.coalesce(F.expr("getbit(_bits, cast(pmod(xxhash64(`%s`), %d) %% 64 as int))" % (key, FILTER_WORDS * 64)), F.lit(0)) == 1
    marked = marked.withColumn("_maybe", maybe)
    drop = ("_word", "_bits", "_maybe")
    return marked.filter("_maybe").drop(*drop), marked.filter("not _maybe").drop(*drop)


def without_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is not in ids; only rows that pass the bit table are shuffled.  df may have columns of any name: a row goes through as one value."""
    gone = ids.select(F.col(key).alias("key")).distinct()
    rows = df.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("key"))
    maybe, surely = split_by_filter(rows, "key", id_filter(gone, "key"))
    return surely.select("row").unionByName(maybe.join(gone, "key", "left_anti").select("row")).select("row.*")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars.

    edges: (src long, dst long), any order, repeats and loops allowed.  Returns
    (id, component) with the smallest id of each component, for every id that
    occurs in an edge.  Each round is one written table; only a count and a sum
    come to the driver.  Rounds grow with the
    logarithm of the graph's size, at worst with its square.
    """
    with scratch(edges.sparkSession):
        e = (
            edges.filter(F.col("src") != F.col("dst"))
            .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
            .distinct()
        )
        e = cut(e)
        before = None
        for _ in range(max_rounds):
            # Large star: neighbours above u are hung on the least neighbour.
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            # Small star: neighbours below u, and u, are hung on the least of them.
            small_least = large.groupBy("u").agg(F.min("v").alias("m"))
            hung = large.join(small_least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = cut(hung.union(small_least.select("u", F.col("m").alias("v"))).distinct())
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
            if now == before or now[0] == 0:
                break
            before = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        return cut(e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct()), keep=True)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """rows left-joined to groups on keys, for groups that may hold a third of all rows.

    groups has a row for each key that occurs more than once, so it is small; it
    is repeated under each salt and the rows of a hot key are dealt over them.
    """
    salted = groups.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*keys, "_salt"], "left").drop("_salt")
