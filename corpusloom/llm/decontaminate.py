"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some token positions of a short span and ignore the others,
so a seed still matches where an ignored token was replaced.  Test and training
text give one hash for each mask and position; equal hashes are hits.  A hit
lays the item along a text; it counts if some window of WINDOW tokens agrees in
LEAST of them.  The masks together hit every such window, whichever of its
tokens were replaced.  Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, id_filter, split_by_filter

#: Fixed masks; 1 is a compared position.
MASKS = ("1111011", "110110111", "11011010011", "1010110101101")
WINDOW, LEAST = 13, 10
#: What MASKS alone leave out: with MORE every window of 13 tokens that agrees in 10 has a hit, with SHORT every item of 7 to 12 tokens that agrees as asked.
MORE = ("11010001011", "1100011011", "111001011", "10111000011")
SHORT = ("11111", "110111", "11010011")
#: For items of 1 to 6 tokens, by their number: each of these masks hits whatever the item may have replaced (none up to 4 tokens, then one).
BRIEF = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("111", "11011"), 6: ("111",)}
#: Benchmark tokens whose seeds may be broadcast; each gives a small row per mask.
BLOCK_TOKENS = 200_000


def tokens_of(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed_rows(df: DataFrame, tokens: str, at: str, masks: tuple[str, ...], first: int = 0) -> DataFrame:
    """df without its tokens, with a row for each 0-based position `at` and mask: its seed; masks are numbered from `first`.

    The token list is zipped with itself shifted, so that a position's tokens are
    columns of a row and hashing is compiled code; no row carries the list.
    """
    spans = [F.slice(tokens, i + 1, F.greatest(F.size(tokens), F.lit(1))).alias(f"t{i}") for i in range(max(map(len, masks)))]
    rest = [c for c in df.columns if c != tokens]
    rows = df.select(*rest, F.posexplode(F.arrays_zip(*spans)).alias(at, "_t"))
    seeds = []
    for k, mask in enumerate(masks, first):
        cared = [F.col(f"_t.t{i}") for i, c in enumerate(mask) if c == "1"]
        seeds.append(F.when(F.col(f"_t.t{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(k), *cared)))
    return rows.select(*rest, at, F.explode(F.array(*seeds)).alias("seed")).filter(F.col("seed").isNotNull())


def _agree(a: Column, b: Column, window: Column) -> Column:
    """The most equal tokens in any window of two token lists laid side by side."""
    eq = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(eq) - window + 1))
    return F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice(eq, i, window), F.lit(0), lambda s, x: s + x)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = 1) -> DataFrame:
    """Rows (doc_id, item_id, tokens_equal, n_hits, token_from, token_to), one for each document and item that share a passage.

    A passage is shared if a window of 13 tokens (of the whole item, if it is
    shorter) agrees in 10 of 13 tokens, laid at a seed hit.  tokens_equal is the
    best window's count, n_hits the hits of MASKS, token_from and token_to the
    first and last of them; where MASKS have none, those of the other masks.
    Items of fewer than `shortest` tokens, null and empty texts and rows with a
    null doc_id or item_id share nothing.  Repeated rows count as one; rows that
    share a doc_id are one document.  Other columns are ignored.

    The documents are read once for their seeds, whatever the benchmark's size.
    Up to BLOCK_TOKENS its seeds are broadcast and only hits are shuffled; a
    larger one's seeds make a bit table of fixed size, and the seeds that pass
    it are shuffled.  Then the texts that have hits are shuffled (by such a
    table too).
    """
    items = benchmark.filter("item_id is not null").select("item_id", tokens_of(F.col("text")).alias("b")).filter(F.size("b") >= max(1, shortest)).distinct()
    items = cut(items)
    n_tokens, least = items.agg(F.coalesce(F.sum(F.size("b")), F.lit(0)), F.coalesce(F.min(F.size("b")), F.lit(WINDOW))).first()
    kinds = [(items, MASKS, True), (items, MORE, False)]
    if least < WINDOW:
        kinds.append((items.filter(F.size("b") < WINDOW), SHORT, False))
    kinds += [(items.filter(F.size("b") == n), masks, False) for n, masks in BRIEF.items() if n >= least]
    masks: tuple[str, ...] = ()
    seeds = []
    for frame, more, stated in kinds:
        seeds.append(_seed_rows(frame, "b", "at", more, len(masks)).withColumn("stated", F.lit(stated)))
        masks += more
    seeds = reduce(DataFrame.unionByName, seeds)
    texts = docs.filter("doc_id is not null").select("doc_id", "text")
    shortest_mask = min(map(len, masks))
    rows = _seed_rows(texts.select("doc_id", tokens_of(F.col("text")).alias("d")).filter(F.size("d") >= shortest_mask), "d", "p", masks)
    if n_tokens <= BLOCK_TOKENS:
        hits = rows.join(F.broadcast(seeds), "seed")
    else:
        hits = split_by_filter(rows, "seed", id_filter(seeds, "seed"))[0].join(seeds, "seed")
    hits = hits.select("doc_id", "item_id", "p", (F.col("p") - F.col("at")).alias("shift"), "stated")
    hits = hits.groupBy("doc_id", "item_id", "shift", "p").agg(F.max("stated").alias("stated"))
    stated = F.when(F.col("stated"), F.col("p"))
    hits = cut(hits.groupBy("doc_id", "item_id", "shift").agg(
        F.count(stated).alias("n_hits"), F.min(stated).alias("token_from"), F.max(stated).alias("token_to"),
        F.count("p").alias("n_any"), F.min("p").alias("from_any"), F.max("p").alias("to_any"),
    ))

    some, _ = split_by_filter(texts, "doc_id", id_filter(hits, "doc_id"))
    laid = hits.join(items, "item_id").join(some.select("doc_id", tokens_of(F.col("text")).alias("d")), "doc_id")
    before = F.greatest(F.lit(0), -F.col("shift"))
    here = F.slice("d", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("b") - before)
    window = F.least(F.lit(WINDOW), F.size("b"))
    laid = laid.withColumn("tokens_equal", _agree(F.slice("b", before + 1, F.size("b")), here, window)).withColumn("need", F.ceil(window * LEAST / WINDOW))
    return (
        laid.filter(F.col("tokens_equal") >= F.col("need"))
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("tokens_equal").alias("tokens_equal"), F.coalesce(F.nullif(F.sum("n_hits"), F.lit(0)), F.sum("n_any")).alias("n_hits"),
            F.coalesce(F.min("token_from"), F.min("from_any")).alias("token_from"), F.coalesce(F.max("token_to"), F.max("to_any")).alias("token_to"),
        )
    )
