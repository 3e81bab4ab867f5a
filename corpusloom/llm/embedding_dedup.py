"""Embedding near-duplicates by a forest of random-projection trees.

Trees split recursively by random directions at the median of a bounded sample;
vectors near a split go to both sides (spill).  Vectors are compared, in double
precision, only within a leaf and an equal label; links of at least the
threshold are counted and united.  How deep a vector goes follows the number of
vectors of its own label, as the sample tells it, so a hot label has more leaves
and not larger ones.  A leaf that stays large (a group of near
copies can't be split) is compared with itself in tiles of rows, each a task of
its own, so nothing is capped.  Equal vectors are one vector with a weight.  A
pair that meets in several leaves counts in the first of them, which both rows'
lists of leaves tell, so no pair is ever sent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import connected_components, cut, join_groups

#: Trees, and how near to a split a vector goes to both sides, in a tree of at most SPILL_DEPTH levels (less in a deeper one, so that spilled rows stay as many).
TREES, SPILL, SPILL_DEPTH = 5, 0.02, 8
#: Vectors that a leaf should hold; rows of the sample that fits the trees; levels whose nodes have a split of their own; greatest depth.
LEAF, SAMPLE, SPLITS, DEPTH = 512, 50_000, 12, 28
THRESHOLD = 0.98
#: Rows of one side of a compared tile, for leaves that stay larger.
TILE = 2048


class Forest:
    """Random directions and split points.

    A node's split is the sample's median there; below level SPLITS, where few
    rows of the sample are left, it is the whole sample's median in the level's
    direction.  Nodes are numbered from 1 at the root; k has the children 2 k
    and 2 k + 1.
    """

    def __init__(self, sample: np.ndarray, labels: list, n: int, leaf: int = LEAF, trees: int = TREES, spill: float = SPILL, seed: int = 11):
        random = np.random.default_rng(seed)
        each = n / max(1, len(sample))  # vectors for which a row of the sample stands
        deep = lambda rows: int(min(DEPTH, max(0, np.ceil(np.log2(max(1.0, rows * each / leaf))))))
        self.depths = {label: deep(rows) for label, rows in Counter(labels).items()}
        self.other = deep(1)  # a label that the sample lacks
        self.depth = max([self.other, *self.depths.values()]) if len(sample) else 0
        self.spill = spill * min(1.0, SPILL_DEPTH / max(1, self.depth))
        dim = sample.shape[1]
        self.direction = random.standard_normal((trees, self.depth, dim))
        self.direction /= np.linalg.norm(self.direction, axis=2, keepdims=True)
        self.middle = np.zeros((trees, self.depth))
        self.split = np.zeros((trees, 1 << min(SPLITS, self.depth)))
        for t in range(trees):
            at = np.ones(len(sample), dtype=np.int64)
            for d in range(self.depth):
                x = sample @ self.direction[t, d]
                self.middle[t, d] = np.median(x)
                if d < SPLITS:
                    order = np.lexsort((x, at))
                    node, first, size = np.unique(at[order], return_index=True, return_counts=True)
                    self.split[t, 1 << d : 1 << (d + 1)] = self.middle[t, d]
                    self.split[t, node] = x[order][first + size // 2]
                    at = at * 2 + (x >= self.split[t, at])

    def leaves(self, x: np.ndarray, labels: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per tree (rows, leaves): every leaf that a row reaches."""
        depth = np.array([self.depths.get(label, self.other) for label in labels], dtype=np.int64)
        out = []
        for t in range(len(self.direction)):
            rows, at = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
            for d in range(self.depth):
                on = depth[rows] > d
                split = self.split[t, at * on] if d < SPLITS else self.middle[t, d]
                off = (x @ self.direction[t, d])[rows] - split
                low, high = on & (off < self.spill), on & (off >= -self.spill)
                rows, at = np.concatenate([rows[~on], rows[low], rows[high]]), np.concatenate([at[~on], at[low] * 2, at[high] * 2 + 1])
            out.append((rows, at))
        return out


def _sample(reps: DataFrame, rows: int) -> tuple[np.ndarray, list, int]:
    """A bounded sample by a hash of rep, as unit vectors with their labels, and the number of all rows."""
    n = reps.count()
    part = reps if n <= rows else reps.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    got = part.select("label", "embedding").toPandas()
    if not len(got):
        return np.zeros((0, 1)), [], n
    length = got["embedding"].map(len)
    got = got[length == int(np.bincount(length).argmax())]
    x = np.stack([np.asarray(v, dtype=np.float64) for v in got["embedding"]])
    return x / np.linalg.norm(x, axis=1, keepdims=True), got["label"].tolist(), n


def _local_components(linked: np.ndarray) -> np.ndarray:
    """Least member's place for each place of a symmetric boolean matrix."""
    at = np.arange(len(linked))
    while True:
        new = at.copy()
        for lo in range(0, len(linked), 256):
            part = np.where(linked[lo : lo + 256], at[None, :], len(linked)).min(axis=1, initial=len(linked))
            new[lo : lo + 256] = np.minimum(at[lo : lo + 256], part)
        new = np.minimum(new, new[new])
        if (new == at).all():
            return at
        at = new


def compare_tile(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One tile of a leaf: (rep, weight, embedding, leaves, leaf, side) -> (rep, links, parent).

    side 0 is compared with side 1, or with itself if there is no side 1.
    links: weight of the vectors linked to rep that meet it here first; parent:
    the least vector of its local component.
    """
    frame = frame.sort_values(["side", "rep"], kind="stable").reset_index(drop=True)
    x = np.stack([np.asarray(v, dtype=np.float64) for v in frame["embedding"]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = frame["side"].to_numpy()
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return pd.DataFrame({"rep": [], "links": [], "parent": []})
    here = int(frame["leaf"].iloc[0])
    # Leaves are numbered by tree, so the leaves before this one are those where a pair would have met already.
    earlier = [[v for v in leaves if v < here] for leaves in frame["leaves"]]
    number = {v: i for i, v in enumerate(sorted({v for vs in earlier for v in vs}))}
    new = linked
    if number:
        member = np.zeros((len(frame), len(number)), dtype=np.float32)
        for i, vs in enumerate(earlier):
            member[i, [number[v] for v in vs]] = 1
        new = linked & (member @ member.T == 0)
    weight = frame["weight"].to_numpy(np.int64)
    rep = frame["rep"].to_numpy(np.int64)
    out = pd.DataFrame({"rep": rep, "links": new.astype(np.float64) @ weight, "parent": rep[_local_components(linked)]})
    out = out[linked.any(axis=1)]
    return out.astype({"links": np.int64})


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF) -> DataFrame:
    """(vec_id, label, embedding) -> vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in
    double precision, is at least threshold; null, empty and zero vectors and
    those with null or non-finite components link with nothing, nor do vectors
    of different length.  n_links counts the vectors found linked directly,
    component_id is the smallest vec_id reachable, kept says whether it is
    vec_id itself.  Rows that share a vec_id are one vector (the least by label,
    then embedding); a null vec_id links with nothing and has a null component.
    Extra columns are ignored; an empty table gives an empty result.
    """
    v = vectors.select("vec_id", "label", "embedding").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x"))
    v = v.select("vec_id", "x.label", "x.embedding")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda c: c != 0), F.lit(False))
    v = v.withColumn("sound", F.coalesce(sound, F.lit(False)))
    v = v.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    v = cut(v)
    reps = (
        v.filter("sound")
        .groupBy("label", "k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    )
    reps = cut(reps)
    sample, labels, n = _sample(reps, SAMPLE)
    width = sample.shape[1]
    forest = vectors.sparkSession.sparkContext.broadcast(Forest(sample, labels, n, leaf, trees, spill))

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown = forest.value
        for frame in frames:
            if not len(frame):
                continue
            fit = np.array([len(e) == width for e in frame["embedding"]])
            lists: list[list[int]] = [[] for _ in range(len(frame))]
            if fit.any():
                x = np.stack([np.asarray(e, dtype=np.float64) for e in frame["embedding"][fit]])
                place = np.flatnonzero(fit)
                for t, (rows, at) in enumerate(grown.leaves(x / np.linalg.norm(x, axis=1, keepdims=True), frame["label"][fit].tolist())):
                    for r, k in zip(place[rows].tolist(), at.tolist(), strict=True):
                        lists[r].append(t << 32 | k)
            for r in np.flatnonzero(~fit):  # another length: one leaf for each length, compared in tiles
                lists[r].append(-1 - len(frame["embedding"].iloc[r]))
            yield frame.assign(leaves=[sorted(x) for x in lists])

    schema = "label {}, rep long, weight long, embedding {}, leaves array<long>".format(*(reps.schema[c].dataType.simpleString() for c in ("label", "embedding")))
    placed = cut(reps.select("label", "rep", "weight", "embedding").mapInPandas(leaves, schema))
    # Leaves that hold more than a tile are cut; a row of block i goes to the tiles (i, j) and (j, i).
    sizes = placed.select("label", F.explode("leaves").alias("leaf")).groupBy("label", "leaf").agg(F.count("*").alias("size"))
    large = sizes.filter(F.col("size") > TILE).select("label", "leaf", F.ceil(F.col("size") / (TILE // 2)).cast("int").alias("parts"))
    rows = placed.withColumn("leaf", F.explode("leaves")).join(large, ["label", "leaf"], "left").fillna(1, ["parts"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep", "leaf"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(
        "label", "leaf", "rep", "weight", "embedding", "leaves",
        F.least("part", "other").alias("tile_a"), F.greatest("part", "other").alias("tile_b"), (F.col("part") > F.col("other")).cast("int").alias("side"),
    )
    tiles = rows.groupBy("label", "leaf", "tile_a", "tile_b").applyInPandas(
        lambda frame: compare_tile(frame, threshold), "rep long, links long, parent long"
    )
    tiles = cut(tiles)
    links = tiles.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(tiles.select(F.col("rep").alias("src"), F.col("parent").alias("dst")))
    found = reps.select("label", "k1", "k2", "rep", "weight").join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select(
        "label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    ).filter("links > 0")
    own = v.select("vec_id", "label", "k1", "k2", "sound")
    out = join_groups(own, found.withColumn("sound", F.lit(True)), ["label", "k1", "k2", "sound"])
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
