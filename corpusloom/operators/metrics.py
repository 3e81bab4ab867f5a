"""Counters, histograms, rates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the processing-time histogram in seconds.
BOUNDS = [5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0, float("inf")]


def histogram(samples: DataFrame, value: str, *keys: str, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative counts (keys, le, count). Counts per bucket are taken before the running sum, so data shuffle once as counts."""
    edges = BOUNDS if bounds is None else bounds
    bucket = F.lit(None).cast("int")
    for k, b in reversed(list(enumerate(edges))):
        bucket = F.when(F.col(value) <= b, k).otherwise(bucket)
    counts = samples.filter(F.col(value).isNotNull()).groupBy(*keys, bucket.alias("_bucket")).agg(F.count("*").alias("n"))
    grid = counts.select(*keys).distinct().withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 1))))
    full = grid.join(counts, [*keys, "_bucket"], "left").fillna(0, ["n"])
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    le = F.element_at(F.array(*[F.lit(float(b)) for b in edges]), F.col("_bucket") + 1)
    return full.select(*keys, le.alias("le"), F.sum("n").over(w).alias("count"))


def histogram_quantile(buckets: DataFrame, q: float, *keys: str) -> DataFrame:
    """Quantile by linear interpolation in the first bucket that reaches the rank; in the last, its lower bound."""
    w = Window.partitionBy(*keys).orderBy("le")
    total = F.max("count").over(Window.partitionBy(*keys))
    b = buckets.withColumn("total", total).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("count").over(w), F.lit(0)))
    rank = F.lit(q) * F.col("total")
    hit = b.filter((F.col("total") > 0) & (F.col("count") >= rank) & ((F.col("below") < rank) | (F.col("below") == 0)))
    inside = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(
        F.col("low") + (F.col("le") - F.col("low")) * F.when(F.col("count") > F.col("below"), (rank - F.col("below")) / (F.col("count") - F.col("below"))).otherwise(1.0)
    )
    return hit.groupBy(*keys).agg(F.min_by(inside, "le").alias("quantile"))


#: Ranges into which a group's values are cut before their order is taken, each by a task of its own.
RANGES = 64


def order_statistics(samples: DataFrame, value: str, ranks: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, n, total, names of `ranks`): exact order statistics of each group; a rank is an expression of n, 1 the least value.

    Equal values are counted first.  Approximate quantiles cut a group into RANGES; running sums find the range that
    holds a rank, and only that range is put in order, so no task holds a whole group.
    """
    s = samples.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    counts = s.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    cuts = s.groupBy(*keys).agg(
        F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 1000).alias("cuts"), F.count("*").alias("n"), F.sum("v").alias("total")
    )
    ranged = counts.join(cuts.select(*[F.col(k).alias(f"k_{k}") for k in keys], "cuts"), [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
    ranged = ranged.select(*keys, "v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("range"))
    sums = ranged.groupBy(*keys, "range").agg(F.sum("c").alias("held"))
    w = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("held").over(w), F.lit(0)))
    wanted = cuts.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()])).alias("r"))
    wanted = wanted.select(*[F.col(k).alias(f"k_{k}") for k in keys], "r.name", "r.rank")
    at = sums.join(wanted, [*[F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys], (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("held"))])
    at = at.select(*[f"k_{k}" for k in keys], F.col("range").alias("k_range"), "below", "name", "rank")
    inside = Window.partitionBy(*keys, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.withColumn("upto", F.sum("c").over(inside))
    found = upto.join(at, [*[F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys], F.col("range") == F.col("k_range")])
    found = found.filter((F.col("below") + F.col("upto") >= F.col("rank")) & (F.col("below") + F.col("upto") - F.col("c") < F.col("rank")))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    back = wide.select(*[F.col(k).alias(f"k_{k}") for k in keys], *ranks)
    return cuts.join(back, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]).select(*keys, "n", "total", *ranks)


def latency_report(samples: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, sum, p50, p95 (between neighbours by place) and the order statistic sorted[int(.95 n) - 1] of each group."""
    n = F.col("n")
    ranks = {"p95_index": F.greatest(F.lit(1), F.floor(F.lit(0.95) * n))}
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        ranks |= {f"{name}_low": F.floor((n - 1) * q) + 1, f"{name}_high": F.ceil((n - 1) * q) + 1}
    o = order_statistics(samples, value, ranks, *keys)

    def between(name: str, q: float) -> Column:
        place, low, high = (n - 1) * q, F.col(f"{name}_low"), F.col(f"{name}_high")
        part = place - F.floor(place)
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    return o.select(*keys, "n", "total", between("p50", 0.5).alias("p50"), between("p95", 0.95).alias("p95"), "p95_index")


def counter_rate(samples: DataFrame, seconds: int = 300) -> DataFrame:
    """(name, t, value) with a counter's increase and per-second rate over the last `seconds`; a fall is a reset.

    Time is cut into spans of `seconds`.  A span's first sample follows the last one of the span before, and a sample's
    look-back reaches no further than that span, so a task holds two spans of a counter.
    """
    s = samples.withColumn("span", F.floor(F.col("t") / seconds))
    last = s.groupBy("name", "span").agg(F.max(F.struct("t", "value")).alias("last"))
    last = last.select("name", "span", F.lag("last.value").over(Window.partitionBy("name").orderBy("span")).alias("earlier"))
    by_time = Window.partitionBy("name", "span").orderBy("t", "value")
    before = F.coalesce(F.lag("value").over(by_time), F.col("earlier"))
    delta = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    d = s.join(last, ["name", "span"]).select("name", "t", "value", "span", delta.alias("delta"))
    # A look-back is the end of the span before and the beginning of its own: running sums from both sides, each row is added once to each.
    beginning = F.sum("delta").over(Window.partitionBy("name", "span").orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    end = F.sum("delta").over(Window.partitionBy("name", "span").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))
    d = d.select("name", "t", "value", "span", beginning.alias("beginning"), end.alias("end"))
    mine = F.struct(F.col("span").alias("at"), F.col("t").alias("x"), F.lit(None).cast("double").alias("rest"))
    next_ = F.struct((F.col("span") + 1).alias("at"), (F.col("t") + seconds).alias("x"), F.col("end").alias("rest"))
    met = d.select("name", "t", "value", "span", "beginning", F.explode(F.array(mine, next_)).alias("m")).select("name", "t", "value", "span", "beginning", "m.*")
    # Of the samples of the span before that are still in reach, the earliest knows the sum from there on.
    reach = Window.partitionBy("name", "at").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, 0)
    r = met.withColumn("rest", F.last("rest", ignorenulls=True).over(reach)).filter(F.col("at") == F.col("span"))
    r = r.withColumn("increase", F.col("beginning") + F.coalesce("rest", F.lit(0.0)))
    return r.select("name", "t", "value", "increase", (F.col("increase") / seconds).alias("rate"))


def backlog(events: DataFrame, limit: int = 500, span: str = "hour") -> DataFrame:
    """(queue, t, event_id, change) -> depth over time and whether it passes the limit.

    Changes are summed by span of time, the spans' sums run up, and each span counts on from there by itself.
    """
    e = events.withColumn("span", F.date_trunc(span, "t"))
    sums = e.groupBy("queue", "span").agg(F.sum("change").alias("sum"))
    w = Window.partitionBy("queue").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("queue", "span", F.coalesce(F.sum("sum").over(w), F.lit(0)).alias("start"))
    inside = Window.partitionBy("queue", "span").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.col("start") + F.sum("change").over(inside)
    return e.join(sums, ["queue", "span"]).select("queue", "event_id", depth.alias("depth"), (depth > limit).alias("saturated"))
