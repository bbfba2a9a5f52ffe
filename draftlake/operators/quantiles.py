"""Exact quantiles of groups, by selection from histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.session import settled

BINS = 4096


def exact_quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], most: int = 100_000) -> DataFrame:
    """(key, n, low, high, a column for each share): linear interpolation between neighbours, as of sorted values.

    Equal values are counted first. Then histograms of the counted values narrow each wanted rank down to one bin, until
    the bins of a rank have at most ``most`` distinct values; only those are ranked, so that no task holds a
    group. Nulls are left out.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counted = settled(counted, "counted-values")
    groups = counted.groupBy(key).agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    asked = F.array(*(F.struct(F.lit(s).alias("name"), F.lit(i).alias("side"), (F.floor(place(q)) if i == 0 else F.ceil(place(q))).cast("long").alias("rank")) for s, q in shares.items() for i in (0, 1)))
    # a rank is looked for among the values from a to b, of which ``before`` lie under a
    ranks = groups.select(key, F.explode(asked).alias("r"), F.col("low").alias("a"), F.col("high").alias("b")).select(key, "r.*", "a", "b", F.lit(0).cast("long").alias("before"))
    ranks = settled(ranks, "ranks")
    while True:
        spans = ranks.select(key, "a", "b", "before").distinct()
        inside = counted.join(spans, key).where("v BETWEEN a AND b")
        sizes = inside.groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("distinct"))
        if (sizes.agg(F.max("distinct")).first()[0] or 0) <= most:
            break
        width = (F.col("b") - F.col("a")) / BINS
        bins = inside.groupBy(key, "a", "b", "before", F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(BINS - 1)).alias("bin")).agg(F.sum("c").alias("c"), F.min("v").alias("x"), F.max("v").alias("y"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(key, "a", "b").orderBy("bin"))
        bins = bins.select(key, "a", "b", (upto - F.col("c")).alias("from"), upto.alias("to"), "x", "y")
        ranks = ranks.drop("before").join(bins, [key, "a", "b"]).where("rank >= from AND rank < to").select(key, "name", "side", "rank", F.col("x").alias("a"), F.col("y").alias("b"), F.col("from").alias("before"))
        ranks = settled(ranks, "ranks")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(key, "a", "b").orderBy("v"))
    sorted_ = inside.select(key, "a", "b", "v", (upto - F.col("c")).alias("from"), upto.alias("to"))
    found = ranks.drop("before").join(sorted_, [key, "a", "b"]).where("rank >= from AND rank < to")
    ends = found.groupBy(key).agg(*(F.max(F.when((F.col("name") == s) & (F.col("side") == i), F.col("v"))).alias(f"{s}_{i}") for s in shares for i in (0, 1)))
    between = lambda s, q: F.col(f"{s}_0") + (place(q) - F.floor(place(q))) * (F.col(f"{s}_1") - F.col(f"{s}_0"))
    return groups.join(ends, key).select(key, "n", "low", "high", *(between(s, q).alias(s) for s, q in shares.items()))
