"""Paired targets and their temporal split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABEL_END_MISSING, LABEL_END_NOT_AFTER_CUTOFF = "E_LABEL_END_MISSING", "E_LABEL_END_NOT_AFTER_CUTOFF"
TRAIN, VALIDATION = 70, 85  # per cent


def with_exclusions(targets: DataFrame, ended_at: str = "ended_at", cutoff: str = "cutoff") -> DataFrame:
    """``excluded_reason``: why a target can't be a sample, null if it can; the first reason counts."""
    end = F.col(ended_at)
    return targets.withColumn("excluded_reason", F.when(end.isNull(), LABEL_END_MISSING).when(end <= F.col(cutoff), LABEL_END_NOT_AFTER_CUTOFF))


def boundaries(samples: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """One row (validation_start, test_start): cutoffs between groups nearest to 70 and 85 % of the samples.

    Positions lie only between different cutoffs; ties in distance take the earlier one, and the first leaves
    a later one for the second. No row if there are fewer than three cutoffs. Only the distinct
    cutoffs, one row each, meet in one window.
    """
    groups = samples.groupBy(F.col(cutoff).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("start")
    placed = groups.select(
        "start",
        (F.sum("n").over(order) - F.col("n")).alias("pos"),
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        F.row_number().over(order).alias("i"),
        F.lead("start").over(order).isNull().alias("is_last"),
    )
    off = lambda share: F.struct(F.abs(100 * F.col("pos") - share * F.col("total")), F.col("pos"))
    first = placed.where("i > 1 AND NOT is_last").agg(F.min_by(F.struct("start", "pos"), off(TRAIN)).alias("first"))
    second = placed.crossJoin(F.broadcast(first)).where("pos > first.pos")  # one row on the right
    return second.agg(F.first("first.start").alias("validation_start"), F.min_by("start", off(VALIDATION)).alias("test_start")).where("test_start IS NOT NULL")


def temporal_split(samples: DataFrame, cutoff: str = "cutoff", ended_at: str = "ended_at") -> DataFrame:
    """``samples`` with ``partition`` and ``purged``: labels known only at or after the next part's start are purged."""
    marked = samples.crossJoin(F.broadcast(boundaries(samples, cutoff)))  # one row on the right
    part = F.when(F.col(cutoff) < F.col("validation_start"), "train").when(F.col(cutoff) < F.col("test_start"), "validation").otherwise("test")
    until = F.when(F.col("partition") == "train", F.col("validation_start")).when(F.col("partition") == "validation", F.col("test_start"))
    return marked.withColumn("partition", part).withColumn("purged", F.coalesce(F.col(ended_at) >= until, F.lit(False)))


def summary(split: DataFrame, label: str, cutoff: str = "cutoff") -> DataFrame:
    """Planned, purged and kept samples of each part, its wins and its first and last cutoff."""
    return split.groupBy("partition").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if("purged").alias("purged"),
        F.count_if(~F.col("purged")).alias("kept"),
        F.sum(F.when(~F.col("purged"), F.col(label))).cast("long").alias("wins"),
        F.min(cutoff).alias("first_cutoff"),
        F.max(cutoff).alias("last_cutoff"),
    )
