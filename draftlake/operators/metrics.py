"""Probability metrics and family selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOREST_GAIN = 0.001


def metrics(scored: DataFrame, label: str, probability: str) -> DataFrame:
    """One row: n, Brier, log loss and exact ROC-AUC (null with one class), rounded to nine places.

    Ties share their mean rank. Scores are counted by value first, so that the ranking window sees
    each distinct score once.
    """
    y, p = F.col(label), F.col(probability)
    plain = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((p - y) * (p - y)), 9).alias("brier"),
        F.round(-F.avg(F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p))), 9).alias("log_loss"),
    )
    values = scored.groupBy(p.alias("p")).agg(F.sum(y).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("all"))
    # blocks of scores keep the running count distributed; their totals are few
    values = values.withColumn("block", F.least(F.floor(F.col("p") * 1024), F.lit(1023)))
    inside = Window.partitionBy("block").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    blocks = values.groupBy("block").agg(F.sum("all").alias("all"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("all").over(ahead), F.lit(0.0)).alias("ahead"))
    ranked = values.withColumn("before", F.coalesce(F.sum("all").over(inside), F.lit(0.0))).join(F.broadcast(blocks), "block")
    rank = F.col("ahead") + F.col("before") + (F.col("all") + 1) / 2
    sums = ranked.agg(F.sum(F.col("pos") * rank).alias("ranks"), F.sum("pos").alias("pos"), F.sum(F.col("all") - F.col("pos")).alias("neg"))
    auc = sums.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.round((F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg")), 9)).alias("roc_auc"))
    return plain.crossJoin(auc)  # one row each


def calibration(scored: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    """A row for each of the bins of equal width: n, mean probability and rate (null if empty)."""
    own = scored.groupBy(F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(probability), 9).alias("mean_p"), F.round(F.avg(label), 9).alias("rate")
    )
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean_p", "rate")


def select_family(results: list[dict]) -> str:
    """The family of least (mean Brier, mean log loss, order); a forest must beat a logistic model that
    itself beats the baseline by FOREST_GAIN in Brier.

    Each result has family (baseline, logistic, forest), brier and log_loss.
    """
    rank = ("baseline", "logistic", "forest")
    best = {r["family"]: (r["brier"], r["log_loss"], rank.index(r["family"])) for r in results}
    winner = min(best, key=best.get)
    if winner == "forest" and "logistic" in best and best["logistic"][:2] < best.get("baseline", (float("inf"),) * 3)[:2]:
        if best["logistic"][0] - best["forest"][0] < FOREST_GAIN:
            return "logistic"
    return winner
