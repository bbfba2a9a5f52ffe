"""Join helpers: resolution among several matches, orphans, checked cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIQUE, AMBIGUOUS, NO_CANDIDATE = "UNIQUE", "AMBIGUOUS", "NO_CANDIDATE"


def resolve(rows: DataFrame, key: str, candidates: DataFrame) -> DataFrame:
    """``rows`` with status, n_candidates and target_id, from candidates (key, id): never a guess among several."""
    found = candidates.where(F.col("key").isNotNull()).groupBy("key").agg(F.countDistinct("id").alias("n__"), F.min("id").alias("id__"))
    out = rows.join(found.withColumnRenamed("key", "key__"), F.col(key) == F.col("key__"), "left").drop("key__")
    n = F.coalesce("n__", F.lit(0).cast("long"))
    return out.withColumns(
        {"status": F.when(n == 0, NO_CANDIDATE).when(n == 1, UNIQUE).otherwise(AMBIGUOUS), "n_candidates": n, "target_id": F.when(n == 1, F.col("id__"))}
    ).drop("n__", "id__")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` without a parent; null keys have none to miss."""
    parents = parent.select(F.col(parent_key).alias("parent__"))
    return child.where(F.col(key).isNotNull()).join(parents, F.col(key) == F.col("parent__"), "left_anti")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose keys match also where both are null; the right side's keys are dropped."""
    named = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{k}__r"))
        on = one if on is None else on & one
    return left.join(named, on, how).drop(*(f"{k}__r" for k in keys)) if how not in ("left_semi", "left_anti") else left.join(named, on, how)


def checked_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, whose execution fails on a repeated key. One more grouped count, no collect."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n__"))
    fine = counts.where(F.when(F.col("n__") > 1, F.raise_error(F.lit(f"repeated key {', '.join(keys)}")).cast("boolean")).otherwise(F.lit(True)))
    return null_safe(rows, fine.drop("n__"), list(keys), "left_semi")
