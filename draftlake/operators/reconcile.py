"""Candidates against a snapshot: INSERT, UPDATE and SKIP, and the application of such a plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.operators.joins import checked_unique
from draftlake.schemas import PRESERVED

INSERT, UPDATE, SKIP = "INSERT", "UPDATE", "SKIP"


def actions(candidates: DataFrame, snapshot: DataFrame, keys: list[str], preserved: list[str] | tuple[str, ...] = PRESERVED) -> DataFrame:
    """``candidates`` with ``action``: INSERT for a new key, SKIP if all columns are equal, else UPDATE.

    Equality is null-safe; a null candidate of a preserved column equals anything. Repeated or null
    keys on either side fail. Rows that only the snapshot has are left alone: nothing is deleted.
    """
    values = [c for c in candidates.columns if c not in keys]
    for k in keys:
        candidates = candidates.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null key {k}"))).otherwise(F.col(k)))
    old = checked_unique(snapshot, *keys).select(*keys, *(F.col(c).alias(f"{c}__old") for c in values), F.lit(True).alias("known__"))
    both = checked_unique(candidates, *keys).join(old, keys, "left")
    same = F.lit(True)
    for c in values:
        equal = F.col(c).eqNullSafe(F.col(f"{c}__old"))
        same = same & ((F.col(c).isNull() | equal) if c in preserved else equal)
    action = F.when(F.col("known__").isNull(), INSERT).when(same, SKIP).otherwise(UPDATE)
    return both.select(*candidates.columns, action.alias("action"))


def applied(planned: DataFrame, snapshot: DataFrame, keys: list[str], preserved: list[str] | tuple[str, ...] = PRESERVED) -> DataFrame:
    """The snapshot after a plan of ``actions``: new rows added, changed rows replaced, preserved columns kept where the candidate is null."""
    values = [c for c in planned.columns if c not in (*keys, "action")]
    new = planned.where(F.col("action") != SKIP)
    old = snapshot.select(*keys, *values)
    kept = old.join(new.select(*keys), keys, "left_anti")
    named = old.select(*keys, *(F.col(c).alias(f"{c}__old") for c in values))
    changed = new.join(named, keys, "left").select(*keys, *((F.coalesce(c, f"{c}__old") if c in preserved else F.col(c)).alias(c) for c in values))
    return kept.unionByName(changed)


def side_transitions(candidates: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Team participations whose (game, team) the snapshot has on another side; a plan may only go on if this is empty."""
    old = snapshot.select("game_id", "team_id", F.col("side").alias("old_side"))
    return candidates.select("game_id", "team_id", "side").join(old, ["game_id", "team_id"]).where("side <> old_side")


def state(plans: dict[str, DataFrame]) -> DataFrame:
    """Actions by table, and whether the whole is a replay (only SKIP), initial (only INSERT) or mixed."""
    counts = reduce(DataFrame.unionByName, [p.groupBy("action").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(t)) for t, p in plans.items()])
    kinds = counts.agg(F.sort_array(F.collect_set("action")).alias("kinds"))  # one row
    name = F.when(F.col("kinds") == F.array(F.lit(SKIP)), "ALREADY_APPLIED").when(F.col("kinds") == F.array(F.lit(INSERT)), "INITIAL").otherwise("MIXED")
    return counts.crossJoin(F.broadcast(kinds.select(name.alias("state"))))
