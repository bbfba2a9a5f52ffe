"""What a prediction rests on: a graph of artifacts that name each other by digest, followed from all leaves at once.

Artifacts are rows (kind, id, digest): the digest that the artifact has now. Links are rows (kind, id, role, to_kind, to_id, to_digest): what an artifact says
that it was made from. Tables of names compress to a fraction of what they take in memory, so joins here are
merge joins: by the size of its files Spark would broadcast a table that the driver can't hold. A prediction is sound if every link of its closure exists, names the digest that is there, and the closure has no cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.session import settled

MISSING, ALTERED, CYCLE, ROLE_MISSING, AMBIGUOUS = "E_PROVENANCE_MISSING", "E_PROVENANCE_DIGEST", "E_PROVENANCE_CYCLE", "E_PROVENANCE_ROLE", "E_PROVENANCE_AMBIGUOUS"
# What each kind must name: a prediction its model, and so on down to the files.
REQUIRED = {"prediction": ("model", "dataset", "split"), "model": ("dataset", "split"), "split": ("dataset",), "dataset": ("evidence",), "evidence": ("file",)}
NODE = ("kind", "id")


def link_issues(artifacts: DataFrame, links: DataFrame, required: dict[str, tuple[str, ...]] = REQUIRED) -> DataFrame:
    """(kind, id, role, code) of single faults: a link to nothing, to another digest or to an artifact that is there twice, a required link that is not there or there twice with different ends."""
    there = artifacts.groupBy(F.col("kind").alias("to_kind"), F.col("id").alias("to_id")).agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    seen = links.join(there.hint("merge"), ["to_kind", "to_id"], "left")
    code = F.when(F.col("a").isNull(), MISSING).when(F.col("a") != F.col("b"), AMBIGUOUS).when(~F.col("a").eqNullSafe(F.col("to_digest")), ALTERED)
    broken = seen.select(*NODE, "role", code.alias("code")).where("code IS NOT NULL")
    wanted = artifacts.sparkSession.createDataFrame([(k, r) for k, roles in required.items() for r in roles], "kind string, role string")
    asked = artifacts.select(*NODE).distinct().join(F.broadcast(wanted), "kind")
    given = links.groupBy(*NODE, "role").agg(F.countDistinct("to_kind", "to_id", "to_digest").alias("n"))
    lacking = asked.join(given.hint("merge"), [*NODE, "role"], "left").where("coalesce(n, 0) <> 1").select(*NODE, "role", F.when(F.col("n") > 1, AMBIGUOUS).otherwise(ROLE_MISSING).alias("code"))
    return broken.unionByName(lacking).distinct()


def closure(links: DataFrame, leaves: DataFrame, rounds: int = 30) -> DataFrame:
    """(leaf_kind, leaf_id, kind, id) of all that leaves rest on, themselves included; paths double in length each round, so a chain of n takes log n joins."""
    step = links.select(F.col("kind").alias("a_kind"), F.col("id").alias("a_id"), F.col("to_kind").alias("b_kind"), F.col("to_id").alias("b_id")).distinct()
    step, before = settled(step, "provenance-paths"), -1
    for _ in range(rounds):
        n = step.count()
        if n == before:
            break
        before = n
        further = step.select(F.col("a_kind").alias("b_kind"), F.col("a_id").alias("b_id"), F.col("b_kind").alias("c_kind"), F.col("b_id").alias("c_id"))
        longer = step.join(further.hint("merge"), ["b_kind", "b_id"]).select("a_kind", "a_id", F.col("c_kind").alias("b_kind"), F.col("c_id").alias("b_id"))
        step = settled(step.union(longer).distinct(), "provenance-paths")
    else:
        raise RuntimeError("the closure has not settled")
    below = leaves.select(F.col("kind").alias("a_kind"), F.col("id").alias("a_id")).distinct().join(step.hint("merge"), ["a_kind", "a_id"])
    own = leaves.select(F.col("kind").alias("a_kind"), F.col("id").alias("a_id"), F.col("kind").alias("b_kind"), F.col("id").alias("b_id")).distinct()
    return below.select("a_kind", "a_id", "b_kind", "b_id").union(own).distinct().toDF("leaf_kind", "leaf_id", *NODE)


def unsound(artifacts: DataFrame, links: DataFrame, leaf_kind: str = "prediction", required: dict[str, tuple[str, ...]] = REQUIRED) -> DataFrame:
    """(leaf_id, kind, id, role, code): every fault in what each leaf rests on; a leaf without a row is sound."""
    kinds = artifacts.where(F.col("kind") == leaf_kind).select(*NODE)
    reach = settled(closure(links, artifacts.select(*NODE)), "provenance-closure")
    round_trip = links.select(F.col("kind"), F.col("id"), "role", F.col("to_kind").alias("leaf_kind"), F.col("to_id").alias("leaf_id")).join(reach.hint("merge"), ["leaf_kind", "leaf_id", *NODE])
    cycles = round_trip.select(*NODE, "role", F.lit(CYCLE).alias("code"))
    faults = settled(link_issues(artifacts, links, required).unionByName(cycles.distinct()), "provenance-faults")
    mine = reach.where(F.col("leaf_kind") == leaf_kind).join(kinds.select(F.col("kind").alias("leaf_kind"), F.col("id").alias("leaf_id")).hint("merge"), ["leaf_kind", "leaf_id"], "left_semi")
    return mine.join(faults.hint("merge"), list(NODE)).select("leaf_id", *NODE, "role", "code").distinct()
