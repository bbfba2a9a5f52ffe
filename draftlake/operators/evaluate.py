"""Evaluations: content-addressed, saved once, the latest active by subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STORAGE_CONFLICT = "E_STORAGE_CONFLICT"


# What a reader of an evaluation is warned of, in this order.
WARNINGS = ("W_TEAM_HISTORY_SMALL", "W_H2H_MISSING", "W_PAIR_HISTORY_MISSING")


def warning_codes(small: F.Column, never_met: F.Column, never_played: F.Column) -> F.Column:
    """The warnings that hold, in order: history under the window, no match against each other, a player new to a champion."""
    return F.array_compact(F.array(*(F.when(c, w) for c, w in zip((small, never_met, never_played), WARNINGS, strict=True))))


def content_key(*columns: str) -> F.Column:
    """SHA-256 of the columns' text in order (null: <NULL>, numbers as Spark writes them, -0.0 as 0.0)."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in columns)), 256)


CONTEXT = ("game_id", "blue_team_id", "red_team_id", "patch", "history_cutoff_at")


def create(scored: DataFrame, model_id: str, phase: str, parents: DataFrame | None = None) -> DataFrame:
    """Evaluations of scored targets (CONTEXT columns and p): context and content keys, the id, and for POST the parent.

    ``parents`` are the PRE evaluations; a POST belongs to the one of its context and is left out without it.
    """
    rows = scored.select(*CONTEXT, "p").withColumn("context_key", content_key(*CONTEXT)).withColumns({"model_id": F.lit(model_id), "phase": F.lit(phase)})
    if parents is None:
        rows = rows.withColumn("parent_id", F.lit(None).cast("string"))
    else:
        rows = rows.join(parents.select("context_key", "model_id", F.col("evaluation_id").alias("parent_id")), ["context_key", "model_id"])
    rows = rows.withColumn("content_sha256", content_key("context_key", "model_id", "phase", "parent_id", "p"))
    return rows.withColumn("evaluation_id", F.concat(F.lower(F.col("phase")), F.lit("-"), F.substring("content_sha256", 1, 32)))


INCOMPATIBLE = "E_EVAL_INCOMPATIBLE"


def sealed(evaluations: DataFrame, features: list[str]) -> DataFrame:
    """Evaluations (with ``features`` and an array ``warnings``) with ``seal``: the digest of context, features, probability and warnings together."""
    told = evaluations.withColumn("told__", F.to_json("warnings"))
    return told.withColumn("seal", content_key("context_key", *features, "p", "told__")).drop("told__")


def incompatible(pre: DataFrame, features: list[str]) -> DataFrame:
    """(evaluation_id, code) of sealed PRE evaluations that no POST may be made on: another phase, or a context, features, probability or warnings that have changed since."""
    own = pre.withColumn("told__", F.to_json("warnings"))
    whole = (F.col("phase") == "PRE") & F.col("context_key").eqNullSafe(content_key(*CONTEXT)) & F.col("seal").eqNullSafe(content_key("context_key", *features, "p", "told__"))
    return own.where(~F.coalesce(whole, F.lit(False))).select("evaluation_id", F.lit(INCOMPATIBLE).alias("code"))


def read_back(saved: DataFrame, warnings: DataFrame, ids: DataFrame) -> DataFrame:
    """Saved evaluations of the ids asked for, with their warnings in order, and the POST evaluations that belong to them."""
    said = warnings.groupBy("evaluation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "code"))), lambda w: w["code"]).alias("warnings"))
    posts = saved.where("phase = 'POST'").groupBy(F.col("parent_id").alias("evaluation_id")).agg(F.sort_array(F.collect_list("evaluation_id")).alias("post_ids"))
    none = F.array().cast("array<string>")
    out = saved.join(ids.select("evaluation_id").distinct(), "evaluation_id", "left_semi").join(said, "evaluation_id", "left").join(posts, "evaluation_id", "left")
    return out.withColumns({"warnings": F.coalesce("warnings", none), "post_ids": F.coalesce("post_ids", none)})


def beside(new: DataFrame, known: DataFrame, key: str = "idempotency_key", content: str = "content_sha256") -> DataFrame:
    """``new`` with its order within a key (n__, first__) and the columns of ``known`` (its key and content as stored__), null if the key is not stored."""
    order = Window.partitionBy(key).orderBy("created_at", content)
    return new.withColumns({"n__": F.row_number().over(order), "first__": F.first(content).over(order)}).join(known, key, "left")


def conflicting(content: str = "content_sha256") -> F.Column:
    return F.col(content) != F.coalesce("stored__", "first__")


def save(new: DataFrame, stored: DataFrame, key: str = "idempotency_key", content: str = "content_sha256") -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): a key that is stored with the same content is skipped. Of the rows of one key in a batch the first by time
    counts; a key is a conflict if any of its rows has another content than the one that is stored or counts.
    """
    both = beside(new, stored.select(key, F.col(content).alias("stored__")), key, content)
    conflicts = both.where(conflicting(content)).select(key, F.lit(STORAGE_CONFLICT).alias("code")).distinct()
    return both.where("n__ = 1 AND stored__ IS NULL").select(*new.columns), conflicts


def with_activity(saved: DataFrame, invalidated: DataFrame | None = None) -> DataFrame:
    """``saved`` (subject_id, model_id, phase, parent_id, evaluation_id, created_at) with ``is_active``.

    The log only grows. The latest PRE of a subject and model is active; the latest POST is if its
    parent is that PRE. ``invalidated`` has (evaluation_id) of rows that were taken back.
    """
    rows = saved
    if invalidated is not None:
        rows = rows.join(invalidated.select("evaluation_id").distinct().withColumn("gone__", F.lit(True)), "evaluation_id", "left")
    else:
        rows = rows.withColumn("gone__", F.lit(None).cast("boolean"))
    order = Window.partitionBy("subject_id", "model_id", "phase").orderBy(F.desc("created_at"), F.desc("evaluation_id"))
    rows = rows.withColumn("latest__", (F.row_number().over(order) == 1) & F.col("gone__").isNull())
    pre = rows.where("phase = 'PRE' AND latest__").select(F.col("evaluation_id").alias("active_pre__"))
    rows = rows.join(pre, F.col("parent_id") == F.col("active_pre__"), "left")
    active = F.col("latest__") & ((F.col("phase") == "PRE") | F.col("active_pre__").isNotNull())
    return rows.withColumn("is_active", active).drop("gone__", "latest__", "active_pre__")


def explain(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Both sides' probabilities of each match before and after the draft, and the change in points."""
    both = pre.select("game_id", F.col("p").alias("pre_blue")).join(post.select("game_id", F.col("p").alias("post_blue")), "game_id")
    return both.select(
        "game_id", "pre_blue", (1 - F.col("pre_blue")).alias("pre_red"), "post_blue", (1 - F.col("post_blue")).alias("post_red"),
        ((F.col("post_blue") - F.col("pre_blue")) * 100).alias("blue_points"), ((F.col("pre_blue") - F.col("post_blue")) * 100).alias("red_points"),
    )


def verify(stored: DataFrame, scored: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Stored evaluations whose probability differs from a new scoring by more than the tolerance (null-safe); must be empty."""
    both = stored.select("game_id", "phase", F.col("p").alias("stored_p")).join(scored.select("game_id", "phase", F.col("p").alias("new_p")), ["game_id", "phase"], "full")
    return both.where(F.col("stored_p").isNull() | F.col("new_p").isNull() | (F.abs(F.col("stored_p") - F.col("new_p")) > tolerance))
