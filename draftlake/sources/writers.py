"""Sinks: versions of the target tables behind a log of commits, and reports.

A version is a folder that is complete before a commit names it, so a lost executor or driver
leaves the old version in place. Paths are Hadoop paths; files are only written by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake import schemas as C
from draftlake.operators import reconcile as R
from draftlake.sources.versions import Log, commit, only_skips


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the latest version that was published."""
    log = Log(spark, root)
    last = log.latest()
    return log.entry(last)["folder"] if last else None


def publish(spark: SparkSession, root: str, version: str, planned: dict[str, DataFrame], snapshot: dict[str, DataFrame], base: int | None = None) -> int:
    """Write the nine tables after ``planned`` as a new version in the folder ``version``, check that a replay would only skip, and commit it.

    ``base`` is the commit that the plan was made on (None: the latest as this begins). If another version has been committed since, this one stays
    unpublished and fails with E_VERSION_BASE_MOVED; ``versions.apply`` plans again instead.
    """
    base = Log(spark, root).latest() if base is None else base
    tables = {t: (R.applied(planned[t], snapshot[t], list(keys)), list(keys)) for t, keys in C.TARGET_KEYS.items()}
    replay = lambda back: only_skips({t: R.actions(planned[t].drop("action"), back[t], list(k)) for t, k in C.TARGET_KEYS.items()})
    return commit(spark, root, base, tables, version, replay)


def backfill_times(games: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``games`` with start and end from proven times where they are null, and the violations (must be empty): a start not before its end, a known time changed."""
    own = times.where("reason IS NULL").select("game_id", F.col("started_at").alias("s__"), F.col("ended_at").alias("e__"))
    both = games.join(own, "game_id", "left")
    bad = both.where("(started_at <> s__) OR (ended_at <> e__) OR (coalesce(started_at, s__) >= coalesce(ended_at, e__))").select("game_id")
    out = both.withColumns({"started_at": F.coalesce("started_at", "s__"), "ended_at": F.coalesce("ended_at", "e__")})
    return out.drop("s__", "e__"), bad


def write_report(frame: DataFrame, path: str, order: list[str]) -> None:
    """A report of aggregates as one CSV with header, sorted with nulls last; never over an existing one."""
    frame.orderBy(*(F.asc_nulls_last(c) for c in order)).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def markdown(frame: DataFrame, most: int = 1000) -> str:
    """A Markdown table of rows of aggregates; if there are over ``most``, a last line says that more were left out."""
    from draftlake.functions.scalars import markdown_cell

    rows = frame.select(*(markdown_cell(F.col(c).cast("string")).alias(c) for c in frame.columns)).limit(most + 1).collect()
    lines = ["| " + " | ".join(frame.columns) + " |", "| " + " | ".join("---" for _ in frame.columns) + " |", *("| " + " | ".join(r) + " |" for r in rows[:most])]
    return "\n".join(lines + [f"\nOnly the first {most} rows are shown."] * (len(rows) > most))


def append_new(rows: DataFrame, existing: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key is new."""
    rows.join(existing.select(*keys), keys, "left_anti").write.mode("append").parquet(path)
