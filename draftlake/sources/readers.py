"""Scans: the source feed, relational snapshots, JSON archives and catalogs, with their checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake import schemas as C


def feed_columns(spark: SparkSession, path: str) -> list[str]:
    """The header of a CSV feed."""
    return spark.read.csv(path, header=True).columns


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV feed as text, blanks kept, a byte-order mark dropped from the first name."""
    raw = spark.read.csv(path, header=True, inferSchema=False, nullValue="\x00", emptyValue="", encoding="UTF-8", escape='"')
    return raw.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in raw.columns})


def read_core(spark: SparkSession, path: str) -> DataFrame:
    """The core columns in contract order; only they are parsed."""
    feed = read_feed(spark, path)
    if gone := [c for c in C.CORE_COLUMNS if c not in feed.columns]:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return feed.select(*C.CORE_COLUMNS)


def read_snapshot(spark: SparkSession, folder: str, tables: Iterable[str] = tuple(C.TARGET_KEYS)) -> dict[str, DataFrame]:
    """The target tables of one version's folder."""
    return {t: spark.read.parquet(f"{folder}/{t}") for t in tables}


TIME_ROW = T.StructType(
    [T.StructField(n, k) for n, k in (("game_id", T.StringType()), ("status", T.StringType()), ("start_timestamp_ms", T.LongType()), ("end_timestamp_ms", T.LongType()), ("started_at", T.StringType()), ("ended_at", T.StringType()), ("revision_id", T.LongType()))]
)


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON arrays of match times, with their file; a malformed file fails."""
    rows = spark.read.schema(TIME_ROW).json(path, multiLine=True, mode="FAILFAST")
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"))


ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)\z"


def time_reason(platform: str | None = None) -> F.Column:
    """Why a time row proves nothing, null if it does; the first reason counts."""
    start, end = F.col("start_timestamp_ms"), F.col("end_timestamp_ms")
    millis = lambda c: F.unix_millis(F.col(c).try_cast("timestamp"))
    chain = F.when(F.coalesce(F.col("status"), F.lit("")) != "OK", "E_TIME_SOURCE_NOT_SUCCESS").when(start.isNull() | end.isNull(), "E_TIME_MILLISECONDS_INVALID").when(start >= end, "E_TIME_ORDER_INVALID")
    chain = chain.when(~(F.coalesce(F.col("started_at").rlike(ISO), F.lit(False)) & F.coalesce(F.col("ended_at").rlike(ISO), F.lit(False))), "E_TIME_TIMESTAMP_INVALID")
    chain = chain.when((millis("started_at") != start) | (millis("ended_at") != end), "E_TIME_SOURCE_CONFLICT")
    return chain.when(~F.col("game_id").startswith(platform), "E_TIME_IDENTITY_CONFLICT") if platform else chain


def load_times(rows: DataFrame) -> DataFrame:
    """One row a match: its only valid pair of times, else the reason (conflict or the first error)."""
    judged = rows.withColumn("reason", time_reason())
    pair = F.when(F.col("reason").isNull(), F.struct("start_timestamp_ms", "end_timestamp_ms"))
    own = judged.groupBy("game_id").agg(F.countDistinct(pair).alias("n"), F.min(pair).alias("times"), F.min("reason").alias("reason"))
    return own.select(
        "game_id", F.when(F.col("n") == 1, F.timestamp_millis("times.start_timestamp_ms")).alias("started_at"), F.when(F.col("n") == 1, F.timestamp_millis("times.end_timestamp_ms")).alias("ended_at"),
        F.when(F.col("n") > 1, "E_TIME_RETRIEVAL_CONFLICT").when(F.col("n") == 0, F.col("reason")).alias("reason"),
    )


def read_champions(spark: SparkSession, path: str) -> DataFrame:
    """A champion catalog {data: {name: {id, key, name}}}, by numeric key."""
    kind = "data map<string, struct<id: string, key: string, name: string>>"
    rows = spark.read.schema(kind).json(path, multiLine=True, mode="FAILFAST").select(F.explode("data").alias("name", "row"))
    return rows.select(F.col("row.key").alias("champion_id"), F.col("row.id").alias("canonical_name"), F.col("row.name").alias("display_name")).orderBy(F.col("champion_id").cast("int"))


def read_catalog(spark: SparkSession, path: str, required: Iterable[str], unique: str) -> DataFrame:
    """A staging CSV: required columns, required values and a unique key, or failure."""
    from draftlake.operators.joins import checked_unique

    rows = read_feed(spark, path)
    if gone := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    for c in required:
        rows = rows.withColumn(c, F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.raise_error(F.lit(f"a blank {c}"))).otherwise(F.col(c)))
    return checked_unique(rows, unique)


def display_catalog(t: dict[str, DataFrame]) -> DataFrame:
    """Games with stage and tournament names, through the series where there is one."""
    stages = t["tournament_stage"].join(t["tournament"].withColumnRenamed("name", "tournament"), "tournament_id", "left").select("stage_id", F.col("name").alias("stage"), "tournament")
    games = t["game"].join(t["series"].select("series_id", F.col("stage_id").alias("series_stage")), "series_id", "left")
    return games.withColumn("stage_id", F.coalesce("stage_id", "series_stage")).join(stages, "stage_id", "left").select("game_id", "stage_id", "stage", "tournament")
