"""Sessions: UTC, adaptive plans, and nothing that fits one machine only."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("draftlake").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each context."""
    context = spark.sparkContext
    if not getattr(context, "_draftlake_shipped", False):
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="draftlake-package-")  # the driver serves the archive from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/draftlake", "zip", package.parent, package.name))
        context._draftlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches: ``spark.checkpoint.dir`` of the session.

    Only a local master may run without that setting (tests); it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and (made := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = made.get()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="draftlake-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: later plans start from a table of known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/draftlake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


PART_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to so many tasks that each sorts about PART_ROWS rows, however many there are."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.count()
    return df.repartition(max(usual, rows // PART_ROWS + 1), *keys) if rows > PART_ROWS * usual else df
