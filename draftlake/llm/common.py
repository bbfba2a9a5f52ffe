"""What the training-data operators share: the shared folder, tables written to it, table paths."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


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


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/draftlake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each context; batches sent to them stay small, as texts may be long."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    if not getattr(context, "_draftlake_shipped", False):
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="draftlake-package-")  # the driver serves the archive from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/draftlake", "zip", package.parent, package.name))
        context._draftlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_held(rows: DataFrame, names: DataFrame, key: str, part: int = 1000) -> DataFrame:
    """``rows`` with what ``names`` (``key`` unique, ``held``: the rows that hold it) says of their key.

    Fewer than ``part`` keys can each be held by over a ``part``-th of all rows: only those are broadcast,
    so that no task of the join gets the rows of a hot key. Both tables are read twice and should be stored ones.
    """
    total = names.agg(F.sum("held")).first()[0] or 0
    hot = names.where(F.col("held") * part > total).drop("held")
    rest = names.where(F.col("held") * part <= total).drop("held")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name (its own lookup takes a dot in a name for a field); ``work`` sees the names of ``df``."""
    names = df.columns
    plain = [f"c{i}" for i in range(len(kind))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=plain)

    fields = [T.StructField(c, f.dataType) for c, f in zip(plain, kind.fields, strict=True)]
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, T.StructType(fields)).toDF(*kind.names)


def free_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column) -> F.Column:
    """A text column as its bytes, null as none."""
    return F.coalesce(column.cast("binary"), F.lit(b""))
