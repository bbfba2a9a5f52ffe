"""Imports of evaluations that may be run again: rows and the note that they are in are one commit.

A batch is written to a folder of its own; the folder counts only once a commit of the log (``versions.Log``) names it and
the batch. A run that died in between left a folder that nobody reads, and its batch is imported again. A batch
that is in the log is compared with what is stored and writes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from draftlake.operators import evaluate as E
from draftlake.session import settled
from draftlake.sources.versions import Log

MISMATCH = "E_IMPORT_MISMATCH"
TOLERANCE = 1e-12
IMPORTED, VERIFIED = "IMPORTED", "VERIFIED"


class ImportError_(RuntimeError):
    """A refused batch; the message begins with its code."""


class Ledger:
    """The batches imported under ``root``, and their rows."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.log, self.schema = spark, Log(spark, root), schema

    def entries(self) -> list[dict]:
        return [self.log.entry(n) for n in range(1, self.log.latest() + 1)]

    def rows(self, entries: list[dict] | None = None) -> DataFrame:
        folders = [f"{self.log.root}/{e['folder']}" for e in (self.entries() if entries is None else entries) if e["rows"]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def import_batch(self, batch: DataFrame, batch_id: str | int, source: str = "stream", tries: int = 5) -> str:
        """IMPORTED, or VERIFIED if this batch of this source was imported before.

        ``batch`` has idempotency_key, content_sha256, created_at and p. A key that is stored with the same content is skipped once its p agrees within
        TOLERANCE; with another content, or another p, the whole batch fails and nothing of it is kept.
        """
        for _ in range(tries):
            entries = self.entries()
            stored = self.rows(entries)
            own = [e for e in entries if (e["source"], e["batch"]) == (source, str(batch_id))]
            if own:
                # its own folder has all of it but the keys that others had stored before
                rows = batch.select("idempotency_key", "content_sha256", "p")
                beside = rows.join(_known(self.rows(own)), "idempotency_key", "left")
                found = beside.agg(_first(_apart(), "apart"), _first(F.col("there__").isNull(), "lost")).first()
                if found.lost is not None and found.apart is None and len(entries) > len(own):
                    rest = settled(beside.where("there__ IS NULL").select(*rows.columns), "import-rest")
                    beside = rest.join(_known(self.rows([e for e in entries if e not in own])), "idempotency_key", "left")
                    found = beside.agg(_first(_apart(), "apart"), _first(F.col("there__").isNull(), "lost")).first()
                self._refuse(found.apart)
                if found.lost is not None:
                    raise ImportError_(f"{MISMATCH}: {found.lost} of batch {batch_id} is not stored")
                return VERIFIED
            # judged as it is written: the folder of a refused batch is in no commit and goes
            seen = Observation()
            hit = settled(stored.select("idempotency_key").join(batch.select("idempotency_key"), "idempotency_key", "left_semi"), "import-hit")  # few, as a rule: contents stay where they are
            both = E.beside(batch, _known(stored.join(hit, "idempotency_key", "left_semi"))).observe(seen, _first(_apart(), "apart"), _first(E.conflicting(), "conflict"))
            folder = f"batches/{source}-{batch_id}-{uuid.uuid4().hex}"
            both.where("n__ = 1 AND stored__ IS NULL").select(*batch.columns).write.mode("errorifexists").parquet(f"{self.log.root}/{folder}")
            told = seen.get
            if told.get("apart") is not None or told.get("conflict") is not None:
                self.log.fs.delete(self.log._path(folder), True)
            self._refuse(told.get("apart"))
            if told.get("conflict") is not None:
                raise ImportError_(f"{E.STORAGE_CONFLICT}: {told['conflict']}")
            n = self.spark.read.schema(self.schema).parquet(f"{self.log.root}/{folder}").count()
            if self.log.add(len(entries) + 1, {"source": source, "batch": str(batch_id), "folder": folder, "rows": n}):
                return IMPORTED  # else another import was first: look at what it has stored
        raise ImportError_(f"{E.STORAGE_CONFLICT}: {tries} imports were first")

    def _refuse(self, apart: str | None) -> None:
        if apart is not None:
            raise ImportError_(f"{MISMATCH}: {apart}")


def _known(stored: DataFrame) -> DataFrame:
    return stored.select("idempotency_key", F.col("content_sha256").alias("stored__"), F.col("p").alias("stored_p__"), F.lit(True).alias("there__"))


def _apart() -> Column:
    """Whether a row beside a stored one has its content but another p."""
    return (F.col("stored__") == F.col("content_sha256")) & (F.col("p").isNull() | F.col("stored_p__").isNull() | (F.abs(F.col("stored_p__") - F.col("p")) > TOLERANCE))


def _first(bad: Column, name: str) -> Column:
    return F.min(F.when(bad, F.coalesce("idempotency_key", F.lit("null")))).alias(name)


def start(ledger: Ledger, stream: DataFrame, checkpoint: str, source: str = "stream"):
    """Import a stream batch by batch and stop when it has caught up."""
    work = lambda batch, batch_id: ledger.import_batch(batch, batch_id, source)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
