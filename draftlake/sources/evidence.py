"""JSON documents that prove something: strict parsing (no repeated key, no NaN or infinity), digests, headers, and archives of time rows.

A document is a small file and is parsed on the driver; archives are arrays of any size that tasks read by ranges (``json_array``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlake.session import settled
from draftlake.sources.json_array import DUPLICATE_KEY, INVALID, NON_FINITE, RANGE, UNREADABLE, EvidenceError, file_digests, read_array, strict_decoder

__all__ = ["DUPLICATE_KEY", "NON_FINITE"]
# Why a document is refused.
SCHEMA, CHANGED = "E_EVIDENCE_SCHEMA", "E_TIME_SOURCE_CHANGED"


def strict_json(text: str):
    """The value of a JSON text without repeated keys and with finite numbers only."""
    try:
        return strict_decoder().decode(text)
    except json.JSONDecodeError as error:
        raise EvidenceError(f"{INVALID}: {error}") from None


def canonical_digest(value) -> str:
    """SHA-256 of a value's JSON with sorted keys, without blanks, in UTF-8; -0.0 counts as 0.0 and NaN as null."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        if isinstance(x, float):
            return None if x != x else x + 0.0
        return x

    return hashlib.sha256(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def read_document(spark: SparkSession, path: str, header: dict | None = None, required: Iterable[str] = ()) -> tuple[dict, str]:
    """(the object, the SHA-256 of the file) of one JSON file; ``header`` must hold as it is, ``required`` keys must be there."""
    rows = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
    if len(rows) != 1:
        raise EvidenceError(f"{UNREADABLE}: {path}")
    content = bytes(rows[0].content)
    found = strict_json(content.decode("utf-8"))
    if not isinstance(found, dict) or any(found.get(k) != v for k, v in (header or {}).items()) or any(k not in found for k in required):
        raise EvidenceError(f"{SCHEMA}: {path}")
    return found, hashlib.sha256(content).hexdigest()


def media_exclusions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(name) of the files of a kind that a policy {schema_version, exclusions: {kind: [names]}} keeps out; a small table to broadcast."""
    policy, _ = read_document(spark, path, {"schema_version": 1}, ["exclusions"])
    names = policy["exclusions"].get(kind, [])
    if len(set(names)) < len(names) or any(not isinstance(n, str) or not n.strip() for n in names):
        raise EvidenceError(f"{SCHEMA}: {path}")
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


ARCHIVE_ROW = "game_id string, status string, start_timestamp_ms long, end_timestamp_ms long, started_at string, ended_at string, revision_id string"


def read_archive(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Rows of the JSON arrays under ``path`` with source_file and source_sha256; a file that breaks the rules fails the read."""
    rows = read_array(spark, path, f"{ARCHIVE_ROW}, source_file string", range_bytes)
    return rows.join(file_digests(spark, path).drop("n_bytes"), "source_file").select(*(c.split()[0] for c in ARCHIVE_ROW.split(", ")), "source_file", "source_sha256")


# Why a match has no proven times.
(
    DUPLICATE_GAME, RAW_MISSING, SUMMARY_MISSING, NOT_SUCCESS, MILLISECONDS, TIMESTAMP, TIME_CONFLICT, TIME_ORDER,
    PAYLOAD_MISSING, IDENTITY, RETRIEVAL, REVISION, REVISION_CONFLICT,
) = (
    "E_TIME_DUPLICATE_GAME_ID", "E_TIME_RAW_MISSING", "E_TIME_SUMMARY_MISSING", "E_TIME_SOURCE_NOT_SUCCESS", "E_TIME_MILLISECONDS_INVALID", "E_TIME_TIMESTAMP_INVALID", "E_TIME_SOURCE_CONFLICT", "E_TIME_ORDER_INVALID",
    "E_TIME_PAYLOAD_MISSING", "E_TIME_IDENTITY_CONFLICT", "E_TIME_RETRIEVAL_CONFLICT", "E_TIME_REVISION_INVALID", "E_TIME_REVISION_CONFLICT",
)
GRADE = "LOCAL_ARCHIVED_V5_CONSISTENT_WITH_SNAPSHOT"
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})\z"
NAMES = ("matchId", "game_id", "RiotPlatformGameId", "requested_riot_platform_game_id")  # fixed: fields that repeat the match's id
SUMMARY_ROW = "game_id string, status string, start_timestamp_ms long, end_timestamp_ms long, started_at string, ended_at string, revision_id string, revision_timestamp_utc string, source_file string, source_order long"
EXPORT_ROW = SUMMARY_ROW + ", matchId string, RiotPlatformGameId string, requested_riot_platform_game_id string, fetched_at_utc string, raw_payload string"
PAYLOAD = "platformId string, gameId long, gameStartTimestamp long, gameEndTimestamp long, " + ", ".join(f"{n} string" for n in NAMES) + ", metadata struct<matchId: string>"
GAME_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]*\z"


def _iso(c: str) -> Column:
    """The moment that a strict ISO timestamp names, null for any other text."""
    return F.when(F.col(c).rlike(ISO), F.col(c).try_cast("timestamp"))


def _known_revision(prefix: str = "") -> Column:
    return F.col(f"{prefix}revision_id").isNotNull() | F.col(f"{prefix}revision_timestamp_utc").isNotNull()


def _revision_fault() -> Column:
    whole = F.col("revision_id").rlike(r"^[1-9]\d*\z") & F.col("revision_timestamp_utc").isNotNull()
    return F.when(_known_revision() & ~F.coalesce(whole, F.lit(False)), REVISION).when(_known_revision() & _iso("revision_timestamp_utc").isNull(), TIMESTAMP)


def _time_fault() -> Column:
    """What is wrong with a row's own times; the first fault counts."""
    start, end = F.col("start_timestamp_ms"), F.col("end_timestamp_ms")
    good = lambda c: F.coalesce(c >= 0, F.lit(False))
    return (
        F.when(F.coalesce(F.col("status") != "SUCCESS", F.lit(True)), NOT_SUCCESS)
        .when(~good(start) | ~good(end), MILLISECONDS)
        .when(_iso("started_at").isNull() | _iso("ended_at").isNull(), TIMESTAMP)
        .when((F.unix_micros(_iso("started_at")) != start * 1000) | (F.unix_micros(_iso("ended_at")) != end * 1000), TIME_CONFLICT)
        .when(start >= end, TIME_ORDER)
    )


def _numbered(rows: DataFrame, files: list[str]) -> DataFrame:
    """Rows with a checked id, in the order of the files; ``copy``: an earlier row has the same id."""
    bad = F.coalesce(~(F.col("game_id").rlike(GAME_ID) & (F.length("game_id") <= 100)), F.lit(True))
    rows = rows.withColumn("game_id", F.when(bad, F.raise_error(F.concat(F.lit("E_ID_INVALID: "), F.coalesce("game_id", F.lit("<NULL>"))))).otherwise(F.col("game_id")))
    place = F.array_position(F.array(*map(F.lit, files)), F.col("source_file"))
    own = Window.partitionBy("game_id").orderBy(place, "source_order")
    return rows.withColumn("copy", F.row_number().over(own) > 1)


def load_time_archive(spark: SparkSession, summary: str, exports: list[str], range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, exclusions, sources) of a summary and the exports that it sums up, each a JSON array.

    A candidate is a match of one summary row and one export row whose times, payload, identity and revision agree; ``raw_payload_sha256``
    is the digest of the payload's canonical JSON. An exclusion has all codes found (``diagnostics``) and the one that counts. ``sources`` are the
    files with their digests, which are taken before and after the rows are read: a file that changed fails with E_TIME_SOURCE_CHANGED.
    """
    files = [summary, *exports]
    sources = settled(file_digests(spark, files), "time-sources")
    told = settled(_numbered(read_array(spark, summary, SUMMARY_ROW, range_bytes, lenient=True), [summary]), "time-summary")
    rows = settled(_numbered(read_array(spark, exports, EXPORT_ROW, range_bytes, lenient=True), exports), "time-exports")
    if not unchanged(sources, file_digests(spark, files)).isEmpty():
        raise EvidenceError(CHANGED)

    fault = F.coalesce(_time_fault(), _revision_fault())
    told = told.withColumn("fault", F.when(F.col("copy"), DUPLICATE_GAME).otherwise(fault))
    sound = told.where("fault IS NULL").select("game_id", *(F.col(c).alias(f"told_{c}") for c in ("start_timestamp_ms", "end_timestamp_ms", "revision_id", "revision_timestamp_utc", "source_order")))
    p = F.col("payload")
    ours = lambda c: F.coalesce(c != F.col("game_id"), F.lit(False))
    number = F.concat_ws("_", p["platformId"], p["gameId"].cast("string"))
    identity = F.coalesce((F.trim(p["platformId"]) == "") | (p["gameId"] <= 0) | p["platformId"].isNull() | p["gameId"].isNull() | (number != F.col("game_id")), F.lit(True))
    for c in (*(F.col(n) for n in NAMES if n != "game_id"), *(p[n] for n in NAMES), p["metadata"]["matchId"]):
        identity = identity | ours(c)
    good = lambda c: F.coalesce(c >= 0, F.lit(False))
    fault = F.coalesce(
        F.when(F.col("told_start_timestamp_ms").isNull(), SUMMARY_MISSING), _time_fault(),
        F.when((F.col("start_timestamp_ms") != F.col("told_start_timestamp_ms")) | (F.col("end_timestamp_ms") != F.col("told_end_timestamp_ms")), TIME_CONFLICT)
        .when(~F.coalesce(F.col("raw_payload").startswith("{"), F.lit(False)), PAYLOAD_MISSING).when(identity, IDENTITY)
        .when(~good(p["gameStartTimestamp"]) | ~good(p["gameEndTimestamp"]), MILLISECONDS)
        .when((p["gameStartTimestamp"] != F.col("start_timestamp_ms")) | (p["gameEndTimestamp"] != F.col("end_timestamp_ms")), TIME_CONFLICT)
        .when(_iso("fetched_at_utc").isNull(), TIMESTAMP).when(F.unix_micros(_iso("fetched_at_utc")) < F.col("end_timestamp_ms") * 1000, RETRIEVAL),
        _revision_fault(),
        F.when(
            _known_revision() & _known_revision("told_") & ((F.col("revision_id") != F.col("told_revision_id")) | (_iso("revision_timestamp_utc") != _iso("told_revision_timestamp_utc"))), REVISION_CONFLICT
        ),
    )
    judged = rows.withColumn("payload", F.from_json("raw_payload", PAYLOAD)).join(sound, "game_id", "left")
    judged = settled(judged.withColumn("fault", F.when(F.col("copy"), DUPLICATE_GAME).otherwise(fault)).drop("payload"), "time-judged")

    unread = told.select("game_id").distinct().join(rows.select("game_id").distinct(), "game_id", "left_anti").select("game_id", F.lit(RAW_MISSING).alias("fault"))
    faults = told.select("game_id", "fault").union(judged.select("game_id", "fault")).union(unread).where("fault IS NOT NULL")
    found = faults.groupBy("game_id").agg(F.sort_array(F.collect_set("fault")).alias("diagnostics"))
    reason = F.when(F.array_contains("diagnostics", DUPLICATE_GAME), DUPLICATE_GAME).otherwise(F.element_at("diagnostics", 1))
    exclusions = settled(found.select("game_id", reason.alias("reason"), "diagnostics"), "time-exclusions")
    proofs = judged.where("fault IS NULL").join(exclusions, "game_id", "left_anti").select(
        "game_id", F.lit(GRADE).alias("grade"), "start_timestamp_ms", "end_timestamp_ms", F.timestamp_millis("start_timestamp_ms").alias("started_at"), F.timestamp_millis("end_timestamp_ms").alias("ended_at"),
        _iso("fetched_at_utc").alias("fetched_at"), F.when(_known_revision(), "PRESENT").otherwise("MISSING").alias("revision_status"), "revision_id", _iso("revision_timestamp_utc").alias("revision_at"),
        F.sha2("raw_payload", 256).alias("raw_payload_sha256"), "source_file", "source_order", F.col("told_source_order").alias("summary_order"),
    )
    return proofs.join(sources.select("source_file", "source_sha256"), "source_file"), exclusions, sources


# Why a match of a snapshot has no proof.
SNAPSHOT_DUPLICATE, ARCHIVE_MISSING, SNAPSHOT_MISSING, SNAPSHOT_CONFLICT = "E_TIME_SNAPSHOT_DUPLICATE", "E_TIME_ARCHIVE_MISSING", "E_TIME_SNAPSHOT_MISSING", "E_TIME_SNAPSHOT_CONFLICT"


def resolve_proofs(games: DataFrame, candidates: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proofs, exclusions with game_id, reason, diagnostics) of a snapshot's games (game_id, started_at, ended_at): the archive's exclusion counts first, then what is missing, then a conflict. A repeated game fails."""
    counted = games.withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy("game_id")))
    checked = counted.withColumn("game_id", F.when(F.col("n__") > 1, F.raise_error(F.concat(F.lit(f"{SNAPSHOT_DUPLICATE}: "), "game_id"))).otherwise(F.col("game_id")))
    own = checked.select("game_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("s__"), F.unix_micros(F.col("ended_at").cast("timestamp")).alias("e__"))
    both = own.join(exclusions, "game_id", "left").join(candidates, "game_id", "left")
    why = F.coalesce(
        "reason", F.when(F.col("grade").isNull(), ARCHIVE_MISSING).when(F.col("s__").isNull() | F.col("e__").isNull(), SNAPSHOT_MISSING)
        .when((F.col("s__") != F.col("start_timestamp_ms") * 1000) | (F.col("e__") != F.col("end_timestamp_ms") * 1000), SNAPSHOT_CONFLICT)
    )
    judged = both.withColumn("reason", why)
    return judged.where("reason IS NULL").select(*candidates.columns), judged.where("reason IS NOT NULL").select("game_id", "reason", "diagnostics")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_file, code) of files whose digest is another than before, or that only one reading has; must be empty."""
    both = before.select("source_file", F.col("source_sha256").alias("a")).distinct().join(after.select("source_file", F.col("source_sha256").alias("b")).distinct(), "source_file", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("source_file", F.lit(CHANGED).alias("code"))


def as_text(rows: DataFrame) -> DataFrame:
    """All columns as text, null as the empty string."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns))
