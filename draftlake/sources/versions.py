"""Versions of a set of tables: a log of commits that only one writer can extend at a time, and reads of one pinned version.

A version is a folder of tables that is complete before a commit names it. Commits are numbered files; number n can be
made once (a hard link or a rename that does not replace: local file systems and HDFS have these, plain object stores do not), and a
commit names the version that it was planned on. So of two writers that planned on one base one wins; the other plans again
on the new base or gives up. A commit has the manifest: of each table the files with their sizes, the rows,
the first and last key and the root of its hash tree, so any later change of a file is found.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from draftlake.operators import merkle
from draftlake.operators import reconcile as R
from draftlake.schemas import TARGET_KEYS

BASE_MOVED, FILE_MISSING, FILE_CHANGED, DIGEST, NOT_APPLIED, NO_VERSION, NOT_APPROVED = (
    "E_VERSION_BASE_MOVED", "E_VERSION_FILE_MISSING", "E_VERSION_FILE_CHANGED", "E_VERSION_DIGEST", "E_VERSION_NOT_APPLIED", "E_VERSION_UNKNOWN", "E_PLAN_NOT_APPROVED",
)


class VersionError(RuntimeError):
    """A refused commit or read; the message begins with its code."""


class Log:
    """The commits under ``root``, by number from 1."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.folder = self._path("_commits")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def latest(self) -> int:
        """The number of the last commit, 0 without one."""
        if not self.fs.exists(self.folder):
            return 0
        return max((int(s.getPath().getName()) for s in self.fs.listStatus(self.folder) if s.getPath().getName().isdigit()), default=0)

    def entry(self, number: int) -> dict:
        path = self._path(f"_commits/{number:020d}")
        if not self.fs.exists(path):
            raise VersionError(f"{NO_VERSION}: {number} of {self.root}")
        return json.loads("\n".join(r.value for r in self.spark.read.text(path.toString()).collect()))  # one small file

    def add(self, number: int, entry: dict) -> bool:
        """Make commit ``number``; False if somebody else has made it. The file is whole before it gets its name."""
        draft, final = self._path(f"_commits/.{uuid.uuid4().hex}"), self._path(f"_commits/{number:020d}")
        self.fs.mkdirs(self.folder)
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        out.close()
        try:
            if draft.toUri().getScheme() in (None, "file") or self.fs.getScheme() == "file":
                paths = [self.jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0)) for p in (final, draft)]
                self.jvm.java.nio.file.Files.createLink(*paths)
                return True
            return bool(self.fs.rename(draft, final))  # HDFS: false if the name is taken
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the data files of a table's folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(path) if s.isFile() and s.getPath().getName()[0] not in "._")


def _describe(spark: SparkSession, folder: str, keys: list[str], rows: DataFrame) -> dict:
    digest, n = merkle.root(nodes := merkle.tree(rows, keys))
    ends = nodes.where("level = 0").agg(F.min_by("low", "block").alias("low"), F.max_by("high", "block").alias("high")).first()
    return {"files": _files(spark, folder), "rows": n, "low": ends.low, "high": ends.high, "digest": digest, "schema": rows.schema.json()}


def commit(
    spark: SparkSession, root: str, base: int, tables: dict[str, tuple[DataFrame, list[str]]], folder: str | None = None, verify: Callable[[dict[str, DataFrame]], None] | None = None, note: dict | None = None
) -> int:
    """Write ``tables`` (name to rows and keys) as version ``base + 1``; fails with BASE_MOVED if the log has gone on since ``base``.

    Rows are counted as they are written; a table that reads back with other counts is not committed, nor is anything that ``verify`` refuses
    of the tables as read back.
    """
    log = Log(spark, root)
    folder = folder or f"versions/{base + 1:020d}-{uuid.uuid4().hex}"
    manifest, back = {}, {}
    for name, (rows, keys) in tables.items():
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{log.root}/{folder}/{name}")
        back[name] = written = spark.read.schema(rows.schema).parquet(f"{log.root}/{folder}/{name}")
        manifest[name] = _describe(spark, f"{log.root}/{folder}/{name}", keys, written)
        if manifest[name]["rows"] != seen.get["n"]:
            raise VersionError(f"{DIGEST}: {name}: {seen.get['n']} rows written, {manifest[name]['rows']} read")
    if verify:
        verify(back)
    entry = {"version": base + 1, "base": base, "folder": folder, "tables": manifest, "keys": {n: k for n, (_, k) in tables.items()}, "note": note or {}}
    entry["digest"] = hashlib.sha256(json.dumps([(n, t["digest"]) for n, t in sorted(manifest.items())]).encode()).hexdigest()
    if not log.add(base + 1, entry):
        raise VersionError(f"{BASE_MOVED}: version {base + 1} of {root} is another's")
    return base + 1


def read_version(spark: SparkSession, root: str, version: int | None = None, tables: dict[str, list[str] | None] | Iterable[str] | None = None, deep: bool = False) -> dict[str, DataFrame]:
    """The tables of one version (None: the latest), each with the columns asked for (None: all), rows ordered by key within range partitions.

    Only the manifest's files are read. A missing file or one of another size fails by code; ``deep`` computes the hash trees again.
    """
    log = Log(spark, root)
    entry = log.entry(version or log.latest())
    asked = tables if isinstance(tables, dict) else dict.fromkeys(tables or entry["tables"])
    out = {}
    for name, columns in asked.items():
        if name not in entry["tables"]:
            raise VersionError(f"{NO_VERSION}: no table {name} in version {entry['version']}")
        told, folder = entry["tables"][name], f"{log.root}/{entry['folder']}/{name}"
        there = dict(_files(spark, folder))
        for file, size in told["files"]:
            if file not in there:
                raise VersionError(f"{FILE_MISSING}: {name}/{file}")
            if there[file] != size:
                raise VersionError(f"{FILE_CHANGED}: {name}/{file}")
        kind = _schema(told["schema"])
        rows = spark.read.schema(kind).parquet(*(f"{folder}/{file}" for file, _ in told["files"])) if told["files"] else spark.createDataFrame([], kind)
        keys = entry["keys"][name]
        if deep and merkle.root(merkle.tree(rows, keys))[0] != told["digest"]:
            raise VersionError(f"{DIGEST}: {name}")
        ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        out[name] = ordered.select(*columns) if columns else ordered
    return out


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def changed_since(spark: SparkSession, root: str, old: int, new: int) -> dict[str, tuple[str | None, str | None]]:
    """Digests of the tables that differ between two versions, from their manifests alone."""
    a, b = (Log(spark, root).entry(v)["tables"] for v in (old, new))
    digest = lambda t, n: t[n]["digest"] if n in t else None
    return {n: (digest(a, n), digest(b, n)) for n in sorted({*a, *b}) if digest(a, n) != digest(b, n)}


def only_skips(planned: dict[str, DataFrame]) -> None:
    """Fail if a plan would still insert or update."""
    left = [t for t, p in planned.items() if not p.where(F.col("action") != R.SKIP).isEmpty()]
    if left:
        raise VersionError(f"{NOT_APPLIED}: {', '.join(left)}")


def apply(spark: SparkSession, root: str, plan: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], empty: dict[str, DataFrame], approved: Iterable[str] = ("INITIAL", "MIXED"), tries: int = 5) -> tuple[int, str]:
    """(version, state): plan on the latest version of the target tables, write, plan again on what was written, and commit.

    ``plan`` turns a snapshot into candidates with actions (``reconcile.actions``) by table; ``empty`` stands for the version before the first. A plan that only skips
    is ALREADY_APPLIED and commits nothing. A state that is not approved fails before anything is written. What the second plan would still insert or
    update fails the commit. If another writer was first, the whole is planned again on its version, up to ``tries`` times.
    """
    log = Log(spark, root)
    for _ in range(tries):
        base = log.latest()
        snapshot = read_version(spark, root, base) if base else empty
        planned = plan(snapshot)
        kinds = {r.action for r in reduce(DataFrame.union, [p.select("action").distinct() for p in planned.values()]).distinct().collect()}
        state = "ALREADY_APPLIED" if kinds <= {R.SKIP} else "INITIAL" if kinds == {R.INSERT} else "MIXED"
        if state == "ALREADY_APPLIED":
            return base, state
        if state not in approved:
            raise VersionError(f"{NOT_APPROVED}: {state}")
        tables = {t: (R.applied(planned[t], snapshot[t], list(k)), list(k)) for t, k in TARGET_KEYS.items()}
        try:
            return commit(spark, root, base, tables, verify=lambda back: only_skips(plan(back)), note={"state": state}), state
        except VersionError as error:
            if not str(error).startswith(BASE_MOVED):
                raise
    raise VersionError(f"{BASE_MOVED}: {tries} times")


# What the resolver asks of the entity tables: columns of theirs, by the names that it uses.
ENTITY_COLUMNS = {
    "team": {"target_id": "team_id", "source_id": "oracle_team_id", "canonical_name": "canonical_name", "display_name": "display_name"},
    "player": {"target_id": "player_id", "source_id": "oracle_player_id", "canonical_name": "canonical_name", "display_name": "display_name"},
}


def entity_references(spark: SparkSession, root: str, version: int | None, champions: DataFrame) -> dict[str, DataFrame]:
    """Teams and players of one version as the resolver's references, and the champions, all ordered by key; without champions nothing can be resolved."""
    if champions.isEmpty():
        raise VersionError("E_CHAMPIONS_EMPTY")
    found = read_version(spark, root, version, tuple(ENTITY_COLUMNS))
    return {t: found[t].select(*(F.col(c).alias(n) for n, c in columns.items())) for t, columns in ENTITY_COLUMNS.items()} | {"champion": champions.orderBy("champion_id")}
