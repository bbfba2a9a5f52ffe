"""Reports of an audit and of a transformation: JSON summaries, CSV tables in a stable order, Markdown. Never over what exists, never over the source."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.operators import quality as Q
from draftlake.sources.writers import markdown

UNSAFE, SAME_PATH, SOURCE_INVALID = "E_REPORT_UNSAFE", "E_REPORT_PATH", "E_SOURCE_PATH_INVALID"
IDENTITY_ENTITIES = ("team", "player")
ISSUE_COLUMNS, REJECTED_COLUMNS, UNMAPPED_COLUMNS = ("entity", "source_key", "reason", "detail"), ("gameid", "reason", "detail"), ("champion", "reason", "n_rows")


class ReportError(ValueError):
    """A refused report; the message begins with its code."""


def resolve_feed(spark: SparkSession, path: str) -> str:
    """The full path of a CSV feed that exists, is a file named .csv and is not empty."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    why = None
    if not fs.exists(own):
        why = "does not exist"
    elif not fs.getFileStatus(own).isFile():
        why = "is no file"
    elif not own.getName().lower().endswith(".csv"):
        why = "is not named .csv"
    elif fs.getFileStatus(own).getLen() == 0:
        why = "is empty"
    if why:
        raise ReportError(f"{SOURCE_INVALID}: {path} {why}")
    return fs.makeQualified(own).toString()


def schema_snapshot(rows: DataFrame) -> dict:
    """{total_rows, total_columns, columns: [{name, type}]} of a table."""
    return {"total_rows": rows.count(), "total_columns": len(rows.columns), "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in rows.schema.fields]}


def _without(value: Column, kind: T.DataType, names: set[str]) -> Column:
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in names]
        whole = F.struct(*(_without(value[f.name], f.dataType, names).alias(f.name) for f in kept))
        return F.when(value.isNotNull(), whole)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _without(x, kind.elementType, names))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _without(v, kind.valueType, names))
    return value


def without_fields(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` without the fields of these names, at any depth of structs, arrays and maps."""
    gone = set(names)
    return rows.select(*(_without(F.col(f"`{f.name}`"), f.dataType, gone).alias(f.name) for f in rows.schema.fields if f.name not in gone))


def linked_options(entities: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Entities that some link names, with ``n_links``, by name and key."""
    counts = links.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_links"))
    return entities.join(counts, key).orderBy("display_name", key)


def _distinct(paths: dict[str, str], source: str) -> None:
    if len(set(paths.values())) < len(paths) or source.rstrip("/") in {p.rstrip("/") for p in paths.values()}:
        raise ReportError(f"{SAME_PATH}: {source}")


def _text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def _table(rows: DataFrame, columns: tuple[str, ...], path: str, order: tuple[str, ...] | None = None) -> None:
    """One CSV folder, its parts in the order of the rows, nulls last; a table of any size is not brought to one task."""
    if gone := [c for c in columns if c not in rows.columns]:
        raise ReportError(f"{UNSAFE}: missing columns {gone}")
    rows.select(*columns).orderBy(*(F.asc_nulls_last(c) for c in order or columns)).write.mode("errorifexists").csv(path, header=True)


def write_audit(feed: DataFrame, folder: str, source: str) -> dict[str, str]:
    """Audit a feed and write its summary (JSON, with the first match ids of each code), its issues (CSV) and a Markdown report; the paths."""
    paths = {n: f"{folder}/{n}" for n in ("audit_summary", "audit_issues", "audit_report")}
    _distinct(paths, source)
    issues, skipped = Q.audit(feed)
    by_code = Q.samples(issues)
    rows = [r.asDict() for r in by_code.orderBy("issue_code").collect()]  # a row a code
    summary = {"source_path": source, "schema": schema_snapshot(feed), "skipped_rules": skipped, "issues": rows}
    _text(feed.sparkSession, json.dumps(summary, ensure_ascii=False, sort_keys=True), paths["audit_summary"])
    _table(issues, ("rule_ord", "issue_code", "gameid", "participantid", "issue_group", "severity"), paths["audit_issues"])
    _text(feed.sparkSession, "# Audit\n\n" + markdown(by_code.orderBy("issue_code").withColumn("sample", F.concat_ws(", ", "sample"))), paths["audit_report"])
    return paths


def write_transformation(out: dict[str, DataFrame], invariants: DataFrame, folder: str, source: str) -> dict[str, str]:
    """The six artifacts of a transformation (``conform.targets``): summary, unresolved identities, unmapped champions, rejected records and matches, report.

    Nothing is written unless all ``invariants`` (``invariants.reconcile``) hold.
    """
    names = ("etl_summary", "unresolved_identities", "unmapped_champions", "rejected_records", "rejected_games", "etl_report")
    paths = {n: f"{folder}/{n}" for n in names}
    _distinct(paths, source)
    facts = [r.asDict() for r in invariants.orderBy("name").collect()]  # a row an invariant
    if broken := [f["name"] for f in facts if not f["holds"]]:
        raise ReportError(f"{UNSAFE}: {', '.join(broken)}")
    issues, judged = out["issues"], out["dispositions"]
    by_reason = issues.groupBy("entity", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy("entity", "reason")
    spark = issues.sparkSession
    summary = {"source_path": source, "reconciliation": facts, "issues": [r.asDict() for r in by_reason.collect()]}  # a row a code
    unmapped = issues.where("entity = 'champion'").groupBy(F.col("source_key").alias("champion"), "reason").agg(F.count(F.lit(1)).alias("n_rows"))
    _text(spark, json.dumps(summary, ensure_ascii=False, sort_keys=True), paths["etl_summary"])
    _table(issues.where(F.col("entity").isin(*IDENTITY_ENTITIES)), ISSUE_COLUMNS, paths["unresolved_identities"])
    _table(unmapped, UNMAPPED_COLUMNS, paths["unmapped_champions"])
    _table(issues.where(~F.col("entity").isin("champion", *IDENTITY_ENTITIES)), ISSUE_COLUMNS, paths["rejected_records"])
    _table(judged.where("reason IS NOT NULL"), REJECTED_COLUMNS, paths["rejected_games"], ("gameid",))
    _text(spark, "# Transformation\n\n" + markdown(by_reason) + "\n\n" + markdown(invariants.orderBy("name")), paths["etl_report"])
    return paths
