"""Reports: artifacts of an audit and a transformation, their guards, and the small readers around them."""

import json

import pytest
from conftest import match_rows
from pyspark.sql import functions as F
from test_conform import run

from draftlake.operators import invariants as V
from draftlake.session import settled
from draftlake.sources import reports as R


def text(path):
    return "\n".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_feed_paths(spark, tmp_path):
    good, empty, other = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.txt"
    good.write_text("x\n1\n")
    empty.write_text("")
    other.write_text("x")
    assert R.resolve_feed(spark, f"file://{good}").endswith("/a.csv")
    for path, why in ((empty, "empty"), (other, "named"), (tmp_path, "no file"), (tmp_path / "z.csv", "exist")):
        with pytest.raises(R.ReportError, match=f"{R.SOURCE_INVALID}.*{why}"):
            R.resolve_feed(spark, f"file://{path}")


def test_fields_go_at_any_depth(spark):
    row = [(1, {"n": 2, "game_ids": ["a"], "deep": [{"game_ids": ["b"], "m": {"k": {"game_ids": ["c"], "v": 3}}}]}, ["x"], None)]
    kind = "id int, s struct<n: int, game_ids: array<string>, deep: array<struct<game_ids: array<string>, m: map<string, struct<game_ids: array<string>, v: int>>>>>, game_ids array<string>, t struct<game_ids: int, w: int>"
    out = R.without_fields(spark.createDataFrame(row, kind), "game_ids")
    assert "game_ids" not in out.schema.simpleString()
    got = out.first().asDict(recursive=True)
    assert got == {"id": 1, "s": {"n": 2, "deep": [{"m": {"k": {"v": 3}}}]}, "t": None}


def test_linked_options_and_schema(spark):
    teams = spark.createDataFrame([("a", "Z"), ("b", "Y"), ("c", "X")], "team_id string, display_name string")
    links = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "team_id string")
    assert [(r.team_id, r.n_links) for r in R.linked_options(teams, links, "team_id").collect()] == [("b", 1), ("a", 2)]
    assert R.schema_snapshot(teams) == {"total_rows": 3, "total_columns": 2, "columns": [{"name": "team_id", "type": "string"}, {"name": "display_name", "type": "string"}]}


def test_audit_report(spark, feed, tmp_path):
    rows = [dict(r, champion="") if r["participantid"] == "1" else r for g in ("G2", "G1") for r in match_rows(g)]
    folder = f"file://{tmp_path}/audit"
    paths = R.write_audit(feed(rows), folder, "file:///data/feed.csv")
    summary = json.loads(text(tmp_path / "audit/audit_summary"))
    assert summary["schema"]["total_rows"] == 24 and summary["skipped_rules"] == {}
    assert [(i["issue_code"], i["n_issues"], i["n_games"], i["sample"]) for i in summary["issues"]] == [("MISSING_PLAYER_CHAMPION", 2, 2, ["G1", "G2"])]
    assert text(tmp_path / "audit/audit_issues").splitlines()[1].split(",")[1:3] == ["MISSING_PLAYER_CHAMPION", "G1"]
    assert "MISSING_PLAYER_CHAMPION" in text(tmp_path / "audit/audit_report") and len(paths) == 3
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        R.write_audit(feed(rows), folder, "file:///data/feed.csv")
    with pytest.raises(R.ReportError, match=R.SAME_PATH):
        R.write_audit(feed(rows), folder, f"{folder}/audit_issues/")


def test_transformation_report(spark, feed, tmp_path):
    bad = [dict(r, champion="Nobody") if r["participantid"] == "1" else r for r in match_rows("G2")]
    _, out = run(spark, feed(match_rows("G1") + bad))
    out = {k: settled(v, k) for k, v in out.items()}
    tables, metrics = V.written({t: out[t] for t in (*V.C.TARGET_KEYS, "dispositions")}, lambda n, rows: settled(rows, n))
    facts = settled(V.reconcile(tables, metrics, 2), "facts")
    folder = f"file://{tmp_path}/report"
    paths = R.write_transformation(out, facts, folder, "file:///data/feed.csv")
    assert len(paths) == 6 and {p.name for p in (tmp_path / "report").iterdir()} == set(paths)
    assert text(tmp_path / "report/unmapped_champions").splitlines()[-1].startswith("Nobody,")
    assert [line.split(",")[0] for line in text(tmp_path / "report/rejected_games").splitlines() if line][-1] == "G2"
    summary = json.loads(text(tmp_path / "report/etl_summary"))
    assert all(f["holds"] for f in summary["reconciliation"]) and {i["entity"] for i in summary["issues"]} >= {"game", "champion"}
    with pytest.raises(R.ReportError, match=R.UNSAFE):
        R.write_transformation(out, facts.withColumn("holds", F.lit(False)), f"{folder}2", "file:///data/feed.csv")
    assert not (tmp_path / "report2").exists()
