from conftest import match_rows
from pyspark.sql import functions as F

from draftlake import schemas as C
from draftlake.operators import conform as T
from draftlake.operators import identity as I
from draftlake.operators import reconcile as R
from draftlake.sources.readers import display_catalog, read_snapshot
from draftlake.sources.writers import current_version, publish


def champions(spark, n=10):
    return spark.createDataFrame([(str(i), f"Champ{i}", f"Champ {i}") for i in range(1, n + 1)], "champion_id string, canonical_name string, display_name string")


def refs(spark):
    return spark.createDataFrame([], "target_id string, source_id string, canonical_name string, display_name string")


def run(spark, frame):
    core = T.typed(frame)
    teams = I.resolve_teams(frame)
    players = I.resolve_players(frame.where("position <> 'team'"), teams)
    mapped = I.map_champions(frame.where("position <> 'team'"), champions(spark))
    return core, T.targets(core, teams, players, mapped, refs(spark), refs(spark))


def series(game, url="https://x.example/m?bo=3", **over):
    return match_rows(f"S1_game_{game}", number=game, url=f"{url}&g={game}", date=f"2025-03-01 1{game}:00:00", **over)


def test_a_series_of_two_matches(spark, feed):
    core, out = run(spark, feed(series(1) + series(2)))
    counts = {t: out[t].count() for t in C.TARGET_KEYS}
    assert counts == {"game_patch": 1, "tournament": 1, "tournament_stage": 1, "series": 1, "team": 2, "player": 10, "game": 2, "game_team": 4, "game_player": 20}
    assert T.reconciliation(core, out).where("NOT holds").count() == 0
    assert T.run_state(out["dispositions"], out["issues"]).first().state == "READY"


def test_rejections_and_fallback_to_the_stage(spark, feed):
    bad = [dict(r) for r in match_rows("G2")]
    bad[0]["champion"] = "Nobody"
    torn = [dict(r) for r in match_rows("G3")]
    torn[4]["patch"] = "15.02"
    tied = [dict(r) for r in match_rows("G4")]
    tied[5]["result"] = "0"
    core, out = run(spark, feed(match_rows("G1") + bad + torn + tied))
    got = {r.gameid: (r.reason, r.detail) for r in out["dispositions"].collect()}
    assert got == {
        "G1": (None, None), "G2": ("GAME_LINEUP_INCOMPLETE", "CHAMPION_UNMAPPED,DUPLICATE_GAME_PARTICIPANT_ID,GAME_REQUIRES_TEN_RESOLVED_PLAYERS,GAME_REQUIRES_TEN_UNIQUE_PLAYERS,TEAM_ROLE_SET_INCOMPLETE"), "G3": ("GAME_METADATA_INVALID", "CONFLICTING_PATCH"), "G4": ("GAME_DEPENDENCY_INVALID", "GAME_REQUIRES_ONE_WINNER"),
    }
    game = out["game"].first()
    assert game.game_id == "G1" and game.series_id is None and game.stage_id.startswith("stage_")
    assert T.reconciliation(core, out).where("NOT holds").count() == 0
    assert T.run_state(out["dispositions"], out["issues"]).first().state == "PARTIAL"


def test_series_codes(spark, feed):
    _, out = run(spark, feed(series(1) + series(3)))
    assert {tuple(r.codes) for r in out["series_codes"].collect()} == {("NON_CONTIGUOUS_SERIES_GAME_NUMBER",)}


def test_publish_then_replay_only_skips(spark, feed, tmp_path):
    _, out = run(spark, feed(series(1) + series(2)))
    empty = {t: out[t].limit(0) for t in C.TARGET_KEYS}
    planned = T.plan(out, empty)
    assert {r.action for p in planned.values() for r in p.select("action").distinct().collect()} == {"INSERT"}
    root = f"file://{tmp_path}/store"
    publish(spark, root, "v1", planned, empty)
    assert current_version(spark, root) == "v1"
    stored = read_snapshot(spark, f"{root}/v1")
    again = R.state(T.plan(out, stored))
    assert {r.state for r in again.collect()} == {"ALREADY_APPLIED"}
    assert display_catalog(stored).where("tournament = 'LCK'").count() == 2


def test_actions(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "id int, name string, logo_file string")
    new = spark.createDataFrame([(1, "a", None), (2, "B", "y"), (3, "c", "z"), (4, "d", None)], "id int, name string, logo_file string")
    planned = R.actions(new, old, ["id"])
    assert {r.id: r.action for r in planned.collect()} == {1: "SKIP", 2: "UPDATE", 3: "UPDATE", 4: "INSERT"}
    after = {tuple(r) for r in R.applied(planned, old, ["id"]).collect()}
    assert after == {(1, "a", "x"), (2, "B", "y"), (3, "c", "z"), (4, "d", None)}


def test_team_identity(spark, feed):
    lost = [dict(r) for r in match_rows("G2")]
    for r in lost:
        if r["side"] == "Blue":
            r["teamid"] = ""
    padded = [dict(r) for r in match_rows("G3", blue="TX", red="TY")]
    padded[0]["teamid"] = " TX"
    two = [dict(r) for r in match_rows("G4", blue="TU", red="TV")]
    two[1]["teamid"] = "other"
    got = {(r.gameid, r.side): (r.status, r.reason, r.team_id) for r in I.resolve_teams(feed(match_rows("G1") + lost + padded + two)).collect()}
    assert got["G1", "Blue"] == ("SOURCE_ID", "SOURCE_ID_PRESENT", "TB")
    assert got["G2", "Blue"] == ("RECOVERED_UNIQUE", "UNIQUE_FULL_CONTEXT", "TB")
    assert got["G3", "Blue"] == ("UNRESOLVED", "INVALID_SOURCE_ID", None)
    assert got["G4", "Blue"] == ("UNRESOLVED", "SOURCE_ID_CONFLICT", None)


def test_target_status(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string")
    known = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("b", "t3")], "source string, target string")
    got = {r.id: (r.target_status, r.target_id) for r in I.target_status(rows, "id", known, "source", "target").collect()}
    assert got == {"a": ("EXISTING", "t1"), "b": ("TARGET_CONFLICT", None), "c": ("NEW_TARGET_REQUIRED", None), None: ("NOT_APPLICABLE", None)}


def test_typed(spark, feed):
    row = T.typed(feed([match_rows()[0] | {"year": "2025.0", "game": "1.5", "split": " "}])).select("year", "game", "split", F.year("date").alias("y")).first()
    assert tuple(row) == (2025, None, None, 2025)


def test_context_codes_of_a_side(spark, feed):
    rows = [dict(r) for r in match_rows("G1")]
    for r in rows:
        r["teamid"] = "" if r["side"] == "Blue" else r["teamid"]
    rows[0]["league"], rows[1]["year"], rows[2]["date"], rows[3]["split"] = "LEC", "", "someday", ""
    two = [dict(r, teamid="", year="2025.5", playoffs="2", date="never", split="") for r in match_rows("G2")]
    got = {(r.gameid, r.side): r.reason for r in I.resolve_teams(feed(rows + two)).collect()}
    assert got["G1", "Blue"] == "CONFLICTING_DATE_CONTEXT,CONFLICTING_LEAGUE_CONTEXT,MIXED_MISSING_SPLIT_CONTEXT,MIXED_MISSING_YEAR_CONTEXT"
    assert got["G2", "Blue"] == got["G2", "Red"] == "INVALID_DATE_CONTEXT,INVALID_PLAYOFFS_CONTEXT,INVALID_YEAR_CONTEXT"


def test_resolved_teams_of_a_table(spark, tmp_path):
    from datetime import datetime

    import duckdb

    from draftlake.plans.catalogue import QUERIES, SQL

    keys = [26, 39, 52, 65, 91, 105, 130, 133, 164, 212, 259, *range(300, 340)]
    rows = [(k, 7 + 40 * (k % 3) if k % 2 else k % 40, datetime(1995, 1, 1 + k % 3, 10)) for k in keys] + [(131, 26 + 40, datetime(1995, 1, 3)), (401, 23, datetime(1995, 1, 3))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT o_orderkey, o_custkey, o_orderdate::TIMESTAMP AS o_orderdate FROM '{tmp_path}/orders.parquet/*.parquet'")
    out = QUERIES["i01_resolve_teams"](spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(con.sql(f"SELECT {', '.join(out.columns)} FROM ({SQL['i01_resolve_teams']})").fetchall(), key=str) and len(got) == 2 * len(rows)
    assert {r[2] for r in got} == {"SOURCE_ID", "RECOVERED_UNIQUE", "UNRESOLVED"}
    assert {"UNIQUE_FULL_CONTEXT", "NO_SOURCE_ID_CANDIDATE", "SOURCE_ID_PRESENT"} <= {r[3] for r in got}
    assert {r[6] for r in got} == {"EXISTING", "NEW_TARGET_REQUIRED", "TARGET_CONFLICT", "NOT_APPLICABLE"}


def test_candidates_are_the_own_ids_or_those_of_the_context(spark, feed):
    over = lambda g, **new: [dict(r, **(new if r["side"] == "Blue" else {})) for r in match_rows(g, red=f"R{g}")]
    two = over("G3")
    two[1]["teamid"] = "other"
    padded = over("G4", teamid="")
    padded[0]["teamid"] = " TB"
    rows = over("G1") + over("G2", teamid="") + two + padded
    found = {r.gameid: (r.reason, r.candidates) for r in I.resolve_teams(feed(rows)).where("side = 'Blue'").collect()}
    assert found == {"G1": ("SOURCE_ID_PRESENT", ["TB"]), "G2": ("UNIQUE_FULL_CONTEXT", ["TB"]), "G3": ("SOURCE_ID_CONFLICT", ["TB", "other"]), "G4": ("INVALID_SOURCE_ID", [])}
    found = {r.gameid: (r.reason, r.candidates) for r in I.resolve_teams(feed(rows + over("G5", teamid="TC"))).where("side = 'Blue'").collect()}
    assert found["G1"] == found["G5"] == ("SOURCE_ID_CONFLICT", ["TB", "TC"]) and found["G2"] == ("AMBIGUOUS_SOURCE_ID_CANDIDATES", ["TB", "TC"])
