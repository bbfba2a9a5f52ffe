"""PRE and POST features of a fixture worked out by hand, the dataset's exclusions, and model runs over it."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from draftlake import schemas as C
from draftlake.operators import dataset as D
from draftlake.operators import runs as R
from draftlake.operators import snapshot as N

SCHEMA = (
    "game_id string, blue_team_id string, red_team_id string, blue_roster array<struct<role: string, player_id: string>>, red_roster array<struct<role: string, player_id: string>>, winner_team_id string, "
    "ended_at timestamp, slots array<struct<team_id: string, side: string, role: string, player_id: string, champion_id: string>>, patch string, history_cutoff_at timestamp"
)
DAY = datetime(2025, 6, 21, 12)


def match(game, blue, red, winner, ended, cutoff=None, shift=0):
    roster = lambda t: [(r, f"{t.lower()}{i + 1}") for i, r in enumerate(C.ROLES)]
    slots = [(t, s, r, p, str(10 * j + i + shift)) for j, (s, t) in enumerate((("BLUE", blue), ("RED", red))) for i, (r, p) in enumerate(roster(t))]
    return (game, blue, red, roster(blue), roster(red), winner, ended, slots, "15.01", cutoff)


@pytest.fixture(scope="module")
def history(spark):
    rows = [match("h1", "A", "B", "A", DAY), match("h2", "B", "A", "B", DAY + timedelta(days=1)), match("h3", "C", "D", "C", DAY + timedelta(days=2)), match("h4", "A", "B", "A", None)]
    return spark.createDataFrame(rows, SCHEMA)


def targets(spark, n=5):
    start = datetime(2025, 7, 1)
    rows = [match(f"t{i:02}", "A", "B", "B" if i % 3 == 0 else "A", start + timedelta(days=i, hours=2), start + timedelta(days=i)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_features_by_hand(spark, history):
    pre = D.pre_features(targets(spark, 1), history).first()
    assert (pre.blue_recent_form_value, pre.blue_recent_form_sample_count, pre.blue_recent_form_win_count, list(pre.blue_recent_form_game_ids)) == (0.5, 2, 1, ["h2", "h1"])
    assert (pre.red_recent_form_value, pre.red_recent_form_sample_count) == (0.5, 2)
    assert (pre.blue_side_win_rate_value, pre.blue_side_win_rate_sample_count) == (1.0, 1) and (pre.red_side_win_rate_value, pre.red_side_win_rate_sample_count) == (0.0, 1)
    assert (pre.h2h_blue_value, pre.h2h_blue_sample_count) == (0.5, 2) and pre.blue_roster_continuity_value == pre.red_roster_continuity_value == 1.0
    post = D.post_features(targets(spark, 1), history).first()
    # a1 had champion 0 in h1 (a win of A); in h2 A was red, with champions of 10 up
    assert (post.blue_top_games_count, post.blue_top_wins_count, post.blue_top_win_rate, post.blue_top_missing) == (1, 1, 1.0, False)
    assert (post.red_top_games_count, post.red_top_wins_count, post.red_top_win_rate) == (1, 0, 0.0)


def test_own_match_and_ties_are_no_history(spark):
    at = datetime(2025, 7, 1)
    rows = [match("a", "A", "B", "A", at - timedelta(hours=1)), match("b", "A", "B", "B", at - timedelta(hours=1)), match("c", "A", "B", "A", at)]
    asked = spark.createDataFrame([match("a", "A", "B", "A", at - timedelta(hours=1), at)], SCHEMA)
    frame = spark.createDataFrame(rows, SCHEMA)
    pre, post, counts = D.pre_features(asked, frame).first(), D.post_features(asked, frame).first(), D.history_counts(asked, frame).first()
    assert list(pre.blue_recent_form_game_ids) == ["b"] and post.blue_mid_games_count == 1 and post.blue_mid_wins_count == 0
    assert (counts.input_games, counts.accepted_games, counts.excluded_games, counts.missing_end_games) == (3, 1, 2, 0)


def records(spark, ids, **over):
    rows = [(i, datetime(2025, 7, 1) + timedelta(days=n), "ref", "p1", "VERIFIED_EXTERNALLY") for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "game_id string, history_cutoff_at timestamp, evidence_ref string, policy_version string, verification string")


def test_a_contradiction_blocks_the_targets_after_it(spark, history):
    asked = targets(spark, 3).drop("history_cutoff_at")
    wrong = spark.createDataFrame([match("h1", "A", "B", "B", DAY)], SCHEMA).drop("history_cutoff_at")
    both = asked.union(wrong)
    found = {r.game_id: r.reason for r in D.paired_dataset(both, records(spark, ["t00", "t01", "t02"]), history, ["p1"])[1].collect()}
    assert found == {"t00": "E_SOURCE_CONFLICT", "t01": "E_SOURCE_CONFLICT", "t02": "E_SOURCE_CONFLICT", "h1": "E_CUTOFF_MISSING"}
    assert [(r.game_id, list(r.columns)) for r in D.source_conflicts(history, both).collect()] == [("h1", ["winner_team_id"])]
    assert {r.reason for r in D.history_issues(history.union(history.where("game_id = 'h1'"))).collect()} == {"E_HISTORY_DUPLICATE_GAME_ID"}


def test_runs_and_bundles(spark, history, tmp_path):
    pairs, left_out = D.paired_dataset(targets(spark, 24).drop("history_cutoff_at"), records(spark, [f"t{i:02}" for i in range(24)]), history.union(targets(spark, 24)), ["p1"])
    pairs = pairs.persist()
    assert left_out.count() == 0 and pairs.count() == 24 and D.table_issues(pairs).count() == 0
    split = pairs.select("game_id", "y_blue_win", F.when(F.col("game_id") < "t16", "train").when(F.col("game_id") < "t20", "validation").otherwise("test").alias("partition"), F.lit(False).alias("purged"))
    assert R.split_issues(split, pairs).count() == 0
    assert {r.problem for r in R.split_issues(split.where("game_id < 't20'"), pairs).collect()} == {"lost", "empty test"}
    part = lambda name: pairs.join(split.where(F.col("partition") == name).select("game_id"), "game_id")
    fitted, selected = R.fit_candidates(part("train"), part("validation"), phases=("PRE",), families=("baseline", "logistic"))
    assert selected in ("baseline", "logistic")
    locked = R.signature(R.model_frame(pairs, "PRE"))
    assert R.signature(R.model_frame(pairs.orderBy(F.desc("game_id")), "PRE")) == locked != R.signature(R.model_frame(pairs.limit(3), "PRE"))
    root = f"file://{tmp_path}/bundle"
    R.publish_bundle(spark, root, fitted, selected, locked)
    with pytest.raises(FileExistsError):
        R.publish_bundle(spark, root, fitted, selected, locked)
    again, chosen = R.load_bundle(spark, root, locked)
    frame = R.model_frame(part("test"), "PRE")
    same = lambda m: {r.game_id: round(r.p, 12) for r in m["logistic", "PRE"].score(frame).collect()}
    assert chosen == selected and same(again) == same(fitted)
    with pytest.raises(ValueError, match="E_MODEL_DATASET_IDENTITY"):
        R.load_bundle(spark, root, "other")
    with pytest.raises(ValueError, match="E_MODEL_DATASET_IDENTITY"):
        R.evaluate(fitted["baseline", "PRE"], frame, locked)


def test_snapshot_issues_and_matches(spark):
    t = {
        "game_patch": spark.createDataFrame([("15.01", "15.01"), ("bad", " x")], "patch_id string, patch_name string"), "tournament": spark.createDataFrame([("t",)], "tournament_id string"),
        "tournament_stage": spark.createDataFrame([("s", "t"), ("s2", "gone")], "stage_id string, tournament_id string"), "series": spark.createDataFrame([], "series_id string, stage_id string"),
        "team": spark.createDataFrame([("A",), ("B",), ("B",)], "team_id string"), "player": spark.createDataFrame([(f"{x}{i}",) for x in "ab" for i in range(5)], "player_id string"),
        "game": spark.createDataFrame([("g", None, "s", "15.01", "A", DAY, DAY + timedelta(hours=1))], "game_id string, series_id string, stage_id string, patch_id string, winner_team_id string, started_at timestamp, ended_at timestamp"),
        "game_team": spark.createDataFrame([("g", "BLUE", "A"), ("g", "RED", "B")], "game_id string, side string, team_id string"),
        "game_player": spark.createDataFrame([("g", s, r, f"{x}{i}", str(i + 5 * (x == "b"))) for s, x in (("BLUE", "a"), ("RED", "b")) for i, r in enumerate(C.ROLES)], "game_id string, side string, role string, player_id string, champion_id string"),
    }
    assert {tuple(r) for r in N.snapshot_issues(t).collect()} == {("team", "B", "E_DB_DUPLICATE_ID"), ("tournament_stage", "s2", "E_DB_PARENT"), ("game_patch", "bad", "E_DB_PATCH_INVALID")}
    row = N.matches(t).first()
    assert row.blue_team_id == "A" and len(row.slots) == 10 and {r.player_id for r in row.red_roster} == {f"b{i}" for i in range(5)}
    assert N.matches(t).select(D.lineup_reason().alias("a"), D.slots_reason().alias("b")).first() == (None, None)
