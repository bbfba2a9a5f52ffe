"""Invariants of a transformation over written tables: all hold on a sound one, each broken one is found."""

import pytest
from conftest import match_rows
from pyspark.sql import functions as F
from test_conform import refs, run, series

from draftlake import schemas as C
from draftlake.operators import identity as I
from draftlake.operators import invariants as V
from draftlake.operators.quality import row_kind
from draftlake.session import settled

TABLES = (*C.TARGET_KEYS, "dispositions")


@pytest.fixture(scope="module")
def sound(spark):
    rows = series(1) + series(2) + [dict(r, champion="Nobody") if r["participantid"] == "1" else r for r in match_rows("G9")]
    columns = list(rows[0])
    frame = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))
    core, out = run(spark, frame)
    return frame, {t: settled(out[t], t) for t in TABLES}


def failed(out, source_games=3, planned=None):
    tables, metrics = V.written(out, lambda name, rows: settled(rows, name))
    return {r.name for r in V.reconcile(tables, metrics, source_games, planned).where("NOT holds").collect()}, metrics


def test_a_sound_transformation_holds(sound):
    _, out = sound
    names, metrics = failed(out, planned={"game": {"INSERT": 2}})
    assert names == set()
    assert (metrics["game"]["n"], metrics["game_team"]["n"], metrics["game_player"]["n"], metrics["dispositions"]["rejected"]) == (2, 4, 20, 1)
    assert V.transform_status(metrics, 3) == "PARTIAL" and V.transform_status(metrics, 2) == "READY"
    assert failed(out, 4, {"game": {"INSERT": 1}})[0] == {"game_disposition_count", "game_action_count"}


def test_each_broken_invariant_is_found(sound):
    _, out = sound
    when = lambda c, bad, value: F.when(bad, value).otherwise(F.col(c))
    first = F.col("game_id") == "S1_game_1"
    blue, top = first & (F.col("side") == "BLUE"), F.col("role") == F.lit(next(iter(C.TARGET_ROLES.values())))
    set_ = lambda t, c, bad, value: {t: out[t].withColumn(c, when(c, bad, value))}
    broken = [
        (set_("game", "stage_id", first, F.lit("s")), {"game_parent_xor", "game_stage_parent"}), (set_("game", "ended_at", first, F.current_timestamp()), {"game_source_time_policy"}),
        (set_("game", "winner_team_id", first, F.lit("x")), {"winner_team_membership"}), (set_("game", "patch_id", first, F.lit("x")), {"game_patch_parent"}),
        (set_("game_team", "side", blue, F.lit("RED")), {"duplicate_game_side", "game_side_set"}), (set_("game_player", "champion_id", blue & top, F.lit(None)), {"game_player_champion_required"}),
        (set_("game_player", "role", blue & top, F.lit("x")), {"game_side_role_set"}), (set_("tournament_stage", "name", F.lit(True), F.lit("UNSPECIFIED")), {"unspecified_stage"}),
        ({"game_player": out["game_player"].where(~(blue & top))}, {"game_player_cardinality", "game_side_role_set", "game_unique_players"}),
        ({"dispositions": out["dispositions"].withColumn("reason", F.lit("x"))}, {"game_disposition_count", "accepted_rejected_overlap"}),
        ({"team": out["team"].limit(0)}, {"game_team_team_parent"}), ({"series": out["series"].limit(0)}, {"game_series_parent"}),
    ]
    for change, names in broken[::2] + broken[1::2]:
        assert failed(out | change)[0] == names, change


def test_identity_totals_and_entity_counts(spark, sound):
    frame, _ = sound
    teams = I.resolve_teams(frame)
    players = I.resolve_players(frame.where("position <> 'team'"), teams)
    source = frame.withColumn("kind", row_kind())
    assert V.identity_totals(teams, players, source).where("NOT holds").count() == 0
    assert {r.name for r in V.identity_totals(teams, players.limit(5), source).where("NOT holds").collect()} == {"player_rows"}
    known = refs(spark)
    statuses = I.target_status(teams.select("team_id").withColumnRenamed("team_id", "id"), "id", known.select(F.col("source_id").alias("source"), F.col("target_id").alias("target")), "source", "target")
    assert {r.status: r.n for r in V.entity_counts(statuses, "id", "target_status").collect()} == {"NEW_TARGET_REQUIRED": 2}
    torn = spark.createDataFrame([("a", "EXISTING"), ("a", "NEW")], "id string, status string")
    with pytest.raises(Exception, match="E_TARGET_STATUS_INCONSISTENT"):
        V.entity_counts(torn, "id", "status").collect()
