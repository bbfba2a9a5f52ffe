"""The stored tables as match history: integrity codes, matches with rosters and slots, coverage of a team's history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.operators.dataset import first_reason
from draftlake.operators.history import last_n_before
from draftlake.schemas import TARGET_KEYS

# What is wrong with a stored snapshot.
DUPLICATE_ID, PARENT, GAME_PARENT, PATCH, SIDES, WINNER, TIME_PAIR, TIME_ORDER = (
    "E_DB_DUPLICATE_ID", "E_DB_PARENT", "E_DB_GAME_PARENT", "E_DB_PATCH_INVALID", "E_DB_GAME_SIDES", "E_DB_WINNER", "E_DB_TIME_PAIR", "E_DB_TIME_ORDER",
)
PARENTS = (
    ("tournament_stage", "tournament_id", "tournament"), ("series", "stage_id", "tournament_stage"), ("game", "series_id", "series"), ("game", "stage_id", "tournament_stage"),
    ("game", "patch_id", "game_patch"), ("game_team", "game_id", "game"), ("game_team", "team_id", "team"), ("game_player", "game_id", "game"), ("game_player", "player_id", "player"),
)


def _issue(rows: DataFrame, table: str, key: str | Column, code: str) -> DataFrame:
    return rows.select(F.lit(table).alias("table_name"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("row_key"), F.lit(code).alias("code"))


def game_issues(games: DataFrame, teams: DataFrame) -> DataFrame:
    """(game_id, code) of games whose parents, sides, winner or times are wrong; the first code counts."""
    own = teams.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("side")).alias("sides"), F.collect_set("team_id").alias("teams"))
    rows = games.join(own, "game_id", "left")
    code = first_reason(
        (F.col("series_id").isNull() == F.col("stage_id").isNull(), GAME_PARENT),
        (~F.coalesce((F.col("n") == 2) & (F.col("sides") == F.array(F.lit("BLUE"), F.lit("RED"))) & (F.size("teams") == 2), F.lit(False)), SIDES),
        (~F.coalesce(F.array_contains("teams", F.col("winner_team_id")), F.lit(False)), WINNER),
        (F.col("started_at").isNull() != F.col("ended_at").isNull(), TIME_PAIR),
        (F.col("started_at") >= F.col("ended_at"), TIME_ORDER),
    )
    return rows.select("game_id", code.alias("code")).where("code IS NOT NULL")


def snapshot_issues(t: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_key, code) of the nine tables: repeated keys, missing parents, bad patches, games; must be empty."""
    out = []
    for table, keys in TARGET_KEYS.items():
        repeated = t[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out.append(_issue(repeated, table, F.concat_ws("|", *keys), DUPLICATE_ID))
    for child, key, parent in PARENTS:
        target = TARGET_KEYS[parent][0]
        known = t[parent].select(F.col(target).alias(key)).distinct()
        out.append(_issue(t[child].where(F.col(key).isNotNull()).join(known, key, "left_anti"), child, F.concat_ws("|", *TARGET_KEYS[child]), PARENT))
    name = F.col("patch_name")
    out.append(_issue(t["game_patch"].where(name.isNull() | (name == "") | (F.trim(name) != name) | (F.length(name) > 20)), "game_patch", "patch_id", PATCH))
    found = game_issues(t["game"], t["game_team"])
    out.append(found.select(F.lit("game").alias("table_name"), F.col("game_id").alias("row_key"), "code"))
    return reduce(DataFrame.unionByName, out)


def matches(t: dict[str, DataFrame]) -> DataFrame:
    """History rows (``schemas.MATCH`` with slots and patch) of the stored games; joined by game, grouped once."""
    sides = t["game_team"].groupBy("game_id").agg(*(F.max(F.when(F.col("side") == s, F.col("team_id"))).alias(f"{s.lower()}_team_id") for s in ("BLUE", "RED")))
    players = t["game_player"].join(t["game_team"].select("game_id", "side", "team_id"), ["game_id", "side"], "left")
    slot = F.struct("team_id", "side", "role", "player_id", "champion_id")
    roster = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("role", "player_id"))))
    lineups = players.groupBy("game_id").agg(roster("BLUE").alias("blue_roster"), roster("RED").alias("red_roster"), F.sort_array(F.collect_list(slot)).alias("slots"))
    games = t["game"].join(t["game_patch"].select("patch_id", F.col("patch_name").alias("patch")), "patch_id", "left")
    return games.select("game_id", "winner_team_id", "started_at", "ended_at", "patch").join(sides, "game_id", "left").join(lineups, "game_id", "left")


def team_coverage(targets: DataFrame, team_games: DataFrame) -> DataFrame:
    """``targets`` (team, cutoff) with game_count, latest_ended_at, age_days of the team's games before the cutoff."""
    states = {"game_count": F.count(F.lit(1)), "latest_ended_at": F.max("ended_at")}
    seen = last_n_before(team_games, targets, ["team"], None, states)
    age = F.floor((F.unix_micros(F.col("cutoff").cast("timestamp")) - F.unix_micros(F.col("latest_ended_at").cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
    return seen.withColumns({"game_count": F.coalesce("game_count", F.lit(0)).cast("long"), "age_days": age})


def roster_suggestion(targets: DataFrame, team_games: DataFrame) -> DataFrame:
    """``targets`` (team, cutoff) with the roster of the team's latest game before the cutoff (null: none)."""
    return last_n_before(team_games, targets, ["team"], 1, {"suggested": F.last("roster"), "suggested_from": F.last("game_id")})


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, n): rows that only one of two tables has, repeats counted; empty if they are the same."""
    columns = left.columns
    only = lambda a, b, side: a.select(*columns).exceptAll(b.select(*columns)).agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return only(left, right, "left").union(only(right, left, "right")).where("n > 0")


def unused(records: DataFrame, targets: DataFrame, key: str = "game_id") -> DataFrame:
    """Records whose target is not there."""
    return records.join(targets.select(key), key, "left_anti")


def time_coverage(games: DataFrame, times: DataFrame, group: str, prefix: str) -> DataFrame:
    """A row for each group: games, those whose id has the platform's prefix, those with valid times, and their share in per cent."""
    own = games.withColumn("on_platform", F.col("game_id").startswith(prefix)).join(times.where("reason IS NULL").select("game_id", F.lit(True).alias("timed")), "game_id", "left")
    timed = F.count_if(F.col("on_platform") & F.col("timed"))
    return own.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if("on_platform").alias("on_platform"), timed.alias("timed"), F.bround(timed * 100.0 / F.count(F.lit(1)), 2).alias("percent"))
