"""Invariants of a transformation, checked on what was written: counts are taken as the tables are written, and only relations between tables read them again.

Each table is written once with its metrics observed on the way (rows, and how many break each rule that a row can break by itself). Keys, parents, sides and
roles need rows that stand together: those are grouped counts and anti-joins of the written tables' key columns. All come out as rows (name, found, expected, holds).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from draftlake import schemas as C

READY, PARTIAL, BLOCKED = "READY", "PARTIAL", "BLOCKED"


def _none(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns))


# What a row of a table can break by itself.
ROW_RULES: dict[str, dict[str, Callable[[], Column]]] = {
    "game": {
        "game_parent_xor": lambda: F.col("series_id").isNull() == F.col("stage_id").isNull(),
        "game_source_time_policy": lambda: _none("scheduled_at", "started_at", "ended_at"),
        "game_winner_required": lambda: F.col("winner_team_id").isNull(),
    },
    "game_team": {"game_team_side": lambda: ~F.coalesce(F.col("side").isin("BLUE", "RED"), F.lit(False)), "game_team_required": lambda: F.col("team_id").isNull()},
    "game_player": {"game_player_champion_required": lambda: F.col("champion_id").isNull(), "game_player_required": lambda: F.col("player_id").isNull()},
    "tournament_stage": {"unspecified_stage": lambda: F.coalesce(F.col("name") == "UNSPECIFIED", F.lit(False))},
    "dispositions": {"rejected": lambda: F.col("reason").isNotNull()},
}
# Keys that no two rows of a table share.
UNIQUE = {
    "duplicate_game": ("game", ("game_id",)), "duplicate_game_side": ("game_team", ("game_id", "side")), "duplicate_game_team": ("game_team", ("game_id", "team_id")),
    "duplicate_game_team_role": ("game_player", ("game_id", "side", "role")), "duplicate_primary_rejection": ("dispositions", ("gameid",)), "duplicate_team": ("team", ("team_id",)),
    "duplicate_player": ("player", ("player_id",)), "duplicate_series": ("series", ("series_id",)), "duplicate_stage": ("tournament_stage", ("stage_id",)),
}
# Rows whose parent must be there: child, its column, parent, its key.
PARENTS = {
    "game_patch_parent": ("game", "patch_id", "game_patch", "patch_id"), "game_series_parent": ("game", "series_id", "series", "series_id"), "game_stage_parent": ("game", "stage_id", "tournament_stage", "stage_id"),
    "series_stage_parent": ("series", "stage_id", "tournament_stage", "stage_id"), "stage_tournament_parent": ("tournament_stage", "tournament_id", "tournament", "tournament_id"),
    "game_team_game_parent": ("game_team", "game_id", "game", "game_id"), "game_team_team_parent": ("game_team", "team_id", "team", "team_id"),
    "game_player_game_parent": ("game_player", "game_id", "game", "game_id"), "game_player_player_parent": ("game_player", "player_id", "player", "player_id"),
}


def written(out: dict[str, DataFrame], write: Callable[[str, DataFrame], DataFrame]) -> tuple[dict[str, DataFrame], dict[str, dict[str, int]]]:
    """The tables as ``write`` reads them back, and the metrics of each, observed as it was written."""
    tables, metrics = {}, {}
    for name, rows in out.items():
        seen = Observation()
        rules = [F.count_if(rule()).alias(code) for code, rule in ROW_RULES.get(name, {}).items()]
        tables[name] = write(name, rows.observe(seen, F.count(F.lit(1)).alias("n"), *rules))
        metrics[name] = dict(seen.get)
    return tables, metrics


def reconcile(tables: dict[str, DataFrame], metrics: dict[str, dict[str, int]], source_games: int, planned: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(name, found, expected, holds) of all invariants of the nine tables and ``dispositions`` (gameid, reason).

    ``source_games``: distinct matches of the source. ``planned``: actions by table (reconcile.actions), whose sum is the table's rows.
    """
    spark = tables["game"].sparkSession
    games, rejected = metrics["game"]["n"], metrics["dispositions"]["rejected"]
    facts = [(code, metrics[t][code], 0) for t, rules in ROW_RULES.items() if t != "dispositions" for code in rules]
    facts += [("game_team_cardinality", metrics["game_team"]["n"], 2 * games), ("game_player_cardinality", metrics["game_player"]["n"], 10 * games), ("game_disposition_count", games + rejected, source_games)]
    facts += [(f"{t}_action_count", sum(a.values()), metrics[t]["n"]) for t, a in (planned or {}).items()]
    known = spark.createDataFrame(facts, "name string, found long, expected long")

    bad = lambda name, rows: rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("found"), F.lit(0).cast("long").alias("expected"))
    checks = [bad(name, tables[t].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")) for name, (t, keys) in UNIQUE.items()]
    for name, (child, column, parent, key) in PARENTS.items():
        there = tables[parent].select(F.col(key).alias(column))
        checks.append(bad(name, tables[child].where(F.col(column).isNotNull()).select(column).join(there, column, "left_anti")))
    members = tables["game_team"].select("game_id", F.col("team_id").alias("winner_team_id"))
    checks.append(bad("winner_team_membership", tables["game"].select("game_id", "winner_team_id").join(members, ["game_id", "winner_team_id"], "left_anti")))
    sides = tables["game_team"].groupBy("game_id").agg(F.count_if(F.col("side") == "BLUE").alias("b"), F.count_if(F.col("side") == "RED").alias("r"), F.count(F.lit(1)).alias("n"))
    checks.append(bad("game_side_set", sides.where("NOT (b = 1 AND r = 1 AND n = 2)")))
    roles = tables["game_player"].groupBy("game_id", "side").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("role") == r).alias(f"r_{r}") for r in C.TARGET_ROLES.values()))
    whole = reduce(lambda a, b: a & b, (F.col(f"r_{r}") == 1 for r in C.TARGET_ROLES.values()))
    checks.append(bad("game_side_role_set", roles.where(~((F.col("n") == 5) & whole))))
    own = tables["game_player"].groupBy("game_id").agg(F.countDistinct("player_id").alias("n"))
    checks.append(bad("game_unique_players", own.where("n <> 10")))
    refused = tables["dispositions"].where("reason IS NOT NULL").select(F.col("gameid").alias("game_id"))
    checks.append(bad("accepted_rejected_overlap", tables["game"].select("game_id").join(refused, "game_id", "left_semi")))
    return reduce(DataFrame.unionByName, [known, *checks]).withColumn("holds", F.col("found") == F.col("expected"))


def transform_status(metrics: dict[str, dict[str, int]], source_games: int) -> str:
    """READY if every match of the source became a game, BLOCKED if none did, else PARTIAL."""
    games = metrics["game"]["n"]
    return BLOCKED if not games else READY if games == source_games else PARTIAL


def entity_counts(rows: DataFrame, source_id: str, status: str) -> DataFrame:
    """(status, n): distinct resolved source ids by their mapping status; an id with two statuses fails."""
    own = rows.where(F.col(source_id).isNotNull()).groupBy(source_id).agg(F.min(status).alias("a"), F.max(status).alias("b"), F.count(status).alias("n"), F.count(F.lit(1)).alias("all"))
    torn = (F.col("a") != F.col("b")) | (F.col("n") != F.col("all"))
    checked = F.when(F.coalesce(torn, F.lit(True)), F.raise_error(F.concat(F.lit("E_TARGET_STATUS_INCONSISTENT: "), F.col(source_id).cast("string"))).cast("string")).otherwise(F.col("a"))
    return own.select(checked.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def identity_totals(teams: DataFrame, players: DataFrame, source: DataFrame) -> DataFrame:
    """(name, found, expected, holds): the parts of each total of the identity summary add up to it.

    ``teams`` (gameid, side, status, team_id) and ``players`` (gameid, participantid, status, player_id) are the resolver's; ``source`` is the feed with ``kind``.
    """
    count = lambda df, name, *conditions: df.agg(F.lit(name).alias("name"), *(c.alias(a) for c, a in zip(conditions, ("found", "expected"), strict=True)))
    resolved, unresolved = F.count_if(F.col("status") != "UNRESOLVED"), F.count_if(F.col("status") == "UNRESOLVED")
    rows = [count(df, f"{n}_status_total", resolved + unresolved, F.count(F.lit(1))) for n, df in (("team", teams), ("player", players))]
    rows += [count(df, f"{n}_resolved_have_ids", F.count_if((F.col("status") != "UNRESOLVED") == F.col(f"{n}_id").isNotNull()), F.count(F.lit(1))) for n, df in (("team", teams), ("player", players))]
    sides = source.where("kind = 'team'").groupBy("gameid", "side").agg(F.count(F.lit(1)).alias("n"))
    rows.append(count(sides, "team_groups", F.count(F.lit(1)), F.lit(0).cast("long")).drop("expected").join(teams.agg(F.lit("team_groups").alias("name"), F.count(F.lit(1)).alias("expected")), "name"))
    rows.append(count(source.where("kind = 'player'"), "player_rows", F.count(F.lit(1)), F.lit(0).cast("long")).drop("expected").join(players.agg(F.lit("player_rows").alias("name"), F.count(F.lit(1)).alias("expected")), "name"))
    games = source.select("gameid").distinct().agg(F.lit("distinct_games").alias("name"), F.count(F.lit(1)).alias("found"))
    rows.append(games.join(teams.agg(F.lit("distinct_games").alias("name"), F.countDistinct("gameid").alias("expected")), "name"))
    return reduce(DataFrame.unionByName, rows).withColumn("holds", F.col("found") == F.col("expected"))
