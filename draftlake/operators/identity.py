"""Entity resolution by exact evidence: ids as given, else the only id seen in the same context, else a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import scalars as S
from draftlake.operators.groups import CONFLICT, MISSING, MIXED, SINGLE, collapse_state, collapse_value
from draftlake.operators.joins import null_safe

RESOLVED = ("SOURCE_ID", "RECOVERED_UNIQUE")


def direct(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Per key: SOURCE_ID and the id if there is exactly one, SOURCE_ID_CONFLICT for several, UNRESOLVED for none."""
    found = rows.groupBy(*keys).agg(F.countDistinct(id_col).alias("n__"), F.min(id_col).alias("one__"))
    status = F.when(F.col("n__") == 1, "SOURCE_ID").when(F.col("n__") == 0, "UNRESOLVED").otherwise("SOURCE_ID_CONFLICT")
    return found.select(*keys, status.alias("status"), F.when(F.col("n__") == 1, F.col("one__")).alias("resolved"))


def recover(rows: DataFrame, context: list[str], id_col: str) -> DataFrame:
    """Rows without an id, with ``reason`` and ``recovered``: the id of the same context (null matches null) if it is the only one."""
    known = rows.where(F.col(id_col).isNotNull()).groupBy(*context).agg(F.countDistinct(id_col).alias("n__"), F.min(id_col).alias("one__"))
    out = null_safe(rows.where(F.col(id_col).isNull()), known, context)
    reason = F.when(F.col("n__").isNull(), "NO_SOURCE_ID_CANDIDATE").when(F.col("n__") == 1, "UNIQUE_FULL_CONTEXT").otherwise("AMBIGUOUS_SOURCE_ID_CANDIDATES")
    return out.withColumns({"reason": reason, "recovered": F.when(F.col("n__") == 1, F.col("one__"))}).drop("n__", "one__")


CONTEXT = ("name_key", "league_key", "year", "split_key", "playoffs", "day")
RAW = ("league", "year", "split", "playoffs", "date")
OPTIONAL = ("split",)


def team_groups(feed: DataFrame) -> DataFrame:
    """One row for each (gameid, side): ids, names and context, from player and team rows alike; keys are made of what all rows agree on."""
    named = feed.select(
        "gameid", "side", S.blank_to_null(F.col("teamid")).alias("id"), S.source_id_state(F.col("teamid")).alias("id_state"),
        S.canonical_key(F.col("teamname")).alias("name_key"), *(S.blank_to_null(F.col(c).cast("string")).alias(c) for c in RAW),
    )
    own = named.groupBy("gameid", "side").agg(
        F.sort_array(F.collect_set(F.when(F.col("id_state") == "VALID", F.col("id")))).alias("ids"), F.count_if(F.col("id_state") == "INVALID").alias("n_invalid"),
        *(collapse_state(F.col(c)).alias(f"{c}_state") for c in RAW), *(collapse_value(F.col(c)).alias(f"{c}_value") for c in RAW),
        F.when(F.count("name_key") == 0, 0).when(F.min("name_key") == F.max("name_key"), 1).otherwise(2).alias("n_names"), collapse_value(F.col("name_key")).alias("name_key"),
    )
    whole = lambda c: F.when(F.trim(c).rlike(r"^[+-]?[0-9]{1,9}\z"), F.trim(c).cast("int"))
    return own.withColumns(
        {
            "league_key": S.canonical_key(F.col("league_value")), "split_key": S.canonical_key(F.col("split_value")), "year": whole(F.col("year_value")).cast("string"),
            "playoffs": F.when(whole(F.col("playoffs_value")).isin(0, 1), whole(F.col("playoffs_value")).cast("string")), "day": F.to_date(S.timestamp(F.col("date_value"))),
        }
    )


def _context_reason() -> Column:
    """Why a side's context is no key: its name, else all codes of its fields, sorted and joined by commas."""
    codes = []
    for c in RAW:
        state, name = F.col(f"{c}_state"), c.upper()
        codes += [F.when(state == CONFLICT, f"CONFLICTING_{name}_CONTEXT"), F.when(state == MIXED, f"MIXED_MISSING_{name}_CONTEXT")]
        if c not in OPTIONAL:
            codes.append(F.when(state == MISSING, f"MISSING_{name}_CONTEXT"))
    codes += [F.when((F.col(f"{c}_state") == SINGLE) & F.col(k).isNull(), f"INVALID_{c.upper()}_CONTEXT") for c, k in (("year", "year"), ("playoffs", "playoffs"), ("date", "day"))]
    found = F.array_join(F.array_sort(F.array_compact(F.array(*codes))), ",")
    keys = F.when(F.col("league_key").isNull(), "MISSING_LEAGUE_CONTEXT").when(F.col("split_value").isNotNull() & F.col("split_key").isNull(), "INVALID_SPLIT_CONTEXT")
    return F.when(F.col("n_names") == 0, "MISSING_TEAM_NAME").when(F.col("n_names") > 1, "TEAM_NAME_CONFLICT").when(found != "", found).otherwise(keys)


def resolve_teams(feed: DataFrame) -> DataFrame:
    """(gameid, side, status, reason, team_id, candidates) of each side of each match.

    In order: an invalid id, several ids, one id (unless its context has several ids in the feed), and
    without an id the only one of the same name, league, year, split, playoffs and day. Candidates are the side's own ids,
    or those of its context if that contradicts its id or it has none.
    """
    groups = team_groups(feed).withColumn("context_reason", _context_reason())
    one = (F.size("ids") == 1) & (F.col("n_invalid") == 0)
    seen = groups.where(one & F.col("context_reason").isNull()).groupBy(*CONTEXT).agg(F.sort_array(F.collect_set(F.element_at("ids", 1))).alias("context_ids"))
    out = null_safe(groups, seen, list(CONTEXT)).withColumn("context_ids", F.when(F.col("context_reason").isNull(), F.coalesce("context_ids", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    n = F.size("context_ids")
    reason = (
        F.when(F.col("n_invalid") > 0, "INVALID_SOURCE_ID")
        .when((F.size("ids") > 1) | ((F.size("ids") == 1) & (n > 1)), "SOURCE_ID_CONFLICT")
        .when(F.size("ids") == 1, "SOURCE_ID_PRESENT")
        .when(F.col("context_reason").isNotNull(), F.col("context_reason"))
        .when(n == 0, "NO_SOURCE_ID_CANDIDATE").when(n == 1, "UNIQUE_FULL_CONTEXT").otherwise("AMBIGUOUS_SOURCE_ID_CANDIDATES")
    )
    out = out.withColumn("reason", reason)
    status = F.when(F.col("reason") == "SOURCE_ID_PRESENT", "SOURCE_ID").when(F.col("reason") == "UNIQUE_FULL_CONTEXT", "RECOVERED_UNIQUE").otherwise("UNRESOLVED")
    team = F.when(F.col("reason") == "SOURCE_ID_PRESENT", F.element_at("ids", 1)).when(F.col("reason") == "UNIQUE_FULL_CONTEXT", F.element_at("context_ids", 1))
    own = (F.col("n_invalid") > 0) | (F.size("ids") > 1) | ((F.size("ids") == 1) & (n <= 1))  # else what the context tells
    return out.select("gameid", "side", status.alias("status"), "reason", team.alias("team_id"), F.when(own, F.col("ids")).otherwise(F.col("context_ids")).alias("candidates"))


PLAYER_CONTEXT = ("name_key", "team_id", "position", "league_key", "year", "split_key")


def resolve_players(players: DataFrame, teams: DataFrame) -> DataFrame:
    """Player rows (gameid, side, participantid) with status, reason, player_id and team_id.

    In order: an invalid id, the id, an unresolved team, a missing context, recovery from the same
    name, team, position, league, year and split (null matches null).
    """
    rows = players.select(
        "gameid", "side", "participantid", "position", S.blank_to_null(F.col("playerid")).alias("id"), S.source_id_state(F.col("playerid")).alias("id_state"),
        S.canonical_key(F.col("playername")).alias("name_key"), S.canonical_key(F.col("league")).alias("league_key"), F.col("year").cast("string").alias("year"), S.canonical_key(F.col("split")).alias("split_key"),
    ).join(teams.select("gameid", "side", "team_id"), ["gameid", "side"], "left")
    whole = F.lit(True)
    for c in PLAYER_CONTEXT[:-1]:
        whole = whole & F.col(c).isNotNull()
    seen = rows.where((F.col("id_state") == "VALID") & whole).groupBy(*PLAYER_CONTEXT).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    out = null_safe(rows, seen, list(PLAYER_CONTEXT))
    n = F.coalesce(F.size("ids"), F.lit(0))
    reason = (
        F.when(F.col("id_state") == "INVALID", "INVALID_SOURCE_ID").when(F.col("id_state") == "VALID", "SOURCE_ID_PRESENT")
        .when(F.col("team_id").isNull(), "TEAM_UNRESOLVED").when(~whole, "INSUFFICIENT_CONTEXT")
        .when(n <= 0, "NO_SOURCE_ID_CANDIDATE").when(n == 1, "UNIQUE_FULL_CONTEXT").otherwise("AMBIGUOUS_SOURCE_ID_CANDIDATES")
    )
    out = out.withColumn("reason", reason)
    status = F.when(F.col("reason") == "SOURCE_ID_PRESENT", "SOURCE_ID").when(F.col("reason") == "UNIQUE_FULL_CONTEXT", "RECOVERED_UNIQUE").otherwise("UNRESOLVED")
    player = F.when(F.col("reason") == "SOURCE_ID_PRESENT", F.col("id")).when(F.col("reason") == "UNIQUE_FULL_CONTEXT", F.element_at("ids", 1))
    return out.select("gameid", "side", "participantid", "position", "team_id", status.alias("status"), "reason", player.alias("player_id"))


def target_status(resolved: DataFrame, id_col: str, references: DataFrame, reference_id: str, target_id: str) -> DataFrame:
    """``resolved`` with target_status: EXISTING (one target of this id), NEW_TARGET_REQUIRED, TARGET_CONFLICT, NOT_APPLICABLE (no id)."""
    known = references.where(F.col(reference_id).isNotNull()).groupBy(F.col(reference_id).alias("ref__")).agg(F.countDistinct(target_id).alias("n__"), F.min(target_id).alias("target__"))
    out = resolved.join(known, F.col(id_col) == F.col("ref__"), "left")
    status = F.when(F.col(id_col).isNull(), "NOT_APPLICABLE").when(F.col("n__").isNull(), "NEW_TARGET_REQUIRED").when(F.col("n__") == 1, "EXISTING").otherwise("TARGET_CONFLICT")
    return out.withColumns({"target_status": status, "target_id": F.when(F.col("n__") == 1, F.col("target__"))}).drop("ref__", "n__", "target__")


def map_champions(names: DataFrame, champions: DataFrame, name: str = "champion") -> DataFrame:
    """Distinct champion names with champion_id and reason; canonical and display names count alike."""
    keys = champions.select("champion_id", F.explode(F.array("canonical_name", "display_name")).alias("any_name")).select("champion_id", S.canonical_key(F.col("any_name")).alias("key"))
    known = keys.where("key IS NOT NULL").groupBy("key").agg(F.countDistinct("champion_id").alias("n"), F.min("champion_id").alias("one"))
    asked = names.select(name).distinct().withColumn("key", S.canonical_key(F.col(name)))
    both = asked.join(known, "key", "left")
    reason = F.when(F.col("key").isNull(), "MISSING_SOURCE_NAME").when(F.col("n").isNull(), "NO_CHAMPION_MATCH").when(F.col("n") == 1, "UNIQUE_CANONICAL_OR_DISPLAY_NAME").otherwise("AMBIGUOUS_CHAMPION_MATCH")
    return both.select(name, F.when(F.col("n") == 1, F.col("one")).alias("champion_id"), F.when(reason == "UNIQUE_CANONICAL_OR_DISPLAY_NAME", "MAPPED").otherwise("UNMAPPED").alias("status"), reason.alias("reason"))


__all__ = ["RESOLVED", "SINGLE", "direct", "map_champions", "recover", "resolve_players", "resolve_teams", "target_status", "team_groups"]
