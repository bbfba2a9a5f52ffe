"""Vocabularies, columns and types of the match data."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the source feed and of the relational target.
CORE_COLUMNS = (
    "gameid", "datacompleteness", "url", "league", "year", "split", "playoffs", "date", "game", "patch",
    "participantid", "side", "position", "playername", "playerid", "teamname", "teamid", "champion", "gamelength", "result",
)
INTEGER_COLUMNS = ("year", "playoffs", "game", "participantid", "gamelength", "result")
PICKS = tuple(f"pick{i}" for i in range(1, 6))
BANS = tuple(f"ban{i}" for i in range(1, 6))
POSITIONS = ("top", "jng", "mid", "bot", "sup")
TEAM_POSITION = "team"
SIDES = ("Blue", "Red")
PLAYER_IDS = tuple(range(1, 11))
TEAM_IDS = (100, 200)
COMPLETENESS = ("complete", "partial")
TARGET_SIDES = {"Blue": "BLUE", "Red": "RED"}
TARGET_ROLES = {"top": "TOP", "jng": "JUNGLE", "mid": "MID", "bot": "BOT", "sup": "SUPPORT"}
ROLES = ("TOP", "JUNGLE", "MID", "BOT", "SUPPORT")

# The audit's issue codes with their group and severity.
ISSUES = {
    "MISSING_REQUIRED_COLUMN": ("SCHEMA", "ERROR"),
    "MISSING_GAME_ID": ("IDENTIFIER", "ERROR"),
    "MISSING_PARTICIPANT_ID": ("IDENTIFIER", "ERROR"),
    "DUPLICATE_GAME_PARTICIPANT": ("IDENTIFIER", "ERROR"),
    "INVALID_GAME_ROW_COUNT": ("STRUCTURE", "ERROR"),
    "INVALID_PLAYER_ROW_COUNT": ("STRUCTURE", "ERROR"),
    "INVALID_TEAM_ROW_COUNT": ("STRUCTURE", "ERROR"),
    "MISSING_PLAYER_ID": ("IDENTIFIER", "WARNING"),
    "MISSING_TEAM_ID": ("IDENTIFIER", "WARNING"),
    "MISSING_PLAYER_NAME": ("IDENTIFIER", "WARNING"),
    "MISSING_TEAM_NAME": ("IDENTIFIER", "WARNING"),
    "MISSING_POSITION": ("CONTENT", "ERROR"),
    "MISSING_SIDE": ("CONTENT", "ERROR"),
    "MISSING_PATCH": ("CONTENT", "ERROR"),
    "MISSING_PLAYER_CHAMPION": ("CONTENT", "ERROR"),
    "INVALID_POSITION": ("CONTENT", "ERROR"),
    "DUPLICATE_TEAM_ROLE": ("STRUCTURE", "ERROR"),
    "INCOMPLETE_TEAM_ROLES": ("STRUCTURE", "ERROR"),
    "MISSING_DATE": ("TIME", "ERROR"),
    "INVALID_DATE": ("TIME", "ERROR"),
    "MISSING_YEAR": ("TIME", "ERROR"),
    "INVALID_YEAR": ("TIME", "ERROR"),
    "YEAR_DATE_MISMATCH": ("TIME", "ERROR"),
    "INCONSISTENT_GAME_YEAR": ("TIME", "ERROR"),
    "MISSING_EXPLICIT_GAME_END_TIME": ("TIME", "WARNING"),
    "MISSING_RESULT": ("CONTENT", "ERROR"),
    "INVALID_RESULT_VALUE": ("CONTENT", "ERROR"),
    "INVALID_RESULT_STRUCTURE": ("CONTENT", "ERROR"),
    "PLAYER_TEAM_RESULT_MISMATCH": ("CONTENT", "ERROR"),
    "MISSING_TEAM_PICK": ("CONTENT", "WARNING"),
    "MISSING_TEAM_BAN": ("CONTENT", "WARNING"),
    "INVALID_TEAM_SIDE_STRUCTURE": ("STRUCTURE", "ERROR"),
    "MISSING_DATA_COMPLETENESS": ("CONTENT", "WARNING"),
    "UNKNOWN_DATA_COMPLETENESS": ("CONTENT", "WARNING"),
    "INVALID_GAME_DATA_COMPLETENESS": ("CONTENT", "WARNING"),
}

SLOT = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("player_id", T.StringType())]))
MATCH = T.StructType(
    [
        T.StructField("game_id", T.StringType()),
        T.StructField("blue_team_id", T.StringType()),
        T.StructField("red_team_id", T.StringType()),
        T.StructField("blue_roster", SLOT),
        T.StructField("red_roster", SLOT),
        T.StructField("winner_team_id", T.StringType()),
        T.StructField("ended_at", T.TimestampType()),
    ]
)

# Keys by which each target table is reconciled, in the order of their foreign keys.
TARGET_KEYS = {
    "game_patch": ("patch_id",),
    "tournament": ("tournament_id",),
    "tournament_stage": ("stage_id",),
    "series": ("series_id",),
    "team": ("team_id",),
    "player": ("player_id",),
    "game": ("game_id",),
    "game_team": ("game_id", "side"),
    "game_player": ("game_id", "side", "role"),
}
# A null candidate never overwrites these.
PRESERVED = ("logo_file", "photo_file", "started_at", "ended_at")
