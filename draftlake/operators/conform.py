"""From the resolved feed to the relational target: nine tables, rejects with their reasons, a plan of actions.

Every match of the feed ends either accepted or rejected with one primary reason; everything is
grouped by match or joined on ids, so the cost is that of a few shuffles on gameid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake import schemas as C
from draftlake.functions import scalars as S
from draftlake.operators import reconcile as R
from draftlake.operators.groups import collapse_state, collapse_value
from draftlake.operators.joins import null_safe
from draftlake.operators.quality import row_kind
from draftlake.session import settled

REQUIRED = ("league", "year", "split", "playoffs", "date", "game", "patch")
METADATA_INVALID, LINEUP_INCOMPLETE, DEPENDENCY_INVALID = "GAME_METADATA_INVALID", "GAME_LINEUP_INCOMPLETE", "GAME_DEPENDENCY_INVALID"


def typed(feed: DataFrame) -> DataFrame:
    """The core columns: blanks null, integers and the date parsed."""
    out = feed.select(*(S.blank_to_null(F.col(c)).alias(c) for c in C.CORE_COLUMNS))
    return out.withColumns({c: S.whole_number(F.col(c)) for c in C.INTEGER_COLUMNS} | {"date": S.timestamp(F.col("date"))})


def match_metadata(core: DataFrame) -> DataFrame:
    """One row a match: its single values, and ``codes`` (sorted; empty: valid)."""
    own = core.groupBy("gameid").agg(
        *(collapse_state(F.col(c)).alias(f"{c}_state") for c in REQUIRED), *(collapse_value(F.col(c)).alias(c) for c in REQUIRED),
        collapse_state(F.col("url")).alias("url_state"), collapse_value(F.col("url")).alias("url"),
    )
    state = {"CONFLICT": "CONFLICTING", "MIXED": "MIXED_MISSING", "MISSING": "MISSING"}  # fixed values
    codes = [F.when(F.col(f"{c}_state") == k, f"{v}_{c.upper()}") for c in REQUIRED for k, v in state.items()]
    ranges = [
        F.when(~F.col("game").between(1, 32767), "INVALID_GAME_NUMBER"), F.when(~F.col("year").between(-32768, 32767), "INVALID_SOURCE_YEAR"),
        F.when(F.length("patch") > 20, "PATCH_TOO_LONG"), F.when(F.length("gameid") > 100, "GAME_ID_TOO_LONG"), F.when(~F.col("playoffs").isin(0, 1), "INVALID_PLAYOFFS"),
    ]
    first = F.sort_array(F.array_compact(F.array(*codes)))
    return own.withColumn("codes", F.when(F.size(first) > 0, first).otherwise(F.sort_array(F.array_compact(F.array(*ranges)))))


def contexts(games: DataFrame) -> DataFrame:
    """``games`` with tournament_id, stage_name and stage_id, by hashes of their keys."""
    league, split = S.canonical_key(F.col("league")), S.canonical_key(F.col("split"))
    stage = F.when(F.col("playoffs") == 1, F.concat(F.col("split"), F.lit(" Playoffs"))).otherwise(F.col("split"))
    named = games.withColumns({"league_key": league, "split_key": split})
    return named.withColumns(
        {
            "tournament_id": S.stable_id("tournament_", F.col("league_key"), F.col("year")),
            "stage_name": stage,
            "stage_id": S.stable_id("stage_", F.col("league_key"), F.col("year"), F.col("split_key"), F.col("playoffs")),
        }
    )


def series_evidence(games: DataFrame, pairs: DataFrame) -> DataFrame:
    """(gameid, series_key, best_of, codes) of valid matches; no code: the match belongs to the series.

    The key comes from the match id (whose number must be the game's), else from the address; the
    best-of must be named. An address shared by two matches blocks both; then each series is checked
    as a whole and a failure blocks all its matches.
    """
    by_id, number = S.series_key(F.col("gameid")), S.series_number(F.col("gameid"))
    by_url = reduce(F.coalesce, [S.url_parameter(F.col("url"), p) for p in S.SERIES_PARAMETERS])
    host = F.lower(F.split_part("url", F.lit("/"), F.lit(3)))
    best = F.coalesce(S.best_of(F.col("url")), *(S.whole_number(S.url_parameter(F.col("url"), p)).cast("int") for p in ("bestof", "best_of", "bo")))
    own = games.join(pairs, "gameid", "left").withColumns(
        {"series_key": F.coalesce(by_id, F.concat(host, F.lit("|"), by_url)), "best_of": best, }
    )
    shares = games.where("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("shares"))  # matches without one never meet
    own = own.where("url IS NOT NULL").join(shares, "url").unionByName(own.where("url IS NULL").withColumn("shares", F.lit(None).cast("long")))
    first = F.array_compact(
        F.array(
            F.when(F.col("series_key").isNull(), "SOURCE_SERIES_KEY_MISSING"), F.when(F.length("series_key") > 80, "SERIES_ID_TOO_LONG"), F.when(number != F.col("game"), "GAMEID_GAME_NUMBER_CONFLICT"),
            F.when(F.col("best_of").isNull() | ~F.col("best_of").isin(1, 3, 5), "EXPLICIT_BEST_OF_MISSING"), F.when(F.col("shares") > 1, "URL_TO_GAMEID_CONFLICT"), F.when(F.col("team_pair").isNull(), "TEAM_PAIR_UNRESOLVED"),
        )
    )
    own = own.withColumn("codes", first)
    one = ("league", "year", "split", "playoffs", "team_pair", "best_of")
    order = Window.partitionBy("series_key").orderBy("game", "gameid")
    good = own.where(F.size("codes") == 0).withColumn("prev", F.lag("date").over(order))
    whole = good.groupBy("series_key").agg(
        F.array_compact(
            F.array(
                *(F.when(F.countDistinct(c) > 1, f"SERIES_{c.upper()}_CONFLICT") for c in one),
                F.when(F.countDistinct("game") < F.count(F.lit(1)), "DUPLICATE_SERIES_GAME_NUMBER"), F.when(F.min("game") < 1, "INVALID_SERIES_GAME_NUMBER"), F.when((F.min("game") != 1) | (F.max("game") != F.countDistinct("game")), "NON_CONTIGUOUS_SERIES_GAME_NUMBER"),
                F.when(F.max("game") > F.max("best_of"), "GAME_NUMBER_EXCEEDS_EXPLICIT_BEST_OF"), F.when(F.max(F.coalesce(F.col("prev") > F.col("date"), F.lit(False))), "SERIES_DATE_ORDER_CONFLICT"),
            )
        ).alias("of_series")
    )
    keyed, none = own.where("series_key IS NOT NULL"), own.where("series_key IS NULL")
    out = keyed.join(whole, "series_key", "left").unionByName(none.withColumn("of_series", F.lit(None).cast("array<string>")))
    return out.select("gameid", "series_key", "best_of", F.concat("codes", F.when(F.size("codes") == 0, F.coalesce("of_series", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))).alias("codes"))


def lineup_codes(players: DataFrame) -> DataFrame:
    """(gameid, codes): what keeps a match's ten player rows from being a lineup (sorted; empty: complete).

    A row with a code is no valid row; a match needs ten valid ones, of ten players and participant ids, five roles a side.
    """
    role, ok = F.coalesce(F.col("position").isin(*C.POSITIONS), F.lit(False)), F.coalesce(F.col("side").isin(*C.SIDES), F.lit(False))
    faults = {
        "INVALID_SIDE": ~ok, "INVALID_ROLE": ~role, "MISSING_PARTICIPANT_ID": F.col("participantid").isNull(),
        "PLAYER_ID_UNRESOLVED": F.col("player_id").isNull(), "CHAMPION_UNMAPPED": F.col("champion_id").isNull(),
    }
    rows = players.select("gameid", "side", "position", "participantid", "player_id", *(bad.alias(code) for code, bad in faults.items()))
    rows = rows.withColumn("valid", ~reduce(lambda a, b: a | b, (F.col(code) for code in faults)))
    several = lambda c: F.size(F.collect_set(F.when(F.col("valid"), F.col(c))))
    side = lambda s: F.col("valid") & (F.col("side") == s)
    # valid rows have one of five positions: they are five, and none twice, if each is there once
    torn = lambda s: reduce(lambda a, b: a | b, (F.count_if(side(s) & (F.col("position") == p)) != 1 for p in C.POSITIONS))
    whole = rows.groupBy("gameid").agg(
        F.array_compact(F.array(*(F.when(F.bool_or(code), code) for code in faults))).alias("of_rows"),
        F.array_compact(
            F.array(
                F.when(F.count_if("valid") != 10, "GAME_REQUIRES_TEN_RESOLVED_PLAYERS"), F.when(several("player_id") != 10, "GAME_REQUIRES_TEN_UNIQUE_PLAYERS"),
                F.when(several("participantid") != 10, "DUPLICATE_GAME_PARTICIPANT_ID"), F.when(torn("Blue") | torn("Red"), "TEAM_ROLE_SET_INCOMPLETE"),
            )
        ).alias("of_match"),
    )
    return whole.select("gameid", F.array_sort(F.array_union("of_rows", "of_match")).alias("codes"))


def dependency_codes(teams: DataFrame) -> DataFrame:
    """(gameid, codes, blue, red, winner) from team rows (side, team_id, result)."""
    row = F.when(~F.coalesce(F.col("side").isin(*C.SIDES), F.lit(False)), "INVALID_SIDE").when(F.col("team_id").isNull(), "TEAM_UNRESOLVED").when(~F.coalesce(F.col("result").isin(0, 1), F.lit(False)), "INVALID_TEAM_RESULT")
    sound = F.col("code").isNull()
    of = lambda side: F.max(F.when(sound & (F.col("side") == side), F.col("team_id")))
    good = lambda c: F.when(sound, F.col(c))
    whole = teams.withColumn("code", row).groupBy("gameid").agg(
        F.collect_set("code").alias("of_rows"), of("Blue").alias("blue"), of("Red").alias("red"), F.max(F.when(sound & (F.col("result") == 1), F.col("team_id"))).alias("winner"),
        F.array_compact(
            F.array(
                F.when(F.array_sort(F.collect_list(good("side"))) != F.array(*map(F.lit, C.SIDES)), "GAME_REQUIRES_BLUE_AND_RED"), F.when(F.countDistinct(good("team_id")) != 2, "GAME_REQUIRES_TWO_TEAMS"),
                F.when(F.count_if(sound & (F.col("result") == 1)) != 1, "GAME_REQUIRES_ONE_WINNER"),
            )
        ).alias("of_match"),
    )
    return whole.select("gameid", F.array_sort(F.array_union("of_rows", "of_match")).alias("codes"), "blue", "red", "winner")


def dispositions(metadata: DataFrame, lineups: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row for each match: ``reason`` (null: accepted) and ``detail``; metadata beats lineup beats dependency."""
    none = F.array().cast("array<string>")
    both = metadata.select("gameid", F.col("codes").alias("m")).join(lineups.select("gameid", F.col("codes").alias("l")), "gameid", "left")
    both = both.join(dependencies.select("gameid", F.col("codes").alias("d")), "gameid", "left")
    lineup, dependency = F.coalesce("l", F.array(F.lit("GAME_REQUIRES_TEN_RESOLVED_PLAYERS"))), F.coalesce("d", F.array(F.lit("GAME_REQUIRES_BLUE_AND_RED")))
    reason = F.when(F.size("m") > 0, METADATA_INVALID).when(F.size(lineup) > 0, LINEUP_INCOMPLETE).when(F.size(dependency) > 0, DEPENDENCY_INVALID)
    codes = F.when(F.size("m") > 0, F.col("m")).otherwise(F.array_sort(F.array_union(F.array_union(lineup, dependency), none)))
    return both.select("gameid", reason.alias("reason"), F.when(reason.isNotNull(), F.array_join(codes, ",")).alias("detail"))


def _target_id(prefix: str, source: Column) -> Column:
    return S.stable_id(prefix, source)


def entity_records(resolved: DataFrame, prefix: str, id_col: str, names: DataFrame, references: DataFrame) -> DataFrame:
    """One row for each resolved source id: the existing target of that id, or a new one with a hashed id; ``reason`` where neither works.

    ``names`` has (source_id, name); references have (target_id, source_id, canonical_name, display_name).
    """
    ids = resolved.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("source_id")).distinct()
    own = names.groupBy("source_id").agg(F.countDistinct(S.canonical_key(F.col("name"))).alias("n_names"), F.min(S.clean_label(F.col("name"))).alias("name"))
    known = references.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.countDistinct("target_id").alias("n"), F.min(F.struct("target_id", "canonical_name", "display_name")).alias("one"))
    taken = references.select(F.col("target_id").alias("new_id")).distinct().withColumn("taken", F.lit(True))
    out = ids.join(own, "source_id", "left").join(known, "source_id", "left").withColumn("new_id", _target_id(prefix, F.col("source_id"))).join(taken, "new_id", "left")
    reason = (
        F.when(F.col("n") > 1, "TARGET_ORACLE_ID_CONFLICT").when(F.col("n") == 1, F.lit(None).cast("string"))
        .when(F.coalesce("n_names", F.lit(0)) == 0, "MISSING_SOURCE_NAME").when(F.col("n_names") > 1, "SOURCE_NAME_CONFLICT").when(F.col("taken"), "TARGET_PRIMARY_KEY_COLLISION")
    )
    exists = F.col("n") == 1
    return out.select(
        "source_id", F.when(exists, F.col("one.target_id")).otherwise(F.col("new_id")).alias("target_id"), F.when(exists, F.col("one.canonical_name")).otherwise(F.col("name")).alias("canonical_name"),
        F.when(exists, F.col("one.display_name")).otherwise(F.col("name")).alias("display_name"), reason.alias("reason"),
    )


def targets(core: DataFrame, teams: DataFrame, players: DataFrame, champions: DataFrame, team_refs: DataFrame, player_refs: DataFrame) -> dict[str, DataFrame]:
    """The nine candidate tables, ``dispositions``, ``series_codes`` and ``issues`` of a typed feed and its resolved identities."""
    # every table below derives from these few, so each is computed once
    core, teams, players, champions = settled(core), settled(teams), settled(players), settled(champions)
    meta = settled(match_metadata(core))
    kinds = core.withColumn("kind", row_kind())
    side_teams = teams.select("gameid", "side", F.col("team_id").alias("source_team"))
    team_records = settled(entity_records(teams, "team_", "team_id", core.select(F.col("teamid").alias("source_id"), F.col("teamname").alias("name")).where("source_id IS NOT NULL"), team_refs))
    player_records = settled(entity_records(players, "player_", "player_id", core.select(F.col("playerid").alias("source_id"), F.col("playername").alias("name")).where("source_id IS NOT NULL"), player_refs))
    good_teams = team_records.where("reason IS NULL").select(F.col("source_id").alias("source_team"), F.col("target_id").alias("team_id"))
    good_players = player_records.where("reason IS NULL").select(F.col("source_id").alias("source_player"), F.col("target_id").alias("player_id"))
    sides = settled(side_teams.join(good_teams, "source_team", "left").select("gameid", "side", "team_id"))
    team_rows = kinds.where("kind = 'team'").select("gameid", "side", "result").join(sides, ["gameid", "side"], "left")
    lineup = kinds.where("kind = 'player'").select("gameid", "side", "participantid", "position", "champion")
    resolved = players.select("gameid", F.col("participantid").cast("long").alias("participantid"), F.col("player_id").alias("source_player"))
    lineup = null_safe(lineup, resolved, ["gameid", "participantid"]).join(good_players, "source_player", "left").join(sides, ["gameid", "side"], "left")
    lineup = settled(lineup.join(champions.where("status = 'MAPPED'").select("champion", "champion_id"), "champion", "left"))
    own = settled(dependency_codes(team_rows))
    judged = settled(dispositions(meta, lineup_codes(lineup), own))
    games = contexts(meta.join(judged.where("reason IS NULL").select("gameid"), "gameid", "left_semi")).join(own.select("gameid", "blue", "red", "winner"), "gameid")
    games = settled(games)
    pairs = games.select("gameid", F.array_join(F.sort_array(F.array("blue", "red")), "|").alias("team_pair"))
    in_series = settled(series_evidence(games, pairs))
    belongs = in_series.where(F.size("codes") == 0).select("gameid", S.stable_id("series_", F.col("series_key")).alias("series_id"), "best_of")
    games = settled(games.join(belongs, "gameid", "left"))
    side = F.create_map(*(F.lit(x) for kv in C.TARGET_SIDES.items() for x in kv))
    role = F.create_map(*(F.lit(x) for kv in C.TARGET_ROLES.items() for x in kv))
    ids = games.select("gameid")
    null_text, null_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    entity = lambda df, key, source, media: df.where("reason IS NULL").select(F.col("target_id").alias(key), F.col("source_id").alias(source), "canonical_name", "display_name", null_text.alias(media))
    issues = reduce(
        DataFrame.unionByName,
        [
            judged.where("reason IS NOT NULL").select(F.lit("game").alias("entity"), F.col("gameid").alias("source_key"), "reason", "detail"),
            in_series.where(F.size("codes") > 0).select(F.lit("series").alias("entity"), F.col("gameid").alias("source_key"), F.element_at("codes", 1).alias("reason"), F.array_join("codes", ",").alias("detail")),
            *(r.where("reason IS NOT NULL").select(F.lit(n).alias("entity"), F.col("source_id").alias("source_key"), "reason", null_text.alias("detail")) for n, r in (("team", team_records), ("player", player_records))),
            champions.where("status <> 'MAPPED'").select(F.lit("champion").alias("entity"), F.col("champion").alias("source_key"), "reason", null_text.alias("detail")),
            lineup.join(judged.where("reason IS NOT NULL").select("gameid", "reason"), "gameid").select(F.lit("game_player").alias("entity"), F.concat_ws("|", "gameid", "participantid").alias("source_key"), F.lit("GAME_PLAYER_BLOCKED_BY_GAME").alias("reason"), F.col("reason").alias("detail")),
        ],
    )
    return {
        "game_patch": games.select(F.col("patch").alias("patch_id"), F.col("patch").alias("patch_name")).distinct(),
        "tournament": games.groupBy("tournament_id").agg(F.min(S.clean_label(F.col("league"))).alias("name"), F.min("year").cast("int").alias("season")),
        "tournament_stage": games.groupBy("stage_id").agg(F.min("tournament_id").alias("tournament_id"), F.min(S.clean_label(F.col("stage_name"))).alias("name")),
        "series": games.where("series_id IS NOT NULL").groupBy("series_id").agg(F.min("stage_id").alias("stage_id"), F.min("best_of").alias("best_of")),
        "team": entity(team_records, "team_id", "oracle_team_id", "logo_file"),
        "player": entity(player_records, "player_id", "oracle_player_id", "photo_file"),
        "game": games.select(
            F.col("gameid").alias("game_id"), "series_id", F.when(F.col("series_id").isNull(), F.col("stage_id")).alias("stage_id"), F.col("patch").alias("patch_id"), F.col("game").alias("game_number"),
            null_time.alias("scheduled_at"), null_time.alias("started_at"), null_time.alias("ended_at"), F.col("winner").alias("winner_team_id"),
        ),
        "game_team": sides.join(ids, "gameid", "left_semi").select(F.col("gameid").alias("game_id"), side[F.col("side")].alias("side"), "team_id", F.lit("CONFIRMED").alias("confirmation_status")),
        "game_player": lineup.join(ids, "gameid", "left_semi").select(F.col("gameid").alias("game_id"), side[F.col("side")].alias("side"), role[F.col("position")].alias("role"), "player_id", "champion_id", F.lit("CONFIRMED").alias("confirmation_status")),
        "dispositions": judged,
        "series_codes": in_series,
        "issues": issues,
    }


def plan(candidates: dict[str, DataFrame], snapshot: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Actions of the nine tables, in the order of their foreign keys."""
    return {t: R.actions(candidates[t], snapshot[t], list(k)) for t, k in C.TARGET_KEYS.items()}


def reconciliation(core: DataFrame, out: dict[str, DataFrame]) -> DataFrame:
    """Invariants as rows (name, left, right, holds), all of which must hold before anything is written."""
    count = lambda df, name, times=1: df.agg(F.lit(name).alias("name"), (F.count(F.lit(1)) * times).alias("n"))
    times = {"two teams for each game": 2, "ten players for each game": 10}
    accepted = out["dispositions"].where("reason IS NULL")
    pairs = {
        "every match has one disposition": (core.select("gameid").distinct(), out["dispositions"]),
        "a game for each accepted match": (accepted, out["game"]),
        "two teams for each game": (accepted, out["game_team"]),
        "ten players for each game": (accepted, out["game_player"]),
        "each game has exactly one parent": (out["game"], out["game"].where("(series_id IS NULL) <> (stage_id IS NULL)")),
        "winners take part": (out["game"], out["game"].join(out["game_team"].select("game_id", F.col("team_id").alias("winner_team_id")), ["game_id", "winner_team_id"], "left_semi")),
        "teams of participations exist": (out["game_team"], out["game_team"].join(out["team"], "team_id", "left_semi")),
        "players of lineups exist": (out["game_player"], out["game_player"].join(out["player"], "player_id", "left_semi")),
        "stages have tournaments": (out["tournament_stage"], out["tournament_stage"].join(out["tournament"], "tournament_id", "left_semi")),
        "series have stages": (out["series"], out["series"].join(out["tournament_stage"], "stage_id", "left_semi")),
    }
    rows = [count(a, n, times.get(n, 1)).withColumnRenamed("n", "left").join(count(b, n).withColumnRenamed("n", "right"), "name") for n, (a, b) in pairs.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("holds", F.col("left") == F.col("right"))


def run_state(dispositions_: DataFrame, issues: DataFrame) -> DataFrame:
    """BLOCKED (nothing accepted), PARTIAL (some rejected), READY_WITH_ISSUES or READY; one row."""
    own = dispositions_.agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    found = issues.agg(F.count(F.lit(1)).alias("n_issues"))
    state = F.when(F.col("accepted") == 0, "BLOCKED").when(F.col("rejected") > 0, "PARTIAL").when(F.col("n_issues") > 0, "READY_WITH_ISSUES").otherwise("READY")
    return own.crossJoin(found).withColumn("state", state)  # one row each
