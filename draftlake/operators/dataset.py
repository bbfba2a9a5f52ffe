"""PRE and POST features of matches, and the paired dataset of both with its exclusions.

History rows are ``schemas.MATCH`` (game_id, blue_team_id, red_team_id, blue_roster, red_roster, winner_team_id,
ended_at), for POST with ``slots`` (team_id, side, role, player_id, champion_id; ten a match). Targets are matches with
``patch`` and ``history_cutoff_at``, for POST with ``slots`` of their final lineup.

All statistics are point-in-time (``history``): one sort of history and targets by team, by team and side, by
pair of teams, and by player and champion. The last games travel as arrays of at most a window and one more, so that
a target's own match, if it ended before the cutoff, is taken out of its own history.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import scalars as S
from draftlake.operators.history import lists_before, sums_before
from draftlake.schemas import ROLES
from draftlake.session import settled

RECENT, SIDE, HEAD_TO_HEAD = 10, 20, 10
SIDES = ("BLUE", "RED")

# Reasons why a record can't be used, in the order in which they are looked for.
ID_INVALID, TEAMS_INVALID, LINEUP_INVALID, PATCH_INVALID = "E_ID_INVALID", "E_TEAMS_INVALID", "E_LINEUP_INVALID", "E_PATCH_INVALID"
WINNER_INVALID, DUPLICATE_HISTORY = "E_HISTORY_WINNER_INVALID", "E_HISTORY_DUPLICATE_GAME_ID"
CUTOFF_MISSING, CUTOFF_CONFLICT, CUTOFF_EVIDENCE, CUTOFF_POLICY = "E_CUTOFF_MISSING", "E_CUTOFF_CONFLICT", "E_CUTOFF_EVIDENCE_INVALID", "E_CUTOFF_POLICY_INVALID"
CUTOFF_UNAPPROVED, CUTOFF_PROTOCOL, CUTOFF_STATUS, CUTOFF_UNVERIFIED = "E_CUTOFF_POLICY_UNAPPROVED", "E_CUTOFF_PROTOCOL_MISMATCH", "E_CUTOFF_STATUS_INVALID", "E_CUTOFF_UNVERIFIED"
TARGET_DUPLICATE, TARGET_WINNER, END_MISSING, END_EARLY = "E_TARGET_DUPLICATE_GAME_ID", "E_TARGET_WINNER_INVALID", "E_LABEL_END_MISSING", "E_LABEL_END_NOT_AFTER_CUTOFF"
SOURCE_CONFLICT, LINEUP_INCOMPLETE, POST_LINEUP_INVALID, CHAMPION_UNKNOWN = "E_SOURCE_CONFLICT", "E_LINEUP_INCOMPLETE", "E_POST_LINEUP_INVALID", "E_CHAMPION_UNKNOWN"
INCOMPATIBLE, HISTORY_MISMATCH = "E_EVAL_INCOMPATIBLE", "E_PRE_HISTORY_MISMATCH"
STRICT, RETROSPECTIVE = "STRICT_PRE", "retrospective-utc-day-minus1-v1"
STATUSES = ("UNVERIFIED", "VERIFIED_EXTERNALLY", "PROTOCOL_ASSUMED")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that holds (null counts as no), null if none does."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), code) for bad, code in checks))


def bad_id(value: Column, longest: int) -> Column:
    """Null, too long, or no stable id."""
    return value.isNull() | (F.length(value) > longest) | ~S.is_stable_id(value)


def _players(roster: Column) -> Column:
    return roster["player_id"]


ID = r"[A-Za-z0-9][A-Za-z0-9._:-]{0,63}"


def _all_ids(values: Column) -> Column:
    """All of an array are stable ids of up to 64 characters, by one look."""
    return F.array_join(values, "\x1f", "").rlike(rf"^{ID}(?:\x1f{ID})*\z")


def lineup_reason(game: str = "game_id") -> Column:
    """Why the teams and rosters of a match can't be used: ids, different teams, five roles a side, ten players.

    Rosters in the order of roles are seen to be right without looking at each player; the checks are for the others.
    """
    blue, red = F.col("blue_roster"), F.col("red_roster")
    roles = F.sort_array(F.array(*map(F.lit, ROLES)))
    whole = lambda r: r.isNotNull() & (F.size(r) == 5) & (F.sort_array(F.transform(r, lambda s: s["role"])) == roles)
    ids = F.concat(_players(blue), _players(red))
    ordered = F.array(*map(F.lit, ROLES))
    teams = F.array("blue_team_id", "red_team_id")
    right = (
        ~bad_id(F.col(game), 100) & _all_ids(F.concat(teams, ids)) & (F.col("blue_team_id") != F.col("red_team_id")) & (blue["role"] == ordered) & (red["role"] == ordered)
        & (F.size(F.array_distinct(ids)) == 10)
    )
    reason = first_reason(
        (bad_id(F.col(game), 100) | bad_id(F.col("blue_team_id"), 64) | bad_id(F.col("red_team_id"), 64), ID_INVALID),
        (F.col("blue_team_id") == F.col("red_team_id"), TEAMS_INVALID),
        (~F.coalesce(whole(blue) & whole(red), F.lit(False)), LINEUP_INVALID),
        (F.exists(ids, lambda i: bad_id(i, 64)), ID_INVALID),
        (F.size(F.array_distinct(ids)) != 10, LINEUP_INVALID),
    )
    return F.when(~F.coalesce(right, F.lit(False)), reason)


def history_issues(history: DataFrame) -> DataFrame:
    """(game_id, reason) of history rows that block a run; must be empty."""
    bad = history.select("game_id", F.coalesce(lineup_reason(), first_reason((bad_id(F.col("winner_team_id"), 64), ID_INVALID), (~F.col("winner_team_id").isin(F.col("blue_team_id"), F.col("red_team_id")), WINNER_INVALID))).alias("reason"))
    twice = history.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("game_id", F.lit(DUPLICATE_HISTORY).alias("reason"))
    return twice.union(bad.where("reason IS NOT NULL"))


def _sided(matches: DataFrame, *more: str, won: Callable[[Column], Column] | None = None) -> DataFrame:
    """Two rows a match, one for each side: team, side, players, and by ``won`` whether the team has won."""
    team = lambda s: F.col(f"{s.lower()}_team_id")
    results = lambda s: (won(team(s)).alias("won"),) if won else ()
    sides = F.array(*(F.struct(team(s).alias("team"), F.lit(s).alias("side"), _players(F.col(f"{s.lower()}_roster")).alias("players"), *results(s)) for s in SIDES))
    return matches.select("game_id", *more, F.explode(sides).alias("s")).select("game_id", *more, "s.*")


def _last(games: Column, n: int, own: Column) -> Column:
    """The last n of an ascending list of games, latest first, without the target's own."""
    return F.slice(F.reverse(F.filter(games, lambda g: g["game_id"] != own)), 1, n)


def _counts(name: str, games: Column) -> list[Column]:
    """Number, wins and ids of a list of games: ``name``_n, ``name``_w, ``name``_ids."""
    wins = F.size(F.filter(games, lambda g: g["won"]))
    return [F.size(games).alias(f"{name}_n"), wins.alias(f"{name}_w"), F.transform(games, lambda g: g["game_id"]).alias(f"{name}_ids")]


def _stat(name: str) -> list[Column]:
    """The fields of a rate of wins from its ``_counts``: value, sample_count, missing, win_count, game_ids."""
    n, wins = F.col(f"{name}_n"), F.col(f"{name}_w")
    fields = {"value": F.when(n > 0, wins / n), "sample_count": n, "missing": n == 0, "win_count": wins, "game_ids": F.col(f"{name}_ids")}
    return [value.alias(f"{name}_{field}") for field, value in fields.items()]


def _continuity(name: str) -> list[Column]:
    """The fields of a side's roster continuity: value, sample_count, missing, game_ids."""
    side = name.split("_")[0]
    common, last = F.col(f"{side}_common"), F.col(f"{side}_last_id")
    fields = {"value": F.when(common >= 0, common / 5), "sample_count": common.isNotNull().cast("int"), "missing": common.isNull(), "game_ids": F.array_compact(F.array(last))}
    return [value.alias(f"{name}_{field}") for field, value in fields.items()]


def pre_features(targets: DataFrame, history: DataFrame, recent: int = RECENT, side: int = SIDE, head_to_head: int = HEAD_TO_HEAD) -> DataFrame:
    """``targets`` (one row an id) with the 26 PRE columns, and the ids of the games of each feature.

    For blue and red: recent form (all games of the team), side win rate (games on the same side), roster
    continuity (players in common with the team's latest game, of five); head to head from blue's point of view.
    Passes take no more of a target than they look at; what they find travels as counts, and lists of ids only if they are asked for.
    """
    # history and targets are dealt out by team once, for the lists of the team and of its side; players travel as one column for both
    won = lambda team: F.col("winner_team_id") == team
    team = _sided(history, "ended_at", won=won)
    own, game = F.col("game_id"), F.struct("game_id", "won")

    def rosters(games: Column) -> list[Column]:
        last = F.get(_last(games, 1, own), F.lit(0))
        common = F.when(last.isNotNull(), F.coalesce(F.size(F.array_intersect("players", last["players"])), F.lit(-1)))
        return [common.alias("common"), last["game_id"].alias("last_id")]

    # players only of the last game, and of the one before in case that the last is the target's own
    lists = [
        (recent + 1, game, (), lambda games: _counts("recent_form", _last(games, recent, own))), (2, F.struct("game_id", "players"), (), rosters),
        (side + 1, game, ("side",), lambda games: _counts("side_win_rate", _last(games, side, own))),
    ]
    seen = lists_before(team, _sided(targets, "history_cutoff_at"), ["team"], lists, cutoff="history_cutoff_at")
    found = [c for c in seen.columns if c not in ("game_id", "team", "side", "players")]
    sides = seen.groupBy("game_id").agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s.lower()}_{c}") for s in SIDES for c in found))
    pair = lambda df: df.withColumns({"a": F.least("blue_team_id", "red_team_id"), "b": F.greatest("blue_team_id", "red_team_id")})
    met = pair(history).select("game_id", "ended_at", "a", "b", won(F.col("a")).alias("a_won"))
    narrow = pair(targets).select("game_id", "history_cutoff_at", "a", "b", (F.col("blue_team_id") == F.col("a")).alias("blue_is_a"))
    of_blue = lambda games: F.transform(games, lambda g: F.struct(g["game_id"].alias("game_id"), (g["a_won"] == F.col("blue_is_a")).alias("won")))
    lists = [(head_to_head + 1, F.struct("game_id", "a_won"), (), lambda games: _counts("h2h_blue", of_blue(_last(games, head_to_head, own))))]
    both = lists_before(met, narrow, ["a", "b"], lists, cutoff="history_cutoff_at").drop("a", "b", "blue_is_a")
    out = targets.join(both, "game_id").join(sides, "game_id")
    columns = [c for f in PRE_STATS for c in (_continuity(f) if f.endswith("continuity") else _stat(f))]
    return out.select(*targets.columns, *columns)


PRE_STATS = tuple(f"{s}_{f}" for s in ("blue", "red") for f in ("recent_form", "side_win_rate", "roster_continuity")) + ("h2h_blue",)
PRE_FIELDS = ("value", "sample_count", "missing", "win_count")
PRE_COLUMNS = tuple(f"{f}_{x}" for f in PRE_STATS for x in PRE_FIELDS if not (f.endswith("continuity") and x == "win_count"))
POST_FIELDS = ("champion_id", "games_count", "wins_count", "win_rate", "missing")
POST_COLUMNS = tuple(f"{s.lower()}_{r.lower()}_{x}" for s in SIDES for r in ROLES for x in POST_FIELDS)


def slots_reason(reference: Column | None = None) -> Column:
    """Why the ten slots of a match can't be used: their number, ids, roles, repeats, a team or player unlike the rosters.

    ``reference``: an array of known champions (a catalogue of some hundreds).
    """
    slots = F.col("slots")
    ids = lambda f: slots[f]
    keys = lambda f: F.size(F.array_distinct(ids(f)))
    places = F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["side"], s["role"]))))
    bound = lambda s: F.transform(f"{s.lower()}_roster", lambda p: F.concat_ws("\x1f", F.col(f"{s.lower()}_team_id"), F.lit(s), p["role"], p["player_id"]))
    expected = F.concat(*map(bound, SIDES))
    found = F.transform(slots, lambda s: F.concat_ws("\x1f", s["team_id"], s["side"], s["role"], s["player_id"]))
    checks = [
        (slots.isNull() | (F.size(slots) != 10), LINEUP_INCOMPLETE),
        (F.exists(slots, lambda s: ~F.coalesce(s["side"].isin(*SIDES) & s["role"].isin(*ROLES), F.lit(False))), POST_LINEUP_INVALID),
        (F.exists(slots, lambda s: bad_id(s["team_id"], 64) | bad_id(s["player_id"], 64) | bad_id(s["champion_id"], 64)), ID_INVALID),
        (F.lit(False) if reference is None else F.exists(slots, lambda s: ~F.array_contains(reference, s["champion_id"])), CHAMPION_UNKNOWN),
        ((places != 10) | (keys("player_id") != 10) | (keys("champion_id") != 10), SOURCE_CONFLICT),
        (F.sort_array(found) != F.sort_array(expected), INCOMPATIBLE),
    ]
    # slots and rosters in the order of places are seen to be right without looking at each slot; the checks are for the others
    ordered = F.array(*map(F.lit, ROLES))
    right = (
        _in_order(slots) & _all_ids(F.concat(ids("team_id"), ids("player_id"), ids("champion_id"))) & (keys("player_id") == 10) & (keys("champion_id") == 10)
        & (ids("team_id") == F.array(*(F.col(f"{s.lower()}_team_id") for s, _ in PLACES))) & (ids("player_id") == F.concat(_players(F.col("blue_roster")), _players(F.col("red_roster"))))
        & (F.col("blue_roster")["role"] == ordered) & (F.col("red_roster")["role"] == ordered)
    )
    if reference is not None:
        right = right & (F.size(F.array_except(ids("champion_id"), reference)) == 0)
    return F.when(~F.coalesce(right, F.lit(False)), first_reason(*checks))


PLACES = tuple((s, r) for s in SIDES for r in ROLES)


def _in_order(slots: Column) -> Column:
    """There are ten slots, each in its place of ``PLACES``."""
    return F.coalesce(reduce(lambda a, b: a & b, ((F.get(slots, F.lit(i))["side"] == s) & (F.get(slots, F.lit(i))["role"] == r) for i, (s, r) in enumerate(PLACES)), F.size(slots) == 10), F.lit(False))


def _by_place(slots: Column) -> Column:
    """Ten structs of champion_id and player_id in the order of ``PLACES``, null where there is no such slot; of several the greatest."""
    pick = lambda s: F.struct(s["champion_id"].alias("champion_id"), s["player_id"].alias("player_id"))
    at = lambda side, role: lambda s: (s["side"] == side) & (s["role"] == role)
    found = F.array(*(F.array_max(F.transform(F.filter(slots, at(*k)), pick)) for k in PLACES))
    return F.when(_in_order(slots), F.array(*(pick(F.get(slots, F.lit(i))) for i in range(len(PLACES))))).otherwise(found)


SHIFT = 31  # bits of a number of games


def post_features(targets: DataFrame, history: DataFrame, early: DataFrame | None = None) -> DataFrame:
    """``targets`` (one row an id) with the 50 POST columns: each player's games and wins with their champion, for any team.

    ``early``: ids of targets whose own match in the history ended before their cutoff, if they are known.
    """
    played = history.select("ended_at", "winner_team_id", F.explode("slots").alias("s"))
    played = played.select("ended_at", "s.player_id", "s.champion_id", F.coalesce(F.col("s.team_id") == F.col("winner_team_id"), F.lit(False)).cast("byte").alias("won"))
    # a target's own match that ended before its cutoff is no history of it; such matches are few, so slots are looked up of those only
    if early is None:
        ends = history.where("ended_at IS NOT NULL").select("game_id", F.col("ended_at").alias("own_end"))
        early = settled(targets.select("game_id", "history_cutoff_at").join(ends, "game_id").where("own_end < history_cutoff_at").select("game_id"), "early-targets")
    picks, asked = _by_place(F.col("slots")), targets.select("game_id", "history_cutoff_at", "slots")
    found, own_games, own_wins = [], F.lit(0), F.lit(0)
    if not early.isEmpty():
        own = history.join(early, "game_id", "left_semi").select("game_id", F.col("ended_at").alias("own_end"), F.col("winner_team_id").alias("own_winner"), F.col("slots").alias("own_slots"))
        asked = asked.join(settled(own, "early-slots"), "game_id", "left")
        before, s = F.col("own_end") < F.col("history_cutoff_at"), F.col("s")
        mine = F.filter("own_slots", lambda o: F.col("before") & (o["player_id"] == s["player_id"]) & (o["champion_id"] == s["champion_id"]))
        size = lambda games: F.when(games.isNotNull(), F.size(games)).otherwise(0).cast("byte")
        asked = asked.withColumn("before", F.coalesce(before, F.lit(False)))
        found = [size(mine).alias("own_games"), size(F.filter(mine, lambda o: o["team_id"] == F.col("own_winner"))).alias("own_wins")]
        own_games, own_wins = F.col("own_games"), F.col("own_wins")
    asked = asked.select("*", F.posexplode(picks).alias("place", "s")).where("s IS NOT NULL")
    asked = asked.select("game_id", "history_cutoff_at", F.col("place").cast("byte").alias("place"), "s.player_id", "s.champion_id", *found)
    seen = sums_before(played, asked, ["player_id", "champion_id"], {"games": F.count("won"), "wins": F.sum("won")}, cutoff="history_cutoff_at")
    # ten rows a target meet again as one number each; champions are the target's own and need not come back
    games, wins = F.col("games") - own_games, F.coalesce("wins", F.lit(0)) - own_wins
    rows = seen.select("game_id", "place", (F.shiftleft(games, SHIFT) + wins).alias("found"))
    wide = rows.groupBy("game_id").agg(*(F.max(F.when(F.col("place") == i, F.col("found"))).alias(f"found_{i}") for i in range(len(PLACES))))
    out = targets.withColumn("picks__", picks["champion_id"]).join(wide, "game_id", "left")

    def fields(i: int) -> dict[str, Column]:
        games, wins = F.shiftright(f"found_{i}", SHIFT).cast("int"), F.col(f"found_{i}").bitwiseAND((1 << SHIFT) - 1).cast("int")
        return {"champion_id": F.get("picks__", F.lit(i)), "games_count": games, "wins_count": wins, "win_rate": F.when(games > 0, wins / games), "missing": games == 0}

    flat = [fields(i)[x].alias(f"{s.lower()}_{r.lower()}_{x}") for i, (s, r) in enumerate(PLACES) for x in POST_FIELDS]
    return out.select(*targets.columns, *flat)


def history_counts(targets: DataFrame, history: DataFrame) -> DataFrame:
    """(game_id, input_games, accepted_games, excluded_games, missing_end_games, digest) of each target's history.

    The digest sums a hash of the accepted ids, so that two selections are compared without their lists. Counts run
    over days: a window over the days (one row each), and one inside each day.
    """
    one = F.xxhash64("game_id").cast("decimal(38,0)")
    rows = history.where("ended_at IS NOT NULL").select(F.to_date("ended_at").alias("day"), F.col("ended_at").alias("at"), F.lit(1).alias("n"), one.alias("h"))
    days = rows.groupBy("day").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    asked = targets.select("game_id", F.col("history_cutoff_at").alias("at"), F.to_date("history_cutoff_at").alias("day"))
    both = rows.unionByName(asked, allowMissingColumns=True).withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))
    earlier = Window.partitionBy("day").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.select("*", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_in") for c in ("n", "h"))).where("n IS NULL").select("game_id", "at", "day", "n_in", "h_in")
    starts = days.unionByName(inside.select("day").distinct(), allowMissingColumns=True).groupBy("day").agg(F.max("n").alias("n"), F.max("h").alias("h"))
    starts = starts.select("day", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ahead") for c in ("n", "h")))
    placed = inside.join(starts, "day")
    own = history.select("game_id", F.col("ended_at").alias("own_end"), one.alias("own_h"), F.lit(1).alias("own"))
    placed = placed.join(own, "game_id", "left")
    mine = F.coalesce(F.col("own_end") < F.col("at"), F.lit(False))
    total = history.agg(F.count(F.lit(1)).alias("input_games"), F.count_if(F.col("ended_at").isNull()).alias("no_end"))  # one row
    accepted = F.col("n_ahead") + F.col("n_in") - mine.cast("int")
    return placed.crossJoin(F.broadcast(total)).select(
        "game_id", "input_games", accepted.cast("long").alias("accepted_games"), (F.col("input_games") - accepted).cast("long").alias("excluded_games"),
        (F.col("no_end") - (F.col("own").isNotNull() & F.col("own_end").isNull()).cast("int")).cast("long").alias("missing_end_games"),
        (F.col("h_ahead") + F.col("h_in") - F.when(mine, F.col("own_h")).otherwise(0)).cast("decimal(38,0)").alias("digest"),
    )


def resolve_cutoffs(targets: DataFrame, records: DataFrame, approved: list[str], protocol: str = STRICT) -> DataFrame:
    """(game_id, history_cutoff_at, reason) of each distinct target id: exactly one approved, verified record each.

    Records have game_id, history_cutoff_at, evidence_ref, policy_version, verification.
    """
    joined = targets.select("game_id").distinct().join(_record_reasons(records, approved, protocol), "game_id", "left")
    reason = _cutoff_reason()
    return joined.select("game_id", F.when(reason.isNull(), F.col("history_cutoff_at")).alias("history_cutoff_at"), reason.alias("reason"))


CUTOFF_CODES = (CUTOFF_MISSING, CUTOFF_CONFLICT, CUTOFF_EVIDENCE, CUTOFF_POLICY, CUTOFF_UNAPPROVED, CUTOFF_PROTOCOL, CUTOFF_STATUS, CUTOFF_UNVERIFIED)


def _record_reasons(records: DataFrame, approved: list[str], protocol: str) -> DataFrame:
    """(game_id, records__, history_cutoff_at, record__): number of records of an id, and of a single one the cutoff and what is wrong with it."""
    text = lambda c: F.col(c).isNull() | (F.col(c) == "") | (F.trim(c) != F.col(c))
    needed = "PROTOCOL_ASSUMED" if protocol == RETROSPECTIVE else "VERIFIED_EXTERNALLY"
    reason = first_reason(
        (F.col("history_cutoff_at").isNull(), CUTOFF_MISSING),
        (text("evidence_ref"), CUTOFF_EVIDENCE),
        (text("policy_version"), CUTOFF_POLICY),
        (~F.col("policy_version").isin(*approved), CUTOFF_UNAPPROVED),
        (F.lit(protocol == RETROSPECTIVE) != (F.col("policy_version") == RETROSPECTIVE), CUTOFF_PROTOCOL),
        (F.col("verification").isNull() | ~F.col("verification").isin(*STATUSES), CUTOFF_STATUS),
        (F.col("verification") != needed, CUTOFF_UNVERIFIED),
    )
    judged = records.select("game_id", "history_cutoff_at", _number(reason, CUTOFF_CODES).alias("record__"))
    return judged.groupBy("game_id").agg(F.count(F.lit(1)).alias("records__"), F.max("history_cutoff_at").alias("history_cutoff_at"), F.max("record__").alias("record__"))


def _cutoff_reason() -> Column:
    """Why a target has no cutoff, of ``_record_reasons`` joined to it."""
    return F.coalesce(first_reason((F.col("records__").isNull(), CUTOFF_MISSING), (F.col("records__") != 1, CUTOFF_CONFLICT)), _reason(F.col("record__"), CUTOFF_CODES))


COMPARED = ("ended_at", "blue_team_id", "red_team_id", "winner_team_id", "blue_roster", "red_roster", "slots")


def source_conflicts(history: DataFrame, targets: DataFrame) -> DataFrame:
    """(game_id, ended_at, columns) of history rows that differ from the target of the same id, or whose target is there twice."""
    sort = lambda c: F.sort_array(F.col(c)) if c in ("blue_roster", "red_roster", "slots") else F.col(c)
    shared = [c for c in COMPARED if c in history.columns and c in targets.columns]
    known = targets.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), *(F.max(sort(c)).alias(f"t_{c}") for c in shared))
    differs = F.array_compact(F.array(F.when(F.col("n") > 1, "game_id"), *(F.when(~sort(c).eqNullSafe(F.col(f"t_{c}")), c) for c in shared)))
    return history.join(known, "game_id").select("game_id", "ended_at", differs.alias("columns")).where(F.size("columns") > 0)


def _digested(rows: DataFrame, columns: list[str], *more: Column | str) -> DataFrame:
    """``more``, and two hashes of 64 bits of the values of ``columns``, lists in any order; equal of equal values."""
    lists = ("blue_roster", "red_roster", "slots")
    text = lambda c: F.sort_array(F.col(c)) if c in lists else F.unix_micros(F.col(c).cast("timestamp")) if c == "ended_at" else F.col(c)
    texts = rows.select(*more, F.explode(F.array(F.to_json(F.struct(*(text(c).alias(c) for c in columns))))).alias("text__"))  # exploded, so that it is made once for both
    return texts.select("*", F.xxhash64("text__").alias("digest_a__"), F.xxhash64(F.lit("b"), "text__").alias("digest_b__")).drop("text__")


def _number(reason: Column, codes: tuple[str, ...]) -> Column:
    """The place of a reason among ``codes``, from 1, null without a reason: short, and grouped by hash."""
    return F.nullif(F.array_position(F.array(*map(F.lit, codes)), reason), F.lit(0)).cast("byte")


def _reason(number: Column, codes: tuple[str, ...]) -> Column:
    return F.when(number.isNotNull(), F.element_at(F.array(*map(F.lit, codes)), number.cast("int")))


def judged_targets(targets: DataFrame, records: DataFrame, history: DataFrame, approved: list[str], champions: list[str] | None = None, protocol: str = STRICT) -> DataFrame:
    """(game_id, history_cutoff_at, reason, early) of each target id; no reason: it can be a pair.

    A target (a match with ``patch``, ``slots``, ``winner_team_id``, ``ended_at``) is left out as a pair for its first
    reason: copies of an id, the cutoff's, the label's, the lineup's, history that contradicts a target, the slots'.
    ``approved`` and ``champions`` are lists of a policy and a catalogue. Rosters and slots are judged where they lie and do not travel: targets,
    records and history are each dealt out by id once, as reasons and digests. ``early``: the match ended before the cutoff in the history.
    """
    known = F.array(*map(F.lit, champions)) if champions else None
    winner = first_reason((F.col("winner_team_id").isNull() | ~F.col("winner_team_id").isin(F.col("blue_team_id"), F.col("red_team_id")), TARGET_WINNER))
    lineup = F.coalesce(lineup_reason(), first_reason((F.col("patch").isNull() | (F.trim("patch") == "") | (F.length("patch") > 20), PATCH_INVALID)))
    own_codes = (TARGET_WINNER, ID_INVALID, TEAMS_INVALID, LINEUP_INVALID, PATCH_INVALID, LINEUP_INCOMPLETE, POST_LINEUP_INVALID, CHAMPION_UNKNOWN, SOURCE_CONFLICT, INCOMPATIBLE)
    judge = {"winner__": winner, "lineup__": lineup, "slots__": slots_reason(known)}
    shared = [c for c in COMPARED if c in history.columns and c in targets.columns]
    own = _digested(targets.where("game_id IS NOT NULL"), shared, "game_id", "ended_at", *(_number(r, own_codes).alias(c) for c, r in judge.items()))
    own = own.groupBy("game_id").agg(F.count(F.lit(1)).alias("copies__"), *(F.max(c).alias(c) for c in own.columns if c != "game_id"))
    rows = own.join(_record_reasons(records, approved, protocol), "game_id", "left")
    # a match without an end is no accepted history
    past = _digested(history.where("ended_at IS NOT NULL"), shared, "game_id", F.col("ended_at").alias("own_end")).withColumnsRenamed({"digest_a__": "past_a__", "digest_b__": "past_b__"})
    differs = (F.col("copies__") > 1) | (F.col("past_a__") != F.col("digest_a__")) | (F.col("past_b__") != F.col("digest_b__"))
    rows = rows.join(past, "game_id", "left").withColumn("clash__", F.when(differs, F.col("own_end")))
    cutoff = _cutoff_reason()
    rows = rows.select(
        "game_id", "copies__", F.when(cutoff.isNull(), F.col("history_cutoff_at")).alias("history_cutoff_at"), _number(cutoff, CUTOFF_CODES).alias("cutoff__"), "ended_at", *judge, "clash__", (F.col("own_end") < F.col("history_cutoff_at")).alias("early"),
    )
    once = [c for c in rows.columns if c not in ("game_id", "clash__", "early")]
    rows = rows.groupBy("game_id").agg(*(F.max(c).alias(c) for c in once), F.min("clash__").alias("clash__"), F.coalesce(F.max("early"), F.lit(False)).alias("early"))
    rows = settled(rows, "judged")  # read for the earliest contradictions, and once more
    clash = rows.where("clash__ IS NOT NULL").select("game_id", F.col("clash__").alias("ended_at"))
    first = clash.agg(F.min(F.struct("ended_at", "game_id")).alias("c__"))  # one row; of another id for the match itself
    second = clash.crossJoin(F.broadcast(first)).where("game_id <> c__.game_id").agg(F.min("ended_at").alias("d__"))
    rows = rows.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(second))
    earliest = F.when(F.col("c__.game_id") == F.col("game_id"), F.col("d__")).otherwise(F.col("c__.ended_at"))
    reason = F.coalesce(
        first_reason((F.col("copies__") > 1, TARGET_DUPLICATE)), _reason(F.col("cutoff__"), CUTOFF_CODES), _reason(F.col("winner__"), own_codes),
        first_reason((F.col("ended_at").isNull(), END_MISSING), (F.col("ended_at") <= F.col("history_cutoff_at"), END_EARLY)), _reason(F.col("lineup__"), own_codes),
        first_reason((earliest < F.col("history_cutoff_at"), SOURCE_CONFLICT)), _reason(F.col("slots__"), own_codes),
    )
    return rows.select("game_id", "history_cutoff_at", reason.alias("reason"), "early")


def exclusions(judged: DataFrame) -> DataFrame:
    """(game_id, reason) of the ``judged_targets`` that are left out."""
    return judged.where("reason IS NOT NULL").select("game_id", "reason").distinct()


def paired_dataset(
    targets: DataFrame, records: DataFrame, history: DataFrame, approved: list[str], champions: list[str] | None = None, protocol: str = STRICT, **windows: int
) -> tuple[DataFrame, DataFrame]:
    """(pairs, exclusions): rows with the label, 26 PRE and 50 POST columns; (game_id, reason) of targets left out (``judged_targets``)."""
    judged = judged_targets(targets, records, history, approved, champions, protocol)
    able = judged.where("reason IS NULL").select("game_id", "history_cutoff_at")  # of a repeated id none is good
    # of a good target slots and rosters agree and ids have no comma: whole lineups travel once, as two texts in the order of places
    picks = _by_place(F.col("slots"))
    text = lambda c: F.array_join(picks[c], ",")
    slim = targets.select("game_id", "blue_team_id", "red_team_id", text("player_id").alias("players"), text("champion_id").alias("champions"))
    good = settled(slim.join(able, "game_id"), "good-targets")
    at = lambda c, i: F.get(F.split(c, ","), F.lit(i))
    roster = lambda side: F.array(*(F.struct(F.lit(r).alias("role"), at("players", i).alias("player_id")) for i, (s, r) in enumerate(PLACES) if s == side))
    slots = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(r).alias("role"), at("players", i).alias("player_id"), at("champions", i).alias("champion_id")) for i, (s, r) in enumerate(PLACES)))
    lineups = good.select("game_id", "history_cutoff_at", "blue_team_id", "red_team_id", *(roster(s).alias(f"{s.lower()}_roster") for s in SIDES))
    pre = pre_features(lineups, history, **windows)
    early = settled(judged.where("reason IS NULL AND early").select("game_id"), "early-targets")  # a small table, broadcast
    post = post_features(good.select("game_id", "history_cutoff_at", slots.alias("slots")), history, early).select("game_id", *POST_COLUMNS)
    pairs = targets.join(pre.drop(*(c for c in lineups.columns if c not in ("game_id", "history_cutoff_at"))), "game_id").join(post, "game_id")
    pairs = pairs.withColumn("y_blue_win", (F.col("winner_team_id") == F.col("blue_team_id")).cast("byte"))
    return pairs.withColumnRenamed("ended_at", "target_ended_at"), exclusions(judged)


def table_issues(pairs: DataFrame) -> DataFrame:
    """(game_id, problem) of pairs that break the table's rules; must be empty."""
    missing = [c for c in ("game_id", "history_cutoff_at", "target_ended_at", "y_blue_win", *PRE_COLUMNS, *POST_COLUMNS) if c not in pairs.columns]
    if missing:
        raise ValueError(f"E_PAIRED_DATASET_INVALID: missing columns {missing}")
    stats = [f[: -len("_value")] for f in PRE_COLUMNS if f.endswith("_value")]
    champions = [c for c in POST_COLUMNS if c.endswith("champion_id")]
    checks = [
        ("label", ~F.coalesce(F.col("y_blue_win").isin(0, 1), F.lit(False))),
        ("label end", ~F.coalesce(F.col("target_ended_at") > F.col("history_cutoff_at"), F.lit(False))),
        ("missing flag", reduce(lambda a, b: a | b, (F.col(f"{s}_missing") != F.col(f"{s}_value").isNull() for s in stats))),
        ("rate", reduce(lambda a, b: a | b, (F.coalesce(~F.col(f"{s}_value").between(0, 1), F.lit(False)) for s in stats))),
        ("champions", F.size(F.array_distinct(F.array(*champions))) != 10),
    ]
    found = pairs.select("game_id", F.explode(F.array_compact(F.array(*(F.when(bad, name) for name, bad in checks)))).alias("problem"))
    # of ids alone, as rows are wide; each copy is one
    twice = pairs.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("game_id", F.explode(F.array_repeat(F.lit("repeated id"), F.col("n").cast("int"))).alias("problem"))
    return twice.union(found)


def same_history(pre: DataFrame, post: DataFrame) -> DataFrame:
    """(game_id, reason) of targets whose PRE and POST selections (``history_counts``) differ; must be empty."""
    both = pre.select("game_id", "accepted_games", "digest").join(post.select("game_id", F.col("accepted_games").alias("n2"), F.col("digest").alias("d2")), "game_id", "full")
    differs = ~(F.col("accepted_games").eqNullSafe(F.col("n2")) & F.col("digest").eqNullSafe(F.col("d2")))
    return both.where(differs).select("game_id", F.lit(HISTORY_MISMATCH).alias("reason"))
