"""Data-quality rules of the source feed: each gives issue rows, at the grain of a row, a match or the file.

A feed has twelve rows a match: ten players (participant ids 1 to 10) and two teams (100, 200). Every
rule is a filter or a grouped aggregate over the feed; issues are (gameid, participantid, issue_code,
issue_group, severity). A rule whose columns are absent is skipped, not failed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake import schemas as C
from draftlake.functions import scalars as S
from draftlake.operators.groups import repeated
from draftlake.session import settled


@dataclass
class Rule:
    """Rows where ``broken`` holds are issues; group and severity of the audit's own codes are fixed (``schemas.ISSUES``)."""

    broken: Column
    code: str
    group: str | None = None
    severity: str | None = None

    def issue(self) -> Column:
        group, severity = C.ISSUES.get(self.code, (self.group, self.severity))
        return F.when(self.broken, F.struct(F.lit(self.code).alias("issue_code"), F.lit(group).alias("issue_group"), F.lit(severity).alias("severity")))


KEYS = ("gameid", "participantid")


def row_issues(rows: DataFrame, rules: Iterable[Rule], keys: Iterable[str] = KEYS) -> DataFrame:
    """An issue for each row and each rule that it breaks; one pass over the rows whatever the number of rules."""
    return rows.select(*keys, F.explode(F.array_compact(F.array(*(r.issue() for r in rules)))).alias("issue")).select(*keys, "issue.*")


def _match_issues(matches: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    return row_issues(matches.withColumn("participantid", F.lit(None).cast("string")), rules)


def missing_columns(feed: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in feed.columns]


def row_kind() -> Column:
    """player or team, by position; by participant id only where the position says nothing; else unknown."""
    position, number = F.col("position"), F.col("participantid").try_cast("int")
    known = F.lower(S.stripped(position))
    return (
        F.when(known.isin(*C.POSITIONS), "player").when(known == C.TEAM_POSITION, "team")
        .when(number.isin(*C.PLAYER_IDS), "player").when(number.isin(*C.TEAM_IDS), "team").otherwise("unknown")
    )


def identifier_rules() -> list[Rule]:
    return [Rule(S.is_missing(F.col("gameid")), "MISSING_GAME_ID"), Rule(S.is_missing(F.col("participantid")), "MISSING_PARTICIPANT_ID")]


def identifier_issues(feed: DataFrame) -> DataFrame:
    blank = row_issues(feed, identifier_rules())
    named = feed.where(~S.is_missing(F.col("gameid")) & ~S.is_missing(F.col("participantid")))
    twice = named.select(*KEYS).join(repeated(named, *KEYS), list(KEYS), "left_semi")
    return blank.unionByName(row_issues(twice, [Rule(F.lit(True), "DUPLICATE_GAME_PARTICIPANT")]))


def _games(feed: DataFrame) -> DataFrame:
    return feed.where(~S.is_missing(F.col("gameid"))).withColumn("kind__", row_kind())


def structure_rules() -> list[Rule]:
    return [Rule(F.col("n") != 12, "INVALID_GAME_ROW_COUNT"), Rule(F.col("players") != 10, "INVALID_PLAYER_ROW_COUNT"), Rule(F.col("teams") != 2, "INVALID_TEAM_ROW_COUNT")]


def structure_issues(feed: DataFrame) -> DataFrame:
    counts = _games(feed).groupBy("gameid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind__") == "player").alias("players"), F.count_if(F.col("kind__") == "team").alias("teams")
    )
    return _match_issues(counts, structure_rules())


PLAYER_FIELDS = {"playerid": "PLAYER_ID", "teamid": "TEAM_ID", "playername": "PLAYER_NAME", "teamname": "TEAM_NAME", "position": "POSITION", "side": "SIDE", "patch": "PATCH", "champion": "PLAYER_CHAMPION"}
TEAM_FIELDS = {"teamid": "TEAM_ID", "teamname": "TEAM_NAME", "side": "SIDE", "patch": "PATCH"}


def player_rules(feed: DataFrame) -> list[Rule]:
    rules = [Rule(S.is_missing(F.col(c)), f"MISSING_{n}") for c, n in PLAYER_FIELDS.items() if c in feed.columns]
    return [*rules, Rule(~S.is_missing(F.col("position")) & ~F.col("position").isin(*C.POSITIONS), "INVALID_POSITION")]


def player_issues(feed: DataFrame) -> DataFrame:
    players = _games(feed).where("kind__ = 'player'")
    rules = player_rules(feed)
    sides = players.where(~S.is_missing(F.col("side"))).groupBy("gameid", "side")
    roles = sides.agg(F.collect_set(F.when(F.col("position").isin(*C.POSITIONS), F.col("position"))).alias("roles"))
    of_sides = _match_issues(roles, [Rule(F.size("roles") < 5, "INCOMPLETE_TEAM_ROLES")])
    named = players.where(~S.is_missing(F.col("side")) & F.col("position").isin(*C.POSITIONS))
    twice = named.join(repeated(named, "gameid", "side", "position"), ["gameid", "side", "position"], "left_semi")
    return row_issues(players, rules).unionByName(of_sides).unionByName(row_issues(twice, [Rule(F.lit(True), "DUPLICATE_TEAM_ROLE")]))


def team_rules(feed: DataFrame) -> list[Rule]:
    rules = [Rule(S.is_missing(F.col(c)), f"MISSING_{n}") for c, n in TEAM_FIELDS.items() if c in feed.columns]
    for code, columns in (("MISSING_TEAM_PICK", C.PICKS), ("MISSING_TEAM_BAN", C.BANS)):
        if not missing_columns(feed, columns):
            rules.append(Rule(reduce(lambda a, b: a | b, (S.is_missing(F.col(c)) for c in columns)), code))
    return rules


def team_issues(feed: DataFrame) -> DataFrame:
    games = _games(feed)
    teams = games.where("kind__ = 'team'")
    rules = team_rules(feed)
    # matches without any team row count as well
    own = games.groupBy("gameid").agg(
        F.collect_set(F.when(F.col("kind__") == "team", F.col("side"))).alias("sides"), F.count_if(F.col("kind__") == "team").alias("n")
    )
    wrong = ~((F.col("n") == 2) & (F.array_sort("sides") == F.array(*map(F.lit, sorted(C.SIDES)))))
    return row_issues(teams, rules).unionByName(_match_issues(own, [Rule(wrong, "INVALID_TEAM_SIDE_STRUCTURE")]))


def known_result() -> Column:
    result = S.whole_number(F.col("result"))
    return F.when(result.isin(0, 1), result)


def result_rules() -> list[Rule]:
    return [Rule(S.is_missing(F.col("result")), "MISSING_RESULT"), Rule(~S.is_missing(F.col("result")) & F.col("result__").isNull(), "INVALID_RESULT_VALUE")]


def result_issues(feed: DataFrame) -> DataFrame:
    games = _games(feed).withColumn("result__", known_result())
    rules = result_rules()
    team = F.col("kind__") == "team"
    own = games.groupBy("gameid").agg(F.count_if(team).alias("n"), F.count_if(team & (F.col("result__") == 1)).alias("won"), F.count_if(team & (F.col("result__") == 0)).alias("lost"))
    whole = _match_issues(own, [Rule(~((F.col("n") == 2) & (F.col("won") == 1) & (F.col("lost") == 1)), "INVALID_RESULT_STRUCTURE")])
    sides = games.where(team).groupBy("gameid", "side").agg(F.count(F.lit(1)).alias("n"), F.max("result__").alias("of_team")).where("n = 1 AND of_team IS NOT NULL")
    players = games.where("kind__ = 'player' AND result__ IS NOT NULL").join(sides.drop("n"), ["gameid", "side"])
    mismatch = row_issues(players, [Rule(F.col("result__") != F.col("of_team"), "PLAYER_TEAM_RESULT_MISMATCH")])
    return row_issues(games, rules).unionByName(whole).unionByName(mismatch)


def time_rules() -> list[Rule]:
    return [
        Rule(S.is_missing(F.col("date")), "MISSING_DATE"),
        Rule(~S.is_missing(F.col("date")) & F.col("date__").isNull(), "INVALID_DATE"),
        Rule(S.is_missing(F.col("year")), "MISSING_YEAR"),
        Rule(~S.is_missing(F.col("year")) & F.col("year__").isNull(), "INVALID_YEAR"),
        Rule(F.coalesce(F.year("date__") != F.col("year__"), F.lit(False)), "YEAR_DATE_MISMATCH"),
    ]


def time_issues(feed: DataFrame) -> DataFrame:
    games = feed.withColumns({"date__": S.timestamp(F.col("date")), "year__": S.whole_number(F.col("year"))})
    rules = time_rules()
    years = games.where(~S.is_missing(F.col("gameid"))).groupBy("gameid").agg(F.countDistinct("year__").alias("n"))
    return row_issues(games, rules).unionByName(_match_issues(years, [Rule(F.col("n") > 1, "INCONSISTENT_GAME_YEAR")]))


END_COLUMNS = ("ended_at", "end_time", "game_end", "gameendtime")


def end_time_issues(feed: DataFrame) -> DataFrame:
    """One issue of the file if no column tells when a match ended (dates of the feed are starts)."""
    spark = feed.sparkSession
    found = {c.lower().replace(" ", "") for c in feed.columns} & set(END_COLUMNS)
    rows = [] if found else [(None, None, "MISSING_EXPLICIT_GAME_END_TIME", *C.ISSUES["MISSING_EXPLICIT_GAME_END_TIME"])]
    return spark.createDataFrame(rows, "gameid string, participantid string, issue_code string, issue_group string, severity string")


def completeness_rules() -> list[Rule]:
    value = F.col("datacompleteness")
    return [Rule(S.is_missing(value), "MISSING_DATA_COMPLETENESS"), Rule(~S.is_missing(value) & ~value.isin(*C.COMPLETENESS), "UNKNOWN_DATA_COMPLETENESS")]


def _mixed_completeness() -> Column:
    """Not all of the ``n`` rows counted hold one and the same known value."""
    return ~reduce(lambda a, b: a | b, (F.col(f"dc_{v}") == F.col("n") for v in C.COMPLETENESS))


def completeness_issues(feed: DataFrame) -> DataFrame:
    value = F.col("datacompleteness")
    rules = completeness_rules()
    own = feed.where(~S.is_missing(F.col("gameid"))).groupBy("gameid").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.coalesce(S.blank_to_null(value) == v, F.lit(False))).alias(f"dc_{v}") for v in C.COMPLETENESS))
    wrong = _mixed_completeness()
    return row_issues(feed, rules).unionByName(_match_issues(own, [Rule(wrong, "INVALID_GAME_DATA_COMPLETENESS")]))


RULES = {
    "identifiers": (identifier_issues, KEYS),
    "structure": (structure_issues, ("gameid", "position", "participantid")),
    "players": (player_issues, ("gameid", "position", "participantid", "side")),
    "teams": (team_issues, ("gameid", "position", "participantid", "side")),
    "results": (result_issues, ("gameid", "position", "participantid", "side", "result")),
    "time": (time_issues, ("gameid", "participantid", "date", "year")),
    "completeness": (completeness_issues, ("gameid", "participantid", "datacompleteness")),
}


def schema_issues(feed: DataFrame, required: Iterable[str] = (*C.CORE_COLUMNS[:-2], "result", *C.PICKS, *C.BANS)) -> DataFrame:
    spark = feed.sparkSession
    rows = [(None, None, "MISSING_REQUIRED_COLUMN", *C.ISSUES["MISSING_REQUIRED_COLUMN"], c) for c in missing_columns(feed, required)]
    return spark.createDataFrame(rows, "gameid string, participantid string, issue_code string, issue_group string, severity string, detail string")


def _sides(rows: DataFrame, live: set[str]) -> DataFrame:
    """One row for each match and side (as written): all counts that the rules of matches and sides ask for."""
    player, team = F.col("kind__") == "player", F.col("kind__") == "team"
    out = [F.count(F.lit(1)).alias("n"), F.count_if(player).alias("players"), F.count_if(team).alias("teams")]
    if "players" in live:
        out += [F.count_if(player & (F.col("position") == p)).alias(f"r_{p}") for p in C.POSITIONS]
    if "results" in live:
        out += [F.max(F.when(team, F.col("result__"))).alias("of_team")]
        out += [F.count_if(k & (F.col("result__") == v)).alias(f"{n}_{v}") for n, k in (("team", team), ("player", player)) for v in (0, 1)]
    if "time" in live:
        out += [F.min("year__").alias("year_a"), F.max("year__").alias("year_b")]
    if "completeness" in live:
        value = F.coalesce(S.blank_to_null(F.col("datacompleteness")), F.lit("<MISSING>"))
        out += [F.count_if(value == v).alias(f"dc_{v}") for v in C.COMPLETENESS]
    return rows.groupBy("gameid", "side").agg(*out)


def _ordered(rows: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """As ``row_issues``, with the place of each rule's group in ``rule_ord``."""
    found = F.array_compact(F.array(*(F.when(r.broken, F.struct(F.lit(i).alias("rule_ord"), r.issue().alias("issue"))) for i, r in rules)))
    return rows.select(*KEYS, F.explode(found).alias("f")).select(*KEYS, "f.issue.*", "f.rule_ord")


def audit(feed: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """Issues of all rules in order (``rule_ord``), and the rules that were skipped with the columns they miss.

    The feed is read four times, whatever the number of rules: for the rules of single rows; for one grouped count by match and side, from which all
    rules of sides and matches follow; for repeated participants; and for the players of the few sides that the counts show to hold a repeated role or a
    result unlike their team's.
    """
    skipped = {n: gone for n, (_, needs) in RULES.items() if (gone := missing_columns(feed, needs))}
    live, place = set(RULES) - set(skipped), {n: i for i, n in enumerate(RULES, 1)}
    parts = [schema_issues(feed).drop("detail").withColumn("rule_ord", F.lit(0))]
    rows = feed.withColumn("named__", ~S.is_missing(F.col("gameid")) if "gameid" in feed.columns else F.lit(False))
    grouped = "structure" in live and "side" in feed.columns
    if "structure" in live:
        rows = rows.withColumn("kind__", row_kind())
    if "results" in live:
        rows = rows.withColumn("result__", known_result())
    if "time" in live:
        rows = rows.withColumns({"date__": S.timestamp(F.col("date")), "year__": S.whole_number(F.col("year"))})

    of = lambda name, rules, where=None: [(place[name], Rule(r.broken if where is None else where & r.broken, r.code)) for r in rules] if name in live else []
    named, player, team = F.col("named__"), F.col("named__") & (F.col("kind__") == "player"), F.col("named__") & (F.col("kind__") == "team")
    single = of("identifiers", identifier_rules()) + of("time", time_rules()) + of("completeness", completeness_rules())
    single += (of("players", player_rules(feed), player) if "players" in live else []) + (of("teams", team_rules(feed), team) if "teams" in live else []) + (of("results", result_rules(), named) if "results" in live else [])
    if single:
        parts.append(_ordered(rows, single))
    if "identifiers" in live:
        whole = rows.where(named & ~S.is_missing(F.col("participantid")))
        twice = repeated(whole, *KEYS).select(*KEYS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        parts.append(_ordered(twice, [(place["identifiers"], Rule(F.lit(True), "DUPLICATE_GAME_PARTICIPANT"))]))
    if grouped:
        parts += _grouped_issues(rows.where(named), live, place)
    else:  # without sides or kinds: what is left of the rules, one by one
        rest = [n for n in ("structure", "time", "completeness") if n in live]
        matches = {"structure": ("INVALID_GAME_ROW_COUNT", "INVALID_PLAYER_ROW_COUNT", "INVALID_TEAM_ROW_COUNT"), "time": ("INCONSISTENT_GAME_YEAR",), "completeness": ("INVALID_GAME_DATA_COMPLETENESS",)}
        parts += [RULES[n][0](feed).where(F.col("issue_code").isin(*matches[n])).withColumn("rule_ord", F.lit(place[n])) for n in rest]
    if "time" in live:
        parts.append(end_time_issues(feed).withColumn("rule_ord", F.lit(place["time"])))
    return reduce(DataFrame.unionByName, parts), skipped


def _grouped_issues(rows: DataFrame, live: set[str], place: dict[str, int]) -> list[DataFrame]:
    """Issues of matches and sides, and of the players of the sides that the counts point at."""
    sides = settled(_sides(rows, live), "audit-sides")
    total = lambda c: F.sum(c).alias(c)
    columns = set(sides.columns)
    side_teams = lambda s: F.sum(F.when(F.col("side") == s, F.col("teams")).otherwise(0))
    sums = [total(c) for c in ("n", "players", "teams", "team_0", "team_1") if c in columns] + [side_teams(s).alias(f"teams_{s}") for s in C.SIDES]
    sums += [total(f"dc_{v}") for v in C.COMPLETENESS if f"dc_{v}" in columns]
    spans = [f(c).alias(c) for f, c in ((F.min, "year_a"), (F.max, "year_b")) if c in columns]
    matches = sides.groupBy("gameid").agg(*sums, *spans).withColumn("participantid", F.lit(None).cast("string"))
    rules = [(place["structure"], r) for r in structure_rules()]
    if "teams" in live:
        one_each = reduce(lambda a, b: a & b, (F.col(f"teams_{s}") == 1 for s in C.SIDES)) & (F.col("teams") == 2)
        rules.append((place["teams"], Rule(~one_each, "INVALID_TEAM_SIDE_STRUCTURE")))
    if "results" in live:
        rules.append((place["results"], Rule(~((F.col("teams") == 2) & (F.col("team_1") == 1) & (F.col("team_0") == 1)), "INVALID_RESULT_STRUCTURE")))
    if "time" in live:
        rules.append((place["time"], Rule(F.coalesce(F.col("year_a") != F.col("year_b"), F.lit(False)), "INCONSISTENT_GAME_YEAR")))
    if "completeness" in live:
        rules.append((place["completeness"], Rule(_mixed_completeness(), "INVALID_GAME_DATA_COMPLETENESS")))
    out = [_ordered(matches, rules)]

    pointed, found = F.lit(False), []
    own = sides.where(~S.is_missing(F.col("side")))
    if "players" in live:
        roles = reduce(lambda a, b: a + b, ((F.col(f"r_{p}") > 0).cast("int") for p in C.POSITIONS))
        few = own.where("players > 0").withColumn("participantid", F.lit(None).cast("string"))
        out.append(_ordered(few, [(place["players"], Rule(roles < len(C.POSITIONS), "INCOMPLETE_TEAM_ROLES"))]))
        twice = F.array_compact(F.array(*(F.when(F.col(f"r_{p}") > 1, p) for p in C.POSITIONS)))
        sides = sides.withColumn("twice__", F.when(S.is_missing(F.col("side")), F.array().cast("array<string>")).otherwise(twice))
        pointed = pointed | (F.size("twice__") > 0)
        found.append((place["players"], Rule(F.array_contains("twice__", F.col("position")), "DUPLICATE_TEAM_ROLE")))
    if "results" in live:
        sides = sides.withColumn("told__", F.when((F.col("teams") == 1) & (F.col("of_team") == 1), F.when(F.col("player_0") > 0, 1)).when((F.col("teams") == 1) & (F.col("of_team") == 0), F.when(F.col("player_1") > 0, 0)))
        pointed = pointed | F.col("told__").isNotNull()
        found.append((place["results"], Rule(F.coalesce(F.col("result__") != F.col("told__"), F.lit(False)), "PLAYER_TEAM_RESULT_MISMATCH")))
    if found:
        marks = [c for c in ("twice__", "told__") if c in sides.columns]
        suspects = settled(sides.where(pointed).select("gameid", "side", *marks), "audit-suspects")
        out.append(_ordered(rows.where("kind__ = 'player'").join(suspects, ["gameid", "side"]), found))
    return out


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_code", "issue_group", "severity").agg(F.count(F.lit(1)).alias("n_issues"), F.countDistinct("gameid").alias("n_games"))


def samples(issues: DataFrame, k: int = 5) -> DataFrame:
    """``summary`` with the first k match ids of each code (``sample``).

    Ids are made distinct once, for the counts and the samples alike; of a code, a task sends on no more than k ids to be ranked.
    """
    ids = issues.groupBy("issue_code", "issue_group", "severity", "gameid").agg(F.count(F.lit(1)).alias("n"))
    ids = settled(ids, "issue-ids")
    keys = ["issue_code", "issue_group", "severity"]
    counts = ids.groupBy(*keys).agg(F.sum("n").alias("n_issues"), F.count("gameid").alias("n_games"))
    first = Window.partitionBy(*keys).orderBy("gameid")
    few = ids.where("gameid IS NOT NULL").withColumn("at__", F.row_number().over(first)).where(F.col("at__") <= k)
    lists = few.groupBy(*keys).agg(F.sort_array(F.collect_list("gameid")).alias("sample"))
    return counts.join(lists, keys, "left").withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))


METRICS = (
    "total_rows", "distinct_games", "games_with_valid_structure", "complete_games", "partial_games", "player_rows_missing_playerid", "player_rows_missing_teamid", "player_rows_missing_patch",
    "player_rows_missing_champion", "games_missing_pick", "games_missing_ban", "duplicate_game_participant_rows",
)


def benchmark_metrics(feed: DataFrame, years: Iterable[int] = (2025, 2026)) -> DataFrame:
    """(metric, value) of METRICS and ``games_year_<year>``: what a benchmark is compared with. One grouped pass by match, and one for repeated participants."""
    named, kind = ~S.is_missing(F.col("gameid")), row_kind()
    rows = feed.select(
        "*", named.alias("named__"), (named & (kind == "player")).alias("player__"), (named & (kind == "team")).alias("team__"), S.whole_number(F.col("year")).alias("year__"),
        F.coalesce(S.blank_to_null(F.col("datacompleteness")), F.lit("<MISSING>")).alias("dc__"),
    )
    lacks = lambda columns: reduce(lambda a, b: a | b, (S.is_missing(F.col(c)) for c in columns))
    games = rows.groupBy(F.when(F.col("named__"), F.col("gameid")).alias("gameid")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("player__").alias("players"), F.count_if("team__").alias("teams"), F.min("year__").alias("a"), F.max("year__").alias("b"), F.min("dc__").alias("c"), F.max("dc__").alias("d"),
        *(F.count_if(F.col("player__") & S.is_missing(F.col(c))).alias(c) for c in ("playerid", "teamid", "patch", "champion")),
        F.count_if(F.col("team__") & lacks(C.PICKS)).alias("picks"), F.count_if(F.col("team__") & lacks(C.BANS)).alias("bans"),
    )
    game = F.col("gameid").isNotNull()
    one = lambda value: F.count_if(game & (F.col("c") == F.col("d")) & (F.col("c") == value))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    values = [
        total("n"), F.count("gameid"), F.count_if(game & (F.col("n") == 12) & (F.col("players") == 10) & (F.col("teams") == 2)), one("complete"), one("partial"),
        *(total(c) for c in ("playerid", "teamid", "patch", "champion")), F.count_if(F.col("picks") > 0), F.count_if(F.col("bans") > 0),
    ]
    names = [n for n in METRICS if n != "duplicate_game_participant_rows"]
    values += [F.count_if(game & (F.col("a") == F.col("b")) & (F.col("a") == y)) for y in years]
    names += [f"games_year_{y}" for y in years]
    found = games.agg(*(v.cast("long").alias(n) for n, v in zip(names, values, strict=True)))  # one row
    out = found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("m")).select("m.*")
    twice = repeated(feed.where(named & ~S.is_missing(F.col("participantid"))), *KEYS)
    return out.unionByName(twice.agg(F.lit("duplicate_game_participant_rows").alias("metric"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("value")))


def benchmark(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(metric, value) of both sides: MATCH, MISMATCH or NOT_AVAILABLE."""
    both = expected.select("metric", F.col("value").alias("expected")).join(observed.select("metric", F.col("value").alias("observed")), "metric", "left")
    status = F.when(F.col("observed").isNull(), "NOT_AVAILABLE").when(F.col("observed") == F.col("expected"), "MATCH").otherwise("MISMATCH")
    return both.withColumn("status", status)


