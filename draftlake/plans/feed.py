"""A source feed of twelve rows a match from the driver's orders, with known faults, and the audit and conformance over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake import schemas as C
from draftlake.operators import conform as T
from draftlake.operators import identity as I
from draftlake.operators import quality as Q
from draftlake.plans.registry import query
from draftlake.session import settled

SQL = """
k AS (SELECT o_orderkey AS k, o_custkey % 40 AS b, (o_custkey % 40 + 1 + o_orderkey % 7) % 40 AS r, o_orderdate AS d FROM orders),
f AS (SELECT k, i, 'G' || k AS gameid, (CASE i WHEN 10 THEN 100 WHEN 11 THEN 200 ELSE i + 1 END)::VARCHAR AS participantid, CASE WHEN i < 5 OR i = 10 THEN 'Blue' ELSE 'Red' END AS side,
        CASE WHEN i >= 10 THEN 'team' WHEN k % 19 = 0 AND i = 2 THEN 'xyz' ELSE (['top', 'jng', 'mid', 'bot', 'sup'])[i % 5 + 1] END AS position,
        CASE WHEN i < 10 AND NOT (k % 23 = 0 AND i = 3) THEN 'p' || CASE WHEN i < 5 THEN b ELSE r END || '-' || i ELSE ' ' END AS playerid,
        CASE WHEN k % 13 = 0 AND (i < 5 OR i = 10) THEN '' ELSE 't' || CASE WHEN i < 5 OR i = 10 THEN b ELSE r END END AS teamid,
        'Team ' || CASE WHEN i < 5 OR i = 10 THEN b ELSE r END AS teamname,
        CASE WHEN i < 10 THEN 'Champ' || (k + i) % 30 END AS champion,
        CASE WHEN k % 31 = 0 AND i = 10 THEN '2' WHEN (k % 2 = 0) = (i < 5 OR i = 10) THEN '1' ELSE '0' END AS result,
        CASE WHEN k % 37 = 0 AND i = 4 THEN 'someday' ELSE strftime(d, '%Y-%m-%d %H:%M:%S') END AS date,
        CASE WHEN k % 41 = 0 AND i = 5 THEN '2024.5' WHEN k % 53 = 0 AND i = 6 THEN (year(d) + 1)::VARCHAR ELSE year(d)::VARCHAR END AS year,
        CASE WHEN k % 43 = 0 AND i = 1 THEN 'other' ELSE 'complete' END AS datacompleteness, 'L' || k % 5 AS league, d
      FROM k, (SELECT unnest(range(12)) AS i) WHERE NOT (k % 29 = 0 AND i = 11)
      UNION ALL BY NAME SELECT k, 0 AS i, 'G' || k AS gameid, '1' AS participantid, 'Blue' AS side, 'top' AS position, 'p' || b || '-0' AS playerid, CASE WHEN k % 13 = 0 THEN '' ELSE 't' || b END AS teamid, 'Team ' || b AS teamname,
        'Champ' || k % 30 AS champion, CASE WHEN k % 2 = 0 THEN '1' ELSE '0' END AS result, strftime(d, '%Y-%m-%d %H:%M:%S') AS date, year(d)::VARCHAR AS year, 'complete' AS datacompleteness, 'L' || k % 5 AS league, d FROM k WHERE k % 47 = 0),
c AS (SELECT *, CASE WHEN position IN ('top', 'jng', 'mid', 'bot', 'sup') THEN 'player' WHEN position = 'team' THEN 'team' WHEN participantid::INTEGER <= 10 THEN 'player' ELSE 'team' END AS kind FROM f)
"""


def feed(t) -> DataFrame:
    k, i = F.col("k"), F.col("i")
    rows = t("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 40).alias("b"), ((F.col("o_custkey") % 40 + 1 + F.col("o_orderkey") % 7) % 40).alias("r"), F.col("o_orderdate").alias("d"))
    places = F.when(k % 47 == 0, F.concat(F.sequence(F.lit(0), F.lit(11)), F.array(F.lit(0)))).otherwise(F.sequence(F.lit(0), F.lit(11)))
    rows = rows.withColumn("i", F.explode(places)).where(~((k % 29 == 0) & (i == 11)))
    blue = (i < 5) | (i == 10)
    team = F.when(blue, F.col("b")).otherwise(F.col("r")).cast("string")
    text = lambda c: F.lit(c)
    out = rows.select(
        F.concat(text("G"), k.cast("string")).alias("gameid"), F.when((k % 43 == 0) & (i == 1), "other").otherwise("complete").alias("datacompleteness"), text("").alias("url"), F.concat(text("L"), (k % 5).cast("string")).alias("league"),
        F.when((k % 41 == 0) & (i == 5), "2024.5").when((k % 53 == 0) & (i == 6), (F.year("d") + 1).cast("string")).otherwise(F.year("d").cast("string")).alias("year"), text("Spring").alias("split"), text("0").alias("playoffs"),
        F.when((k % 37 == 0) & (i == 4), "someday").otherwise(F.date_format("d", "yyyy-MM-dd HH:mm:ss")).alias("date"), text("1").alias("game"), text("15.01").alias("patch"),
        F.when(i == 10, "100").when(i == 11, "200").otherwise((i + 1).cast("string")).alias("participantid"), F.when(blue, "Blue").otherwise("Red").alias("side"),
        F.when(i >= 10, "team").when((k % 19 == 0) & (i == 2), "xyz").otherwise(F.element_at(F.array(*map(F.lit, C.POSITIONS)), (i % 5 + 1).cast("int"))).alias("position"),
        F.when(i < 10, F.concat(text("P"), team, text("-"), i.cast("string"))).alias("playername"), F.when((i < 10) & ~((k % 23 == 0) & (i == 3)), F.concat(text("p"), team, text("-"), i.cast("string"))).otherwise(" ").alias("playerid"),
        F.concat(text("Team "), team).alias("teamname"), F.when((k % 13 == 0) & blue, "").otherwise(F.concat(text("t"), team)).alias("teamid"), F.when(i < 10, F.concat(text("Champ"), ((k + i) % 30).cast("string"))).alias("champion"), text("1800").alias("gamelength"),
        F.when((k % 31 == 0) & (i == 10), "2").when((k % 2 == 0) == blue, "1").otherwise("0").alias("result"),
    )
    return out.withColumns({c: F.lit("x") for c in (*C.PICKS, *C.BANS)})  # not written: each rule makes the few columns that it reads


ISSUES = f"""{SQL},
g AS (SELECT gameid, count(*) AS n, count(*) FILTER (WHERE kind = 'player') AS p, count(*) FILTER (WHERE kind = 'team') AS t, count(*) FILTER (WHERE kind = 'team' AND result = '1') AS won, count(*) FILTER (WHERE kind = 'team' AND result = '0') AS lost,
             count(DISTINCT side) FILTER (WHERE kind = 'team') AS sides, count(DISTINCT CASE WHEN NOT contains(year, '.') THEN year END) AS years, count(DISTINCT datacompleteness) AS dc FROM c GROUP BY gameid),
s AS (SELECT gameid, side, count(DISTINCT CASE WHEN position NOT IN ('xyz') THEN position END) AS roles FROM c WHERE kind = 'player' GROUP BY gameid, side),
x AS (SELECT gameid, side, position FROM c WHERE kind = 'player' AND position <> 'xyz' GROUP BY ALL HAVING count(*) > 1),
w AS (SELECT gameid, side, max(CASE WHEN result IN ('0', '1') THEN result END) AS r FROM c WHERE kind = 'team' GROUP BY gameid, side HAVING count(*) = 1),
issues AS (
  SELECT gameid, 'DUPLICATE_GAME_PARTICIPANT' AS issue_code FROM c WHERE (gameid, participantid) IN (SELECT (gameid, participantid) FROM c GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT gameid, 'INVALID_GAME_ROW_COUNT' FROM g WHERE n <> 12 UNION ALL SELECT gameid, 'INVALID_PLAYER_ROW_COUNT' FROM g WHERE p <> 10 UNION ALL SELECT gameid, 'INVALID_TEAM_ROW_COUNT' FROM g WHERE t <> 2
  UNION ALL SELECT gameid, 'MISSING_PLAYER_ID' FROM c WHERE kind = 'player' AND trim(playerid) = '' UNION ALL SELECT gameid, 'MISSING_TEAM_ID' FROM c WHERE teamid = ''
  UNION ALL SELECT gameid, 'INVALID_POSITION' FROM c WHERE position = 'xyz' UNION ALL SELECT gameid, 'DUPLICATE_TEAM_ROLE' FROM c WHERE (gameid, side, position) IN (SELECT (gameid, side, position) FROM x) UNION ALL SELECT gameid, 'INCOMPLETE_TEAM_ROLES' FROM s WHERE roles < 5
  UNION ALL SELECT gameid, 'INVALID_TEAM_SIDE_STRUCTURE' FROM g WHERE t <> 2 OR sides <> 2 UNION ALL SELECT gameid, 'INVALID_RESULT_VALUE' FROM c WHERE result = '2' UNION ALL SELECT gameid, 'INVALID_RESULT_STRUCTURE' FROM g WHERE NOT (t = 2 AND won = 1 AND lost = 1)
  UNION ALL SELECT c.gameid, 'PLAYER_TEAM_RESULT_MISMATCH' FROM c JOIN w ON c.gameid = w.gameid AND c.side = w.side WHERE c.kind = 'player' AND c.result <> w.r
  UNION ALL SELECT gameid, 'INVALID_DATE' FROM c WHERE date = 'someday' UNION ALL SELECT gameid, 'INVALID_YEAR' FROM c WHERE contains(year, '.') UNION ALL SELECT gameid, 'YEAR_DATE_MISMATCH' FROM c WHERE date <> 'someday' AND NOT contains(year, '.') AND year <> year(d)::VARCHAR
  UNION ALL SELECT gameid, 'INCONSISTENT_GAME_YEAR' FROM g WHERE years > 1 UNION ALL SELECT gameid, 'UNKNOWN_DATA_COMPLETENESS' FROM c WHERE datacompleteness = 'other' UNION ALL SELECT gameid, 'INVALID_GAME_DATA_COMPLETENESS' FROM g WHERE dc > 1
  UNION ALL SELECT NULL, 'MISSING_EXPLICIT_GAME_END_TIME')
"""
LISTED = "(VALUES " + ", ".join(f"('{c}', '{g}', '{s}')" for c, (g, s) in C.ISSUES.items()) + ") AS v(issue_code, issue_group, severity)"


def _rule(name: str, rule, codes: tuple[str, ...]) -> None:
    listed = ", ".join(f"'{c}'" for c in codes)

    @query(name, f"WITH {ISSUES} SELECT gameid, issue_code, issue_group, severity, count(*) AS n FROM issues JOIN {LISTED} USING (issue_code) WHERE issue_code IN ({listed}) GROUP BY ALL")
    def issues(t) -> DataFrame:
        return rule(feed(t)).groupBy("gameid", "issue_code", "issue_group", "severity").agg(F.count(F.lit(1)).alias("n"))


_rule("q02_identifiers", Q.identifier_issues, ("MISSING_GAME_ID", "MISSING_PARTICIPANT_ID", "DUPLICATE_GAME_PARTICIPANT"))
_rule("q03_structure", Q.structure_issues, ("INVALID_GAME_ROW_COUNT", "INVALID_PLAYER_ROW_COUNT", "INVALID_TEAM_ROW_COUNT"))
_rule("q06_results", Q.result_issues, ("MISSING_RESULT", "INVALID_RESULT_VALUE", "INVALID_RESULT_STRUCTURE", "PLAYER_TEAM_RESULT_MISMATCH"))
_rule("q07_time", Q.time_issues, ("INVALID_DATE", "INVALID_YEAR", "YEAR_DATE_MISMATCH", "INCONSISTENT_GAME_YEAR"))
_rule("q08_completeness", Q.completeness_issues, ("UNKNOWN_DATA_COMPLETENESS", "INVALID_GAME_DATA_COMPLETENESS"))


@query("q04_players", f"WITH {ISSUES} SELECT gameid, issue_code, count(*) AS n FROM (SELECT * FROM issues WHERE issue_code IN ('MISSING_PLAYER_ID', 'INVALID_POSITION', 'DUPLICATE_TEAM_ROLE', 'INCOMPLETE_TEAM_ROLES') UNION ALL SELECT gameid, 'MISSING_TEAM_ID' FROM c WHERE kind = 'player' AND teamid = '') GROUP BY ALL")
def player_issues(t) -> DataFrame:
    return Q.player_issues(feed(t)).groupBy("gameid", "issue_code").agg(F.count(F.lit(1)).alias("n"))


@query("q05_teams", f"WITH {ISSUES} SELECT gameid, issue_code, count(*) AS n FROM (SELECT * FROM issues WHERE issue_code = 'INVALID_TEAM_SIDE_STRUCTURE' UNION ALL SELECT gameid, 'MISSING_TEAM_ID' FROM c WHERE kind = 'team' AND teamid = '') GROUP BY ALL")
def team_issues(t) -> DataFrame:
    return Q.team_issues(feed(t)).groupBy("gameid", "issue_code").agg(F.count(F.lit(1)).alias("n"))


@query("q10_audit", f"WITH {ISSUES} SELECT issue_code, issue_group, severity, count(*) AS n_issues, count(DISTINCT gameid) AS n_games FROM issues JOIN {LISTED} USING (issue_code) GROUP BY ALL")
def audit(t) -> DataFrame:
    return Q.summary(Q.audit(feed(t))[0])


@query("q09_benchmark", f"""WITH {SQL}, g AS (SELECT gameid, count(*) AS n, count(*) FILTER (WHERE kind = 'player') AS p, count(*) FILTER (WHERE kind = 'team') AS t, min(CASE WHEN NOT contains(year, '.') THEN year END) AS a, max(CASE WHEN NOT contains(year, '.') THEN year END) AS b,
        min(datacompleteness) AS c, max(datacompleteness) AS d FROM c GROUP BY gameid),
    v AS (SELECT 'total_rows' AS metric, count(*) AS value FROM c UNION ALL SELECT 'distinct_games', count(*) FROM g UNION ALL SELECT 'games_with_valid_structure', count(*) FROM g WHERE n = 12 AND p = 10 AND t = 2
      UNION ALL SELECT 'complete_games', count(*) FROM g WHERE c = 'complete' AND d = 'complete' UNION ALL SELECT 'partial_games', 0 UNION ALL SELECT 'player_rows_missing_playerid', count(*) FROM c WHERE kind = 'player' AND trim(playerid) = ''
      UNION ALL SELECT 'player_rows_missing_teamid', count(*) FROM c WHERE kind = 'player' AND teamid = '' UNION ALL SELECT 'player_rows_missing_patch', 0 UNION ALL SELECT 'player_rows_missing_champion', 0 UNION ALL SELECT 'games_missing_pick', 0 UNION ALL SELECT 'games_missing_ban', 0
      UNION ALL SELECT 'duplicate_game_participant_rows', coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM c GROUP BY gameid, participantid HAVING count(*) > 1)
      UNION ALL SELECT 'games_year_' || y, (SELECT count(*) FROM g WHERE a = b AND a = y) FROM (VALUES ('1995'), ('1996')) AS x(y)),
    e AS (SELECT 'total_rows' AS metric, count(*) * 12 AS expected FROM k UNION ALL SELECT 'distinct_games', count(*) FROM k UNION ALL SELECT 'missing_metric', 1)
    SELECT coalesce(v.metric, e.metric) AS metric, v.value::BIGINT AS value, CASE WHEN e.metric IS NULL THEN 'NOT_ASKED' WHEN v.value IS NULL THEN 'NOT_AVAILABLE' WHEN v.value = expected THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM v FULL JOIN e USING (metric)""")
def benchmark(t) -> DataFrame:
    """The feed's metrics, and how three of them compare with what is expected."""
    found = settled(Q.benchmark_metrics(feed(t), (1995, 1996)), "metrics")
    n = t("orders").agg(F.count(F.lit(1)).alias("n"))
    told = (("total_rows", F.col("n") * 12), ("distinct_games", F.col("n")), ("missing_metric", F.lit(1).cast("long")))
    expected = n.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in told))).alias("e")).select("e.*")
    judged = Q.benchmark(found, expected).select("metric", "status")
    return found.join(judged, "metric", "full").select("metric", "value", F.coalesce("status", F.lit("NOT_ASKED")).alias("status"))


@query("p03_classify", f"WITH {SQL} SELECT kind, count(*) AS n FROM c GROUP BY kind")
def classify(t) -> DataFrame:
    """By position first, by participant id only where the position says nothing."""
    return feed(t).groupBy(Q.row_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("p02_normalise", f"WITH {SQL} SELECT gameid, participantid::BIGINT AS participantid, nullif(trim(playerid), '') AS playerid, nullif(teamid, '') AS teamid, CASE WHEN NOT contains(year, '.') THEN year::BIGINT END AS year, CASE WHEN date <> 'someday' THEN d::DATE END AS day, count(*) AS n FROM f GROUP BY ALL")
def normalise(t) -> DataFrame:
    core = T.typed(feed(t))
    return core.groupBy("gameid", "participantid", "playerid", "teamid", "year", F.to_date("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("t01_metadata", f"""WITH {SQL}, m AS (SELECT gameid, count(DISTINCT y) AS ny, count(y) AS cy, count(DISTINCT dd) AS nd, count(dd) AS cd, count(*) AS n FROM (SELECT gameid, CASE WHEN NOT contains(year, '.') THEN year END AS y, CASE WHEN date <> 'someday' THEN date END AS dd FROM f) GROUP BY gameid)
    SELECT gameid, array_to_string(list_sort(list_filter([CASE WHEN ny > 1 THEN 'CONFLICTING_YEAR' WHEN cy < n THEN 'MIXED_MISSING_YEAR' END, CASE WHEN nd > 1 THEN 'CONFLICTING_DATE' WHEN cd < n THEN 'MIXED_MISSING_DATE' END], lambda x: x IS NOT NULL)), ',') AS codes FROM m""")
def metadata(t) -> DataFrame:
    return T.match_metadata(T.typed(feed(t))).select("gameid", F.array_join("codes", ",").alias("codes"))


CHAMPIONS = 28  # of 30 names in the feed
TEAMS = 30  # of 40 teams in the feed


@query("t08_preflight", f"""WITH {SQL}, v AS (SELECT *, position <> 'xyz' AS role_ok, trim(playerid) <> '' AS player_ok, (k + i) % 30 < {CHAMPIONS} AS champion_ok FROM c WHERE kind = 'player'),
    r AS (SELECT gameid, bool_or(NOT role_ok) AS a, bool_or(NOT player_ok) AS b, bool_or(NOT champion_ok) AS e, count(*) FILTER (WHERE ok) AS n, count(DISTINCT playerid) FILTER (WHERE ok) AS np, count(DISTINCT participantid) FILTER (WHERE ok) AS nq,
                 count(*) FILTER (WHERE ok AND side = 'Blue') AS nb, count(*) FILTER (WHERE ok AND side = 'Red') AS nr, count(DISTINCT position) FILTER (WHERE ok AND side = 'Blue') AS pb, count(DISTINCT position) FILTER (WHERE ok AND side = 'Red') AS pr
          FROM (SELECT *, role_ok AND player_ok AND champion_ok AS ok FROM v) GROUP BY gameid)
    SELECT gameid, array_to_string(list_sort(list_filter([CASE WHEN a THEN 'INVALID_ROLE' END, CASE WHEN b THEN 'PLAYER_ID_UNRESOLVED' END, CASE WHEN e THEN 'CHAMPION_UNMAPPED' END, CASE WHEN n <> 10 THEN 'GAME_REQUIRES_TEN_RESOLVED_PLAYERS' END,
        CASE WHEN np <> 10 THEN 'GAME_REQUIRES_TEN_UNIQUE_PLAYERS' END, CASE WHEN nq <> 10 THEN 'DUPLICATE_GAME_PARTICIPANT_ID' END, CASE WHEN nb <> 5 OR nr <> 5 OR pb <> 5 OR pr <> 5 THEN 'TEAM_ROLE_SET_INCOMPLETE' END], lambda x: x IS NOT NULL)), ',') AS codes FROM r""")
def preflight(t) -> DataFrame:
    rows = feed(t).where(Q.row_kind() == "player")
    known = F.regexp_extract("champion", r"(\d+)$", 1).cast("int") < CHAMPIONS
    players = rows.select("gameid", "side", "position", "participantid", "teamid", F.nullif(F.trim("playerid"), F.lit("")).alias("player_id"), F.when(known, F.col("champion")).alias("champion_id"))
    return T.lineup_codes(players).select("gameid", F.array_join("codes", ",").alias("codes"))


@query("t09_dependencies", f"""WITH {SQL}, v AS (SELECT gameid, side, result, CASE WHEN teamid = '' THEN 'TEAM_UNRESOLVED' WHEN result NOT IN ('0', '1') THEN 'INVALID_TEAM_RESULT' END AS code, teamid FROM c WHERE kind = 'team'),
    r AS (SELECT gameid, list(DISTINCT code) FILTER (WHERE code IS NOT NULL) AS codes, count(*) FILTER (WHERE code IS NULL) AS n, count(DISTINCT side) FILTER (WHERE code IS NULL) AS ns, count(DISTINCT teamid) FILTER (WHERE code IS NULL) AS nt, count(*) FILTER (WHERE code IS NULL AND result = '1') AS w FROM v GROUP BY gameid)
    SELECT gameid, array_to_string(list_sort(list_distinct(coalesce(codes, []) || list_filter([CASE WHEN n <> 2 OR ns <> 2 THEN 'GAME_REQUIRES_BLUE_AND_RED' END, CASE WHEN nt <> 2 THEN 'GAME_REQUIRES_TWO_TEAMS' END, CASE WHEN w <> 1 THEN 'GAME_REQUIRES_ONE_WINNER' END], lambda x: x IS NOT NULL))), ',') AS codes FROM r""")
def dependencies(t) -> DataFrame:
    teams = feed(t).where(Q.row_kind() == "team").select("gameid", "side", F.nullif("teamid", F.lit("")).alias("team_id"), F.col("result").cast("int").alias("result"))
    return T.dependency_codes(teams).select("gameid", F.array_join("codes", ",").alias("codes"))


@query("i07_champions", f"""WITH {SQL} SELECT champion, CASE WHEN n < {CHAMPIONS} THEN n::VARCHAR END AS champion_id, CASE WHEN n < {CHAMPIONS} THEN 'MAPPED' ELSE 'UNMAPPED' END AS status,
    CASE WHEN n < {CHAMPIONS} THEN 'UNIQUE_CANONICAL_OR_DISPLAY_NAME' ELSE 'NO_CHAMPION_MATCH' END AS reason FROM (SELECT DISTINCT champion, substr(champion, 6)::INTEGER AS n FROM f WHERE champion IS NOT NULL)""")
def champions(t) -> DataFrame:
    rows = feed(t).where("champion IS NOT NULL")
    known = t("orders").sparkSession.range(CHAMPIONS).select(F.col("id").cast("string").alias("champion_id"), F.concat(F.lit("champ"), F.col("id").cast("string")).alias("canonical_name"), F.concat(F.lit("CHAMP"), F.col("id").cast("string")).alias("display_name"))
    return I.map_champions(rows, known)


@query("i01_resolve_teams", f"""WITH {SQL},
    s AS (SELECT gameid, side, max(nullif(teamid, '')) AS id, lower(min(teamname)) AS name, lower(min(league)) AS league, min(year) AS year, min(d)::DATE AS day,
                 array_to_string(list_sort(list_filter([CASE WHEN count(DISTINCT date) > 1 THEN 'CONFLICTING_DATE_CONTEXT' END, CASE WHEN count(DISTINCT year) > 1 THEN 'CONFLICTING_YEAR_CONTEXT' END], lambda x: x IS NOT NULL)), ',') AS codes
          FROM f GROUP BY gameid, side),
    seen AS (SELECT name, league, year, day, list_sort(list(DISTINCT id)) AS ids FROM s WHERE id IS NOT NULL AND codes = '' GROUP BY ALL),
    x AS (SELECT s.*, CASE WHEN codes = '' THEN coalesce(ids, []) ELSE [] END AS found FROM s LEFT JOIN seen USING (name, league, year, day)),
    r AS (SELECT *, CASE WHEN id IS NOT NULL AND len(found) > 1 THEN 'SOURCE_ID_CONFLICT' WHEN id IS NOT NULL THEN 'SOURCE_ID_PRESENT' WHEN codes <> '' THEN codes
                         WHEN len(found) = 0 THEN 'NO_SOURCE_ID_CANDIDATE' WHEN len(found) = 1 THEN 'UNIQUE_FULL_CONTEXT' ELSE 'AMBIGUOUS_SOURCE_ID_CANDIDATES' END AS reason FROM x),
    e AS (SELECT *, CASE reason WHEN 'SOURCE_ID_PRESENT' THEN id WHEN 'UNIQUE_FULL_CONTEXT' THEN found[1] END AS team_id FROM r),
    known AS (SELECT source_id, count(DISTINCT target_id) AS n, min(target_id) AS target FROM (
        SELECT 't' || b AS source_id, 'T' || b AS target_id FROM k WHERE b < {TEAMS} UNION ALL SELECT 't' || b, 'U' || b FROM k WHERE b < {TEAMS} AND b % 10 = 3) GROUP BY source_id)
    SELECT gameid, side, CASE reason WHEN 'SOURCE_ID_PRESENT' THEN 'SOURCE_ID' WHEN 'UNIQUE_FULL_CONTEXT' THEN 'RECOVERED_UNIQUE' ELSE 'UNRESOLVED' END AS status, reason, team_id,
           array_to_string(CASE WHEN id IS NOT NULL AND len(found) <= 1 THEN [id] ELSE found END, ',') AS candidates,
           CASE WHEN team_id IS NULL THEN 'NOT_APPLICABLE' WHEN n IS NULL THEN 'NEW_TARGET_REQUIRED' WHEN n = 1 THEN 'EXISTING' ELSE 'TARGET_CONFLICT' END AS target_status, CASE WHEN n = 1 THEN target END AS target_id
    FROM e LEFT JOIN known ON team_id = source_id""")
def resolve_teams(t) -> DataFrame:
    """Each side's team by its id or its context, and the stored team of that id: of 40 teams some are stored, a few of them twice."""
    b = F.col("o_custkey") % 40
    stored = t("orders").where(b < TEAMS).select(b.alias("b")).distinct()
    twice = F.when(F.col("b") % 10 == 3, F.array(F.lit("T"), F.lit("U"))).otherwise(F.array(F.lit("T")))
    references = stored.select(F.concat(F.lit("t"), F.col("b").cast("string")).alias("source_id"), F.explode(twice).alias("kind"), "b").select("source_id", F.concat("kind", F.col("b").cast("string")).alias("target_id"))
    return I.target_status(I.resolve_teams(feed(t)), "team_id", references, "source_id", "target_id").withColumn("candidates", F.array_join("candidates", ","))
