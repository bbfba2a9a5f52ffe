"""Whole matches with rosters and drafts from the driver's orders, and the PRE, POST and dataset operators over them.

A match is an order: blue is the customer's key modulo 40, red the next but a few of the same 40 teams; a player is
team and role, with a substitute every third match; champions go round a pool of 60. It starts at the order date and ends
the order key modulo 5 days (and hours) later, or has no end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.operators import dataset as D
from draftlake.plans.registry import query
from draftlake.schemas import ROLES
from draftlake.session import settled

VERSION = "policy-1"

SQL = """
k AS (SELECT o_orderkey AS k, o_custkey % 40 AS b, (o_custkey % 40 + 1 + o_orderkey % 7) % 40 AS r, o_orderdate AS d FROM orders),
m AS (SELECT 'g' || k AS game_id, 't' || b AS blue, 't' || r AS red, CASE WHEN (k * 13) % 7 < 4 THEN 't' || b ELSE 't' || r END AS winner, k, b, r,
             CASE WHEN k % 11 <> 0 THEN d + to_days((k % 5)::INTEGER) + to_hours((k % 5)::INTEGER) END AS ended_at,
             date_trunc('day', d)::TIMESTAMP - INTERVAL 1 DAY AS cutoff FROM k),
s AS (SELECT game_id, ended_at, cutoff, 'BLUE' AS side, blue AS team, winner = blue AS won, b AS n, k FROM m UNION ALL SELECT game_id, ended_at, cutoff, 'RED', red, winner = red, r, k FROM m),
p AS (SELECT game_id, ended_at, cutoff, side, team, won, i, 'p' || n || '-' || i || CASE WHEN (k + i) % 3 = 0 THEN 's' ELSE '' END AS player,
             'c' || (k + 7 * i + CASE side WHEN 'RED' THEN 3 ELSE 0 END) % 60 AS champion FROM s, (SELECT unnest(range(5)) AS i))
"""


def matches(t) -> DataFrame:
    """History rows with slots, and what targets have on top (patch, history_cutoff_at)."""
    k = F.col("o_orderkey")
    team = lambda n: F.concat(F.lit("t"), n.cast("string"))
    blue, red = F.col("o_custkey") % 40, (F.col("o_custkey") % 40 + 1 + k % 7) % 40
    ended = F.col("o_orderdate") + F.make_interval(days=(k % 5).cast("int"), hours=(k % 5).cast("int"))
    player = lambda n, i: F.concat(F.lit("p"), n.cast("string"), F.lit(f"-{i}"), F.when((k + i) % 3 == 0, "s").otherwise(""))
    roster = lambda n: F.array(*(F.struct(F.lit(r).alias("role"), player(n, i).alias("player_id")) for i, r in enumerate(ROLES)))
    slot = lambda s, n, i, r: F.struct(
        team(n).alias("team_id"), F.lit(s).alias("side"), F.lit(r).alias("role"), player(n, i).alias("player_id"), F.concat(F.lit("c"), ((k + 7 * i + (3 if s == "RED" else 0)) % 60).cast("string")).alias("champion_id")
    )
    return t("orders").select(
        F.concat(F.lit("g"), k.cast("string")).alias("game_id"), team(blue).alias("blue_team_id"), team(red).alias("red_team_id"), roster(blue).alias("blue_roster"), roster(red).alias("red_roster"),
        F.when((k * 13) % 7 < 4, team(blue)).otherwise(team(red)).alias("winner_team_id"), F.when(k % 11 != 0, ended).alias("ended_at"),
        F.array(*(slot(s, n, i, r) for s, n in (("BLUE", blue), ("RED", red)) for i, r in enumerate(ROLES))).alias("slots"),
        F.lit("15.01").alias("patch"), (F.date_trunc("DAY", "o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("history_cutoff_at"),
    )


def _rates(name: str, on: str, n: int, history: str, target: str) -> str:
    """One rate of the last n matches before the cutoff, by target: a table ``name``."""
    return f"""{name}_r AS (SELECT x.game_id, h.won, row_number() OVER (PARTITION BY x.game_id ORDER BY h.ended_at DESC, h.game_id) AS rn
        FROM {target} x JOIN {history} h ON {on} AND h.ended_at < x.cutoff AND h.game_id <> x.game_id),
    {name} AS (SELECT game_id, count(*) AS n, count(*) FILTER (WHERE won) AS w FROM {name}_r WHERE rn <= {n} GROUP BY game_id)"""


def _fields(name: str, table: str) -> str:
    return f"round({table}.w / {table}.n, 9) AS {name}_value, coalesce({table}.n, 0)::INTEGER AS {name}_sample_count, {table}.n IS NULL AS {name}_missing, coalesce({table}.w, 0)::INTEGER AS {name}_win_count"


PRE_SQL = f"""WITH {SQL},
    sb AS (SELECT * FROM s WHERE side = 'BLUE'), sr AS (SELECT * FROM s WHERE side = 'RED'),
    {_rates("bf", "x.team = h.team", 10, "s", "sb")}, {_rates("rf", "x.team = h.team", 10, "s", "sr")},
    {_rates("bs", "x.team = h.team", 20, "sb", "sb")}, {_rates("rs", "x.team = h.team", 20, "sr", "sr")},
    hm AS (SELECT m.*, least(blue, red) AS a, greatest(blue, red) AS z FROM m),
    hr AS (SELECT x.game_id, h.winner = x.blue AS won, row_number() OVER (PARTITION BY x.game_id ORDER BY h.ended_at DESC, h.game_id) AS rn
           FROM hm x JOIN hm h ON x.a = h.a AND x.z = h.z AND h.ended_at < x.cutoff AND h.game_id <> x.game_id),
    hh AS (SELECT game_id, count(*) AS n, count(*) FILTER (WHERE won) AS w FROM hr WHERE rn <= 10 GROUP BY game_id),
    q AS (SELECT game_id, side, team, ended_at, cutoff, list(player) AS players FROM p GROUP BY ALL),
    lr AS (SELECT x.game_id, x.side, len(list_intersect(x.players, h.players)) / 5 AS v, row_number() OVER (PARTITION BY x.game_id, x.side ORDER BY h.ended_at DESC, h.game_id) AS rn
           FROM q x JOIN q h ON x.team = h.team AND h.ended_at < x.cutoff AND h.game_id <> x.game_id),
    l AS (SELECT game_id, max(v) FILTER (WHERE side = 'BLUE') AS b, max(v) FILTER (WHERE side = 'RED') AS r FROM lr WHERE rn = 1 GROUP BY game_id)
    SELECT m.game_id, {_fields("blue_recent_form", "bf")}, {_fields("red_recent_form", "rf")}, {_fields("blue_side_win_rate", "bs")}, {_fields("red_side_win_rate", "rs")}, {_fields("h2h_blue", "hh")},
           round(l.b, 9) AS blue_roster_continuity_value, (l.b IS NOT NULL)::INTEGER AS blue_roster_continuity_sample_count, l.b IS NULL AS blue_roster_continuity_missing,
           round(l.r, 9) AS red_roster_continuity_value, (l.r IS NOT NULL)::INTEGER AS red_roster_continuity_sample_count, l.r IS NULL AS red_roster_continuity_missing
    FROM m LEFT JOIN bf USING (game_id) LEFT JOIN rf USING (game_id) LEFT JOIN bs USING (game_id) LEFT JOIN rs USING (game_id) LEFT JOIN hh USING (game_id) LEFT JOIN l USING (game_id)"""


def _rounded(df: DataFrame, *columns: str) -> list:
    return [F.round(c, 9).alias(c) if c.endswith(("_value", "_rate")) else F.col(c) for c in columns]


@query("x04_pre_features", PRE_SQL)
def pre_features(t) -> DataFrame:
    m = matches(t)
    pre = D.pre_features(m.select("game_id", "blue_team_id", "red_team_id", "blue_roster", "red_roster", "history_cutoff_at"), m)
    return pre.select("game_id", *_rounded(pre, *D.PRE_COLUMNS))


POST_SQL = f"""WITH {SQL},
    e AS (SELECT x.game_id, x.side, x.i, any_value(x.champion) AS champion, count(h.game_id) AS n, count(h.game_id) FILTER (WHERE h.won) AS w
          FROM p x LEFT JOIN p h ON x.player = h.player AND x.champion = h.champion AND h.ended_at < x.cutoff AND h.game_id <> x.game_id GROUP BY ALL)
    SELECT game_id, {", ".join(
        f"max(CASE WHEN side = '{s}' AND i = {i} THEN {value} END){kind} AS {s.lower()}_{r.lower()}_{field}"
        for s in ("BLUE", "RED") for i, r in enumerate(ROLES)
        for field, value, kind in (("champion_id", "champion", ""), ("games_count", "n", "::INTEGER"), ("wins_count", "w", "::INTEGER"), ("win_rate", "round(w / nullif(n, 0), 9)", ""), ("missing", "(n = 0)", ""))
    )} FROM e GROUP BY game_id"""  # fmt: skip


@query("x06_post_features", POST_SQL)
def post_features(t) -> DataFrame:
    m = matches(t)
    post = D.post_features(m.select("game_id", "slots", "history_cutoff_at"), m)
    return post.select("game_id", *_rounded(post, *D.POST_COLUMNS))


@query("x01_history_counts", f"""WITH {SQL}, a AS (SELECT x.game_id, count(h.game_id) AS n FROM m x LEFT JOIN m h ON h.ended_at < x.cutoff AND h.game_id <> x.game_id GROUP BY x.game_id)
    SELECT game_id, (SELECT count(*) FROM m) AS input_games, n AS accepted_games, (SELECT count(*) FROM m) - n AS excluded_games,
           (SELECT count(*) FROM m WHERE ended_at IS NULL) - (m.ended_at IS NULL)::INTEGER AS missing_end_games FROM m JOIN a USING (game_id)""")
def history_counts(t) -> DataFrame:
    m = matches(t)
    return D.history_counts(m, m).drop("digest")


BROKEN = """CASE WHEN k % 23 = 0 THEN 'TEAMS' WHEN k % 23 = 1 THEN 'ROLES' WHEN k % 23 = 2 THEN 'PLAYERS' WHEN k % 23 = 3 THEN 'ID' END"""


@query("x05_lineups", f"""WITH {SQL} SELECT game_id, CASE k % 23 WHEN 0 THEN 'E_TEAMS_INVALID' WHEN 1 THEN 'E_LINEUP_INVALID' WHEN 2 THEN 'E_LINEUP_INVALID' WHEN 3 THEN 'E_ID_INVALID' END AS reason,
    CASE WHEN k % 23 IN (0, 1, 2, 3) THEN 'E_EVAL_INCOMPATIBLE' WHEN k % 29 = 0 THEN 'E_LINEUP_INCOMPLETE' WHEN k % 29 = 1 THEN 'E_SOURCE_CONFLICT' END AS slots_reason FROM m""")
def lineups(t) -> DataFrame:
    """Rosters and slots broken in known ways: one team twice, a role twice, a player twice, a padded id; nine slots, a champion twice."""
    m = matches(t).withColumn("k", F.expr("cast(substr(game_id, 2) as bigint)"))
    way = F.col("k") % 23
    swap = lambda **new: F.transform("blue_roster", lambda s, i: F.when(i == 4, F.struct(*(new.get(c, s[c]).alias(c) for c in ("role", "player_id")))).otherwise(s))
    first = F.col("blue_roster")[0]
    m = m.withColumn("red_team_id", F.when(way == 0, F.col("blue_team_id")).otherwise(F.col("red_team_id"))).withColumn(
        "blue_roster", F.when(way == 1, swap(role=first["role"])).when(way == 2, swap(player_id=first["player_id"])).when(way == 3, swap(player_id=F.lit(" x"))).otherwise(F.col("blue_roster"))
    )
    kind, slots = F.col("k") % 29, F.col("slots")
    twice = F.transform(slots, lambda s, i: F.when(i == 9, s.withField("champion_id", slots[0]["champion_id"])).otherwise(s))
    m = m.withColumn("slots", F.when(way < 4, slots).when(kind == 0, F.slice(slots, 1, 9)).when(kind == 1, twice).otherwise(slots))
    return m.select("game_id", D.lineup_reason().alias("reason"), D.slots_reason().alias("slots_reason"))


def records(m: DataFrame) -> DataFrame:
    """Cutoff records in which each of the reasons occurs."""
    k = F.expr("cast(substr(game_id, 2) as bigint)") % 31
    rows = m.select(
        "game_id", F.when(k != 2, F.col("history_cutoff_at")).alias("history_cutoff_at"), F.when(k == 3, " e").otherwise("evidence").alias("evidence_ref"), F.when(k == 4, "").when(k == 5, "other").otherwise(VERSION).alias("policy_version"),
        F.when(k == 6, "odd").when(k == 7, "PROTOCOL_ASSUMED").otherwise("VERIFIED_EXTERNALLY").alias("verification"), k.alias("k"),
    )
    return rows.where("k <> 0").union(rows.where("k = 1")).drop("k")


CUTOFF_CASE = """CASE k % 31 WHEN 0 THEN 'E_CUTOFF_MISSING' WHEN 1 THEN 'E_CUTOFF_CONFLICT' WHEN 2 THEN 'E_CUTOFF_MISSING' WHEN 3 THEN 'E_CUTOFF_EVIDENCE_INVALID' WHEN 4 THEN 'E_CUTOFF_POLICY_INVALID'
    WHEN 5 THEN 'E_CUTOFF_POLICY_UNAPPROVED' WHEN 6 THEN 'E_CUTOFF_STATUS_INVALID' WHEN 7 THEN 'E_CUTOFF_UNVERIFIED' END"""


@query("x08_cutoffs", f"WITH {SQL} SELECT game_id, {CUTOFF_CASE} AS reason, CASE WHEN k % 31 > 7 THEN cutoff END AS history_cutoff_at FROM m")
def cutoffs(t) -> DataFrame:
    m = matches(t)
    return D.resolve_cutoffs(m, records(m), [VERSION])


@query("x09_exclusions", f"""WITH {SQL} SELECT reason, count(*) AS n FROM (SELECT coalesce({CUTOFF_CASE}, CASE WHEN ended_at IS NULL THEN 'E_LABEL_END_MISSING' WHEN ended_at <= cutoff THEN 'E_LABEL_END_NOT_AFTER_CUTOFF' END) AS reason FROM m) WHERE reason IS NOT NULL GROUP BY reason""")
def exclusions(t) -> DataFrame:
    m = matches(t)
    return D.exclusions(D.judged_targets(m.drop("history_cutoff_at"), records(m), m, [VERSION])).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("x09_dataset", f"""WITH {SQL} SELECT count(*) AS n_pairs, sum((winner = blue)::INTEGER)::BIGINT AS wins, min(cutoff) AS first_cutoff, max(ended_at) AS last_end, 0::BIGINT AS n_issues FROM m
    WHERE {CUTOFF_CASE} IS NULL AND ended_at > cutoff""")
def dataset(t) -> DataFrame:
    m = matches(t)
    pairs = D.paired_dataset(m.drop("history_cutoff_at"), records(m), m, [VERSION])[0]
    pairs = settled(pairs.select("game_id", "history_cutoff_at", "target_ended_at", "y_blue_win", *D.PRE_COLUMNS, *D.POST_COLUMNS), "pairs")
    issues = D.table_issues(pairs).agg(F.count(F.lit(1)).alias("n_issues"))  # one row
    counted = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("y_blue_win").alias("wins"), F.min("history_cutoff_at").alias("first_cutoff"), F.max("target_ended_at").alias("last_end"))
    return counted.crossJoin(issues)


@query("x10_source_conflicts", f"""WITH {SQL} SELECT game_id, array_to_string(list_filter([CASE WHEN k % 17 = 0 THEN 'ended_at' END, CASE WHEN k % 13 = 0 THEN 'winner_team_id' END], lambda x: x IS NOT NULL), ',') AS conflicts
    FROM m WHERE (k % 17 = 0 OR k % 13 = 0) AND k % 11 <> 0""")
def source_conflicts(t) -> DataFrame:
    """Targets with another end or winner than the history's."""
    m = matches(t).where("ended_at IS NOT NULL").withColumn("k", F.expr("cast(substr(game_id, 2) as bigint)"))
    other = m.withColumn("ended_at", F.when(F.col("k") % 17 == 0, F.col("ended_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ended_at"))).withColumn(
        "winner_team_id", F.when(F.col("k") % 13 == 0, F.when(F.col("winner_team_id") == F.col("blue_team_id"), F.col("red_team_id")).otherwise(F.col("blue_team_id"))).otherwise(F.col("winner_team_id"))
    )
    return D.source_conflicts(m, other).select("game_id", F.array_join("columns", ",").alias("conflicts"))
