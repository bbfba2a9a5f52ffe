"""Snapshots, coverage and run checks over the whole matches of ``drafts``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.operators import dataset as D
from draftlake.operators import runs as R
from draftlake.operators import snapshot as N
from draftlake.operators import split as P
from draftlake.plans.drafts import SQL, matches
from draftlake.plans.registry import query
from draftlake.session import settled


def _k() -> F.Column:
    return F.expr("cast(substr(game_id, 2) as bigint)")


@query("x18_game_issues", f"""WITH {SQL} SELECT game_id, CASE WHEN k % 23 = 0 THEN 'E_DB_GAME_PARENT' WHEN k % 23 = 1 THEN 'E_DB_GAME_SIDES' WHEN k % 23 = 2 THEN 'E_DB_WINNER' WHEN (k % 23 = 3) <> (ended_at IS NULL) THEN 'E_DB_TIME_PAIR' WHEN k % 5 = 0 AND ended_at IS NOT NULL THEN 'E_DB_TIME_ORDER' END AS code
    FROM m WHERE k % 23 < 3 OR (k % 23 = 3) <> (ended_at IS NULL) OR (k % 5 = 0 AND ended_at IS NOT NULL)""")
def game_issues(t) -> DataFrame:
    """Games without a parent, with one side, with a strange winner, with one time, or with a start that is no earlier than the end."""
    m = settled(matches(t).withColumn("k", _k() % 23), "games")
    started = F.date_trunc("DAY", F.col("history_cutoff_at") + F.expr("INTERVAL 1 DAY"))
    start = t("orders").select(F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("game_id"), F.col("o_orderdate").alias("started_at"))
    games = m.join(start, "game_id").select(
        "game_id", F.lit(None).cast("string").alias("series_id"), F.when(F.col("k") != 0, F.lit("s")).alias("stage_id"), F.when(F.col("k") == 2, "nobody").otherwise(F.col("winner_team_id")).alias("winner_team_id"),
        F.when(F.col("k") != 3, F.coalesce("started_at", started)).alias("started_at"), "ended_at",
    )
    sides = m.select("game_id", "k", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s.lower()}_team_id").alias("team_id")) for s in D.SIDES))).alias("s")).where("NOT (k = 1 AND s.side = 'RED')")
    return N.game_issues(games, sides.select("game_id", "s.side", "s.team_id"))


@query("a29_coverage", f"""WITH {SQL}, c AS (SELECT x.game_id, count(h.game_id) AS game_count, max(h.ended_at) AS latest_ended_at FROM (SELECT * FROM s WHERE side = 'BLUE') x LEFT JOIN s h ON x.team = h.team AND h.ended_at < x.cutoff GROUP BY x.game_id)
    SELECT game_id, game_count, latest_ended_at, floor((epoch_us(cutoff) - epoch_us(latest_ended_at)) / 86400000000)::BIGINT AS age_days FROM c JOIN m USING (game_id)""")
def coverage(t) -> DataFrame:
    m = matches(t)
    games = D._sided(m, "ended_at")
    return N.team_coverage(m.select("game_id", F.col("blue_team_id").alias("team"), F.col("history_cutoff_at").alias("cutoff")), games).select("game_id", "game_count", "latest_ended_at", "age_days")


@query("x16_roster", f"""WITH {SQL}, c AS (SELECT x.game_id, h.game_id AS suggested_from, row_number() OVER (PARTITION BY x.game_id ORDER BY h.ended_at DESC, h.game_id) AS rn FROM (SELECT * FROM s WHERE side = 'RED') x JOIN s h ON x.team = h.team AND h.ended_at < x.cutoff)
    SELECT m.game_id, c.suggested_from FROM m LEFT JOIN c ON m.game_id = c.game_id AND c.rn = 1""")
def roster(t) -> DataFrame:
    m = matches(t)
    games = D._sided(m, "ended_at").withColumnRenamed("players", "roster")
    return N.roster_suggestion(m.select("game_id", F.col("red_team_id").alias("team"), F.col("history_cutoff_at").alias("cutoff")), games).select("game_id", "suggested_from")


@query("u04_unused_cutoffs", f"WITH {SQL} SELECT game_id FROM m WHERE k % 9 = 0")
def unused_cutoffs(t) -> DataFrame:
    m = matches(t)
    return N.unused(m.select("game_id"), m.where(_k() % 9 != 0))


@query("u09_same_rows", f"WITH {SQL} SELECT 'left' AS side, count(*) AS n FROM m WHERE k % 6 = 0 AND k % 10 <> 0 UNION ALL SELECT 'right', count(*) FROM m WHERE k % 10 = 0 AND k % 6 <> 0")
def same_rows(t) -> DataFrame:
    """Two copies of the matches: every sixth twice on the left, every tenth twice on the right."""
    teams = matches(t).select("game_id", "blue_team_id")
    twice = lambda n: teams.union(teams.where(_k() % n == 0))
    return N.same_rows(twice(6), twice(10))


@query("t21_time_coverage", f"""WITH {SQL} SELECT blue AS team, count(*) AS total, count(*) FILTER (WHERE game_id LIKE 'g1%') AS on_platform, count(*) FILTER (WHERE game_id LIKE 'g1%' AND ended_at IS NOT NULL) AS timed, round_even(count(*) FILTER (WHERE game_id LIKE 'g1%' AND ended_at IS NOT NULL) * 100.0 / count(*), 2) AS percent FROM m GROUP BY blue""")
def time_coverage(t) -> DataFrame:
    m = matches(t)
    times = m.select("game_id", F.when(F.col("ended_at").isNull(), "E_TIME_PAYLOAD_MISSING").alias("reason"))
    return N.time_coverage(m.select("game_id", F.col("blue_team_id").alias("team")), times, "team", "g1")


@query("o02_ordered_pairs", f"WITH {SQL} SELECT game_id, cutoff FROM m")
def ordered(t) -> DataFrame:
    return matches(t).select("game_id", F.col("history_cutoff_at").alias("cutoff")).orderBy("cutoff", "game_id")


@query("m11_split_check", f"""WITH {SQL} SELECT 'lost' AS problem, count(*) AS n FROM m WHERE ended_at > cutoff AND k % 50 = 0 HAVING count(*) > 0""")
def split_check(t) -> DataFrame:
    """A split without every fiftieth sample."""
    m = settled(matches(t).where("ended_at > history_cutoff_at").withColumn("y_blue_win", (F.col("winner_team_id") == F.col("blue_team_id")).cast("int")), "samples")
    split = P.temporal_split(m.where(_k() % 50 != 0), "history_cutoff_at")
    return R.split_issues(split.select("game_id", "partition", "purged", "y_blue_win"), m)


@query("e01_evaluations", f"""WITH {SQL}, c AS (SELECT game_id, sha256(concat_ws(chr(31), game_id, blue, red, '15.01', strftime(cutoff, '%Y-%m-%d %H:%M:%S'))) AS context_key, (k % 97)::INTEGER AS p FROM m),
    e AS (SELECT *, sha256(concat_ws(chr(31), context_key, 'm1', 'PRE', '<NULL>', p::VARCHAR)) AS h FROM c)
    SELECT game_id, context_key, 'pre-' || h[1:32] AS pre_id, CASE WHEN p % 2 = 0 THEN 'post-' || sha256(concat_ws(chr(31), context_key, 'm1', 'POST', 'pre-' || h[1:32], (p + 1)::VARCHAR))[1:32] END AS post_id FROM e""")
def evaluations(t) -> DataFrame:
    """PRE evaluations of all matches and POST of every second, by content keys."""
    from draftlake.operators import evaluate as E

    m = matches(t).withColumn("p", (_k() % 97).cast("int"))
    pre = settled(E.create(m, "m1", "PRE"), "pre-evaluations")
    post = E.create(m.where("p % 2 = 0").withColumn("p", F.col("p") + 1), "m1", "POST", pre)
    return pre.join(post.select("game_id", F.col("evaluation_id").alias("post_id")), "game_id", "left").select("game_id", "context_key", F.col("evaluation_id").alias("pre_id"), "post_id")


@query("s24_read_back", f"""WITH {SQL} SELECT 'e' || k AS evaluation_id, array_to_string(list_filter(['W_B', 'W_A'], lambda w: (w = 'W_B' AND k % 2 = 0) OR (w = 'W_A' AND k % 3 = 0)), ',') AS warnings, CASE WHEN k % 4 = 0 THEN 'p' || k ELSE '' END AS post_ids FROM m WHERE k % 7 = 0""")
def read_back(t) -> DataFrame:
    from draftlake.operators import evaluate as E

    k = matches(t).select(_k().alias("k"))
    name = lambda p: F.concat(F.lit(p), F.col("k").cast("string"))
    pre = k.select(name("e").alias("evaluation_id"), F.lit("PRE").alias("phase"), F.lit(None).cast("string").alias("parent_id"))
    saved = pre.union(k.where("k % 4 = 0").select(name("p"), F.lit("POST"), name("e")))
    warnings = k.where("k % 3 = 0").select(name("e").alias("evaluation_id"), F.lit(1).alias("position"), F.lit("W_A").alias("code")).union(k.where("k % 2 = 0").select(name("e"), F.lit(0), F.lit("W_B")))
    found = E.read_back(saved, warnings, k.where("k % 7 = 0").select(name("e").alias("evaluation_id")))
    return found.select("evaluation_id", F.array_join("warnings", ",").alias("warnings"), F.array_join("post_ids", ",").alias("post_ids"))


@query("s14_as_text", "SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, '') AS o_orderpriority FROM orders")
def as_text(t) -> DataFrame:
    from draftlake.sources.evidence import as_text as texts

    return texts(t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority")))


@query("f16_media_url", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '/api/media/teams/' || replace(p_name, ' ', '%20') || '.png' END AS url FROM part")
def media(t) -> DataFrame:
    from draftlake.functions.scalars import media_url

    r = F.col("p_partkey") % 4
    path = F.when(r == 0, F.concat(F.lit("assets/teams/"), "p_name", F.lit(".png"))).when(r == 1, F.concat(F.lit("assets/players/"), "p_name", F.lit(".png"))).when(r == 2, F.concat(F.lit("assets/teams/../"), "p_name", F.lit(".png"))).otherwise(F.concat(F.lit("assets/teams/"), "p_name", F.lit(".exe")))
    return t("part").select("p_partkey", media_url(path, "teams").alias("url"))
