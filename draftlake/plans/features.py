"""Point-in-time features, pairs, splits and evaluation over the match view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.operators import history as H
from draftlake.operators import split as P
from draftlake.operators.metrics import calibration, metrics
from draftlake.plans.matches import SQL as M
from draftlake.plans.matches import matches
from draftlake.plans.registry import query
from draftlake.session import settled

def states() -> dict:
    return {"games": F.count(F.lit(1)), "wins": F.sum("win")}



def _counts(df: DataFrame) -> DataFrame:
    return df.withColumns({"games": F.coalesce("games", F.lit(0).cast("long")), "wins": F.coalesce("wins", F.lit(0).cast("long"))})


def _rated(df: DataFrame, *columns: str) -> DataFrame:
    return _counts(df).select(
        *columns, F.round(H.rate(F.col("wins"), F.col("games")), 9).alias("value"), F.col("games").alias("sample_count"),
        (F.col("games") == 0).alias("missing"), F.col("wins").alias("win_count"),
    )


def _plan_a(keys: str, n: int | None, history: str, targets: str, columns: str) -> str:
    on = " AND ".join(f"x.{k} = h.{k}" for k in keys.split())
    limit = f"WHERE rn <= {n}" if n else ""
    return f"""
    WITH {M}, h AS ({history}), x AS ({targets}),
    c AS (SELECT x.tid, h.win, row_number() OVER (PARTITION BY x.tid ORDER BY h.ended_at DESC, h.game_id) AS rn
          FROM x JOIN h ON {on} AND h.ended_at < x.cutoff),
    a AS (SELECT tid, count(*) AS games, sum(win)::BIGINT AS wins FROM c {limit} GROUP BY tid)
    SELECT {columns}, round(wins / games, 9) AS value, coalesce(games, 0) AS sample_count,
           games IS NULL AS missing, coalesce(wins, 0)::BIGINT AS win_count
    FROM x LEFT JOIN a ON x.tid = a.tid"""


TEAM_HISTORY = "SELECT blue AS team, game_id, ended_at, win FROM m UNION ALL SELECT red + 1000000000, game_id, ended_at, 1 - win FROM m"


def team_history(m: DataFrame) -> DataFrame:
    """A row for each side of a match; suppliers' keys are moved beyond the customers'."""
    first = m.select(F.col("blue").alias("team"), "game_id", "ended_at", "win")
    return first.union(m.select(F.col("red") + 1_000_000_000, "game_id", "ended_at", 1 - F.col("win")))


@query("x02_recent_form", _plan_a("team", 10, TEAM_HISTORY, "SELECT *, blue AS team, game_id AS tid FROM m", "x.game_id, x.team"))
def recent_form(t) -> DataFrame:
    m = matches(t)
    targets = m.select("game_id", F.col("blue").alias("team"), "cutoff")
    return _rated(H.last_n_before(team_history(m), targets, ["team"], 10, states()), "game_id", "team")


@query("x02_side_rate", _plan_a("team", 20, "SELECT red AS team, game_id, ended_at, 1 - win AS win FROM m", "SELECT *, red AS team, game_id AS tid FROM m", "x.game_id, x.team"))
def side_rate(t) -> DataFrame:
    m = matches(t)
    own = m.select(F.col("red").alias("team"), "game_id", "ended_at", (1 - F.col("win")).alias("win"))
    return _rated(H.last_n_before(own, m.select("game_id", F.col("red").alias("team"), "cutoff"), ["team"], 20, states()), "game_id", "team")


@query("x03_h2h", _plan_a("a b", 10, "SELECT least(blue, red) AS a, greatest(blue, red) AS b, game_id, ended_at, win FROM m", "SELECT *, least(blue, red) AS a, greatest(blue, red) AS b, game_id AS tid FROM m", "x.game_id, x.blue, x.red"))
def head_to_head(t) -> DataFrame:
    m = matches(t).withColumns({"a": F.least("blue", "red"), "b": F.greatest("blue", "red")})
    targets = m.select("game_id", "blue", "red", "a", "b", "cutoff")
    return _rated(H.last_n_before(m.select("a", "b", "game_id", "ended_at", "win"), targets, ["a", "b"], 10, states()), "game_id", "blue", "red")


@query("x06_pair_experience", _plan_a("blue champion", None, "SELECT * FROM m", "SELECT *, game_id AS tid FROM m", "x.game_id, x.blue, x.champion"))
def pair_experience(t) -> DataFrame:
    m = matches(t)
    targets = m.select("game_id", "blue", "champion", "cutoff")
    return _rated(H.last_n_before(m.select("blue", "champion", "game_id", "ended_at", "win"), targets, ["blue", "champion"], None, states()), "game_id", "blue", "champion")


ROSTERS = """
  r AS (SELECT l_orderkey AS game_id, any_value(o_custkey) AS team, max(l_shipdate) AS ended_at, any_value(date_trunc('day', o_orderdate)::TIMESTAMP - INTERVAL 1 DAY) AS cutoff,
               list_sort(list_distinct(list(l_suppkey % 50))) AS roster FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)
"""


@query(
    "x02_continuity",
    f"""WITH {ROSTERS},
    c AS (SELECT x.game_id, h.roster, row_number() OVER (PARTITION BY x.game_id ORDER BY h.ended_at DESC, h.game_id) AS rn
          FROM r x JOIN r h ON x.team = h.team AND h.ended_at < x.cutoff)
    SELECT r.game_id, r.team, CASE WHEN c.roster IS NOT NULL THEN round(len(list_intersect(r.roster, c.roster)) / 5, 9) END AS value, c.roster IS NULL AS missing
    FROM r LEFT JOIN c ON r.game_id = c.game_id AND c.rn = 1""",
)
def roster_continuity(t) -> DataFrame:
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rosters = lines.groupBy(F.col("l_orderkey").alias("game_id")).agg(
        F.min("o_custkey").alias("team"), F.max("l_shipdate").alias("ended_at"), F.min(F.date_trunc("DAY", "o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("cutoff"),
        F.sort_array(F.collect_set(F.col("l_suppkey") % 50)).alias("roster"),
    )
    seen = H.last_n_before(rosters.select("team", "game_id", "ended_at", "roster"), rosters.select("game_id", "team", "roster", "cutoff"), ["team"], 1, {"previous": F.last("roster")})
    return seen.select("game_id", "team", F.round(H.continuity(F.col("roster"), F.col("previous")), 9).alias("value"), F.col("previous").isNull().alias("missing"))


@query(
    "p08_history_reasons",
    f"""WITH {M}, x AS (SELECT game_id AS target_id, blue AS team, cutoff FROM m)
    SELECT reason, count(*) AS n FROM (
      SELECT CASE WHEN m.game_id = x.target_id THEN 'TARGET_GAME' WHEN m.ended_at IS NULL THEN 'MISSING_ENDED_AT'
                  WHEN m.ended_at >= x.cutoff THEN 'END_NOT_BEFORE_CUTOFF' ELSE 'ACCEPTED' END AS reason
      FROM x JOIN m ON m.blue = x.team) GROUP BY reason""",
)
def history_reasons(t) -> DataFrame:
    m = matches(t)
    return H.reason_counts(m, m.select("game_id", "blue", "cutoff"), ["blue"])


X08 = """CASE WHEN ended_at IS NULL THEN 'E_LABEL_END_MISSING' WHEN ended_at <= cutoff THEN 'E_LABEL_END_NOT_AFTER_CUTOFF' END"""


@query(
    "x09_pairs",
    f"""WITH {M} SELECT game_id, {X08} AS excluded_reason, CASE WHEN {X08} IS NULL THEN win END AS y_blue_win FROM m""",
)
def pairs(t) -> DataFrame:
    m = P.with_exclusions(matches(t))
    return m.select("game_id", "excluded_reason", F.when(F.col("excluded_reason").isNull(), F.col("win")).alias("y_blue_win"))


SPLIT = f"""
  p AS (SELECT game_id, cutoff, ended_at, win FROM m WHERE ended_at > cutoff),
  g AS (SELECT cutoff, sum(count(*)) OVER (ORDER BY cutoff) - count(*) AS pos, sum(count(*)) OVER () AS n,
               row_number() OVER (ORDER BY cutoff) AS gi, count(*) OVER () AS gn FROM p GROUP BY cutoff),
  b1 AS (SELECT cutoff AS c1, pos AS p1 FROM g WHERE gi > 1 AND gi < gn ORDER BY abs(100 * pos - 70 * n), pos LIMIT 1),
  b2 AS (SELECT cutoff AS c2 FROM g, b1 WHERE pos > p1 ORDER BY abs(100 * pos - 85 * n), pos LIMIT 1),
  s AS (SELECT p.*, CASE WHEN cutoff < c1 THEN 'train' WHEN cutoff < c2 THEN 'validation' ELSE 'test' END AS partition,
               CASE WHEN cutoff < c1 THEN ended_at >= c1 WHEN cutoff < c2 THEN ended_at >= c2 ELSE false END AS purged
        FROM p, b1, b2)
"""


@query("x12_split", f"WITH {M}, {SPLIT} SELECT game_id, partition, purged FROM s")
def temporal_split(t) -> DataFrame:
    return P.temporal_split(P.with_exclusions(matches(t)).where("excluded_reason IS NULL")).select("game_id", "partition", "purged")


@query(
    "x12_purge",
    f"""WITH {M}, {SPLIT} SELECT partition, count(*) AS planned, count(*) FILTER (WHERE purged) AS purged,
        count(*) FILTER (WHERE NOT purged) AS kept, sum(win) FILTER (WHERE NOT purged)::BIGINT AS wins,
        min(cutoff) AS first_cutoff, max(cutoff) AS last_cutoff FROM s GROUP BY partition""",
)
def partition_summary(t) -> DataFrame:
    split = P.temporal_split(P.with_exclusions(matches(t)).where("excluded_reason IS NULL"))
    return P.summary(split, "win")


SCORED = f"""{M},
  d AS (SELECT win AS y, 1 / (1 + exp(-((champion % 97) / 24.0 - 2))) AS p FROM m)
"""


def _scored(t) -> DataFrame:
    return matches(t).select(F.col("win").alias("y"), (1 / (1 + F.exp(-((F.col("champion") % 97) / 24.0 - 2)))).alias("p"))


@query("m02_baseline", f"WITH {M}, {SPLIT} SELECT round(avg(win), 9) AS p, (SELECT count(*) FROM s WHERE partition = 'validation') AS n FROM s WHERE partition = 'train' AND NOT purged")
def baseline(t) -> DataFrame:
    """The prior of the training part, as the model family gives it to the validation part."""
    from draftlake.operators.models import fit

    split = settled(P.temporal_split(P.with_exclusions(matches(t)).where("excluded_reason IS NULL")), "split")
    fitted = fit("baseline", split.where("partition = 'train' AND NOT purged"), [], [], [], "win")
    return fitted.score(split.where("partition = 'validation'")).groupBy(F.round("p", 9).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "m06_brier_logloss_auc",
    f"""WITH {SCORED},
    r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM d),
    c AS (SELECT sum(y) AS pos, sum(1 - y) AS neg, sum(CASE WHEN y = 1 THEN rk END) AS rs FROM r)
    SELECT (SELECT count(*) FROM d) AS n, round((SELECT avg((p - y) * (p - y)) FROM d), 9) AS brier,
           round((SELECT -avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) FROM d), 9) AS log_loss,
           round((rs - pos * (pos + 1) / 2.0) / (pos * neg), 9) AS roc_auc FROM c""",
)
def quality_metrics(t) -> DataFrame:
    return metrics(_scored(t), "y", "p")


@query(
    "m06_calibration",
    f"""WITH {SCORED}, b AS (SELECT unnest(range(10)) AS bin),
    c AS (SELECT least(floor(p * 10)::BIGINT, 9) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM d GROUP BY 1)
    SELECT b.bin::INTEGER AS bin, coalesce(n, 0) AS n, mean_p, rate FROM b LEFT JOIN c ON b.bin = c.bin""",
)
def calibration_table(t) -> DataFrame:
    return calibration(_scored(t), "y", "p", 10)


@query(
    "e02_warnings",
    f"""WITH {M}, h AS ({TEAM_HISTORY}),
    c AS (SELECT x.game_id, count(h.game_id) AS games FROM m x LEFT JOIN h ON h.team = x.blue AND h.ended_at < x.cutoff GROUP BY x.game_id),
    p AS (SELECT x.game_id, count(h.game_id) AS met FROM m x LEFT JOIN m h ON h.blue = x.blue AND h.red = x.red AND h.ended_at < x.cutoff GROUP BY x.game_id),
    d AS (SELECT x.game_id, count(h.game_id) AS played FROM m x LEFT JOIN m h ON h.blue = x.blue AND h.champion = x.champion AND h.ended_at < x.cutoff GROUP BY x.game_id),
    w AS (SELECT game_id, unnest(list_filter([CASE WHEN games < 10 THEN 'W_TEAM_HISTORY_SMALL' END, CASE WHEN met = 0 THEN 'W_H2H_MISSING' END, CASE WHEN played = 0 THEN 'W_PAIR_HISTORY_MISSING' END], lambda x: x IS NOT NULL)) AS code
          FROM c JOIN p USING (game_id) JOIN d USING (game_id))
    SELECT game_id, code, (row_number() OVER (PARTITION BY game_id ORDER BY CASE code WHEN 'W_TEAM_HISTORY_SMALL' THEN 0 WHEN 'W_H2H_MISSING' THEN 1 ELSE 2 END) - 1)::INTEGER AS position FROM w""",
)
def warnings(t) -> DataFrame:
    from draftlake.operators.evaluate import warning_codes

    m = matches(t)
    tenth = H.nth_end(team_history(m), ["team"], 10, name="tenth").withColumnRenamed("team", "blue")
    first = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.min("ended_at").over(Window.partitionBy(a, b)))
    seen = m.select("game_id", "blue", "red", "champion", "ended_at", "cutoff").withColumn("met", first("blue", "red")).drop("red").withColumn("played", first("blue", "champion"))
    seen = seen.select("game_id", "blue", "cutoff", "met", "played").join(tenth, "blue", "left")
    before = lambda c: F.coalesce(F.col(c) < F.col("cutoff"), F.lit(False))
    codes = warning_codes(~before("tenth"), ~before("met"), ~before("played"))
    return seen.select("game_id", F.posexplode(codes).alias("position", "code"))


@query(
    "j11_asof_last",
    """SELECT a.event_id, a.user_id, b.event_id AS previous_id, b.value AS previous_value
       FROM (SELECT * FROM events WHERE event_type = 'purchase') a
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') b ON a.user_id = b.user_id AND a.ts > b.ts""",
)
def asof_last(t) -> DataFrame:
    events = t("events")
    targets = events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("cutoff"))
    past = events.where("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("past_id"), "value")
    seen = H.last_n_before(past, targets, ["user_id"], 1, {"previous_id": F.last("past_id"), "previous_value": F.last("value")}, ts="ts", id_col="past_id")
    return seen.select("event_id", "user_id", "previous_id", "previous_value")


@query(
    "j11_range_topn",
    f"""WITH {M} SELECT target_id, rn::INTEGER AS place, game_id FROM (
        SELECT x.game_id AS target_id, h.game_id, row_number() OVER (PARTITION BY x.game_id ORDER BY h.ended_at DESC, h.game_id) AS rn
        FROM m x JOIN m h ON x.blue = h.blue AND h.ended_at < x.cutoff) WHERE rn <= 3""",
)
def range_topn(t) -> DataFrame:
    m = matches(t)
    targets = m.select(F.col("game_id").alias("target_id"), "blue", "cutoff")
    seen = H.last_n_before(m.select("blue", "game_id", "ended_at"), targets, ["blue"], 3, {"ids": F.collect_list("game_id")})
    return seen.select("target_id", F.posexplode(F.reverse("ids")).alias("place", "game_id")).withColumn("place", F.col("place") + 1)


@query(
    "e05_idempotent_latest",
    """WITH s AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, ts, round(value, 0)::BIGINT AS v,
                  user_id || '-' || CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END || '-' || round(value, 0)::BIGINT AS k FROM events WHERE event_type <> 'purchase'),
       f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, event_id) = 1),
       p AS (SELECT * FROM f WHERE event_id % 3 <> 0)
       SELECT event_id, user_id, model, row_number() OVER (PARTITION BY user_id, model ORDER BY ts DESC, event_id DESC) = 1 AS is_active FROM p""",
)
def idempotent_latest(t) -> DataFrame:
    """Events as saved evaluations: those of two thirds are kept (the others are stored already), the latest of user and model is active."""
    from draftlake.operators import evaluate as E

    model = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    rows = t("events").where("event_type <> 'purchase'").select(
        F.col("event_id").alias("evaluation_id"), F.col("user_id").alias("subject_id"), model.alias("model_id"), F.lit("PRE").alias("phase"), F.lit(None).cast("long").alias("parent_id"),
        F.col("ts").alias("created_at"), F.concat_ws("-", F.col("user_id"), model, F.round("value", 0).cast("long")).alias("idempotency_key"),
    )
    rows = rows.withColumn("content_sha256", F.lpad(F.col("evaluation_id").cast("string"), 20, "0"))
    first = E.save(rows, rows.limit(0))[0]
    known = first.where("evaluation_id % 3 = 0")
    fresh = E.save(first, known)[0]
    return E.with_activity(fresh).select(F.col("evaluation_id").alias("event_id"), F.col("subject_id").alias("user_id"), F.col("model_id").alias("model"), "is_active")
