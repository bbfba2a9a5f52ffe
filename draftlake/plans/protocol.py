"""Positions, digests, versions, provenance, imports and streamed state over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.operators import dataset as D
from draftlake.operators import merkle as M
from draftlake.operators import provenance as P
from draftlake.operators import quality as Q
from draftlake.operators.history import last_n_before
from draftlake.operators.ordering import numbered
from draftlake.plans import drafts, feed
from draftlake.plans.registry import query
from draftlake.session import settled, shared_dir
from draftlake.sources import versions as V
from draftlake.streaming import activity as A
from draftlake.streaming import imports as I


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/draftlake/{name}-{uuid.uuid4().hex}"


@query("w09_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey DESC) - 1 AS position FROM orders")
def positions(t) -> DataFrame:
    return numbered(t("orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").asc_nulls_last(), F.desc("o_orderkey")]).select("o_orderkey", "position")


@query("o07_target_order", f"WITH {drafts.SQL} SELECT game_id, row_number() OVER (ORDER BY cutoff, game_id) AS place FROM m")
def target_order(t) -> DataFrame:
    return numbered(drafts.matches(t).select("game_id", "history_cutoff_at"), ["history_cutoff_at", "game_id"], "place", first=1).select("game_id", "place")


def _piece(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '~')"


@query("f42_tree_root", f"""WITH r AS (SELECT sha256('4;' || {_piece("o_custkey")} || {_piece("o_orderkey")} || {_piece("o_orderpriority")} || {_piece("o_orderstatus")}) AS d, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders),
    l0 AS (SELECT n // 1024 AS b, sha256(string_agg(d, '' ORDER BY n)) AS d FROM r GROUP BY ALL), l1 AS (SELECT b // 64 AS b, sha256(string_agg(d, '' ORDER BY b)) AS d FROM l0 GROUP BY ALL),
    l2 AS (SELECT b // 64 AS b, sha256(string_agg(d, '' ORDER BY b)) AS d FROM l1 GROUP BY ALL), l3 AS (SELECT b // 64 AS b, sha256(string_agg(d, '' ORDER BY b)) AS d FROM l2 GROUP BY ALL)
    SELECT CASE WHEN (SELECT count(*) FROM l0) = 1 THEN (SELECT max(d) FROM l0) WHEN (SELECT count(*) FROM l1) = 1 THEN (SELECT max(d) FROM l1) WHEN (SELECT count(*) FROM l2) = 1 THEN (SELECT max(d) FROM l2) ELSE (SELECT max(d) FROM l3) END AS digest, (SELECT count(*) FROM orders) AS n""")
def tree_root(t) -> DataFrame:
    """The root of the orders' hash tree."""
    nodes = settled(M.tree(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"]), "tree")
    top = nodes.agg(F.max("level").alias("level"))  # one row
    return nodes.join(F.broadcast(top), "level").select("digest", "n")


@query("f42_first_difference", """WITH c AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderkey % 997 = 13), r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1024 AS block FROM orders)
    SELECT block, '{"o_orderkey":' || min(o_orderkey) || '}' AS low, '{"o_orderkey":' || max(o_orderkey) || '}' AS high FROM r WHERE block = (SELECT r2.block FROM r r2 JOIN c ON r2.o_orderkey = c.k) GROUP BY block""")
def difference(t) -> DataFrame:
    """The first block in which two histories differ that disagree on every 997th order's status."""
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = rows.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 997 == 13, F.concat("o_orderstatus", F.lit("?"))).otherwise(F.col("o_orderstatus")))
    a, b = (settled(M.tree(x, ["o_orderkey"]), "tree") for x in (rows, changed))
    found = M.first_difference(a, b)
    row = [(found["block"], *found["left"])] if found else []
    return rows.sparkSession.createDataFrame(row, "block long, low string, high string")


@query("s07_pinned_version", "SELECT 'old' AS version, c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT 'new', c_custkey, c_name || '*', c_nationkey FROM customer WHERE c_nationkey % 2 = 0")
def pinned(t) -> DataFrame:
    """Two versions of the customers, each read back by its number, projected."""
    rows = t("customer")
    spark, root = rows.sparkSession, _folder(rows, "versions")
    later = rows.where("c_nationkey % 2 = 0").withColumn("c_name", F.concat("c_name", F.lit("*")))
    for base, state in enumerate((rows, later)):
        V.commit(spark, root, base, {"customer": (state, ["c_custkey"])})
    read = lambda v: V.read_version(spark, root, v, {"customer": ["c_custkey", "c_name", "c_nationkey"]})["customer"]
    return read(1).withColumn("version", F.lit("old")).unionByName(read(2).withColumn("version", F.lit("new")))


@query("w01_stretches", f"""WITH {drafts.SQL}, h AS (SELECT x.game_id, x.side, p.won, p.game_id AS earlier, row_number() OVER (PARTITION BY x.game_id, x.side ORDER BY p.ended_at DESC, p.game_id) AS rn FROM s x JOIN s p ON x.team = p.team AND p.ended_at < x.cutoff)
    SELECT s.game_id, s.side, count(h.won) AS n, count(*) FILTER (WHERE h.won) AS wins, min(h.earlier) FILTER (WHERE rn = 1) AS latest FROM s LEFT JOIN h ON s.game_id = h.game_id AND s.side = h.side AND rn <= 10 GROUP BY ALL""")
def stretches(t) -> DataFrame:
    """Form of the last ten games, with the history of each team cut into stretches of about a hundred."""
    m = drafts.matches(t)
    won = (F.col("winner_team_id") == F.col("team")).cast("int")
    games = settled(D._sided(m, "ended_at", "winner_team_id").select("game_id", "ended_at", "team", won.alias("won")), "team-games")
    asked = D._sided(m, "history_cutoff_at").select("game_id", "side", "team", "history_cutoff_at")
    states = {"n": F.count(F.lit(1)), "wins": F.sum("won"), "latest": F.last("game_id")}
    seen = last_n_before(games, asked, ["team"], 10, states, cutoff="history_cutoff_at", bucket_rows=100)
    return seen.select("game_id", "side", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wins", F.lit(0)).alias("wins"), "latest")


@query("o05_samples", f"""WITH {feed.ISSUES}, i AS (SELECT DISTINCT issue_code, gameid FROM issues WHERE gameid IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY issue_code ORDER BY gameid) AS rn FROM i)
    SELECT issue_code, issue_group, severity, count(*) AS n_issues, count(DISTINCT gameid) AS n_games, coalesce(any_value(s.sample), '') AS sample FROM issues JOIN {feed.LISTED} USING (issue_code)
    LEFT JOIN (SELECT issue_code, string_agg(gameid, ',' ORDER BY gameid) AS sample FROM r WHERE rn <= 5 GROUP BY issue_code) s USING (issue_code) GROUP BY ALL""")
def issue_samples(t) -> DataFrame:
    return Q.samples(Q.audit(feed.feed(t))[0]).withColumn("sample", F.concat_ws(",", "sample"))


GRAPH = """n AS (SELECT 'prediction' AS kind, 'o' || o_orderkey AS id, 'd' || o_orderkey AS digest FROM orders UNION ALL SELECT 'dataset', 'c' || c_custkey, 'd' || c_custkey || CASE WHEN c_custkey % 50 = 7 THEN '!' ELSE '' END FROM customer WHERE c_custkey % 40 <> 3
      UNION ALL SELECT 'evidence', 'n' || n_nationkey, 'd' || n_nationkey FROM nation UNION ALL SELECT 'file', 'r' || r_regionkey, 'd' || r_regionkey || CASE WHEN r_regionkey = 2 THEN '!' ELSE '' END FROM region)"""


@query("j24_provenance", f"""WITH {GRAPH}, p AS (SELECT o_orderkey, o_custkey, c_nationkey, n_regionkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
    SELECT code, kind, role, count(*) AS n, count(DISTINCT leaf) AS leaves FROM (
      SELECT o_orderkey AS leaf, 'prediction' AS kind, 'dataset' AS role, 'E_PROVENANCE_MISSING' AS code FROM p WHERE o_custkey % 40 = 3 OR c_nationkey IS NULL
      UNION ALL SELECT o_orderkey, 'prediction', 'dataset', 'E_PROVENANCE_DIGEST' FROM p WHERE o_custkey % 50 = 7 AND o_custkey % 40 <> 3 AND c_nationkey IS NOT NULL
      UNION ALL SELECT o_orderkey, 'evidence', 'file', 'E_PROVENANCE_DIGEST' FROM p WHERE n_regionkey = 2 AND o_custkey % 40 <> 3) GROUP BY ALL""")
def provenance(t) -> DataFrame:
    """Orders as predictions, made from customers, nations and regions, of which some are gone or altered."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda df, kind, p, c, digest=None: df.select(F.lit(kind).alias("kind"), name(p, c).alias("id"), (name("d", c) if digest is None else digest).alias("digest"))
    marked = lambda c, bad: F.concat(name("d", c), F.when(bad, "!").otherwise(""))
    customers = t("customer").where("c_custkey % 40 <> 3")
    artifacts = node(t("orders"), "prediction", "o", "o_orderkey").union(node(customers, "dataset", "c", "c_custkey", marked("c_custkey", F.col("c_custkey") % 50 == 7)))
    artifacts = artifacts.union(node(t("nation"), "evidence", "n", "n_nationkey")).union(node(t("region"), "file", "r", "r_regionkey", marked("r_regionkey", F.col("r_regionkey") == 2)))
    link = lambda df, kind, p, c, role, q, d: df.select(F.lit(kind).alias("kind"), name(p, c).alias("id"), F.lit(role).alias("role"), F.lit(role).alias("to_kind"), name(q, d).alias("to_id"), name("d", d).alias("to_digest"))
    links = link(t("orders"), "prediction", "o", "o_orderkey", "dataset", "c", "o_custkey").union(link(customers, "dataset", "c", "c_custkey", "evidence", "n", "c_nationkey")).union(link(t("nation"), "evidence", "n", "n_nationkey", "file", "r", "n_regionkey"))
    needed = {"prediction": ("dataset",), "dataset": ("evidence",), "evidence": ("file",)}
    found = P.unsound(settled(artifacts, "artifacts"), settled(links, "links"), required=needed)
    return found.groupBy("code", "kind", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("leaf_id").alias("leaves"))


@query("e07_import", "SELECT 'k' || o_orderkey AS idempotency_key, o_totalprice / 1000000 AS p FROM orders")
def imported(t) -> DataFrame:
    """Orders imported as evaluations in four batches, of which two come again, one beside rows of the next."""
    rows = t("orders").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("idempotency_key"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_sha256"), F.col("o_orderdate").alias("created_at"), (F.col("o_totalprice") / 1_000_000).alias("p"), (F.col("o_orderkey") % 4).alias("part"))
    ledger = I.Ledger(rows.sparkSession, _folder(rows, "ledger"), "idempotency_key string, content_sha256 string, created_at timestamp, p double")
    for batch, parts in ((0, [0]), (1, [1]), (0, [0]), (2, [1, 2]), (3, [3]), (2, [1, 2])):
        ledger.import_batch(rows.where(F.col("part").isin(parts)).drop("part"), batch)
    return ledger.rows().select("idempotency_key", "p")


@query("e06_stream_activity", """WITH x AS (SELECT *, lpad(event_id::VARCHAR, 12, '0') AS eid, CASE WHEN event_type IN ('view', 'click') THEN 'b' ELSE 'a' END AS model FROM events),
    y AS (SELECT *, max(eid) FILTER (WHERE event_type = CASE WHEN model = 'a' THEN 'signup' ELSE 'view' END) OVER (PARTITION BY user_id, model ORDER BY event_id) AS parent, lag(eid) OVER u AS prev, lag(model) OVER u AS prev_model FROM x WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
    z AS (SELECT user_id, ts, eid, parent, CASE WHEN event_type = 'error' THEN 'INVALIDATE' WHEN event_type IN ('signup', 'view') THEN 'PRE' WHEN event_type = 'click' AND event_id % 50 = 0 THEN 'CONTEXT' ELSE 'POST' END AS kind, CASE WHEN event_type = 'error' THEN prev_model ELSE model END AS model, prev FROM y WHERE event_type <> 'error' OR prev IS NOT NULL),
    g AS (SELECT DISTINCT user_id, model, prev AS eid FROM z WHERE kind = 'INVALIDATE'), c AS (SELECT user_id, model, max(ts) AS since FROM z WHERE kind = 'CONTEXT' GROUP BY ALL),
    l AS (SELECT z.user_id, z.model, z.kind, z.eid, z.parent, g.eid IS NULL AND (since IS NULL OR z.ts >= since) AS holds, row_number() OVER (PARTITION BY z.user_id, z.model, z.kind ORDER BY z.ts DESC, z.eid DESC) AS rn
          FROM z LEFT JOIN g USING (user_id, model, eid) LEFT JOIN c USING (user_id, model) WHERE kind IN ('PRE', 'POST')),
    p AS (SELECT * FROM l WHERE rn = 1 AND holds AND kind = 'PRE')
    SELECT user_id::VARCHAR AS subject_id, model AS model_id, kind AS phase, eid AS evaluation_id FROM p
    UNION ALL SELECT l.user_id::VARCHAR, l.model, l.kind, l.eid FROM l JOIN p ON l.user_id = p.user_id AND l.model = p.model AND l.parent = p.eid WHERE l.rn = 1 AND l.holds AND l.kind = 'POST'""")
def stream_activity(t) -> DataFrame:
    """The events as evaluations of users, streamed in three parts: what is active after the last."""
    e = t("events").withColumn("eid", F.lpad(F.col("event_id").cast("string"), 12, "0")).withColumn("model", F.when(F.col("event_type").isin("view", "click"), "b").otherwise("a"))
    own, user = Window.partitionBy("user_id", "model").orderBy("event_id"), Window.partitionBy("user_id").orderBy("event_id")
    first = F.when(F.col("model") == "a", "signup").otherwise("view")
    e = e.withColumns({"parent": F.max(F.when(F.col("event_type") == first, F.col("eid"))).over(own), "prev": F.lag("eid").over(user), "prev_model": F.lag("model").over(user)})
    error = F.col("event_type") == "error"
    kind = F.when(error, "INVALIDATE").when(F.col("event_type").isin("signup", "view"), "PRE").when((F.col("event_type") == "click") & (F.col("event_id") % 50 == 0), "CONTEXT").otherwise("POST")
    rows = e.where(~error | F.col("prev").isNotNull()).select(
        kind.alias("kind"), F.col("user_id").cast("string").alias("subject_id"), F.when(error, F.col("prev_model")).otherwise(F.col("model")).alias("model_id"), F.when(error, F.col("prev")).otherwise(F.col("eid")).alias("evaluation_id"),
        F.when(kind == "POST", F.col("parent")).alias("parent_id"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 3).alias("part"),
    )
    spark, root = rows.sparkSession, _folder(rows, "activity")
    rows = settled(rows, "events")
    for part in range(3):  # a query of its own for each part: it goes on where the last one stopped
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{root}/events")
        A.start(spark, spark.readStream.schema(A.EVENT).parquet(f"{root}/events"), f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return A.active(spark.read.parquet(f"{root}/changes"))
