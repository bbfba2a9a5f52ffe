"""Scalar functions, data-quality rules, identity and conformance over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions import scalars as S
from draftlake.operators import quality as Q
from draftlake.operators import reconcile as R
from draftlake.plans.registry import query


@query("f04_stable_id", "SELECT page_id, url, regexp_full_match(split_part(url, '/', 4), '[A-Za-z0-9][A-Za-z0-9._:-]*') AS is_stable FROM pages")
def stable_id_check(t) -> DataFrame:
    return t("pages").select("page_id", "url", S.is_stable_id(F.split_part("url", F.lit("/"), F.lit(4))).alias("is_stable"))


@query("f08_stable_hash", "SELECT o_orderkey, substr('stage_' || sha256(concat_ws(chr(31), o_custkey::VARCHAR, o_orderpriority, '<NULL>')), 1, 64) AS stage_id FROM orders")
def stable_hash(t) -> DataFrame:
    return t("orders").select("o_orderkey", S.stable_id("stage_", F.col("o_custkey"), F.col("o_orderpriority"), F.lit(None)).alias("stage_id"))


@query("f10_series_key", "SELECT page_id, nullif(regexp_extract(g, '^(.+?)[_-]game[_-](\\d+)$', 1), '') AS series_key, try_cast(nullif(regexp_extract(g, '^(.+?)[_-]game[_-](\\d+)$', 2), '') AS BIGINT) AS game_number FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN split_part(url, '/', 3) ELSE split_part(url, '/', 3) || '_game_' || (page_id % 7) END AS g FROM pages)")
def series_key(t) -> DataFrame:
    host = F.split_part("url", F.lit("/"), F.lit(3))
    pages = t("pages").select("page_id", F.when(F.col("page_id") % 3 == 0, host).otherwise(F.concat(host, F.lit("_game_"), (F.col("page_id") % 7).cast("string"))).alias("g"))
    return pages.select("page_id", S.series_key(F.col("g")).alias("series_key"), S.series_number(F.col("g")).alias("game_number"))


@query("f11_url_params", "SELECT page_id, lower(split_part(url, '/', 3)) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def url_params(t) -> DataFrame:
    return t("pages").select("page_id", F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"), S.url_parameter(F.col("url"), "page").alias("page"), S.url_parameter(F.col("url"), "ref").alias("ref"))


@query("f12_best_of", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN NULL ELSE (CASE WHEN p_size % 2 = 0 THEN 3 ELSE 5 END) END::INTEGER AS best_of FROM part")
def best_of(t) -> DataFrame:
    r = F.col("p_size") % 4
    text = F.when(r == 0, "Bo3 then best of 5").when(r == 1, "no format").when(r == 2, "BO3 match").otherwise("Best-of-5 final")
    return t("part").select("p_partkey", S.best_of(text).alias("best_of"))


@query("f13_codes", "SELECT o_custkey, '[' || string_agg(DISTINCT '\"' || trim(split_part(o_orderpriority, '-', 2)) || '\"', ',' ORDER BY '\"' || trim(split_part(o_orderpriority, '-', 2)) || '\"') || ']' AS codes FROM orders GROUP BY o_custkey")
def codes(t) -> DataFrame:
    joined = t("orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), F.lit(" "))), ",").alias("text"))
    return joined.select("o_custkey", S.codes(F.col("text")).alias("codes"))


@query("f20_timestamps", "SELECT o_orderkey, o_orderdate AS parsed, o_orderdate::DATE AS day FROM orders")
def timestamps(t) -> DataFrame:
    """Written in three formats and parsed again."""
    r = F.col("o_orderkey") % 3
    text = F.when(r == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(r == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy HH:mm"))
    parsed = S.timestamp(text)
    return t("orders").select("o_orderkey", parsed.cast("timestamp_ntz").alias("parsed"), F.to_date(parsed).alias("day"))


@query("f22_cutoff", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY AS cutoff FROM events")
def cutoff(t) -> DataFrame:
    return t("events").select("event_id", S.cutoff(F.col("ts")).alias("cutoff"))


@query("f23_millis", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def millis(t) -> DataFrame:
    return t("events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query("f25_age_days", "SELECT l_orderkey, l_linenumber, l_partkey, floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000)::BIGINT AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def age_days(t) -> DataFrame:
    both = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", S.age_days(F.col("l_shipdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp")).alias("age"))


@query("f30_int_checks", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity % 2 = 0 THEN l_quantity::BIGINT END AS whole FROM lineitem")
def int_checks(t) -> DataFrame:
    text = F.when(F.col("l_quantity") % 2 == 0, F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(".0"))).otherwise(F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(".5")))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.whole_number(text).alias("whole"))


@query("f31_points", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_discount - l_tax) * 100, 6) AS points, abs(l_discount - l_tax) <= 1e-12 AS is_same FROM lineitem")
def points(t) -> DataFrame:
    a, b = F.col("l_discount"), F.col("l_tax")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.points(a - b), 6).alias("points"), S.is_close(a, b).alias("is_same"))


@query("f50_arrays", "SELECT vec_id, len(embedding)::INTEGER AS n, len(list_distinct(list_transform(embedding, lambda x: round(x, 1))))::INTEGER AS n_distinct, round(list_max(embedding)::DOUBLE, 6) AS greatest FROM embeddings")
def arrays(t) -> DataFrame:
    v = F.col("embedding")
    return t("embeddings").select("vec_id", F.size(v).alias("n"), F.size(F.array_distinct(F.transform(v, lambda x: F.round(x, 1)))).alias("n_distinct"), F.round(F.array_max(v).cast("double"), 6).alias("greatest"))


CHECKS = {
    "l_shipdate <= o_orderdate": ("SHIP_NOT_AFTER_ORDER", "time", "error"),
    "l_discount > 0.09": ("LARGE_DISCOUNT", "value", "warning"),
    "l_quantity > 49": ("LARGE_QUANTITY", "value", "warning"),
}


@query("q11_row_rules", "SELECT o_orderkey, l_linenumber, l_partkey, issue_code, issue_group, severity FROM (" + " UNION ALL ".join(f"SELECT o_orderkey, l_linenumber, l_partkey, '{c}' AS issue_code, '{g}' AS issue_group, '{s}' AS severity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {w}" for w, (c, g, s) in CHECKS.items()) + ")")
def row_rules(t) -> DataFrame:
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return Q.row_issues(rows, [Q.Rule(F.expr(w), *said) for w, said in CHECKS.items()], ["o_orderkey", "l_linenumber", "l_partkey"])


@query("a10_issue_counts", "SELECT issue_code, count(*) AS n_issues, count(DISTINCT o_orderkey) AS n_games FROM (" + " UNION ALL ".join(f"SELECT o_orderkey, '{c}' AS issue_code FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {w}" for w, (c, _, _) in CHECKS.items()) + ") GROUP BY issue_code")
def issue_counts(t) -> DataFrame:
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    issues = Q.row_issues(rows, [Q.Rule(F.expr(w), *said) for w, said in CHECKS.items()], ["o_orderkey"])
    return issues.groupBy("issue_code").agg(F.count(F.lit(1)).alias("n_issues"), F.countDistinct("o_orderkey").alias("n_games"))


@query("i01_resolve_direct", """WITH g AS (SELECT o_custkey AS k, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS n, min(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS v FROM orders GROUP BY o_custkey)
    SELECT k AS custkey, CASE WHEN n = 1 THEN 'SOURCE_ID' WHEN n = 0 THEN 'UNRESOLVED' ELSE 'SOURCE_ID_CONFLICT' END AS status, CASE WHEN n = 1 THEN v END AS resolved FROM g""")
def resolve_direct(t) -> DataFrame:
    from draftlake.operators.identity import direct

    ids = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return direct(t("orders").select(F.col("o_custkey").alias("custkey"), ids.alias("id")), ["custkey"], "id").select("custkey", "status", "resolved")


@query("i04_recover_context", """WITH r AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal::BIGINT % 3 END AS id FROM customer),
    e AS (SELECT c_nationkey, c_mktsegment, count(DISTINCT id) AS n, min(id) AS only_id FROM r WHERE id IS NOT NULL GROUP BY ALL)
    SELECT c_custkey, CASE WHEN n IS NULL THEN 'NO_SOURCE_ID_CANDIDATE' WHEN n = 1 THEN 'UNIQUE_FULL_CONTEXT' ELSE 'AMBIGUOUS_SOURCE_ID_CANDIDATES' END AS reason, CASE WHEN n = 1 THEN only_id END AS recovered
    FROM r LEFT JOIN e ON r.c_nationkey IS NOT DISTINCT FROM e.c_nationkey AND r.c_mktsegment IS NOT DISTINCT FROM e.c_mktsegment WHERE id IS NULL""")
def recover_context(t) -> DataFrame:
    from draftlake.operators.identity import recover

    rows = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, F.round("c_acctbal").cast("long") % 3).alias("id"))
    return recover(rows, ["c_nationkey", "c_mktsegment"], "id").select("c_custkey", "reason", "recovered")


@query("t05_context_ids", "SELECT DISTINCT o_orderpriority AS split, substr('stage_' || sha256(concat_ws(chr(31), year(o_orderdate)::VARCHAR, o_orderpriority)), 1, 64) AS stage_id FROM orders")
def context_ids(t) -> DataFrame:
    return t("orders").select(F.col("o_orderpriority").alias("split"), S.stable_id("stage_", F.year("o_orderdate"), F.col("o_orderpriority")).alias("stage_id")).distinct()


@query("t14_action_counts", """WITH old AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal FROM supplier WHERE s_suppkey % 6 <> 1),
    new AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS bal FROM supplier)
    SELECT CASE WHEN old.id IS NULL THEN 'INSERT' WHEN new.bal IS NOT DISTINCT FROM old.bal AND new.name IS NOT DISTINCT FROM old.name THEN 'SKIP' ELSE 'UPDATE' END AS action, count(*) AS n
    FROM new LEFT JOIN old USING (id) GROUP BY 1""")
def action_counts(t) -> DataFrame:
    supplier = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    new = supplier.withColumn("bal", F.when(F.col("id") % 4 == 0, F.col("bal") + 1).otherwise(F.col("bal")))
    return R.actions(new, supplier.where("id % 6 <> 1"), ["id"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
