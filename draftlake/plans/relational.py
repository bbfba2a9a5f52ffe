"""Scans, projections, joins, aggregates, windows, sorts and set operations over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import scalars as S
from draftlake.operators import groups as G
from draftlake.operators import joins as J
from draftlake.plans.registry import query
from draftlake.session import dealt


@query("s04_scan_project", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity > 45")
def scan_project(t) -> DataFrame:
    return t("lineitem").where("l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


KEYS = {"customer": "c_custkey", "nation": "n_nationkey", "orders": "o_orderkey", "part": "p_partkey", "region": "r_regionkey", "supplier": "s_suppkey"}


@query("s06_snapshot", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, min({k})::BIGINT AS first_key, max({k})::BIGINT AS last_key, count(*) - count(DISTINCT {k}) AS n_repeated FROM {n}" for n, k in KEYS.items()))
def snapshot(t) -> DataFrame:
    parts = [
        t(n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.min(k).cast("long").alias("first_key"), F.max(k).cast("long").alias("last_key"), (F.count(F.lit(1)) - F.countDistinct(k)).alias("n_repeated"))
        for n, k in KEYS.items()
    ]
    return reduce(DataFrame.unionByName, parts).select("table_name", "n_rows", "first_key", "last_key", "n_repeated")


@query("p01_missing", "SELECT doc_id, text IS NULL OR regexp_full_match(text, '\\s*') AS text_missing, source IS NULL OR trim(source) = '' AS source_missing FROM documents")
def missing(t) -> DataFrame:
    return t("documents").select("doc_id", S.is_missing(F.col("text")).alias("text_missing"), S.is_missing(F.col("source")).alias("source_missing"))


@query("p07_missing_cells", """SELECT event_type, count(*) FILTER (WHERE props IS NULL OR trim(props) = '') AS props_missing, count(*) FILTER (WHERE value IS NULL) AS value_missing,
    count(*) FILTER (WHERE user_id IS NULL) AS user_missing, count(*) FILTER (WHERE props IS NULL OR trim(props) = '' OR value IS NULL OR user_id IS NULL) AS any_missing FROM events GROUP BY event_type""")
def missing_cells(t) -> DataFrame:
    cells = {"props": S.is_missing(F.col("props")), "value": F.col("value").isNull(), "user": F.col("user_id").isNull()}
    return t("events").groupBy("event_type").agg(*(F.count_if(c).alias(f"{n}_missing") for n, c in cells.items()), F.count_if(reduce(lambda a, b: a | b, cells.values())).alias("any_missing"))


@query("p13_label", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem")
def label(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query("p14_flatten", "SELECT l_orderkey, round(avg(l_discount), 9) AS discount_value, count(l_discount) AS discount_sample_count, count(l_discount) = 0 AS discount_missing, max(l_tax) AS tax_value FROM lineitem GROUP BY l_orderkey")
def flatten(t) -> DataFrame:
    stats = t("lineitem").groupBy("l_orderkey").agg(
        F.struct(F.round(F.avg("l_discount"), 9).alias("value"), F.count("l_discount").alias("sample_count"), (F.count("l_discount") == 0).alias("missing")).alias("discount"),
        F.struct(F.max("l_tax").alias("value")).alias("tax"),
    )
    return stats.select("l_orderkey", *(F.col(f"discount.{c}").alias(f"discount_{c}") for c in ("value", "sample_count", "missing")), F.col("tax.value").alias("tax_value"))


@query("j01_one_to_one", "SELECT o_orderkey, o_totalprice, n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def one_to_one(t) -> DataFrame:
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return t("orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left")


@query("j02_many_to_one", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def many_to_one(t) -> DataFrame:
    out = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("j04_multi_match", """SELECT p_partkey, CASE WHEN n IS NULL THEN 'NO_CANDIDATE' WHEN n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN only_id END AS target_id
    FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS only_id FROM lineitem WHERE l_quantity > 48 GROUP BY l_partkey) ON p_partkey = l_partkey""")
def multi_match(t) -> DataFrame:
    pairs = t("lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("id"))
    return J.resolve(t("part").select("p_partkey"), "p_partkey", pairs).select("p_partkey", "status", "n_candidates", "target_id")


@query("j05_name_union_key", """SELECT k AS name_key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS first_id FROM (
    SELECT lower(p_name) AS k, p_partkey FROM part UNION ALL SELECT lower(p_brand), p_partkey FROM part) GROUP BY k""")
def name_union_key(t) -> DataFrame:
    keys = t("part").select("p_partkey", F.explode(F.array(F.lower("p_name"), F.lower("p_brand"))).alias("name_key"))
    return keys.groupBy("name_key").agg(F.countDistinct("p_partkey").alias("n"), F.min("p_partkey").alias("first_id"))


NULLABLE = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS split FROM orders"


@query("j07_nullsafe", f"""WITH o AS ({NULLABLE}), k AS (SELECT split, count(*) AS n FROM o GROUP BY split)
    SELECT o_orderkey, n FROM o JOIN k ON o.split IS NOT DISTINCT FROM k.split""")
def nullsafe(t) -> DataFrame:
    orders = t("orders").withColumn("split", F.when(~F.col("o_orderpriority").like("1%"), F.col("o_orderpriority")))
    counts = orders.groupBy(F.col("split").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return orders.join(counts, F.col("split").eqNullSafe(F.col("key"))).select("o_orderkey", "n")


@query("j25_distinct_from", f"""WITH o AS ({NULLABLE}) SELECT a.o_orderkey, a.o_custkey FROM o a JOIN o b ON a.o_orderkey = b.o_orderkey + 1 WHERE a.split IS DISTINCT FROM b.split""")
def distinct_from(t) -> DataFrame:
    orders = t("orders").withColumn("split", F.when(~F.col("o_orderpriority").like("1%"), F.col("o_orderpriority")))
    before = orders.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("split").alias("before"))
    return orders.join(before, "o_orderkey").where(~F.col("split").eqNullSafe(F.col("before"))).select("o_orderkey", "o_custkey")


@query("j09_coalesce_parents", """SELECT s_suppkey, c_custkey, coalesce(r1.r_name, r2.r_name) AS region FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 0
    LEFT JOIN nation n1 ON c_nationkey = n1.n_nationkey LEFT JOIN region r1 ON n1.n_regionkey = r1.r_regionkey
    LEFT JOIN nation n2 ON s_nationkey = n2.n_nationkey LEFT JOIN region r2 ON n2.n_regionkey = r2.r_regionkey""")
def coalesce_parents(t) -> DataFrame:
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    first = places.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("first"))
    second = places.select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("second"))
    both = t("supplier").join(t("customer").where("c_acctbal > 0"), F.col("s_suppkey") == F.col("c_custkey"), "left")
    return both.join(first, "c_nationkey", "left").join(second, "s_nationkey", "left").select("s_suppkey", "c_custkey", F.coalesce("first", "second").alias("region"))


@query("j10_fk_antijoin", """SELECT 'lineitem' AS child, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def fk_antijoin(t) -> DataFrame:
    links = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"))
    return reduce(DataFrame.union, [J.orphans(t(child), key, t(parent), parent_key).agg(F.lit(child).alias("child"), F.count(F.lit(1)).alias("orphans")) for child, key, parent, parent_key in links])


@query("j20_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi(t) -> DataFrame:
    return t("customer").join(t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j20_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti(t) -> DataFrame:
    return t("customer").join(t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("j17_reconcile", """WITH old AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS logo FROM customer WHERE c_custkey % 7 <> 0),
    new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_name || '*' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS logo FROM customer)
    SELECT new.id, CASE WHEN old.id IS NULL THEN 'INSERT' WHEN new.name IS NOT DISTINCT FROM old.name AND (new.logo IS NULL OR new.logo IS NOT DISTINCT FROM old.logo) THEN 'SKIP' ELSE 'UPDATE' END AS action
    FROM new LEFT JOIN old ON new.id = old.id""")
def reconcile(t) -> DataFrame:
    from draftlake.operators.reconcile import actions

    old = t("customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("logo"))
    new = t("customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("logo"),
    )
    return actions(new, old, ["id"], preserved=["logo"]).select("id", "action")


@query("a01_structure", "SELECT l_orderkey, count(*) AS n_rows, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open, count(*) FILTER (WHERE l_linestatus = 'F') AS n_final, count(*) = 4 AS is_valid FROM lineitem GROUP BY l_orderkey")
def structure(t) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count_if(F.col("l_linestatus") == "F").alias("n_final"), (F.count(F.lit(1)) == 4).alias("is_valid"))


@query("a02_distribution", "SELECT n_rows, count(*) AS n_orders FROM (SELECT count(*) AS n_rows FROM lineitem GROUP BY l_orderkey) GROUP BY n_rows")
def distribution(t) -> DataFrame:
    return G.distribution(t("lineitem"), "l_orderkey", "n_rows", "n_orders")


@query("a05_missing_roles", "SELECT l_orderkey, list_sort(list_filter([1, 2, 3, 4, 5], lambda x: NOT list_contains(list(l_linenumber), x)))::INTEGER[]::VARCHAR AS missing_roles FROM lineitem GROUP BY l_orderkey")
def missing_roles(t) -> DataFrame:
    roles = F.array_except(F.array(*map(F.lit, range(1, 6))), F.collect_set("l_linenumber"))
    return t("lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.sort_array(roles).cast("array<string>"), ", "), F.lit("]")).alias("missing_roles"))


@query("a06_sides", "SELECT o_orderkey, coalesce(list_aggregate(list_sort(list_distinct(list(l_linestatus) FILTER (WHERE l_linestatus IS NOT NULL))), 'string_agg', ','), '') AS sides FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def sides(t) -> DataFrame:
    own = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("sides"))
    return t("orders").select("o_orderkey").join(own, "o_orderkey", "left").select("o_orderkey", F.coalesce("sides", F.lit("")).alias("sides"))


@query("a07_years", "SELECT n_years, count(*) AS n_customers FROM (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS n_years FROM orders GROUP BY o_custkey) GROUP BY n_years")
def years(t) -> DataFrame:
    return t("orders").groupBy("o_custkey").agg(F.countDistinct(F.year("o_orderdate")).alias("n_years")).groupBy("n_years").agg(F.count(F.lit(1)).alias("n_customers"))


@query("a08_completeness", """SELECT status, count(*) AS n FROM (SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'complete' WHEN bool_and(o_orderstatus = 'O') THEN 'partial' ELSE 'mixed' END AS status FROM orders GROUP BY o_custkey) GROUP BY status""")
def completeness(t) -> DataFrame:
    status = G.only_value(F.collect_set(F.coalesce("o_orderstatus", F.lit("<MISSING>"))))
    groups = t("orders").groupBy("o_custkey").agg(status.alias("only"))
    return groups.groupBy(F.when(F.col("only") == "F", "complete").when(F.col("only") == "O", "partial").otherwise("mixed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a09_minmax", "SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def minmax(t) -> DataFrame:
    return t("events").groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("a12_collapse", """SELECT l_orderkey, CASE WHEN count(DISTINCT v) > 1 THEN 'CONFLICT' WHEN count(v) = 0 THEN 'MISSING' WHEN count(v) < count(*) THEN 'MIXED' ELSE 'SINGLE' END AS state,
    CASE WHEN count(DISTINCT v) = 1 AND count(v) = count(*) THEN min(v) END AS value FROM (SELECT l_orderkey, nullif(l_returnflag, 'N') AS v FROM lineitem) GROUP BY l_orderkey""")
def collapse(t) -> DataFrame:
    lines = t("lineitem").select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("v"))
    return lines.groupBy("l_orderkey").agg(G.collapse_state(F.col("v")).alias("state"), G.collapse_value(F.col("v")).alias("value"))


@query("a14_names", "SELECT source, count(DISTINCT lang) AS n_langs, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def names(t) -> DataFrame:
    return t("documents").groupBy("source").agg(F.countDistinct("lang").alias("n_langs"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@query("a15_pair", "SELECT l_orderkey, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 2")
def pair(t) -> DataFrame:
    ids = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("ids")).where(F.size("ids") == 2)
    return ids.select("l_orderkey", F.element_at("ids", 1).alias("a"), F.element_at("ids", 2).alias("b"))


@query("a20_series_checks", """WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_shipdate AS d, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS prev FROM lineitem)
    SELECT l_orderkey, count(*) <> count(DISTINCT n) AS has_duplicate, max(n) = count(DISTINCT n) AND min(n) = 1 AS is_contiguous, max(n) <= 5 AS within_best_of, bool_and(coalesce(prev <= d, true)) AS is_ordered FROM l GROUP BY l_orderkey""")
def series_checks(t) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate")
    n = F.col("l_linenumber")
    lines = dealt(t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_orderkey")
    lines = lines.withColumns({"prev": F.lag("l_shipdate").over(order), "fresh": n.isNotNull() & ~n.eqNullSafe(F.lag(n).over(order))})
    distinct = F.count_if("fresh")  # rows of one number are neighbours
    return lines.groupBy("l_orderkey").agg(
        (F.count(F.lit(1)) != distinct).alias("has_duplicate"), ((F.max(n) == distinct) & (F.min(n) == 1)).alias("is_contiguous"),
        (F.max(n) <= 5).alias("within_best_of"), F.bool_and(F.coalesce(F.col("prev") <= F.col("l_shipdate"), F.lit(True))).alias("is_ordered"),
    )


@query("a21_many_to_one", "SELECT md5(text) AS text_key, count(DISTINCT doc_id) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1")
def many_to_one_violations(t) -> DataFrame:
    found = t("documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_key")).agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("first_id"))
    return found.where("n > 1")


@query("a22_artifact", """SELECT o_custkey, CASE count(DISTINCT o_orderpriority) WHEN 0 THEN NULL WHEN 1 THEN min(o_orderpriority) ELSE '["' || string_agg(p, '","' ORDER BY first_key) || '"]' END AS value
    FROM (SELECT o_custkey, o_orderpriority, o_orderpriority AS p, min(o_orderkey) AS first_key FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def artifact(t) -> DataFrame:
    return G.first_seen(t("orders"), ["o_custkey"], "o_orderpriority", "o_orderkey").select("o_custkey", "value")


@query("a23_child_integrity", """SELECT o_orderkey, coalesce(n, 0) AS n_children, coalesce(n, 0) = coalesce(k, 0) AS keys_unique, coalesce(n, 0) BETWEEN 1 AND 6 AS cardinality_ok
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def child_integrity(t) -> DataFrame:
    own = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_linenumber").alias("k"))
    zero = F.lit(0).cast("long")
    n = F.coalesce("n", zero)
    return t("orders").select("o_orderkey").join(own, "o_orderkey", "left").select("o_orderkey", n.alias("n_children"), (n == F.coalesce("k", zero)).alias("keys_unique"), n.between(1, 6).alias("cardinality_ok"))


@query("a24_coverage", """SELECT r_name, count(*) AS total, count(*) FILTER (WHERE l_shipdate > o_orderdate) AS valid, round(100.0 * count(*) FILTER (WHERE l_shipdate > o_orderdate) / count(*), 4) AS percent
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def coverage(t) -> DataFrame:
    valid = F.count_if(F.col("l_shipdate") > F.col("o_orderdate"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count(F.lit(1)).alias("total"), valid.alias("valid"), F.round(valid * 100.0 / F.count(F.lit(1)), 4).alias("percent"))


@query("a25_percentiles", "SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS low, round(median(l_extendedprice), 3) AS median, round(quantile_cont(l_extendedprice, 0.9), 3) AS p90, max(l_extendedprice) AS high FROM lineitem GROUP BY l_returnflag")
def percentiles(t) -> DataFrame:
    from draftlake.operators.quantiles import exact_quantiles

    found = exact_quantiles(t("lineitem"), "l_returnflag", "l_extendedprice", {"median": 0.5, "p90": 0.9})
    return found.select("l_returnflag", "n", "low", F.round("median", 3).alias("median"), F.round("p90", 3).alias("p90"), "high")


@query("a28_latest", "SELECT user_id, count(*) AS n, arg_max(event_type, ts) AS latest_type, max(ts) AS latest_ts FROM events WHERE ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY user_id")
def latest(t) -> DataFrame:
    events = t("events")
    last = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("until"))  # one row
    return events.crossJoin(F.broadcast(last)).where("ts < until").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", "ts").alias("latest_type"), F.max("ts").alias("latest_ts"))


@query("a30_label_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def label_counts(t) -> DataFrame:
    return t("labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("a34_handle_dup", "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY lower(p_name)) AS n_same FROM part QUALIFY n_same > 1")
def handle_duplicates(t) -> DataFrame:
    return t("part").withColumn("n_same", F.count(F.lit(1)).over(Window.partitionBy(F.lower("p_name")))).where("n_same > 1").select("p_partkey", "p_name", "n_same")


@query("w03_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicates(t) -> DataFrame:
    return G.repeated(t("lineitem"), "l_orderkey", "l_linenumber")


@query("w04_keep_last", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(t) -> DataFrame:
    return G.keep_last(t("events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("w05_max_by", "SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, l_linenumber, l_partkey)) AS best_part, max(l_extendedprice) AS best_price FROM lineitem GROUP BY l_orderkey")
def max_by(t) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", "l_linenumber", "l_partkey")).alias("best_part"), F.max("l_extendedprice").alias("best_price"))


@query("w06_monotone", "SELECT o_custkey, bool_and(ok) AS is_monotone FROM (SELECT o_custkey, coalesce(o_totalprice >= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), true) AS ok FROM orders) GROUP BY o_custkey")
def monotone(t) -> DataFrame:
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = t("orders").select("o_custkey", F.coalesce(F.col("o_totalprice") >= before, F.lit(True)).alias("ok"))
    return rows.groupBy("o_custkey").agg(F.bool_and("ok").alias("is_monotone"))


@query("w07_boundaries", "SELECT o_orderdate AS cutoff, (sum(count(*)) OVER (ORDER BY o_orderdate) - count(*))::BIGINT AS position, count(*) AS n FROM orders GROUP BY o_orderdate")
def group_boundaries(t) -> DataFrame:
    groups = t("orders").groupBy(F.col("o_orderdate").alias("cutoff")).agg(F.count(F.lit(1)).alias("n"))  # distinct cutoffs only meet in the window
    return groups.select("cutoff", (F.sum("n").over(Window.orderBy("cutoff")) - F.col("n")).alias("position"), "n")


@query("w08_position", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS position FROM conversations")
def position(t) -> DataFrame:
    return t("conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("position"))


@query("o01_canonical_order", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank, o_orderpriority FROM orders")
def canonical_order(t) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t("orders").select("o_orderkey", rank.alias("rank"), "o_orderpriority").orderBy("rank", "o_orderpriority", "o_orderkey")


WORDS = "list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')"
NAME, INITIALS = f"array_to_string({WORDS}, '')", f"array_to_string(list_transform({WORDS}, lambda w: w[1:1]), '')"
SEARCH = f"CASE WHEN {NAME} = 're' OR {INITIALS} = 're' THEN 0 WHEN {NAME} LIKE 're%' THEN 1 WHEN {INITIALS} LIKE 're%' THEN 2 WHEN contains({NAME}, 're') THEN 3 END"


@query("o06_search_rank", f"SELECT p_partkey, p_name, {SEARCH}::INTEGER AS rank FROM part WHERE {SEARCH} IS NOT NULL ORDER BY rank, length({NAME}), p_partkey LIMIT 40")
def search_rank(t) -> DataFrame:
    from draftlake.operators.reference_data import search

    return search(t("part").select("p_partkey", "p_name"), "p_name", "re", "p_partkey").select("p_partkey", "p_name", "rank")


@query("o08_topk", "SELECT c_custkey, sum_price FROM (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS sum_price FROM orders GROUP BY o_custkey) ORDER BY sum_price DESC, c_custkey LIMIT 20")
def topk(t) -> DataFrame:
    sums = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("sum_price"))
    return sums.orderBy(F.desc("sum_price"), "c_custkey").limit(20)


@query("u01_union", "SELECT 'customer' AS entity, c_custkey AS id, c_name AS name, 0 AS rule_ord FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, 1 FROM supplier")
def union(t) -> DataFrame:
    first = t("customer").select(F.lit("customer").alias("entity"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return G.in_rule_order(first, t("supplier").select(F.lit("supplier").alias("entity"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("u02_intersect_except", """SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'customers_only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'keys_left', count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT s_suppkey FROM supplier)""")
def intersect_except(t) -> DataFrame:
    a, b = t("customer").select("c_nationkey"), t("supplier").select("s_nationkey")
    keys = t("customer").select("c_custkey").exceptAll(t("supplier").select("s_suppkey"))
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(a.intersect(b), "both").union(count(a.subtract(b), "customers_only")).union(count(keys, "keys_left"))


@query("u03_overlap", """WITH o AS (SELECT l_orderkey AS k, list_distinct(list(l_suppkey % 20)) AS s FROM lineitem GROUP BY l_orderkey)
    SELECT a.k AS order_key, round(len(list_intersect(a.s, b.s)) / 5, 9) AS overlap FROM o a JOIN o b ON a.k = b.k + 1""")
def overlap(t) -> DataFrame:
    sets = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 20).alias("s"))
    before = sets.select((F.col("l_orderkey") + 1).alias("l_orderkey"), F.col("s").alias("b"))
    return sets.join(before, "l_orderkey").select(F.col("l_orderkey").alias("order_key"), F.round(F.size(F.array_intersect("s", "b")) / 5, 9).alias("overlap"))


@query("u06_subtract", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def subtract(t) -> DataFrame:
    from draftlake.operators.reference_data import removable

    current = t("customer").select("c_custkey")
    return removable(current, "c_custkey", t("orders").select(F.col("o_custkey").alias("c_custkey")), [t("supplier").select(F.col("s_suppkey").alias("c_custkey"))])
