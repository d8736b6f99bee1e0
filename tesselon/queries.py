"""Named queries over the tables of a data folder, each with SQL that gives the same rows where SQL can.

Queries run over whole tables; a limit stands only where the limit is what is shown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import scalar as S
from tesselon.functions import statistics as ST
from tesselon.operators import relational as R
from tesselon.operators.recursive import MAX_LEVELS, fixpoint
from tesselon.session import register, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def same(name: str, *tables: str, sql: str) -> None:
    """A query whose text Spark and the oracle read alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if tables:
            register(spark, sf_dir, *tables)
        if "RECURSIVE" in sql:
            spark.conf.set("spark.sql.cteRecursionLevelLimit", MAX_LEVELS)
        return spark.sql(sql)

    QUERIES[name], ORACLES[name] = run, sql


def query(name: str, oracle: str | None = None) -> Callable[[Callable], Callable]:
    """A query given as a function of a table reader; ``oracle`` is its SQL."""

    def put(fn: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(lambda t: table(spark, sf_dir, t))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return put


# ------------------------------------------------------------ scans, projections, filters

same("scan_projection", "customer", sql="SELECT c_custkey, c_name AS name, c_acctbal FROM customer")
same("scan_star", "nation", sql="SELECT * FROM nation")
same("select_without_from", sql="SELECT 1 + 2 AS n, 'a' AS s, CAST(NULL AS INTEGER) AS nothing")
same("values_rows", sql="SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)")
same("count_star", "lineitem", sql="SELECT COUNT(*) AS n FROM lineitem")
same("filter_compound", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 45 AND l_discount < 0.05) OR NOT (l_tax < 0.07)")
same("filter_between_in", "part", sql="SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
same("filter_like", "part", sql="SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' AND p_name LIKE '_a%'")
same("filter_ilike", "events", sql="SELECT event_id, event_type FROM events WHERE event_type ILIKE 'P%'")
same("null_semantics", "orders", sql="""
    SELECT o_orderkey, x IS NULL AS missing, x = 'F' AS same, NOT (x = 'F') AS other, x IN ('F', 'O') AS listed, COALESCE(x, '-') AS shown
    FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS x FROM orders) t""")
same("null_filter", "orders", sql="SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'P') IS NULL")
same("arithmetic", "lineitem", sql="SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount) + l_tax - 1, 4) AS net, -l_quantity AS less FROM lineitem")
same("exact_lookup", "orders", sql="SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")


@query("arithmetic_floor_div", """
    SELECT o_orderkey, CAST(FLOOR((o_custkey - 70) / 7.0) AS BIGINT) AS d, CAST((o_custkey - 70) - 7 * FLOOR((o_custkey - 70) / 7.0) AS BIGINT) AS m, CAST(NULL AS BIGINT) AS z
    FROM orders""")  # fmt: skip
def _(t):
    x = F.col("o_custkey") - 70
    return t("orders").select("o_orderkey", S.floor_div(x, 7).alias("d"), S.floor_mod(x, 7).alias("m"), S.floor_div(x, 0).alias("z"))


@query("index_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def _(t):
    return R.index_scan(t("orders"), ["o_orderkey"], low=100, high=400, high_open=True).select("o_orderkey", "o_totalprice")


@query("index_prefix_scan", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%'")
def _(t):
    return R.index_scan(t("part"), ["p_brand"], prefix="Brand#1").select("p_partkey", "p_brand")


@query("index_multi_key_scan", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 100)")
def _(t):
    return R.index_scan(t("customer"), ["c_custkey"], keys=[1, 5, 9, 100]).select("c_custkey", "c_name")


# ------------------------------------------------------------ joins

same("inner_join", "orders", "customer", sql="SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
for kind in ("left", "right", "full"):
    same(f"{kind}_join", "orders", "customer", sql=f"""
        SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_custkey > 20) c
        {kind.upper()} JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c.c_custkey = o.o_custkey""")
same("cross_join", "region", "nation", sql="SELECT r_name, n_name FROM region CROSS JOIN nation")
same("theta_join", "nation", "region", sql="SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey AND n_nationkey > 3")
same("self_join", "nation", sql="SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
same("multi_join_chain", "lineitem", "orders", "customer", "nation", "region", sql="""
    SELECT r_name, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
same("null_keys_do_not_join", "orders", "customer", sql="""
    SELECT o_orderkey, c_custkey FROM (SELECT o_orderkey, NULLIF(o_custkey, 1) AS k FROM orders) o
    JOIN (SELECT c_custkey, NULLIF(c_custkey, 1) AS k FROM customer) c ON o.k = c.k""")
same("semi_join_in", "customer", "orders", sql="SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
same("semi_join_exists", "customer", "orders", sql="SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
same("exists_uncorrelated", "region", "nation", sql="SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)")
same("anti_join_not_exists", "customer", "orders", sql="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
same("scalar_subquery", "nation", "region", sql="SELECT n_name, (SELECT COUNT(*) FROM region) AS regions, (SELECT r_name FROM region WHERE r_regionkey = -1) AS nobody FROM nation")

_JOINED = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"


@query("hash_join", _JOINED)
def _(t):
    return t("orders").join(t("customer").hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("merge_join", _JOINED)
def _(t):
    return t("orders").join(t("customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


# ------------------------------------------------------------ aggregation

same("global_agg", "lineitem", sql="SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS total, ROUND(AVG(l_discount), 6) AS mean, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last FROM lineitem")
same("group_by_agg", "lineitem", sql="""
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 6) AS avg_disc
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
same("group_by_expression", "orders", sql="SELECT o_orderstatus = 'F' AS done, COUNT(*) AS n FROM orders GROUP BY o_orderstatus = 'F'")
same("group_without_aggregate", "orders", sql="SELECT o_orderstatus FROM orders GROUP BY o_orderstatus")
same("count_distinct", "events", sql="SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(user_id) AS n FROM events GROUP BY event_type")
same("sum_distinct", "lineitem", sql="SELECT l_returnflag, SUM(DISTINCT l_quantity) AS s, AVG(DISTINCT l_quantity) AS a FROM lineitem GROUP BY l_returnflag")
same("having_alias", "orders", sql="SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority HAVING n > 100")
same("having_expr", "orders", sql="SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12 AND SUM(o_totalprice) / COUNT(*) > 100000")
same("empty_aggregate", "orders", sql="SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0")
same("null_group", "orders", sql="SELECT NULLIF(o_orderstatus, 'P') AS g, COUNT(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'P')")
same("revenue_by_segment", "orders", "customer", sql="""
    SELECT c_mktsegment, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY c_mktsegment HAVING COUNT(*) >= 2 ORDER BY revenue DESC""")


@query("string_agg_sorted", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def _(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("array_agg", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_nationkey)), ' ') AS ids FROM nation GROUP BY n_regionkey")
def _(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.array_agg("n_nationkey")), " ").alias("ids"))


# ------------------------------------------------------------ windows

_W = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"
same("row_number", "orders", sql=f"SELECT o_orderkey, CAST(ROW_NUMBER() OVER ({_W}) AS BIGINT) AS rn FROM orders")
same("rank_dense_rank", "lineitem", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS BIGINT) AS r,
    CAST(DENSE_RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS BIGINT) AS d FROM lineitem""")
same("window_partition_total", "orders", sql="SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
same("window_rows_frame", "events", sql="SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS s FROM events")
same("window_rows_single_bound", "events", sql="SELECT event_id, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS m FROM events")
same("window_running_sum", "events", sql="SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS s FROM events")
same("window_following", "events", sql="SELECT event_id, MIN(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m FROM events")
same("lag_lead", "events", sql="SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")


@query("window_null_order", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'P') ASC NULLS FIRST, o_orderkey) AS BIGINT) AS rn FROM orders")
def _(t):
    found = t("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return R.with_row_number(found, [F.asc_nulls_first("s"), F.asc("o_orderkey")], "rn").select("o_orderkey", "rn")



@query("window_ordered_total", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.count("*").over(R.whole("o_custkey")).alias("n"))


@query("window_count_distinct", """
    SELECT event_id, n FROM events JOIN (SELECT user_id AS u, COUNT(DISTINCT event_type) AS n FROM events GROUP BY user_id) ON user_id = u""")  # fmt: skip
def _(t):
    return R.with_count_distinct(t("events"), ["user_id"], "event_type", "n").select("event_id", "n")


# ------------------------------------------------------------ sort, limit, distinct, set operations

same("order_limit_offset", "orders", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
same("top_k", "lineitem", sql="SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
@query("order_nulls", "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS s, CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'P') DESC NULLS LAST, o_orderkey) AS BIGINT) AS place FROM orders")
def _(t):
    found = t("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return R.with_row_number(found, [F.desc_nulls_last("s"), F.asc("o_orderkey")], "place")


same("distinct", "orders", sql="SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
same("union_all", "nation", "region", sql="SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
same("union_distinct", "nation", "region", sql="SELECT n_name AS x FROM nation UNION SELECT r_name FROM region UNION SELECT NULLIF(r_name, r_name) FROM region")
same("intersect", "orders", "customer", sql="SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
same("except", "customer", "orders", sql="SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")


@query("distinct_on", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(t):
    return R.distinct_on(t("orders"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("limit_with_total", "SELECT o_orderkey, (SELECT COUNT(*) FROM orders) AS total_count FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 2")
def _(t):
    return R.limit_with_total(t("orders").select("o_orderkey"), ["o_orderkey"], 5, 2)


@query("set_operation_helpers", "SELECT k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT r_regionkey FROM region")
def _(t):
    both = R.set_operation("intersect", t("orders").select(F.col("o_custkey").alias("k")), t("customer").select("c_custkey"))
    return R.set_operation("union", both, t("region").select(F.col("r_regionkey").cast("bigint")), keep_all=True)


@query("set_operations_to_the_right", "SELECT n_nationkey AS k FROM nation EXCEPT (SELECT n_regionkey FROM nation UNION SELECT 7)")
def _(t):
    spark = t("nation").sparkSession
    return R.chained(t("nation").select(F.col("n_nationkey").alias("k")), ("except", False, t("nation").select("n_regionkey")), ("union", False, spark.sql("SELECT 7")))


# ------------------------------------------------------------ common table expressions, recursion, views

same("cte_chain", "orders", sql="WITH a AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey FROM a WHERE s > 1000000) SELECT COUNT(*) AS n, MIN(o_custkey) AS lo FROM b")
same("recursive_cte", sql="WITH RECURSIVE n(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM n WHERE x < 150) SELECT x FROM n")


@query("recursive_union_fixpoint", """
    WITH RECURSIVE reach(k) AS (SELECT CAST(1 AS BIGINT) UNION SELECT CAST(n_nationkey AS BIGINT) FROM reach JOIN nation ON n_nationkey % 7 = (k * 3 + 1) % 7) SELECT k FROM reach""")  # fmt: skip
def _(t):
    nation = t("nation").select(F.col("n_nationkey").cast("bigint").alias("n"))
    seed = nation.sparkSession.range(1, 2).select(F.col("id").alias("k"))
    return fixpoint(seed, lambda level: level.join(nation, F.col("n") % 7 == (F.col("k") * 3 + 1) % 7).select(F.col("n").alias("k")))


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "orders")
    spark.sql("CREATE OR REPLACE TEMP VIEW large_orders AS SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
    return spark.sql("SELECT o_custkey, COUNT(*) AS n FROM large_orders GROUP BY o_custkey")


QUERIES["view_query"] = _view
ORACLES["view_query"] = "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey"


# ------------------------------------------------------------ functions


@query("fn_string_case_length", "SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, CAST(length(p_name) AS BIGINT) AS n, reverse(p_name) AS r FROM part")
def _(t):
    c = F.col("p_name")
    return t("part").select("p_partkey", F.lower(c).alias("lo"), F.upper(c).alias("up"), F.length(c).cast("bigint").alias("n"), F.reverse(c).alias("r"))


@query("fn_string_substr", "SELECT p_partkey, substr(p_name, 2, 3) AS a, substr(p_name, 1, 2) AS zero, right(p_name, 3) AS tail, left(p_name, 4) AS head, right(p_name, 4) AS last4 FROM part")
def _(t):
    c = F.col("p_name")
    return t("part").select("p_partkey", S.substr(c, 2, 3).alias("a"), S.substr(c, 0, 2).alias("zero"), S.substr(c, -3).alias("tail"), S.left(c, 4).alias("head"), S.right(c, 4).alias("last4"))


@query("fn_string_concat_trim", """
    SELECT p_partkey, concat(p_brand, '-', NULL, p_type) AS c, regexp_replace('  ' || p_name || chr(9), '^\\s+|\\s+$', '', 'g') AS t,
    p_name || ' ' AS l, ' ' || p_name AS r FROM part""")  # fmt: skip
def _(t):
    c = F.col("p_name")
    padded = F.concat(F.lit("  "), c, F.lit("\t"))
    return t("part").select("p_partkey", S.concat(F.col("p_brand"), "-", F.lit(None), F.col("p_type")).alias("c"), S.trim(padded).alias("t"), S.ltrim(F.concat(F.lit(" "), c, F.lit(" "))).alias("l"), S.rtrim(F.concat(F.lit(" "), c, F.lit(" "))).alias("r"))


@query("fn_string_search", """
    SELECT p_partkey, replace(p_brand, 'Brand', 'B') AS r, CAST(strpos(p_brand, '#') AS BIGINT) AS at, CAST(strpos(p_brand, '?') AS BIGINT) AS none,
    CASE WHEN len(string_split(p_brand, '#')) >= 2 THEN string_split(p_brand, '#')[2] END AS part, CAST(NULL AS VARCHAR) AS beyond FROM part""")  # fmt: skip
def _(t):
    c = F.col("p_brand")
    return t("part").select("p_partkey", F.replace(c, F.lit("Brand"), F.lit("B")).alias("r"), S.position("#", c).alias("at"), S.position("?", c).alias("none"), S.split_part(c, "#", 2).alias("part"), S.split_part(c, "#", 9).alias("beyond"))


@query("fn_string_hash", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def _(t):
    return t("customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"))


@query("fn_numeric_rounding", """
    SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(s_acctbal, 1) AS r, CAST(sign(s_acctbal) AS INTEGER) AS s FROM supplier""")  # fmt: skip
def _(t):
    c = F.col("s_acctbal")
    return t("supplier").select("s_suppkey", S.absolute(c).alias("a"), F.ceil(c).alias("c"), F.floor(c).alias("f"), S.rounded(c, 1).alias("r"), S.sign(c).alias("s"))


@query("fn_numeric_powers", """
    SELECT p_partkey, round(power(p_size, 2), 4) AS p, round(sqrt(p_size), 8) AS q, round(ln(p_size), 8) AS l, round(log10(p_size), 8) AS t, CAST(NULL AS DOUBLE) AS none, CAST(p_size % 7 AS BIGINT) AS m FROM part""")  # fmt: skip
def _(t):
    c = F.col("p_size")
    return t("part").select("p_partkey", F.round(F.pow(c, 2), 4).alias("p"), F.round(F.sqrt(c), 8).alias("q"), F.round(S.ln(c), 8).alias("l"), F.round(S.log10(c), 8).alias("t"), S.ln(c - c).alias("none"), S.floor_mod(c, 7).alias("m"))


@query("fn_date_extract", """
    SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, dayofweek(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy FROM orders""")  # fmt: skip
def _(t):
    c = F.col("o_orderdate")
    return t("orders").select("o_orderkey", *[S.extract(p, c).alias(n) for p, n in (("year", "y"), ("mon", "m"), ("day", "d"), ("h", "h"), ("dow", "dow"), ("doy", "doy"))])


@query("fn_date_arithmetic", """
    SELECT o_orderkey, o_orderdate + INTERVAL 60 DAY AS later, CAST(floor(abs(epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days, CAST(floor(abs(epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate)) / 31536000) AS BIGINT) AS years FROM orders""")  # fmt: skip
def _(t):
    c, base = F.col("o_orderdate"), F.lit("2000-01-01").cast("timestamp")
    return t("orders").select("o_orderkey", S.date_add(c, 2, "month").cast("timestamp_ntz").alias("later"), S.date_diff(c, base, "day").alias("days"), S.date_diff(c, base, "years").alias("years"))


@query("fn_date_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS s, strftime(o_orderdate, '%d/%m/%y') AS e, CAST(o_orderdate AS DATE) AS d, CAST(NULL AS DATE) AS bad FROM orders")
def _(t):
    c = F.col("o_orderdate")
    return t("orders").select("o_orderkey", S.date_format(c, "%Y-%m-%d %H:%M:%S").alias("s"), S.date_format(c, "%d/%m/%y").alias("e"), S.date(c).alias("d"), S.date("no date").alias("bad"))


@query("fn_json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def _(t):
    return t("events").select("event_id", S.json_extract(F.col("props"), "k").alias("k"), S.json_extract(F.col("props"), "none").alias("none"))


@query("fn_json_build", """
    SELECT event_id, '["' || event_type || '","' || CAST(user_id AS VARCHAR) || '"]' AS a, '{"t":"' || event_type || '"}' AS o, '["k"]' AS keys, 'object' AS kind, CAST(0 AS BIGINT) AS n FROM events""")  # fmt: skip
def _(t):
    p = F.col("props")
    return t("events").select("event_id", S.json_array(F.col("event_type"), F.col("user_id")).alias("a"), S.json_object("t", F.col("event_type")).alias("o"), S.json_keys(p).alias("keys"), S.json_type(p).alias("kind"), S.json_array_length(p).alias("n"))


@query("fn_json_shapes", """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' WHEN 3 THEN 'integer' WHEN 4 THEN 'boolean' END AS kind,
    CAST(CASE event_id % 6 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS n, CASE event_id % 6 WHEN 0 THEN '["a","b"]' ELSE '[]' END AS keys, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) END AS deep FROM events""")  # fmt: skip
def _(t):
    k = F.col("event_id").cast("string")
    shapes = [F.concat(F.lit('{"a":{"x":[1,'), k, F.lit(']},"b":null}')), F.concat(F.lit("["), k, F.lit(",[1]]")), F.concat(F.lit('"'), k, F.lit('"')), k, F.lit("true")]
    j = F.lit(None).cast("string")
    for n, shape in enumerate(shapes):
        j = F.when(F.col("event_id") % 6 == n, shape).otherwise(j)
    return t("events").withColumn("j", j).select("event_id", S.json_type(F.col("j")).alias("kind"), S.json_array_length(F.col("j")).alias("n"), S.json_keys(F.col("j")).alias("keys"), S.json_extract(F.col("j"), "a.x.1").alias("deep"))


same("fn_bitwise", "part", sql="SELECT p_partkey, p_size & 6 AS a, p_size | 6 AS o, ~p_size AS n FROM part")
same("fn_conditional", "orders", sql="SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'P'), 'none') AS c, GREATEST(o_custkey, 50, NULL) AS g, LEAST(o_custkey, 50) AS l, NULLIF(o_orderstatus, 'F') AS n FROM orders")
same("fn_cast", "orders", sql="SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(o_totalprice AS DECIMAL(12, 2)) AS d, CAST(o_orderdate AS DATE) AS day FROM orders")


@query("fn_lenient_cast", "SELECT p_partkey, CAST(p_size AS BIGINT) AS n, CAST(0 AS BIGINT) AS zero FROM part")
def _(t):
    return t("part").select("p_partkey", S.lenient_cast(F.concat(F.col("p_size"), F.lit("abc")), "integer").alias("n"), S.lenient_cast(F.col("p_brand"), "integer").alias("zero"))


# ------------------------------------------------------------ statistics


@query("stats_summary", """
    SELECT event_type, COUNT(*) AS count, round(sum(value), 3) AS sum, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(var_samp(value), 4) AS variance,
    round(stddev_samp(value), 6) AS std_dev, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90,
    round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")  # fmt: skip
def _(t):
    digits = {"sum": 3, "variance": 4}
    found = t("events").groupBy("event_type").agg(*ST.summary("value"))
    return found.select("event_type", "count", "min", "max", *[F.round(c, digits.get(c, 6)).alias(c) for c in found.columns if c not in ("event_type", "count", "min", "max")])


@query("stats_mode_all", """
    WITH c AS (SELECT p_brand, p_size, COUNT(*) AS n FROM part GROUP BY p_brand, p_size) SELECT p_brand, p_size, n FROM c WHERE n = (SELECT MAX(n) FROM c d WHERE d.p_brand = c.p_brand)""")  # fmt: skip
def _(t):
    return ST.modes(t("part"), ["p_brand"], "p_size")


@query("stats_histogram", """
    WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events) SELECT CAST(floor((value - lo) / w) AS INTEGER) AS bin, COUNT(*) AS n FROM events, b WHERE floor((value - lo) / w) < 10 GROUP BY 1""")  # fmt: skip
def _(t):
    return ST.histogram(t("events"), "value", 10).select("bin", "n")


@query("stats_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS ma FROM events")
def _(t):
    return t("events").select("event_id", F.round(ST.moving_average("value", 5, ["event_id"], ["user_id"]), 6).alias("ma"))


@query("stats_ema", """
    WITH RECURSIVE r AS (SELECT user_id, event_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    e AS (SELECT user_id, event_id, k, value AS ema FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.event_id, r.k, 0.3 * r.value + 0.7 * e.ema FROM e JOIN r ON r.user_id = e.user_id AND r.k = e.k + 1)
    SELECT event_id, round(ema, 6) AS ema FROM e""")  # fmt: skip
def _(t):
    return ST.exponential_average(t("events"), ["user_id"], ["event_id"], "value", 0.3).select("event_id", F.round("ema", 6).alias("ema"))


@query("stats_zscore", "SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type), 6) AS z FROM events")
def _(t):
    return t("events").select("event_id", F.round(ST.z_score("value", ["event_type"]), 6).alias("z"))


same("stats_correlation", "lineitem", sql="SELECT l_returnflag, ROUND(CORR(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")


# ------------------------------------------------------------ pipeline


@query("rows_pipeline", "SELECT o_custkey, COUNT(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING COUNT(*) >= 5 ORDER BY n DESC, o_custkey LIMIT 25")
def _(t):
    found = R.pipeline(t("orders"), filters=[("o_orderstatus", "ne", "P")], group_by=["o_custkey"], aggregates={"n": ("count", "*"), "total": ("sum", "o_totalprice")}, having=[("n", "gte", 5)], order_by=[("n", "desc"), "o_custkey"], limit=25)
    return found.withColumn("total", F.round("total", 2))


@query("rows_pipeline_window", "SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS BIGINT) AS rn FROM events WHERE event_type IN ('click', 'view')")
def _(t):
    return R.pipeline(t("events"), filters=[{"column": "event_type", "op": "in", "value": ["click", "view"]}], windows={"rn": {"function": "row_number", "partition_by": ["user_id"], "order_by": [("event_id", "desc")]}}, projection=["event_id"])
