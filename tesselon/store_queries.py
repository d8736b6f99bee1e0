"""Named queries over the versioned store, change logs, exports and backups, each with SQL that gives the same rows.

Each makes a store of its own in the shared folder from whole tables, and runs statements on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.operators import history as H
from tesselon.plans.engine import Engine
from tesselon.queries import ORACLES, QUERIES
from tesselon.session import register, table
from tesselon.sources.backup import Backups
from tesselon.sources.export import export
from tesselon.sources.scratch import shared_dir
from tesselon.sources.store import ConstraintError, Store


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def query(name: str, oracle: str):
    """A query given as a function of the session, an engine over a new store, and a table reader."""

    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, Engine(spark, scratch(spark)), lambda t: table(spark, sf_dir, t))
        ORACLES[name] = oracle
        return fn

    return put


# ------------------------------------------------------------ statements


@query("upsert_merge", """
    SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name || '?' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS times
    FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""")  # fmt: skip
def _(spark, e, t):
    e.query("CREATE TABLE st_customer (k BIGINT PRIMARY KEY, name TEXT NOT NULL, times INTEGER DEFAULT 0)")
    e.store.insert("st_customer", t("customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "c_name AS name"))
    t("customer").createOrReplaceTempView("st_new_customer")
    e.query("INSERT INTO st_customer (k, name) SELECT c_custkey, c_name || ? FROM st_new_customer WHERE c_custkey % 2 = 0 ON CONFLICT (k) DO UPDATE SET name = excluded.name, times = old.times + 1", ["?"])
    return e.query("SELECT k, name, times FROM st_customer")


@query("insert_ignore", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN 'old' ELSE 'new' END AS s FROM customer")
def _(spark, e, t):
    e.query("CREATE TABLE st_seen (k BIGINT PRIMARY KEY, s TEXT)")
    e.store.insert("st_seen", t("customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "'old' AS s"))
    t("customer").createOrReplaceTempView("st_new_customer")
    e.query("INSERT INTO st_seen SELECT c_custkey, 'new' FROM st_new_customer ON CONFLICT DO NOTHING")
    return e.query("SELECT * FROM st_seen")


@query("update_rows", """
    SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_orderkey END AS a, CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_custkey END AS b,
    CASE WHEN o_orderstatus = 'F' THEN 'x WHERE y, = ''q''' ELSE o_orderpriority END AS note FROM orders""")  # fmt: skip
def _(spark, e, t):
    e.query("CREATE TABLE st_orders (k BIGINT PRIMARY KEY, a BIGINT, b BIGINT, status TEXT, note TEXT)")
    e.store.insert("st_orders", t("orders").selectExpr("o_orderkey AS k", "o_orderkey AS a", "o_custkey AS b", "o_orderstatus AS status", "o_orderpriority AS note"))
    e.query("UPDATE st_orders SET a = b, b = a, note = ? WHERE status = ?", ["x WHERE y, = 'q'", "F"])
    return e.query("SELECT k, a, b, note FROM st_orders")


@query("delete_rows", "SELECT c_custkey AS k, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_custkey % 5 <> 0")
def _(spark, e, t):
    e.query("CREATE TABLE st_parent (k BIGINT PRIMARY KEY)")
    e.query("CREATE TABLE st_child (k BIGINT PRIMARY KEY, parent BIGINT REFERENCES st_parent (k) ON DELETE CASCADE)")
    customers = t("customer").selectExpr("c_custkey AS k")
    e.store.insert("st_parent", customers)
    e.store.insert("st_child", t("orders").selectExpr("o_orderkey AS k", "o_custkey AS parent").join(customers.selectExpr("k AS parent"), "parent", "left_semi"))
    e.query("DELETE FROM st_parent WHERE k % 5 = 0")
    return e.query("SELECT p.k, COUNT(c.k) AS n FROM st_parent p LEFT JOIN st_child c ON c.parent = p.k GROUP BY p.k")


@query("constraint_violations", """
    SELECT 'NOT NULL (k)' AS "constraint", 0 AS rows UNION ALL SELECT 'UNIQUE (k)', COUNT(*) - COUNT(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'CHECK (price < 200000)', COUNT(*) FROM orders WHERE NOT (o_totalprice < 200000)
    UNION ALL SELECT 'FOREIGN KEY (parent)', COUNT(*) FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)""")  # fmt: skip
def _(spark, e, t):
    e.query("CREATE TABLE st_parent (k BIGINT PRIMARY KEY)")
    e.store.insert("st_parent", t("customer").selectExpr("c_custkey AS k"))
    e.query("CREATE TABLE st_checked (k BIGINT PRIMARY KEY, price DOUBLE, parent BIGINT REFERENCES st_parent (k), CHECK (price < 200000))")
    rows = t("orders").selectExpr("o_custkey AS k", "o_totalprice AS price", "o_orderkey AS parent")
    try:
        e.store.insert("st_checked", rows)
    except ConstraintError:
        assert e.store.table("st_checked").isEmpty()
    return e.store.violations("st_checked", rows)


@query("autoincrement_defaults", "SELECT COUNT(*) AS n, CAST(SUM(id) AS BIGINT) AS total, MIN(id) AS low, MAX(id) AS high, MIN(flag) AS flag FROM (SELECT ROW_NUMBER() OVER () AS id, 'on' AS flag FROM nation)")
def _(spark, e, t):
    e.query("CREATE TABLE st_numbered (id BIGINT PRIMARY KEY AUTOINCREMENT, name TEXT, flag TEXT DEFAULT 'on')")
    e.store.insert("st_numbered", t("nation").selectExpr("n_name AS name"))
    return e.query("SELECT COUNT(*) AS n, CAST(SUM(id) AS BIGINT) AS total, MIN(id) AS low, MAX(id) AS high, MIN(flag) AS flag FROM st_numbered")


@query("alter_columns", "SELECT n_nationkey AS k, n_name AS label, 'new' AS note, n_regionkey AS region FROM nation")
def _(spark, e, t):
    e.query("CREATE TABLE st_nation (k INTEGER PRIMARY KEY, name TEXT, note TEXT DEFAULT 'old')")
    e.store.insert("st_nation", t("nation").selectExpr("n_nationkey AS k", "n_name AS name"))
    for text in ("DROP COLUMN note", "ADD COLUMN note TEXT DEFAULT 'new'", "RENAME COLUMN name TO label", "ADD COLUMN region INTEGER"):
        e.query(f"ALTER TABLE st_nation {text}")
    t("nation").createOrReplaceTempView("st_new_nation")
    e.query("INSERT INTO st_nation (k, label, region) SELECT n_nationkey, n_name, n_regionkey FROM st_new_nation ON CONFLICT DO UPDATE SET region = excluded.region")
    return e.query("SELECT k, label, note, region FROM st_nation")


@query("version_scan", "SELECT 'before' AS moment, COUNT(*) AS n FROM nation UNION ALL SELECT 'after', COUNT(*) FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'branch', 0")
def _(spark, e, t):
    e.query("CREATE TABLE st_nation (k INTEGER PRIMARY KEY, region INTEGER)")
    e.store.insert("st_nation", t("nation").selectExpr("n_nationkey AS k", "n_regionkey AS region"))
    version = e.store.version
    e.query("DELETE FROM st_nation WHERE region = 1")
    e.store.create_branch("other")
    e.store.checkout("other")
    e.query("DELETE FROM st_nation")
    parts = {"branch": e.store.table("st_nation")}
    e.store.checkout("main")
    parts |= {"before": e.store.table("st_nation", version), "after": e.store.table("st_nation")}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(at).alias("moment"), "n") for at, df in parts.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("library_functions", """
    SELECT event_id, json_extract_string(props, '$.k') AS k, strftime(ts, '%Y/%m/%d') AS day, CAST(floor(abs(epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', ts))) / 3600) AS BIGINT) AS hours,
    strftime(ts + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS later, CASE WHEN len(string_split(event_type, 'i')) >= 2 THEN string_split(event_type, 'i')[2] END AS part FROM events""")  # fmt: skip
def _(spark, e, t):
    t("events").createOrReplaceTempView("st_events")
    return e.query("""SELECT event_id, JSON_EXTRACT(props, 'k') AS k, DATE_FORMAT(ts, '%Y/%m/%d') AS day, DATE_DIFF(ts, TIMESTAMP '2024-01-20', 'hours') AS hours,
        DATE_FORMAT(DATE_ADD(ts, 1, 'month'), '%Y-%m-%d %H:%M:%S') AS later, SPLIT_PART(event_type, 'i', 2) AS part FROM st_events""")


@query("parameters_in_query", "SELECT event_type, COUNT(*) AS n FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10' AND value > 1.5 GROUP BY event_type")
def _(spark, e, t):
    from datetime import datetime

    t("events").createOrReplaceTempView("st_events")
    return e.query("SELECT event_type, COUNT(*) AS n FROM st_events WHERE event_type IN (?) AND ts >= $2 AND value > ? GROUP BY event_type".replace("?", "$1", 1).replace("?", "$3"), [["click", "view"], datetime(2024, 1, 10), 1.5])


# ------------------------------------------------------------ change logs

_OP = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END"


def log(events: DataFrame) -> DataFrame:
    """Events as changes of users: signups set both columns, errors delete, clicks set the type, others the value."""
    kind, value = (F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in (("type", "event_type"), ("value", "event_id")))
    cells = F.when(F.col("event_type") == "signup", F.array(kind, value)).when(F.col("event_type") == "click", F.array(kind)).when(F.col("event_type") != "error", F.array(value))
    return events.select(F.col("event_id").alias("id"), "ts", F.lit("users").alias("table_name"), F.col("user_id").alias("row_id"), F.expr(_OP).alias("operation"), F.lit(None).cast("map<string,string>").alias("old_values"), F.map_from_entries(cells).alias("new_values"), F.lit("main").alias("branch"), F.lit(None).cast("string").alias("user"), F.col("event_id").alias("lsn"))


_STATE = """
    WITH e AS (SELECT user_id AS u, event_type AS t, event_id AS id, CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id AS w FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'),
    m AS (SELECT u, max(w) AS mark, arg_max(t, w) AS t FROM e WHERE t IN ('signup', 'error') GROUP BY u),
    s AS (SELECT e.* FROM e LEFT JOIN m ON e.u = m.u WHERE m.u IS NULL OR (m.t = 'signup' AND e.w >= m.mark))
    SELECT u AS row_id, arg_max(t, w) FILTER (WHERE t IN ('signup', 'click')) AS type, arg_max(CAST(id AS VARCHAR), w) FILTER (WHERE t IN ('signup', 'view', 'purchase')) AS value FROM s GROUP BY u"""


@query("as_of_state", _STATE)
def _(spark, e, t):
    state = H.as_of(log(t("events")), "users", F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return state.select("row_id", F.col("values")["type"].alias("type"), F.col("values")["value"].alias("value"))


@query("history_restored", _STATE)
def _(spark, e, t):
    changes, at = log(t("events")), F.lit("2024-01-15 12:00:00").cast("timestamp")
    back = H.restored(changes, "users", at).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("id", F.lit(1 << 40))
    state = H.as_of(changes.unionByName(back, allowMissingColumns=True), "users")
    return state.select("row_id", F.col("values")["type"].alias("type"), F.col("values")["value"].alias("value"))


@query("history_pruned", _STATE)
def _(spark, e, t):
    pruned = H.pruned(log(t("events")), F.lit("2024-01-10").cast("timestamp"))
    state = H.as_of(pruned, "users", F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return state.select("row_id", F.col("values")["type"].alias("type"), F.col("values")["value"].alias("value"))


@query("change_between", f"SELECT event_id AS id, user_id AS row_id, {_OP} AS operation FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def _(spark, e, t):
    return H.between(log(t("events")), "users", F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")).select("id", "row_id", "operation")


@query("row_history", f"SELECT event_id AS id, {_OP} AS operation FROM events WHERE user_id = 7")
def _(spark, e, t):
    return H.history(log(t("events")), "users", 7).select("id", "operation")


@query("changes_filtered", "SELECT user_id AS row_id, COUNT(*) AS n FROM events WHERE event_type = 'error' AND event_id BETWEEN 100 AND 5000 GROUP BY user_id")
def _(spark, e, t):
    return H.changes(log(t("events")), branch="main", operation="delete", lsn=(100, 5000)).groupBy("row_id").agg(F.count("*").alias("n"))


@query("branch_diff", f"""
    WITH c AS (SELECT event_id, user_id AS row_id, {_OP} AS operation, CASE WHEN event_type IN ('signup', 'click') THEN event_type END AS t, CASE WHEN event_type IN ('signup', 'view', 'purchase') THEN event_id END AS v FROM events),
    a AS (SELECT DISTINCT row_id, operation, t, v FROM c WHERE event_id % 3 <> 0), b AS (SELECT DISTINCT row_id, operation, t, v FROM c WHERE event_id % 2 = 0)
    SELECT side, operation, COUNT(*) AS n FROM (SELECT 'added' AS side, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) GROUP BY side, operation""")  # fmt: skip
def _(spark, e, t):
    changes = log(t("events"))
    return H.diff(changes.where("id % 3 <> 0"), changes.where("id % 2 = 0"), "users").groupBy("side", "operation").agg(F.count("*").alias("n"))


@query("branch_merge", "SELECT user_id AS row_id, COUNT(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def _(spark, e, t):
    """Both branches number their changes on their own, from 0 to 99; what they change differs."""
    changes = log(t("events")).withColumn("id", F.col("id") % 100)
    merged = H.merge(changes.where("new_values['type'] = 'click'"), log(t("events").where("event_type = 'view'")).withColumn("id", F.col("id") % 100))
    return merged.groupBy("row_id").agg(F.count("*").alias("n"))


# ------------------------------------------------------------ exports, backups, catalog


@query("export_rows", "SELECT o_orderkey AS k, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS d FROM orders WHERE o_totalprice >= 100000 AND o_orderpriority LIKE '%-%'")
def _(spark, e, t):
    path = scratch(spark)
    rows = t("orders").selectExpr("o_orderkey AS k", "o_orderpriority AS p", "o_orderdate AS d", "o_totalprice AS price")
    export(rows, path, columns=["k", "p", "d"], where=[("price", "gte", 100000), ("p", "like", "%-%")])
    return spark.read.schema("k BIGINT, p STRING, d STRING").json(path)


@query("export_csv", "SELECT n_nationkey AS k, n_name || ',\"' AS name FROM nation")
def _(spark, e, t):
    path = scratch(spark)
    export(t("nation").selectExpr("n_nationkey AS k", "n_name || ',\"' AS name"), path, kind="csv")
    return spark.read.schema("k INT, name STRING").option("header", True).option("escape", '"').csv(path)


@query("backup_restore", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def _(spark, e, t):
    e.query("CREATE TABLE st_places (k INTEGER PRIMARY KEY, name TEXT)")
    e.store.insert("st_places", t("nation").selectExpr("n_nationkey AS k", "n_name AS name"))
    backups = Backups(e.store, scratch(spark))
    backups.create("full")
    e.store.insert("st_places", t("region").selectExpr("100 + r_regionkey AS k", "r_name AS name"))
    last = backups.create("incremental")
    e.query("DELETE FROM st_places")
    other = Store(spark, scratch(spark))
    backups.restore(last, other)
    return other.table("st_places")


@query("catalog_columns", """
    SELECT * FROM (VALUES ('st_a', 'k', 'int', false, true, NULL), ('st_a', 's', 'string', true, false, '''x'''), ('st_b', 'k', 'bigint', true, false, NULL))
    AS c(table_name, column_name, data_type, nullable, primary_key, column_default)""")  # fmt: skip
def _(spark, e, t):
    e.query("CREATE TABLE st_a (k INTEGER PRIMARY KEY, s TEXT DEFAULT 'x')")
    e.query("CREATE TABLE st_b (k BIGINT)")
    return e.store.tables()
