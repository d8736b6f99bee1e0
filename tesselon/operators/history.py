"""Temporal queries over a change log, and diffs and merges of branches of changes.

A change log has id, ts, table_name, row_id, operation (insert, update, delete), old_values and new_values (maps of
texts), and may have branch, user and lsn. An update gives only the columns that it changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE = "id bigint, ts timestamp, table_name string, row_id bigint, operation string, old_values map<string,string>, new_values map<string,string>, branch string, user string, lsn bigint"


def between(log: DataFrame, table: str, start, end) -> DataFrame:
    """Changes of a table from one time to another, both included."""
    return log.where((F.col("table_name") == table) & F.col("ts").between(start, end))


def history(log: DataFrame, table: str, row_id) -> DataFrame:
    return log.where((F.col("table_name") == table) & (F.col("row_id") == row_id)).orderBy("ts", "id")


def changes(log: DataFrame, *, user: str | None = None, branch: str | None = None, operation: str | None = None, lsn: tuple[int, int] | None = None) -> DataFrame:
    for name, value in (("user", user), ("branch", branch), ("operation", operation)):
        if value is not None:
            log = log.where(F.col(name) == value)
    return log if lsn is None else log.where(F.col("lsn").between(*lsn))


def as_of(log: DataFrame, table: str, ts=None) -> DataFrame:
    """(row_id, values) of all rows of a table as they stood: inserts set, updates merge, deletes drop.

    Only changes since a row's last insert or delete matter; of these each column's last value counts.
    """
    seen = log.where(F.col("table_name") == table)
    if ts is not None:
        seen = seen.where(F.col("ts") <= ts)
    place = F.struct("ts", "id")
    marks = seen.groupBy("row_id").agg(F.max(F.when(F.col("operation") != "update", F.struct("ts", "id", "operation"))).alias("mark"))
    alive = marks.where("mark IS NULL OR mark.operation = 'insert'")
    rows = seen.join(alive, "row_id").where((F.col("mark").isNull()) | (place >= F.struct("mark.ts", "mark.id")))
    cells = rows.select("row_id", "ts", "id", F.explode_outer("new_values").alias("k", "v"))
    last = cells.groupBy("row_id", "k").agg(F.max_by(F.struct("v"), F.struct("ts", "id"))["v"].alias("v"))
    pairs = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))
    return last.groupBy("row_id").agg(F.map_from_entries(F.array_sort(pairs)).alias("values"))


def version(log: DataFrame, table: str, row_id, ts) -> DataFrame:
    return as_of(log.where(F.col("row_id") == row_id), table, ts)


def snapshot(log: DataFrame, ts) -> dict[str, DataFrame]:
    """The state of every table of the log."""
    names = [r[0] for r in log.select("table_name").distinct().collect()]  # a row for each table
    return {n: as_of(log, n, ts) for n in names}


_SAME = ("table_name", "row_id", "operation", "values")


def _changes(log: DataFrame) -> DataFrame:
    shown = F.to_json(F.array_sort(F.map_entries(F.coalesce("new_values", F.create_map().cast("map<string,string>")))))
    return log.select("table_name", "row_id", "operation", shown.alias("values"))


def diff(a: DataFrame, b: DataFrame, table: str | None = None) -> DataFrame:
    """Changes of one branch that the other lacks: side 'added' is in b alone, 'removed' in a alone."""
    a, b = (_changes(x if table is None else x.where(F.col("table_name") == table)).distinct() for x in (a, b))
    return b.subtract(a).withColumn("side", F.lit("added")).unionByName(a.subtract(b).withColumn("side", F.lit("removed")))


def conflicts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Cells that both branches change, to different values."""

    def cells(log: DataFrame, name: str) -> DataFrame:
        flat = log.select("table_name", "row_id", "ts", "id", F.explode("new_values").alias("column", "v"))
        return flat.groupBy("table_name", "row_id", "column").agg(F.max_by(F.struct("v"), F.struct("ts", "id"))["v"].alias(name))

    both = cells(ours, "ours").join(cells(theirs, "theirs"), ["table_name", "row_id", "column"])
    return both.where(~F.col("ours").eqNullSafe(F.col("theirs")))


def merge(ours: DataFrame, theirs: DataFrame, resolve: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """All changes of both branches, common ones once; conflicting cells need a resolver, whose values come as later updates.

    A change is common if its id, time, table, row, operation and values are equal, not by its id alone: branches may
    number their changes on their own.
    """
    open_cells = conflicts(ours, theirs)
    if resolve is None and not open_cells.isEmpty():
        raise ValueError("the branches conflict")

    def marked(log: DataFrame) -> DataFrame:
        shown = [F.to_json(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))))) for c in ("old_values", "new_values")]
        return log.withColumn("__same", F.struct("id", "ts", "table_name", "row_id", "operation", *[x.alias(f"v{k}") for k, x in enumerate(shown)]))

    mine, other = marked(ours).select(F.col("__same").alias("__mine")), marked(theirs)
    both = ours.unionByName(other.join(mine, F.col("__same").eqNullSafe(F.col("__mine")), "left_anti").drop("__same"))
    if resolve is None:
        return both
    top = both.agg(F.max("id").alias("top_id"), F.max("ts").alias("top_ts"))
    cells = open_cells.select("table_name", "row_id", F.struct("column", resolve(F.col("ours"), F.col("theirs")).alias("v")).alias("cell"))
    rows = cells.groupBy("table_name", "row_id").agg(F.map_from_entries(F.array_sort(F.collect_list("cell"))).alias("new_values"))  # a row's columns
    fixes = rows.crossJoin(F.broadcast(top)).select((F.col("top_id") + 1 + F.monotonically_increasing_id()).alias("id"), F.col("top_ts").alias("ts"), "table_name", "row_id", F.lit("update").alias("operation"), F.lit(None).cast("map<string,string>").alias("old_values"), "new_values")
    return both.unionByName(fixes, allowMissingColumns=True)


def restored(log: DataFrame, table: str, ts) -> DataFrame:
    """Changes that, added to the log, take a table back to how it stood at a time: deletes, inserts and updates of rows that differ."""
    now, then = as_of(log, table), as_of(log, table, ts)
    both = now.select("row_id", F.col("values").alias("now")).join(then.select("row_id", F.col("values").alias("then")), "row_id", "full")

    def shown(x: str) -> Column:
        return F.to_json(F.array_sort(F.map_entries(x)))

    differ = both.where(~shown("now").eqNullSafe(shown("then")))
    gone = F.map_from_entries(F.transform(F.array_except(F.map_keys("now"), F.map_keys("then")), lambda k: F.struct(k, F.lit(None).cast("string"))))
    back = F.when(F.col("now").isNull(), F.col("then")).when(F.col("then").isNotNull(), F.map_concat("then", gone))
    kind = F.when(F.col("then").isNull(), "delete").when(F.col("now").isNull(), "insert").otherwise("update")
    return differ.select("row_id", F.lit(table).alias("table_name"), kind.alias("operation"), F.col("now").alias("old_values"), back.alias("new_values"))


def pruned(log: DataFrame, before) -> DataFrame:
    """The log with the changes up to a time put together to one insert for each row that then stood, or its last delete; later states are the same."""
    old = log.where(F.col("ts") <= before)
    top = old.groupBy("table_name", "row_id").agg(F.max(F.struct("ts", "id")).alias("top"))
    names = [r[0] for r in old.select("table_name").distinct().collect()]  # a row for each table
    marks = old.groupBy("table_name", "row_id").agg(F.max(F.when(F.col("operation") != "update", F.struct("ts", "id", "operation"))).alias("mark"))
    gone = marks.where("mark.operation = 'delete'").select(F.col("mark.id").alias("id"), F.col("mark.ts").alias("ts"), "table_name", "row_id", F.lit("delete").alias("operation"))
    out = log.where((F.col("ts") > before) | F.col("ts").isNull()).unionByName(gone, allowMissingColumns=True)
    for name in names:
        rows = as_of(old, name).join(top.where(F.col("table_name") == name), "row_id")
        out = out.unionByName(rows.select(F.col("top.id").alias("id"), F.col("top.ts").alias("ts"), F.lit(name).alias("table_name"), "row_id", F.lit("insert").alias("operation"), F.col("values").alias("new_values")), allowMissingColumns=True)
    return out
