"""Operators that Spark lacks or gives other semantics: DISTINCT ON, windows over whole partitions, set operations with
checks, limits with totals, index-style scans, and the declarative row pipeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.scalar import as_column
from tesselon.sources.scratch import stored

#: Predicates by name, as filters of exports and pipelines give them.
PREDICATES = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "like": lambda c, v: c.like(v), "ilike": lambda c, v: c.ilike(v),
    "in": lambda c, v: c.isin(*v), "between": lambda c, v: c.between(*v),
    "is_null": lambda c, v: c.isNull(), "is_not_null": lambda c, v: c.isNotNull(),
}


def where_all(df: DataFrame, filters: Sequence[tuple | Mapping[str, Any]]) -> DataFrame:
    """Rows that meet every filter: (column, operator[, value])."""
    found = []
    for f in filters:
        column, op, value = (f["column"], f["op"], f.get("value")) if isinstance(f, Mapping) else (*f, None)[:3]
        if op not in PREDICATES:
            raise ValueError(f"unknown filter operator {op!r}")
        found.append(PREDICATES[op](F.col(column), value))
    return df.where(reduce(lambda a, b: a & b, found)) if found else df


def order(*keys: str | tuple[str, str] | Column) -> list[Column]:
    """Sort keys, NULLs first when ascending and last when descending."""
    out = []
    for k in keys:
        name, way = k if isinstance(k, tuple) else (k, "asc")
        c = F.col(name) if isinstance(name, str) else name
        out.append(c if isinstance(k, Column) else c.desc_nulls_last() if way.lower() == "desc" else c.asc_nulls_first())
    return out


def distinct_on(df: DataFrame, keys: Sequence[str], *by) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def whole(*by) -> Window:
    """A window over all rows of a partition, whatever their order."""
    return Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def rows(by: Sequence, order_by: Sequence, start: int | None, end: int | None) -> Window:
    """A ROWS frame; None is unbounded."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    return w.rowsBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)


def count_distinct_over(column, window) -> Column:
    return F.size(F.collect_set(column).over(window)).cast("bigint")


def with_count_distinct(df: DataFrame, by: Sequence[str], column: str, out: str) -> DataFrame:
    """``df`` with the number of different values of a column among the rows of equal ``by``, from an aggregate joined back; nothing is gathered."""
    counts = df.groupBy(*by).agg(F.countDistinct(column).alias(out))
    renamed = counts.toDF(*[f"__{c}" for c in by], out)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return df.join(renamed, on).drop(*[f"__{c}" for c in by])


def with_row_number(df: DataFrame, keys: Sequence, out: str) -> DataFrame:
    """``df`` with the place of each row in the order of all rows, from 1, without gathering them in one task.

    Rows are sorted by range partitions and stored; the partitions' sizes, a row for each, give the offsets. Of equal keys any comes first.
    """
    low = F.lit((1 << 33) - 1)  # this id counts rows within a partition in its lower 33 bits
    placed = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__id", 33))
    total, before = 0, []
    for r in placed.groupBy("__part").count().orderBy("__part").collect():
        before.append((r["__part"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "__part long, __before long")
    return placed.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + F.col("__id").bitwiseAND(low) + 1).drop("__id", "__part", "__before")


def chained(first: DataFrame, *rest: tuple[str, bool, DataFrame]) -> DataFrame:
    """Set operations (kind, keep_all, branch) of equal precedence that bind to the right: a op (b op c)."""
    if not rest:
        return first
    kind, keep_all, branch = rest[0]
    return set_operation(kind, first, chained(branch, *rest[1:]), keep_all)


def set_operation(kind: str, left: DataFrame, right: DataFrame, keep_all: bool = False) -> DataFrame:
    """UNION, INTERSECT or EXCEPT by position; widths must agree, names come from the left."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{kind} needs the same number of columns, not {len(left.columns)} and {len(right.columns)}")
    right = right.toDF(*left.columns)
    made = {
        ("union", True): left.unionAll, ("union", False): lambda r: left.unionAll(r).distinct(),
        ("intersect", True): left.intersectAll, ("intersect", False): left.intersect,
        ("except", True): left.exceptAll, ("except", False): left.subtract,
    }.get((kind.lower(), keep_all))
    if made is None:
        raise ValueError(f"unknown set operation {kind!r}")
    return made(right)


def limit_with_total(df: DataFrame, keys: Sequence, limit: int, offset: int = 0, total: str = "total_count") -> DataFrame:
    """A page of rows, each with how many there are in all."""
    counted = df.agg(F.count("*").alias(total))
    return df.orderBy(*keys).offset(offset).limit(limit).crossJoin(F.broadcast(counted))


def index_scan(df: DataFrame, columns: Sequence[str], *, equal: Sequence | None = None, low=None, high=None, low_open: bool = False, high_open: bool = False, prefix: str | None = None, keys: Sequence | None = None) -> DataFrame:
    """Rows by equality on all columns, a range, prefix or list of keys of the first; file statistics prune the scan."""
    first = F.col(columns[0])
    tests: list[Column] = []
    if equal is not None:
        tests += [F.col(c) == v for c, v in zip(columns, equal, strict=True)]
    if low is not None:
        tests.append(first > low if low_open else first >= low)
    if high is not None:
        tests.append(first < high if high_open else first <= high)
    if prefix is not None:
        tests.append(first.startswith(prefix))
    if keys is not None:
        tests.append(first.isin(*keys))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


AGGREGATES = {
    "count": lambda c: F.count("*" if c in (None, "*") else c), "count_distinct": F.countDistinct, "sum": F.sum, "sum_distinct": F.sum_distinct,
    "avg": F.avg, "min": F.min, "max": F.max, "array_agg": F.array_agg, "string_agg": lambda c: F.listagg(F.col(c).cast("string"), F.lit(",")),
}


def _windowed(spec: Mapping[str, Any]) -> Column:
    by, keys = spec.get("partition_by", ()), order(*spec.get("order_by", ()))
    fn, column = spec["function"].lower(), spec.get("column")
    ranking = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
    if fn in ranking:
        return ranking[fn]().over(Window.partitionBy(*by).orderBy(*(keys or [F.monotonically_increasing_id()]))).cast("bigint")
    if fn in ("lag", "lead"):
        return {"lag": F.lag, "lead": F.lead}[fn](column, spec.get("offset", 1)).over(Window.partitionBy(*by).orderBy(*keys))
    frame = spec.get("frame")
    return AGGREGATES[fn](column).over(rows(by, keys, *frame) if frame else whole(*by))


def pipeline(df: DataFrame, *, filters=(), order_by=(), group_by=(), aggregates: Mapping[str, tuple] | None = None, having=(), distinct: bool = False, projection: Sequence[str] | None = None, windows: Mapping[str, Mapping] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A declarative query: filters, groups, having, distinct, projection, windows, order, page, in this order."""
    df = where_all(df, filters)
    if aggregates:
        df = df.groupBy(*group_by).agg(*[AGGREGATES[fn](column).alias(name) for name, (fn, column) in aggregates.items()])
        df = where_all(df, having)
    for name, spec in (windows or {}).items():
        df = df.withColumn(name, _windowed(spec))
    sorting = order(*order_by)
    hidden = projection is not None and not distinct
    if sorting and hidden:
        df = df.orderBy(*sorting)
    if projection is not None:
        df = df.select(*projection, *[w for w in windows or {} if w not in projection])
    if distinct:
        df = df.distinct()
    if sorting and not hidden:
        df = df.orderBy(*sorting)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def like(c, pattern: str | None, fold: bool = False) -> Column:
    """LIKE with NULL for a NULL pattern."""
    if pattern is None:
        return F.lit(None).cast("boolean")
    return as_column(c).ilike(pattern) if fold else as_column(c).like(pattern)
