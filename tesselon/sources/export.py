"""Export to JSON lines or CSV with exact value encodings."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselon.operators.relational import where_all


def encoded(name: str, kind: T.DataType) -> Column:
    """Binary as base64, decimals as text, dates ISO, timestamps in UTC with seconds, odd reals by name."""
    c = F.col(name)
    if isinstance(kind, T.BinaryType):
        c = F.base64(c)
    elif isinstance(kind, T.DecimalType):
        c = c.cast("string")
    elif isinstance(kind, T.DateType):
        c = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        utc = F.to_utc_timestamp(c, F.current_timezone()) if isinstance(kind, T.TimestampType) else c
        c = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").otherwise(c.cast("string"))
    return c.alias(name)


def export(df: DataFrame, path: str, *, kind: str = "jsonl", columns: Sequence[str] | None = None, where: Sequence[tuple | Mapping] = (), max_rows: int | None = None, header: bool = True) -> None:
    """Writes a folder of part files, all or nothing; an existing path is refused."""
    df = where_all(df, where).select(*(columns or df.columns))
    if max_rows is not None:
        df = df.limit(max_rows)
    out = df.select(*[encoded(f.name, f.dataType) for f in df.schema]).write.mode("errorifexists")
    if kind == "jsonl":
        out.option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        out.option("header", header).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown export kind {kind!r}")


def shown(df: DataFrame, kind: str = "table", max_rows: int | None = None) -> str:
    """The rows as text for a terminal: a table with the number of rows, CSV with a header, or a JSON array.

    Rows come partition by partition. ``max_rows`` is for tables alone; the last line then says how many rows there are.
    """
    names = df.columns
    if max_rows is not None and kind != "table":
        raise ValueError(f"{kind} output has all rows")
    rows = list(df.toLocalIterator()) if max_rows is None else df.limit(max_rows).collect()
    if kind == "json":
        return json.dumps([dict(zip(names, r, strict=True)) for r in rows], default=str, ensure_ascii=False)
    cells = [["" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r] for r in rows]
    if kind == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *cells])
        return out.getvalue()
    if kind != "table":
        raise ValueError(f"unknown output kind {kind!r}")
    total = df.count() if max_rows is not None and len(rows) == max_rows else len(rows)
    if not total:
        return "0 rows returned"
    widths = [max(map(len, column)) for column in zip(names, *cells, strict=True)]
    lines = [" | ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in [names, *cells]]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:], f"({total} rows)" if total == len(rows) else f"({len(rows)} of {total} rows)"])


def batches(df: DataFrame, size: int = 1000):
    """The rows in lists of ``size``, one partition at a time on the driver."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
