"""Scalar functions whose semantics differ from Spark's built-ins of similar name, and the arithmetic rules."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ------------------------------------------------------------ arithmetic


def floor_div(a, b) -> Column:
    """Integer division rounding down; NULL for a zero divisor."""
    a, b = as_column(a).cast("bigint"), F.nullif(as_column(b).cast("bigint"), F.lit(0).cast("bigint"))
    quotient = (a - floor_mod(a, b)) / b
    return quotient.cast("bigint")


def floor_mod(a, b) -> Column:
    """Remainder with the divisor's sign; NULL for a zero divisor."""
    a, b = as_column(a).cast("bigint"), F.nullif(as_column(b).cast("bigint"), F.lit(0).cast("bigint"))
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def safe_div(a, b) -> Column:
    """Real division; NULL for a zero divisor."""
    return as_column(a).cast("double") / F.nullif(as_column(b).cast("double"), F.lit(0.0))


# ------------------------------------------------------------ strings


def concat(*parts) -> Column:
    """Concatenation that takes NULL as ''."""
    return F.concat_ws("", *[F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts])


def substr(s, start, length=None) -> Column:
    """1-based; negative starts count from the end, 0 acts like 1."""
    s, start = as_column(s), as_column(start)
    rest = F.length(s) if length is None else as_column(length)
    return F.substring(s, start, rest)


def trim(s) -> Column:
    return F.regexp_replace(as_column(s), r"^\s+|\s+$", "")


def ltrim(s) -> Column:
    return F.regexp_replace(as_column(s), r"^\s+", "")


def rtrim(s) -> Column:
    return F.regexp_replace(as_column(s), r"\s+$", "")


def position(part, s) -> Column:
    return F.locate(part, as_column(s)).cast("bigint") if isinstance(part, str) else F.position(part, as_column(s)).cast("bigint")


def split_part(s, delimiter: str, n: int) -> Column:
    """The nth piece, NULL out of range."""
    if n <= 0:
        return F.lit(None).cast("string")
    return F.get(F.split(as_column(s), re.escape(delimiter), -1), F.lit(n - 1))


def left(s, n) -> Column:
    return F.left(as_column(s), as_column(n))


def right(s, n) -> Column:
    return F.right(as_column(s), as_column(n))


# ------------------------------------------------------------ numbers


def absolute(x) -> Column:
    return F.abs(as_column(x).cast("double"))


def sign(x) -> Column:
    return F.signum(as_column(x).cast("double")).cast("int")


def ln(x) -> Column:
    """Natural logarithm; NULL for what has none."""
    x = as_column(x).cast("double")
    return F.when(x > 0, F.log(x))


def log10(x) -> Column:
    x = as_column(x).cast("double")
    return F.when(x > 0, F.log10(x))


def rounded(x, digits: int = 0) -> Column:
    """Half away from zero, as a real number."""
    return F.round(as_column(x).cast("double"), digits)


# ------------------------------------------------------------ dates

#: Seconds of each unit; months and years have fixed lengths here.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 30 * 86400, "year": 365 * 86400}
#: The date format codes and the Java patterns they stand for.
FORMAT_CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}
_PARTS = {"y": "year", "mon": "month", "d": "day", "h": "hour", "min": "minute", "sec": "second"}


def _unit(unit: str) -> int:
    name = unit.lower().rstrip("s")
    if name not in UNIT_SECONDS:
        raise ValueError(f"unknown unit {unit!r}")
    return UNIT_SECONDS[name]


def date(x) -> Column:
    """A date from a date, timestamp or text; NULL for text that is none."""
    return as_column(x).try_cast("date")


def to_timestamp(x) -> Column:
    return as_column(x).try_cast("timestamp")


def extract(part: str, d) -> Column:
    """year month day hour minute second doy, and dow with Sunday as 0."""
    d, part = as_column(d), _PARTS.get(part.lower(), part.lower())
    found = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
        "doy": F.dayofyear, "dow": lambda x: F.dayofweek(x) - 1,
    }.get(part)
    if found is None:
        raise ValueError(f"unknown part {part!r}")
    return found(d).cast("bigint")


def date_add(d, n, unit: str) -> Column:
    """A timestamp n units later, months and years of fixed length."""
    return F.timestamp_micros(F.unix_micros(as_column(d).cast("timestamp")) + as_column(n).cast("bigint") * (_unit(unit) * 1_000_000))


def date_diff(a, b, unit: str) -> Column:
    """Whole units between two times, without sign."""
    gap = F.abs(F.unix_seconds(as_column(b).cast("timestamp")) - F.unix_seconds(as_column(a).cast("timestamp")))
    return F.floor(gap / _unit(unit)).cast("bigint")


def date_format(d, pattern: str) -> Column:
    java = "".join(FORMAT_CODES.get(x, "'" + x.replace("'", "''") + "'" if x.isalpha() else x) for x in re.findall(r"%.|.", pattern))
    return F.date_format(as_column(d), java)


# ------------------------------------------------------------ JSON


def _path(path: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))


def json_extract(j, path: str) -> Column:
    """By dotted path; texts as they are, others as JSON; NULL for what is missing."""
    return F.get_json_object(as_column(j), _path(path))


def json_array(*items) -> Column:
    return F.to_json(F.array(*[as_column(x).cast("string") for x in items]))


def json_object(*pairs) -> Column:
    """Keys and values in turn; values as text."""
    if len(pairs) % 2:
        raise ValueError("json_object needs keys and values in pairs")
    return F.to_json(F.create_map(*[as_column(x).cast("string") for x in pairs]), {"ignoreNullFields": "false"})


def json_array_length(j) -> Column:
    return F.coalesce(F.json_array_length(as_column(j)), F.lit(0)).cast("bigint")


def json_type(j) -> Column:
    """object array string integer number boolean null; NULL for what is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(as_column(j)))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def json_keys(j) -> Column:
    return F.to_json(F.coalesce(F.json_object_keys(as_column(j)), F.array().cast("array<string>")))


# ------------------------------------------------------------ others


def nullif(a, b) -> Column:
    return F.nullif(as_column(a), as_column(b))


def lenient_cast(x, kind: str) -> Column:
    """A cast that reads the number a text starts with, 0 if none; NULL for bad dates."""
    x, kind = as_column(x), kind.lower()
    text = x.cast("string")
    if kind in ("int", "integer", "bigint", "smallint"):
        prefix = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
        return F.when(x.isNotNull(), F.coalesce(prefix.try_cast("bigint"), F.lit(0).cast("bigint")))
    if kind in ("float", "double", "decimal", "numeric"):
        prefix = F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1)
        return F.when(x.isNotNull(), F.coalesce(prefix.try_cast("double"), F.lit(0.0)))
    if kind in ("text", "string", "varchar"):
        return text
    return x.try_cast(kind)


def process_id() -> Column:
    return F.lit(os.getpid())
