"""The library's functions for SQL text: SQL functions of their own names, which Catalyst inlines, and the names they stand for.

Some names mean something else in Spark (DATE_ADD and DATE_DIFF with a unit, DATE_FORMAT with % codes, SPLIT_PART out of
range, JSON paths with dots), so text is read with these names put in place, outside quotes.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from tesselon.functions.scalar import FORMAT_CODES, UNIT_SECONDS

_PREFIX = "tesselon_"
_SECONDS = "CASE rtrim('s', lower(unit)) " + " ".join(f"WHEN '{u}' THEN {n}" for u, n in UNIT_SECONDS.items()) + " ELSE raise_error(concat('unknown unit ', unit)) END"


def _java(pattern: str) -> str:
    for code, java in FORMAT_CODES.items():
        pattern = f"replace({pattern}, '{code}', '{java}')"
    return pattern


#: Parameters, type and body of each function.
FUNCTIONS = {
    "json_extract": ("j STRING, path STRING", "STRING", r"get_json_object(j, concat('$', regexp_replace(regexp_replace(concat('.', path), '\\.([0-9]+)(?=\\.|$)', '[$1]'), '\\.([0-9]+)(?=\\.|$|\\[)', '[$1]')))"),
    "json_array_length": ("j STRING", "BIGINT", "CAST(coalesce(json_array_length(j), 0) AS BIGINT)"),
    "json_keys": ("j STRING", "STRING", "to_json(coalesce(json_object_keys(j), CAST(array() AS ARRAY<STRING>)))"),
    "date_add": ("d TIMESTAMP, n BIGINT, unit STRING DEFAULT 'day'", "TIMESTAMP", f"timestamp_micros(unix_micros(d) + n * ({_SECONDS}) * 1000000)"),
    "date_diff": ("a TIMESTAMP, b TIMESTAMP, unit STRING DEFAULT 'day'", "BIGINT", f"CAST(floor(abs(unix_seconds(b) - unix_seconds(a)) / ({_SECONDS})) AS BIGINT)"),
    "date_format": ("d TIMESTAMP, p STRING", "STRING", f"date_format(d, CASE WHEN contains(p, '%') THEN {_java('p')} ELSE p END)"),
    "split_part": ("s STRING, d STRING, n INT", "STRING", "CASE WHEN n > 0 AND n <= size(split(s, concat('\\\\Q', d, '\\\\E'), -1)) THEN split_part(s, d, n) END"),
    "uuid_generate": ("", "STRING", "uuid()"),
    "pg_backend_pid": ("", "BIGINT", None),
    "db_name": ("", "STRING", "current_database()"),
}
_CALL = re.compile(r"\b(" + "|".join(FUNCTIONS) + r")\s*\(", re.I)


def define(spark: SparkSession) -> None:
    """Makes the functions for the session."""
    import os

    for name, (given, kind, body) in FUNCTIONS.items():
        text = f"CAST({os.getpid()} AS BIGINT)" if body is None else body
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_PREFIX}{name}({given}) RETURNS {kind} RETURN {text}")


def with_library(text: str) -> str:
    """SQL without quoted parts, in which the library's names are put in place."""
    return _CALL.sub(lambda m: f"{_PREFIX}{m[1].lower()}(", text)
