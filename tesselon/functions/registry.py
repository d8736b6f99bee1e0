"""User functions: arity-checked scalar functions and aggregates, by name in SQL."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FunctionInfo:
    name: str
    returns: str
    min_args: int
    max_args: int | None
    deterministic: bool = True
    aggregate: bool = False


@dataclass
class Registry:
    """Functions that take and give pandas Series (or, for aggregates, give one value), registered for SQL and DataFrames."""

    spark: SparkSession
    known: dict[str, FunctionInfo] = field(default_factory=dict)
    made: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def register(self, name: str, fn: Callable, returns: str, *, aggregate: bool = False, deterministic: bool = True) -> FunctionInfo:
        given = list(inspect.signature(fn).parameters.values())
        least = sum(p.default is p.empty and p.kind is not p.VAR_POSITIONAL for p in given)
        most = None if any(p.kind is p.VAR_POSITIONAL for p in given) else len(given)
        made = F.pandas_udf(fn, returns, F.PandasUDFType.GROUPED_AGG if aggregate else F.PandasUDFType.SCALAR)
        if not deterministic:
            made = made.asNondeterministic()
        self.spark.udf.register(name, made)
        self.known[name.lower()] = info = FunctionInfo(name, returns, least, most, deterministic, aggregate)
        self.made[name.lower()] = made
        return info

    def call(self, name: str, *args) -> Column:
        info = self.known[name.lower()]
        if len(args) < info.min_args or info.max_args is not None and len(args) > info.max_args:
            raise TypeError(f"{info.name} takes {info.min_args} to {info.max_args or 'any number of'} arguments, not {len(args)}")
        return self.made[name.lower()](*args)
