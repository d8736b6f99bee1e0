"""The Python database interface (PEP 249) over an engine: connections, cursors, and rows fetched partition by partition."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import SparkSession

from tesselon.plans.engine import Engine

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Error(Exception):
    pass


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class ProgrammingError(DatabaseError):
    pass


_READS = re.compile(r"\s*(?:SELECT|WITH|VALUES|EXPLAIN|SHOW|DESCRIBE|FROM|TABLE)\b|\s*\(", re.I)


def connect(spark: SparkSession, path: str) -> Connection:
    return Connection(Engine(spark, path))


class Connection:
    """A transaction is open from the first changing statement until commit or rollback."""

    def __init__(self, engine: Engine):
        self.engine, self.closed = engine, False

    def _live(self) -> Engine:
        if self.closed:
            raise InterfaceError("the connection is closed")
        return self.engine

    def cursor(self) -> Cursor:
        self._live()
        return Cursor(self)

    def commit(self) -> None:
        if self._live().store.open:
            self.engine.store.commit()

    def rollback(self) -> None:
        if self._live().store.open:
            self.engine.store.rollback()

    def close(self) -> None:
        """Changes that are not committed are lost."""
        if not self.closed:
            self.rollback()
        self.closed = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *rest) -> None:
        self.commit() if kind is None else self.rollback()


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount = connection, None, -1
        self._rows: Iterator[Any] | None = None

    def execute(self, sql: str, args: Sequence[Any] = ()) -> Cursor:
        engine = self.connection._live()
        reads = bool(_READS.match(sql))
        if not reads and not engine.store.open and not re.match(r"\s*(?:BEGIN|START|COMMIT|ROLLBACK|VACUUM)\b", sql, re.I):
            engine.store.begin()
        try:
            found = engine.query(sql, args)
            if reads:
                self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in found.schema]
                self._rows, self.rowcount = map(tuple, found.toLocalIterator(prefetchPartitions=True)), -1
            else:
                self.description, self._rows, self.rowcount = None, None, found.first()[0]
        except Exception as e:
            raise ProgrammingError(str(e)) from e
        return self

    def executemany(self, sql: str, rows: Sequence[Sequence[Any]]) -> Cursor:
        total = 0
        for args in rows:
            total += max(0, self.execute(sql, args).rowcount)
        self.rowcount = total
        return self

    def fetchone(self) -> tuple | None:
        if self._rows is None:
            raise ProgrammingError("no rows to fetch")
        return next(self._rows, None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        out = []
        while len(out) < (size or self.arraysize) and (row := self.fetchone()) is not None:
            out.append(row)
        return out

    def fetchall(self) -> list[tuple]:
        return list(self)

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.fetchone()) is not None:
            yield row

    def setinputsizes(self, sizes) -> None:
        pass

    def setoutputsize(self, size, column=None) -> None:
        pass

    def close(self) -> None:
        self._rows = None
