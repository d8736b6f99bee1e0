"""Versioned tables on Parquet: immutable data folders, a manifest per version, transactions, savepoints and branches.

A write makes new files and a new manifest; readers keep the version they opened. Manifests are small JSON rows
read and written by Spark, so any file system it knows will do. One writer at a time: a commit checks that the
version it started from is still the newest.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselon.sources.scratch import stored


class ConstraintError(ValueError):
    """A row breaks a table's constraint."""


class ConflictError(RuntimeError):
    """Another commit came first."""


class Store:
    """Tables under one folder, on one branch at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.branch = spark, path.rstrip("/"), "main"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._state: dict[str, Any] | None = None  # of an open transaction
        self._base: int | None = None
        self._savepoints: list[tuple[str, str]] = []
        self.listeners: list[Callable[[str, str, DataFrame], None]] = []
        self.functions: dict[str, Callable[[str, str, DataFrame], None]] = {}  # for triggers

    # ---------------------------------------------------------- manifests

    def _versions(self, branch: str) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/_branches/{branch}")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder))

    def _read(self, branch: str, version: int | None = None) -> dict[str, Any]:
        versions = self._versions(branch)
        if not versions:
            return {"tables": {}, "views": {}}
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/_branches/{branch}/{version if version is not None else versions[-1]}"))
        try:
            return json.loads(stream.readAllBytes().decode())
        finally:
            stream.close()

    def _write(self, branch: str, version: int, state: dict[str, Any]) -> None:
        target = self._hadoop.Path(f"{self.path}/_branches/{branch}/{version}")
        temporary = self._hadoop.Path(f"{self.path}/_pending/{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            raise ConflictError(f"version {version} of {branch} is taken")

    @property
    def version(self) -> int:
        return (self._versions(self.branch) or [0])[-1]

    def state(self) -> dict[str, Any]:
        return self._state if self._state is not None else self._read(self.branch)

    def _change(self, edit: Callable[[dict[str, Any]], None]) -> None:
        alone = self._state is None
        if alone:
            self.begin()
        try:
            edit(self._state)
        except Exception:
            if alone:
                self.rollback()
            raise
        if alone:
            self.commit()

    # ---------------------------------------------------------- transactions

    def begin(self) -> None:
        if self._state is not None:
            raise RuntimeError("a transaction is open")
        self._base, self._state, self._savepoints = self.version, self._read(self.branch), []

    @property
    def open(self) -> bool:
        """Whether a transaction is open."""
        return self._state is not None

    def commit(self) -> int:
        if self._state is None:
            raise RuntimeError("no transaction is open")
        if self.version != self._base:
            self.rollback()
            raise ConflictError("another commit came first")
        self._state["time"] = time.time()
        self._write(self.branch, self._base + 1, self._state)
        self._state = None
        return self.version

    def rollback(self) -> None:
        self._state, self._savepoints = None, []

    def savepoint(self, name: str) -> None:
        self._savepoints.append((name, json.dumps(self.state())))

    def _savepoint(self, name: str) -> int:
        found = [k for k, (n, _) in enumerate(self._savepoints) if n == name]
        if not found:
            raise KeyError(f"no savepoint {name!r}")
        return found[-1]

    def rollback_to(self, name: str) -> None:
        at = self._savepoint(name)
        self._state = json.loads(self._savepoints[at][1])
        del self._savepoints[at + 1 :]

    def release(self, name: str) -> None:
        del self._savepoints[self._savepoint(name) :]

    # ---------------------------------------------------------- branches

    def create_branch(self, name: str) -> None:
        if self._versions(name):
            raise ValueError(f"branch {name!r} exists")
        self._write(name, 1, self._read(self.branch) | {"base": [self.branch, self.version]})

    def checkout(self, name: str) -> None:
        if name != "main" and not self._versions(name):
            raise KeyError(f"no branch {name!r}")
        self.branch = name

    def merge_branch(self, source: str, resolve: Callable[[str], str] | None = None) -> list[str]:
        """Takes the tables over that ``source`` changed since it left this branch; returns their names.

        A table that both changed is a conflict, unless ``resolve`` says 'ours' or 'theirs' for its name.
        """
        theirs = self._read(source)
        base_branch, base_version = theirs.get("base", [None, None])
        if base_branch != self.branch:
            raise ConflictError(f"{source!r} did not leave {self.branch!r}")
        base, taken = self._read(self.branch, base_version), []

        def edit(state: dict[str, Any]) -> None:
            for name in sorted({*base["tables"], *theirs["tables"], *state["tables"]}):
                old, own, new = (x["tables"].get(name) for x in (base, state, theirs))
                if new in (old, own):
                    continue
                if own != old and (resolve is None or resolve(name) not in ("ours", "theirs")):
                    raise ConflictError(f"both branches change {name!r}")
                if own != old and resolve(name) == "ours":
                    continue
                taken.append(name)
                if new is None:
                    del state["tables"][name]
                else:
                    state["tables"][name] = new

        self._change(edit)
        return taken

    def revert(self, version: int) -> int:
        """The state of an older version as the newest one."""
        old = self._read(self.branch, version)

        def edit(state: dict[str, Any]) -> None:
            state.clear()
            state.update(old)

        self._change(edit)
        return self.version

    def version_at(self, when: float) -> int:
        """The newest version committed by a time in seconds since 1970."""
        found = [v for v in self._versions(self.branch) if self._read(self.branch, v).get("time", 0) <= when]
        if not found:
            raise KeyError("no version is that old")
        return found[-1]

    # ---------------------------------------------------------- definitions

    def create_schema(self, name: str, if_not_exists: bool = False) -> None:
        """Tables of a schema have names of the form schema__table."""

        def edit(state: dict[str, Any]) -> None:
            known = state.setdefault("schemas", [])
            if name in known and not if_not_exists:
                raise ValueError(f"schema {name!r} exists")
            if name not in known:
                known.append(name)

        self._change(edit)

    def drop_schema(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        def edit(state: dict[str, Any]) -> None:
            known = state.setdefault("schemas", [])
            if name not in known:
                if if_exists:
                    return
                raise KeyError(f"no schema {name!r}")
            own = [x for kind in ("tables", "views") for x in state[kind] if x.startswith(f"{name}__")]
            if own and not cascade:
                raise ConstraintError(f"schema {name!r} has tables or views")
            for x in own:
                state["tables"].pop(x, None)
                state["views"].pop(x, None)
            known.remove(name)

        self._change(edit)

    def create_table(self, name: str, schema: T.StructType | str, *, primary_key: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), not_null: Sequence[str] = (), checks: Sequence[str] = (), foreign_keys: Sequence[Mapping[str, Any]] = (), defaults: Mapping[str, str] | None = None, autoincrement: str | None = None, if_not_exists: bool = False, named: Mapping[str, Any] | None = None) -> None:
        """``foreign_keys``: columns, table, references, on_delete and on_update (restrict, cascade, set_null, set_default)."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

        def edit(state: dict[str, Any]) -> None:
            if name in state["tables"]:
                if if_not_exists:
                    return
                raise ValueError(f"table {name!r} exists")
            state["tables"][name] = {
                "schema": schema.json(), "files": [], "primary_key": list(primary_key), "unique": [list(u) for u in unique], "not_null": sorted({*not_null, *primary_key}),
                "checks": list(checks), "foreign_keys": [dict(f) for f in foreign_keys], "defaults": dict(defaults or {}), "autoincrement": autoincrement, "named": {k: list(v) for k, v in (named or {}).items()},
            }

        self._change(edit)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        def edit(state: dict[str, Any]) -> None:
            if state["tables"].pop(name, None) is None and not if_exists:
                raise KeyError(f"no table {name!r}")

        self._change(edit)

    def add_column(self, table: str, column: str, kind: str, default: str | None = None) -> None:
        """Old rows read as the default; no file is rewritten. Files hold the column by a name of its own if its name was used before."""

        def edit(state: dict[str, Any]) -> None:
            info = self.info(table)
            schema = T.StructType.fromJson(json.loads(info["schema"]))
            if column in schema.names:
                raise ValueError(f"{table} has a column {column!r}")
            names = info.setdefault("names", {})
            used = {x for f in info["files"] for x in f["columns"]} | set(names.values()) | set(schema.names)
            names[column] = next(x for x in (column, *(f"{column}__{k}" for k in range(2, len(used) + 3))) if x not in used)
            info["schema"] = schema.add(column, T.DataType.fromDDL(kind)).json()
            if default is not None:
                info["defaults"][column] = default

        self._change(edit)

    def drop_column(self, table: str, column: str) -> None:
        """No file is rewritten; a column that a key or a check needs stays."""

        def edit(state: dict[str, Any]) -> None:
            info = self.info(table)
            schema = T.StructType.fromJson(json.loads(info["schema"]))
            if column not in schema.names:
                raise KeyError(f"{table} has no column {column!r}")
            keys = [info["primary_key"], *info["unique"], *(f["columns"] for f in info["foreign_keys"])]
            keys += [f["references"] for other in state["tables"].values() for f in other["foreign_keys"] if f["table"] == table]
            if any(column in k for k in keys) or any(_mentions(c, column) for c in info["checks"]) or len(schema) == 1:
                raise ConstraintError(f"{table}.{column} is part of a key or check, or the last column")
            info["schema"] = T.StructType([f for f in schema if f.name != column]).json()
            info["not_null"] = [c for c in info["not_null"] if c != column]
            info["defaults"].pop(column, None)
            info.get("names", {}).pop(column, None)
            info["autoincrement"] = None if info["autoincrement"] == column else info["autoincrement"]

        self._change(edit)

    def rename_column(self, table: str, column: str, name: str) -> None:
        """Keys, checks and other tables' foreign keys follow; no file is touched."""

        def renamed(columns: Sequence[str]) -> list[str]:
            return [name if c == column else c for c in columns]

        def edit(state: dict[str, Any]) -> None:
            info = self.info(table)
            schema = T.StructType.fromJson(json.loads(info["schema"]))
            if column not in schema.names or name in schema.names:
                raise ValueError(f"can't rename {table}.{column} to {name}")
            info["schema"] = T.StructType([T.StructField(name if f.name == column else f.name, f.dataType) for f in schema]).json()
            names = info.setdefault("names", {})
            names[name] = names.pop(column, column)
            info["primary_key"], info["not_null"] = renamed(info["primary_key"]), sorted(renamed(info["not_null"]))
            info["unique"] = [renamed(u) for u in info["unique"]]
            info["checks"] = [_mention(c, column, name) for c in info["checks"]]
            info["defaults"] = {name if c == column else c: v for c, v in info["defaults"].items()}
            info["autoincrement"] = name if info["autoincrement"] == column else info["autoincrement"]
            own = [v for k, v in info.get("named", {}).values() if k == "foreign_keys"]
            for fk in [*info["foreign_keys"], *own]:
                fk["columns"] = renamed(fk["columns"])
            for other in state["tables"].values():
                for fk in [*other["foreign_keys"], *(v for k, v in other.get("named", {}).values() if k == "foreign_keys")]:
                    fk["references"] = renamed(fk["references"]) if fk["table"] == table else fk["references"]
            for key, (kind, value) in list(info.get("named", {}).items()):
                if kind != "foreign_keys":
                    info["named"][key] = [kind, renamed(value) if kind == "unique" else _mention(value, column, name)]

        self._change(edit)

    def rename_table(self, table: str, name: str) -> None:
        """Foreign keys of other tables follow; no file is touched."""

        def edit(state: dict[str, Any]) -> None:
            if name in state["tables"]:
                raise ValueError(f"table {name!r} exists")
            self.info(table)
            state["tables"][name] = state["tables"].pop(table)
            found = [fk for info in state["tables"].values() for fk in [*info["foreign_keys"], *(v for k, v in info.get("named", {}).values() if k == "foreign_keys")]]
            for item in [*found, *state.get("triggers", {}).values()]:
                item["table"] = name if item["table"] == table else item["table"]

        self._change(edit)

    def alter_type(self, table: str, column: str, kind: str) -> None:
        """Rewrites the column in another type; a value that the type can't hold is refused."""

        def edit(state: dict[str, Any]) -> None:
            old, to = self.table(table), T.DataType.fromDDL(kind)
            lost = old.where(F.col(column).isNotNull() & F.col(column).try_cast(to).isNull())
            if not lost.isEmpty():
                raise ConstraintError(f"{table}.{column} has values that are no {kind}")
            info = state["tables"][table]
            info["schema"] = T.StructType([T.StructField(f.name, to if f.name == column else f.dataType) for f in old.schema]).json()
            self._replace(table, old.withColumn(column, F.col(column).cast(to)), "alter", old.limit(0))

        self._change(edit)

    def add_constraint(self, table: str, kind: str, value: Any, name: str | None = None) -> None:
        """kind: unique (columns), checks (expression) or foreign_keys (mapping); present rows must meet it."""

        def edit(state: dict[str, Any]) -> None:
            named = self.info(table).setdefault("named", {})
            if name in named:
                raise ValueError(f"constraint {name!r} exists")
            if name is not None:
                named[name] = [kind, value]
            state["tables"][table][kind].append(value)
            self._validate(table, self.table(table))

        self._change(edit)

    def info(self, table: str) -> dict[str, Any]:
        tables = self.state()["tables"]
        if table not in tables:
            raise KeyError(f"no table {table!r}")
        return tables[table]

    def tables(self) -> DataFrame:
        rows = [(t, f.name, f.dataType.simpleString(), f.name not in i["not_null"], f.name in i["primary_key"], i["defaults"].get(f.name)) for t, i in self.state()["tables"].items() for f in T.StructType.fromJson(json.loads(i["schema"]))]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean, primary_key boolean, column_default string")

    def constraints(self) -> DataFrame:
        """(table_name, constraint_name, kind, definition) of all tables; unnamed ones have NULL."""
        rows = []
        for name, info in self.state()["tables"].items():
            names = {json.dumps(v): k for k, v in info.get("named", {}).items()}
            rows += [(name, None, "primary key", ", ".join(info["primary_key"]))] * bool(info["primary_key"])
            rows += [(name, names.get(json.dumps([kind, v])), label, v if isinstance(v, str) else ", ".join(v) if kind == "unique" else f"{', '.join(v['columns'])} -> {v['table']} ({', '.join(v['references'])})") for kind, label in (("unique", "unique"), ("checks", "check"), ("foreign_keys", "foreign key")) for v in info[kind]]
        return self.spark.createDataFrame(rows, "table_name string, constraint_name string, kind string, definition string")

    def catalog(self) -> DataFrame:
        """(kind, name, detail) of schemas, tables, views and triggers."""
        state = self.state()
        rows = [("schema", x, None) for x in state.get("schemas", [])] + [("table", x, f"{len(i['files'])} files") for x, i in state["tables"].items()] + [("view", x, text) for x, text in state["views"].items()]
        rows += [("trigger", x, f"{t['when']} {t['event']} on {t['table']}: {t['function']}") for x, t in state.get("triggers", {}).items()]
        return self.spark.createDataFrame(rows, "kind string, name string, detail string")

    # ---------------------------------------------------------- rows

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table, of an older version if given."""
        info = self.info(name) if version is None else self._read(self.branch, version)["tables"][name]
        schema = T.StructType.fromJson(json.loads(info["schema"]))
        if not info["files"]:
            return self.spark.createDataFrame([], schema)
        parts, names = [], info.get("names", {})
        for at, group in _runs(info["files"]):
            held = [T.StructField(names.get(f.name, f.name), f.dataType) for f in schema if names.get(f.name, f.name) in at]
            df = self.spark.read.schema(T.StructType(held)).parquet(*group)
            parts.append(df.select(*[F.col(names.get(f.name, f.name)).alias(f.name) if names.get(f.name, f.name) in at else F.expr(info["defaults"].get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in schema]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _save(self, name: str, rows: DataFrame) -> dict[str, Any]:
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        names = self.info(name).get("names", {})
        rows = rows.toDF(*[names.get(c, c) for c in rows.columns])
        rows.write.parquet(path)
        return {"path": path, "columns": rows.columns}

    def _saved(self, name: str, rows: DataFrame) -> tuple[dict[str, Any], DataFrame]:
        """The entry of a new file, and its rows read back."""
        saved = self._save(name, rows)
        schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(saved["columns"], rows.schema, strict=True)])
        return saved, self.spark.read.schema(schema).parquet(saved["path"]).toDF(*rows.columns)

    def _validate(self, table: str, rows: DataFrame, beside: DataFrame | None = None) -> None:
        """Checks the rows; ``beside`` are rows of the table that are known to be valid."""
        info = self.info(table)
        for c in info["not_null"]:
            if not rows.where(F.col(c).isNull()).isEmpty():
                raise ConstraintError(f"{table}.{c} must not be NULL")
        for key in [k for k in [info["primary_key"], *info["unique"]] if k]:
            known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in key))
            if not known.groupBy(*key).count().where("count > 1").isEmpty():
                raise ConstraintError(f"{table}: duplicate {', '.join(key)}")
            if beside is not None and not known.join(beside.select(*key), key, "left_semi").isEmpty():
                raise ConstraintError(f"{table}: duplicate {', '.join(key)}")
        for check in info["checks"]:
            if not rows.where(F.expr(f"NOT ({check})")).isEmpty():
                raise ConstraintError(f"{table}: CHECK ({check})")
        for fk in info["foreign_keys"]:
            own = rows if beside is None else rows.unionByName(beside)
            parent = (own if fk["table"] == table else self.table(fk["table"])).select(*[F.col(r).alias(f"__{r}") for r in fk["references"]])
            on = [F.col(c) == F.col(f"__{r}") for c, r in zip(fk["columns"], fk["references"], strict=True)]
            known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in fk["columns"]))
            if not known.join(parent, on, "left_anti").isEmpty():
                raise ConstraintError(f"{table}: no parent in {fk['table']}")

    def violations(self, table: str, rows: DataFrame) -> DataFrame:
        """(constraint, rows) of each constraint of the table: how many of the given rows break it; of rows with one key all but one do."""
        info, found = self.info(table), []

        def count(name: str, bad: DataFrame) -> None:
            found.append(bad.agg(F.count("*").alias("rows")).select(F.lit(name).alias("constraint"), "rows"))

        for c in info["not_null"]:
            count(f"NOT NULL ({c})", rows.where(F.col(c).isNull()))
        for key in [k for k in [info["primary_key"], *info["unique"]] if k]:
            known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in key)).groupBy(*key).agg((F.count("*") - 1).alias("more"))
            found.append(known.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("rows")).select(F.lit(f"UNIQUE ({', '.join(key)})").alias("constraint"), "rows"))
        for check in info["checks"]:
            count(f"CHECK ({check})", rows.where(F.expr(f"NOT ({check})")))
        for fk in info["foreign_keys"]:
            parent = (rows if fk["table"] == table else self.table(fk["table"])).select(*[F.col(r).alias(f"__{r}") for r in fk["references"]])
            on = [F.col(c) == F.col(f"__{r}") for c, r in zip(fk["columns"], fk["references"], strict=True)]
            known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in fk["columns"]))
            count(f"FOREIGN KEY ({', '.join(fk['columns'])})", known.join(parent, on, "left_anti"))
        return reduce(DataFrame.unionAll, found) if found else self.spark.createDataFrame([], "constraint string, rows bigint")

    def _filled(self, table: str, rows: DataFrame) -> DataFrame:
        """Missing columns by default or NULL, declared types, and numbers for an autoincrement column."""
        info = self.info(table)
        schema = T.StructType.fromJson(json.loads(info["schema"]))
        extra = set(rows.columns) - set(schema.names)
        if extra:
            raise ValueError(f"{table} has no column {', '.join(sorted(extra))}")
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.expr(info["defaults"].get(f.name, "NULL"))).cast(f.dataType).alias(f.name) for f in schema])
        auto = info["autoincrement"]
        if auto:
            top = self.table(table).agg(F.coalesce(F.max(auto), F.lit(0))).first()[0]
            given = rows.agg(F.max(auto)).first()[0]
            top = top if given is None else max(top, given)
            missing = rows.where(F.col(auto).isNull())
            if not missing.isEmpty():
                low = F.lit((1 << 33) - 1)  # this id counts rows within a partition in its lower 33 bits
                placed = stored(missing.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)))
                before = []
                for r in placed.groupBy("__part").count().orderBy("__part").collect():  # a row for each partition
                    before.append((r["__part"], top))
                    top += r["count"]
                numbered = placed.join(F.broadcast(self.spark.createDataFrame(before, "__part long, __before long")), "__part")
                numbered = numbered.withColumn(auto, (F.col("__before") + 1 + F.col("__id").bitwiseAND(low)).cast(schema[auto].dataType))
                rows = rows.where(F.col(auto).isNotNull()).unionByName(numbered.select(*rows.columns))
        return rows

    def _replace(self, table: str, rows: DataFrame, kind: str, changes: DataFrame) -> None:
        saved, fresh = self._saved(table, rows)
        self._validate(table, fresh)
        self.info(table)["files"] = [saved]
        self._tell(table, kind, changes)

    def create_trigger(self, name: str, table: str, when: str, event: str, function: str) -> None:
        """Calls ``functions[function]`` with (table, kind, changed rows) on each insert, update or delete of the table.

        The change is not committed then, so a function that raises refuses it. Those of ``when`` 'before' come
        first. An upsert counts as insert and as update.
        """
        if function not in self.functions:
            raise KeyError(f"no function {function!r}")
        self.info(table)

        def edit(state: dict[str, Any]) -> None:
            triggers = state.setdefault("triggers", {})
            if name in triggers:
                raise ValueError(f"trigger {name!r} exists")
            triggers[name] = {"table": table, "when": when, "event": event, "function": function}

        self._change(edit)

    def drop_trigger(self, name: str) -> None:
        def edit(state: dict[str, Any]) -> None:
            if state.setdefault("triggers", {}).pop(name, None) is None:
                raise KeyError(f"no trigger {name!r}")

        self._change(edit)

    def drop_constraint(self, table: str, name: str) -> None:
        def edit(state: dict[str, Any]) -> None:
            named = self.info(table).setdefault("named", {})
            if name not in named:
                raise KeyError(f"{table} has no constraint {name!r}")
            kind, value = named.pop(name)
            state["tables"][table][kind].remove(value)

        self._change(edit)

    def _tell(self, table: str, kind: str, changes: DataFrame) -> None:
        events = {"upsert": {"insert", "update"}}.get(kind, {kind})
        fired = [t for t in self.state().get("triggers", {}).values() if t["table"] == table and t["event"] in events]
        for trigger in sorted(fired, key=lambda t: t["when"] != "before"):
            self.functions[trigger["function"]](table, kind, changes)
        for listener in self.listeners:
            listener(table, kind, changes)

    def insert(self, table: str, rows: DataFrame, *, conflict: str | None = None, target: Sequence[str] | None = None, assign: Mapping[str, str] | None = None) -> int:
        """Appends rows; ``conflict`` 'nothing' skips rows whose key exists, 'update' assigns expressions over ``excluded`` and ``old``.

        The target defaults to the primary key, else the first unique key. Of rows with one key the first counts
        for 'nothing', the last for 'update'. Returns how many rows were inserted or updated.
        """
        affected = 0

        def edit(state: dict[str, Any]) -> None:
            nonlocal affected
            info = state["tables"][table]
            new = self._filled(table, rows)
            if conflict is None:
                saved, written = self._saved(table, new)
                self._validate(table, written, beside=self.table(table))
                info["files"].append(saved)
                affected = written.count()
                self._tell(table, "insert", written)
                return
            key = list(target or info["primary_key"] or (info["unique"] or [[]])[0])
            if not key:
                raise ConstraintError(f"{table} has no key for ON CONFLICT")
            place = F.monotonically_increasing_id()
            known = " AND ".join(f"`{c}` IS NOT NULL" for c in key)
            keyed = new.where(known).withColumn("__place", place)
            w = Window.partitionBy(*key).orderBy(F.asc("__place") if conflict == "nothing" else F.desc("__place"))
            one = keyed.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__place", "__rank")
            one = self._saved(table, one)[1]
            old = self.table(table)
            fresh = one.join(old.select(*key), key, "left_anti").select(*new.columns).unionByName(new.where(f"NOT ({known})"))
            if conflict == "nothing":
                out, changed = old.unionByName(fresh), fresh
            else:
                pairs = old.alias("old").join(one.alias("excluded"), [F.col(f"old.{c}") == F.col(f"excluded.{c}") for c in key], "left")
                hit = F.col(f"excluded.{key[0]}").isNotNull()
                values = {c: F.when(hit, F.expr(assign[c])).otherwise(F.col(f"old.{c}")) if c in (assign or {}) else F.col(f"old.{c}") for c in new.columns}
                updated = pairs.select(*[values[c].cast(old.schema[c].dataType).alias(c) for c in new.columns])
                out, changed = updated.unionByName(fresh), one
            affected = changed.count()
            self._replace(table, out, "upsert", changed)

        self._change(edit)
        return affected

    def update(self, table: str, assign: Mapping[str, str | Column], where: str | Column = "true") -> int:
        """Every right-hand side sees the old row."""
        affected = 0

        def edit(state: dict[str, Any]) -> None:
            nonlocal affected
            old = self.table(table)
            hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
            value = {c: F.expr(v) if isinstance(v, str) else v for c, v in assign.items()}
            affected = old.where(hit).count()
            out = old.select(*[F.when(hit, value[c]).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in value else F.col(c) for c in old.columns])
            both = old.where(hit).select(*[F.col(c).alias(f"__old_{c}") for c in old.columns], *[(value[c] if c in value else F.col(c)).cast(old.schema[c].dataType).alias(f"__new_{c}") for c in old.columns])
            self._replace(table, out, "update", old.where(hit))
            self._follow(table, both, set(value))

        self._change(edit)
        return affected

    def _follow(self, parent: str, both: DataFrame, changed: set[str]) -> None:
        """Children of changed keys follow their foreign keys' actions on update; ``both`` holds old and new rows side by side."""
        for child, info in list(self.state()["tables"].items()):
            for fk in info["foreign_keys"]:
                refs = fk["references"]
                if fk["table"] != parent or not changed & set(refs):
                    continue
                moved = both.where(F.expr(" OR ".join(f"NOT (`__old_{r}` <=> `__new_{r}`)" for r in refs)))
                keys = moved.select(*[F.col(f"__{side}_{r}") for side in ("old", "new") for r in refs]).distinct()
                rows = self.table(child)
                on = [F.col(c) == F.col(f"__old_{r}") for c, r in zip(fk["columns"], refs, strict=True)]
                hit = rows.join(keys, on)
                if hit.isEmpty():
                    continue
                action = fk.get("on_update", "restrict")
                if action == "restrict":
                    still = self.table(parent).select(*[F.col(r).alias(f"__old_{r}") for r in refs])
                    if not hit.join(still, [f"__old_{r}" for r in refs], "left_anti").isEmpty():
                        raise ConstraintError(f"{child} refers to {parent}")
                    continue
                value = {c: F.col(f"__new_{r}") if action == "cascade" else F.expr(info["defaults"].get(c, "NULL")) if action == "set_default" else F.lit(None) for c, r in zip(fk["columns"], refs, strict=True)}
                new = {c: value[c].cast(rows.schema[c].dataType) if c in value else F.col(c) for c in rows.columns}
                pairs = hit.select(*[F.col(c).alias(f"__old_{c}") for c in rows.columns], *[v.alias(f"__new_{c}") for c, v in new.items()])
                self._replace(child, rows.join(keys, on, "left_anti").unionByName(hit.select(*[v.alias(c) for c, v in new.items()])), "update", hit.select(*rows.columns))
                self._follow(child, pairs, set(value))

    def delete(self, table: str, where: str | Column = "true") -> int:
        """Children follow their foreign keys' actions: cascade, set_null, set_default, else restrict."""
        affected = 0

        def edit(state: dict[str, Any]) -> None:
            nonlocal affected
            old = self.table(table)
            hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
            gone = old.where(hit)
            affected = gone.count()
            self._replace(table, old.where(~hit), "delete", gone)
            self._children(table, gone)

        self._change(edit)
        return affected

    def _children(self, parent: str, gone: DataFrame) -> None:
        for child, info in list(self.state()["tables"].items()):
            for fk in info["foreign_keys"]:
                if fk["table"] != parent:
                    continue
                rows = self.table(child)
                keys = gone.select(*[F.col(r).alias(f"__{r}") for r in fk["references"]]).distinct()
                on = [F.col(c) == F.col(f"__{r}") for c, r in zip(fk["columns"], fk["references"], strict=True)]
                lost = rows.join(keys, on, "left_semi")
                action = fk.get("on_delete", "restrict")
                if action == "restrict":
                    if not lost.isEmpty():
                        raise ConstraintError(f"{child} refers to {parent}")
                elif action == "cascade":
                    self._replace(child, rows.join(keys, on, "left_anti"), "delete", lost)
                    self._children(child, lost)
                else:
                    value = {c: F.expr(info["defaults"].get(c, "NULL")) if action == "set_default" else F.lit(None) for c in fk["columns"]}
                    cleared = lost.select(*[value[c].cast(rows.schema[c].dataType).alias(c) if c in value else F.col(c) for c in rows.columns])
                    self._replace(child, rows.join(keys, on, "left_anti").unionByName(cleared), "update", lost)

    # ---------------------------------------------------------- upkeep

    def vacuum(self) -> int:
        """Deletes data folders that no manifest of any branch names; returns how many."""
        named = set()
        root = self._hadoop.Path(f"{self.path}/_branches")
        for b in [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []:
            for v in self._versions(b):
                named |= {f["path"].rpartition("/")[2] for t in self._read(b, v)["tables"].values() for f in t["files"]}
        removed = 0
        for folder in self._fs.listStatus(self._hadoop.Path(self.path)):
            if folder.getPath().getName().startswith("_"):
                continue
            for s in self._fs.listStatus(folder.getPath()):
                if s.getPath().getName() not in named:
                    self._fs.delete(s.getPath(), True)
                    removed += 1
        return removed

    def ddl(self) -> list[str]:
        """Statements that make the tables anew."""
        out = []
        for name, info in self.state()["tables"].items():
            columns = [f"{f.name} {f.dataType.simpleString()}" + " NOT NULL" * (f.name in info["not_null"]) + " AUTOINCREMENT" * (f.name == info["autoincrement"]) + (f" DEFAULT {info['defaults'][f.name]}" if f.name in info["defaults"] else "") for f in T.StructType.fromJson(json.loads(info["schema"]))]
            names = {json.dumps(v): f"CONSTRAINT {k} " for k, v in info.get("named", {}).items()}
            keys = [f"PRIMARY KEY ({', '.join(info['primary_key'])})"] * bool(info["primary_key"])
            keys += [names.get(json.dumps(["unique", u]), "") + f"UNIQUE ({', '.join(u)})" for u in info["unique"]]
            keys += [names.get(json.dumps(["checks", c]), "") + f"CHECK ({c})" for c in info["checks"]]
            keys += [names.get(json.dumps(["foreign_keys", f]), "") + f"FOREIGN KEY ({', '.join(f['columns'])}) REFERENCES {f['table']} ({', '.join(f['references'])}) " + " ".join(f"ON {w.upper()} {f.get(f'on_{w}', 'restrict').replace('_', ' ').upper()}" for w in ("delete", "update")) for f in info["foreign_keys"]]
            out.append(f"CREATE TABLE {name} ({', '.join(columns + keys)})")
        return out


_WORDS = re.compile(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|\w+|.", re.S)


def _mentions(check: str, column: str) -> bool:
    return any(w.strip("`") == column for w in _WORDS.findall(check) if w[0] != "'")


def _mention(check: str, column: str, name: str) -> str:
    """The expression with another name for a column, texts left alone."""
    return "".join(f"`{name}`" if w[0] != "'" and w.strip("`") == column else w for w in _WORDS.findall(check))


def _runs(files: Sequence[Mapping[str, Any]]) -> list[tuple[frozenset[str], list[str]]]:
    """Files by the columns that they hold."""
    found: dict[frozenset[str], list[str]] = {}
    for f in files:
        found.setdefault(frozenset(f["columns"]), []).append(f["path"])
    return list(found.items())


def schema_diff(old: T.StructType, new: T.StructType, table: str) -> list[str]:
    """ALTER statements that turn one schema into the other."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    out = [f"ALTER TABLE {table} DROP COLUMN {n}" for n in a if n not in b]
    out += [f"ALTER TABLE {table} ADD COLUMN {n} {f.dataType.simpleString()}" for n, f in b.items() if n not in a]
    return out + [f"ALTER TABLE {table} ALTER COLUMN {n} TYPE {f.dataType.simpleString()}" for n, f in b.items() if n in a and a[n].dataType != f.dataType]
