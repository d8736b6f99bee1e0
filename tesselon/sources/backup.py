"""Full, differential and incremental backups of a store's committed tables.

Data folders never change once written, so a backup after a full one copies only the folders that the backups before
it lack: all since the full one (differential) or since the latest one (incremental). Spark copies the rows, and an
order-free sum of row hashes checks them on verifying and restoring.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.sources.store import Store

KINDS = ("full", "differential", "incremental")


class BackupError(RuntimeError):
    """A backup is missing, needed by another one, or differs from what was saved."""


class Backups:
    """The backups of one store under a folder of any file system that Spark knows."""

    def __init__(self, store: Store, path: str):
        self.store, self.spark, self.path = store, store.spark, path.rstrip("/")
        self._hadoop = self.spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, name: str) -> Any:
        return self._hadoop.Path(f"{self.path}/{name}/_manifest")

    def info(self, name: str) -> dict[str, Any]:
        if not self._fs.exists(self._manifest(name)):
            raise BackupError(f"no backup {name!r}")
        stream = self._fs.open(self._manifest(name))
        try:
            return json.loads(stream.readAllBytes().decode())
        finally:
            stream.close()

    def list(self) -> list[dict[str, Any]]:
        """All complete backups, oldest first."""
        root = self._hadoop.Path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted((self.info(n) for n in names if self._fs.exists(self._manifest(n))), key=lambda b: b["created"])

    def _base(self, kind: str) -> dict[str, Any]:
        found = [b for b in self.list() if kind == "incremental" or b["kind"] == "full"]
        if not found:
            raise BackupError(f"a backup of kind {kind!r} needs a full one before it")
        return found[-1]

    def create(self, kind: str = "full", name: str | None = None) -> str:
        """Saves the newest committed version of the store's branch; the manifest comes last, so a broken run leaves no backup."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        name = name or f"{kind}-{uuid.uuid4().hex}"
        if self._fs.exists(self._manifest(name)):
            raise BackupError(f"backup {name!r} exists")
        base = None if kind == "full" else self._base(kind)
        held: dict[str, Any] = base["files"] if base else {}
        version = self.store.version
        state = self.store._read(self.store.branch, version or None)
        files = {}
        for table in state["tables"].values():
            for file in table["files"]:
                folder = file["path"].rpartition("/")[2]
                if folder in held:
                    files[folder] = held[folder]
                    continue
                target = f"{self.path}/{name}/{folder}"
                self.spark.read.parquet(file["path"]).write.mode("overwrite").parquet(target)
                files[folder] = {"in": name} | measured(self.spark.read.parquet(target))
        out = self._fs.create(self._manifest(name), False)
        made = {"name": name, "kind": kind, "base": base["name"] if base else None, "branch": self.store.branch, "version": version, "created": time.time(), "state": state, "files": files}
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        return name

    def _copy(self, folder: str, file: dict[str, Any]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{file['in']}/{folder}")

    def verify(self, name: str) -> bool:
        """Whether all rows that the backup needs, in earlier backups too, are there as they were saved."""
        for folder, file in self.info(name)["files"].items():
            if not self._fs.exists(self._hadoop.Path(f"{self.path}/{file['in']}/{folder}")):
                return False
            if measured(self._copy(folder, file)) != {k: file[k] for k in ("rows", "hash")}:
                return False
        return True

    def restore(self, name: str, into: Store | None = None) -> int:
        """Makes the backup's tables and views the newest version of a store (its own if none is given) and returns that version."""
        store, found = into or self.store, self.info(name)
        if not self.verify(name):
            raise BackupError(f"backup {name!r} is damaged")
        state = found["state"]
        store.begin()
        try:
            for table, info in state["tables"].items():
                for file in info["files"]:
                    folder = file["path"].rpartition("/")[2]
                    file["path"] = f"{store.path}/{table}/{uuid.uuid4().hex}"
                    self._copy(folder, found["files"][folder]).write.parquet(file["path"])
            store._state = state
        except Exception:
            store.rollback()
            raise
        return store.commit()

    def restore_to_time(self, when: float, into: Store | None = None) -> int:
        """Restores the latest backup made at or before ``when`` (seconds since 1970)."""
        found = [b for b in self.list() if b["created"] <= when]
        if not found:
            raise BackupError("no backup is that old")
        return self.restore(found[-1]["name"], into)

    def delete(self, name: str) -> None:
        """Removes a backup that no other one draws on."""
        self.info(name)
        users = [b["name"] for b in self.list() if b["name"] != name and (b["base"] == name or any(f["in"] == name for f in b["files"].values()))]
        if users:
            raise BackupError(f"{name} is needed by {', '.join(users)}")
        self._fs.delete(self._hadoop.Path(f"{self.path}/{name}"), True)

    def clean(self, keep: int) -> list[str]:
        """Removes old backups but the newest ``keep`` and those that these draw on; returns the names removed."""
        if keep < 0:
            raise ValueError("keep must not be negative")
        removed = []
        found = self.list()
        for b in reversed(found[: len(found) - keep]):
            try:
                self.delete(b["name"])
            except BackupError:
                continue
            removed.append(b["name"])
        return removed


def measured(df: DataFrame) -> dict[str, Any]:
    """The number of rows and the sum of their hashes."""
    row = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hash")).first()
    return {"rows": row["rows"], "hash": str(row["hash"] or 0)}
