"""Backups: what each kind copies, what restoring gives back, and what is refused."""

import shutil

import pytest

from tesselon.plans.engine import Engine
from tesselon.sources.backup import BackupError, Backups


@pytest.fixture
def db(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "db"))
    made.query("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    made.query("INSERT INTO t VALUES (1, 'a'), (2, NULL)")
    return made


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_kinds_and_restore(db, tmp_path):
    saved = Backups(db.store, str(tmp_path / "saved"))
    with pytest.raises(BackupError):
        saved.create("incremental")
    saved.create("full", "f")
    db.query("INSERT INTO t VALUES (3, 'c')")
    saved.create("incremental", "i")
    db.query("INSERT INTO t VALUES (4, 'd')")
    saved.create("differential", "d")
    assert [b["name"] for b in saved.list()] == ["f", "i", "d"]
    copied = {b["name"]: sum(f["in"] == b["name"] for f in b["files"].values()) for b in saved.list()}
    assert copied == {"f": 1, "i": 1, "d": 2}
    db.query("DELETE FROM t WHERE id > 0")
    saved.restore("i")
    assert rows(db.query("SELECT * FROM t")) == [(1, "a"), (2, None), (3, "c")]
    other = Engine(db.spark, str(tmp_path / "other"))
    saved.restore("d", other.store)
    assert rows(other.query("SELECT id FROM t")) == [(1,), (2,), (3,), (4,)]
    assert saved.restore_to_time(saved.info("f")["created"]) and rows(db.query("SELECT id FROM t")) == [(1,), (2,)]
    with pytest.raises(BackupError):
        saved.restore_to_time(0)


def test_delete_verify_and_clean(db, tmp_path):
    saved = Backups(db.store, str(tmp_path / "saved"))
    saved.create("full", "f")
    saved.create("incremental", "i")
    assert saved.verify("f") and saved.verify("i")
    with pytest.raises(BackupError):
        saved.delete("f")
    saved.create("full", "g")
    assert saved.clean(1) == ["i", "f"] and [b["name"] for b in saved.list()] == ["g"]
    folder = next(iter(saved.info("g")["files"]))
    shutil.rmtree(tmp_path / "saved" / "g" / folder)
    assert not saved.verify("g")
    with pytest.raises(BackupError):
        saved.restore("g")
    assert rows(db.query("SELECT id FROM t")) == [(1,), (2,)]


def test_empty_store(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "none"))
    saved = Backups(db.store, str(tmp_path / "saved"))
    saved.create("full", "f")
    assert saved.verify("f") and saved.info("f")["files"] == {}
