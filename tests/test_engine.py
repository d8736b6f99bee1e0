"""Statements over the versioned store, and what they must refuse."""

import pytest

from tesselon.plans.engine import Engine, bind
from tesselon.sources.export import batches, export, shown
from tesselon.sources.store import ConflictError, ConstraintError


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_update_delete(db):
    db.query("CREATE TABLE users (id INTEGER PRIMARY KEY AUTOINCREMENT, email TEXT NOT NULL UNIQUE, active BOOLEAN NOT NULL DEFAULT TRUE)")
    db.query("INSERT INTO users (email) VALUES ('ada'), ('grace')")
    assert rows(db.query("SELECT id, email, active FROM users")) == [(1, "ada", True), (2, "grace", True)]
    assert db.query("UPDATE users SET active = FALSE WHERE email = ?", ["ada"]).first()[0] == 1
    assert rows(db.query("SELECT email FROM users WHERE active = FALSE")) == [("ada",)]
    assert db.query("DELETE FROM users WHERE id = 2").first()[0] == 1
    assert db.query("SELECT COUNT(*) FROM users").first()[0] == 1


def test_constraints(db):
    db.query("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER, CHECK (n > 0))")
    db.query("INSERT INTO t VALUES (1, 5)")
    for bad in ("(1, 6)", "(2, -1)", "(NULL, 1)"):
        with pytest.raises(ConstraintError):
            db.query(f"INSERT INTO t VALUES {bad}")
    assert rows(db.query("SELECT * FROM t")) == [(1, 5)]


def test_upsert(db):
    db.query("CREATE TABLE u (id INTEGER PRIMARY KEY, email VARCHAR(64) UNIQUE)")
    db.query("INSERT INTO u VALUES (1, 'a')")
    assert db.query("INSERT INTO u VALUES (1, 'b') ON CONFLICT DO NOTHING").first()[0] == 0
    db.query("INSERT INTO u VALUES (1, 'c'), (2, 'd') ON CONFLICT (id) DO UPDATE SET email = excluded.email")
    assert rows(db.query("SELECT * FROM u")) == [(1, "c"), (2, "d")]


def test_transaction_and_savepoint(db):
    db.query("CREATE TABLE t (id INTEGER)")
    db.query("BEGIN")
    db.query("INSERT INTO t VALUES (1)")
    db.query("SAVEPOINT s")
    db.query("INSERT INTO t VALUES (2)")
    db.query("ROLLBACK TO s")
    db.query("COMMIT")
    assert rows(db.query("SELECT * FROM t")) == [(1,)]
    db.query("BEGIN")
    db.query("DELETE FROM t")
    db.query("ROLLBACK")
    assert rows(db.query("SELECT * FROM t")) == [(1,)]


def test_foreign_keys(db):
    db.query("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    db.query("CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER REFERENCES p (id) ON DELETE CASCADE)")
    db.query("INSERT INTO p VALUES (1), (2)")
    db.query("INSERT INTO c VALUES (10, 1), (11, 2), (12, NULL)")
    with pytest.raises(ConstraintError):
        db.query("INSERT INTO c VALUES (13, 9)")
    db.query("DELETE FROM p WHERE id = 1")
    assert rows(db.query("SELECT id FROM c")) == [(11,), (12,)]


def test_columns_versions_branches(db):
    db.query("CREATE TABLE t (id INTEGER)")
    db.query("INSERT INTO t VALUES (1)")
    before = db.store.version
    db.query("ALTER TABLE t ADD COLUMN s TEXT DEFAULT 'x'")
    db.query("INSERT INTO t VALUES (2, 'y')")
    assert rows(db.query("SELECT * FROM t")) == [(1, "x"), (2, "y")]
    assert rows(db.store.table("t", before)) == [(1,)]
    db.store.create_branch("b")
    db.store.checkout("b")
    db.query("DELETE FROM t WHERE id = 1")
    assert db.query("SELECT COUNT(*) FROM t").first()[0] == 1
    db.store.checkout("main")
    assert db.query("SELECT COUNT(*) FROM t").first()[0] == 2


def test_parameters_are_values_and_nothing_else(db):
    from datetime import date, datetime
    from decimal import Decimal

    db.query("CREATE TABLE w (id INTEGER PRIMARY KEY, a TEXT, d DATE, ts TIMESTAMP, n DECIMAL(20, 4), b BLOB, x DOUBLE)")
    odd = ["x :p1_0", "'; DELETE", "a\\", " WHERE y", "ON CONFLICT DO NOTHING", "q?$1 -- /*", "it''s, = )"]
    for k, text in enumerate(odd):
        db.query("INSERT INTO w (id, a) VALUES (?, ?)", [k, text])
    assert [r["a"] for r in db.query("SELECT a FROM w ORDER BY id").collect()] == odd
    assert db.query("UPDATE w SET a = ? WHERE a = ? AND a = ?", ["z", "x :p1_0", " OR true OR "]).first()[0] == 0
    assert db.query("DELETE FROM w WHERE a = ? OR a = $1", ["' OR true OR '"]).first()[0] == 0
    values = [date(2020, 2, 3), datetime(2020, 2, 3, 4, 5, 6, 7000), Decimal("12345678901.5"), b"\x00'\xff", -1.5e-300]
    db.query("UPDATE w SET d = ?, ts = ?, n = ?, b = ?, x = ? WHERE a = ?", [*values, odd[2]])
    assert [tuple(r) for r in db.query("SELECT d, ts, n, b, x FROM w WHERE id = 2").collect()] == [(values[0], values[1], Decimal("12345678901.5000"), bytearray(values[3]), values[4])]
    db.query("UPDATE w SET a = 'x WHERE y', d = NULL WHERE id = 1 -- WHERE id = 2")
    db.query("INSERT INTO w (id, a) VALUES (1, 'z ON CONFLICT (id) DO NOTHING') ON CONFLICT (id) DO UPDATE SET a = concat(old.a, ' SET b = ', excluded.a)")
    assert db.query("SELECT a FROM w WHERE id = 1").first()[0] == "x WHERE y SET b = z ON CONFLICT (id) DO NOTHING"
    assert db.query("DELETE FROM w WHERE id IN (?) AND a <> ?", [[1, 2, 3], " WHERE y"]).first()[0] == 2
    with pytest.raises(ValueError):
        db.query("DELETE FROM w WHERE a = ?")


def test_columns_dropped_and_added(db):
    db.query("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT NOT NULL, n INTEGER, CHECK (n > 0))")
    db.query("INSERT INTO t VALUES (1, 'old', 5)")
    db.query("ALTER TABLE t DROP COLUMN a")
    db.query("ALTER TABLE t ADD COLUMN a TEXT DEFAULT 'new'")
    assert rows(db.query("SELECT id, a FROM t")) == [(1, "new")]
    db.query("INSERT INTO t (id, n) VALUES (2, 6)")
    db.query("UPDATE t SET a = 'mine' WHERE id = 1")
    for column in ("id", "n", "none"):
        with pytest.raises((ConstraintError, KeyError)):
            db.query(f"ALTER TABLE t DROP COLUMN {column}")
    db.query("ALTER TABLE t RENAME COLUMN n TO a2")
    db.query("ALTER TABLE t RENAME COLUMN id TO k")
    assert rows(db.query("SELECT k, a, a2 FROM t")) == [(1, "mine", 5), (2, "new", 6)]
    for bad in ("(3, -1)", "(2, 1)"):
        with pytest.raises(ConstraintError):
            db.query(f"INSERT INTO t (k, a2) VALUES {bad}")
    db.query("CREATE TABLE c (k INTEGER REFERENCES t (k))")
    db.query("ALTER TABLE t RENAME COLUMN k TO key")
    with pytest.raises(ConstraintError):
        db.query("INSERT INTO c VALUES (9)")
    db.query("INSERT INTO c VALUES (1)")


def test_explain_analyze(db):
    db.query("CREATE TABLE t (id INTEGER)")
    db.query("INSERT INTO t VALUES (1), (2)")
    lines = [r[0] for r in db.query("EXPLAIN ANALYZE SELECT * FROM t WHERE id > ?", [1]).collect()]
    assert lines[0] == "Rows: 1" and lines[1].startswith("Execution time: ")


def test_view_explain_bind(db):
    db.query("CREATE TABLE t (id INTEGER)")
    db.query("INSERT INTO t VALUES (1), (2), (3)")
    db.query("CREATE VIEW v AS SELECT id FROM t WHERE id > 1")
    assert rows(db.query("SELECT * FROM v WHERE id IN (?)", [[2, 3]])) == [(2,), (3,)]
    assert db.query("EXPLAIN SELECT * FROM t").columns == ["QUERY PLAN"]
    assert bind("a = '?' AND b = $1", [7]) == ("a = '?' AND b = :p0_0", {"p0_0": 7})
    with pytest.raises(ValueError):
        bind("a = ?", [])


def test_export(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, CAST(1.5 AS DECIMAL(4,2)) AS d, X'00FF' AS b, DATE '2020-01-02' AS day")
    export(df, str(tmp_path / "o"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == ['{"a":1,"d":"1.50","b":"AP8=","day":"2020-01-02"}']


@pytest.mark.parametrize("action,left", [("CASCADE", [(10, 7), (11, None)]), ("SET NULL", [(10, None), (11, None)]), ("SET DEFAULT", [(10, 2), (11, None)])])
def test_update_actions(db, action, left):
    db.query("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    db.query(f"CREATE TABLE c (id INTEGER PRIMARY KEY, pid INTEGER DEFAULT 2 REFERENCES p (id) ON DELETE RESTRICT ON UPDATE {action})")
    db.query("INSERT INTO p VALUES (1), (2)")
    db.query("INSERT INTO c VALUES (10, 1), (11, NULL)")
    db.query("UPDATE p SET id = 7 WHERE id = 1")
    assert sorted((tuple(r) for r in db.query("SELECT id, pid FROM c").collect()), key=str) == left


def test_update_restrict(db):
    db.query("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    db.query("CREATE TABLE c (id INTEGER PRIMARY KEY, pid INTEGER REFERENCES p (id))")
    db.query("INSERT INTO p VALUES (1), (2)")
    db.query("INSERT INTO c VALUES (10, 1)")
    with pytest.raises(ConstraintError):
        db.query("UPDATE p SET id = 7 WHERE id = 1")
    db.query("UPDATE p SET id = 8 WHERE id = 2")
    assert rows(db.query("SELECT id FROM p")) == [(1,), (8,)]


def test_rename_and_type(db):
    db.query("CREATE TABLE a (id INTEGER PRIMARY KEY, v TEXT)")
    db.query("CREATE TABLE b (id INTEGER PRIMARY KEY, aid INTEGER REFERENCES a (id))")
    db.query("INSERT INTO a VALUES (1, '5'), (2, NULL)")
    db.query("ALTER TABLE a RENAME TO z")
    db.query("ALTER TABLE z ALTER COLUMN v TYPE BIGINT")
    assert [tuple(r) for r in db.query("SELECT id, v + 1 AS w FROM z ORDER BY id").collect()] == [(1, 6), (2, None)]
    db.query("INSERT INTO b VALUES (1, 1)")
    with pytest.raises(ConstraintError):
        db.query("INSERT INTO b VALUES (2, 9)")
    db.query("INSERT INTO z VALUES (3, 8)")
    with pytest.raises(ConstraintError):
        db.query("INSERT INTO z VALUES (3, 8)")
    db.query("CREATE TABLE s (v TEXT)")
    db.query("INSERT INTO s VALUES ('x')")
    with pytest.raises(ConstraintError):
        db.query("ALTER TABLE s ALTER COLUMN v TYPE INTEGER")


def test_autoincrement_over_many_partitions(db, spark):
    db.query("CREATE TABLE n (id INTEGER PRIMARY KEY AUTOINCREMENT, v BIGINT)")
    db.query("INSERT INTO n VALUES (5, 0)")
    db.store.insert("n", spark.range(1, 101, numPartitions=7).selectExpr("id AS v"))
    assert [r["id"] for r in db.query("SELECT id FROM n ORDER BY v").collect()] == list(range(5, 106))


def test_self_reference_in_one_insert(db):
    db.query("CREATE TABLE e (id INTEGER PRIMARY KEY, boss INTEGER REFERENCES e (id))")
    db.query("INSERT INTO e VALUES (1, NULL), (2, 1)")
    db.query("INSERT INTO e VALUES (3, 2)")
    with pytest.raises(ConstraintError):
        db.query("INSERT INTO e VALUES (4, 9)")


def test_shown(spark):
    df = spark.createDataFrame([(1, "a,b", True), (2, None, False)], "id int, s string, ok boolean")
    assert shown(df, "csv") == 'id,s,ok\n1,"a,b",true\n2,,false\n'
    assert shown(df, "json") == '[{"id": 1, "s": "a,b", "ok": true}, {"id": 2, "s": null, "ok": false}]'
    assert shown(df).splitlines() == ["id | s   | ok", "---+-----+------", "1  | a,b | true", "2  |     | false", "(2 rows)"]
    assert shown(df.limit(0)) == "0 rows returned"
    assert shown(df, max_rows=1).splitlines()[-1] == "(1 of 2 rows)"
    assert [len(x) for x in batches(df.union(df), 3)] == [3, 1]


def test_triggers(db):
    seen = []

    def refuse(table, kind, changed):
        if changed.where("id < 0").count():
            raise ValueError("negative")

    db.store.functions |= {"note": lambda table, kind, changed: seen.append((table, kind, changed.count())), "refuse": refuse}
    db.query("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    db.query("CREATE TRIGGER a AFTER INSERT ON t EXECUTE FUNCTION note()")
    db.query("CREATE TRIGGER b BEFORE INSERT ON t EXECUTE FUNCTION refuse()")
    db.query("INSERT INTO t VALUES (1), (2)")
    with pytest.raises(ValueError):
        db.query("INSERT INTO t VALUES (-1)")
    db.query("DELETE FROM t WHERE id = 1")
    db.query("DROP TRIGGER a")
    db.query("INSERT INTO t VALUES (3)")
    assert seen == [("t", "insert", 2)]
    assert rows(db.query("SELECT * FROM t")) == [(2,), (3,)]
    with pytest.raises(KeyError):
        db.query("CREATE TRIGGER c AFTER DELETE ON t EXECUTE FUNCTION missing()")


def test_named_constraints(db):
    db.query("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    db.query("INSERT INTO t VALUES (1, 5)")
    db.query("ALTER TABLE t ADD CONSTRAINT small CHECK (n < 10)")
    with pytest.raises(ConstraintError):
        db.query("ALTER TABLE t ADD CONSTRAINT big CHECK (n > 10)")
    with pytest.raises(ConstraintError):
        db.query("INSERT INTO t VALUES (2, 11)")
    db.query("ALTER TABLE t DROP CONSTRAINT small")
    db.query("INSERT INTO t VALUES (2, 11)")
    db.query("ALTER TABLE t ADD CONSTRAINT own FOREIGN KEY (id) REFERENCES t (id) ON DELETE CASCADE")
    assert rows(db.query("SELECT * FROM t")) == [(1, 5), (2, 11)]
    with pytest.raises(KeyError):
        db.query("ALTER TABLE t DROP CONSTRAINT small")


def test_unique_index(db):
    db.query("CREATE TABLE t (id INTEGER)")
    db.query("CREATE UNIQUE INDEX i ON t (id)")
    db.query("INSERT INTO t VALUES (1)")
    with pytest.raises(ConstraintError):
        db.query("INSERT INTO t VALUES (1)")
    db.query("DROP INDEX i")
    db.query("INSERT INTO t VALUES (1)")
    assert rows(db.query("SELECT * FROM t")) == [(1,), (1,)]


def test_library_functions_in_statements(db):
    db.query("CREATE TABLE t (id INTEGER PRIMARY KEY, j TEXT, s TEXT)")
    db.query("INSERT INTO t VALUES (1, ?, 'a.b')", ['{"a":{"b":[5,{"c":"DATE_ADD(x"}]}}'])
    db.query("UPDATE t SET s = concat(SPLIT_PART(s, '.', 2), JSON_EXTRACT(j, 'a.b.1.c')) WHERE JSON_EXTRACT(j, 'a.b.0') = '5'")
    db.query("CREATE VIEW v AS SELECT SPLIT_PART(s, '.', 9) AS none, JSON_KEYS(j) AS k FROM t")
    assert rows(db.query("SELECT s FROM t")) == [("bDATE_ADD(x",)]
    assert rows(db.query("SELECT * FROM v")) == [(None, '["a"]')]
    assert db.query("SELECT DATE_ADD(TIMESTAMP '2020-01-31 00:00:00', 1, 'month') = TIMESTAMP '2020-03-01 00:00:00', DATE_DIFF(DATE '2020-01-03', DATE '2020-01-01', 'days')").first() == (True, 2)


def test_schemas(db):
    db.query("CREATE SCHEMA shop")
    db.query("CREATE TABLE shop.items (id INTEGER PRIMARY KEY, label TEXT)")
    db.query("CREATE TABLE items (id INTEGER)")
    db.query("INSERT INTO shop.items VALUES (1, 'shop.items')")
    db.query("UPDATE shop.items SET label = concat(label, '!') WHERE id = 1")
    assert rows(db.query("SELECT i.id, shop.items.label FROM shop.items JOIN shop.items i ON i.id = shop.items.id")) == [(1, "shop.items!")]
    assert db.query("SELECT COUNT(*) FROM items").first()[0] == 0
    with pytest.raises(ConstraintError):
        db.query("DROP SCHEMA shop")
    db.query("DROP SCHEMA shop CASCADE")
    assert [r["table_name"] for r in db.store.tables().collect()] == ["items"]


def test_merged_branches_and_reverted_versions(db):
    import time

    for t in ("a", "b"):
        db.query(f"CREATE TABLE {t} (id INTEGER PRIMARY KEY)")
        db.query(f"INSERT INTO {t} VALUES (1)")
    store, before, when = db.store, db.store.version, time.time()
    store.create_branch("dev")
    db.query("INSERT INTO a VALUES (2)")
    store.checkout("dev")
    db.query("INSERT INTO b VALUES (3)")
    store.checkout("main")
    assert store.merge_branch("dev") == ["b"]
    assert rows(db.query("SELECT * FROM a")) == [(1,), (2,)] and rows(db.query("SELECT * FROM b")) == [(1,), (3,)]
    store.checkout("dev")
    db.query("INSERT INTO a VALUES (9)")
    store.checkout("main")
    with pytest.raises(ConflictError):
        store.merge_branch("dev")
    assert store.merge_branch("dev", lambda name: "theirs") == ["a"]
    assert rows(db.query("SELECT * FROM a")) == [(1,), (9,)]
    assert store.version_at(when) == before
    store.revert(before)
    assert rows(db.query("SELECT * FROM a")) == [(1,)] == rows(db.query("SELECT * FROM b"))


def test_dump_makes_the_same_tables(db, spark, tmp_path):
    db.query("CREATE TABLE p (id INTEGER PRIMARY KEY AUTOINCREMENT, s VARCHAR(3) DEFAULT 'a', CONSTRAINT odd CHECK (id % 2 = 1), CONSTRAINT one UNIQUE (s))")
    db.query("CREATE TABLE c (p INTEGER, CONSTRAINT up FOREIGN KEY (p) REFERENCES p (id) ON DELETE CASCADE)")
    other = Engine(spark, str(tmp_path / "other"))
    for text in db.store.ddl():
        other.query(text)
    assert other.store.ddl() == db.store.ddl()
    assert sorted(map(str, other.store.constraints().collect())) == sorted(map(str, db.store.constraints().collect()))
    other.query("ALTER TABLE p DROP CONSTRAINT odd")
    other.query("INSERT INTO p (s) VALUES ('x'), ('y')")
    assert {(r["kind"], r["name"]) for r in other.store.catalog().collect()} == {("table", "p"), ("table", "c")}


def test_database_interface(spark, tmp_path):
    from tesselon import dbapi

    with dbapi.connect(spark, str(tmp_path / "d")) as con:
        cur = con.cursor()
        cur.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT)")
        assert cur.executemany("INSERT INTO t VALUES (?, ?)", [(k, f"s{k}") for k in range(3)]).rowcount == 3
    cur.execute("SELECT id, s FROM t WHERE id > ? ORDER BY id", [0])
    assert [d[0] for d in cur.description] == ["id", "s"]
    assert cur.fetchone() == (1, "s1") and cur.fetchmany(5) == [(2, "s2")] and cur.fetchall() == []
    assert cur.execute("DELETE FROM t").rowcount == 3
    con.rollback()
    assert len(cur.execute("SELECT * FROM t").fetchall()) == 3
    with pytest.raises(dbapi.ProgrammingError):
        cur.execute("SELECT nothing FROM t")
    con.close()
    with pytest.raises(dbapi.InterfaceError):
        con.cursor()
