"""Temporal queries, branch diffs, and the change stream."""

from datetime import datetime, timedelta

import pytest

from tesselon.operators import history as H
from tesselon.operators.recursive import fixpoint
from tesselon.streaming.changelog import append_changes, applied, follow, replica

T0 = datetime(2026, 1, 1)


def log(spark, *changes):
    return spark.createDataFrame([(k, T0 + timedelta(seconds=s), "users", row, op, None, new, "main", None, k) for k, (s, row, op, new) in enumerate(changes)], H.CHANGE)


def test_as_of(spark):
    found = log(spark, (0, 1, "insert", {"id": "1", "name": "old"}), (60, 1, "update", {"name": "new"}), (90, 1, "delete", None))
    at = lambda s: [r["values"] for r in H.as_of(found, "users", T0 + timedelta(seconds=s)).collect()]
    assert at(30) == [{"id": "1", "name": "old"}]
    assert at(60) == [{"id": "1", "name": "new"}]
    assert at(99) == []
    assert H.between(found, "users", T0, T0 + timedelta(seconds=60)).count() == 2


def test_diff_and_merge(spark):
    a, b = log(spark, (0, 1, "insert", {"n": "x"})), log(spark, (0, 1, "insert", {"n": "y"}), (1, 2, "insert", {"n": "z"}))
    assert sorted(r["side"] for r in H.diff(a, b).collect()) == ["added", "added", "removed"]
    with pytest.raises(ValueError):
        H.merge(a, b)


def test_merge_keeps_changes_of_branches_that_number_alone(spark):
    common = (0, 9, "insert", {"n": "c"})
    a, b = log(spark, common, (1, 1, "insert", {"n": "x"})), log(spark, common, (1, 2, "insert", {"n": "x"}), (2, 1, "update", {"m": "y"}))
    assert sorted(r["row_id"] for r in H.merge(a, b).collect()) == [1, 1, 2, 9]
    other = log(spark, common, (1, 1, "insert", {"n": "z", "k": "1"}))
    merged = H.merge(a, other, lambda ours, theirs: theirs)
    assert merged.count() == 4 and merged.select("id").where("id > 1").count() == 1
    assert {r["row_id"]: r["values"] for r in H.as_of(merged, "users").collect()} == {1: {"n": "z", "k": "1"}, 9: {"n": "c"}}


def test_stream(spark, tmp_path):
    rows = [(1, T0, "users", 1, "insert", {"n": "a"}), (2, T0, "users", 1, "update", {"m": "b"}), (3, T0, "users", 2, "insert", {"n": "c"}), (4, T0, "users", 2, "delete", None), (5, T0, "other", 9, "insert", {})]
    changes = spark.createDataFrame(rows, "lsn bigint, ts timestamp, table_name string, row_id bigint, operation string, new_values map<string,string>")
    append_changes(changes, str(tmp_path / "log"))
    for _ in range(2):
        follow(spark, str(tmp_path / "log"), str(tmp_path / "t"), "users", str(tmp_path / "cp")).awaitTermination()
    state = replica(spark, str(tmp_path / "t"))
    assert sorted((r["row_id"], r["deleted"], r["values"]) for r in state.collect()) == [(1, False, {"n": "a", "m": "b"}), (2, True, {})]
    again = applied(state, changes.where("table_name = 'users'"))
    assert sorted(map(str, again.collect())) == sorted(map(str, state.collect()))


def test_fixpoint_stops(spark):
    seed = spark.range(1)
    assert fixpoint(seed, lambda level: level.selectExpr("(id + 1) % 5 AS id")).count() == 5
