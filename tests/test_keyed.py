"""Keyed tables: changes, versions, conflicts, lookups, against a plain dictionary."""

from __future__ import annotations

import random

import pytest

from siltstone.errors import ConflictError, IntegrityError, NotFoundError, ValidationError
from siltstone.operators.keyed import KeyedTable, create_keyed

SCHEMA = "id string, uri string, n int"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def held(table, version=None):
    return {r.id: (r.uri, r.n) for r in table.rows(version).collect()}


@pytest.fixture
def table(spark, tmp_path):
    return create_keyed(spark, str(tmp_path / "t"), rows(spark).schema, "id", ("uri",), buckets=4)


def test_changes_follow_each_other(spark, table):
    assert table.version() == 0 and held(table) == {}
    assert table.add(rows(spark, ("a", "u1", 1), ("b", "u2", 2), ("c", None, 3), ("d", None, 4))) == 1
    assert table.update(rows(spark, ("b", "u3", 20))) == 2
    # A value that was given up can be taken, within one change as well.
    assert table.upsert(rows(spark, ("a", "u2", 10), ("e", "u1", 5))) == 3
    assert table.delete(spark.createDataFrame([("c",), ("zz",)], "id string")) == 4
    now = {"a": ("u2", 10), "b": ("u3", 20), "d": (None, 4), "e": ("u1", 5)}
    assert held(table) == now and held(table, 1)["b"] == ("u2", 2) and len(held(table, 3)) == 5
    assert table.compact() == 5 and held(table) == now and len(table.changes()) == 1
    assert table.add(rows(spark, ("c", "u9", 7))) == 6 and held(table) == {**now, "c": ("u9", 7)}
    assert [r.n for r in table.get("c").collect()] == [7] and not table.get("zz").collect()
    assert held(KeyedTable(spark, table.path)) == {**now, "c": ("u9", 7)}


def test_rules(spark, table):
    table.add(rows(spark, ("a", "u1", 1), ("b", "u2", 2)))
    for change, error, words in (
        (lambda: table.add(rows(spark, ("a", "x", 1))), IntegrityError, "id 'a' already exists"),
        (lambda: table.add(rows(spark, ("x", "u2", 1))), IntegrityError, "uri 'u2' already exists"),
        (lambda: table.add(rows(spark, ("x", "y", 1), ("x", "z", 1))), IntegrityError, "id 'x' occurs twice"),
        (lambda: table.add(rows(spark, ("x", "y", 1), ("z", "y", 1))), IntegrityError, "uri 'y' occurs twice"),
        (lambda: table.add(rows(spark, (None, "y", 1))), ValidationError, "id is null"),
        (lambda: table.update(rows(spark, ("x", "y", 1))), NotFoundError, "id 'x' does not exist"),
        (lambda: table.update(rows(spark, ("a", "u2", 1))), IntegrityError, "uri 'u2' already exists"),
        (lambda: table.upsert(rows(spark, ("x", "u1", 1))), IntegrityError, "uri 'u1' already exists"),
        (lambda: table.add(spark.range(1)), ValidationError, "rows lack"),
    ):
        with pytest.raises(error, match=words):
            change()
    assert table.version() == 1 and held(table) == {"a": ("u1", 1), "b": ("u2", 2)}
    table.update(rows(spark, ("a", "u1", 9)))  # a row may keep its own value
    table.upsert(rows(spark, ("a", "u1", 1), ("a", "u1", 2)), order=["n"])
    assert held(table)["a"] == ("u1", 2)


def test_two_writers_never_lose_an_update(spark, table):
    table.add(rows(spark, ("a", "u1", 0)))
    other = KeyedTable(spark, table.path)
    seen = table.version(), other.version()
    table.update(rows(spark, ("a", "u1", 1)), base=seen[0])
    with pytest.raises(ConflictError):
        other.update(rows(spark, ("a", "u1", 2)), base=seen[1])
    assert held(table) == {"a": ("u1", 1)}
    folders = {f"_change={x.folder}" for v in range(1, table.version() + 1) for x in table.changes(v)}
    assert set(table.files.names("data")) == folders  # the refused change left nothing
    tries = []

    def increment():
        base = other.version() if tries else seen[1]
        tries.append(base)
        return other.update(rows(spark, ("a", "u1", held(other, base)["a"][1] + 1)), base=base)

    assert other.retried(increment) == 3 and len(tries) == 2 and held(table) == {"a": ("u1", 2)}


def test_an_append_writes_its_rows_only_and_a_lookup_reads_one_bucket(spark, table):
    table.add(spark.range(1000).selectExpr("concat('k', id) as id", "concat('u', id) as uri", "cast(id as int) as n"))
    table.add(rows(spark, ("new", "uri", 1)))
    assert spark.read.parquet(f"{table.path}/data/_change={table.changes()[-1].folder}").count() == 1
    plan = table.get("k7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert table.get("k7").first().n == 7


def test_random_changes_equal_a_dictionary(spark, table):
    dice, known = random.Random(3), {}
    for step in range(10):
        keys = dice.sample("abcdefghij", 3)
        if step % 3 == 2:
            table.delete(spark.createDataFrame([(k,) for k in keys], "id string"))
            known = {k: v for k, v in known.items() if k not in keys}
        else:
            table.upsert(rows(spark, *((k, f"{k}{step}", step) for k in keys)))
            known |= {k: (f"{k}{step}", step) for k in keys}
        if step == 5:
            table.compact()
    assert held(table) == known


def test_creation(spark, tmp_path):
    with pytest.raises(NotFoundError):
        KeyedTable(spark, str(tmp_path / "none"))
    with pytest.raises(ValidationError):
        create_keyed(spark, str(tmp_path / "t"), rows(spark).schema, "nope")
    first = create_keyed(spark, str(tmp_path / "t"), rows(spark).schema, "id", buckets=2)
    assert create_keyed(spark, str(tmp_path / "t"), rows(spark).schema, "id", buckets=9).buckets == first.buckets


def test_staged_rows_are_seen_when_committed(spark, table):
    table.add(rows(spark, ("a", "u1", 1)))
    data = table._read(table.changes(), None).count
    with table.staged(rows(spark, ("a", "u1", 2), ("b", None, 3)), table.version()) as change:
        assert held(table) == {"a": ("u1", 1)} and change.rows.count() == 2
        assert table.upsert_staged(change) == 2
    assert held(table) == {"a": ("u1", 2), "b": (None, 3)} and data() == 1
    # What is not committed leaves no trace, nor does a change that another writer was faster than.
    folders = table.files.names("data")
    with pytest.raises(IntegrityError):
        with table.staged(rows(spark, ("c", None, 3), ("c", None, 4)), table.version()) as change:
            table.upsert_staged(change)
    with pytest.raises(ConflictError):
        with table.staged(rows(spark, ("c", None, 3)), 1) as change:
            table.upsert_staged(change)
    assert table.files.names("data") == folders and len(held(table)) == 2
