"""Versioned tables: commits as a whole, only changed buckets, conflicts, runs that come again."""

import pytest
from pyspark.sql import functions as F

from casestream.session import scratch
from casestream.sources.versioned import Conflict, VersionedTable

SCHEMA = "id bigint, v string"


def made(spark, n=40, buckets=8):
    rows = spark.range(n).select("id", F.concat(F.lit("v"), "id").alias("v"))
    return VersionedTable.create(rows, scratch(spark, "versioned-test"), ["id"], buckets)


def values(table, version=None):
    return {r.id: r.v for r in table.read(version).collect()}


def test_one_changed_row_of_a_million_rewrites_one_bucket(spark):
    table = made(spark, 1_000_000, 64)
    assert table.upsert(spark.createDataFrame([(7, "new")], SCHEMA))
    old, new = (table.manifest(v)["parts"] for v in (0, 1))
    assert sum(old[b] != new[b] for b in old) == 1 and len(new) == 64
    assert table.read().count() == 1_000_000 and table.read().where("id = 7").first().v == "new" and table.read(0).where("id = 7").first().v == "v7"


def test_upserts_deletes_and_null_keys(spark):
    table = made(spark)
    table.upsert(spark.createDataFrame([(3, "x"), (100, "y"), (None, "z")], SCHEMA))
    table.delete(spark.createDataFrame([(5,), (None,), (999,)], "id bigint"))
    want = {i: f"v{i}" for i in range(40) if i != 5} | {3: "x", 100: "y"}
    assert values(table) == want and values(table, 0) == {i: f"v{i}" for i in range(40)}
    table.delete(table.read().select("id"))
    assert values(table) == {} and table.read().columns == ["id", "v"]
    table.upsert(spark.createDataFrame([(1, "back")], SCHEMA))
    assert values(table) == {1: "back"}


def test_empty_tables_and_changes(spark):
    table = VersionedTable.create(spark.createDataFrame([], SCHEMA), scratch(spark, "versioned-test"), ["id"])
    assert values(table) == {}
    assert table.upsert(spark.createDataFrame([], SCHEMA)) and table.versions() == [0, 1] and values(table) == {}
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, scratch(spark, "no-table")).read()


def test_what_no_manifest_names_is_not_read(spark, monkeypatch):
    table = made(spark)

    def stop(self, manifest):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(VersionedTable, "_publish", stop)
        table.upsert(spark.createDataFrame([(1, "half")], SCHEMA))
    assert values(table)[1] == "v1" and table.versions() == [0]
    assert len(table.vacuum()) == 1 and values(table)[1] == "v1"


def test_a_run_counts_once(spark):
    table = made(spark)
    change = spark.createDataFrame([(1, "a")], SCHEMA)
    assert table.upsert(change, "job", 4) and not table.upsert(spark.createDataFrame([(1, "b")], SCHEMA), "job", 4)
    assert values(table)[1] == "a" and table.applied("job") == 4 and table.applied("other") == -1
    assert table.upsert(spark.createDataFrame([(1, "c")], SCHEMA), "other", 0) and table.applied("job") == 4


def test_a_conflict_starts_over_from_the_new_version(spark, monkeypatch):
    table, other = made(spark), None
    other = VersionedTable(spark, table.path)
    real, done = VersionedTable._publish, []

    def late(self, manifest):
        if self is table and not done:
            done.append(1)
            other.upsert(spark.createDataFrame([(2, "other")], SCHEMA))
        real(self, manifest)

    monkeypatch.setattr(VersionedTable, "_publish", late)
    assert table.upsert(spark.createDataFrame([(1, "mine")], SCHEMA))
    assert values(table)[1] == "mine" and values(table)[2] == "other" and table.versions() == [0, 1, 2]
    done.clear()
    with pytest.raises(Conflict):
        table.update(spark.createDataFrame([(1, "x")], SCHEMA), lambda rows, new: rows, tries=1)


def test_vacuum_keeps_what_is_named(spark):
    table = made(spark)
    for k in range(4):
        table.upsert(spark.createDataFrame([(k, f"new{k}")], SCHEMA))
    before = values(table)
    table.vacuum(keep=1)
    assert table.versions() == [4] and values(table) == before
