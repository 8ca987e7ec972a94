"""Publishing, sharing and sweeping of table versions; checks in writes and in one shuffle; content comparison."""

from __future__ import annotations

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terraced.operators import clones, quality
from terraced.session import scratch_path
from terraced.sources import catalog, versions
from terraced.sources.catalog import Warehouse


@pytest.fixture
def wh(spark):
    return Warehouse(spark, f"v{uuid.uuid4().hex[:8]}_", scratch_path(spark, "versions"))


def frames(wh, rows, tables=("a", "b", "c", "d", "e")):
    return {wh.name("p", "core", t): wh.spark.range(rows).withColumn("t", F.lit(t)) for t in tables}


def counts(wh, tables=("a", "b", "c", "d", "e")):
    return [wh.table("p", "core", t).count() for t in tables]


def test_all_or_none(spark, wh):
    wh.publish(frames(wh, 10), scope="s")
    new = frames(wh, 20)
    new[wh.name("p", "core", "d")] = spark.range(5).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        wh.publish(new, scope="s")
    assert counts(wh) == [10] * 5
    with pytest.raises(ValueError, match="range"):
        wh.publish(frames(wh, 20), rules={wh.name("p", "core", "e"): quality.Rules(ranges={"id": F.col("id") < 19})}, scope="s")
    with pytest.raises(ValueError, match="audit"):
        wh.publish(frames(wh, 20), audit=lambda seen: quality.in_range(seen[wh.name("p", "core", "a")], "audit", {"id": F.col("id") < 5}), scope="s")
    assert counts(wh) == [10] * 5
    assert versions.sweep(spark, wh.root, older_than=0) == 0  # what failed left no folder
    wh.publish(frames(wh, 30), scope="s")
    assert counts(wh) == [30] * 5


def test_a_failed_move_is_undone(spark, wh, monkeypatch):
    wh.publish(frames(wh, 10), scope="s")
    point, calls = versions._point, []

    def fails_at_fourth(*args):
        calls.append(args)
        if len(calls) == 4:
            raise RuntimeError("catalog gone")
        point(*args)

    monkeypatch.setattr(versions, "_point", fails_at_fourth)
    with pytest.raises(RuntimeError):
        wh.publish(frames(wh, 20), scope="s")
    monkeypatch.undo()
    assert counts(wh) == [10] * 5
    assert all(df.count() == 10 for df in versions.committed(spark, wh.root, "s").values())


def test_a_lost_driver_between_record_and_names(spark, wh, monkeypatch):
    wh.publish(frames(wh, 10), scope="s")
    point, calls = versions._point, []

    class Lost(BaseException):
        pass

    def dies_at_third(*args):
        calls.append(args)
        if len(calls) == 3:
            raise Lost
        point(*args)

    monkeypatch.setattr(versions, "_point", dies_at_third)
    with pytest.raises(Lost):
        wh.publish(frames(wh, 20), scope="s")
    monkeypatch.undo()
    assert counts(wh) == [20, 20, 10, 10, 10]
    assert {df.count() for df in versions.committed(spark, wh.root, "s").values()} == {20}  # the record is whole
    assert versions.sweep(spark, wh.root, older_than=0) == 2
    assert len(versions.recover(spark, wh.root, "s")) == 3
    assert counts(wh) == [20] * 5
    assert versions.recover(spark, wh.root, "s") == []


def test_new_columns_and_frames_already_read(spark, wh):
    name = wh.name("p", "core", "a")
    wh.publish({name: spark.range(4)})
    before = spark.table(name)
    wh.publish({name: spark.range(7).select(F.col("id").cast("string").alias("other"))})
    assert spark.table(name).columns == ["other"] and spark.table(name).count() == 7
    assert before.count() == 4
    assert wh.write("p", "core", "a", spark.table(name).filter("other > 3")).count() == 3  # from itself


def test_clones_share_files_until_one_side_changes(spark, wh):
    wh.publish(frames(wh, 10, ("a", "b")))
    wh.view("p", "access", "v", wh.name("p", "core", "a"), "id AS renamed")
    wh.view("p", "access", "w", wh.name("p", "access", "v"), "renamed")
    assert clones.apply_clone(wh, "p", "c", replace=False) == "cloned"
    assert wh.table("c", "core", "a").inputFiles() == wh.table("p", "core", "a").inputFiles()
    assert wh.table("c", "access", "w").inputFiles() == wh.table("p", "core", "a").inputFiles()
    assert versions.sweep(spark, wh.root, older_than=0) == 0
    wh.write("c", "core", "a", spark.range(3).withColumn("t", F.lit("x")))
    wh.write("p", "core", "b", spark.range(5).withColumn("t", F.lit("x")))
    assert [wh.table(p, "core", t).count() for p in "pc" for t in "ab"] == [10, 5, 3, 10]
    assert wh.table("c", "access", "w").count() == 10 and wh.table("c", "access", "w").columns == ["renamed"]
    assert versions.sweep(spark, wh.root, older_than=0) == 0  # the old b is the clone's, the old a the source's
    clones.drop_clone(wh, "c", "p")
    assert wh.table("c", "access", "w").count() == 10  # still reads a folder that the sweep must keep
    assert versions.sweep(spark, wh.root, older_than=0) == 1
    assert wh.table("c", "access", "w").count() == 10 and wh.table("c", "core", "b").count() == 10
    clones.drop_clone(wh, "p", "c")
    assert versions.sweep(spark, wh.root, older_than=3600) == 0
    assert versions.sweep(spark, wh.root, older_than=0) == 3


def test_foreign_tables_and_views_are_cloned_by_copy(spark, wh):
    place = wh.ensure(wh.namespace("p", "core"))
    spark.range(6).write.saveAsTable(f"{place}.managed")
    spark.sql(f"CREATE VIEW {place}.summed AS SELECT sum(id) AS s FROM {place}.managed WHERE id > 1")
    assert clones.clone_namespace(wh, place, wh.namespace("c", "core")) == ["managed", "summed"]
    assert wh.table("c", "core", "managed").count() == 6 and wh.table("c", "core", "summed").first()[0] == 14
    assert catalog.drop_namespace(spark, place) == 2
    assert wh.table("c", "core", "managed").count() == 6


def test_tables_made_by_other_means_come_back_when_a_move_fails(spark, wh, monkeypatch):
    place = wh.ensure(wh.namespace("p", "core"))
    spark.range(6).write.saveAsTable(f"{place}.a")
    spark.range(2).write.saveAsTable(f"{place}.b")
    point = versions._point
    monkeypatch.setattr(versions, "_point", lambda sp, name, *rest: point(sp, name, *rest) if name.endswith(".a") else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        wh.publish(frames(wh, 20, ("a", "b")))
    monkeypatch.undo()
    assert counts(wh, ("a", "b")) == [6, 2] and catalog.table_names(spark, place) == ["a", "b"]
    wh.publish(frames(wh, 20, ("a", "b")))
    assert counts(wh, ("a", "b")) == [20, 20] and catalog.table_names(spark, place) == ["a", "b"]


def test_writes_count_what_a_scan_counts(spark, wh):
    df = spark.range(1000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"), (F.col("id") - 10).alias("n")).repartition(9)
    rules = quality.Rules(present=["k", "n"], ranges={"n": F.col("n") >= 0})
    staged = versions.stage(df, wh.root, "x.t", rules)
    scanned = quality.union([quality.not_null(df, "x.t", ["k", "n"]), quality.in_range(df, "x.t", {"n": F.col("n") >= 0})])
    assert staged.row_count == 1000
    assert sorted(staged.checks) == sorted(tuple(r) for r in scanned.collect())
    empty = versions.stage(df.limit(0), wh.root, "x.t", rules)
    assert empty.row_count == 0 and all(n == 0 for *_, n in empty.checks)
    assert versions.frame_of(spark, empty).columns == ["k", "n"]


def test_all_keys_in_one_shuffle(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, None), (None, "y"), (3, "y")], "k int, s string")
    b = spark.createDataFrame([("p",), ("q",)], "k string")
    tables = [("a", a, ["k", "s"], ["k", "s"]), ("b", b, ["k"], ["k"]), ("none", a.limit(0), ["k"], ["s"]), ("rows only", b, ["k"], [])]
    got = sorted(tuple(r) for r in quality.present_and_distinct(tables).collect())
    want = quality.union([f for label, df, present, distinct in tables for f in ([quality.not_null(df, label, present)] + ([quality.unique(df, label, distinct)] if distinct else []))])
    assert got == sorted(tuple(r) for r in want.collect())
    assert ("unique", "a", "s", 1) in got and ("not_null", "a", "k", 2) in got


def plain_difference(one, two):
    first, second = Counter(one), Counter(two)
    keys = {r[0] for r in set(first) | set(second) if first[r] != second[r]}
    return sorted(((k, sum(n for r, n in first.items() if r[0] == k), sum(n for r, n in second.items() if r[0] == k)) for k in keys), key=str)


def test_content_that_counts_do_not_tell_apart(spark):
    rows = [(i, f"v{i % 13}", None if i % 5 else 1.5) for i in range(2000)] + [(None, "n", None)] * 3 + [(7, "again", 0.0)] * 600
    other = [r for r in rows if r[0] not in (11, 12)] + [(13, "v0", None), (14, "v1", None), (None, "n", 1.0)]
    other.remove((None, "n", None))
    other[20] = (other[20][0], None, other[20][2])
    schema = "k int, s string, d double"
    one, two = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema).repartition(5)
    assert one.count() == two.count()
    assert sorted((tuple(r) for r in quality.differing_keys(one, two, "k").collect()), key=str) == plain_difference(rows, other)
    assert quality.differing_keys(one, one.orderBy("s"), "k").count() == 0
    assert quality.differing_keys(one.limit(0), one.limit(0), "k").count() == 0
    assert quality.differing_keys(one.filter("k = 1"), one.limit(0), "k").collect() == [(1, 1, 0)]
    swapped = [(1, "a", None), (2, None, 1.0)]
    assert quality.differing_keys(spark.createDataFrame(swapped, schema), spark.createDataFrame([(1, None, None), (2, "a", 1.0)], schema), "k").count() == 2


def test_projected_table_shares_files_and_stays_apart(spark):
    wh = Warehouse(spark, f"t{uuid.uuid4().hex[:8]}_", scratch_path(spark, "projected"))
    core = wh.write("p", "core", "a", spark.createDataFrame([(1, "x", 2.0), (2, None, None)], "k bigint, v string, w double"))
    wh.project("p", "access", "a", core.select("w", "k"), wh.name("p", "core", "a"))
    seen = wh.view("q", "inbound", "in_a", wh.name("p", "access", "a"))
    wh.project("q", "core", "a", seen.drop("w"), wh.name("q", "inbound", "in_a"))
    assert wh.table("p", "access", "a").columns == ["w", "k"] and wh.table("q", "core", "a").columns == ["k"]
    for table in (wh.table("p", "access", "a"), wh.table("q", "core", "a")):
        assert table.inputFiles() == core.inputFiles()
    assert spark.catalog.getTable(wh.name("q", "core", "a")).tableType == "EXTERNAL"
    wh.write("p", "core", "a", core.limit(0))  # a write to one name reaches no other
    versions.sweep(spark, wh.root, older_than=0)
    assert sorted((r.k, r.w) for r in wh.table("p", "access", "a").collect()) == [(1, 2.0), (2, None)]
    assert sorted(r.k for r in wh.table("q", "core", "a").collect()) == [1, 2]
    wh.write("q", "core", "a", wh.table("p", "access", "a").filter("k = 1"))
    assert wh.table("p", "access", "a").count() == 2 and wh.table("q", "core", "a").count() == 1


def test_stored_files_are_zstd(spark):
    from terraced.session import pin

    wh = Warehouse(spark, f"t{uuid.uuid4().hex[:8]}_", scratch_path(spark, "codec"))
    for stored in (wh.write("p", "core", "a", spark.range(3).toDF("k")), pin(spark.range(3), "codec")):
        assert all(f.endswith(".zstd.parquet") for f in stored.inputFiles())
