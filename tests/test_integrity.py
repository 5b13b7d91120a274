"""Incremental feed, versioned state, orphan references, salted joins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.operators.changes import ChangeFeed, content_hash, latest_handled
from ctxloom.operators.orphans import orphan_references, parent_intervals
from ctxloom.operators.skew import salted_join
from ctxloom.operators.state import ConcurrentRun, VersionedState
from ctxloom.tables import current_files, scratch

KEYS = {"k": T.StringType()}
ROW = "k string, content_hash string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def feed(spark):
    return ChangeFeed(spark, scratch(spark, "t"), KEYS)


def test_first_run_sees_all_then_only_changes(spark):
    f = feed(spark)
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], ROW)
    assert rows(f.pending(now, with_status=True), "k", "status") == [("a", "new"), ("b", "new")]
    f.run(now, lambda todo: None)
    assert f.pending(now).count() == 0
    later = spark.createDataFrame([("a", "9"), ("b", "2"), ("c", "3")], ROW)
    assert rows(f.pending(later, with_status=True), "k", "status") == [("a", "changed"), ("c", "new")]


def test_failed_run_is_repeated_and_nothing_is_lost(spark):
    f = feed(spark)
    now = spark.createDataFrame([("a", "1")], ROW)
    with pytest.raises(RuntimeError):
        f.run(now, lambda todo: (_ for _ in ()).throw(RuntimeError("died")))
    assert rows(f.pending(now), "k") == [("a",)]
    f.run(now, lambda todo: todo.count())
    assert f.pending(now).count() == 0


def test_null_keys_hashes_and_empty_tables(spark):
    f = feed(spark)
    now = spark.createDataFrame([(None, "1"), ("n", None)], ROW)
    assert f.pending(now).count() == 2
    f.run(now, lambda todo: None)
    assert f.pending(now).count() == 0
    assert f.pending(spark.createDataFrame([], ROW)).count() == 0
    wide = now.withColumn("handled_hash", F.lit("x")).withColumn("status", F.lit(1))
    assert f.pending(wide).count() == 0


def test_advance_takes_out_what_is_gone(spark):
    f = feed(spark)
    now = spark.createDataFrame([("a", "1"), ("b", "2")], ROW)
    f.run(now, lambda todo: None)
    f.advance(spark.createDataFrame([], ROW), spark.createDataFrame([("a",)], "k string"))
    assert rows(f.pending(now), "k") == [("a",)]


def test_staged_version_is_not_in_force(spark):
    s = VersionedState(spark, scratch(spark, "s"), T.StructType([T.StructField("v", T.IntegerType())]))
    assert s.read().count() == 0
    s.commit(spark.createDataFrame([(1,)], "v int"))
    s.stage(spark.createDataFrame([(2,)], "v int"))
    assert rows(s.read(), "v") == [(1,)]
    s.commit(spark.createDataFrame([(3,)], "v int"))
    assert rows(s.read(), "v") == [(3,)]


def test_ledger_counts_only_successful_runs(spark):
    t = dt.datetime(2025, 1, 1)
    led = spark.createDataFrame([(1, "a", "old", t), (2, "a", "new", t + dt.timedelta(1)), (3, "a", "bad", t + dt.timedelta(2)), (4, "b", "x", t)], "run_id long, k string, content_hash string, processed_at timestamp_ntz")
    runs = spark.createDataFrame([(1, "done"), (2, "running"), (2, "done"), (3, "failed")], "id long, state string")
    assert rows(latest_handled(led, runs, ["k"]), "k", "handled_hash") == [("a", "new")]


def test_content_hash_separates_columns(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "x string, y string")
    assert df.select(content_hash("x", "y").alias("h")).distinct().count() == 4


def test_current_file_is_the_newest(spark):
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("p", "a", "1", t), ("p", "a", "2", t + dt.timedelta(1)), ("p", "a", "3", None), ("p", "a", "2", t + dt.timedelta(1))], "project_id string, path string, content_hash string, indexed_at timestamp_ntz")
    assert rows(current_files(df), "content_hash") == [("2",)]


def test_orphan_statuses(spark):
    day = dt.datetime(2025, 1, 1)
    refs = spark.createDataFrame([("p", "x", "1", day), ("p", "gone", "2", day), ("p", "late", "3", day), ("p", "ok", "4", day), ("p", None, "5", day), ("q", "ok", "6", day), ("p", "late", "7", None)], "project_id string, key string, ref_key string, at timestamp_ntz")
    parents = spark.createDataFrame(
        [("p", "gone", day - dt.timedelta(9), day - dt.timedelta(1)), ("p", "late", day + dt.timedelta(1), None), ("p", "ok", day - dt.timedelta(1), None), ("p", "ok", None, None)], "project_id string, key string, a timestamp_ntz, b timestamp_ntz"
    )
    got = orphan_references(refs, parent_intervals(parents, valid_from="a", valid_to="b"), ref_time="at")
    assert rows(got, "ref_key", "status") == [("1", "missing"), ("2", "deleted"), ("3", "late"), ("6", "missing")]


def test_orphans_on_empty_and_clashing_tables(spark):
    empty = spark.createDataFrame([], "project_id string, key string")
    refs = spark.createDataFrame([("p", "x", "1", 5, "old")], "project_id string, key string, ref_key string, valid_from int, status string")
    assert rows(orphan_references(refs, parent_intervals(empty)), "ref_key", "status") == [("1", "missing")]
    none = spark.createDataFrame([], "project_id string, key string, ref_key string")
    assert orphan_references(none, parent_intervals(empty)).count() == 0


@pytest.mark.parametrize("hot", [1, 10_000])
def test_salted_join_equals_plain_join(spark, hot):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2), ("z", 3)], "k string, i int")
    right = spark.createDataFrame([("h", "H"), ("c", "C"), (None, "N")], "k string, v string")
    got = rows(salted_join(left, right, ["k"], "left", salt_from=["i"], salts=4, hot_rows=hot).na.fill("-"), "i", "v")
    want = sorted([(i, "H") for i in range(50)] + [(1, "C"), (2, "N"), (3, "-")])
    assert got == want


def test_only_one_run_follows_a_version(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    state = VersionedState(spark, f"file://{tmp_path}/s", schema)
    rows = lambda n: spark.createDataFrame([(n,)], schema)
    state.commit(rows(1), None)
    with pytest.raises(ConcurrentRun):
        state.commit(rows(2), None)
    base = state.current()
    one, two = state.stage(rows(3)), state.stage(rows(4))
    state.publish(one, base)
    with pytest.raises(ConcurrentRun):
        state.publish(two, base)
    assert state.read().first().a == 3
    base = state.current()  # a run that claims and dies before the swap is completed by the next
    state._write(f"NEXT-{base}", two, False)
    with pytest.raises(ConcurrentRun):
        state.publish(state.stage(rows(5)), base)
    assert state.read().first().a == 4
