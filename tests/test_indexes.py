"""Indexes of files: merged by priority, and what to fetch by them."""

from voxelweave.operators import masks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_the_last_index_wins(spark):
    remote = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 9)], "path string, hash int")
    previous = spark.createDataFrame([("b", 20), ("c", 30), ("d", 40), ("d", 41), ("d", None)], "path string, hash int")
    members = spark.createDataFrame([("c", 3)], "path string, hash int")
    found = masks.merge_indexes(remote, previous, members)
    assert rows(found) == sorted([("a", 1, 0), ("b", 20, 1), ("c", 3, 2), ("d", 41, 1), (None, 9, 0)], key=str)


def test_indexes_with_other_columns_and_without_rows(spark):
    a = spark.createDataFrame([("x", 1)], "path string, hash int")
    b = spark.createDataFrame([("x", 7.5), ("y", 8.5)], "path string, size double")
    found = masks.merge_indexes(a, b, a.limit(0))
    assert found.columns == ["path", "hash", "size", "source"]
    assert rows(found) == [("x", None, 7.5, 1), ("y", None, 8.5, 1)]
    assert rows(masks.merge_indexes(a.limit(0))) == []


def test_what_to_fetch(spark):
    members = spark.createDataFrame([("same", "1"), ("changed", "2"), ("unknown", "3"), ("bare", "4"), ("absent", "5"), (None, "6")], "path string, hash string")
    present = spark.createDataFrame([("same",), ("same",), ("changed",), ("unknown",), ("bare",), ("own",)], "path string")
    previous = spark.createDataFrame([("same", "1"), ("changed", "0"), ("bare", None), ("absent", "5")], "path string, hash string")
    missing = [(None, "missing"), ("absent", "missing")]
    assert rows(masks.index_downloads(members, present, previous)) == sorted(missing, key=str)
    wanted = [*missing, ("changed", "changed"), ("unknown", "changed"), ("bare", "changed")]
    assert rows(masks.index_downloads(members, present, previous, refresh=True)) == sorted(wanted, key=str)


def test_tasks_send_one_row_for_each_key(spark):
    a = spark.createDataFrame([("x", 1)], "path string, hash int")
    plan = masks.merge_indexes(a, a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_max" in plan and "Window" not in plan
