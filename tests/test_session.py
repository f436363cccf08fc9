from types import SimpleNamespace

import pytest

from lossgauge import session


def fake(master, folder=None, current=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: current, setCheckpointDir=lambda path: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: folder or default))


def test_folder_comes_from_the_session(tmp_path):
    assert session.checkpoint_dir(fake("spark://host:7077", folder="/shared/x")) == "/shared/x"
    assert session.checkpoint_dir(fake("spark://host:7077", current="/shared/y")) == "/shared/y"
    assert session.checkpoint_dir(fake("local[4]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(fake("yarn"))


def test_stored_table_keeps_schema_and_can_be_dropped(spark, rows):
    df = spark.createDataFrame([(1, None, "x")], "a int, `b c (d)` double, e string")
    other = session.stable(df)
    with session.intermediate_tables(spark) as written:
        kept = session.stable(df)
        assert kept.schema == df.schema and rows(kept) == rows(df)
    assert len(written) == 1
    with pytest.raises(Exception):
        spark.read.parquet(written[0]).count()
    assert rows(other) == rows(df)


def test_sorted_buckets_meet_without_a_shuffle_and_go_with_the_scope(spark):
    some = spark.createDataFrame([(i % 50, i) for i in range(500)], "k int, v int")
    with session.intermediate_tables(spark) as written:
        names = [session.sorted_buckets(some, ["k"]), session.sorted_buckets(some.filter("v < 100"), ["k"])]
        left, right = (spark.table(n) for n in names)
        joined = left.hint("merge").join(right.withColumnRenamed("v", "w"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.count() == 50 * 10 * 2
        session.drop_buckets(spark, names[:1])
        assert not spark.catalog.tableExists(names[0]) and right.count() == 100
        assert len(written) == 2
        session.drop_buckets(spark, names[1:])


def test_folders_of_a_scope_are_deleted(spark):
    with session.intermediate_tables(spark):
        folder = session.intermediate_folder(spark)
        spark.range(5).write.parquet(folder)
    with pytest.raises(Exception):
        spark.read.parquet(folder).count()
