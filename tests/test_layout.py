import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lossgauge.operators import layout


def test_interleaved_bits(spark):
    rows = [(0b10, 0b01), (0b11, 0b11), (0, 0), (0b01, 0b10)]
    df = spark.createDataFrame(rows, "a long, b long")
    found = df.select(layout.interleaved([F.col("a"), F.col("b")], bits=2).alias("z")).collect()
    assert [r["z"] for r in found] == [0b1001, 0b1111, 0, 0b0110]
    with pytest.raises(ValueError):
        layout.interleaved([F.lit(1)] * 9)


@pytest.mark.parametrize("limit", [3, 10**9])
def test_places_share_the_rows_and_keep_the_order(spark, limit):
    df = spark.createDataFrame([(None,)] * 4 + [("a",)] * 8 + [("b",), ("c",), ("d",), ("e",)], "v string")
    found = {r["v"]: r["_place"] for r in layout.places(df, "v", bits=4, group_limit=limit).collect()}
    assert found == {None: 0, "a": 4, "b": 12, "c": 13, "d": 14, "e": 15}


def test_a_filter_on_any_column_skips_files(spark, tmp_path):
    rows = [(f"r{i * 7 % 8}", 1990 + i * 5 % 16, f"item {i * 11 % 50:02d}", i) for i in range(8000)]
    df = spark.createDataFrame(rows, "region string, year int, item string, n long").repartition(8)
    columns = ["region", "year", "item"]
    layout.write_z_ordered(df, str(tmp_path / "z"), columns, files=64, bits=4)
    stored = spark.read.parquet(str(tmp_path / "z"))
    assert sorted(map(tuple, stored.collect())) == sorted(rows)
    files = list((tmp_path / "z").glob("*.parquet"))
    assert len(files) > 40

    def reads(column, value):
        """Files whose statistics admit the value."""
        hit = 0
        for file in files:
            group = pq.ParquetFile(file).metadata.row_group(0)
            place = pq.ParquetFile(file).schema_arrow.get_field_index(column)
            hit += group.column(place).statistics.min <= value <= group.column(place).statistics.max
        return hit

    for column, value in (("region", "r3"), ("year", 1997), ("item", "item 30")):
        assert reads(column, value) < 0.5 * len(files)
        chosen = stored.filter(F.col(column) == value)
        assert chosen.count() == sum(r[columns.index(column)] == value for r in rows)


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), ("a", None), (None, None)], "k string, n int")
    assert sorted(map(str, layout.z_ordered(df, ["k", "n"], files=2).collect())) == sorted(map(str, df.collect()))
    assert layout.z_ordered(df.limit(0), ["k", "n"], files=2).count() == 0
