import codecs

from lossgauge.sources import files
from lossgauge.sources.delimited import read_delimited, read_delimited_checked, read_table, write_rows


def put(folder, name, text, encoding="utf-8", bom=False):
    path = folder / name
    path.write_bytes((codecs.BOM_UTF8 if bom else b"") + text.replace("\n", "\r\n").encode(encoding))
    return str(path)


def test_losses_by_name_with_markers_and_extra_columns(spark, tmp_path, rows):
    path = put(
        tmp_path,
        "losses.csv",
        "extra,country,year,loss_percentage,food_supply_stage,m49_code\n"
        'q,"Ab, c",2001,1.5,<NA>,7\nq,Xy,20x1,NaN,Storage,\n',
    )
    df = files.read_losses(spark, path)
    assert dict(df.dtypes) == {
        "extra": "string", "country": "string", "year": "int", "loss_percentage": "double",
        "food_supply_stage": "string", "m49_code": "int",
    }
    assert rows(df, "country", "year", "loss_percentage", "food_supply_stage", "m49_code") == [
        ("Ab, c", 2001, 1.5, None, 7),
        ("Xy", None, None, "Storage", None),
    ]


def test_semicolons_byte_order_mark_and_quoted_line_breaks(spark, tmp_path, rows):
    path = put(
        tmp_path,
        "policies.csv",
        "Policy;LPI-category;survey_1;mean;Benefits;Risks;factor_loadings\n"
        '"first ""part""\nsecond";Customs;3;2,2;;bad;0.5\nplain;Timeliness;1;3,8;good;;-0.25\n',
        bom=True,
    )
    df = files.read_policies(spark, path)
    assert df.columns[0] == "Policy"
    found = rows(df, "LPI-category", "survey_1", "mean", "Benefits", "Risks", "factor_loadings")
    assert found == [("Customs", 3, "2,2", None, "bad", 0.5), ("Timeliness", 1, "3,8", "good", None, -0.25)]
    assert 'first "part"' in rows(df, "Policy")[0][0]


def test_latin_1_and_kept_marker(spark, tmp_path, rows):
    path = put(tmp_path, "indicators.csv", "Country Name,Series Name,2007 [YR2007]\nCôte,s,..\nÅland,s,2.5\n", encoding="latin-1")
    assert rows(files.read_indicators(spark, path)) == [("Côte", "s", ".."), ("Åland", "s", "2.5")]


def test_dimensions_and_dotted_header(spark, tmp_path, rows):
    path = put(tmp_path, "countries.csv", "Country;Region;Income\nA;EAST;RICH \nB;WEST;Nan\n", bom=True)
    assert rows(files.read_entities(spark, path)) == [("A", "EAST", "RICH "), ("B", "WEST", "Nan")]
    dotted = put(tmp_path, "dotted.csv", "No.;Policy\n1;x\n", bom=True)
    df = read_delimited(spark, dotted, sep=";", types={"No.": "int"})
    assert df.columns == ["No.", "Policy"] and rows(df) == [(1, "x")]


def test_parquet_rows(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    write_rows(df, str(tmp_path / "kept.parquet"), partition_by=["k"])
    assert rows(read_table(spark, str(tmp_path), "kept"), "n", "k") == rows(df)


def test_good_and_rejected_records_are_all_records(spark, tmp_path, rows):
    path = put(
        tmp_path,
        "damaged.csv",
        "name;year;price;note\n"
        'a;2001;1.5;"two\nlines; one ""field"""\nb;20x1;n/a;fine\nc;2002\nd;2003;2.5;x;more\n;;;\ne;x;y;z\n"f\ng";2004;3;\n',
        bom=True,
    )
    types = {"year": "int", "price": "double"}
    good, rejected = read_delimited_checked(spark, path, types=types, sep=";", multiline=True)
    assert good.columns == ["name", "year", "price", "note"] and dict(good.dtypes)["year"] == "int"
    assert [(r[0], r[1], r[2]) for r in rows(good)] == [("a", 2001, 1.5), ("f\ng", 2004, 3.0), (None, None, None)]
    found = {r["fields"]["name"]: r for r in rejected.collect()}
    assert {k: r["reason"] for k, r in found.items()} == {
        "b": "unreadable: year",
        "c": "wrong number of fields",
        "d": "wrong number of fields",
        "e": "unreadable: year, price",
    }
    assert found["c"]["line"] == "c;2002" and found["b"]["line"] is None and found["b"]["fields"]["year"] == "20x1"
    assert good.count() + rejected.count() == 7


def test_checked_reading_without_a_header_and_in_any_query(spark, tmp_path):
    path = put(tmp_path, "plain.csv", "1,x\n2\n3,y,z\n,w\n")
    good, rejected = read_delimited_checked(spark, path, types={"n": "int"}, names=["n", "t"])
    assert [r["t"] for r in good.select("t").collect()] == ["x", "w"]
    assert good.count() == 2 and rejected.count() == 2 and rejected.select("reason").distinct().count() == 1
