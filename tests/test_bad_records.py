"""Bad records are counted in the scan that reads the good ones."""

from pyspark.sql import types as T

from tablelens.sources.readers import load_checked

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])
LINES = ["a,b,c", "1,x,1.5", "2,y", "three,z,1.0", "4,w,2.5,more", "5,,", ",,", "7,v,NaN"]


def counts(seen):
    return seen.get["records"], seen.get["bad_records"]


def read(spark, tmp_path, **options):
    (tmp_path / "in.csv").write_text("\n".join(LINES) + "\n")
    return load_checked(spark, str(tmp_path / "in.csv"), SCHEMA, **options)


def test_counts_and_lines(spark, tmp_path):
    rows, seen = read(spark, tmp_path)
    got = rows.collect()
    assert sorted(r["_bad_record"] for r in got if r["_bad_record"]) == ["2,y", "4,w,2.5,more", "three,z,1.0"]
    assert counts(seen) == (7, 3)


def test_counts_do_not_depend_on_the_columns_read(spark, tmp_path):
    rows, seen = read(spark, tmp_path, bad="why")
    assert rows.select("a").count() == 7 and rows.columns == ["a", "b", "c", "why"]
    assert counts(seen) == (7, 3)


def test_checksum_is_of_the_rows_not_of_their_order(spark, tmp_path):
    sums = []
    for k, lines in enumerate((LINES[1:], LINES[:0:-1])):
        (tmp_path / f"{k}.csv").write_text("\n".join(lines) + "\n")
        rows, seen = load_checked(spark, str(tmp_path / f"{k}.csv"), SCHEMA, header="false")
        rows.count()
        sums.append(seen.get["checksum"])
    assert sums[0] == sums[1]


def test_json(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a": 1, "b": "x", "c": 2.0}\n{"a": "one"}\nnot json\n')
    rows, seen = load_checked(spark, str(tmp_path / "in.json"), SCHEMA)
    assert len(rows.collect()) == 3 and counts(seen) == (3, 2)
