from tessella.sources.csvio import read_csv
from tessella.store import Store


def write(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_inference_over_all_rows(spark, tmp_path):
    path = write(tmp_path, "name,age,score,ok,code,gap\nann,30,1,true,007,\nbob,-4,2.5,false,x,5\n")
    df = read_csv(spark, path)
    assert df.dtypes == [("name", "string"), ("age", "bigint"), ("score", "double"), ("ok", "boolean"), ("code", "string"), ("gap", "string")]
    assert [tuple(r) for r in df.collect()] == [("ann", 30, 1.0, True, "007", ""), ("bob", -4, 2.5, False, "x", "5")]


def test_strict_forms(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, "a,b,c\n 7,yes,99999999999999999999\n8,true,1\n"))
    assert df.dtypes == [("a", "string"), ("b", "string"), ("c", "double")]


def test_no_header_and_schema(spark, tmp_path):
    path = write(tmp_path, "1,x\n2,y\n")
    assert read_csv(spark, path, header=False).columns == ["col_0", "col_1"]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("s", T.StringType())])
    assert read_csv(spark, path, header=False, schema=schema).dtypes == [("id", "int"), ("s", "string")]


def test_load_from_csv(spark, tmp_path):
    path = write(tmp_path, "name,age,score\nann,30,1.5\nbob,4,2.5\ncyd,9,0.5\n")
    store = Store(spark, str(tmp_path / "store"))
    store.write_table("people", read_csv(spark, path), ["name"])
    assert [tuple(r) for r in store.snapshot("people").ordered().collect()] == [("ann", 30, 1.5), ("bob", 4, 2.5), ("cyd", 9, 0.5)]
    assert sorted(r["row_id"] for r in store.snapshot("people").stored().collect()) == [0, 1, 2]


def test_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, 'a,b\n"say ""hi"", now",1\n"two\nlines",2\n')
    assert [tuple(r) for r in read_csv(spark, path, line_breaks=True).collect()] == [('say "hi", now', 1), ("two\nlines", 2)]
