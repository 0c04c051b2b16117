import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, synthetic, writers
from millrace.streaming import jobs


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(p)


def test_headers(spark):
    assert readers.tidy_names([" a", "a ", "", "b"]) == ["a", "a_1", "column_3", "b"]


def test_csv_separators_and_header(spark, tmp_path):
    semi = readers.read_table(spark, put(tmp_path, "s.csv", "a;b\n1;x\n2;y\n"))
    assert semi.columns == ["a", "b"] and semi.count() == 2
    tab = readers.read_table(spark, put(tmp_path, "t.txt", "a\tb\n1\tx\n"))
    assert tab.columns == ["a", "b"]
    assert readers.read_table(spark, put(tmp_path, "h.csv", "1,2\n3,4\n"), header=False).count() == 2


def test_encodings(spark, tmp_path):
    bom = readers.read_table(spark, put(tmp_path, "bom.csv", "﻿name,n\nZoë,1\n".encode()))
    assert bom.columns == ["name", "n"] and bom.first()["name"] == "Zoë"
    arabic = readers.read_table(spark, put(tmp_path, "ar.csv", "name,n\nسلام,1\n".encode("cp1256")))
    assert arabic.first()["name"] == "سلام"
    latin = readers.read_csv(spark, put(tmp_path, "l.csv", "name\nZoë\n".encode("latin-1")), encoding="ISO-8859-1")
    assert latin.first()["name"] == "Zoë"


def test_json_and_refusals(spark, tmp_path):
    array = readers.read_table(spark, put(tmp_path, "a.json", '[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]'))
    lines = readers.read_table(spark, put(tmp_path, "l.jsonl", '{"a": 1}\n{"a": 2}\n'))
    assert array.count() == 2 and lines.count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, put(tmp_path, "x.exe", "a"))
    with pytest.raises(ValueError):
        readers.read_table(spark, put(tmp_path, "e.csv", "a,b\n"))


def test_pasted_and_typed(spark):
    p = readers.pasted_table(spark, "name\tage\nAli\t34\nSara\t29\n")
    assert dict(p.dtypes) == {"name": "string", "age": "double"} and p.count() == 2
    t = readers.typed_rows(spark, ["a", "b"], [["1", "x"], ["", None], ["2", "3"]])
    assert dict(t.dtypes) == {"a": "double", "b": "string"} and t.count() == 2


def test_sinks(spark, tmp_path):
    df = spark.range(50).select((49 - F.col("id")).alias("k"), F.lit("a,\"b\"").alias("t"))
    for kind, ext in (("csv", "csv"), ("json", "json"), ("parquet", "parquet")):
        path = str(tmp_path / f"o.{ext}")
        writers.write_table(df, path, kind, index_by="k")
        back = readers.read_table(spark, path)
        assert back.filter("index = k and t = 'a,\"b\"'").count() == 50
    log = writers.log_from_pipeline(spark, [{"step": "a", "rows_out": 10, "cols_out": 3, "notes": []}, {"step": "b", "rows_out": 8, "cols_out": 4, "notes": ["n"]}])
    assert [tuple(r) for r in log.select("row_change", "col_change").orderBy("position").collect()] == [(None, None), (-2, 1)]
    writers.write_log(log, str(tmp_path / "log"), "text")
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["1. a: 10 rows x 3 columns", "2. b: 8 rows x 4 columns - n"]


def test_synthetic(spark):
    df = synthetic.make_dataset(spark, 5000, 10, seed=3)
    assert len(df.columns) == 11 and df.count() == 5000
    share = df.agg(F.avg((F.col("y") == "yes").cast("int")), F.avg(F.col("num_0").isNull().cast("int"))).first()
    assert 0.1 < share[0] < 0.4 and 0.03 < share[1] < 0.07
    assert sorted(map(tuple, df.limit(5).collect())) == sorted(map(tuple, synthetic.make_dataset(spark, 5000, 10, seed=3).limit(5).collect()))


def test_stream_profile_equals_batch(spark, tmp_path):
    from millrace.operators import running
    src = str(tmp_path / "in")
    spark.range(900).select("id", (F.col("id") % 7).cast("double").alias("v"), F.when(F.col("id") % 5 != 0, "t").alias("s")).repartition(6).write.parquet(src)
    table = spark.read.parquet(src)
    out = str(tmp_path / "out")
    jobs.profile_stream(jobs.read_files(spark, src, "*.parquet", table.schema, max_files=2), ["v"], ["s"], out)
    numbers, texts = jobs.stream_profile(spark, out)
    want = running.merged_numbers(running.number_partials(table, ["v"])).first()
    got = numbers.first()
    assert spark.read.parquet(f"{out}/numbers").select("batch").distinct().count() == 3
    assert got["rows"] == 900 and abs(got["std"] - want["std"]) < 1e-12 and texts.first()["missing"] == 180
