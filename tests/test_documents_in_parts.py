import json

from pyspark.sql import functions as F

from loomfield.sources import readers, writers


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_parts_of_many_tasks_are_one_document(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("ü,\n[]"), F.col("id").cast("string"))).alias("t")).repartition(7, "id").where("id > 20")
    assert writers.write_document(df, str(tmp_path / "d")) == 979
    assert len(list((tmp_path / "d").glob("part-*.txt"))) > 1  # several tasks wrote
    got = json.loads(text_of(tmp_path / "d"))
    assert sorted(r["id"] for r in got) == list(range(21, 1000)) and {"id": 21, "t": None} in got and {"id": 22, "t": "ü,\n[]22"} in got
    rows, frame = readers.read_document(spark, str(tmp_path / "d"), "id long, t string")
    assert frame == "[]" and sorted(map(tuple, rows.collect())) == sorted((r["id"], r["t"]) for r in got)
    writers.join_parts(spark, str(tmp_path / "d"), str(tmp_path / "one.json"))
    assert json.loads((tmp_path / "one.json").read_text()) == got
    assert {r.id for r in readers.read_json(spark, str(tmp_path / "one.json")).collect()} == set(range(21, 1000))
    writers.write_document(df, str(tmp_path / "sorted"), order=["id"])
    assert [r["id"] for r in json.loads(text_of(tmp_path / "sorted"))] == list(range(21, 1000))


def test_empty_partitions_and_no_rows(spark, tmp_path):
    few = spark.range(0, 100, 1, 9).where("id in (50, 51)")
    writers.write_document(few, str(tmp_path / "few"))
    assert sorted(r["id"] for r in json.loads(text_of(tmp_path / "few"))) == [50, 51]
    writers.write_envelope(few.where("id < 0"), str(tmp_path / "none"), "s", "u", "t")
    assert json.loads(text_of(tmp_path / "none")) == {"metadata": {"source": "s", "scrape_time": "t", "url": "u", "record_count": 0, "format_version": "1.0"}, "data": []}
    assert readers.read_document(spark, str(tmp_path / "none"), "id long")[0].collect() == []
    assert writers.write_envelope(few, str(tmp_path / "two"), "s", "u", "t", ["id"]) == 2
    assert json.loads(text_of(tmp_path / "two"))["metadata"]["record_count"] == 2


def test_files_that_tasks_make(spark):
    from loomfield.sources import documents

    df = spark.range(0, 95, 1, 4).select("id", F.when(F.col("id") % 2 > 0, F.concat(F.lit("ü'\""), F.col("id").cast("string"))).alias("a b"))
    files = writers.sqlite_files(df, "my table", 10)
    paths = [r.path for r in files.collect()]
    assert len(paths) == len(set(paths)) == 4 * 3 and all(p.endswith(".db") for p in paths)
    got = documents.sqlite_rows(files, 'SELECT id, "a b" AS x FROM "my table"', "id long, x string")
    assert sorted((r.id, r.x) for r in got.collect()) == sorted(map(tuple, df.collect()))
    sheets = documents.xlsx_rows(writers.workbook_files(df, rows=30)).collect()
    assert sum(r.row > 0 for r in sheets) == 95 and {tuple(r.cells) for r in sheets if r.row == 0} == {("id", "a b")}
    assert writers.sqlite_files(df.where("id < 0"), "t").collect() == []
