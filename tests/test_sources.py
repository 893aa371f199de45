import json
import os

import pytest
from pyspark.sql import functions as F

import samples
from steplake.operators.guards import ScanTooLarge, estimate_scan, read_partitioned, require_partition_filter
from steplake.operators.nested import (expand_json, flatten, infer_types, infer_value_schema, read_documents)
from steplake.session import ensure_checkpoint_dir, scratch_path, shared_folder
from steplake.sources import files, jdbc, sinks, storage
from steplake.sources.catalog import list_catalog, list_tables, preview, table_schema


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_any(spark, tmp_path):
    assert files.read_any(spark, write(tmp_path / "a.csv", 'id,name\n1,"x, ""y"""\n2,\n')).collect()[0].name == 'x, "y"'
    assert files.read_any(spark, write(tmp_path / "a.tsv", "id\tname\n1\tx,y\n")).first().name == "x,y"
    assert files.read_any(spark, write(tmp_path / "a.txt", "id,v\n1,2.5\n")).dtypes == [("id", "int"), ("v", "double")]
    assert files.read_any(spark, write(tmp_path / "a.json", '[{"a": 1},\n {"a": 2}]')).count() == 2
    assert files.read_any(spark, write(tmp_path / "a.ndjson", '{"a": 1}\n{"a": 2}\n')).count() == 2
    assert files.read_any(spark, write(tmp_path / "plain", "a\n1\n"), "text/csv; charset=utf-8").columns == ["a"]
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert files.read_any(spark, str(tmp_path / "t.parquet")).count() == 3
    assert files.detect_format("x/y.csv.gz") == "csv"
    with pytest.raises(ValueError, match="supported: .csv"):
        files.read_any(spark, "x.xlsb")


def test_import_table(spark, tmp_path):
    assert files.table_name("2024 sales-data") == "t_2024_sales_data"
    path = write(tmp_path / "7 days.csv", "a,b\n1,2\n3,4\n")
    row = files.import_table(spark, path, location=str(tmp_path / "tbl")).first()
    assert tuple(row) == ("t_7_days", 2, 2)
    assert files.import_table(spark, path, location=str(tmp_path / "tbl")).first().row_count == 2
    assert "t_7_days" in [r.name for r in list_catalog(spark).collect()]
    spark.sql("DROP TABLE t_7_days")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc', ""), (2, None, "  x "), (3, "\\", "é")], "id int, t string, u string")
    for sep in (",", "\t"):
        sinks.export_csv(df, f"{tmp_path}/out", sep)
        back = files.read_csv(spark, f"{tmp_path}/out", sep, schema=df.schema, multiline=True)
        assert sorted(back.collect()) == sorted(df.collect())
    sinks.export_csv(df, f"{tmp_path}/two", limit=2)
    assert files.read_csv(spark, f"{tmp_path}/two", schema=df.schema, multiline=True).count() == 2


def test_write_files_and_objects(spark, tmp_path):
    df = spark.range(4)
    for name in ("a.parquet", "b.json", "c.csv", "d.dat"):
        sinks.write_files(df, f"{tmp_path}/{name}")
    (tmp_path / "real.csv").write_text("id\n1\n")
    (tmp_path / "notes.md").write_text("x")
    listed = {(r.name, r.node_type) for r in files.list_objects(spark, str(tmp_path)).collect()}
    assert ("a.parquet", "directory") in listed and ("real.csv", "table") in listed
    assert "notes.md" not in {n for n, _ in listed}
    assert files.list_objects(spark, f"{tmp_path}/missing").count() == 0
    assert files.read_object_store(spark, f"{tmp_path}/b.json").count() == 4
    with pytest.raises(ValueError, match="unsupported object"):
        files.read_object_store(spark, f"{tmp_path}/d.dat")
    assert files.object_store_options("http://x", "k", "s")["fs.s3a.endpoint"] == "http://x"


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1, 2])], "_id int, name string, tags array<int>")
    sinks.write_documents(df, f"{tmp_path}/d")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/d").collect()]
    assert sorted(map(len, lines)) == [2, 2]
    back = read_documents(spark, f"{tmp_path}/d")
    assert back.columns == ["_id", "name", "tags"] and dict(back.dtypes)["_id"] == "string"
    sinks.write_documents(df, f"{tmp_path}/d")
    assert read_documents(spark, f"{tmp_path}/d").count() == 4
    sinks.write_documents(df, f"{tmp_path}/d", "overwrite")
    assert read_documents(spark, f"{tmp_path}/d").count() == 2


NESTED = {"boat": {"hull": "oak", "crew": {"cook": "Ida", "mate": "Jon"}}, "ports": ["Hull", "Bergen"], "afloat": False}


def test_flatten(spark, tmp_path):
    df = spark.read.json(write(tmp_path / "n.json", json.dumps(NESTED)))
    row = flatten(df).first().asDict()
    assert row == {"afloat": False, "ports": '["Hull","Bergen"]', "boat.crew.cook": "Ida", "boat.crew.mate": "Jon", "boat.hull": "oak"}


def test_expand_and_infer(spark):
    docs = [json.dumps(NESTED), '{"n": "text", "x": null}', '{"n": 4, "x": 1.5, "big": 12345678901}', "no json"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    types = {r.name: r.data_type for r in infer_types(df, "doc", "i").collect()}
    assert types == {"boat.hull": "VARCHAR", "boat.crew.cook": "VARCHAR", "boat.crew.mate": "VARCHAR", "ports": "VARCHAR",
                     "afloat": "BOOLEAN", "n": "BIGINT", "x": "DOUBLE", "big": "BIGINT"}
    out = expand_json(df.filter("i <> 3"), "doc")
    assert "doc.boat.crew.cook" in out.columns and out.count() == 3
    with pytest.raises(ValueError, match="does not hold JSON objects"):
        infer_value_schema(spark.createDataFrame([("[1]",)], "value string"))


def test_catalog(spark, tmp_path):
    samples.meters(spark).write.parquet(f"{tmp_path}/s")
    df = spark.read.parquet(f"{tmp_path}/s")
    row = list_tables({"meters": df}).first()
    assert (row.row_count, row.column_count) == (7, 6)
    assert row.size_bytes == sum(os.path.getsize(p.removeprefix("file:")) for p in {
        r.p for r in df.select(F.col("_metadata.file_path").alias("p")).collect()})
    shown = preview(df, ["meter", "read_at"], limit=2, offset=1)
    assert shown["total_rows"] == 7 and [r[0] for r in shown["rows"]] == ["M0", "M1"]
    assert [tuple(r) for r in table_schema(df).collect()][0] == (0, "meter", "string", True)


def test_save_as_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    sinks.save_as_table(df, "saved", path=f"{tmp_path}/saved")
    sinks.save_as_table(df.select("name", "id"), "saved", "append")
    assert [tuple(r) for r in spark.table("saved").distinct().collect()] == [(1, "a")]
    with pytest.raises(ValueError, match="other columns"):
        sinks.save_as_table(df.select("id"), "saved", "append")
    sinks.save_as_table(df.limit(0), "saved", path=f"{tmp_path}/saved2")
    assert spark.table("saved").count() == 0
    spark.sql("DROP TABLE saved")


def test_newest_log_lines(spark, tmp_path):
    path = write(tmp_path / "audit.jsonl", "\n".join(json.dumps({"timestamp": f"2026-01-{d:02d}", "action": f"a{d}"})
                                                      for d in (3, 1, 2)))
    assert [r.action for r in files.read_log_jsonl(spark, path, 2).collect()] == ["a3", "a2"]


# ---- databases: no server and no embedded one is started; what Spark and the database are asked is checked

def test_jdbc_options():
    assert jdbc.read_options("jdbc:x:y", table="t") == {"url": "jdbc:x:y", "fetchsize": "1000", "dbtable": "t"}
    assert jdbc.read_options("jdbc:x:y", query="SELECT 1")["query"] == "SELECT 1"
    split = jdbc.read_options("jdbc:x:y", query="SELECT 1", partition_column="id", lower_bound=0, upper_bound=9,
                              num_partitions=3, user="u")
    assert split["dbtable"] == "(SELECT 1) AS part" and split["numPartitions"] == "3" and split["user"] == "u"
    with pytest.raises(ValueError, match="either"):
        jdbc.read_options("jdbc:x:y")
    with pytest.raises(ValueError, match="split read"):
        jdbc.read_options("jdbc:x:y", table="t", partition_column="id")


def test_jdbc_texts():
    assert jdbc.dialect("jdbc:ch://h/db") == "clickhouse"
    with pytest.raises(ValueError):
        jdbc.dialect("postgres://h")
    assert "'pg_toast'" in jdbc.catalog_query("postgresql") and "'performance_schema'" in jdbc.catalog_query("mysql")
    assert "sqlite_master" in jdbc.catalog_query("sqlite") and "system.tables" in jdbc.catalog_query("clickhouse")
    assert "O''Brien" in jdbc.columns_query("postgresql", "public", "O'Brien")
    assert jdbc.sqlite_type("varchar(20)") == "string" and jdbc.sqlite_type("Real") == "double"
    assert jdbc.sqlite_type("point") == "string"
    assert jdbc.move_statements("t", "s", ["a", "b"], "overwrite") == [
        "DELETE FROM t", "INSERT INTO t (a, b) SELECT a, b FROM s"]


class FakeConnection:
    def __init__(self, fail_on=None):
        self.done, self.fail_on = [], fail_on

    def __getattr__(self, name):
        def call(*args):
            self.done.append((name, *args))
            if args and args[0] == self.fail_on:
                raise RuntimeError("no")
            return self
        return call


def test_jdbc_transaction(spark):
    good = FakeConnection()
    jdbc.run_transaction(good, ["A", "B"])
    assert [d[0] for d in good.done] == ["setAutoCommit", "createStatement", "executeUpdate", "executeUpdate", "commit", "close"]
    bad = FakeConnection("B")
    with pytest.raises(RuntimeError):
        jdbc.run_transaction(bad, ["A", "B"])
    assert [d[0] for d in bad.done][-2:] == ["rollback", "close"]
    with pytest.raises(PermissionError):
        jdbc.write_jdbc(spark.range(1), "jdbc:x:y", "t", read_only=True)
    with pytest.raises(ValueError, match="mode"):
        jdbc.write_jdbc(spark.range(1), "jdbc:x:y", "t", mode="merge")


# ---- guards and the shared folder

def test_guards(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 4).alias("day"), F.lit("a").alias("kind")).write.partitionBy(
        "day").parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    whole, part = estimate_scan(df, count_rows=True), estimate_scan(df.filter("day = 1"))
    assert whole.rows == 1000 and 0 < part.size_bytes < whole.size_bytes
    with pytest.raises(ScanTooLarge):
        estimate_scan(df, max_bytes=10)
    assert estimate_scan(df, max_bytes=10, confirmed=True).files == whole.files
    assert require_partition_filter(df.filter("day = 1"), ["day"])[0]
    assert require_partition_filter(df.filter("day IN (1, 2) AND id > 3"), ["day"])[0]
    long = df.withColumnRenamed("id", "i" * 900).filter("day = 2 AND day > 0 AND day < 3")
    assert require_partition_filter(long, ["day"])[0]
    small = spark.range(3).withColumnRenamed("id", "other")
    small.write.parquet(f"{tmp_path}/small")
    plain = spark.read.parquet(f"{tmp_path}/small")
    assert require_partition_filter(df.filter("day = 1").join(plain, F.col("id") == F.col("other")), ["day"])[0]
    assert not require_partition_filter(plain, ["day"])[0]
    for loose in (df, df.filter("id = 3"), df.filter("day > 1"), df.filter("kind = 'a'"), df.filter("day <> 1"), df.filter("NOT (day = 1)"),
                  df.filter("day = 1 OR day > 0"), df.filter("day = 1").join(df.select(F.col("id").alias("other")), F.col("id") == F.col("other"))):
        assert not require_partition_filter(loose, ["day"])[0]
    assert not require_partition_filter(df.filter("day = 1"), ["day"], allow_full_scan=True)[0]
    with pytest.raises(ValueError, match="partition column"):
        read_partitioned(df, ["day"])
    assert read_partitioned(df.filter("day = 2"), ["day"]).count() == 250


def test_shared_folder(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_remove(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/gone/a=1")
    assert storage.exists(spark, f"{tmp_path}/gone") and storage.remove(spark, f"{tmp_path}/gone")
    assert not storage.exists(spark, f"{tmp_path}/gone") and not storage.remove(spark, f"{tmp_path}/gone")


def test_names_that_look_like_types(spark):
    docs = ['{"VOID_at": 1, "VARIANT": 2, "a<b": {"OBJECT": "x", "DECIMAL(2,1)": 1.5}}', '{"VOID_at": null, "late": [1, "two"], "with, comma": true}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")
    assert {f.name for f in infer_value_schema(df, "doc")} == {"VOID_at", "VARIANT", "a<b", "late", "with, comma"}
    rows = expand_json(df, "doc").orderBy("i").collect()
    assert rows[0]["doc.VOID_at"] == 1 and rows[0]["doc.VARIANT"] == 2 and rows[0]["doc.a<b.OBJECT"] == "x"
    assert rows[0]["doc.a<b.DECIMAL(2,1)"] == 1.5 and rows[1]["doc.with, comma"] is True and rows[1]["doc.late"] == '["1","two"]'


def test_fields_that_come_late(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 150, F.lit('{"a": 1}')).otherwise(F.lit('{"a": 1, "late": true}')).alias("doc"))
    assert {r.name: r.data_type for r in infer_types(df, "doc", "id").collect()} == {"a": "BIGINT", "late": "BOOLEAN"}
