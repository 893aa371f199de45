import pytest
from pyspark.sql import functions as F

from steplake.operators import partitioned as P

SCHEMA = "id string, town string, amount double, day string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


@pytest.fixture()
def sales(spark, folder):
    path = f"{folder}/sales"
    P.overwrite(rows(spark, ("a", "Oslo", 1.0, "d1"), ("b", "Bergen", 2.0, "d1"), ("c", "Bodo", 3.0, "d2")), path, ["day"])
    P.append(rows(spark, ("e", "Narvik", 4.0, "d3"), ("f", "Alta", 5.0, "d3")), path, ["day"])
    return path


def contents(spark, path, schema=SCHEMA):
    return sorted((tuple(r) for r in P.read_table(spark, path, schema).collect()), key=str)


def test_merge(spark, sales):
    batch = rows(spark, ("b", "Voss", 20.0, "d1"), ("c", "Bodo", 30.0, "d1"), ("g", "Hamar", 6.0, "d4"))
    for _ in range(2):
        P.merge(batch, sales, ["id"], ["day"])
        assert contents(spark, sales) == [("a", "Oslo", 1.0, "d1"), ("b", "Voss", 20.0, "d1"), ("c", "Bodo", 30.0, "d1"),
                                          ("e", "Narvik", 4.0, "d3"), ("f", "Alta", 5.0, "d3"), ("g", "Hamar", 6.0, "d4")]
    with pytest.raises(ValueError, match="repeat a key"):
        P.merge(rows(spark, ("z", "x", 1.0, "d1"), ("z", "y", 1.0, "d1")), sales, ["id"], ["day"])
    with pytest.raises(ValueError, match="needs keys"):
        P.merge(batch, sales, [], ["day"])
    P.merge(rows(spark, (None, "x", 1.0, "d1"), (None, "y", 1.0, "d1")), sales, ["id"], ["day"])
    P.merge(rows(spark, (None, "z", 1.0, "d1")), sales, ["id"], ["day"])
    assert P.read_table(spark, sales, SCHEMA).filter("id IS NULL").count() == 3  # NULL keys match nothing


def test_merge_leaves_other_partitions_alone(spark, sales):
    before = {r.file for r in P.files(spark, sales, SCHEMA, ["day"]).filter("day <> 'd3'").collect()}
    P.merge(rows(spark, ("e", "Tromso", 9.0, "d3")), sales, ["id"], ["day"])
    after = {r.file for r in P.files(spark, sales, SCHEMA, ["day"]).filter("day <> 'd3'").collect()}
    assert before == after and ("e", "Tromso", 9.0, "d3") in contents(spark, sales)


def test_merge_without_partitions_and_into_nothing(spark, folder):
    path = f"{folder}/plain"
    P.merge(rows(spark, ("a", "x", 1.0, "d"), ("b", "x", 1.0, "d")), path, ["id"])
    P.merge(rows(spark, ("b", "y", 2.0, "d"), ("c", "y", 2.0, "d")), path, ["id"])
    assert [r[:2] for r in contents(spark, path)] == [("a", "x"), ("b", "y"), ("c", "y")]


def test_backfill(spark, folder):
    path = f"{folder}/daily"
    P.overwrite(rows(spark, ("a", "x", 1.0, "2025-06-01"), ("b", "x", 1.0, "2025-06-02"), ("c", "x", 1.0, "2025-06-04")), path, ["day"])
    source = rows(spark, ("p", "k", 1.0, "2025-06-02"), ("q", "k", 1.0, "2025-06-03"), ("r", "k", 1.0, "2025-07-01"))
    for _ in range(2):
        runs = P.backfill(source, path, "day", "2025-06-02", "2025-06-04").orderBy("run_id").collect()
        assert [(r.run_id, r.rows_processed) for r in runs] == [("bf-daily-20250602", 1), ("bf-daily-20250603", 1), ("bf-daily-20250604", 0)]
        assert [r[0] for r in contents(spark, path)] == ["a", "p", "q"]
    with pytest.raises(ValueError, match="starts after"):
        P.backfill(source, path, "day", "2025-06-05", "2025-06-04")


def test_overwrite_partitions(spark, sales):
    P.overwrite_partitions(rows(spark, ("n", "k", 1.0, "d1")), sales, ["day"])
    assert [r[0] for r in contents(spark, sales)] == ["c", "e", "f", "n"]
    P.overwrite(rows(spark, ("z", "k", 1.0, "d9")), sales, ["day"])
    assert [r[0] for r in contents(spark, sales)] == ["z"]
    with pytest.raises(ValueError, match="no partitions"):
        P.overwrite_partitions(rows(spark), sales, [])


def test_writes_make_few_files(spark, folder):
    wide = spark.range(2000).repartition(8).select("id", (F.col("id") % 5).alias("k"))
    P.append(wide, f"{folder}/few", ["k"])
    assert P.files(spark, f"{folder}/few", wide.schema, ["k"]).count() <= 10


def test_compact(spark, folder):
    path, schema = f"{folder}/wide", "id bigint, h string, k int"
    wide = spark.range(40000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"), (F.col("id") % 2).cast("int").alias("k"))
    for part in range(4):
        P.append(wide.filter(f"id % 4 = {part}"), path, ["k"])
    P.append(wide.limit(0), path, ["k"])
    total = P.files(spark, path, schema, ["k"]).agg(F.sum("bytes")).first()[0]
    report = P.compact(spark, path, schema, ["k"], target_file_size_mb=total / 3 / 1024 / 1024)
    assert report["new_files_count"] <= 4 < report["previous_files_count"] + 1
    assert sorted(r.id for r in P.read_table(spark, path, schema).collect()) == list(range(40000))
    again = P.compact(spark, path, schema, ["k"])
    assert again["new_files_count"] == 2 == P.files(spark, path, schema, ["k"]).count()
    assert P.compact(spark, path, schema, ["k"])["previous_files_count"] == 2


def test_snapshots(spark, folder):
    path, schema = f"{folder}/snap", SCHEMA
    for number in range(1, 5):
        P.write_snapshot(rows(spark, *[(str(i), "t", 1.0, "d") for i in range(number)]), path, number)
    P.write_snapshot(rows(spark, ("x", "t", 1.0, "d")), path, 4)  # the same snapshot again
    assert sorted(map(tuple, P.snapshot_rows(spark, path).collect())) == [(1, 1), (2, 2), (3, 3), (4, 1)]
    assert P.read_snapshot(spark, path, schema).count() == 1 and P.read_snapshot(spark, path, schema, 3).count() == 3
    assert P.drop_snapshots(spark, path, 2) == [1, 2] and P.snapshots(spark, path) == [3, 4]
    with pytest.raises(ValueError, match="no snapshot"):
        P.read_snapshot(spark, path, schema, 2)
    with pytest.raises(ValueError, match="at least one"):
        P.drop_snapshots(spark, path, 0)


def test_merge_on_partition_values_with_any_character(spark, folder):
    """Rows that move away leave nothing behind, however the file system spells the folder."""
    path = f"{folder}/odd values"
    values = ["a:b", "a/b", "a b", "", None, "100%", "x=y", "ä", "b"]
    P.overwrite(rows(spark, *[(str(i), "t", 1.0, v) for i, v in enumerate(values)]), path, ["day"])
    P.merge(rows(spark, *[(str(i), "t", 2.0, "b") for i in range(len(values))]), path, ["id"], ["day"])
    assert contents(spark, path) == sorted([(str(i), "t", 2.0, "b") for i in range(len(values))], key=str)


def test_merge_on_timestamps(spark, folder):
    path, schema = f"{folder}/times", "id int, at timestamp_ntz"
    first = spark.sql("SELECT id, TIMESTAMP_NTZ '2024-01-01 10:20:30' AS at FROM VALUES (1), (2) t(id)")
    P.overwrite(first, path, ["at"])
    P.merge(first.selectExpr("id", "at + INTERVAL 1 HOUR AS at"), path, ["id"], ["at"])
    assert [r[1].hour for r in contents(spark, path, schema)] == [11, 11]


def _failing(frame):
    return frame.withColumn("town", F.when(F.col("id") == "bad", F.raise_error(F.lit("broken row"))).otherwise(F.col("town")))


@pytest.mark.parametrize("partition_by", [["day"], []])
def test_a_failing_write_leaves_the_old_rows(spark, folder, partition_by):
    path = f"{folder}/kept"
    P.overwrite(rows(spark, ("a", "Oslo", 1.0, "2025-06-01"), ("b", "Bergen", 2.0, "2025-06-02")), path, partition_by)
    before = contents(spark, path)
    bad = _failing(rows(spark, ("c", "x", 1.0, "2025-06-01"), ("bad", "x", 1.0, "2025-06-02")))
    writes = [lambda: P.overwrite(bad, path, partition_by), lambda: P.merge(bad, path, ["id"], partition_by)]
    if partition_by:
        writes += [lambda: P.overwrite_partitions(bad, path, partition_by), lambda: P.backfill(bad, path, "day", "2025-06-01", "2025-06-03")]
    for write in writes:
        with pytest.raises(Exception, match="broken row"):
            write()
        assert contents(spark, path) == before
    P.overwrite(P.read_table(spark, path, SCHEMA).filter("id = 'a'"), path, partition_by)  # made from its own rows
    assert [r[0] for r in contents(spark, path)] == ["a"]


def test_backfill_empties_partitions_below_a_day(spark, folder):
    path = f"{folder}/towns"
    P.overwrite(rows(spark, ("a", "x:y", 1.0, "2025-06-01"), ("b", "z", 1.0, "2025-06-01"), ("c", "x:y", 1.0, "2025-06-05")), path, ["day", "town"])
    P.backfill(rows(spark, ("n", "z", 1.0, "2025-06-01")), path, "day", "2025-06-01", "2025-06-02", ["day", "town"])
    assert sorted(r[0] for r in contents(spark, path)) == ["c", "n"]


def test_compact_a_table_with_maps_and_equal_rows(spark, folder):
    path, schema = f"{folder}/maps", "id bigint, m map<string,bigint>, k int"
    wide = spark.range(6000).select((F.col("id") * 0).alias("id"), F.create_map(F.lit("a"), F.col("id") * 0).alias("m"), F.lit(1).alias("k"))
    for _ in range(6):
        P.append(wide, path, ["k"])
    total = P.files(spark, path, schema, ["k"]).agg(F.sum("bytes")).first()[0]
    P.compact(spark, path, schema, ["k"], target_file_size_mb=total / 3 / 1024 / 1024)
    files = [r["rows"] for r in P.files(spark, path, schema, ["k"]).collect()]
    assert sum(files) == 36_000 and 2 <= len(files) < 6 and max(files) < 30_000
