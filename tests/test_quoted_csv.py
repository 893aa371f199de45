"""CSV with line breaks inside quotes, read in many byte ranges."""

import csv
import random

import pytest

from steplake.sources.files import read_csv
from steplake.sources.quoted_csv import csv_records, read_quoted_csv

SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture()
def small_ranges(spark):
    """Byte ranges far smaller than the files, so that many records cross them."""
    before = {k: spark.conf.get(k) for k in SETTINGS}

    def use(n):
        for k in SETTINGS:
            spark.conf.set(k, n)
    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_rows(n, seed):
    rng = random.Random(seed)
    pieces = ['"', "\n", ",", "ab", "é", "", '""', "\n\n", "x y", "\r\n", '\n"', "longer words here"]
    return [[str(i), "".join(rng.choice(pieces) for _ in range(rng.randrange(9))), rng.choice(["", "plain", "two\nlines"]), str(i * 0.5)] for i in range(n)]


def write(path, rows, header=("id", "text", "kind", "half"), end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        if header:
            out.writerow(header)
        out.writerows(rows)


@pytest.mark.parametrize("size", [64, 701, 10_000_000])
def test_records_equal_a_sequential_reader(spark, tmp_path, small_ranges, size):
    (tmp_path / "in").mkdir()
    files = [odd_rows(150, 1), odd_rows(90, 2), odd_rows(1, 3), []]
    for i, rows in enumerate(files):
        write(tmp_path / "in" / f"{i}.csv", rows, end="\r\n" if i == 1 else "\n")
    small_ranges(size)
    path = str(tmp_path / "in")
    got = read_quoted_csv(spark, path, schema="id int, text string, kind string, half double")
    if size < 1000:
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() >= 8
    want = [(int(r[0]), r[1] or None, r[2] or None, float(r[3])) for rows in files for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert csv_records(spark, path).filter("first").count() == 4


def test_quotes_right_at_the_edges(spark, tmp_path, small_ranges):
    """Every length of the first field moves the ranges' edges over quotes, doubled quotes and line breaks."""
    for shift in range(0, 48, 3):
        rows = [["a" * shift, 'say ""hi""\n"', "", "1"], ["b", '"', "\n", "2"], ["c", '""\n""', "k", "3"], ["", "", "", "4"]]
        path = tmp_path / f"{shift}.csv"
        write(path, rows)
        small_ranges(16)
        got = read_csv(spark, str(path), schema="id string, text string, kind string, half int", multiline=True)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((r[0] or None, r[1] or None, r[2] or None, int(r[3]))) for r in rows), shift


def test_a_record_longer_than_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}" for i in range(500))
    write(tmp_path / "long.csv", [["1", long, "k", "1"], ["2", "short", "k", "2"], ["3", long + '"', "k", "3"]])
    small_ranges(100)
    got = {r.id: r.text for r in read_quoted_csv(spark, str(tmp_path / "long.csv"), schema="id int, text string, kind string, half double").collect()}
    assert got == {1: long, 2: "short", 3: long + '"'}


def test_inferred_types_and_headers(spark, tmp_path):
    write(tmp_path / "t.csv", [["1", "3000000000", "1.5", "2024-01-02", "2024-01-02 03:04:05", "true", "a\nb", ""]] * 3 + [["", "1", "7", "", "", "false", "", ""]],
          ["a b", "big", "num", "day", "at", "flag", "text", "none"])
    got = read_csv(spark, str(tmp_path / "t.csv"), multiline=True)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == [
        "a b int", "big bigint", "num double", "day date", "at timestamp", "flag boolean", "text string", "none string"]
    assert got.count() == 4 and got.filter("text = 'a\\nb'").count() == 3
    plain = read_quoted_csv(spark, str(tmp_path / "t.csv"), header=False)
    assert plain.columns[:2] == ["_c0", "_c1"] and plain.count() == 5
    (tmp_path / "none.csv").write_text("")
    assert read_quoted_csv(spark, str(tmp_path / "none.csv")).columns == []


def test_empty_and_quoted_empty_fields_and_tabs(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('id\tv\n1\t""\n\n2\t\n3\t"a\tb\n"')
    got = {r.id: r.v for r in read_csv(spark, str(tmp_path / "q.tsv"), schema="id int, v string", multiline=True).collect()}
    assert got == {1: "", 2: None, 3: "a\tb\n"}
