"""Results of a whole table from what its loads have left."""

import pytest

from steplake.operators.quality import Rule, evaluate
from steplake.operators.quality_state import add_load, breach_history, loads, stream_whole_quality, whole_results

RULES = [Rule("r", "not_null", "v"), Rule("r", "unique", "k"), Rule("u", "unique", "t", severity="warn"), Rule("m", "row_count_min", params={"min_count": 95}),
         Rule("x", "range", "nowhere", {"min": 1}), Rule("q", "regex", "t", {"pattern": "^t[0-4]"}), Rule("s", "custom_sql", params={"sql": "v > 2 OR k < 50"})]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i % 60, None if i % 7 == 0 else i % 9, f"t{i}" if i % 5 else None) for i in range(90)], "k int, v int, t string")


def test_loads_add_up_to_one_evaluation(spark, rows, folder):
    for load in (2, 0, 1, 0):  # in any order, one of them twice
        add_load(rows.filter(f"(k + coalesce(v, 0)) % 3 = {load}"), RULES, f"{folder}/state", load)
    got, want = whole_results(spark, RULES, f"{folder}/state", "t"), evaluate(rows, RULES, "t")
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert loads(spark, f"{folder}/state") == ["0", "1", "2"]
    some = whole_results(spark, RULES, f"{folder}/state", "t", ["0", "2"])
    assert sorted(map(repr, some.collect())) == sorted(map(repr, evaluate(rows.filter("(k + coalesce(v, 0)) % 3 <> 1"), RULES, "t").collect()))
    by_load = {(r.load, r.rule_id): r.total_rows for r in breach_history(spark, RULES, f"{folder}/state").collect()}
    assert sum(by_load[str(i), "q"] for i in range(3)) == 90


def test_empty_loads_and_no_loads(spark, rows, folder):
    add_load(rows.filter("false"), RULES, f"{folder}/state", "none")
    add_load(rows, RULES, f"{folder}/state", "all")
    assert sorted(map(repr, whole_results(spark, RULES, f"{folder}/state").collect())) == sorted(map(repr, evaluate(rows, RULES).collect()))
    with pytest.raises(ValueError, match="no load"):
        whole_results(spark, RULES, f"{folder}/nothing")


def test_a_stream_is_judged_batch_by_batch_as_a_whole(spark, rows, folder):
    rows.repartition(5).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream_whole_quality(stream, RULES, f"{folder}/state", f"{folder}/ck")
    assert len(loads(spark, f"{folder}/state")) >= 4
    assert sorted(map(repr, whole_results(spark, RULES, f"{folder}/state").collect())) == sorted(map(repr, evaluate(rows, RULES).collect()))
