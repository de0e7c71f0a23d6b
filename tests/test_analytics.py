import csv
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import analytics as a
from lodestrata.sources.tables import InvalidDataset, csv_records, read_csv_dataset

REVENUE = "region,product,revenue,units,active\nNorth,Atlas,120.50,10,true\nNorth,Beacon,80.25,8,true\nSouth,Atlas,150.00,12,true\nSouth,Beacon,95.75,9,false\nWest,Atlas,110.00,11,true\nWest,Beacon,70.50,7,false\n"


@pytest.fixture
def raw(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("\ufeff" + REVENUE + " , ,,,\n", encoding="utf-8")
    return read_csv_dataset(spark, str(path))


@pytest.fixture
def data(raw):
    return a.apply_schema(raw, a.infer_schema(raw), 2)


def test_types_are_inferred_over_all_rows(raw, spark):
    assert [tuple(r) for r in a.infer_schema(raw).collect()] == [("region", "string", False), ("product", "string", False), ("revenue", "number", False), ("units", "number", False), ("active", "boolean", False)]
    odd = spark.createDataFrame([("NaN", None, "TRUE", "1e3"), ("1", None, "false", None)], "a string, b string, c string, d string")
    assert [tuple(r) for r in a.infer_schema(odd).collect()] == [("a", "string", False), ("b", "string", True), ("c", "boolean", False), ("d", "number", True)]
    assert raw.count() == 6


def test_metrics(data):
    assert a.count_rows(data).head()[0] == 6
    assert [float(a.single_metric(data, f, "revenue").head()[0]) for f in ("sum", "mean", "min", "max")] == [627, 104.5, 70.5, 150]
    with pytest.raises(a.InvalidOperation):
        a.single_metric(data.where("false"), "sum", "revenue", strict=True)


def test_groups(data):
    got = [(r.region, float(r.sum_revenue), r.group_count, r.returned_rows) for r in a.group_by(data, ["region"], "sum", "revenue", 2).collect()]
    assert got == [("North", 200.75, 3, 2), ("South", 245.75, 3, 2)]
    nulls = data.withColumn("region", F.when(F.col("units") > 8, F.col("region")))
    assert [r.region for r in a.group_by(nulls, ["region"]).collect()] == ["", "North", "South", "West"]


def test_aggregation_of_groups_and_of_all(data):
    aggs = [{"fn": "count", "alias": "n"}, {"fn": "mean", "field": "units", "alias": "m"}]
    assert [(r.product, r.n, float(r.m)) for r in a.aggregate(data, aggs, ("product",)).collect()] == [("Atlas", 3, 11.0), ("Beacon", 3, 8.0)]
    assert a.aggregate(data, aggs).head().n == 6


@pytest.mark.parametrize("approx", [False, True])
def test_description(data, approx):
    got = {r["column"]: r for r in a.describe(data, approx=approx).collect()}
    assert abs(got["region"].unique_count - 3) <= approx and got["region"]["min"] is None and got["revenue"]["mean"] == 104.5 and got["revenue"]["max"] == 150 and got["active"].data_type == "boolean"


def test_sorts_put_nulls_last(data, spark):
    assert [float(r.revenue) for r in a.sort_rows(data, [("revenue", "asc")], 2).collect()] == [70.5, 80.25]
    assert [float(r.revenue) for r in a.top_n(data, "revenue", 2).collect()] == [150, 120.5]
    t = spark.createDataFrame([(1, "b"), (2, None), (3, "A")], "i int, s string")
    assert [[r.i for r in a.sort_rows(t, [("s", way)], tie="i").collect()] for way in ("asc", "desc")] == [[3, 1, 2], [1, 3, 2]]


@pytest.mark.parametrize("op", [
    {"grouped": True, "keys": ["nope"]}, {"aggs": [{"fn": "mean", "field": "region"}]}, {"limit": 1001}, {"aggs": [{"fn": "sum", "field": None}]}, {"grouped": True, "keys": []},
    {"keys": ["region", "product", "active", "units"]}, {"aggs": [{"fn": "count", "alias": "x"}] * 11}, {"aggs": [{"fn": "count", "alias": "1x"}]},
])
def test_operations_that_do_not_fit_are_refused(data, op):
    with pytest.raises(a.InvalidOperation):
        a.validate_op(data.schema, op)


@pytest.mark.parametrize("text", ["", "a,a\n1,2\n", "a,\n1,2\n", "a,b\n", ",".join(f"c{i}" for i in range(51)) + "\n" + ",".join("1" for _ in range(51)) + "\n"])
def test_files_that_break_the_rules_are_refused(spark, tmp_path, text):
    path = tmp_path / "bad.csv"
    path.write_text(text)
    with pytest.raises(InvalidDataset):
        read_csv_dataset(spark, str(path))


def test_rows_of_another_width_fail(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        read_csv_dataset(spark, str(path)).collect()


def test_newest_first(spark):
    t = spark.createDataFrame([(1, 5), (2, 7), (3, 7)], "id int, created_at int")
    assert [r.id for r in a.list_recent(t).collect()] == [3, 2, 1] and [r.id for r in a.list_recent(t, 1).collect()] == [3]


def test_one_csv_file_is_read_in_ranges(spark, tmp_path):
    rng = random.Random(2)
    cells = ["plain", "", "  padded ", 'say "hi"', "two\nlines", "a,b", "\n\n", '"', 'x\n"y",z', "é ü", "5"]
    rows = [["a", "b", "c"]] + [[rng.choice(cells) for _ in range(3)] for _ in range(400)]
    path = tmp_path / "long.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
        f.write('unquoted 5" pipe,7" pipe,"8"" pipe\n on"\nlast 1" one,,2\n')
    with open(path, newline="", encoding="utf-8") as f:
        want = [tuple(x.strip() or None for x in row) for row in list(csv.reader(f))[1:]]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = read_csv_dataset(spark, str(path))
        assert csv_records(spark, str(path)).rdd.getNumPartitions() > 4
        strip = lambda x: x.strip() or None if x is not None else None
        assert Counter(tuple(strip(x) for x in r) for r in found.collect()) == Counter(r for r in want if any(r))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    path.write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(InvalidDataset):
        read_csv_dataset(spark, str(path))
