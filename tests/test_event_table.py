import glob
import json

import pytest
from pyspark.sql import types as T

from postmill.sinks import event_table as et


def lines(spark, *values):
    return spark.createDataFrame([(v if v is None or isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def at(day, **more):
    return {"created_at": f"Mon Jan {day:02d} 10:00:00 +0000 2024", **more}


def test_schema_is_found_from_the_data(spark):
    found = et.detect_schema(
        lines(
            spark, {"a": 1, "b": {"c": "x", "d": [1, 2.5]}, "e": None}, {"a": 2, "b": {"z": True, "none": None}, "VOID": "x", "a b": [{"k": 1}]},
            "no json", None, "7", "[1]", {"mixed": 1, "none": []}, {"mixed": "t", "o": {}},
        )
    )
    assert found.simpleString() == "struct<VOID:string,a:bigint,a b:array<struct<k:bigint>>,b:struct<c:string,d:array<double>,z:boolean>,mixed:string,o:string>"
    assert et.detect_schema(lines(spark, "7", None)) == T.StructType() == et.detect_schema(lines(spark, {}))


def test_merging(spark):
    kind = lambda ddl: T.StructType.fromDDL(ddl)
    merged, drift = et.merge_types(kind("a bigint, b struct<c:string>, d double, t string"), kind("A string, b struct<c:string, n:boolean>, d bigint, t bigint, x array<int>"))
    assert merged.simpleString() == "struct<a:bigint,b:struct<c:string,n:boolean>,d:double,t:string,x:array<int>>"
    assert drift == [("A", et.CHANGED, "bigint", "string"), ("b.n", et.ADDED, None, "boolean"), ("x", et.ADDED, None, "array<int>")]


def test_new_fields_and_changed_types(spark, tmp_path):
    path = str(tmp_path / "events")
    with pytest.raises(FileNotFoundError):
        et.read_events(spark, path)
    assert et.load_lines(spark, path, "storm", lines(spark, at(1, id=1, user={"n": "a"}), at(2, id=2), "broken {", "", None), 1) == []
    drift = et.load_lines(spark, path, "fire", lines(spark, at(1, id="x", user={"n": "b", "age": 3}, tags=["q"]), {"id": 4}), 2)
    assert sorted(drift) == [("id", et.CHANGED, "bigint", "string"), ("tags", et.ADDED, None, "array<string>"), ("user.age", et.ADDED, None, "bigint")]
    view = et.register_events(spark, path, "events_found")
    rows = spark.sql(f"SELECT _event, _day, id, user.n, user.age, tags, _line IS NULL AS plain FROM {view} ORDER BY _event, _day").collect()
    assert [tuple(r) for r in rows] == [
        ("fire", None, 4, None, None, None, False), ("fire", "2024-01-01", None, "b", 3, ["q"], False),
        ("storm", "2024-01-01", 1, "a", None, None, True), ("storm", "2024-01-02", 2, None, None, None, True),
    ]
    assert spark.read.text(f"{path}/bad/load=1").collect()[0].value == "broken {"
    assert {tuple(r) for r in et.drift_report(spark, path).collect()} == {(2, *d) for d in drift}


def test_a_day_is_read_alone_and_only_the_columns_asked_for(spark, tmp_path):
    path = str(tmp_path / "events")
    et.load_lines(spark, path, "storm", lines(spark, *[at(d, id=d, text="long " * 50) for d in range(1, 9)]), 1)
    view = et.register_events(spark, path, "events_by_day")
    query = f"SELECT count(id) AS n FROM {view} WHERE _event = 'storm' AND _day = '2024-01-03'"
    plan = spark.sql(query)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<post:struct<id:bigint>>" in plan and "PartitionFilters: [isnotnull(event" in plan
    for file in glob.glob(f"{path}/rows/*/*/*/*.parquet"):
        if "day=2024-01-03" not in file:
            with open(file, "wb") as broken:
                broken.write(b"none")
    assert spark.sql(query).first().n == 1


def test_loads_show_when_complete_and_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "events")
    et.load_lines(spark, path, "storm", lines(spark, at(1, id=1)), 1)
    spark.range(3).selectExpr("named_struct('id', id) AS post", "'storm' AS event", "'2024-01-01' AS day").write.partitionBy("event", "day").parquet(f"{path}/rows/load=2")
    assert et.read_events(spark, path).count() == 1
    for _ in range(2):
        assert et.load_lines(spark, path, "storm", lines(spark, at(1, id=5, new=1)), 2) == [("new", et.ADDED, None, "bigint")]
    assert sorted(r.id for r in et.read_events(spark, path).select("post.id").collect()) == [1, 5]
    et.load_lines(spark, path, "empty", lines(spark), 3)
    assert et.read_events(spark, path).count() == 2


def test_lines_are_worked_out_once_and_a_day_is_one_file(spark, tmp_path):
    path, seen = str(tmp_path / "events"), spark.sparkContext.accumulator(0)
    texts = [json.dumps({"id": i, "created_at": f"Mon Jan 0{1 + i % 2} 00:00:{i:02} +0000 2024"}) for i in range(40)] + ["bad"]
    rows = spark.sparkContext.parallelize(texts, 4).map(lambda text: (seen.add(1), (text,))[1])
    et.load_lines(spark, path, "storm", spark.createDataFrame(rows, "value string"), 1)
    assert seen.value == len(texts)
    assert [len(glob.glob(f"{path}/rows/load=1/event=storm/day=2024-01-0{d}/*.parquet")) for d in (1, 2)] == [1, 1]
    assert et.read_events(spark, path).count() == 40
    assert [r.value for r in spark.read.text(f"{path}/bad/load=1").collect()] == ["bad"]
