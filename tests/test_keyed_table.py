import uuid

import pytest

from postmill.operators.upsert import insert_or_ignore
from postmill.sinks.keyed_table import create_keyed, insert_new, pending

SCHEMA = "k string, v string"


@pytest.fixture
def name(spark, tmp_path):
    name = f"keyed_{uuid.uuid4().hex}"
    yield name, str(tmp_path / name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_same_as_insert_or_ignore_batch_after_batch(spark, name):
    table, path = name
    state = spark.createDataFrame([(str(i), "old") for i in range(50)], SCHEMA)
    create_keyed(state, table, ["k"], 4, path)
    batches = [[(str(i % 70), f"b{i}") for i in range(200)], [("7", "x"), ("90", "y"), ("90", "a"), (None, "n"), (None, "n")], []]
    for batch in batches:
        frame = spark.createDataFrame(batch, SCHEMA)
        state = insert_or_ignore(state, frame, ["k"], ["v"])
        insert_new(spark, table, frame, ["k"], 4, ["v"], path)
        assert rows(spark.table(table)) == rows(state)
    insert_new(spark, table, spark.createDataFrame(batches[0], SCHEMA), ["k"], 4, ["v"], path)
    assert rows(spark.table(table)) == rows(state)


def test_the_target_is_not_shuffled(spark, name):
    table, path = name
    create_keyed(spark.range(1000).selectExpr("cast(id as string) k", "'o' v"), table, ["k"], 4, path)
    batch = spark.createDataFrame([(str(i), "b") for i in range(900, 1100)], SCHEMA)
    plan = pending(spark, table, batch, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    # The join's right side is printed last: what follows the scans of the batch.
    target = plan.rsplit("ExistingRDD", 1)[1]
    assert "Bucketed: true" in target and "Exchange" not in target
    insert_new(spark, table, batch, ["k"], 4, ["v"], path)
    assert spark.table(table).count() == 1100
