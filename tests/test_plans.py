"""What a query's plan must not hold, however right its rows are."""

import pytest

from logloom.operators import analytics
from logloom.plans import queries as log_queries

DATA = "/root/testdata/sf0.001"


def python_steps(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


@pytest.mark.parametrize(("name", "steps"), [("any_values", 1), ("any_values_proto", 2), ("otlp_json_to_logs", 1), ("otlp_proto_to_logs", 2)])
def test_each_message_is_encoded_and_decoded_once(spark, name, steps):
    assert python_steps(log_queries.queries()[name](spark, DATA)) == steps


def test_traces_meet_once_and_count_as_before(spark):
    rows = spark.createDataFrame([("a", "s", "ERROR"), ("a", "t", "INFO"), ("a", "s", "INFO"), ("b", "s", "INFO"), ("", "s", "ERROR")], "trace_id string, service_name string, severity string")
    found = analytics.traces(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [("a", 3, 2, 1), ("b", 1, 1, 0)]


def test_a_first_question_computes_its_columns_only_and_a_second_one_is_asked_of_the_table(spark, tmp_path):
    (tmp_path / "events.parquet").symlink_to(f"{DATA}/events.parquet")  # a path that nothing was asked of
    first, second = (log_queries.queries()["trace_summary"](spark, str(tmp_path)) for _ in range(2))
    assert python_steps(first) == 1 and "map_from_arrays" not in first._jdf.queryExecution().optimizedPlan().toString()
    assert python_steps(second) == 0
    assert first.schema.simpleString() == second.schema.simpleString()
    assert sorted(first.collect()) == sorted(second.collect())
