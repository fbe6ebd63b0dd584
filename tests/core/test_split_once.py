from tallyforge.plans import stream_plans


def test_the_split_query_parses_each_text_once(spark, sf):
    """The rows that are split are stored: no part parses the texts again."""
    plan = stream_plans.split_valid_executions(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan
