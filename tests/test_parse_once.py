"""A model's JSON is parsed once a row, however many of its fields are read."""

from episodica.plans.catalog import QUERIES


def test_each_form_is_parsed_once(spark, data):
    plan = QUERIES["extraction_parse"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"from_json(StructField({field}") for field in ("entities", "candidates")] == [1, 1], plan[:3000]
