"""How much queries move: shuffles in the plan of a query, which grow with the tables, and tasks, which have to."""

import re

import pytest
from strataweave.plans import bed, catalogue


def shuffles(df):
    """Shuffles of rows by key in the plan, as it is before it runs; those that a broadcast or a last count need aren't among them."""
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


# tables dealt by record once each: orders and lines for cells, orders and lines for entities, orders twice for roots and index; then what the query's own sums need
MOST = {
    "plan_models": 8,
    "plan_totals": 7,
    "plan_validation_steps": 7,
    "plan_blocked_reasons": 8,
    "plan_by_disposition": 8,
    "missing_required_reads": 5,
    "step_dependencies": 5,
    "assemble_root": 4,
    "assemble_orders": 4,
    "decompose_cells": 2,
}


@pytest.mark.parametrize("name", MOST)
def test_few_shuffles(spark, data, name):
    assert shuffles(catalogue.QUERIES[name](spark, data)) <= MOST[name]


DEALT = ["step_expansion", "reads_with_root_fallback", "resume_remaining", "stale_fields", "export_lines"]


@pytest.mark.parametrize("name", DEALT)
def test_tasks_grow_with_the_table(spark, data, monkeypatch, name):
    """Orders and lines are dealt by record into so many tasks, so what one of them sorts stays as it is; and all that meets by record meets there."""
    monkeypatch.setattr(bed, "LINES", 100)
    n = -(-bed.table(spark, data, "lineitem").count() // 100)
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((?:record_id|step_key|entity)[^)]*, (\d+)\)", plan)
    assert dealt and set(dealt) == {str(n)}


@pytest.mark.parametrize("name", ["validate_undefined", "validate_bounds"])
def test_a_value_is_parsed_once(spark, data, name):
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"parse_?json", plan, re.I)) <= 1
