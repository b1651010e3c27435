"""What is made of a narrow table's rows is made by all tasks."""

import os

import pytest

from quillmesh.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
MADE = ["s03_table_records", "s06_json_records", "d30_made_zones", "d47_made_hints", "s09_embedded_data", "s08_extracted", "s07_kml_records", "d54_cleaned_contacts"]


@pytest.mark.parametrize("name", MADE)
def test_rows_are_dealt_before_pages_are_made(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [k for k, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert at and all("html" not in x for k in at for x in plan[k + 1 : k + 3])  # keys are shuffled, not what is made of them
    assert name == "d54_cleaned_contacts" or all("Project [p_partkey" in plan[k + 1] or "Relation" in plan[k + 1] or "Filter" in plan[k + 1] for k in at)
