"""What grows with the reviews is never gathered by the driver; phrases come out alike however many names there are."""

import re

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import catalog
from reviewlake.functions.staging import cut
from reviewlake.operators import grading
from reviewlake.plans import queries_review

SF = "/root/testdata/sf0.001"


def broadcast_keys(df: DataFrame) -> set[str]:
    return set(re.findall(r"Broadcast\w*Join \[(\w+)#", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name", ["graded_assessments", "grade_behavior", "grade_evidence", "grade_failure", "markdown_report"])
def test_only_names_are_broadcast(spark, monkeypatch, name):
    """With Spark's own threshold, whose estimates see neither exploded rows nor compression."""
    seen = []
    monkeypatch.setattr(queries_review, "cut", lambda df: seen.append(broadcast_keys(df)) or cut(df))
    seen.append(broadcast_keys(catalog.QUERIES[name](spark, SF)))
    assert set().union(*seen) <= {"name", "effect"}


def test_phrases_of_many_names_are_those_of_few(spark, monkeypatch):
    handed = []
    monkeypatch.setattr(grading, "grade", lambda *x: handed.append(x) or x[0])
    queries_review.graded(spark, SF, "failure")
    monkeypatch.undo()
    few, many = (sorted(map(repr, grading.grade(*handed[0], most_names=n).collect())) for n in (grading.FEW_NAMES, 7))
    assert few == many and len(few) > 0
