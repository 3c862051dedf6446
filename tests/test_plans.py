"""What the physical plans of the registered queries must not contain."""

import os
import re

import pytest

import __spark_entry__ as contract
from tidemark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_python_rows(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in text
    if name not in ("smote_rows", "hashed_neighbours", "hashed_neighbour_recall"):  # these search for neighbours
        assert "InPandas" not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(contract.queries()["daily_wave_maxima"](spark, SF))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_discount:double,l_shipdate:timestamp_ntz>" in text
    text = plan(contract.queries()["dummy_coding"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text
    text = plan(contract.queries()["orders_in_study_period"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_structure_drops_the_text_before_the_shuffle(spark):
    text = plan(contract.queries()["deck_segments"](spark, SF))
    exchanges = [line for line in text.split("\n") if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(path" in exchanges[0]
    carried = re.search(r"Generate posexplode\(.*?\), \[([^\]]*)\], false, \[_p", text, re.DOTALL).group(1)
    assert re.fullmatch(r"path#\d+", carried)


def test_the_calendar_is_not_shuffled(spark):
    text = plan(contract.queries()["modelling_panel"](spark, SF))
    assert "Join" not in text
    # Nothing above the generator is exchanged: the plan is printed from the top down.
    assert "Exchange" not in text[: text.index("explode(sequence")]


def test_vote_rows_are_dealt_before_they_unfold(spark):
    """The aggregate of the votes does not share a task with the one of the daily maxima."""
    from tidemark.plans.daily_risk import majority_of_vote_rows

    text = plan(majority_of_vote_rows(spark, SF))
    votes, daily = text.index("Generate explode"), text.rindex("HashAggregate(keys=[l_suppkey")
    assert "REPARTITION_BY_NUM" in text[votes:daily]
