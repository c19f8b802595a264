"""Every query of this subpackage that has SQL against it, over whole tables."""

import compare
import pytest

from sievelake.llm.common import table
from sievelake.llm.oracles import quality_sql
from sievelake.llm.quality import quality_rules
from sievelake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare.difference(spark, con, QUERIES[name], ORACLES[name], SF) is None


def test_quality_of_pairs(spark, con):
    """With fewer texts asked for, most pairs of language and source have estimates of their own."""
    assert compare.difference(spark, con, lambda s, d: quality_rules(table(s, d, "documents"), least_rows=20).drop("distance"), quality_sql(least_rows=20), SF) is None


def test_sql_only_for_queries():
    assert set(ORACLES) <= set(QUERIES)
