"""Every registered query against its SQL on the test tables."""

import os

import pytest

import __spark_entry__ as entry
from harness import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# too few rows at the smallest scale to leave a result; checked at the larger ones
MAY_BE_EMPTY = {"f1_report_list", "v9_merge_synonyms"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    problem = difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    if name in MAY_BE_EMPTY and problem == "no rows":
        return
    assert problem is None, problem


def test_every_plain_query_has_sql():
    plain = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if n != "pipeline" and not n.startswith("op")}
    assert not plain


def test_entry_is_a_stable_top_list(spark):
    df = entry.entry(spark)
    assert df.columns == ["theme_id", "report_count", "name"]
    assert 0 < df.count() <= 20
