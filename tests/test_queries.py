import os

import pytest

import __spark_entry__ as entry
from bytegrain.plans import catalog
from check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


WITHOUT_SQL = {"q_train_full", "q_encode_full"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, catalog.QUERIES[name], catalog.ORACLES[name]) is None


def test_other_queries_have_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES) - WITHOUT_SQL


def test_a_vocabulary_of_the_default_size(spark):
    merges = catalog.QUERIES["q_train_full"](spark, SF_DIR).collect()
    assert [r.rank for r in merges] == list(range(1, len(merges) + 1)) and len(merges) > 10_000
    coded = catalog.QUERIES["q_encode_full"](spark, SF_DIR).collect()
    assert len(coded) == 200 and all(r.same for r in coded)


def test_entry_registers_the_catalog():
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.bytes_per_token > 1 for r in rows)
