"""All of the engine's queries against their SQL, on the smallest tables; plans that must prune."""

import re

import pytest

import __spark_entry__ as entry
from gramlode import registry

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    said = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert said in ("", "no rows"), said


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "line_number", "line_text", "context_before", "context_after"]
    assert set(registry.oracle_sql()) == set(registry.queries())


def test_lookup_is_pushed_down(spark):
    index = registry.indexed(spark, SF)
    plan = index.rows_of([1, 2]).groupBy("file_id").count()._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan and re.search(r"PartitionFilters: \[[^\]]*folder", plan)
    files = registry.corpus_files(spark, SF)._jdf.queryExecution().toString()
    assert "n_chars" not in files.split("ReadSchema")[1]
