"""Every registered query against its SQL; those without SQL must run and give rows."""

import pytest

from corpusloom.plans import job_queries, result_queries, stream_queries, text_queries  # noqa: F401
from corpusloom.plans.registry import ORACLES, QUERIES
from tests.oracle import connect, spark_rows, sql_rows

#: May be empty on the smallest tables.
MAY_BE_EMPTY = {"artifact_orphans", "batch_done_stream", "completed_jobs", "redelivery_dedupe", "inference_vectors", "span_overlap_pairs", "regex_entities"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    cols, rows = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        want_cols, want = sql_rows(con, ORACLES[name])
        assert cols == want_cols
        assert rows == want
    if name not in MAY_BE_EMPTY:
        assert rows
