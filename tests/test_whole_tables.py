"""Queries that give a row for each row of a table give it for all of them."""

import os

import pytest

from larkspur import plans

SF = "/root/testdata/sf0.01"

WHOLE = {
    "fn_regular_expressions": "part",
    "fn_rounding": "lineitem",
    "fn_logarithms": "part",
    "fn_trigonometry": "part",
    "fn_date_parts": "events",
    "fn_date_truncation": "events",
    "fn_date_arithmetic": "orders",
    "fn_arrays": "part",
    "fn_json": "events",
    "fn_casts": "lineitem",
    "fn_regular_expressions_more": "part",
    "fn_numbers_more": "part",
    "fn_mysql_dates": "events",
    "fn_times_and_intervals": "events",
    "fn_full_text": "documents",
    "win_groups_frame": "lineitem",
    "project_expressions": "lineitem",
    "like_family": "part",
    "casts": "lineitem",
    "win_ranking_ties": "lineitem",
    "win_default_frame_ties": "lineitem",
    "date_arithmetic": "lineitem",
    "json_to_record": "events",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", WHOLE)
def test_query_reads_its_whole_table(spark, name):
    assert plans.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{WHOLE[name]}.parquet").count()
