"""Matches counted without evidence, and what validation reads of them."""

import datetime as dt

from pyspark.sql import functions as F
from test_history import claims, some_rows

from claimloom.operators import fraud
from claimloom.plans import catalog


def test_counts_without_evidence_are_those_with_it(spark):
    df = claims(spark, some_rows())
    for since in (0, 10, 39):
        at = F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(days=since))
        for same, by, reach in ((["provider", "code"], "day", 7), (["service_date"], "amount", 1)):
            want = {r["claim_id"]: r["matches"] for r in fraud.matches(df, at, same, by, reach).collect()}
            got = fraud.matches(df, at, same, by, reach, 0).collect()
            assert {r["claim_id"]: r["matches"] for r in got} == want and want
            assert all(r["evidence"] == [] for r in got)


def test_validation_gathers_no_evidence(spark):
    plan = catalog.QUERIES["v12_a18_validation_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "other_id" not in plan
