"""A claim's fields as one array: against the long table's way, and what is shuffled."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import fields, risk
from claimloom.plans import catalog
from claimloom.plans import fields as plans

SF = "/root/testdata/sf0.001"
SCHEMA = "claim_id long, field_name string, field_value string, created_at timestamp, id string, document_id int"


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(3)
    names = ["Patient Name", "name", "policy no", "Member ID", "grand total", "total_amount", "date of admission", "DOA", "diagnosis", "icd_code", "room rent", "icu charges", "Sum Insured", "note", "age", None]
    values = [None, "", "  ", " A ", "Rs. 1,200", "90", "05/03/1997", "Sum insured: Rs. 5,000", "abc"]
    day = lambda: rng.choice([None, datetime.datetime(1997, 1, rng.randint(1, 3))])
    rows = [(claim, rng.choice(names), rng.choice(values), day(), f"r{i}", rng.choice([None, 1, 2, 3])) for claim in range(60) for i in range(rng.randint(1, 14))]
    return spark.createDataFrame(rows, SCHEMA)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_maps_hold_what_the_long_way_resolves(long):
    got = fields.resolved_maps(fields.by_claim(long)).select("claim_id", F.explode("resolved").alias("canonical", "value"))
    assert told(got) == told(fields.resolved(long)) and got.count() > 100


def test_fields_named_twice_hold_all_that_cross_documents(long):
    arrays = long.groupBy("claim_id").agg(F.collect_list(F.struct("field_name", "field_value", "document_id")).alias("fields"))
    got = fields.cross_document(fields.named_twice(arrays))
    assert told(got) == told(fields.cross_document(long)) and got.count() > 20


def test_features_are_the_same_from_either_form(spark, long):
    codes = spark.createDataFrame([(1, "A", "ICD10", True), (1, "B", "CPT", False)], "claim_id long, code string, code_system string, is_primary boolean")
    entities = spark.createDataFrame([(1, "Flu", "DIAGNOSIS"), (1, "flu ", "DIAGNOSIS"), (2, "x", "PROCEDURE")], "claim_id long, entity_text string, entity_type string")
    a, b = risk.features(long, codes, entities), risk.features(fields.by_claim(long), codes, entities)
    assert told(a) == told(b) and a.columns[1:] == list(risk.FEATURES)
    one = {r["claim_id"]: r for r in a.collect()}[1]
    assert (one["num_icd_codes"], one["num_cpt_codes"], one["num_entities"], one["num_diagnosis_types"]) == (1, 1, 2, 1)


def test_arrays_hold_the_long_table(spark):
    spread = plans.claim_fields(spark, SF).select("claim_id", F.inline("fields"))
    columns = ["claim_id", "field_name", "field_value", "model_version", "created_at", "id", "document_id"]
    assert told(spread.select(columns)) == told(plans.long_table(spark, SF).select(columns))


@pytest.mark.parametrize("name", ["m1_features", "m4_risk_score", "m5_o3_reasons", "v1_v10_rules", "v12_a18_validation_summary", "a22_cross_document"])
def test_a_claims_fields_are_not_spread_before_they_are_shuffled(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not [line for line in plan if "Expand" in line and "Patient Name" in line]
