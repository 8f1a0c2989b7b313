"""Small DataFrames against values worked out by hand."""

import itertools
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import scalars
from claimloom.operators import documents, expenses, extraction, fields, fraud, lifecycle, retrieval, risk, validation
from claimloom.plans import fraud as plans


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_amounts(spark):
    got = one(spark, scalars.amount_plain(F.lit("1,50,000")), scalars.amount_plain(F.lit("abc")), scalars.amount_lenient(F.lit("Rs. 500")), scalars.amount_lenient(F.lit("₹500")), scalars.amount_lenient(F.lit(None).cast("string")), scalars.amount_signed(F.lit("(1,234.50)")), scalars.amount_signed(F.lit("12,5")), scalars.first_number(F.lit("about 1,200.5 only")))
    assert list(got) == [150000.0, None, 500.0, 500.0, 0.0, -1234.5, 12.5, 1200.5]


def test_dates(spark):
    got = one(spark, scalars.parse_date(F.lit("03/04/2024")).cast("string"), scalars.parse_date(F.lit("12/31/2024")).cast("string"), scalars.parse_date(F.lit("05-Jan-2024"), "risk").cast("string"), scalars.parse_date(F.lit("x")).cast("string"), scalars.birth_date(F.lit("1/2/80")), scalars.birth_date(F.lit("3 Mar 1999")), scalars.birth_date(F.lit("07/08/20")))
    assert list(got) == ["2024-04-03", "2024-12-31", "2024-01-05", None, "1980-02-01", "1999-03-03", "2020-08-07"]


def test_stay_of_missing_or_inverted_dates(spark):
    d = lambda x: F.lit(x).cast("date")
    assert list(one(spark, scalars.stay_days(d("2024-01-01"), d("2024-01-05")), scalars.stay_days(d("2024-01-05"), d("2024-01-01")), scalars.stay_days(d("2024-01-01"), d(None)), scalars.stay_days(d("2024-01-01"), d("2025-01-01")))) == [4, 0, 0, 60]


def test_names(spark):
    s = lambda a, b: scalars.name_similarity(F.lit(a), F.lit(b))
    got = one(spark, s("Mr. Asha Rao", "asha  rao"), s("Asha", "Asha Rao"), s("Asha Devi Rao", "Asha Kumari Rao"), s("", "Asha"), s("A B", "C D"))
    assert list(got) == [1.0, 0.85, 0.5, 0.0, 0.0]


def wide(spark, **changes):
    base = {"claim_id": 1, "patient_id": 1, "policy_id": 1, "amount": 75000.0, "sum_insured": 500000.0, "line_sum": 75000.0, "icu": 10000.0, "surgery": 20000.0, "pharmacy": 5000.0, "los": 3, "icd_count": 1, "cpt_count": 2, "has_diagnosis": True} | changes
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in base.items()))


def codes_of(df):
    return {h["code"] for h in df.first()["indicators"]}


def test_clean_claim_has_no_high_hit(spark):
    assert fraud.assessment(wide(spark)).first()["fraud_category"] == "LOW"
    assert codes_of(fraud.assessment(wide(spark))) == set()


def test_each_fraud_rule_fires(spark):
    edits = {"R-DUP-01": {"exact_matches": 1}, "R-DUP-02": {"near_matches": 2}, "R-BILL-01": {"amount": 1_000_000.0}, "R-BILL-02": {"amount": 250_000.0}, "R-BILL-03": {"line_sum": 60_000.0}, "R-PROV-01": {"blacklisted": True}, "R-VEL-01": {"recent": 6}, "R-CODE-01": {"cpt_count": 9}, "R-CODE-02": {"icd_count": 0, "has_diagnosis": False}}
    for code, change in edits.items():
        assert code in codes_of(fraud.assessment(wide(spark, **change))), code
    gone = wide(spark).withColumn("policy_id", F.lit(None).cast("int")).withColumn("patient_id", F.lit(None).cast("int"))
    assert "R-IDEN-01" in codes_of(fraud.assessment(gone))
    assert "R-CODE-01" not in codes_of(fraud.assessment(wide(spark, cpt_count=8)))
    assert fraud.assessment(wide(spark, exact_matches=1, blacklisted=True)).first()["rules_score"] > 0.85


def test_anomaly_extremes(spark):
    clean = fraud.assessment(wide(spark, amount=30000.0, line_sum=30000.0, icu=0.0, surgery=0.0)).first()["ml_score"]
    wild = fraud.assessment(wide(spark, amount=900000.0, sum_insured=1000000.0, icu=700000.0, surgery=150000.0, los=2, recent=8)).first()["ml_score"]
    assert clean < 0.5 < 0.6 < wild


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=5))
def test_weights_combine_in_any_order(spark, weights):
    seen = set()
    for order in itertools.islice(itertools.permutations(weights), 3):
        hits = F.array(*(F.struct(F.lit(w).alias("weight")) for w in order))
        seen.add(one(spark, fraud.combined_weight(hits))[0])
    assert max(seen) - min(seen) <= 1e-4 and all(0 <= s <= 1 for s in seen)


def test_history_pairs_match_on_either_key_but_never_on_null(spark):
    rows = [(1, 1, 10, "2024-01-10"), (2, 1, 20, "2024-01-05"), (3, 2, 10, "2024-01-01"), (4, None, None, "2024-01-09"), (5, None, None, "2024-01-08"), (6, 1, 10, "2023-01-01")]
    df = spark.createDataFrame(rows, "claim_id long, patient_id long, policy_id long, d string").withColumn("created_at", F.to_timestamp("d"))
    assert {tuple(r) for r in fraud.history_pairs(df, 30).collect()} == {(1, 2), (1, 3)}


def test_validation_has_eleven_rows_and_error_for_unknown(spark):
    row = dict(claim_id="a", has_patient_name=1, has_policy_number=1, has_diagnosis=0, num_icd_codes=2, has_service_date=1, has_total_amount=0, has_provider=1, num_cpt_codes=1, has_primary_icd=1, rejection_score=0.7, fraud_score=0.9, fraud_category="HIGH")
    got = {r["rule_id"]: (r["passed"], r["severity"]) for r in validation.validated(spark.createDataFrame([row])).collect()}
    assert len(got) == 11 and got["R001"] == (True, "PASS") and got["R003"] == (False, "ERROR") and got["R006"] == (False, "WARN") and got["R008"] == (False, "WARN") and got["R011"] == (False, "ERROR")


def test_risk_levels(spark):
    base = dict.fromkeys(risk.FEATURES, 0) | dict(has_patient_name=1, has_policy_number=1, has_diagnosis=1, has_service_date=1, has_total_amount=1, has_provider=1, num_parsed_fields=12, num_icd_codes=1, num_cpt_codes=1, has_primary_icd=1)
    base = {k: float(v) for k, v in base.items()}
    simple = base | {"length_of_stay": 2.0, "total_amount_log": 11.0}
    hard = base | {"length_of_stay": 28.0, "total_amount_log": 14.5, "is_icu_admission": 1.0, "num_icd_codes": 4.0, "num_cpt_codes": 3.0, "has_secondary_diagnosis": 1.0}
    rows = spark.createDataFrame([simple | {"claim_id": 1.0}, hard | {"claim_id": 2.0}])
    got = {r["claim_id"]: r for r in risk.scored(rows).collect()}
    assert got[1.0]["risk_category"] == "LOW" and got[2.0]["risk_category"] == "HIGH" and len(got[2.0]["top_reasons"]) == 5


def test_best_values(spark):
    rows = [("a", "total_amount", "100", "expense-table-v4"), ("a", "total_amount", "50", "expense-table-v4"), ("a", "total_amount", "999", "heuristic-v2"), ("a", "age", "DOB 1980 age 45 or 200", "x"), ("a", "name", "A|B|C", "x"), ("a", "name", "Asha Rao", "x"), ("a", "empty", " ", "x")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "claim_id string, field_name string, field_value string, model_version string, id int").withColumn("created_at", F.timestamp_seconds("id"))
    assert {r["field_name"]: r["value"] for r in fields.best_values(df).collect()} == {"total_amount": "150.00", "age": "45", "name": "Asha Rao"}


def test_aliases_resolve_in_order(spark):
    rows = [("a", "Grand Total", "7"), ("a", "Total Amount", ""), ("a", "claimed-amount", "5"), ("b", "DOA", "x")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "claim_id string, field_name string, field_value string, id int").withColumn("created_at", F.timestamp_seconds("id"))
    got = {(r["claim_id"], r["canonical"]): r["value"] for r in fields.resolved(df).collect()}
    assert got[("a", "total_amount")] == "5" and got[("b", "admission_date")] == "x" and got[("b", "service_date")] == "x"


def test_expense_rules(spark):
    d = lambda t: expenses.is_expense(F.lit(t), F.lit(5.0))
    assert list(one(spark, d("Room rent 3 days"), d("Pincode 560001"), d("ABCDE1234F"), d("1-0-1 after food"), d("x"), expenses.is_summary(F.lit("Grand Total")))) == [True, False, False, False, False, True]


def test_cross_source_keeps_repeats_of_one_source(spark):
    rows = [(1, 1, 1, "semantic", "Room", 10.0), (1, 1, 2, "semantic", "Room", 10.0), (1, 1, 3, "heuristic", "room", 10.0)]
    df = spark.createDataFrame(rows, "claim_id int, page int, seq int, source string, description string, amount double")
    assert {r["seq"] for r in expenses.cross_source(df).collect()} == {1, 2}


def test_scrubbing(spark):
    text = "ssn 123-45-6789 tel 555-123-4567 a@b.com MRN: 12345 DOB: 1/2/1980 AB12345678 none"
    got = one(spark, documents.scrubbed(F.lit(text)), documents.scrubbed(F.lit("nothing here")), documents.scrubbed(F.lit("code X1"), ((r"X\d", "[X]"),)))
    assert got[0] == "ssn [SSN_REDACTED] tel [PHONE_REDACTED] [EMAIL_REDACTED] [MRN_REDACTED] [DOB_REDACTED] [POLICY_REDACTED] none" and got[1] == "nothing here" and got[2] == "code [X]"


def test_document_rules(spark):
    medical = "Discharge summary. Patient diagnosis treatment hospital doctor. " * 3
    got = one(spark, documents.document_class(F.lit("x.pdf"), F.lit(medical))["code"], documents.relevance(F.lit(medical))["relevant"], documents.relevance(F.lit("short"))["relevant"], documents.relevance(F.lit("curriculum vitae resume employment history of a person"))["relevant"], documents.last_amount(F.lit("Net payable Rs. 5,000 ... Net payable: 7,500.50"), documents.NET))
    assert list(got) == ["DISCHARGE_SUMMARY", True, False, False, 7500.5]


def test_chunks_overlap(spark):
    df = spark.createDataFrame([(1, "a" * 950), (2, ""), (3, "short"), (4, None)], "doc_id int, text string")
    got = [(r["doc_id"], r["chunk"], len(r["text"])) for r in documents.chunks(df).orderBy("doc_id", "chunk").collect()]
    assert got == [(1, 0, 500), (1, 1, 500), (1, 2, 150), (3, 0, 5)]


def test_fusion_promotes_what_both_lists_have(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id int, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, doc_id int, rank int")
    got = retrieval.top(retrieval.fused(a, b), 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [2, 1, 3] and retrieval.fused(a.limit(0), b.limit(0)).count() == 0


def test_transitions_and_edits(spark):
    acts = spark.createDataFrame([(1, "approve", 1), (1, "send_back", 2), (1, "dance", 3)], "claim_id int, action string, seq int").withColumn("at", F.timestamp_seconds("seq"))
    good, bad = lifecycle.transitions(acts)
    assert [(r["old_status"], r["new_status"]) for r in good.orderBy("seq").collect()] == [("RECEIVED", "APPROVED"), ("APPROVED", "MANUAL_REVIEW_REQUIRED")] and bad.count() == 1
    edits = spark.createDataFrame([(1, "f", 1, "a", "b"), (1, "f", 2, "b", "b"), (1, "f", 3, "b", "c"), (1, "g", 1, "x", "y"), (1, "g", 2, "y", "x")], "claim_id int, field string, seq int, old_value string, new_value string").withColumn("at", F.timestamp_seconds("seq"))
    assert [tuple(r) for r in lifecycle.edited(edits).collect()] == [(1, "f", "a", "c", 2)]


def test_feedback_is_clamped_at_each_event(spark):
    codes = spark.createDataFrame([(1, 0.95)], "code_id int, confidence double")
    events = spark.createDataFrame([(1, "accepted", 1), (1, "rejected", 2)], "code_id int, action string, seq long").withColumn("at", F.timestamp_seconds("seq"))
    assert abs(risk.with_feedback(codes, events).first()["adjusted"] - 0.7) < 1e-9


def test_last_document_stays(spark):
    docs = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "claim_id int, document_id int")
    left = lifecycle.without_documents(docs, spark.createDataFrame([(1,), (3,)], "document_id int"))
    assert {r["document_id"] for r in left.collect()} == {2, 3}


def test_payloads(spark):
    lines = spark.createDataFrame([(1, 1, None, 5.0), (2, 1, 99213, 7.0)], "claim_id int, seq int, code long, amount double")
    got = {r["claim_id"]: r["payload"] for r in lifecycle.payload("fhir", lines).collect()}
    assert "99999" in got[1] and "99213" in got[2] and '"total":{"value":7.0' in got[2]
    assert lifecycle.payload("unknown payer", lines).count() == 2


def test_synonyms_by_any_containment(spark):
    terms = spark.createDataFrame([("bronch",), ("echocardiogram",), ("x-ray, chest",), ("mr",), ("nothing",), ("echo",)], "term string")
    synonyms = spark.createDataFrame([("bronchitis", 1), ("acute bronchitis", 2), ("echo", 3), ("x-ray", 4), ("mri of brain", 5), ("ray", 6)], "synonym string, code long")
    got = {r["term"]: r["code"] for r in retrieval.by_synonym(terms, synonyms).collect()}
    assert got == {"bronch": 2, "echocardiogram": 3, "x-ray, chest": 4, "mr": 5, "nothing": None, "echo": 3}
    assert retrieval.by_synonym(terms.limit(0), synonyms).count() == 0 and {r["code"] for r in retrieval.by_synonym(terms, synonyms.limit(0)).collect()} == {None}


def test_diagnosis_terms_by_section_line_and_window(spark):
    long = " ".join(f"w{i}ord" for i in range(30)) + " then pneumonia " + " ".join(f"z{i}word" for i in range(30))
    texts = ["Impression: Acute bronchitis; asthma BP: 120/80\nTreatment: fever watch", "Seen. He has dengue now. Bye", long, "nothing", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["t"] for r in df.select("i", extraction.diagnosis_keywords(F.col("text")).alias("t")).collect()}
    assert got[0] == ["acute bronchitis", "asthma"] and got[1] == ["he has dengue now"] and len(got[2]) == 1 and "then pneumonia" in got[2][0] and not got[3] and not got[4] and not got[5]


def test_pattern_fields_reject_and_clean(spark):
    text = "Patient Name: claim form\nMr. Ravi Iyer aged 45\na baby girl: female, mother male\nAdmitted on 3/4/24\nCity Care Hospital, Pune\nDiagnosis: management\nFinal diagnosis: Acute appendicitis"
    got = {k: one(spark, extraction.pattern_field(F.lit(text), k))[0] for k in ("patient_name", "age", "admission_date", "hospital_name", "diagnosis", "claimed_total")}
    assert got == {"patient_name": "Ravi Iyer", "age": "45 Years", "admission_date": "03-04-2024", "hospital_name": "City Care Hospital", "diagnosis": "Acute appendicitis", "claimed_total": None}
    assert one(spark, *(extraction.pattern_field(F.lit(None).cast("string"), k) for k in extraction.FIELD_PATTERNS)) == (None,) * len(extraction.FIELD_PATTERNS)


def test_exact_history_is_the_pairs_filtered(spark):
    rows = [(i, i % 3, i % 2 if i % 5 else None, f"2024-01-{i % 9 + 1:02d}", float(i % 4)) for i in range(60)]
    claims = spark.createDataFrame(rows, "claim_id long, patient_id long, policy_id long, d string, amount double").withColumn("created_at", F.to_timestamp("d"))
    facts = claims.select("claim_id", "amount", F.col("created_at").cast("date").alias("service_date"))
    want = {tuple(r) for r in fraud.exact_duplicates(fraud.history_pairs(claims, 30), facts, 1.5).collect()}
    assert {tuple(r) for r in fraud.exact_history(claims, facts, 30, 1.5).collect()} == want and len(want) > 50


def test_code_context_before_and_after(spark):
    df = spark.createDataFrame([(1, "Diagnosis: acute bronchitis ICD-10: J20.9"), (2, "K35 - acute appendicitis | ward"), (3, "phone 55123"), (4, None), (5, "procedure 1: laparoscopic repair of\nhernia 49505")], "doc_id int, text string")
    got = {r["doc_id"]: (r["code"], r["context"]) for r in documents.code_mentions(df, spark.createDataFrame([("J20.9", "x")], "code string, description string")).collect()}
    assert got == {1: ("J20.9", "acute bronchitis"), 2: ("K35", "acute appendicitis"), 5: ("49505", "laparoscopic repair of hernia")}


def test_history_pairs_are_made_once_and_never_shuffled(spark):
    rows = [(1, 1, 10, "2024-03-01"), (2, 1, 10, "2024-02-20"), (3, 2, 10, "2024-02-25"), (4, None, 10, "2024-02-26"), (5, 1, None, "2024-02-27"), (6, None, None, "2024-02-28"), (2, 1, 10, "2024-02-20")]
    claims = spark.createDataFrame(rows, "claim_id long, patient_id long, policy_id long, at string").selectExpr("claim_id", "patient_id", "policy_id", "cast(at as timestamp) AS created_at")
    told = spark.createDataFrame([(i, i * 10) for i in range(1, 7)], "other_id long, amount long")
    found = fraud.history_pairs(claims, 30, told)
    want = {(1, 2), (1, 3), (1, 4), (1, 5), (3, 2), (4, 2), (4, 3), (5, 2)}
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, b, b * 10) for a, b in want)
    # Above the joins lie only projections and the union: neither distinct nor a join by the other's id.
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Union" in plan[0] and not any("Aggregate" in line for line in plan[: next(i for i, line in enumerate(plan) if "Join" in line)])


def test_a_layer_alone_joins_only_its_children(spark):
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables here")
    plan = plans.m3(spark, at)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "matches" not in plan and "Join" in plan
    assert "supplier" not in plans.x1_evidence(spark, at)._jdf.queryExecution().analyzed().toString()


def test_search_grows_with_sets_of_words(spark):
    """F8: thousands of documents of one text meet a query as one kind, and the k smallest of them are told."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "large ring ring").when(F.col("id") % 3 == 0, "Ring large").when(F.col("id") == 5, "ring").when(F.col("id") == 7, "a of").otherwise("large bolt").alias("text"))
    asked = spark.createDataFrame([(1, "large ring"), (2, "RING, large done"), (3, "bolt"), (4, "nowhere"), (5, None)], "query_id long, text string")
    got = retrieval.catalogue_hits(asked, docs, "doc_id", F.col("text"), 3)
    rows = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect())
    assert sorted(len(r["ids"]) for r in retrieval.kinds(docs, "doc_id", F.col("text"), 3).collect()) == [1, 3, 3]
    assert rows == [(1, 1, 0, 2), (1, 2, 2, 2), (1, 3, 3, 2), (2, 1, 0, 2), (2, 2, 2, 2), (2, 3, 3, 2), (3, 1, 1, 1), (3, 2, 11, 1), (3, 3, 13, 1)]


def test_null_codes_are_claimed_and_found(spark):
    """F16: as the SQL's EXCEPT has it, a null code on both sides is supported."""
    rows = lambda *r: spark.createDataFrame(list(r), "claim_id long, code long")
    got = retrieval.unsupported(rows((1, None), (1, 2), (1, 2), (2, None)), rows((1, None), (1, 3))).collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, 2, 'unsupported')", "(1, 3, 'missing')", "(2, None, 'unsupported')"]


def test_assigned_rows_are_dealt_by_their_count(spark, monkeypatch):
    """partitions grow with the rows, and a term that two claims name is each one's own."""
    monkeypatch.setattr(retrieval, "TASK_ROWS", 10)
    hits = spark.range(100).selectExpr("id AS claim_id", "'fever' AS term", "id % 7 AS code", "0.6D AS score")
    got = retrieval.assigned(spark.createDataFrame([], "claim_id long, code long"), hits)
    assert got.count() == 100 and got.rdd.getNumPartitions() == 10
