"""Risk and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import fraud, risk, validation
from claimloom.plans.fields import LONG, claim_fields
from claimloom.plans.fraud import WIDE
from claimloom.plans.fraud import wide as fraud_wide
from claimloom.plans.registry import query, raw, role


def features(spark, d):
    lines = role(spark, d, "expenses")
    codes = lines.select("claim_id", "code", F.when(F.col("category") == "Pharmacy", "ICD10").otherwise("CPT").alias("code_system"), (F.col("seq") == 1).alias("is_primary"))
    entities = lines.select("claim_id", F.concat(F.lit("D"), (F.col("code") % 50).cast("string")).alias("entity_text"), F.when(F.col("line_status") == "O", "DIAGNOSIS").otherwise("PROCEDURE").alias("entity_type"))
    return risk.features(claim_fields(spark, d), codes, entities)


FEATURES = f"""{LONG},
    l AS (SELECT claim_id, count(*) FILTER (category = 'Pharmacy') AS icd, count(*) FILTER (category <> 'Pharmacy') AS cpt, count(DISTINCT CASE WHEN line_status = 'O' THEN code % 50 END) AS dx, count(*) AS entities, sum(CASE WHEN line_status = 'O' THEN floor(amount)::BIGINT END)::BIGINT AS o, sum(CASE WHEN line_status = 'F' THEN floor(amount)::BIGINT END)::BIGINT AS f, count(DISTINCT line_status) AS parts FROM expenses GROUP BY 1),
    ft AS (SELECT b.claim_id, (b.patient_name IS NOT NULL)::INT AS has_patient_name, 1 AS has_policy_number, 0 AS has_diagnosis, 1 AS has_service_date, 1 AS has_total_amount, (b.segment IS NOT NULL)::INT AS has_provider, 7 + coalesce(parts, 0) AS num_parsed_fields, coalesce(entities, 0) AS num_entities,
        coalesce(icd, 0) AS num_icd_codes, coalesce(cpt, 0) AS num_cpt_codes, (coalesce(icd, 0) > 0)::INT AS has_primary_icd, coalesce(dx, 0) AS num_diagnosis_types, coalesce(o, f, floor(b.total_amount))::DOUBLE AS amount FROM base b LEFT JOIN l USING (claim_id))"""


@query("m1_features", f"""WITH {FEATURES} SELECT claim_id, has_patient_name, has_policy_number, has_diagnosis, has_service_date, has_total_amount, has_provider, num_parsed_fields, num_entities, num_icd_codes, num_cpt_codes, has_primary_icd, num_diagnosis_types,
    round(ln(1 + amount), 4) AS total_amount_log, round(ln(1 + amount / greatest(num_cpt_codes, 1)), 4) AS amount_per_cpt_log FROM ft""", "claims patients expenses")  # fmt: skip
def m1(spark, d):
    names = ["claim_id", *risk.FEATURES[:12]]
    return features(spark, d).select(*names, F.round("total_amount_log", 4).alias("total_amount_log"), F.round("amount_per_cpt_log", 4).alias("amount_per_cpt_log"))


SCORE = f"""{FEATURES}, sc AS (SELECT *, 0.12 + (1 - has_patient_name) * 0.08 + CASE WHEN num_icd_codes = 0 THEN 0.08 ELSE 0 END AS comp,
    CASE WHEN ln(1 + amount) > 14 THEN 0.20 WHEN ln(1 + amount) > 13 THEN 0.12 WHEN ln(1 + amount) > 11.5 THEN 0.08 ELSE 0 END + CASE WHEN num_icd_codes > 3 THEN 0.08 WHEN num_icd_codes > 1 THEN 0.04 ELSE 0 END + CASE WHEN num_cpt_codes > 2 THEN 0.06 WHEN num_cpt_codes > 1 THEN 0.03 ELSE 0 END AS sev FROM ft),
    risk AS (SELECT *, round(comp + sev, 4) AS risk_score FROM sc)"""


@query("m4_risk_score", f"""WITH {SCORE} SELECT claim_id, risk_score, CASE WHEN risk_score <= .25 THEN 'LOW' WHEN risk_score <= .5 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_category FROM risk""", "claims patients expenses")
def m4(spark, d):
    return risk.scored(features(spark, d)).select("claim_id", "risk_score", "risk_category")


@query("m5_o3_reasons", f"""WITH {SCORE}, u AS (SELECT claim_id, unnest([has_patient_name = 0, true, num_icd_codes = 0, has_primary_icd = 0, ln(1 + amount) > 11.5, num_icd_codes > 1, num_cpt_codes > 1]) AS there,
        unnest(['Missing patient name', 'Missing diagnosis', 'No ICD-10 codes found', 'No primary ICD code designated', CASE WHEN ln(1 + amount) > 14 THEN 'Very high claim amount' WHEN ln(1 + amount) > 13 THEN 'High claim amount' ELSE 'Significant claim amount' END, CASE WHEN num_icd_codes > 3 THEN 'Complex case by ICD codes' ELSE 'Multiple ICD codes' END, CASE WHEN num_cpt_codes > 2 THEN 'Multiple procedures' ELSE 'Two procedures performed' END]) AS reason,
        unnest([0.08, 0.12, 0.05, 0.03, CASE WHEN ln(1 + amount) > 14 THEN 0.20 WHEN ln(1 + amount) > 13 THEN 0.12 ELSE 0.08 END, CASE WHEN num_icd_codes > 3 THEN 0.08 ELSE 0.04 END, CASE WHEN num_cpt_codes > 2 THEN 0.06 ELSE 0.03 END]) AS weight FROM risk),
    n AS (SELECT claim_id, reason, weight FROM u WHERE there)
    SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY weight DESC, reason) AS rank, reason, weight::DOUBLE AS weight FROM n QUALIFY rank <= 5""", "claims patients expenses")  # fmt: skip
def m5(spark, d):
    rows = risk.scored(features(spark, d)).select("claim_id", F.posexplode("top_reasons").alias("at", "r"))
    return rows.select("claim_id", (F.col("at") + 1).cast("long").alias("rank"), "r.reason", "r.weight")


@query("m2_sum_insured", "SELECT doc_id, try_cast(replace(nullif(regexp_extract(text || ' Sum Insured: Rs. ' || n_chars || ',000', '(?i)sum\\s*insured\\s*[:\\-]?\\s*(?:(?:rs|inr|\\$)\\.?\\s*)?([\\d,]+\\.?\\d*)', 1), ''), ',', '') AS DOUBLE) AS insured FROM documents")
def m2(spark, d):
    text = F.concat("text", F.lit(" Sum Insured: Rs. "), F.col("n_chars").cast("string"), F.lit(",000"))
    return raw(spark, d, "documents").select("doc_id", risk.amount_lenient(F.regexp_extract(text, r"(?i)sum\s*insured\s*[:\-]?\s*(?:(?:rs|inr|\$)\.?\s*)?([\d,]+\.?\d*)", 1)).alias("insured"))


@query("m6_override", """SELECT claim_id, CASE WHEN policy_id % 7 >= 5 OR total_amount > 300000 THEN greatest(total_amount / 600000, 0.55) ELSE total_amount / 600000 END AS score FROM claims""", "claims")
def m6(spark, d):
    c = F.col
    return role(spark, d, "claims").select("claim_id", risk.overridden(c("total_amount") / 600000, F.when(c("total_amount") > 300000, 0.9).otherwise(0.1), c("policy_id") % 7).alias("score"))


NAMES = ["chars", "words", "capitals", "marks", "digits"]


def labelled(spark, d):
    """M7's table: shape features of documents with their quality label."""
    t = F.col("text")
    docs = raw(spark, d, "documents").select("doc_id", F.log1p(F.length(t)).alias("chars"), F.log1p(F.size(F.split(t, r"\s+"))).alias("words"), (F.regexp_count(t, F.lit("[A-Z]")) / F.greatest(F.length(t), F.lit(1))).alias("capitals"), (F.regexp_count(t, F.lit(r"[|#$%&*!]")) / F.greatest(F.length(t), F.lit(1))).alias("marks"), F.log1p(F.regexp_count(t, F.lit("[0-9]"))).alias("digits"))
    return docs.join(raw(spark, d, "labels"), "doc_id")


@query("m7_classifier")
def m7(spark, d):
    rows = labelled(spark, d)
    model = risk.fit_classifier(rows.where("doc_id % 4 <> 0"), NAMES, "quality")
    return risk.classify(model, rows, NAMES).select("doc_id", "quality", "score", "predicted", (F.col("doc_id") % 4 == 0).alias("held_out"))


@query("m9_importances")
def m9(spark, d):
    return risk.importances(spark, risk.fit_classifier(labelled(spark, d), NAMES, "quality"), NAMES)


@query("m8_blend_weight", """WITH r AS (SELECT least(total_amount / 400000, 1) AS a, (policy_id % 100) / 100.0 AS b, (status = 'COMPLETED')::INT AS label FROM claims),
    g AS (SELECT step, avg(((step / 50.0 * a + (1 - step / 50.0) * b >= 0.5)::INT = label)::INT) AS accuracy FROM r, range(51) t(step) GROUP BY step)
    SELECT step::INT AS step, round(accuracy, 6) AS accuracy FROM g ORDER BY accuracy DESC, step LIMIT 1""", "claims")  # fmt: skip
def m8(spark, d):
    rows = role(spark, d, "claims").select(F.least(F.col("total_amount") / 400000, F.lit(1.0)).alias("a"), ((F.col("policy_id") % 100) / 100.0).alias("b"), (F.col("status") == "COMPLETED").cast("int").alias("label"))
    return risk.blend_weight(rows).select("step", F.round("accuracy", 6).alias("accuracy"))


@query("m10_feedback_confidence", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'purchase' THEN 0.1 WHEN 'click' THEN -0.3 WHEN 'view' THEN -0.2 ELSE 0 END AS delta FROM activity),
    f AS (SELECT user_id, 0::BIGINT AS n, 0.6::DOUBLE AS c FROM (SELECT DISTINCT user_id FROM e) UNION ALL SELECT e.user_id, e.n, greatest(least(f.c + e.delta, 1), 0) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id AS code_id, round(arg_max(c, n), 6) AS adjusted FROM f GROUP BY 1""", "activity")  # fmt: skip
def m10(spark, d):
    rows = role(spark, d, "activity")
    kind = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "click", "rejected").when(F.col("event_type") == "view", "corrected")
    codes = rows.select(F.col("user_id").alias("code_id")).distinct().withColumn("confidence", F.lit(0.6))
    return risk.with_feedback(codes, rows.select(F.col("user_id").alias("code_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.coalesce(kind, F.lit("none")).alias("action"))).select("code_id", F.round("adjusted", 6).alias("adjusted"))


def wide(spark, d):
    """V12's wide row: features, risk score and fraud assessment of every claim; fraud comes first."""
    rows = risk.scored(features(spark, d), risk.FEATURES).withColumnRenamed("risk_score", "rejection_score")
    # Validation asks for the score and category alone: what would be shown as evidence isn't gathered.
    found = fraud.assessment(fraud_wide(spark, d, evidence=0)).select("claim_id", "fraud_score", "fraud_category")
    return rows.join(found, "claim_id", "left")


@query("v1_v10_rules", f"""WITH {SCORE}, v AS (SELECT claim_id, unnest(['R001', 'R002', 'R003', 'R004', 'R005', 'R006', 'R007', 'R008', 'R009', 'R010']) AS rule_id,
    unnest([has_patient_name = 1, true, false, num_icd_codes > 0, true, true, has_provider = 1, risk_score < 0.5, num_cpt_codes > 0, has_primary_icd = 1]) AS passed, unnest(['ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'WARN', 'WARN', 'WARN', 'WARN', 'WARN']) AS level FROM risk)
    SELECT claim_id, rule_id, passed, CASE WHEN passed THEN 'PASS' ELSE level END AS severity FROM v""", "claims patients expenses")  # fmt: skip
def v1(spark, d):
    rows = risk.scored(features(spark, d), risk.FEATURES).withColumnRenamed("risk_score", "rejection_score")
    out = validation.validated(rows.withColumn("fraud_score", F.lit(None).cast("double")).withColumn("fraud_category", F.lit(None).cast("string")))
    return out.where("rule_id <> 'R011'").select("claim_id", "rule_id", "passed", "severity")


@query("v12_a18_validation_summary", f"""WITH {SCORE}, {WIDE}, c AS (SELECT claim_id, round((0.5 * rules_score + 0.4 * ml_score) / 0.9, 4) AS fraud FROM z),
    v AS (SELECT claim_id, (has_patient_name = 0)::INT + 1 + (num_icd_codes = 0)::INT + (fraud >= 0.7)::INT AS errors, (has_provider = 0)::INT + (risk_score >= 0.5)::INT + (num_cpt_codes = 0)::INT + (has_primary_icd = 0)::INT + (fraud >= 0.4 AND fraud < 0.7)::INT AS warnings FROM risk JOIN c USING (claim_id))
    SELECT claim_id, 11::BIGINT AS total, 11 - errors - warnings AS passed, errors + warnings AS failed, warnings, errors FROM v""", "claims patients expenses providers")  # fmt: skip
def v12(spark, d):
    return validation.summary(validation.validated(wide(spark, d)))
