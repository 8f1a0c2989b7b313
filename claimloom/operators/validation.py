"""Validation rules R001 to R011 over one wide row per claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "array<struct<rule_id:string,rule_name:string,passed:boolean,severity:string,message:string>>"


def rule(rule_id: str, name: str, passed: Column, severity: Column | str, good: Column | str, bad: Column | str) -> Column:
    """A passed rule has severity PASS; a condition that can't be told fails with ERROR."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    level = F.when(passed, "PASS").when(passed.isNull(), "ERROR").otherwise(lit(severity))
    told = F.when(passed, lit(good)).when(passed.isNull(), F.lit(f"Rule {rule_id} raised an exception")).otherwise(lit(bad))
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule_name"), F.coalesce(passed, F.lit(False)).alias("passed"), level.alias("severity"), told.alias("message"))


def rules() -> Column:
    """V1 to V11 as one array. Columns: the has_ flags, counts, rejection_score, fraud_score, fraud_category."""
    c = F.col
    present = [
        ("R001", "Patient name present", "has_patient_name", "ERROR", "Patient name"), ("R002", "Policy number present", "has_policy_number", "ERROR", "Policy number"),
        ("R003", "Diagnosis present", "has_diagnosis", "ERROR", "Diagnosis"), ("R004", "ICD-10 code present", "num_icd_codes", "ERROR", "ICD-10 code"),
        ("R005", "Date of service present", "has_service_date", "ERROR", "Date of service"), ("R006", "Total amount present", "has_total_amount", "WARN", "Total amount"),
        ("R007", "Provider name present", "has_provider", "WARN", "Provider name"),
    ]
    out = [rule(i, n, c(f) > 0, s, f"{t} found", f"{t} is missing") for i, n, f, s, t in present]
    score = F.format_string("%.2f", c("rejection_score"))
    out.append(rule("R008", "Rejection score check", c("rejection_score").isNull() | (c("rejection_score") < 0.5), "WARN", F.when(c("rejection_score").isNull(), "No prediction available").otherwise(F.concat(F.lit("Rejection risk acceptable: "), score)), F.concat(F.lit("High rejection risk: "), score)))
    out.append(rule("R009", "CPT code present", c("num_cpt_codes") > 0, "WARN", "CPT code found", "No CPT code found"))
    out.append(rule("R010", "Primary ICD designated", c("has_primary_icd") > 0, "WARN", "Primary ICD-10 code designated", "No primary ICD-10 code designated"))
    fine = c("fraud_score").isNull() | ~F.coalesce(c("fraud_category").isin("HIGH", "MEDIUM"), F.lit(False))
    out.append(rule("R011", "Fraud risk check", fine, F.when(c("fraud_category") == "HIGH", "ERROR").otherwise("WARN"), "Fraud risk acceptable", F.concat(F.lit("Fraud risk "), c("fraud_category"))))
    return F.array(*out)


def validated(wide: DataFrame) -> DataFrame:
    """Eleven rows per claim."""
    return wide.select("claim_id", F.inline(rules().cast(RESULT)))


def summary(results: DataFrame) -> DataFrame:
    """A18."""
    return results.groupBy("claim_id").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("severity") == "WARN").alias("warnings"), F.count_if(F.col("severity") == "ERROR").alias("errors"))
