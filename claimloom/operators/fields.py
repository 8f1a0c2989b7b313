"""Field resolution over a long (claim, field, value, extractor) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.scalars import blank_to_null, field_key, first_number

#: Canonical fields with their aliases, in the order in which they are tried (fixed values).
ALIASES: dict[str, tuple[str, ...]] = {
    "patient_name": ("patient_name", "patientname", "name", "patient_full_name", "full_name"),
    "policy_number": ("policy_number", "policynumber", "policy_id", "policyid", "policy", "member_id", "memberid"),
    "patient_age": ("age", "patient_age", "patientage", "patient_dob", "dob", "date_of_birth"),
    "patient_gender": ("gender", "patient_gender", "sex", "patient_sex"),
    "service_date": ("service_date", "servicedate", "dos", "date_of_service", "admission_date", "date_of_admission", "doa", "discharge_date", "date_of_discharge", "dod"),
    "admission_date": ("admission_date", "admissiondate", "date_of_admission", "doa", "admitted_date"),
    "discharge_date": ("discharge_date", "dischargedate", "date_of_discharge", "dod", "discharged_date"),
    "diagnosis": ("diagnosis", "primary_diagnosis", "primary_diag", "chief_complaint", "presenting_complaint"),
    "secondary_diagnosis": ("secondary_diagnosis", "secondary_diag", "comorbidity", "comorbidities", "additional_diagnosis", "other_diagnosis"),
    "provider_name": ("provider_name", "providername", "hospital_name", "hospitalname", "hospital", "facility_name", "doctor_name", "docname", "treating_doctor", "physician", "surgeon", "healthcare_provider"),
    "total_amount": ("total_amount", "totalamount", "claimed_total", "claimed_amount", "claim_amount", "calculated_total", "net_amount", "grand_total", "gross_total", "billed_amount", "billing_amount"),
    "sum_insured": ("sum_insured", "suminsured", "cover_amount", "coverage_amount", "policy_limit", "sum_assured", "policy_sum"),
    "ward_type": ("ward_type", "wardtype", "room_type", "roomtype", "room_category", "ward_category"),
    "room_charges": ("room_charges", "room_charge", "boarding_charges", "boarding_charge", "room_fee", "room_rent"),
    "consultation_charges": ("consultation_charges", "consultation_charge", "consultation_fee", "consultation_fees", "doctor_fee", "doctor_fees"),
    "surgeon_fees": ("surgeon_fees", "surgeon_fee", "surgeon_charges", "surgical_fee", "surgical_fees", "professional_fees"),
    "nursing_charges": ("nursing_charges", "nursing_charge", "nursing_fee", "nursing_fees", "nursing_support", "support_services"),
    "ot_charges": ("ot_charges", "ot_charge", "operation_theatre", "operation_theater", "theatre_charges"),
    "surgery_charges": ("surgery_charges", "surgery_charge", "surgical_charges", "surgical_charge", "procedure_charges"),
    "anaesthesia_charges": ("anaesthesia_charges", "anaesthesia_charge", "anesthesia_charges", "anaesthesia_fee", "anesthesia_fee", "anaesthesia_fees"),
    "laboratory_charges": ("laboratory_charges", "laboratory_charge", "lab_charges", "laboratory_fee", "lab_fee", "pathology_charges"),
    "radiology_charges": ("radiology_charges", "radiology_charge", "imaging_charges", "xray_charges", "ct_charges", "mri_charges"),
    "investigation_charges": ("investigation_charges", "investigation_charge", "diagnostic_charges", "diagnostics_charges", "tests_charges"),
    "pharmacy_charges": ("pharmacy_charges", "pharmacy_charge", "medication_charges", "medicine_charges", "drug_charges"),
    "consumables": ("consumables", "consumable_charges", "medical_consumables", "surgical_consumables", "supplies_charges", "materials_charges"),
    "icu_charges": ("icu_charges", "icu_charge", "intensive_care_charges", "icu_fee", "critical_care_charges"),
    "isolation_charges": ("isolation_charges", "isolation_charge", "isolation_fee", "quarantine_charges"),
    "blood_charges": ("blood_charges", "blood_charge", "blood_transfusion_charges", "transfusion_charges", "blood_products"),
    "physiotherapy_charges": ("physiotherapy_charges", "physiotherapy_charge", "physio_charges", "rehabilitation_charges", "therapy_charges"),
    "chemotherapy_charges": ("chemotherapy_charges", "chemotherapy_charge", "chemo_charges", "oncology_charges"),
    "transplant_charges": ("transplant_charges", "transplant_charge", "stem_cell_charges", "organ_transplant"),
    "ambulance_charges": ("ambulance_charges", "ambulance_charge", "ambulance_fee", "transportation_charges"),
    "misc_charges": ("misc_charges", "misc_charge", "miscellaneous_charges", "miscellaneous_fee", "other_charges", "other_charge"),
    "implant_charges": ("implant_charges", "implant_charge", "prosthesis_charges", "prosthetic_charges", "device_charges"),
}
EXPENSE_FIELDS = tuple(k for k in ALIASES if k.endswith(("_charges", "_fees")) or k == "consumables")
#: Extractors of money fields, most trusted first (fixed values).
TRUST = ("expense-table-v4", "expense-table-geo-v1", "expense-table-v2", "heuristic-v2")
MONEY = (*EXPENSE_FIELDS, "total_amount", "net_payable", "net_amount", "billed_amount", "claimed_total", "other_charges")


def alias_table(spark) -> DataFrame:
    """(canonical, ordinal, alias): the dimension that resolves field names; its size is fixed."""
    return spark.createDataFrame([(k, i, a) for k, names in ALIASES.items() for i, a in enumerate(names)], "canonical string, ordinal int, alias string")


def resolved(fields: DataFrame) -> DataFrame:
    """(claim_id, canonical, value): the first alias, in order, that has a value.

    Rows of one alias go by (created_at, id): the last one counts.
    """
    named = fields.select("claim_id", field_key(F.col("field_name")).alias("alias"), blank_to_null(F.col("field_value")).alias("value"), "created_at", "id").where("value IS NOT NULL")
    last = named.groupBy("claim_id", "alias").agg(F.max_by("value", F.struct("created_at", "id")).alias("value"))
    return last.join(F.broadcast(alias_table(fields.sparkSession)), "alias").groupBy("claim_id", "canonical").agg(F.min_by("value", "ordinal").alias("value"))


def by_claim(fields: DataFrame) -> DataFrame:
    """(claim_id, fields): a claim's rows of the long table as one array, for what needs all of them at once."""
    return fields.groupBy("claim_id").agg(F.collect_list(F.struct("field_name", "field_value", "created_at", "id")).alias("fields"))


def resolved_maps(claims: DataFrame) -> DataFrame:
    """F10 over by_claim()'s arrays: adds `resolved`, a map of canonical name to value, chosen as resolved() does.

    A claim's rows are ordered within their array, so nothing is shuffled or sorted across claims.
    """
    found: dict[str, list] = {}
    for name, names in ALIASES.items():
        for i, alias in enumerate(names):
            found.setdefault(alias, []).append(F.struct(F.lit(name).alias("canonical"), F.lit(-i).alias("before")))
    canonical = F.create_map(*(c for alias, of in found.items() for c in (F.lit(alias), F.array(*of))))
    filled = F.filter("fields", lambda r: F.trim(r["field_value"]) != "")
    meant = lambda r: F.transform(F.try_element_at(canonical, field_key(r["field_name"])), lambda c: F.struct(c["canonical"], c["before"], r["created_at"].alias("created_at"), r["id"].alias("id"), F.trim(r["field_value"]).alias("value")))
    rows = claims.withColumn("ordered", F.array_sort(F.flatten(F.array_compact(F.transform(filled, meant)))))
    # In ascending order the last of each name is the one that counts.
    after = lambda i: F.get("ordered", i + 1)["canonical"]
    last = F.filter("ordered", lambda x, i: after(i).isNull() | (after(i) != x["canonical"]))
    return rows.withColumn("resolved", F.map_from_entries(F.transform(last, lambda x: F.struct(x["canonical"], x["value"])))).drop("ordered")


def merged(fields: DataFrame, policy: str = "last") -> DataFrame:
    """The three merge policies of duplicate rows: last, first, or best."""
    if policy == "best":
        return best_values(fields)
    order = F.struct("created_at", "id")
    pick = F.max_by if policy == "last" else F.min_by
    return fields.groupBy("claim_id", "field_name").agg(pick("field_value", order).alias("value"))


def pivoted(fields: DataFrame, names: list[str]) -> DataFrame:
    """A1: one row per claim with the named fields as columns; the last row counts."""
    return fields.groupBy("claim_id").pivot("field_name", names).agg(F.max_by("field_value", F.struct("created_at", "id")))


def trust(version: Column) -> Column:
    out = F.lit(len(TRUST))
    for i, name in reversed(list(enumerate(TRUST))):
        out = F.when(F.startswith(F.coalesce(version, F.lit("")), F.lit(name)), i).otherwise(out)
    return out


def best_values(fields: DataFrame) -> DataFrame:
    """A2: the best value per claim and field.

    Money: the most trusted extractor with a number; expense tables sum, others take the
    largest. Age: the smallest from 1 to 120. Else the least noisy text: fewest pipes and line
    feeds, at least four characters, longest.
    """
    value = F.col("field_value")
    rows = fields.where(F.trim(value) != "")
    number = F.when(F.col("field_name").isin(*MONEY), first_number(value))
    rows = rows.withColumn("number", number).withColumn("trust", F.when(number.isNotNull(), trust(F.col("model_version"))))
    rows = rows.withColumn("age", F.when(F.col("field_name") == "age", F.array_min(F.filter(F.transform(F.regexp_extract_all(value, F.lit(r"\b(\d{1,3})\b"), F.lit(1)), lambda x: x.cast("int")), lambda n: n.between(1, 120)))))
    pipes, lines = F.length(value) - F.length(F.replace(value, F.lit("|"), F.lit(""))), F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))
    noise = F.struct(pipes + 2 * lines, F.when(F.length(value) >= 4, 0).otherwise(1), -F.length(value), "created_at", "id")
    least = F.min("trust").over(Window.partitionBy("claim_id", "field_name"))
    rows = rows.withColumn("noise", noise).withColumn("least", least)
    mine = F.col("trust") == F.col("least")
    out = rows.groupBy("claim_id", "field_name").agg(
        F.min("least").alias("least"), F.sum(F.when(mine, F.col("number"))).alias("total"), F.max(F.when(mine, F.col("number"))).alias("most"),
        F.min("age").alias("age"), F.min_by(F.trim(value), "noise").alias("cleanest"),
    )
    money = F.when(F.col("least") < 3, F.col("total")).otherwise(F.col("most"))
    return out.select("claim_id", "field_name", F.coalesce(F.when(money.isNotNull(), F.format_string("%.2f", money)), F.col("age").cast("string"), "cleanest").alias("value"))


def is_label(value: Column) -> Column:
    """A field's label rather than a value."""
    return F.lower(F.trim(value)).rlike(r"^(?:patient\s*name|name|age|sex|gender|date|policy(?:\s*(?:no|number))?|hospital|doctor|diagnosis|address|phone|amount|total)\s*[:\-]?$")


def is_person(value: Column) -> Column:
    """Two to six words, no digits, colons or medical words."""
    n = F.size(F.split(F.trim(value), r"\s+"))
    return n.between(2, 6) & ~value.rlike(r"[0-9:]") & ~F.lower(value).rlike(r"\b(?:hospital|clinic|diagnosis|patient|report|ward|summary|department|medical)\b")


def resolved_candidates(candidates: DataFrame) -> DataFrame:
    """A3: per claim and field the accepted candidate of most confidence, and what was rejected."""
    fits = ~is_label(F.col("value")) & (F.trim("value") != "") & ((F.col("field_name") != "patient_name") | is_person(F.col("value")))
    rows = candidates.withColumn("accepted", F.coalesce(fits, F.lit(False)))
    order = F.struct(F.col("accepted").cast("int"), "confidence", -F.col("seq"))
    best = F.max_by(F.struct("value", "confidence", "accepted"), order)
    out = rows.groupBy("claim_id", "field_name").agg(best.alias("b"), F.count_if(~F.col("accepted")).alias("rejected"))
    return out.select("claim_id", "field_name", F.when(F.col("b.accepted"), F.col("b.value")).alias("value"), F.when(F.col("b.accepted"), F.col("b.confidence")).alias("confidence"), "rejected")


def cross_document(fields: DataFrame) -> DataFrame:
    """Fields found in two documents or more, and whether their values agree."""
    same = field_key(F.col("field_value"))
    return fields.groupBy("claim_id", "field_name").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct(same).alias("values")).where("documents >= 2").withColumn("agrees", F.col("values") == 1)


def named_twice(claims: DataFrame) -> DataFrame:
    """(claim_id, field_name, field_value, document_id) of the fields that a claim's array names twice or more.

    All others can't be in two documents. Rows stay where their claim is: counts by claim and field need no shuffle.
    """
    rows = claims.select("claim_id", F.array_sort(F.transform("fields", lambda r: F.struct(r["field_name"].alias("field_name"), r["field_value"].alias("field_value"), r["document_id"].alias("document_id")))).alias("ordered"))
    beside = lambda x, i: (i >= 0) & (i < F.size("ordered")) & F.get("ordered", i)["field_name"].eqNullSafe(x["field_name"])
    return rows.select("claim_id", F.inline(F.filter("ordered", lambda x, i: beside(x, i - 1) | beside(x, i + 1))))


def nested(fields: DataFrame) -> DataFrame:
    """Per claim a map of document type to a map of field to its first value."""
    first = fields.groupBy("claim_id", "doc_type", "field_name").agg(F.min_by("field_value", F.struct("created_at", "id")).alias("value"))
    by_type = first.groupBy("claim_id", "doc_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "value")))).alias("fields"))
    return by_type.groupBy("claim_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_type", F.to_json("fields").alias("fields"))))).alias("documents"))
