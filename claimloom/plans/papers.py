"""Document rules over papers: texts whose labels, order, amounts, negations and formats vary with the document's id.

The driver's documents carry no medical words, so a paper's lines are made from its id by one SQL
expression that Spark and DuckDB share; most end with the document's own text. The expected
answer of every row is worked out in SQL from the id, not from the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import documents, extraction, layout
from claimloom.plans.registry import query, raw

NL = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(n: int, *options: str, by: str = "doc_id") -> str:
    """One of the SQL expressions, by the id modulo n; the last for the rest."""
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options[:-1]))
    return f"(CASE {by} % {n} {cases} ELSE {options[-1]} END)"


def papers(spark, d, **columns: str):
    return raw(spark, d, "documents").selectExpr("doc_id", "source", *(f"{e} AS {c}" for c, e in columns.items()))


FIRST = pick(5, *map(q, ("Asha", "Ravi", "Meera", "Kabir", "Nisha")))
LAST = pick(3, *map(q, ("Rao", "Iyer", "Sen")))
NAME = f"({FIRST} || ' ' || {LAST})"
#: 1,510.25 and the like.
THOUSANDS, REST = "(doc_id % 9 + 1)", "(doc_id % 10)"
AMOUNT = f"({THOUSANDS} || ',5' || {REST} || '0.25')"
VALUE = f"({THOUSANDS} * 1000 + 500 + {REST} * 10 + 0.25)"

# ---------------------------------------------------------------- classes

#: Title, class, report view, reimbursement type, parser type.
TITLES = (
    ("Discharge Summary", "DISCHARGE_SUMMARY", "discharge", "Discharge Summary", "discharge_summary"), ("Indoor case paper", "ADMISSION_RECORD", "other", "Supporting Document", "hospital_bill"),
    ("Medication chart", "PRESCRIPTION", "prescription", "Supporting Document", "prescription"), ("Blood test", "LAB_REPORT", "investigation", "Lab Report", "hospital_bill"),
    ("Ultrasound report", "RADIOLOGY_REPORT", "investigation", "Radiology Report", "hospital_bill"), ("Operative note", "SURGICAL_NOTE", "other", "Supporting Document", "hospital_bill"),
    ("Referral letter", "CONSULTATION", "other", "Supporting Document", "hospital_bill"), ("Final bill", "BILL_INVOICE", "bill", "Hospital Bill", "hospital_bill"),
    ("Cashless form, sum insured", "INSURANCE_FORM", "claim_form", "Insurance Claim Form", "insurance_form"), ("Passport copy", "ID_DOCUMENT", "identity", "KYC / ID", "hospital_bill"),
    ("Informed consent", "CONSENT_FORM", "other", "Supporting Document", "hospital_bill"), ("ECG tracing", "INVESTIGATION", "investigation", "Investigation Report", "hospital_bill"),
    ("Notes", "UNKNOWN", "other", "Supporting Document", "hospital_bill"),
)
TITLE = pick(13, *(q(t[0]) for t in TITLES))
CASED = f"(CASE WHEN doc_id % 2 = 0 THEN {TITLE} ELSE upper({TITLE}) END)"


@query("d1_d2_classes", f"""SELECT doc_id, {pick(13, *(q(t[1]) for t in TITLES))} AS code, {pick(13, *(q(t[2]) for t in TITLES))} AS report_view, {pick(13, *(q(t[3]) for t in TITLES))} AS reimbursement,
    CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN 'hospital_bill' ELSE {pick(13, *(q(t[4]) for t in TITLES))} END AS parser FROM documents""")  # fmt: skip
def d1(spark, d):
    # Every seventh title stands in the file's name alone, and the parser sees texts only.
    rows = papers(spark, d, file=f"CASE WHEN doc_id % 7 = 0 THEN {CASED} || '.pdf' ELSE 'scan.pdf' END", text=f"CASE WHEN doc_id % 7 = 0 THEN '' ELSE {CASED} || {NL} END || text")
    rows = rows.withColumn("code", documents.document_class(F.col("file"), F.col("text"))["code"])
    return rows.select("doc_id", "code", documents.report_view(F.col("code")).alias("report_view"), extraction.reimbursement_type(F.col("file"), F.col("text")).alias("reimbursement"), extraction.parser_type(F.col("text"), F.col("doc_id") % 11 == 0).alias("parser"))


# ---------------------------------------------------------------- identities

ID_TEXT = " || ".join((
    pick(4, f"'Patient Name: ' || {NAME}", f"'Pt: ' || {NAME}", f"'Mr. ' || {NAME}", "'no identity given'"), NL,
    pick(3, "'MRN: A' || doc_id || '00'", "'UHID - B' || doc_id || '77'", "'Bed No: C12' || doc_id"), NL,
    pick(2, "'DOB: 01/02/19' || (doc_id % 50 + 40)", "'Date of Birth - 3-4-1980'"), NL,
    pick(3, "'Age: ' || (doc_id % 90 + 1)", "'Age & Gender: ' || (doc_id % 90 + 1)", "'seen today'"), NL, pick(4, "'Sex: male'", "'Gender - F'", "'Sex other'", "'unsaid'"), NL,
    pick(5, "''", "'Policy No: POL' || doc_id || 'X'", "'Member ID - M' || doc_id || '99'", "''", "'Insurance number: INS/' || doc_id"), NL, "(CASE WHEN doc_id % 3 = 2 THEN '' ELSE text END)",
))


@query("d4_d5_identity", f"""SELECT doc_id, {pick(4, NAME, NAME, NAME, 'NULL')} AS name, {pick(3, "'A' || doc_id || '00'", "'B' || doc_id || '77'", "'C12' || doc_id")} AS record_id,
    {pick(2, "'01/02/19' || (doc_id % 50 + 40)", "'3-4-1980'")} AS dob, {pick(3, "(doc_id % 90 + 1)::VARCHAR", "(doc_id % 90 + 1)::VARCHAR", 'NULL')} AS age, {pick(4, "'male'", "'F'", "'other'", 'NULL')} AS gender,
    {pick(5, 'NULL', "'POL' || doc_id || 'X'", "'M' || doc_id || '99'", 'NULL', "NULL")} AS policy FROM documents""")  # fmt: skip
def d4(spark, d):
    rows = papers(spark, d, text=ID_TEXT.replace("'Insurance number: INS/' || doc_id", "'Insured'"))
    return rows.select("doc_id", documents.identity(F.col("text")).alias("i")).select("doc_id", "i.*")


#: Ten documents make a claim; names, record ids and birth dates agree, clash or lack.
IDENTITY = {
    "claim_id": "CAST(floor(doc_id / 10) AS BIGINT)", "document_id": "doc_id", "seq": "doc_id", "name": pick(4, "'Asha Rao'", "'Mrs. Asha  RAO'", "'Kabir Sen'", "CAST(NULL AS STRING)"),
    "record_id": pick(3, "'R' || (doc_id % 2)", "CAST(NULL AS STRING)", "'R0'"), "dob": pick(5, "'01/02/1980'", "'05/06/1990'", "CAST(NULL AS STRING)"), "locked": "doc_id % 7 = 0",
}
IDENTITY_SQL = "i AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in IDENTITY.items()) + f", {pick(4, '1', '1', '2', 'NULL')} AS who FROM documents)"


def identities(spark, d):
    return papers(spark, d, **IDENTITY, age="CAST(NULL AS STRING)", gender="CAST(NULL AS STRING)", policy="CAST(NULL AS STRING)")


MATCHED_SQL = f"""{IDENTITY_SQL}, s AS (SELECT *, (name IS NOT NULL)::INT * 3 + (record_id IS NOT NULL)::INT * 3 + (dob IS NOT NULL)::BIGINT * 2 AS points FROM i),
    p AS (SELECT claim_id, arg_max({{'who': who, 'record_id': record_id, 'dob': dob, 'id': document_id, 'name': name}}, points * 1000000000 - seq) AS m FROM s GROUP BY 1),
    w AS (SELECT s.*, m.id AS main, m.name AS expected, CASE WHEN who IS NOT NULL AND m.who IS NOT NULL THEN (who = m.who)::INT END AS n, CASE WHEN record_id IS NOT NULL AND m.record_id IS NOT NULL THEN (record_id = m.record_id)::INT END AS r, CASE WHEN dob IS NOT NULL AND m.dob IS NOT NULL THEN (dob = m.dob)::INT END AS b FROM s JOIN p USING (claim_id)),
    v AS (SELECT *, CASE WHEN r = 0 THEN 0.1 ELSE (coalesce(n, 0) * 0.5 + coalesce(r, 0) * 0.3 + coalesce(b, 0) * 0.2) / nullif((n IS NOT NULL)::INT * 0.5 + (r IS NOT NULL)::INT * 0.3 + (b IS NOT NULL)::INT * 0.2, 0) END::DOUBLE AS sure FROM w),
    verdicts AS (SELECT *, round(sure, 4) AS score, CASE WHEN sure IS NULL THEN 'NO_DATA' WHEN r = 0 OR sure < 0.4 THEN 'MISMATCH' WHEN sure < 0.7 THEN 'UNCERTAIN' ELSE 'MATCH' END AS verdict FROM v)"""


@query("d7_j17_w7_identity_match", f"WITH {MATCHED_SQL} SELECT claim_id, document_id, score, verdict, document_id = main AS is_primary FROM verdicts")
def d7(spark, d):
    return documents.identity_matched(identities(spark, d))


@query("w5_w6_identity_gate", f"""WITH {IDENTITY_SQL}, a AS (SELECT claim_id, arg_min(who, (NOT locked)::BIGINT * 1000000000 + seq) FILTER (who IS NOT NULL) AS k FROM i GROUP BY 1),
    v AS (SELECT claim_id, document_id, CASE WHEN who IS NULL OR k IS NULL THEN 'NO_DATA' WHEN who = k THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM i JOIN a USING (claim_id)) SELECT *, verdict <> 'MATCH' AS excluded FROM v""")  # fmt: skip
def w5(spark, d):
    return documents.gated(identities(spark, d))


def judged(spark, d):
    """Documents with what D8 needs: relevance by id, and the identity match of D7."""
    own = identities(spark, d).withColumn("medical", F.col("document_id") % 9 != 0).withColumn("relevant", F.col("document_id") % 6 != 0).withColumn("confidence", (F.col("document_id") % 8) / 8).withColumn("file_name", F.concat(F.lit("f"), F.col("document_id").cast("string")))
    match = documents.identity_matched(identities(spark, d))
    expected = match.where("is_primary").select("claim_id", "document_id").join(own.select("claim_id", "document_id", F.col("name").alias("expected")), ["claim_id", "document_id"]).drop("document_id")
    return extraction.validated(own.join(match.drop("is_primary"), ["claim_id", "document_id"]).join(expected, "claim_id"))


JUDGED_SQL = f"""{MATCHED_SQL}, j AS (SELECT *, document_id % 9 <> 0 AS medical, document_id % 6 <> 0 AS relevant, (document_id % 8) / 8.0 AS confidence, 'f' || document_id AS file_name FROM verdicts),
    k AS (SELECT claim_id, document_id, file_name, CASE WHEN NOT medical OR verdict = 'MISMATCH' THEN 'INVALID' WHEN NOT relevant THEN 'WARNING' ELSE 'VALID' END AS status, CASE WHEN coalesce(score, 0) > 0 THEN (confidence + score) / 2 ELSE confidence END::DOUBLE AS confidence,
        concat_ws('; ', CASE WHEN NOT medical THEN 'Document does not appear to be medical' END, CASE WHEN medical AND NOT relevant THEN 'Document may not be relevant to the claim' END, CASE WHEN verdict = 'MISMATCH' THEN 'Patient identity mismatch: this document may belong to a different patient' END,
            CASE WHEN verdict = 'MISMATCH' AND name IS NOT NULL AND expected IS NOT NULL THEN 'Expected patient: ''' || expected || ''', found: ''' || name || '''' END) AS issues FROM j)"""  # fmt: skip


@query("d8_a19_validity", f"WITH {JUDGED_SQL} SELECT claim_id, document_id, status, confidence, issues FROM k")
def d8(spark, d):
    return judged(spark, d).select("claim_id", "document_id", "status", "confidence", F.array_join("issues", "; ").alias("issues"))


@query("a19_claim_validity", f"""WITH {JUDGED_SQL}, c AS (SELECT claim_id, count(*) AS documents, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'INVALID') AS invalid, count(*) FILTER (status = 'WARNING') AS warning, string_agg('''' || file_name || ''': ' || issues, ' / ' ORDER BY document_id) FILTER (status = 'INVALID') AS told FROM k GROUP BY 1)
    SELECT claim_id, documents, valid, invalid, warning, CASE WHEN invalid > 0 THEN invalid || ' document(s) failed validation / ' || told ELSE '' END AS issues FROM c""")  # fmt: skip
def a19(spark, d):
    return extraction.claim_validity(judged(spark, d)).withColumn("issues", F.array_join("issues", " / "))


# ---------------------------------------------------------------- amounts

NET_LABELS = ("Net admissible amount", "Admissible amount", "Net payable", "Amount payable", "Net total", "Payable amount", "Total payable")
GROSS_LABELS = ("Gross hospital bill", "Gross bill", "Gross total amount", "Gross total", "Total amount")
SECTION_LABELS = ("Sub-total A - room & boarding | Rs ", "Subtotal B - investigations | ", "Sub total C - procedures / implants INR ", "SUB-TOTAL D ", "Sub-total E - pharmacy & consumables | rs ")
BILL_TEXT = " || ".join((
    f"CASE WHEN doc_id % 8 = 7 THEN '' ELSE {pick(7, *map(q, NET_LABELS))} || {pick(3, q(': Rs. '), q(' - '), q(' $'))} || '1.00' || {NL} || {pick(7, *map(q, NET_LABELS))} || ': INR ' || {AMOUNT} || {NL} || {pick(7, *map(q, NET_LABELS))} || ' 0' END", NL,
    f"CASE WHEN doc_id % 6 = 5 THEN '' ELSE {pick(5, *map(q, GROSS_LABELS))} || ' | rs ' || (doc_id * 3 + 1) END", NL,
    *(f"CASE WHEN doc_id % {k + 2} = 0 THEN '' ELSE {q(label)} || {AMOUNT} || {NL} || {q(label)} || (doc_id % 5 + {k}) END || {NL}" for k, label in enumerate(SECTION_LABELS)), "text",
))


@query("d9_d10_amount_anchors", f"""SELECT doc_id, CASE WHEN doc_id % 8 <> 7 THEN {VALUE} END::DOUBLE AS net, CASE WHEN doc_id % 6 <> 5 THEN doc_id * 3 + 1 END::DOUBLE AS gross,
    {', '.join(f"CASE WHEN doc_id % {k + 2} <> 0 THEN CASE WHEN doc_id % 5 + {k} > 0 THEN doc_id % 5 + {k} ELSE {VALUE} END END::DOUBLE AS {name}" for k, name in enumerate(extraction.SUBTOTALS))} FROM documents""")  # fmt: skip
def d9(spark, d):
    rows = papers(spark, d, text=BILL_TEXT)
    return rows.select("doc_id", documents.last_amount(F.col("text"), documents.NET).alias("net"), documents.last_amount(F.col("text"), documents.GROSS).alias("gross"), *extraction.subtotals(F.col("text")))


# ---------------------------------------------------------------- pattern fields

ILLS = tuple(map(q, ("Asthma", "Dengue", "Sepsis", "Malaria", "Hernia", "Typhoid", "Anaemia")))
ILL = pick(7, *ILLS)
DAY = "(doc_id % 18 + 10)"
CLAIM_TEXT = " || ".join((
    pick(3, f"'Patient Name: ' || {NAME}", f"'Name of patient - ' || {NAME}", "'unnamed'"), NL, pick(4, f"'Admission date: ' || {DAY} || '-May-2024'", f"'admission ' || {DAY} || '/05/24'", "'came in'"), NL,
    pick(5, "'left'", f"'Discharge date ' || {DAY} || '-June-2024'"), NL, pick(2, f"'Primary diagnosis: ' || {ILL}", f"'Diagnosis ' || {ILL} || ' of old'"), NL,
    pick(3, "'none done'", "'Procedure performed: stitch ' || doc_id"), NL, pick(4, "'Policy No: P-' || doc_id", "'policy number Q' || doc_id || 'Z'", "'uninsured'"), NL, pick(5, f"'Grand total: Rs. ' || {AMOUNT}", f"'Billed INR ' || {AMOUNT}", "'free'"), NL,
    pick(3, f"'Surgeon: Dr. ' || {FIRST}", f"'consultant ' || {FIRST}", "'nobody'"), NL,
))
CLAIM_FIELDS = {
    "patient_name": pick(3, NAME, NAME, "NULL"), "admission_date": pick(4, f"{DAY} || '-May-2024'", "NULL"), "discharge_date": pick(5, "NULL", f"{DAY} || '-June-2024'"), "diagnosis": pick(2, ILL, f"{ILL} || ' of old'"),
    "procedure": pick(3, "NULL", "'stitch ' || doc_id"), "policy_number": pick(4, "'P-' || doc_id", "'Q' || doc_id || 'Z'", "NULL"), "total_amount": pick(5, AMOUNT, AMOUNT, "NULL"), "doctor": pick(3, FIRST, FIRST, "NULL"),
}


@query("d11_reimbursement_fields", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, {e} AS value FROM documents WHERE {e} IS NOT NULL" for k, e in CLAIM_FIELDS.items()))
def d11(spark, d):
    return extraction.reimbursement_fields(papers(spark, d, text=CLAIM_TEXT))


FORM_TEXT = " || ".join((
    pick(5, f"'Patient Name: Mr. ' || {NAME} || ' Age 5'", f"'Seen: Mrs. ' || {NAME} || ' aged'", f"'patient ' || {NAME} || ' was here'", f"'Member name - ' || {NAME} || ' 123'", "'Patient Name: claim summary'"), NL,
    pick(4, "'Age/Sex: ' || (doc_id % 90 + 1) || '/M'", "'aged ' || (doc_id % 90 + 1) || ' years'", "(doc_id % 90 + 1) || '-year-old'", "'Age: 999'"), NL, pick(3, "'Sex: F'", "'Gender - male'", "'a baby girl'"), NL,
    pick(4, f"'Admitted on: ' || {DAY} || '/05/2024'", f"'DOA ' || {DAY} || '-05-24'", f"'adm date: ' || {DAY} || '-may-2024'", "'came'"), NL, pick(3, f"'Date of discharge: ' || {DAY} || '-06-2024'", f"'discharge was ' || {DAY} || '/06/2024'", "'left'"), NL,
    pick(3, f"'Treated by: Dr. ' || {FIRST} || ' ' || {LAST} || ' MD'", f"'Dr. ' || {FIRST} || ' ' || {LAST}", "'Consultant: hereby declare'"), NL,
    pick(4, f"{FIRST} || ' General Hospital'", f"'Hospital Name: ' || {FIRST} || ' Clinic | Ref'", f"'was treated at ' || {FIRST} || ' Medical Center'", "'Hospital: claim form'"), NL,
    pick(3, f"'Final Diagnosis: ' || {ILL} || ' with cough'", f"'the diagnosis on leaving was ' || {ILL}", "'Diagnosis: risk factor'"), NL, pick(4, f"'Total billed amount Rs. ' || {AMOUNT}", f"'Total: INR ' || {AMOUNT}", f"'Bill amount' || {NL} || '₹ ' || {AMOUNT}", "'nothing due'"), NL,
))
FORM_FIELDS = {
    "patient_name": pick(5, NAME, NAME, NAME, NAME, "NULL"), "age": f"CASE WHEN doc_id % 5 = 0 THEN '5 Years' ELSE {pick(4, *(['(doc_id % 90 + 1) || ' + q(' Years')] * 3), 'NULL')} END",
    "gender": f"CASE WHEN doc_id % 4 = 0 THEN 'Male' ELSE {pick(3, q('Female'), q('Male'), 'NULL')} END", "admission_date": pick(4, f"{DAY} || '-05-2024'", f"{DAY} || '-05-2024'", f"{DAY} || '-05-2024'", "NULL"), "discharge_date": pick(3, f"{DAY} || '-06-2024'", f"{DAY} || '-06-2024'", "NULL"),
    "doctor_name": pick(3, f"{FIRST} || ' ' || {LAST}", f"{FIRST} || ' ' || {LAST}", "NULL"), "hospital_name": pick(4, f"{FIRST} || ' General Hospital'", f"{FIRST} || ' Clinic'", f"{FIRST} || ' Medical Center'", "NULL"),
    "diagnosis": pick(3, f"{ILL} || ' with cough'", ILL, "NULL"), "claimed_total": pick(4, AMOUNT, AMOUNT, AMOUNT, "NULL"),
}


@query("d11_d12_pattern_fields", "SELECT doc_id, " + ", ".join(f"{e} AS {k}" for k, e in FORM_FIELDS.items()) + " FROM documents")
def d12(spark, d):
    rows = papers(spark, d, text=FORM_TEXT)
    return rows.select("doc_id", *(extraction.pattern_field(F.col("text"), k).alias(k) for k in FORM_FIELDS))


# ---------------------------------------------------------------- diagnoses, codes, entities

TERMS_TEXT = pick(4, f"'Seen today' || {NL} || 'Final diagnosis: Acute ' || {ILL} || ' BP: 120/80' || {NL} || 'Type 2 Diabetes; ' || {ILL} || ' 5 mg.' || {NL} || 'Treatment: rest and fever watch'", f"'He had ' || {ILL} || ' since May. It went. No stroke; all well'",
    f"'one two three four five six seven eight nine ten eleven twelve thirteen then ' || lower({ILL}) || ' came and went and came and went once more and yet again until at last it did not'", "'quiet words of no import ' || doc_id")
NARRATIVE = pick(6, "'Viral fever'", "'STEMI seen'", "'MRI and CT done'", "'T2DM'", "'a long tale of nothing much that goes on and on and on'", "'BP fine'")


@query("d13_d18_d19_diagnosis_terms", f"""SELECT doc_id, {pick(4, f"'acute ' || lower({ILL}) || '|type diabetes|' || lower({ILL})", f"'he had ' || lower({ILL}) || ' since may|no stroke'", f"'eleven twelve thirteen then ' || lower({ILL}) || ' came and went and'", "''")} AS terms,
    {pick(6, 'false', 'true', 'false', 'true', 'true', 'false')} AS long FROM documents""")  # fmt: skip
def d13(spark, d):
    rows = papers(spark, d, text=TERMS_TEXT, narrative=NARRATIVE)
    return rows.select("doc_id", F.array_join(extraction.diagnosis_keywords(F.col("text")), "|").alias("terms"), extraction.needs_extraction(F.col("narrative")).alias("long"))


ENTITY_TEXT = " || ".join((f"CASE WHEN doc_id % 2 = 0 THEN 'Impression: ' || {ILL} || ' found' || {NL} ELSE '' END", f"CASE WHEN doc_id % 3 = 0 THEN 'Operation - repair of ' || {ILL} || '; ' || {NL} ELSE '' END", f"CASE WHEN doc_id % 5 = 0 THEN 'Inj. ' || {FIRST} || 'cillin' || {NL} ELSE '' END", "'end'"))


@query("d14_d15_d38_entities", f"""SELECT doc_id, 'DIAGNOSIS' AS entity_type, {ILL} || ' found' AS entity_text, 0.65 AS confidence, 12 AS start FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'PROCEDURE', 'repair of ' || {ILL}, 0.6, 12 + CASE WHEN doc_id % 2 = 0 THEN 19 + length({ILL}) ELSE 0 END FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'MEDICATION', {FIRST} || 'cillin', 0.6, 5 + CASE WHEN doc_id % 2 = 0 THEN 19 + length({ILL}) ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 25 + length({ILL}) ELSE 0 END FROM documents WHERE doc_id % 5 = 0""")  # fmt: skip
def d15(spark, d):
    rows = documents.entities(papers(spark, d, text=ENTITY_TEXT))
    return rows.select("doc_id", "entity_type", "entity_text", F.round("confidence", 2).alias("confidence"), F.col("start").cast("int").alias("start"))


MEDICINE_TEXT = " || ".join(("'given '", "(CASE WHEN doc_id % 2 = 0 THEN 'CALPOL and ' ELSE '' END)", "(CASE WHEN doc_id % 3 = 0 THEN 'insulin, ' ELSE '' END)", "(CASE WHEN doc_id % 5 = 0 THEN 'Brufen/Lipitor; ' ELSE '' END)", "(CASE WHEN doc_id % 7 = 0 THEN 'Rx: zed' || (doc_id % 10) || ' FORTE, ' ELSE '' END)", "'then rest'"))


@query("d14_medicines", """SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'Paracetamol' END, CASE WHEN doc_id % 3 = 0 THEN 'Insulin' END, CASE WHEN doc_id % 5 = 0 THEN 'Ibuprofen' END, CASE WHEN doc_id % 5 = 0 THEN 'Atorvastatin' END, CASE WHEN doc_id % 7 = 0 THEN 'Zed' || (doc_id % 10) || ' Forte' END], lambda x: x IS NOT NULL)), '|') AS medicines FROM documents""")
def d14(spark, d):
    return papers(spark, d, text=MEDICINE_TEXT).select("doc_id", F.array_join(documents.medicines(F.col("text")), "|").alias("medicines"))


#: What each kind of document takes from its sections (fixed values).
ROUTES = (("bill", "header", "fields"), ("bill", "table", "expenses"), ("lab", "table", "results"), ("discharge", "header", "fields"), ("discharge", "narrative", "fields"), ("prescription", "table", "medications"))


@query("d39_routed_sections", f"""SELECT doc_id, {pick(4, *map(q, ('bill', 'lab', 'discharge', 'prescription')))} AS doc_kind, {pick(3, *map(q, ('header', 'table', 'narrative')))} AS section_type,
    CASE {' '.join(f"WHEN {pick(4, *map(q, ('bill', 'lab', 'discharge', 'prescription')))} = '{a}' AND {pick(3, *map(q, ('header', 'table', 'narrative')))} = '{b}' THEN '{t}'" for a, b, t in ROUTES)} ELSE 'none' END AS target FROM documents""")  # fmt: skip
def d39(spark, d):
    rows = papers(spark, d, doc_kind=pick(4, *map(q, ("bill", "lab", "discharge", "prescription"))), section_type=pick(3, *map(q, ("header", "table", "narrative")))).drop("source")
    return layout.routed(rows, spark.createDataFrame(ROUTES, "doc_kind string, section_type string, target string"))


CODE_TEXT = pick(5, f"'Diagnosis: acute kind of ' || {ILL} || ' ICD-10: J2' || (doc_id % 10) || '.9 given'", f"'K3' || (doc_id % 10) || ' - inflamed ' || {ILL} || ' of the gut' || {NL} || 'more'", "'paid Rs. 4' || (doc_id % 10) || '213 for it'", "'CPT code 4' || (doc_id % 10) || '213 repair of the mesh'", "text")


# Every document takes part; a fifth has its own text, which holds no code in these tables.
@query("d16_d17_code_mentions", f"""SELECT doc_id, 'J2' || (doc_id % 10) || '.9' AS code, 0.95 AS confidence, 'acute kind of ' || {ILL} AS description, doc_id % 10 = 5 AS known FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT doc_id, 'K3' || (doc_id % 10), 0.9, 'inflamed ' || {ILL} || ' of the gut', false FROM documents WHERE doc_id % 5 = 1 UNION ALL SELECT doc_id, '4' || (doc_id % 10) || '213', 0.95, 'repair of the mesh', false FROM documents WHERE doc_id % 5 = 3""")  # fmt: skip
def d16(spark, d):
    catalogue = spark.createDataFrame([("J25.9", "Acute kind"), ("40213", "x")], "code string, description string")
    return documents.code_mentions(papers(spark, d, text=CODE_TEXT), catalogue).select("doc_id", "code", "confidence", F.col("context").alias("description"), "known")


# ---------------------------------------------------------------- scans and clinical context

SCAN_TEXT = pick(4, f"'MRI brain done' || {NL} || 'Findings:' || {NL} || '- a mass of ' || doc_id || ' mm is seen' || {NL} || '- mild swelling of the rim' || {NL} || '- no fracture anywhere' || {NL} || 'Impression: suspicious mass' || {NL} || 'Recommendation: biopsy'",
    f"'X-Ray of the chest' || {NL} || 'Observation: lungs normal and clear, heart preserved' || {NL} || 'Conclusion: normal study'", "'Ultrasound of the liver. There is a calculus. Nothing else to say'", "'HRCT scan of the knee. ' || text")


def first_that(rules, text: str, default: str) -> str:
    """SQL of the first rule whose words a text has."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i)\\b(?:{pattern})\\b') THEN '{name}'" for name, pattern in rules) + f" ELSE '{default}' END"


#: A scan's own text: its telling sentences, or else its paragraphs, the critical first.
OWN_SCAN = rf"""t AS (SELECT doc_id, 'HRCT scan of the knee. ' || text AS t FROM documents WHERE doc_id % 4 = 3),
    s AS (SELECT *, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '[.\n]'), lambda x: trim(x)), lambda x: length(x) >= 10 AND (regexp_matches(x, '{extraction.ABNORMAL}') OR regexp_matches(x, '{extraction.NORMAL}')))[1:8], '. ') AS f FROM t),
    i AS (SELECT *, list_filter(list_transform(regexp_split_to_array(CASE WHEN f <> '' THEN f ELSE t END, '\n\s*[-•*\d.]+\s*|\n{{2,}}'), lambda x: trim(x)), lambda x: length(x) >= 10) AS items FROM s),
    b AS (SELECT *, list_transform(items, lambda x: CASE WHEN NOT regexp_matches(x, '{extraction.ABNORMAL}') OR regexp_matches(x, '{extraction.NEGATED}') THEN 'info' WHEN regexp_matches(x, '{extraction.CRITICAL}') THEN 'critical' ELSE 'warning' END) AS kinds FROM i),
    own AS (SELECT doc_id, {first_that(extraction.SCAN_TYPES, 't', 'Unknown')} AS scan_type, {first_that(extraction.BODY_PARTS, 't', 'Unspecified')} AS body_part,
        array_to_string((list_transform(list_filter(list_zip(kinds, items), lambda z: z[1] = 'critical') || list_filter(list_zip(kinds, items), lambda z: z[1] = 'warning') || list_filter(list_zip(kinds, items), lambda z: z[1] = 'info'),
            lambda z: z[1] || ':' || regexp_replace(substr(z[2], 1, 300), '^-\s*', '')))[1:12], '|') AS findings,
        len(regexp_extract_all(f, '{extraction.ABNORMAL}')) > len(regexp_extract_all(f, '{extraction.NORMAL}')) AS abnormal,
        round(0.45 + CASE WHEN f <> '' THEN 0.25 ELSE 0 END + CASE WHEN length(t) > 500 THEN 0.1 ELSE 0 END + CASE WHEN length(t) > 1500 THEN 0.05 ELSE 0 END, 2)::DOUBLE AS confidence FROM b)"""


@query("d24_scan_reports", f"""WITH {OWN_SCAN}
    SELECT doc_id, {pick(4, "'MRI'", "'X-Ray'", "'Ultrasound'", "'CT'")} AS scan_type, {pick(4, "'Brain / Head'", "'Chest'", "'Abdomen'", "'Knee'")} AS body_part,
    {pick(4, "'critical:a mass of ' || doc_id || ' mm is seen|warning:mild swelling of the rim|info:no fracture anywhere'", "'info:lungs normal and clear, heart preserved'", "'warning:There is a calculus'", "NULL")} AS findings, {pick(4, 'true', 'false', 'true', 'false')} AS abnormal,
    {pick(4, '0.85', '0.85', '0.7', 'NULL')}::DOUBLE AS confidence FROM documents WHERE doc_id % 4 < 3
    UNION ALL SELECT doc_id, scan_type, body_part, findings, abnormal, confidence FROM own""")  # fmt: skip
def d24(spark, d):
    rows = extraction.scan_reports(papers(spark, d, text=SCAN_TEXT))
    told = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["severity"], F.regexp_replace(i["text"], r"^-\s*", ""))), "|")
    return rows.select("doc_id", "scan_type", "body_part", told.alias("findings"), "abnormal", F.round("confidence", 2).alias("confidence"))


CONTEXT_TEXT = " || ".join(("'header line'", NL, pick(3, "'Diagnosis: G3PILIAI at ZWKS for ' || " + NAME, "'History of ' || " + ILL + " || ' told by ' || " + FIRST, "'nothing of note ' || doc_id"), NL, "'Indication: ZDAYS of pain'", NL, "'plain words'"))


@query("d20_d21_clinical_context", f"SELECT doc_id, {pick(3, q('Diagnosis: G3P1L1A1 at 2WKS for [REDACTED]'), f'{chr(39)}History of {chr(39)} || {ILL} || {chr(39)} told by [REDACTED]{chr(39)}', q(''))} || CASE WHEN doc_id % 3 < 2 THEN chr(10) ELSE '' END || 'Indication: 2DAYS of pain' AS context FROM documents")
def d20(spark, d):
    rows = papers(spark, d, text=CONTEXT_TEXT, first=FIRST, full=NAME)
    return rows.select("doc_id", documents.clinical_context(documents.obstetric_repaired(F.col("text")), F.array("first", "full")).alias("context"))


# ---------------------------------------------------------------- redaction, intents, key values

PHI_TEXT = "'id ' || " + " || ' then ' || ".join((
    "(CASE WHEN doc_id % 2 = 0 THEN '123-45-' || (doc_id % 9000 + 1000) ELSE 'none' END)", "(CASE WHEN doc_id % 3 = 0 THEN '(555) 123-' || (doc_id % 9000 + 1000) ELSE 'no phone' END)", "(CASE WHEN doc_id % 5 = 0 THEN 'u' || doc_id || '@mail.example.org' ELSE 'no mail' END)",
    "(CASE WHEN doc_id % 4 = 0 THEN 'MRN: ' || (doc_id + 1000) ELSE 'no record' END)", "(CASE WHEN doc_id % 7 = 0 THEN 'DOB: 1/2/19' || (doc_id % 50 + 40) ELSE 'no birth' END)", "(CASE WHEN doc_id % 6 = 0 THEN 'AB' || (doc_id + 10000000) ELSE 'no policy' END)",
    "(CASE WHEN doc_id % 11 = 0 THEN 'ABCDE1234F' ELSE 'no pan' END)", "(CASE WHEN doc_id % 9 = 0 THEN '1234 5678 9012' ELSE 'no card' END)",
))
PHI_SQL = "'id ' || " + " || ' then ' || ".join(f"(CASE WHEN doc_id % {n} = 0 THEN '{token}' ELSE '{other}' END)" for n, token, other in ((2, "[SSN_REDACTED]", "none"), (3, "([PHONE_REDACTED]", "no phone"), (5, "[EMAIL_REDACTED]", "no mail"), (4, "[MRN_REDACTED]", "no record"), (7, "[DOB_REDACTED]", "no birth"), (6, "[POLICY_REDACTED]", "no policy"), (11, "[PAN_REDACTED]", "no pan"), (9, "[AADHAAR_REDACTED]", "no card")))


@query("d22_d23_scrubbed_papers", f"SELECT doc_id, {PHI_SQL} AS text FROM documents")
def d22(spark, d):
    return papers(spark, d, text=PHI_TEXT).select("doc_id", documents.scrubbed(F.col("text"), documents.PHI_MORE).alias("text"))


SAID = pick(6, "'please change the policy number to P' || turn || '.'", "'Set hospital name = City ' || conv_id", "'delete the diagnosis field'", "'add insurer = Acme ' || turn", "'what does update mean?'", "text", by="(conv_id + turn)")


@query("d33_spoken_intents", f"""SELECT conv_id, turn, {pick(6, q('modify'), q('modify'), q('delete'), q('add'), 'NULL', by='(conv_id + turn)')} AS action, {pick(6, q('policy_number'), q('hospital_name'), q('diagnosis'), q('insurance_payer'), 'NULL', by='(conv_id + turn)')} AS field,
    {pick(6, "'P' || turn", "'City ' || conv_id", 'NULL', "'Acme ' || turn", 'NULL', by='(conv_id + turn)')} AS value FROM conversations""")  # fmt: skip
def d33(spark, d):
    said = raw(spark, d, "conversations").selectExpr("conv_id", "turn", f"{SAID} AS text")
    rows = said.select("conv_id", "turn", documents.intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.*")
    return documents.aliased(rows, spark.createDataFrame([("insurer", "insurance_payer"), ("hospital", "hospital_name")], "alias string, canonical string"))


PAIRS_TEXT = " || ".join(("'Name: '", NAME, NL, pick(3, "'Ward : ' || (doc_id % 20)", "'Ward'", "': 5'"), NL, "'Bill No.: ' || doc_id", NL, pick(2, "'Time: 10:30'", "'1st: x'")))


@query("d35_key_value_pairs", f"SELECT doc_id, 'Name=' || {NAME} || {pick(3, chr(39) + '|Ward=' + chr(39) + ' || (doc_id % 20)', q(''))} || '|Bill No.=' || doc_id || {pick(2, q('|Time=10:30'), q(''))} AS pairs FROM documents")
def d35(spark, d):
    pairs = documents.key_values(F.col("text"))
    return papers(spark, d, text=PAIRS_TEXT).select("doc_id", F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"])), "|").alias("pairs"))


# ---------------------------------------------------------------- extractors' fields

KEYS = ("Patient Name:", "DOB", "Policy No:", "Hospital", "UHID", "Total claimed", "shoe size", "name")


@query("f25_a36_canonical_fields", f"""WITH k AS (SELECT doc_id, seq, {pick(8, *map(q, ('patient_name', 'patient_dob', 'insurance_policy_number', 'hospital_name', 'patient_id', 'claimed_total')), 'NULL', "CASE WHEN doc_id % 2 = 0 THEN 'hospital_name' ELSE 'patient_name' END", by='(doc_id + seq)')} AS field,
        {pick(8, *(["'v' || doc_id || '_' || seq"] * 7), "CASE WHEN doc_id % 2 = 0 THEN 'City Clinic ' ELSE 'Mr. Clinic ' END || seq", by='(doc_id + seq)')} AS value, ((doc_id * 7 + seq * 3) % 5) / 5.0 AS confidence FROM documents, range(12) r(seq))
    SELECT doc_id, field, arg_max(value, confidence * 100 - seq) AS value, max(confidence)::DOUBLE AS confidence FROM k WHERE field IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def f25(spark, d):
    rows = papers(spark, d, seq="explode(sequence(0, 11))").drop("source")
    key, value = pick(8, *map(q, KEYS), by="(doc_id + seq)"), pick(8, *(["'v' || doc_id || '_' || seq"] * 7), "CASE WHEN doc_id % 2 = 0 THEN 'City Clinic ' ELSE 'Mr. Clinic ' END || seq", by="(doc_id + seq)")
    rows = rows.selectExpr("doc_id", "seq", f"{key} AS key", f"{value} AS value", "((doc_id * 7 + seq * 3) % 5) / 5.0D AS confidence")
    rows = rows.withColumn("field", extraction.canonical_key(F.col("key"), F.col("value"))).where("field IS NOT NULL")
    return extraction.best_candidates(rows, ["doc_id"])


# ---------------------------------------------------------------- cell tables

KIND = pick(5, *map(q, ("expense", "medication", "lab", "vitals", "diagnosis")))
CELLS = {
    "expense": [("Item", "'Bed ' || seq"), ("Category", "CASE WHEN seq % 2 = 0 THEN 'Room' ELSE '' END"), ("Rate", "'Rs. 10'"), ("Net", f"'1,' || (doc_id % 900 + 100) || '.50'")],
    "medication": [("Drug name", "'Pill ' || seq"), ("Dosage", "(doc_id % 9) || ' mg'"), ("Frequency", "'twice'"), ("Days", "seq || ''")],
    "lab": [("", "'Test ' || seq"), ("Units", "'mg/dl'"), ("Result", "(doc_id % 99) || ''"), ("Normal range", "'1-2'")],
    "vitals": [("Parameter", "'Pulse ' || seq"), ("Reading", "(doc_id % 60 + 60) || ''"), ("Unit", "CASE WHEN seq = 1 THEN '' ELSE 'bpm' END")],
    "diagnosis": [("Code", "'J' || (doc_id % 90 + 10)"), ("Type", "'final'"), ("Description", f"CASE WHEN seq = 2 THEN '' ELSE {ILL} END")],
}
RECORD_SQL = {
    "expense": f"'description=Bed ' || seq || CASE WHEN seq % 2 = 0 THEN ' Room' ELSE '' END || ' Rs. 10|category=' || CASE WHEN seq % 2 = 0 THEN 'Room' ELSE 'Bed ' || seq END || '|amount=1' || (doc_id % 900 + 100) || '.50'",
    "medication": "'name=Pill ' || seq || '|dose=' || (doc_id % 9) || ' mg|frequency=twice|duration=' || seq", "lab": "'test_name=Test ' || seq || '|result=' || (doc_id % 99) || '|units=mg/dl|range=1-2'",
    "vitals": "'name=Pulse ' || seq || '|value=' || (doc_id % 60 + 60) || CASE WHEN seq = 1 THEN '' ELSE '|units=bpm' END", "diagnosis": f"'diagnosis=' || {ILL} || '|code=J' || (doc_id % 90 + 10) || '|kind=final'",
}


@query("d28_cell_tables", f"SELECT doc_id AS table_id, kind, seq AS row, CASE kind {' '.join(f'WHEN {q(k)} THEN {e}' for k, e in RECORD_SQL.items())} END AS record FROM (SELECT doc_id, {KIND} AS kind, unnest([1, 2, 3])::INT AS seq FROM documents) WHERE NOT (kind = 'diagnosis' AND seq = 2)")
def d28(spark, d):
    rows = papers(spark, d, kind=KIND, seq="explode(array(1, 2, 3))")
    made = [F.when(F.col("kind") == k, F.array(*(F.struct(F.lit(i).alias("col"), F.lit(h).alias("header"), F.expr(e).alias("cell")) for i, (h, e) in enumerate(cells)))) for k, cells in CELLS.items()]
    cells = rows.select(F.col("doc_id").alias("table_id"), "kind", F.col("seq").alias("row"), F.inline(F.coalesce(*made)))
    out = extraction.table_records(cells)
    told = F.array_join(F.transform(F.filter(F.map_entries("record"), lambda e: e["value"].isNotNull()), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return out.select("table_id", "kind", "row", told.alias("record"))
