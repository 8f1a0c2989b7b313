"""Rule tables over document texts: coarser classes, validity, fields by patterns, diagnosis terms, scan reports, cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.scalars import blank_to_null

# ---------------------------------------------------------------- D2: the other two views of a document's class

#: Reimbursement types in the order they are tried, over the file name and the text's first 1000 characters (fixed values).
REIMBURSEMENT_TYPES = (
    ("Discharge Summary", r"discharge\s+summar|discharge\s+report|discharge\s+certificate|final\s+summary"),
    ("Insurance Claim Form", r"insurance\s+claim|claim\s+form|pre[\-\s]?auth|cashless\s+form|reimbursement\s+form"),
    ("Hospital Bill", r"hospital\s+bill|final\s+bill|expense\s+statement|bill\s+summary|invoice|receipt\s+cum"),
    ("Prescription", r"prescription|rx\b|prn\b|treatment\s+sheet|drug\s+chart|medication\s+order"),
    ("Lab Report", r"lab\s+report|laboratory|pathology|blood\s+test|hematology|biochemistry|urine\s+(?:test|analysis)|culture\s+sensitivity"),
    ("Radiology Report", r"radiology|x[\-\s]?ray|mri|ct\s+scan|ultrasound|usg|imaging\s+report|sonography"),
    ("Investigation Report", r"investigation|diagnostic|ecg|eeg|endoscop|colonoscop|biopsy"),
    ("Doctor Certificate", r"doctor.?s?\s+certificate|medical\s+certificate|fitness\s+certificate|treating\s+doctor"),
    ("Policy Document", r"policy\s+(?:document|number|details|schedule)|sum\s+insured|premium|coverage"),
    ("KYC / ID", r"aadhaar|pan\s+card|passport|voter\s+id|identity\s+proof|kyc"),
)
#: Parser types by words of the lower-cased text (fixed values).
PARSER_TYPES = (
    ("discharge_summary", ("discharge summary", "final diagnosis", "history of present illness", "treatment on discharge")),
    ("prescription", ("prescription", "rx", "medication", "medicine")),
    ("lab_report", ("lab report", "laboratory", "investigation report", "test result")),
    ("insurance_form", ("insurance form", "policy number", "member id", "sum insured")),
)


def _first_that(rules, otherwise: str, holds) -> Column:
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(holds(rule), name).otherwise(out)
    return out


def reimbursement_type(file_name: Column, text: Column) -> Column:
    """Ten types, else a supporting document."""
    head = F.concat_ws(" ", F.coalesce(file_name, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 1000))
    return _first_that(REIMBURSEMENT_TYPES, "Supporting Document", lambda p: head.rlike(f"(?i){p}"))


def parser_type(text: Column, has_table: Column) -> Column:
    """Five types; a document with a table, or without any word, is a bill."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: F.greatest(*(low.contains(w).cast("int") for w in words)) == 1
    return F.when(has_table, "hospital_bill").otherwise(_first_that(PARSER_TYPES, "hospital_bill", any_of))


# ---------------------------------------------------------------- D8, A19: validity


def validated(docs: DataFrame) -> DataFrame:
    """Adds status, confidence and issues.

    docs: medical, relevant, confidence, verdict and score (of the identity match), name and expected
    (the claim's primary name). No match score, or 0, leaves the confidence as it is.
    """
    c = F.col
    wrong = F.coalesce(c("verdict") == "MISMATCH", F.lit(False))
    status = F.when(~c("medical") | wrong, "INVALID").when(~c("relevant"), "WARNING").otherwise("VALID")
    sure = F.when(F.coalesce(c("score"), F.lit(0.0)) > 0, (c("confidence") + c("score")) / 2).otherwise(c("confidence"))
    issues = F.array_compact(F.array(
        F.when(~c("medical"), "Document does not appear to be medical"), F.when(c("medical") & ~c("relevant"), "Document may not be relevant to the claim"),
        F.when(wrong, "Patient identity mismatch: this document may belong to a different patient"),
        F.when(wrong & blank_to_null(c("name")).isNotNull() & blank_to_null(c("expected")).isNotNull(), F.format_string("Expected patient: '%s', found: '%s'", c("expected"), c("name"))),
    ))
    return docs.withColumn("status", status).withColumn("confidence", sure).withColumn("issues", issues)


def claim_validity(docs: DataFrame) -> DataFrame:
    """Counts by status and the issues of invalid documents, in order, after their number. docs: of validated(), with seq and file_name.

    Only invalid documents' issues are gathered, one text each.
    """
    told = F.when(F.col("status") == "INVALID", F.struct("seq", F.concat(F.lit("'"), F.col("file_name"), F.lit("': "), F.array_join("issues", "; ")).alias("text")))
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    rows = docs.groupBy("claim_id").agg(F.count("*").alias("documents"), count("VALID"), count("INVALID"), count("WARNING"), F.array_sort(F.collect_list(told)).alias("told"))
    head = F.when(F.col("invalid") > 0, F.array(F.format_string("%d document(s) failed validation", F.col("invalid")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("issues", F.concat(head, F.transform("told", lambda t: t["text"]))).drop("told")


# ---------------------------------------------------------------- D10: section subtotals of a bill

#: Sections A to E of a hospital bill (fixed values).
SUBTOTALS = {
    "room_charges": r"sub[-\s]*total\s*A\s*(?:[-–]\s*room\s*&?\s*boarding)?", "investigation_charges": r"sub[-\s]*total\s*B\s*(?:[-–]\s*investigations?)?",
    "surgery_charges": r"sub[-\s]*total\s*C\s*(?:[-–]\s*procedures?\s*/\s*implants?)?", "consultation_charges": r"sub[-\s]*total\s*D\s*(?:[-–]\s*consultations?)?",
    "pharmacy_charges": r"sub[-\s]*total\s*E\s*(?:[-–]\s*pharmacy\s*&\s*consumables?)?",
}


def subtotals(text: Column) -> list[Column]:
    """The last positive subtotal of each section."""
    out = []
    for name, label in SUBTOTALS.items():
        found = F.regexp_extract_all(text, F.lit(rf"(?i){label}\s*\|?\s*(?:rs|inr)?\s*([\d,]+\.?\d*)"), F.lit(1))
        values = F.filter(F.transform(found, lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double")), lambda v: v > 0)
        out.append(F.try_element_at(values, F.lit(-1)).alias(name))
    return out


# ---------------------------------------------------------------- D11: reimbursement fields

#: One pattern for each field (fixed values).
REIMBURSEMENT_FIELDS = {
    "patient_name": r"(?im)^\s*(?:patient\s*name|name\s+of\s+patient)\s*[:\-]\s*([^\n\r]+)",
    "admission_date": r"(?i)admission\s*(?:date)?\s*:?\s*(\d{1,2}[\-/]\w{3,9}[\-/]\d{2,4})",
    "discharge_date": r"(?i)discharge\s*(?:date)?\s*:?\s*(\d{1,2}[\-/]\w{3,9}[\-/]\d{2,4})",
    "diagnosis": r"(?i)(?:primary\s+)?diagnosis\s*:?\s*(.+?)(?:\n|$)",
    "procedure": r"(?i)procedure(?:\s+performed)?\s*:?\s*(.+?)(?:\n|$)",
    "hospital": r"(?i)hospital\s*(?:name)?\s*:?\s*(.+?)(?:\n|$)",
    "policy_number": r"(?i)policy\s*(?:no|number)?\s*:?\s*([\w\-]+)",
    "total_amount": r"(?i)(?:total|grand\s+total|net\s+amount|billed)\s*:?\s*(?:Rs\.?|INR)?\s*([\d,]+\.?\d*)",
    "doctor": r"(?i)(?:surgeon|doctor|consultant|treating)\s*(?:name)?\s*:?\s*(?:Dr\.?\s*)?([A-Z][a-z]+(?:\s+[A-Z]\.?\s*[a-z]*)*)",
}


def reimbursement_fields(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, field, value): the first match of each field, of 2 to 200 characters."""
    one = lambda p: F.trim(F.regexp_extract(text_col, p, 1))
    listed = F.array(*(F.struct(F.lit(k).alias("field"), one(p).alias("value")) for k, p in REIMBURSEMENT_FIELDS.items()))
    return docs.select(id_col, F.inline(F.filter(listed, lambda s: F.length(s["value"]) > 1))).withColumn("value", F.substring("value", 1, 200))


# ---------------------------------------------------------------- D12: fields by ordered patterns

_WORDS = r"[A-Z][A-Za-z.'’\-]+(?:[ \t]+[A-Z][A-Za-z.'’\-]+){1,4}"
_DAY = r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_MONEY = r"([0-9]+(?:\s*,\s*[0-9]+)*(?:\s*\.\s*[0-9]+)?)"
_PLACE = r"Hospital|Hospitals|Medical\s+Center|Medical\s+Centre|Healthcare|Clinic"


def _dates(noun: str, verb: str, short: str, code: str) -> tuple[str, ...]:
    """The forms of a stay's first or last day."""
    return (
        rf"date\s+of\s*[:\-=\/|]?\s*({_DAY})[^\n]*\n\s*{noun}", rf"\b(?:{noun}\s+date|{verb}\s+on|date\s+of\s+{noun}|{code})\s*[:\-=|]?\s*({_DAY})",
        rf"{noun}\s+(?:date\s+)?was\s+({_DAY})", rf"{short}\s+date\s*[:\-=]?\s*(\d{{1,2}}[-/](?:{_MONTHS})[-/]\d{{2,4}})", rf"{verb}\s*[:\-=]?\s*({_DAY})",
    )


#: Patterns of each field; all are tried, without regard to case and by lines (fixed values).
FIELD_PATTERNS = {
    "patient_name": (
        r"^[ \t]*(?:patient\s+name|name\s+of\s+patient|name\s+of\s+the\s+patient)\s*[:\-=|]?\s*([^\n|]+)\s*(?:\||$)", r"\b(?:mr\.?|mrs\.?|ms\.?|miss)[ \t]+(" + _WORDS + r")\b",
        r"\bpatient[ \t]+(" + _WORDS + r")\b", r"^[ \t]*name\s*[:\-=|]?\s*(?!of\s+hospital)(?:Mr\.?\s*|Mrs\.?\s*|Ms\.?\s*)?([^\n|]+)\s*(?:\||$)",
        r"^[ \t]*patient\s*[:\-=|]\s*(?!name\b)(?:Mr\.?\s+|Mrs\.?\s+|Ms\.?\s+)?([^\n|]+)\s*(?:\||$)", r"^[ \t]*member\s+name\s*[:\-=|]?\s*(?:Mr\.?\s*|Mrs\.?\s*|Ms\.?\s*)?([^\n|]+)\s*(?:\||$)",
    ),
    "age": (r"\bage\s*/\s*(?:gender|sex)\s*[:\-=|]?\s*(\d{1,3})", r"\bage\.?\s*(\d{1,3})\b", r"\bagez?\s*[:\-=|]?\s*(\d{1,3})(?:\s*(?:years?|yrs?))?\b", r"aged\s+(\d{1,3})", r"(\d{1,3})\s*-?\s*year\s*-?old"),
    "gender": (r"\b(?:gender|sex)\s*[:\-=|]?\s*(male|female|[mf])\b", r"\bage\s*/\s*sex\s*[:\-=|]?\s*\d{1,3}\s*/\s*([mf])\b", r"^[ \t]*\d{1,3}\s*/\s*([mf])\b", r"\b(male|female)\b"),
    "admission_date": _dates("admission", "admitted", "adm", "doa"),
    "discharge_date": _dates("discharge", "discharged", "disch", "dod"),
    "doctor_name": (
        r"^[ \t]*(?:doctor|physician|treating\s+doctor|treating\s+consultant|consultant|treating\s+by|treated\s+by|attended\s+by)\s*[:\-=|\.]?\s*(?:dr\.?\s*)?([A-Z][A-Za-z\.'-]+(?:[ \t]+[A-Z][A-Za-z\.'-]+){0,3})\b",
        r"\bdr\.?[ \t]*([A-Z][A-Za-z\.'-]+(?:[ \t]+[A-Z][A-Za-z\.'-]+)*)\b",
    ),
    "hospital_name": (
        rf"^[ \t]*(?:hospital\s+name|name\s+of\s+hospital)\s*[:\-=|]?\s*([^\n|]{{5,150}})\s*(?:\||$)", r"^[ \t]*hospital\s*[:\-=|]\s*([^\n|]{5,150})\s*(?:\||$)",
        rf"^[ \t]*([A-Za-z0-9][A-Za-z0-9 \t.,&'\-]{{3,80}}\b(?:{_PLACE}))\b(?:,[A-Za-z0-9 \t.,\-]+)?[ \t]*$", rf"\b(?:treated|admitted|hospitalized)\s+(?:at|in)\s+([A-Z][^\n\.]{{3,120}}(?:{_PLACE}))\b",
    ),
    "diagnosis": (
        r"^[ \t]*(?:(?:final|clinical|primary|chief)\s+)?diagnosis\s*[:\-=|]\s*([^\n|]{3,200})\s*(?:\||$)", r"\bdiagnosis\s+(?:[A-Za-z \t]{1,30}\s+)?(?:was|is)\s+([^\n\.\(|]+)",
    ),
    "claimed_total": (
        r"(?:gross\s+hospital\s+bill|total\s+billed\s+amount|total\s+claimed\s+amount|claimed\s+total|total\s+claimed|bill\s+amount|total\s+amount|total\s+bill|net\s+bill|billed\s+amount|gross\s+total)\s*\n?\s*(?:rs\.?|inr|₹)?\s*[:\-=\/|]?\s*" + _MONEY,
        r"(?:total|grand\s+total|net\s+amount)\s*[:\-]?\s*(?:rs\.?|inr|₹)?\s*" + _MONEY,
    ),
}
#: Words that end a person's name, and that a field's value must not hold (fixed values).
NAME_ENDS = ("hereby", "declare", "that", "the", "information", "furnished", "above", "is", "true", "and", "correct", "was", "admitted", "to", "on", "at", "patient", "name", "ipd", "reg", "no", "bill", "date", "age", "sex", "relation", "relative", "relationship", "doctor", "referring", "consultant", "treating", "referred", "hospital", "tpa", "insurance", "aged", "upon", "under", "for", "active", "admitting", "discharge", "discharged", "treatment", "treated", "by")
REJECTED = {
    "patient_name": ("information", "date", "age", "gender", "sex", "diagnosis", "hospital", "doctor", "claim", "summary", "discharge", "admission", "ipd", "reg"),
    "doctor_name": ("doctor", "referring", "consultant", "treating", "hereby", "declare", "information", "furnished", "above", "true", "correct"),
    "hospital_name": ("expense", "breakdown", "claim", "risk", "classification", "signature", "seal", "form", "summary", "original copy", "copy", "duplicate", "certified true", "office copy", "patient copy"),
    "diagnosis": ("count", "documented", "risk", "factor", "claim", "total", "expense", "breakdown", "sum insured", "patient", "hospital", "doctor", "information"),
}
GENERIC_DIAGNOSES = ("management", "medical management", "procedure", "care", "admitting", "discharge", "treated", "managed", "history")
INFANT = r"(?i)baby|babies|born|deliver|birth|infant|child|son|daughter|neonate"


def _person(value: Column, words: int) -> Column:
    """A name without titles and digits, up to the first word that ends a name; null under two words."""
    bare = F.regexp_replace(value, r"(?i)\b(?:mr|mrs|ms|miss|dr)\.?[:\-]?\s*", "")
    tokens = F.filter(F.split(bare, r"\s+"), lambda t: t != "")
    low = lambda t: F.lower(F.regexp_replace(t, r"^[ ,;:|.\-]+|[ ,;:|.\-]+$", ""))
    ends = lambda t: low(t).isin(*NAME_ENDS) | low(t).rlike("ipd|reg") | t.rlike(r"^[a-z]{3,}$")
    stop = F.array_position(F.transform(tokens, lambda t: F.coalesce(ends(t), F.lit(False))), True)
    kept = F.slice(tokens, 1, F.when(stop > 0, stop.cast("int") - 1).otherwise(F.size(tokens)))
    kept = F.filter(F.transform(kept, lambda t: F.regexp_replace(F.regexp_replace(t, r"\d+", ""), r"^[ ,;:|.\-]+|[ ,;:|.\-]+$", "")), lambda t: t != "")
    return F.when((F.size(kept) >= 2) & F.exists(F.slice(kept, 1, words), lambda t: F.length(t) >= 3), F.array_join(F.slice(kept, 1, words), " "))


def _clean(field: str, raw: Column) -> Column:
    """A candidate's value, null where the field can't have it."""
    value = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(raw), r"[:\-=,.]*$", ""), r"<[^>]+>", ""), r"\s+\d+$", ""))
    low = F.lower(value)
    if field == "age":
        return F.when(F.trim(raw).try_cast("int").between(0, 120), F.concat(F.trim(raw).try_cast("int").cast("string"), F.lit(" Years")))
    if field == "gender":
        return F.when(low.isin("m", "male"), "Male").when(low.isin("f", "female"), "Female")
    if field.endswith("_date"):
        day = F.replace(F.trim(raw), F.lit("/"), F.lit("-"))
        parsed = F.coalesce(*(F.try_to_date(day, f) for f in ("d-M-yyyy", "d-M-yy", "d-MMM-yyyy")))
        return F.coalesce(F.date_format(parsed, "dd-MM-yyyy"), F.nullif(day, F.lit("")))
    if field in ("patient_name", "doctor_name"):
        name = _person(F.regexp_replace(value, r"(?i)\s+(?:dept|department|md|phd|reg\.|reg\s+no).*$", "") if field == "doctor_name" else value, 3 if field == "doctor_name" else 4)
        return F.when(~F.arrays_overlap(F.split(F.lower(name), " "), F.array(*map(F.lit, REJECTED[field]))), name)
    if field == "hospital_name":
        name = F.trim(F.regexp_replace(value, r"\s*[&|].*$", ""))
        # A facility's own words are the capitalised ones at the end.
        tail = F.regexp_extract(name, r"((?:\b(?:\p{Lu}\S*|of|and|the)\s+)*\p{Lu}\S*)$", 1)
        name = F.when(tail.rlike(r"(?i)hospital|medical cent|health|clinic|corporation|nursing home|maternity home|sanatorium"), tail).otherwise(name)
        good = (F.length(name) >= 5) & (name.rlike(r"(?i)hospital|center|centre|clinic|health") | F.regexp_replace(name, r"[ &.]", "").rlike(r"^\p{L}+$"))
        return F.when(good & ~low.rlike("|".join(REJECTED[field])), name)
    if field == "diagnosis":
        name = F.regexp_replace(F.regexp_extract(F.regexp_replace(value, r"\s+", " "), rf"(?i)^(.*?)(?:\b(?:age|sex|admission|admit|discharge|patient|doctor|hospital|bill|occupation)\b|\b{_DAY}\b|$)", 1), r"^[ ,;:|.\-]+|[ ,;:|.\-]+$", "")
        return F.when((F.length(name) >= 3) & name.rlike(r"\p{L}") & ~F.lower(value).rlike("|".join(REJECTED[field])), name)
    return F.when(F.regexp_replace(value, r"[^\d.]", "").try_cast("double").isNotNull(), value)


def pattern_field(text: Column, field: str) -> Column:
    """A field's value by its patterns: the earliest valid candidate; for a diagnosis the longest that isn't generic, for a gender one not beside an infant's words first."""
    found = []
    for k, pattern in enumerate(FIELD_PATTERNS[field]):
        p = F.lit(f"(?im){pattern}")
        pairs = F.zip_with(F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(1)), lambda w, v: F.struct(w.alias("whole"), v.alias("value")))
        found.append(F.transform(pairs, lambda x: F.struct(F.position(x["whole"], text).alias("at"), F.lit(k).alias("k"), _clean(field, x["value"]).alias("value"))))  # noqa: B023
    valid = F.filter(F.concat(*found), lambda c: c["value"].isNotNull())
    if field == "diagnosis":
        ranked = F.transform(valid, lambda c: F.struct(F.lower(c["value"]).isin(*GENERIC_DIAGNOSES).alias("generic"), (-F.length(c["value"])).alias("short"), c["at"].alias("at"), c["value"].alias("value")))
        return F.array_min(ranked)["value"]
    if field == "gender":
        near = lambda c: F.substr(text, F.greatest(c["at"] - 45, F.lit(1)), F.lit(90)).rlike(INFANT)
        return F.array_min(F.transform(valid, lambda c: F.struct(near(c).alias("infant"), c["at"].alias("at"), c["value"].alias("value"))))["value"]
    return F.array_min(valid)["value"]


# ---------------------------------------------------------------- D13, D18, D19: diagnosis terms

#: Words that tell a diagnosis line without a header (fixed values).
DIAGNOSIS_WORDS = ("diabetes", "hypertension", "pregnancy", "labour", "labor", "delivery", "episiotomy", "cesarean", "c-section", "myocardial", "infarction", "stroke", "fracture", "appendicitis", "cholecystitis", "pneumonia", "asthma", "copd", "cancer", "carcinoma", "tumor", "tumour", "anemia", "anaemia", "sepsis", "septicaemia", "hepatitis", "cirrhosis", "stone", "calculus", "hernia", "ulcer", "gastritis", "ckd", "chronic kidney", "renal failure", "heart failure", "tuberculosis", "dengue", "malaria", "typhoid", "covid", "fever", "trauma", "wound", "burn", "abscess", "syndrome", "disorder", "disease")
HEADER = r"(?i)(?:^|\n)\s*(?:final\s+diagnosis|primary\s+diagnosis|diagnosis|impression|dx)\s*[:\-]\s*"
HEADER_END = r"(?i)(?:^|\n)\s*(?:procedures?|treatment|hospital\s+course|medications?|investigation|history|examination|vitals?|plan|discharge\s+condition)\b"
VITALS = r"(?i)\b(?:bp|p|rr|temp|hr|spo2|hb|tlc|wbc|rbc|plt|na|k|cl|cr|esr|hbsag|hiv|vdrl|fbs|ppbs|hba1c)\s*[-:]\s*[a-z0-9./+\-]*"
QUANTITY = r"(?i)\b\d+(?:\.\d+)?\s*(?:mmhg|mg|ml|kg|cm|wks?|days?|m)?\b"
LONG_NARRATIVE, LONGEST_TERM, MOST_TERMS, WINDOW = 45, 80, 5, 4
PLAIN_ABBREVIATIONS = ("MRI", "CT", "BP", "HR", "DOB")
_KNOWN = "|".join(DIAGNOSIS_WORDS)


def _clauses(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda c: F.regexp_replace(c, r"^[\s\-:]+|[\s\-:]+$", "")), lambda c: c != "")


def diagnosis_keywords(text: Column, most: int = MOST_TERMS) -> Column:
    """Clauses of the section under a header; without one, lines that hold a diagnosis word; without those, WINDOW words each way of one. Vitals and numbers go; distinct, a few."""
    tail = F.try_element_at(F.split(text, HEADER, 2), F.lit(2))
    section = F.element_at(F.split(tail, HEADER_END, 2), 1)
    under = F.coalesce(_clauses(section, r"[\n;.]+|\s+\d+[).]\s+"), F.array().cast("array<string>"))
    lines = F.filter(_clauses(text, r"[\n;.]+"), lambda c: F.length(c).between(4, LONGEST_TERM) & F.lower(c).rlike(_KNOWN))
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z-]+"), F.lit(0))
    around = F.transform(words, lambda w, i: F.when(w.rlike(_KNOWN), F.array_join(F.slice(words, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW)) + WINDOW + 1), " ")))
    around = F.filter(around, lambda c: F.length(c).between(4, LONGEST_TERM))
    found = F.when(F.size(under) > 0, under).when(F.size(lines) > 0, lines).otherwise(around)
    cleaned = F.transform(found, lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, VITALS, " "), QUANTITY, " "), r"^[\s\-:,.]+|[\s\-:,.]+$", ""), r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda c: F.length(c) >= 4)), 1, most)


def needs_extraction(text: Column) -> Column:
    """A long narrative, or one with an abbreviation that isn't plain."""
    short = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,10}|[A-Z]+[0-9]+[A-Z0-9]*|[0-9]+[A-Z]+[A-Z0-9]*)\b"), F.lit(1))
    return F.coalesce((F.length(text) > LONG_NARRATIVE) | F.exists(short, lambda a: ~a.isin(*PLAIN_ABBREVIATIONS)), F.lit(False))


# ---------------------------------------------------------------- D24: scan reports

#: Types, body parts, and words of findings (fixed values).
SCAN_TYPES = (
    ("MRI", r"MRI|M\.R\.I|magnetic\s+resonance|MR\s+imaging|MR\s+scan"), ("CT", r"CT\s+scan|C\.T|computed\s+tomography|HRCT|CECT|NCCT|CT\s+with\s+contrast|CAT\s+scan"),
    ("X-Ray", r"X[\-\s]?Ray|radiograph|plain\s+film|chest\s+PA|AP\s+view|lateral\s+view"), ("Ultrasound", r"ultrasound|ultrasonography|USG|sonography|doppler"), ("PET", r"PET\s+scan|PET[\-/]CT|positron\s+emission"),
    ("Mammography", r"mammogra(?:m|phy)|breast\s+imaging"), ("Angiography", r"angiogra(?:m|phy)|DSA|catheter\s+study|coronary\s+angio"),
)
BODY_PARTS = (
    ("Brain / Head", r"brain|head|cranial|intracranial|cerebr|skull|sella"), ("Spine", r"spine|spinal|lumbar|cervical|thoracic|vertebr|disc|lumbosacral|dorsal\s+spine"), ("Chest", r"chest|thorax|lung|pulmonary|pleural|mediastin|cardiac|heart"),
    ("Abdomen", r"abdomen|abdominal|liver|hepat|spleen|pancrea|kidney|renal|gallbladder|biliary"), ("Pelvis", r"pelvi[cs]|hip|uterus|ovary|prostate|bladder|sacroiliac"), ("Knee", r"knee|patell|meniscus|cruciate|tibial\s+plateau"),
    ("Shoulder", r"shoulder|rotator\s+cuff|glenohumeral|acromi"), ("Neck", r"neck|thyroid|laryn|pharyn|cervical\s+soft"), ("Extremity", r"hand|wrist|elbow|ankle|foot|femur|tibia|humerus|forearm|leg"), ("Whole Body", r"whole\s+body|full\s+body"),
)
ABNORMAL = r"(?i)\b(?:fracture|mass|lesion|tumor|tumour|nodule|opacity|effusion|stenosis|herniat|bulge|tear|rupture|infarct|hemorrhage|haemorrhage|thrombus|thrombosis|embolism|aneurysm|dissection|edema|oedema|collection|abscess|calcif|calculus|stone|obstruction|perforation|collapse|atelectasis|consolidation|infiltrate|fibrosis|necrosis|erosion|degenerat|spondylol|narrowing|compression|displacement|abnormal|irregular|enlarged|dilat|hypertrop|atroph|malignant|metastas|polyp|cyst|inflammation|inflamed|swelling|thickening|heterogeneous|suspicious)\b"
NORMAL = r"(?i)\b(?:normal|unremarkable|no\s+(?:significant|abnormal|evidence)|within\s+normal\s+limits|no\s+fracture|no\s+mass|no\s+lesion|essentially\s+normal|no\s+acute|negative|no\s+focal|preserved|intact|symmetrical|clear\s+lung)\b"
CRITICAL = r"(?i)\b(?:fracture|mass|tumor|tumour|malignant|metastas|hemorrhage|haemorrhage|infarct|thrombus|thrombosis|embolism|aneurysm|perforation|necrosis)\b"
NEGATED = r"(?i)\b(?:no|not|without|absent|negative|nil|none|unremarkable|normal)\b"
SECTIONS = {
    "findings": (r"(?i)(?:findings|observation)[:\s]*\n?([\s\S]*?)(?=\n\s*(?:impression|conclusion|opinion|recommendation)|$(?![\s\S]))", 1500),
    "impression": (r"(?i)(?:impression|conclusion|opinion)[:\s]*\n?([\s\S]*?)(?=\n\s*(?:recommendation|advice|advised)|$(?![\s\S]))", 800),
    "recommendation": (r"(?i)(?:recommendation|advice|advised|suggested|follow[\-\s]up)[:\s]*\n?([\s\S]*)$", 500),
}


def scan_reports(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds scan_type, body_part, the sections, findings (text, severity, confidence), abnormal and confidence.

    A finding with a negation is no abnormality; critical ones come first. The report is abnormal
    where its sections hold more abnormal than normal words. Without sections, its telling sentences are the findings.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("scan_type", _first_that(SCAN_TYPES, "Unknown", lambda p: text.rlike(rf"(?i)\b(?:{p})\b"))).withColumn("body_part", _first_that(BODY_PARTS, "Unspecified", lambda p: text.rlike(rf"(?i)\b(?:{p})\b")))
    for name, (pattern, most) in SECTIONS.items():
        rows = rows.withColumn(name, F.substring(F.trim(F.regexp_extract(text, pattern, 1)), 1, most))
    sentences = F.filter(F.transform(F.split(text, r"[.\n]"), lambda s: F.trim(s)), lambda s: (F.length(s) >= 10) & (s.rlike(ABNORMAL) | s.rlike(NORMAL)))
    rows = rows.withColumn("findings", F.when((F.col("findings") == "") & (F.col("impression") == ""), F.array_join(F.slice(sentences, 1, 8), ". ")).otherwise(F.col("findings")))
    source = F.coalesce(*(F.nullif(c, F.lit("")) for c in (F.col("findings"), F.col("impression"), text)), F.lit(""))
    items = F.filter(F.transform(F.split(source, r"\n\s*[-•*\d.]+\s*|\n{2,}"), lambda s: F.trim(s)), lambda s: F.length(s) >= 10)

    def finding(item: Column, i: Column) -> Column:
        bad, not_so = item.rlike(ABNORMAL) & ~item.rlike(NEGATED), item.rlike(NORMAL) | item.rlike(NEGATED)
        critical = bad & item.rlike(CRITICAL)
        order = F.when(critical, 0).when(bad, 1).otherwise(2)
        sure = F.when(critical, 0.85).when(bad, 0.75).when(not_so, 0.80).otherwise(0.60)
        return F.struct(order.alias("order"), i.alias("i"), F.substring(item, 1, 300).alias("text"), F.when(critical, "critical").when(bad, "warning").otherwise("info").alias("severity"), sure.alias("confidence"))

    ranked = F.slice(F.array_sort(F.transform(items, finding)), 1, 12)
    full = F.concat_ws(" ", "findings", "impression")
    sure = 0.3 + F.when(F.col("findings") != "", 0.25).otherwise(0.0) + F.when(F.col("impression") != "", 0.15).otherwise(0.0) + F.when(F.col("scan_type") != "Unknown", 0.15).otherwise(0.0) + F.when(F.length(text) > 500, 0.1).otherwise(0.0) + F.when(F.length(text) > 1500, 0.05).otherwise(0.0)
    return (
        rows.withColumn("items", F.transform(ranked, lambda r: r.dropFields("order", "i"))).withColumn("abnormal", F.regexp_count(full, F.lit(ABNORMAL)) > F.regexp_count(full, F.lit(NORMAL)))
        .withColumn("confidence", F.least(sure, F.lit(0.98)))
    )


# ---------------------------------------------------------------- D28: cell tables

_AMOUNT = r"(?i)^\s*(?:rs\.?|inr|₹)?\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*$"
#: Parts of each kind of table, and the header words that name them (fixed values).
TABLE_PARTS = {
    "medication": (("name", r"drug|medicine|medication|name"), ("dose", r"dose|dosage|strength"), ("frequency", r"freq|times|schedule"), ("duration", r"duration|days")),
    "lab": (("test_name", r"test|investigation|name"), ("result", r"result|value"), ("units", r"unit"), ("range", r"range|normal|reference")),
    "vitals": (("name", r"vital|parameter|name"), ("value", r"value|reading|result"), ("units", r"unit")),
    "diagnosis": (("diagnosis", r"diagnosis|description|condition"), ("code", r"code|icd"), ("kind", r"type|kind")),
}


def table_records(cells: DataFrame) -> DataFrame:
    """(table_id, kind, row, record) of cell tables (table_id, kind, row, col, header, cell).

    An expense row takes its last amount cell as amount, the cells before it as description, and
    its second text cell as category. Other kinds take each part from the first cell whose header
    names it, and their first part from the first cell without a header. Rows without a first part go.
    """
    one = F.struct("col", F.lower(F.coalesce("header", F.lit(""))).alias("header"), F.trim("cell").alias("cell"))
    rows = cells.where(F.trim("cell") != "").groupBy("table_id", "kind", "row").agg(F.array_sort(F.collect_list(one)).alias("cells"))
    texts = F.transform("cells", lambda c: c["cell"])
    amounts = F.filter(texts, lambda t: t.rlike(_AMOUNT))
    number = lambda t: F.regexp_replace(t, r"(?i)rs\.?|inr|₹|[,\s]", "")
    last_is = F.element_at(texts, -1).rlike(_AMOUNT)
    words = F.when(last_is & (F.size(texts) > 1), F.slice(texts, 1, F.greatest(F.size(texts) - 1, F.lit(1)))).otherwise(F.slice(texts, 1, 1))
    second = F.try_element_at(texts, F.lit(2))
    expense = F.create_map(
        F.lit("description"), F.array_join(words, " "), F.lit("category"), F.when(second.isNotNull() & ~second.rlike(_AMOUNT), second).otherwise(F.element_at(texts, 1)),
        F.lit("amount"), number(F.try_element_at(amounts, F.lit(-1))),
    )
    record, first = expense, F.lit("x")
    for kind, parts in TABLE_PARTS.items():
        def value(k: int, pattern: str) -> Column:
            named = F.filter("cells", lambda c: c["header"].rlike(pattern))
            bare = F.filter("cells", lambda c: c["header"] == "")
            found = F.try_element_at(named, F.lit(1))["cell"]
            return found if k else F.coalesce(found, F.try_element_at(bare, F.lit(1))["cell"])

        values = [value(k, pattern) for k, (_, pattern) in enumerate(parts)]
        pairs = [x for (name, _), v in zip(parts, values, strict=True) for x in (F.lit(name), v)]
        record = F.when(F.col("kind") == kind, F.create_map(*pairs)).otherwise(record)
        first = F.when(F.col("kind") == kind, values[0]).otherwise(first)
    return rows.where(first.isNotNull()).select("table_id", "kind", "row", record.alias("record"))


# ---------------------------------------------------------------- F25, A36: canonical fields of extractors

#: An extractor's keys and the fields they stand for (fixed values).
EXTRACTOR_KEYS = {
    "patient_name": ("patient_name", "patientname", "name", "patient"), "patient_dob": ("date_of_birth", "birth_date", "dob", "birth"), "patient_age": ("age", "age_gender"), "patient_gender": ("sex", "gender"), "patient_address": ("address",),
    "insurance_policy_number": ("policy_number", "policy_no", "policy", "reg"), "claim_number": ("claim_no", "claim_number"), "insurance_payer": ("insurance_provider", "payer", "provider"), "hospital_name": ("hospital_name", "hospital"),
    "admission_date": ("admission_date", "admission"), "discharge_date": ("discharge_date", "discharge"), "doctor_name": ("doctor_name", "doctor", "consultant"), "diagnosis": ("diagnosis", "primary_diagnosis"),
    "claimed_total": ("claimed", "total_claimed", "amount_claimed"), "patient_id": ("uid", "uhid"),
}
FACILITY = r"(?i)hospital|commission|clinic|center|health|medical center|pharmacy"


def canonical_key(key: Column, value: Column) -> Column:
    """the canonical field of an extractor's key; a name that looks like a facility is the hospital's. Unknown keys are null."""
    norm = F.replace(F.regexp_replace(F.trim(F.lower(key)), "[:-]", ""), F.lit(" "), F.lit("_"))
    names = F.create_map(*(F.lit(x) for field, keys in EXTRACTOR_KEYS.items() for k in keys for x in (k, field)))
    field = names[norm]
    return F.when((field == "patient_name") & value.rlike(FACILITY) & ~value.rlike(r"(?i)m[sr]\."), "hospital_name").otherwise(field)


def best_candidates(fields: DataFrame, keys: list[str], field: str = "field", order: str = "seq") -> DataFrame:
    """The most confident candidate of each field; the first of equal ones. Aggregated, so nothing is gathered."""
    sure = F.coalesce(F.col("confidence"), F.lit(0.0))
    return fields.groupBy(*keys, field).agg(F.max_by(F.struct("value", "confidence"), F.struct(sure, -F.col(order))).alias("best")).select(*keys, field, "best.*")
