"""Document and text operators: classes, relevance, identity, anchors, redaction, chunks, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.scalars import blank_to_null, normal_similarity, person_name

#: Document classes in the order they are tried: code, label, pattern (fixed values).
CLASSES = (
    ("DISCHARGE_SUMMARY", "Discharge Summary", r"discharge\s+summary|discharge\s+report|final\s+summary|case\s+summary"),
    ("ADMISSION_RECORD", "Admission Record", r"admission\s+(?:record|form|note|sheet)|indoor\s+case|case\s+paper|IP\s+record"),
    ("PRESCRIPTION", "Prescription / Medication", r"prescription|Rx|medication\s+(?:list|order|chart)|drug\s+chart|treatment\s+sheet"),
    ("LAB_REPORT", "Laboratory Report", r"lab(?:oratory)?\s+(?:report|test|result)|blood\s+(?:test|report)|CBC|LFT|KFT|RFT|urine\s+(?:test|analysis|report)|pathology|hematology|biochemistry|culture\s+(?:report|sensitivity)|serology|biopsy|histopath"),
    ("RADIOLOGY_REPORT", "Radiology / Imaging Report", r"radiology|imaging\s+report|MRI\s+report|CT\s+report|X[\-\s]?Ray\s+report|ultrasound\s+report|sonography|nuclear\s+medicine|PET|mammogra"),
    ("SURGICAL_NOTE", "Operative / Surgical Note", r"operative?\s+(?:note|report|record|summary)|surgery\s+(?:note|report)|pre[\-\s]?op|post[\-\s]?op|anesthesia\s+(?:note|record)|anaesthe"),
    ("CONSULTATION", "Consultation Note", r"consultation|consult\s+note|specialist\s+(?:opinion|report)|referral\s+letter"),
    ("BILL_INVOICE", "Hospital Bill / Invoice", r"hospital\s+bill|bill\s+(?:summary|detail)|invoice|receipt|payment|charges|itemized\s+bill|final\s+bill|interim\s+bill|estimated\s+cost"),
    ("INSURANCE_FORM", "Insurance / Claim Form", r"claim\s+form|insurance\s+(?:form|card|policy)|pre[\-\s]?auth|cashless|TPA|third\s+party|reimbursement\s+form|policy\s+(?:number|document)"),
    ("ID_DOCUMENT", "Identity Document", r"aadhaar|aadhar|PAN\s+card|voter\s+ID|passport|driving\s+licen[sc]e|photo\s+ID|identity\s+(?:card|proof|document)"),
    ("CONSENT_FORM", "Consent Form", r"consent\s+(?:form|document)|informed\s+consent|authorization\s+for\s+treatment"),
    ("INVESTIGATION", "Investigation / Diagnostic Report", r"ECG|EEG|EMG|echocardiograph|spirometry|pulmonary\s+function|endoscopy|colonoscopy|bronchoscopy|angiography"),
)
#: Words that tell a medical text, and one that isn't (fixed values).
MEDICAL = r"(?i)\b(?:patient|diagnosis|treatment|hospital|doctor|physician|medical|clinical|health|healthcare|disease|condition|symptom|prescription|medication|admission|discharge|surgery|procedure|insurance|claim|policy|TPA|reimbursement|cashless|laboratory|blood|urine|biopsy|pathology|radiology|imaging|scan|MRI|CT|ultrasound|CPT|nursing|ward|ICU|OT|operation|anesthesia|OPD|IPD|emergency|ER|casualty|ambulance|pharmacy|drug|tablet|capsule|injection|IV|vital|temperature|BP|pulse|SPO2|allergy|bill|invoice|charges|amount|receipt|payment|DOB|age|gender|sex|male|female|registration|MRN|UHID)\b"
NOT_MEDICAL = r"(?i)\b(?:curriculum\s+vitae|resume|job\s+application|employment|real\s+estate|property|deed|mortgage|rent|lease|tenancy|restaurant|food\s+order|delivery|shopping|travel\s+itinerary|flight\s+booking|hotel\s+reservation|academic|transcript|degree|semester|tax\s+return|income\s+tax|legal\s+notice|court\s+order|police)\b"
RELEVANCE_CHARS = 5000


def document_class(file_name: Column, text: Column) -> Column:
    """(code, label): the first class that the name, then the text, fits."""
    out = F.struct(F.lit("UNKNOWN").alias("code"), F.lit("Unclassified Document").alias("label"))
    for source in (text, file_name):
        for code, label, pattern in reversed(CLASSES):
            out = F.when(source.rlike(rf"(?i)\b(?:{pattern})\b"), F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"))).otherwise(out)
    return out


#: Report view of a class (fixed values).
REPORT_VIEW = {"DISCHARGE_SUMMARY": "discharge", "LAB_REPORT": "investigation", "RADIOLOGY_REPORT": "investigation", "INVESTIGATION": "investigation", "PRESCRIPTION": "prescription", "BILL_INVOICE": "bill", "INSURANCE_FORM": "claim_form", "ID_DOCUMENT": "identity"}


def report_view(code: Column) -> Column:
    """D2."""
    return F.coalesce(F.create_map(*(F.lit(v) for pair in REPORT_VIEW.items() for v in pair))[code], F.lit("other"))


def relevance(text: Column, medical: str = MEDICAL, other: str = NOT_MEDICAL) -> Column:
    """D3: (relevant, confidence) by indicator density per 1000 characters of the beginning."""
    head = F.substring(text, 1, RELEVANCE_CHARS)
    size = F.greatest(F.length(head), F.lit(1))
    m, n = F.regexp_count(head, F.lit(medical)) / size * 1000, F.regexp_count(head, F.lit(other)) / size * 1000
    out = lambda yes, sure: F.struct(F.lit(yes).alias("relevant"), (sure if isinstance(sure, Column) else F.lit(sure)).cast("double").alias("confidence"))
    return (
        F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) < 20, out(False, 0.0)).when((n > 0) & (n > m), out(False, F.least(n / 5, F.lit(0.95)))).when(m == 0, out(False, 0.1))
        .when(m < 2, out(False, 0.3)).when(m < 5, out(True, 0.6)).otherwise(out(True, F.least(0.5 + m / 20, F.lit(0.98))))
    )


def _first(text: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns))


def identity(text: Column) -> Column:
    """Name, record id, birth date, age, gender and policy, each by its first pattern that fits."""
    head = F.substring(text, 1, 8000)
    name = r"([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3})"
    return F.struct(
        _first(head, rf"(?i:patient\s*(?:name)?)\s*[:\-]?\s*{name}", rf"(?i:patient|pt)\s*[:\-]\s*{name}", rf"(?:Mr\.|Mrs\.|Ms\.|Shri|Smt\.?|Master)\s+{name}").alias("name"),
        _first(head, r"(?i)(?:patient\s*ID|PID|MRN|UHID|IP\s*(?:No|Number)|registration\s*(?:no|number))\s*[:\-]?\s*([A-Z0-9\-/]{3,20})", r"(?i)(?:case\s*no|admission\s*no|bed\s*no)\s*[:\-]?\s*([A-Z0-9\-/]{3,20})").alias("record_id"),
        _first(head, r"(?i)(?:DOB|date\s*of\s*birth|birth\s*date)\s*[:\-]?\s*(\d{1,2}[\-/]\d{1,2}[\-/]\d{2,4})").alias("dob"),
        _first(head, r"(?i)age(?:\s*[/&]\s*gender)?\s*[:\-]?\s*(\d{1,3})").alias("age"),
        _first(head, r"(?i)(?:sex|gender|age\s*[/&]\s*gender)\s*[:\-]?\s*(?:\d{1,3}\s*[/\s]\s*)?(male|female|m|f|other)\b").alias("gender"),
        _first(head, r"(?i)(?:policy\s*(?:no|number|id)|insurance\s*(?:no|number|id)|member\s*(?:no|id))\s*[:\-]?\s*([A-Z0-9\-/]{4,25})").alias("policy"),
    )


#: Points of an identity's parts when the most complete document is chosen (fixed values).
POINTS = {"name": 3, "record_id": 3, "dob": 2, "policy": 2, "age": 1, "gender": 1}


def identity_matched(docs: DataFrame) -> DataFrame:
    """Each document against its claim's most complete identity.

    docs: claim_id, document_id, seq and the identity's columns. The primary is found by an
    aggregation and joined back, so no claim's documents meet in one row.
    """
    c = F.col
    points = sum((F.when(blank_to_null(c(k)).isNotNull(), n).otherwise(0) for k, n in POINTS.items()), F.lit(0))
    primary = docs.groupBy("claim_id").agg(F.max_by(F.struct("document_id", *POINTS), F.struct(points, -c("seq"))).alias("p"))
    rows = docs.join(primary, "claim_id")

    equal = lambda k: F.when(c(k).isNotNull() & c(f"p.{k}").isNotNull(), (F.lower(F.trim(c(k))) == F.lower(F.trim(c(f"p.{k}")))).cast("double"))
    # Names are normalised once, in columns of their own: repeated inside the rule they make code too long to compile.
    rows = rows.withColumn("own_name", person_name(c("name"))).withColumn("main_name", person_name(c("p.name"))).withColumn("alike", normal_similarity(c("own_name"), c("main_name")))
    name = F.when((c("own_name") != "") & (c("main_name") != ""), c("alike"))
    parts = [(name, 0.5), (equal("record_id"), 0.3), (equal("dob"), 0.2)]
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    score = sum((F.coalesce(s, F.lit(0.0)) * w for s, w in parts), F.lit(0.0)) / F.when(weight > 0, weight)
    clash = F.coalesce(equal("record_id") == 0, F.lit(False))
    score = F.when(clash, 0.1).otherwise(score)
    verdict = F.when(score.isNull(), "NO_DATA").when(clash | (score < 0.4), "MISMATCH").when(score < 0.7, "UNCERTAIN").otherwise("MATCH")
    return rows.select("claim_id", "document_id", F.round(score, 4).alias("score"), verdict.alias("verdict"), (c("document_id") == c("p.document_id")).alias("is_primary"))


def gated(docs: DataFrame) -> DataFrame:
    """Documents against the anchor, the claim's first named document, locked ones first."""
    c = F.col
    named = person_name(c("name")) != ""
    anchor = docs.groupBy("claim_id").agg(F.min_by(F.when(named, person_name(c("name"))), F.when(named, F.struct(~c("locked"), c("seq")))).alias("anchor"))
    rows = docs.join(anchor, "claim_id")
    verdict = F.when(~named | c("anchor").isNull(), "NO_DATA").when(person_name(c("name")) == c("anchor"), "MATCH").otherwise("MISMATCH")
    return rows.select("claim_id", "document_id", verdict.alias("verdict"), (verdict != "MATCH").alias("excluded"))


#: Amount anchors in order of trust (fixed values).
_MONEY = r"\s*[:|\-]?\s*(?:rs|inr|usd|\$|₹)?\.?\s*([\d,]+\.?\d*)"
NET = tuple(rf"(?i){p}{_MONEY}" for p in (r"net\s*admissible\s*(?:amount|total)?", r"admissible\s*amount", r"net\s*payable\s*(?:amount|total)?", r"amount\s*payable", r"net\s*(?:total|amount)", r"payable\s*(?:total|amount)", r"total\s*payable"))
GROSS = tuple(rf"(?i){p}{_MONEY}" for p in (r"gross\s*hospital\s*bill", r"gross\s*bill", r"(?:total\s*)?gross\s*(?:total\s*)?amount", r"gross\s*total", r"total\s*amount", r"bill\s*summary[\s\S]{0,350}?gross\s*total"))


def last_amount(text: Column, patterns: tuple[str, ...]) -> Column:
    """The last positive amount of the first pattern that has one."""

    def of(pattern: str) -> Column:
        values = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double")), lambda v: v > 0)
        return F.try_element_at(values, F.lit(-1))

    return F.coalesce(*(of(p) for p in patterns))


#: Redaction rules in the order they apply: pattern, token (fixed values).
PHI = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"), (r"\b(?:\+?1[-.]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"), (r"(?i)\bMRN[:\s#]*\d{4,12}\b", "[MRN_REDACTED]"),
    (r"(?i)\b(?:DOB|Date of Birth|Birth Date)[:\s]*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", "[DOB_REDACTED]"), (r"\b[A-Z]{2,4}\d{8,15}\b", "[POLICY_REDACTED]"),
)
PHI_MORE = ((r"\b\d{4}\s?\d{4}\s?\d{4}\b", "[AADHAAR_REDACTED]"), (r"\b[A-Z]{5}\d{4}[A-Z]\b", "[PAN_REDACTED]"), (r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "[IFSC_REDACTED]"), (r"\b\d{9,18}\b", "[ACCOUNT_REDACTED]"), (r"\b\d{6}\b", "[PIN_REDACTED]"))


def scrubbed(text: Column, more: tuple[tuple[str, str], ...] = ()) -> Column:
    """The rules in order, then the caller's own."""
    for pattern, token in (*PHI, *more):
        text = F.regexp_replace(text, pattern, token.replace("$", r"\$"))
    return text


def usable(text: Column) -> Column:
    """At least 25 characters that aren't space and 4 words."""
    return (F.length(F.regexp_replace(text, r"\s", "")) >= 25) & (F.regexp_count(text, F.lit(r"\S+")) >= 4)


def noisy(text: Column, most: int = 200) -> Column:
    """Too long, or two header words or more."""
    terms = F.array(*map(F.lit, ("patient name", "date", "address", "policy", "hospital", "doctor", "bill no", "page")))
    return (F.length(text) > most) | (F.size(F.filter(terms, lambda t: F.lower(text).contains(t))) >= 2)


def chunks(docs: DataFrame, size: int = 500, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Overlapping character windows, white-space ones dropped."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(step))
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col), F.col(text_col).alias("t"), F.posexplode(starts).alias("chunk", "start"))
    return rows.select(id_col, "chunk", "start", F.substr("t", F.col("start") + 1, F.lit(size)).alias("text")).where(F.trim("text") != "")


def keyword_scores(pieces: DataFrame, keywords: list[str]) -> DataFrame:
    """Adds hits, how often any of the words comes in a piece."""
    pattern = "(?i)(?:" + "|".join(keywords) + ")"
    return pieces.withColumn("hits", F.regexp_count("text", F.lit(pattern)))


def within_budget(pieces: DataFrame, score: str, budget: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """The best pieces of each document, back in order, cut at the character budget."""
    best = pieces.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(score), "chunk"))).where(F.col("r") <= most)
    used = F.sum(F.length("text")).over(Window.partitionBy(id_col).orderBy("chunk")) - F.length("text")
    return best.withColumn("used", used).where(F.col("used") < budget).withColumn("text", F.substr("text", F.lit(1), F.lit(budget) - F.col("used"))).drop("r", "used")


def key_values(text: Column) -> Column:
    """`key: value` lines as (key, value)."""
    pairs = F.transform(F.split(text, "\n"), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([A-Za-z][A-Za-z /._-]{1,40}?)\s*:\s*(\S.*)$", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^\s*([A-Za-z][A-Za-z /._-]{1,40}?)\s*:\s*(\S.*)$", 2)).alias("value")))
    return F.filter(pairs, lambda p: p["key"] != "")


def column_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of lines with two columns or more (pipes, tabs or wide gaps) as tables."""
    cells = F.filter(F.split("line", r"\s*\|\s*|\t+| {2,}"), lambda c: c != "")
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line")).withColumn("columns", F.size(cells)).where("columns >= 2")
    island = F.col("n") - F.row_number().over(Window.partitionBy(id_col).orderBy("n"))
    return rows.withColumn("island", island).groupBy(id_col, "island").agg(F.min("n").alias("first_line"), F.count("*").alias("lines"), F.max("columns").alias("columns")).drop("island")


def merged_lines(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """U4: the lines of several texts in order, repeated ones (by their normal form) dropped."""
    rows = pieces.select(id_col, "seq", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.trim("line") != "")
    norm = F.regexp_replace(F.lower(F.trim("line")), r"\s+", " ")
    first = rows.groupBy(id_col, F.xxhash64(norm).alias("key")).agg(F.min(F.struct("seq", "n", "line")).alias("s"))
    return first.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("text"))


#: Chat commands on fields: action and pattern with field and value (fixed values).
INTENTS = (
    ("delete", r"(?i)\b(?:delete|remove|clear)\s+(?:the\s+)?([a-z][a-z _]{1,40}?)\s*(?:field)?\s*[.!]?$"),
    ("modify", r"(?i)\b(?:change|update|set|correct|modify)\s+(?:the\s+)?([a-z][a-z _]{1,40}?)\s+(?:to|as|=)\s+(.+?)\s*[.!]?$"),
    ("add", r"(?i)\badd\s+(?:the\s+)?([a-z][a-z _]{1,40}?)\s+(?:as|=|:)\s+(.+?)\s*[.!]?$"),
)


def intent(text: Column) -> Column:
    """(action, field, value) of a command, null for other texts."""
    out = F.lit(None).cast("struct<action:string,field:string,value:string>")
    for action, pattern in reversed(INTENTS):
        value = F.lit(None).cast("string") if action == "delete" else F.regexp_extract(text, pattern, 2)
        out = F.when(text.rlike(pattern), F.struct(F.lit(action).alias("action"), F.replace(F.lower(F.trim(F.regexp_extract(text, pattern, 1))), F.lit(" "), F.lit("_")).alias("field"), value.alias("value"))).otherwise(out)
    return out


#: Entity patterns with confidence (fixed values).
ENTITIES = (("DIAGNOSIS", 0.65, r"(?i)(?:diagnosis|diagnosed\s+with|impression)\s*[:\-]?\s*([^\n.;]{3,80})"), ("PROCEDURE", 0.60, r"(?i)(?:procedure|surgery|operation)\s*[:\-]?\s*([^\n.;]{3,80})"), ("MEDICATION", 0.60, r"(?i)(?:tab\.?|cap\.?|inj\.?|rx)\s*[:\-]?\s*([A-Za-z][A-Za-z0-9 \-]{2,40})"))


#: Medicines by their names and brands, and what introduces others (fixed values).
MEDICINES = {
    "Paracetamol": "paracetamol|acetaminophen|tylenol|calpol", "Ibuprofen": "ibuprofen|brufen", "Aspirin": "aspirin", "Amoxicillin": "amoxicillin|amoxycillin", "Ciprofloxacin": "ciprofloxacin|cipro", "Cefixime": "cefixime",
    "Metformin": "metformin|glucophage", "Lisinopril": "lisinopril|prinivil", "Atorvastatin": "atorvastatin|lipitor", "Omeprazole": "omeprazole|prilosec", "Salbutamol": "salbutamol|albuterol", "Doxycycline": "doxycycline",
    "Metoprolol": "metoprolol|lokren", "Amlodipine": "amlodipine|norvasc", "Insulin": "insulin",
}
PRESCRIBED = r"(?i)(?:rx|medicine|drug|medication|tab|capsule|injection)\s*[:|\-]?\s*([A-Za-z\s\-\d.]{3,80})"


def medicines(text: Column) -> Column:
    """Distinct medicines: known ones by name or brand, and what stands after a prescription's words, in title case."""
    known = [F.when(text.rlike(rf"(?i)\b(?:{p})\b"), name) for name, p in MEDICINES.items()]
    others = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PRESCRIBED), F.lit(1)), lambda m: F.trim(m)), lambda m: F.length(m) > 2)
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*known)), F.transform(others, lambda m: F.initcap(m)))))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, entity_type, entity_text, confidence, start)."""
    made = [F.transform(F.array_distinct(F.regexp_extract_all(text_col, F.lit(p), F.lit(1))), _entity(kind, sure)) for kind, sure, p in ENTITIES]
    rows = docs.select(id_col, F.col(text_col).alias("t"), F.inline(F.concat(*made)))
    return rows.select(id_col, "entity_type", "entity_text", "confidence", (F.expr("locate(entity_text, t)") - 1).alias("start"))


def _entity(kind: str, sure: float):
    return lambda v: F.struct(F.lit(kind).alias("entity_type"), F.trim(v).alias("entity_text"), F.lit(sure).alias("confidence"))


#: Labels that go from a code's context (fixed values).
_LEADING = r"(?i)^(?:diagnosis|dx|impression|procedure|proc)\s*\d*\s*[:-]?\s*|^\d+[.)]\s*"


def _nearby(before: Column, after: Column) -> Column:
    """A code's description: its line before it, joined with the line above where that is short; else its line after it; null under 9 characters."""
    bare = F.trim(F.regexp_replace(before, r"(?i)\b(?:icd-?10|icd|cpt(?:\s*code)?|code)\s*[:-]?\s*$", ""))
    parts = F.transform(F.split(bare, r"[\n|\t]"), lambda p: F.trim(F.regexp_replace(F.trim(p), _LEADING, "")))
    own, above = F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    told = F.when((F.length(own) < 15) & (above != ""), F.trim(F.concat_ws(" ", above, own))).otherwise(own)
    line = F.trim(F.regexp_extract(after, r"^[\s:\-|]*([^\n|\t]*)", 1))
    return F.when(F.length(told) > 8, told).when(F.length(line) > 8, line)


def code_mentions(docs: DataFrame, catalogue: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Explicit codes with confidence, context (80 characters each way, see _nearby) and the catalogue's description; known says whether it has the code.

    Mentions after words of identifiers or money are no codes; a trigger word makes them surer.
    """
    pattern = r"(?<![0-9A-Za-z.])(?:[A-Z][0-9]{2}(?:\.[0-9A-Z]{1,4})?|[0-9]{5})(?![0-9A-Za-z])"
    code = F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))
    # A piece stands between two mentions: the end of one is before a code, the beginning of the next after it.
    gaps = F.split(text_col, pattern, -1)
    zipped = F.transform(code, lambda c, i: F.struct(c.alias("code"), F.right(F.get(gaps, i), F.lit(80)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(80)).alias("after")))
    rows = docs.where(F.col(text_col).rlike(pattern)).select(id_col, F.posexplode(zipped).alias("n", "m")).select(id_col, "n", "m.before", "m.after", "m.code")
    near = F.right("before", F.lit(40))
    rows = rows.where(~F.lower(near).rlike(r"(?:rs\.?|inr|₹|phone|pin|bill|policy|amount|no\.?)\s*[:#\-]?\s*$"))
    sure = F.when(F.lower(near).rlike(r"icd|cpt|code"), 0.95).when(F.col("code").rlike("^[A-Z]"), 0.90).otherwise(0.60)
    rows = rows.withColumn("confidence", sure).withColumn("context", _nearby(F.col("before"), F.col("after"))).drop("before", "after")
    return rows.join(catalogue.select("code", "description").withColumn("known", F.lit(True)), "code", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def aliased(intents: DataFrame, aliases: DataFrame) -> DataFrame:
    """Fields by their canonical names; aliases: alias, canonical, each alias once."""
    return intents.join(aliases.withColumnRenamed("alias", "field"), "field", "left").withColumn("field", F.coalesce("canonical", "field")).drop("canonical")


def ordered_text(pages: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """A key's texts in order (unknown places last), joined and cut; null where all are null.

    Texts that begin past the cut are dropped before they are gathered. One that begins just after it stays: the
    break before it is the last character that counts.
    """
    size = F.when(F.col(text).isNotNull(), F.length(text) + 1).otherwise(0)
    ahead = F.sum(size).over(Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last(), text).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    pages = pages.select(key, order, F.substring(text, 1, most).alias(text), ahead.alias("__ahead")).where(F.col("__ahead") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).isNull().alias("__last"), order, text))), lambda s: s[text]), "\n")
    return pages.groupBy(key).agg(F.when(F.count(text) > 0, F.substring(joined, 1, most)).alias("text"))


def set_hash(docs: DataFrame, key: str, hash_col: str) -> DataFrame:
    """sha256 of a claim's sorted content hashes, joined by commas."""
    return docs.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(hash_col)), ","), 256).alias("set_hash"))


#: Words of lines worth keeping as clinical context (fixed values).
CLINICAL = r"(?i)(?:diagnosis|delivery|discharge|clinical|impression|obstetric|investigation|procedure|operative|treatment|complaint|history|course in hospital|c/o|h/o|type of delivery|indication|lab|apgar|gestation|gravida|para)"


def clinical_context(text: Column, known: Column, most: int = 25, fallback: int = 1500) -> Column:
    """The clinical lines of a text, a few, else its beginning; known values masked, longest first."""
    lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 5) & x.rlike(CLINICAL))
    kept = F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, most), "\n")).otherwise(F.substring(text, 1, fallback))
    longest = F.array_sort(F.filter(known, lambda v: F.length(v) > 2), lambda a, b: F.length(b) - F.length(a))
    return F.trim(F.aggregate(longest, kept, lambda t, v: F.replace(t, v, F.lit("[REDACTED]"))))


def obstetric_repaired(text: Column) -> Column:
    """Digits misread in obstetric shorthand: I for 1 in G3P1L1A1, Z for 2 before days and weeks."""
    fixed = F.regexp_replace(text, r"(?i)\b(G\d)(P)[I1](L)[I1](A)[I1]\b", "$1$2" + "1$3" + "1$4" + "1")
    return F.regexp_replace(F.regexp_replace(fixed, r"(?i)\bZDAYS\b", "2DAYS"), r"(?i)\bZWKS\b", "2WKS")
