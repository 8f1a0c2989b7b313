"""Column functions: amounts, dates, names, codes, boxes. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Empty and white-space texts count as missing; "0" doesn't."""
    return F.nullif(F.trim(c), F.lit(""))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))


def amount_plain(*columns: Column) -> Column:
    """the first of the texts that is a number once commas and currency signs are dropped."""
    return F.coalesce(*(F.trim(F.regexp_replace(c, r"[,₹$]", "")).try_cast("double") for c in columns))


def amount_lenient(c: Column) -> Column:
    """also drops spaces, "rs", "rs." and "inr"; 0 where nothing parses."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s ,]", ""), r"₹|rs\.|rs|inr", "").try_cast("double"), F.lit(0.0))


def amount_stripped(c: Column) -> Column:
    """every character that can't be in a number is dropped."""
    return F.coalesce(F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))


def amount_signed(c: Column) -> Column:
    """parentheses mean negative; one comma before one or two digits at the end is a decimal comma."""
    bare = F.regexp_replace(F.trim(c), r"[^0-9.,()\-]", "")
    negative = bare.rlike(r"^\(.*\)$")
    inner = F.regexp_replace(bare, r"[()]", "")
    number = F.when(inner.rlike(r"^-?[0-9]+,[0-9]{1,2}$"), F.replace(inner, F.lit(","), F.lit("."))).otherwise(F.replace(inner, F.lit(","), F.lit(""))).try_cast("double")
    return F.when(negative, -number).otherwise(number)


def rounded(c: Column, digits: int) -> Column:
    """A double's nearest number of so many digits by the double's own product, as SQL engines on IEEE arithmetic round.

    F.round goes by the shortest decimal text instead: 1.005 is 1.01 there, though the double lies below.
    """
    return F.round(c.cast("double") * 10.0**digits) / 10.0**digits


def first_number(c: Column) -> Column:
    """the first number in a text."""
    return F.replace(F.nullif(F.regexp_extract(c, r"\d[\d,]*\.?\d*", 0), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


#: Date layouts in the order they are tried: day before month where both fit (fixed values).
DATE_LAYOUTS = {
    "fraud": ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "yyyy/MM/dd"),
    "risk": ("dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "dd-MMM-yyyy", "dd/MMM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy", "MMM dd, yyyy"),
}


def parse_date(c: Column, layouts: str = "fraud") -> Column:
    """the first layout that fits decides."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(x)).cast("date") for x in DATE_LAYOUTS[layouts]))


def birth_date(c: Column, pivot: int = 50) -> Column:
    """yyyy-MM-dd from day-first dates; two-digit years above the pivot are of the last century."""
    d, m, y = (F.regexp_extract(c, r"(\d{1,2})[/\-. ](\d{1,2}|[A-Za-z]{3,9})[/\-. ,]+(\d{2,4})", i) for i in (1, 2, 3))
    months = F.create_map(*(F.lit(v) for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split()) for v in (n, i + 1)))
    month = F.coalesce(m.try_cast("int"), months[F.lower(F.substring(m, 1, 3))])
    short = y.try_cast("int")
    year = F.when(F.length(y) > 2, short).when(short > pivot, short + 1900).otherwise(short + 2000)
    iso = F.regexp_extract(c, r"(\d{4})[/\-](\d{1,2})[/\-](\d{1,2})", 0)
    made = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, d.try_cast("int")), F.lit("yyyy-MM-dd"))
    return F.date_format(F.coalesce(F.try_to_timestamp(F.nullif(F.replace(iso, F.lit("/"), F.lit("-")), F.lit("")), F.lit("yyyy-M-d")), made), "yyyy-MM-dd")


def stay_days(admitted: Column, discharged: Column, most: int = 60) -> Column:
    """F8: 0 where a date is missing or the order is wrong."""
    days = F.datediff(discharged, admitted)
    return F.when(days > 0, F.least(days, F.lit(most))).otherwise(0)


def field_key(c: Column) -> Column:
    """lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def person_name(c: Column) -> Column:
    """Without titles, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b(?:mr|mrs|ms|dr|shri|smt|master|baby|miss)\b\.?", ""), r"\s+", " ")))


def name_similarity(a: Column, b: Column) -> Column:
    """1 equal, 0.85 one holds the other, else token Jaccard, 0.80 where outer tokens agree; 0 without a name."""
    return normal_similarity(person_name(a), person_name(b))


def normal_similarity(x: Column, y: Column) -> Column:
    """name_similarity() of names that person_name() has been through."""
    s, t = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    jaccard = F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t))
    outer = (F.size(s) >= 2) & (F.size(t) >= 2) & (F.array_min(s) == F.array_min(t)) & (F.array_max(s) == F.array_max(t))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.85).when(jaccard >= 0.5, jaccard).when(outer, 0.80).otherwise(jaccard)


def words(c: Column) -> Column:
    """lower-case alphanumeric tokens of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)


#: First and last code prefix of each chapter (fixed values).
CHAPTERS = (("A00", "B99", 1), ("C00", "D48", 2), ("D50", "D89", 3), ("E00", "E90", 4), ("F00", "F99", 5), ("G00", "G99", 6), ("H00", "H59", 7), ("H60", "H95", 8), ("I00", "I99", 9), ("J00", "J99", 10), ("K00", "K93", 11), ("L00", "L99", 12), ("M00", "M99", 13), ("N00", "N99", 14), ("O00", "O99", 15), ("P00", "P96", 16), ("Q00", "Q99", 17), ("R00", "R99", 18), ("S00", "T98", 19), ("V01", "Y98", 20), ("Z00", "Z99", 21), ("U00", "U99", 22))


def chapter(code: Column) -> Column:
    """a diagnosis code's chapter number."""
    head = F.upper(F.substring(code, 1, 3))
    out = F.lit(None).cast("int")
    for low, high, n in CHAPTERS:
        out = F.when(head.between(low, high), n).otherwise(out)
    return out


def roman(c: Column) -> Column:
    """I to XXII as a number."""
    names = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI XXII".split()
    return F.create_map(*(F.lit(v) for i, n in enumerate(names) for v in (n, i + 1)))[F.upper(F.trim(c))]


def ratio(a: Column, b: Column, most: float | None = None) -> Column:
    """0 where the divisor isn't positive."""
    out = F.when(b > 0, a / b).otherwise(0.0)
    return out if most is None else F.least(out, F.lit(most))


def squash(x: Column) -> Column:
    """F16: the logistic function."""
    return 1 / (1 + F.exp(-x))


#: Upper bounds of LOW and MEDIUM; inclusive says whether a bound belongs below (fixed values).
CUTOFFS = {"rejection": (0.25, 0.50, True), "fraud": (0.40, 0.70, False), "insight": (0.3, 0.6, False)}


def risk_label(score: Column, kind: str) -> Column:
    """F17."""
    low, high, inclusive = CUTOFFS[kind]
    under = (lambda b: score <= b) if inclusive else (lambda b: score < b)
    return F.when(score.isNull(), None).when(under(low), "LOW").when(under(high), "MEDIUM").otherwise("HIGH")


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """F20."""
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def box_overlap(a: tuple, b: tuple) -> Column:
    """area that two boxes (x0, y0, x1, y1) share."""
    return box_area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


#: Steps of processing with label and percent, in order (fixed values).
STEPS = (("UPLOADED", "Uploaded", 5), ("INTAKE", "Intake", 10), ("OCR", "Reading documents", 30), ("PARSE", "Extracting fields", 50), ("CODE", "Assigning codes", 65), ("RISK", "Scoring risk", 80), ("VALIDATE", "Validating", 90), ("COMPLETED", "Completed", 100))


def step_percent(step: Column) -> Column:
    """0 for unknown steps."""
    return F.coalesce(F.create_map(*(F.lit(v) for s, _, p in STEPS for v in (s, p)))[step], F.lit(0))


def retrieval_confidence(score: Column, rank: Column, explicit: Column) -> Column:
    """F22."""
    return F.when(explicit, 0.90).otherwise(0.55 + 0.4 * score - F.least(0.04 * rank, F.lit(0.12)))


def extractor_confidence(version: Column) -> Column:
    """by the extractor's name."""
    v = F.lower(F.coalesce(version, F.lit("")))
    return F.when(v.rlike("expense-table"), 0.9).when(v.rlike("layout|vlm|semantic"), 0.85).when(v.rlike("heuristic|regex"), 0.6).otherwise(0.5)
