"""Expense rows: categories, totals, reconciliation, merging of extractors, duplicate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.scalars import words
from claimloom.sources.storage import stored

#: Row category to charge field (fixed values).
CATEGORY_FIELD = {
    "Room Rent": "room_charges", "Nursing": "nursing_charges", "Consultation": "consultation_charges", "Pharmacy": "pharmacy_charges", "Injection": "pharmacy_charges", "Tablet": "pharmacy_charges",
    "Laboratory": "laboratory_charges", "USG": "radiology_charges", "ECG": "radiology_charges", "X-Ray": "radiology_charges", "Surgery / OT": "surgery_charges", "Labour / Delivery": "surgery_charges",
    "Consumables": "consumables", "Blood": "blood_charges", "Service Charges": "misc_charges", "Diet / Nutrition": "misc_charges", "Miscellaneous": "misc_charges",
}

#: What a summary row says, which isn't an expense itself (fixed values).
SUMMARY = ("total", "grand total", "bill amount", "claim amount", "claimed amount", "amount claimed", "amount payable", "net amount", "final amount", "amount due", "sum insured")
#: Texts that only look like expense rows: identifiers, addresses, dosage lines.
NOT_EXPENSE = r"(?i)\b(?:pin\s*code|pincode|aadhaar|aadhar|ifsc|account\s*(?:no|number)|cheque|a/c\s*no|phone|mobile|e-?mail|gstin|reg(?:istration)?\s*no)\b|\b[A-Z]{5}[0-9]{4}[A-Z]\b|\b[A-Z]{4}0[A-Z0-9]{6}\b|\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b|\b(?:once|twice|thrice)\s+daily\b|\b[01]-[01]-[01]\b"


def is_summary(description: Column, category: Column | None = None) -> Column:
    """The description and category together hold a summary row's words."""
    text = F.lower(F.concat_ws(" ", F.trim(description), *([F.trim(category)] if category is not None else [])))
    return F.coalesce(text.rlike("|".join(SUMMARY)), F.lit(False))


def is_expense(description: Column, amount: Column) -> Column:
    """A plausible row: 3 to 300 characters with a letter, positive amount, no identifier, no bare 6-digit number."""
    text = F.trim(F.coalesce(description, F.lit("")))
    return F.length(text).between(3, 300) & text.rlike("[A-Za-z]") & ~text.rlike(NOT_EXPENSE) & ~text.rlike(r"^\D*\b[0-9]{6}\b\D*$") & (amount > 0)


def charge_field(category: Column, description: Column) -> Column:
    """ICU and theatre rows by description, others by category, the rest miscellaneous."""
    low = F.lower(F.coalesce(description, F.lit("")))
    names = F.create_map(*(F.lit(v) for pair in CATEGORY_FIELD.items() for v in pair))
    return F.when(low.contains("icu"), "icu_charges").when(low.contains("ot ") | low.contains("theatre"), "ot_charges").otherwise(F.coalesce(names[category], F.lit("misc_charges")))


def by_charge_field(rows: DataFrame) -> DataFrame:
    """(claim_id, field, amount)."""
    return rows.groupBy("claim_id", charge_field(F.col("category"), F.col("description")).alias("field")).agg(F.sum("amount").alias("amount"))


def itemised(rows: DataFrame) -> DataFrame:
    """Rows edited in the UI replace a claim's extracted rows; summary rows go; with the claim's total."""
    ui = F.max(F.col("is_ui").cast("int")).over(Window.partitionBy("claim_id"))
    kept = rows.withColumn("ui", ui).where((F.col("is_ui").cast("int") == F.col("ui")) & ~is_summary(F.col("description"))).drop("ui")
    return kept.withColumn("expense_total", F.sum("amount").over(Window.partitionBy("claim_id")))


def reconciled(totals: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Totals (claim_id, billed, items, net, gross) with warnings as an array."""
    c = F.col
    warn = lambda when, text: F.when(when, F.lit(text))
    off = (c("billed") > 0) & (F.abs(c("billed") - c("items")) > tolerance * c("billed"))
    found = F.array_compact(F.array(warn(off, "items differ from the billed amount"), warn(c("net").isNull(), "net payable not found"), warn(c("gross").isNull(), "gross total not found")))
    return totals.withColumn("difference", c("billed") - c("items")).withColumn("warnings", found)


def source_stats(rows: DataFrame) -> DataFrame:
    """Per claim and extractor: valid rows, mean confidence, total, pages."""
    ok = is_expense(F.col("description"), F.col("amount"))
    return rows.groupBy("claim_id", "source").agg(F.count_if(ok).alias("valid"), F.avg("confidence").alias("confidence"), F.sum(F.when(ok, F.col("amount")).otherwise(0.0)).alias("total"), F.array_sort(F.collect_set("page")).alias("pages"))


def source_policy(stats: DataFrame) -> DataFrame:
    """Which extractor a claim's rows come from, and the pages only the other has."""
    side = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    wide = stats.groupBy("claim_id").agg(*(side(s, c).alias(f"{s}_{c}") for s in ("semantic", "heuristic") for c in ("valid", "confidence", "total", "pages")))
    c = F.col
    share = F.coalesce(c("semantic_valid"), F.lit(0)) / F.greatest(F.coalesce(c("heuristic_valid"), F.lit(0)), F.lit(1))
    none = F.expr("cast(array() as array<int>)")
    uncovered = F.array_except(F.coalesce("heuristic_pages", none), F.coalesce("semantic_pages", none))
    policy = F.when(F.coalesce("semantic_valid", F.lit(0)) == 0, "heuristic").when((share >= 0.8) & (F.size(uncovered) == 0), "semantic").otherwise("blended")
    return wide.select("claim_id", policy.alias("policy"), uncovered.alias("uncovered"))


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, the same at every run."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def cross_source(rows: DataFrame) -> DataFrame:
    """Drops rows that repeat one from another extractor; repeats within an extractor stay."""
    first = F.first("source").over(Window.partitionBy("claim_id", "page", F.lower(F.trim("description")), "amount").orderBy("seq"))
    return rows.withColumn("first_source", first).where(F.col("source") == F.col("first_source")).drop("first_source")


def continued(rows: DataFrame) -> DataFrame:
    """Rows without an amount go on the description of the last row that has one."""
    w = Window.partitionBy("claim_id", "page").orderBy("seq")
    island = F.sum((F.col("amount").isNotNull()).cast("int")).over(w)
    grouped = rows.withColumn("island", island).groupBy("claim_id", "page", "island")
    return grouped.agg(F.min("seq").alias("seq"), F.max("amount").alias("amount"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda s: s["description"]), " ").alias("description"))


def alike(a: Column, b: Column, least: float) -> Column:
    """Token Jaccard of two descriptions, or one holding the other."""
    s, t = words(a), words(b)
    return (F.size(F.array_intersect(s, t)) >= least * F.size(F.array_union(s, t))) | F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))


def similar_rows(rows: DataFrame, tolerance: float = 1.0, least: float = 0.5) -> DataFrame:
    """(claim_id, seq_a, seq_b) of rows of different extractors with near amounts and like descriptions.

    The band join is on the claim and the amount's bucket of the tolerance's width.
    """
    bucket = F.floor(F.col("amount") / tolerance)
    a = rows.select("claim_id", F.col("seq").alias("seq_a"), F.col("source").alias("sa"), F.col("amount").alias("aa"), F.col("description").alias("da"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    b = rows.select("claim_id", F.col("seq").alias("seq_b"), F.col("source").alias("sb"), F.col("amount").alias("ab"), F.col("description").alias("db"), bucket.alias("b"))
    near = (F.col("sa") < F.col("sb")) & (F.abs(F.col("aa") - F.col("ab")) <= tolerance)
    return a.join(b, ["claim_id", "b"]).where(near).where(alike(F.col("da"), F.col("db"), least)).select("claim_id", "seq_a", "seq_b")


def merged_groups(rows: DataFrame) -> DataFrame:
    """One row per (claim_id, grp): semantic unless amounts differ or it is less sure by more than 0.15."""
    pick = lambda s: F.max_by(F.when(F.col("source") == s, F.struct("description", "amount", "confidence")), F.when(F.col("source") == s, F.struct("confidence", -F.col("seq"))))
    out = rows.groupBy("claim_id", "grp").agg(pick("semantic").alias("s"), pick("heuristic").alias("h"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"))
    use_h = F.col("s").isNull() | (F.col("h").isNotNull() & ((F.abs(F.col("s.amount") - F.col("h.amount")) > 0.01) | (F.col("s.confidence") < F.col("h.confidence") - 0.15)))
    best = F.when(use_h, F.col("h")).otherwise(F.col("s"))
    longest = F.when((F.length("s.description") < 200) & F.col("s").isNotNull(), F.col("s.description")).otherwise(best["description"])
    return out.select("claim_id", "grp", longest.alias("description"), best["amount"].alias("amount"), "confidence", "sources")


def normal(description: Column) -> Column:
    """Lower case, letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def same_charge(a: Column, b: Column, tolerance: float, least: float) -> Column:
    """Whether two rows (description as normal(), amount, category) of different extractors are one charge.

    Amounts that are both known may differ by the tolerance, categories that both say something
    must be the same; descriptions are like by Jaccard, or one holds the other and both have words.
    """
    said = lambda r: F.lower(F.trim(F.coalesce(r["category"], F.lit(""))))
    has = lambda r: (said(r) != "") & (said(r) != "miscellaneous")
    of = lambda r: F.array_distinct(F.filter(F.split(r["norm"], " "), lambda w: w != ""))
    v, w = of(a), of(b)
    both, either = F.size(F.array_intersect(v, w)), F.size(F.array_union(v, w))
    held = a["norm"].contains(b["norm"]) | b["norm"].contains(a["norm"]) | (F.least(F.size(v), F.size(w)) == both)
    many = lambda r: F.size(F.split(r["norm"], " ")) > 1
    like = F.when((a["norm"] == "") | (b["norm"] == ""), a["norm"] == b["norm"]).otherwise((both >= least * either) | (a["norm"] == b["norm"]) | (held & many(a) & many(b)))
    clash = (a["amount"] > 0) & (b["amount"] > 0) & (F.abs(a["amount"] - b["amount"]) > tolerance)
    return like & ~clash & ~(has(a) & has(b) & (said(a) != said(b)))


def grouped(rows: DataFrame, tolerance: float = 1.0, least: float = 0.5) -> DataFrame:
    """A35's groups: adds grp, the seq of the row that leads each row's group.

    Extractor lists are read semantic rows first, by seq; a row joins the first before it, of the
    other list, that says the same charge. Rows of one list never merge, so every semantic row
    leads and a heuristic one joins the first semantic row like it, or leads itself: chains end
    after one step. Known amounts meet by claim and bucket; a row without one meets by claim and word.
    Words are spread only in claims whose other list has a row that could ask for them. Rows are worked
    out once, with norm, the description as normal(), which stays for merged_charges().
    """
    rows = stored(rows.withColumn("norm", normal(F.col("description"))))
    bucket = lambda r: F.floor(r["amount"] / tolerance)
    r = rows.select("claim_id", "source", F.struct("seq", "norm", F.coalesce(F.col("amount"), F.lit(0.0)).alias("amount"), "category").alias("r"))
    # Whether a claim's lists have rows without an amount: known rows show their words to those alone.
    lacks = lambda source: F.max((F.col("source") == source) & (F.col("amount").isNull() | (F.col("amount") <= 0)))
    lacking = rows.groupBy("claim_id").agg(lacks("semantic").alias("no_a"), lacks("heuristic").alias("no_b")).where("no_a OR no_b")
    r = r.join(lacking, "claim_id", "left")
    tokens = F.when(F.col("r.norm") == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.split("r.norm", " ")))
    none, known = F.array().cast("array<string>"), F.col("r.amount") > 0
    keys = lambda near, asked: F.concat(F.when(known, F.transform(near, lambda b: F.concat(F.lit("#"), b.cast("string")))).otherwise(none), F.when(~known | F.coalesce(asked, F.lit(False)), F.transform(tokens, lambda w: F.concat(F.lit("w"), w))).otherwise(none))
    b = bucket(F.col("r"))
    sem = r.where("source = 'semantic'").select("claim_id", F.col("r").alias("a"), F.explode(keys(F.array(b - 1, b, b + 1), F.col("no_b"))).alias("k"))
    heu = r.where("source = 'heuristic'").select("claim_id", F.col("r").alias("b"), F.explode(keys(F.array(b), F.col("no_a"))).alias("k"))
    unknown = (F.col("a.amount") <= 0) | (F.col("b.amount") <= 0)
    met = sem.join(heu, ["claim_id", "k"]).where(F.col("k").startswith("#") | unknown).where(same_charge(F.col("a"), F.col("b"), tolerance, least))
    first = met.groupBy("claim_id", F.col("b.seq").alias("seq")).agg(F.min("a.seq").alias("lead")).withColumn("source", F.lit("heuristic"))
    return rows.join(first, ["claim_id", "seq", "source"], "left").withColumn("grp", F.coalesce("lead", "seq")).drop("lead")


def merged_charges(rows: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """A35 over grouped(): one row per (claim_id, grp), led by a semantic row where there is one.

    The surest row of each list stands for it. Where their amounts differ by more than the
    tolerance, or the heuristic one is surer by over 0.15, that one is chosen. Its description gives
    way to a longer one of the group that holds it and is of no lower quality, and to a semantic one
    under 200 characters.
    """
    rank = F.when(F.col("source") == "semantic", 3).when(F.lower("heuristic_source") == "table", 2).when(F.lower("heuristic_source") == "summary", 0).otherwise(1)
    norm = F.col("norm") if "norm" in rows.columns else normal(F.col("description"))
    row = F.struct(F.when(F.col("source") == "semantic", 0).otherwise(1).alias("list"), "seq", "description", norm.alias("norm"), F.coalesce(F.col("amount"), F.lit(0.0)).alias("amount"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), rank.alias("rank"))
    if "heuristic_source" not in rows.columns:
        rows = rows.withColumn("heuristic_source", F.lit(None).cast("string"))
    pick = lambda s: F.max_by(F.when(F.col("source") == s, row), F.when(F.col("source") == s, F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("seq"))))
    out = rows.groupBy("claim_id", "grp").agg(pick("semantic").alias("s"), pick("heuristic").alias("h"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_list(row)).alias("all"))
    use_h = F.col("s").isNull() | (F.col("h").isNotNull() & ((F.abs(F.col("s.amount") - F.col("h.amount")) > tolerance) | (F.col("s.confidence") < F.col("h.confidence") - 0.15)))
    out = out.withColumn("best", F.when(use_h, F.col("h")).otherwise(F.col("s")))

    def longer(told: Column, g: Column) -> Column:
        words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
        holds = g["norm"].contains(told["norm"]) | (F.size(F.array_except(words(told["norm"]), words(g["norm"]))) == 0)
        return F.when((F.length(g["norm"]) > F.length(told["norm"])) & (g["rank"] >= told["rank"]) & holds, F.struct(g["description"].alias("description"), g["norm"].alias("norm"), told["rank"].alias("rank"))).otherwise(told)

    start = F.struct(F.coalesce("best.description", F.lit("")).alias("description"), F.col("best.norm").alias("norm"), F.col("best.rank").alias("rank"))
    longest = F.aggregate("all", start, longer, lambda t: t["description"])
    short = F.coalesce(F.length("s.description") < 200, F.lit(False))
    return out.select("claim_id", "grp", F.when(short, F.col("s.description")).otherwise(longest).alias("description"), F.col("best.amount").alias("amount"), "confidence", "sources", F.size("all").alias("n"))


def split_losers(rows: DataFrame) -> DataFrame:
    """(claim_id, seq) of rows that repeat another of the same page and amount less well.

    Loses the row of lower rank, or the shorter; pairs are compared at once, so a loser may
    also have made another lose.
    """
    a = rows.select("claim_id", "page", "amount", F.col("seq").alias("seq_a"), F.col("description").alias("da"), F.col("rank").alias("ra"))
    b = rows.select("claim_id", "page", "amount", F.col("seq").alias("seq_b"), F.col("description").alias("db"), F.col("rank").alias("rb"))
    shared = F.size(F.array_intersect(words(F.col("da")), words(F.col("db"))))
    same = F.lower("da").contains(F.lower("db")) | F.lower("db").contains(F.lower("da")) | ((shared >= 2) & (shared >= 0.40 * F.size(F.array_union(words(F.col("da")), words(F.col("db"))))))
    pairs = a.join(b, ["claim_id", "page", "amount"]).where((F.col("seq_a") < F.col("seq_b")) & (F.col("amount") != 0)).where(same)
    a_wins = (F.col("ra") > F.col("rb")) | ((F.col("ra") == F.col("rb")) & (F.length("da") >= F.length("db")))
    return pairs.select("claim_id", F.when(a_wins, F.col("seq_b")).otherwise(F.col("seq_a")).alias("seq")).distinct()
