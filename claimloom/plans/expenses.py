"""Expense queries: a line item is a row; its part's name is the description."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions.scalars import rounded
from claimloom.operators import expenses
from claimloom.plans.papers import pick
from claimloom.plans.registry import query, raw, role

R = """r AS (SELECT e.claim_id, e.seq, e.code, e.category, c.description, e.amount, e.quantity, e.line_status, (e.quantity % 3)::INT AS page, CASE WHEN e.line_status = 'O' THEN 'semantic' ELSE 'heuristic' END AS source, e.quantity / 50 AS confidence FROM expenses e JOIN catalogue c USING (code))"""


def rows(spark, d):
    lines = role(spark, d, "expenses").join(role(spark, d, "catalogue").select("code", "description"), "code")
    return lines.select("claim_id", "seq", "code", "category", "description", "amount", "quantity", "line_status", (F.col("quantity") % 3).cast("int").alias("page"), F.when(F.col("line_status") == "O", "semantic").otherwise("heuristic").alias("source"), (F.col("quantity") / 50).alias("confidence"))


@query("a9_by_charge_field", f"""WITH {R} SELECT claim_id, CASE WHEN contains(lower(description), 'icu') THEN 'icu_charges' WHEN contains(lower(description), 'ot ') OR contains(lower(description), 'theatre') THEN 'ot_charges'
    WHEN category = 'Pharmacy' THEN 'pharmacy_charges' WHEN category = 'Room Rent' THEN 'room_charges' ELSE 'surgery_charges' END AS field, round(sum(amount), 2) AS amount FROM r GROUP BY 1, 2""", "expenses catalogue")  # fmt: skip
def a9(spark, d):
    return expenses.by_charge_field(rows(spark, d)).select("claim_id", "field", rounded(F.col("amount"), 2).alias("amount"))


@query("a10_a12_totals", """SELECT c.claim_id, round(CASE WHEN c.total_amount > 1000 THEN c.total_amount ELSE coalesce(e.items, 0) END, 2) AS total, round(coalesce(e.icd, 0), 2) AS icd, round(coalesce(e.cpt, 0), 2) AS cpt FROM claims c
    LEFT JOIN (SELECT claim_id, sum(amount) AS items, sum(CASE WHEN category = 'Pharmacy' THEN amount END) AS icd, sum(CASE WHEN category <> 'Pharmacy' THEN amount END) AS cpt FROM expenses GROUP BY 1) e USING (claim_id)""", "claims expenses")  # fmt: skip
def a10(spark, d):
    kind = F.col("category") == "Pharmacy"
    sums = role(spark, d, "expenses").groupBy("claim_id").agg(F.sum("amount").alias("items"), F.sum(F.when(kind, F.col("amount"))).alias("icd"), F.sum(F.when(~kind, F.col("amount"))).alias("cpt"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    return role(spark, d, "claims").join(sums, "claim_id", "left").select("claim_id", F.round(F.when(F.col("total_amount") > 1000, F.col("total_amount")).otherwise(F.coalesce("items", F.lit(0.0))), 2).alias("total"), zero(F.col("icd")).alias("icd"), zero(F.col("cpt")).alias("cpt"))


@query("a11_itemised", f"""WITH {R}, k AS (SELECT *, line_status = 'O' AS is_ui FROM r), m AS (SELECT *, bool_or(is_ui) OVER (PARTITION BY claim_id) AS ui FROM k)
    SELECT claim_id, seq, code, round(amount, 2) AS amount, round(sum(amount) OVER (PARTITION BY claim_id), 2) AS expense_total FROM m WHERE is_ui = ui""", "expenses catalogue")  # fmt: skip
def a11(spark, d):
    return expenses.itemised(rows(spark, d).withColumn("is_ui", F.col("line_status") == "O")).select("claim_id", "seq", "code", rounded(F.col("amount"), 2).alias("amount"), rounded(F.col("expense_total"), 2).alias("expense_total"))


@query("a13_reconciled", """SELECT c.claim_id, round(c.total_amount - e.items, 2) AS difference, (abs(c.total_amount - e.items) > 0.01 * c.total_amount)::INT + (c.policy_id % 2 = 0)::INT AS warnings FROM claims c JOIN (SELECT claim_id, sum(amount) AS items FROM expenses GROUP BY 1) e USING (claim_id)""", "claims expenses")
def a13(spark, d):
    items = role(spark, d, "expenses").groupBy("claim_id").agg(F.sum("amount").alias("items"))
    totals = role(spark, d, "claims").join(items, "claim_id").select("claim_id", F.col("total_amount").alias("billed"), "items", F.when(F.col("policy_id") % 2 != 0, 1.0).alias("net"), F.lit(1.0).alias("gross"))
    return expenses.reconciled(totals).select("claim_id", rounded(F.col("difference"), 2).alias("difference"), F.size("warnings").alias("warnings"))


@query("a30_a31_source_policy", f"""WITH {R}, s AS (SELECT claim_id, count(*) FILTER (source = 'semantic') AS sv, count(*) FILTER (source = 'heuristic') AS hv, list(DISTINCT page) FILTER (source = 'semantic') AS sp, list(DISTINCT page) FILTER (source = 'heuristic') AS hp FROM r GROUP BY 1),
    u AS (SELECT *, len(list_filter(coalesce(hp, []), lambda x: NOT list_contains(coalesce(sp, []), x))) AS un FROM s)
    SELECT claim_id, CASE WHEN sv = 0 THEN 'heuristic' WHEN sv / greatest(hv, 1) >= 0.8 AND un = 0 THEN 'semantic' ELSE 'blended' END AS policy, un::INT AS uncovered FROM u""", "expenses catalogue")  # fmt: skip
def a30(spark, d):
    return expenses.source_policy(expenses.source_stats(rows(spark, d))).select("claim_id", "policy", F.size("uncovered").alias("uncovered"))


@query("a35_merged_groups", f"""WITH {R}, b AS (SELECT claim_id, page, max((confidence, -seq, -code, amount, description)) FILTER (source = 'semantic') AS s, max((confidence, -seq, -code, amount, description)) FILTER (source = 'heuristic') AS h, max(confidence) AS confidence FROM r GROUP BY 1, 2)
    SELECT claim_id, page AS grp, round(CASE WHEN s IS NULL OR (h IS NOT NULL AND (abs(s[4] - h[4]) > 0.01 OR s[1] < h[1] - 0.15)) THEN h[4] ELSE s[4] END, 2) AS amount, confidence, (s IS NOT NULL)::INT + (h IS NOT NULL)::INT AS sources FROM b""", "expenses catalogue")  # fmt: skip
def a35(spark, d):
    keyed = rows(spark, d).withColumn("grp", F.col("page")).withColumn("seq", F.col("seq") * 1_000_000 + F.col("code"))
    return expenses.merged_groups(keyed).select("claim_id", "grp", rounded(F.col("amount"), 2).alias("amount"), "confidence", F.size("sources").alias("sources"))


#: Rows as two extractors read them: a tenth without an amount, a ninth of no telling category.
READ = f"""{R}, k AS (SELECT claim_id, seq * 1000000 + code AS seq, source, description, CASE WHEN quantity % 10 = 0 THEN 0 ELSE amount END AS amount, CASE WHEN quantity % 9 = 0 THEN 'Miscellaneous' ELSE category END AS category, confidence,
        lower(description) AS norm, list_distinct(string_split(lower(description), ' ')) AS w FROM r)"""


def read_rows(spark, d):
    r = rows(spark, d).withColumn("seq", F.col("seq") * 1_000_000 + F.col("code"))
    return r.withColumn("amount", F.when(F.col("quantity") % 10 == 0, 0.0).otherwise(F.col("amount"))).withColumn("category", F.when(F.col("quantity") % 9 == 0, "Miscellaneous").otherwise(F.col("category"))).drop("code", "quantity", "line_status", "page")


@query("a35_grouped_charges", f"""WITH {READ},
    p AS (SELECT b.claim_id, b.seq, min(a.seq) AS lead FROM k a JOIN k b ON a.claim_id = b.claim_id AND a.source = 'semantic' AND b.source = 'heuristic'
        WHERE (a.amount = 0 OR b.amount = 0 OR abs(a.amount - b.amount) <= 5000) AND (a.category = b.category OR a.category = 'Miscellaneous' OR b.category = 'Miscellaneous')
        AND (len(list_intersect(a.w, b.w)) >= 0.3 * len(list_distinct(list_concat(a.w, b.w))) OR a.norm = b.norm OR (len(a.w) > 1 AND len(b.w) > 1 AND (contains(a.norm, b.norm) OR contains(b.norm, a.norm) OR len(list_intersect(a.w, b.w)) = least(len(a.w), len(b.w))))) GROUP BY 1, 2),
    g AS (SELECT k.*, coalesce(p.lead, k.seq) AS grp FROM k LEFT JOIN p ON p.claim_id = k.claim_id AND p.seq = k.seq AND k.source = 'heuristic'),
    m AS (SELECT claim_id, grp, max((confidence, -seq, amount, description)) FILTER (source = 'semantic') AS s, max((confidence, -seq, amount, description)) FILTER (source = 'heuristic') AS h, max(confidence) AS confidence, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT claim_id, grp, coalesce(s[4], h[4]) AS description, round(CASE WHEN s IS NULL OR (h IS NOT NULL AND (abs(s[3] - h[3]) > 5000 OR s[1] < h[1] - 0.15)) THEN h[3] ELSE s[3] END, 2) AS amount, confidence, n::INT AS n FROM m""", "expenses catalogue")  # fmt: skip
def a35_grouped(spark, d):
    found = expenses.merged_charges(expenses.grouped(read_rows(spark, d), 5000.0, 0.3), 5000.0)
    return found.select("claim_id", "grp", "description", rounded(F.col("amount"), 2).alias("amount"), "confidence", "n")


@query("p8_p10_expense_rows", f"""WITH {R} SELECT claim_id, seq, code FROM r WHERE length(trim(description)) BETWEEN 3 AND 300 AND regexp_matches(description, '[A-Za-z]') AND amount > 0 AND NOT regexp_matches(description, '^[^0-9]*\\b[0-9]{{6}}\\b[^0-9]*$')""", "expenses catalogue")
def p8(spark, d):
    return rows(spark, d).where(expenses.is_expense(F.col("description"), F.col("amount"))).select("claim_id", "seq", "code")


SAID = pick(8, "'Grand TOTAL due'", "'Bed charges'", "'Bill'", "'Claimed amount'", "'Discount given'", "'Sum insured'", "'Net payable'", "text")
KIND = pick(3, "'Room'", "'amount due'", "'Amount'")


@query("p9_summary_rows", f"SELECT doc_id FROM documents WHERE doc_id % 8 IN (0, 3, 5) OR doc_id % 3 = 1 OR doc_id % 8 = 7 AND contains(lower(text), 'total') OR doc_id % 8 = 2 AND doc_id % 3 = 2")
def p9(spark, d):
    rows = raw(spark, d, "documents").selectExpr("doc_id", f"{SAID} AS description", f"{KIND} AS category")
    return rows.where(expenses.is_summary(F.col("description"), F.col("category"))).select("doc_id")


@query("w8_first_per_key", f"WITH {R} SELECT claim_id, category, seq, code FROM r QUALIFY row_number() OVER (PARTITION BY claim_id, category ORDER BY seq, code) = 1", "expenses catalogue")
def w8(spark, d):
    return expenses.first_per_key(rows(spark, d).select("claim_id", "category", "seq", "code"), ["claim_id", "category"], ["seq", "code"])


@query("w9_cross_source", f"""WITH {R}, k AS (SELECT claim_id, page, seq * 1000000 + code AS seq, source, category AS description, floor(amount / 20000) AS amount FROM r)
    SELECT claim_id, seq, source FROM k QUALIFY source = first_value(source) OVER (PARTITION BY claim_id, page, lower(trim(description)), amount ORDER BY seq)""", "expenses catalogue")  # fmt: skip
def w9(spark, d):
    r = rows(spark, d).select("claim_id", "page", (F.col("seq") * 1_000_000 + F.col("code")).alias("seq"), "source", F.col("category").alias("description"), F.floor(F.col("amount") / 20000).alias("amount"))
    return expenses.cross_source(r).select("claim_id", "seq", "source")


@query("w13_continued_rows", f"""WITH {R}, k AS (SELECT claim_id, page, seq * 1000000 + code AS seq, CASE WHEN quantity > 20 THEN round(amount, 2) END AS amount, category AS description FROM r),
    i AS (SELECT *, count(amount) OVER (PARTITION BY claim_id, page ORDER BY seq) AS island FROM k)
    SELECT claim_id, page, min(seq) AS seq, max(amount) AS amount, string_agg(description, ' ' ORDER BY seq, description) AS description FROM i GROUP BY claim_id, page, island""", "expenses catalogue")  # fmt: skip
def w13(spark, d):
    r = rows(spark, d).select("claim_id", "page", (F.col("seq") * 1_000_000 + F.col("code")).alias("seq"), F.when(F.col("quantity") > 20, rounded(F.col("amount"), 2)).alias("amount"), F.col("category").alias("description"))
    return expenses.continued(r).select("claim_id", "page", "seq", "amount", "description")


SIM = "(len(list_intersect(wa, wb)) >= {least} * len(list_distinct(list_concat(wa, wb))) OR contains(lower(da), lower(db)) OR contains(lower(db), lower(da)))"


@query("j18_similar_rows", f"""WITH {R}, k AS (SELECT claim_id, seq * 1000000 + code AS seq, source, amount, description, list_distinct(list_filter(regexp_extract_all(lower(description), '[a-z0-9]+'), lambda x: length(x) > 1)) AS w FROM r),
    p AS (SELECT a.claim_id, a.seq AS seq_a, b.seq AS seq_b, a.w AS wa, b.w AS wb, a.description AS da, b.description AS db FROM k a JOIN k b ON a.claim_id = b.claim_id AND a.source < b.source AND abs(a.amount - b.amount) <= 5000)
    SELECT claim_id, seq_a, seq_b FROM p WHERE {SIM.format(least=0.3)}""", "expenses catalogue")  # fmt: skip
def j18(spark, d):
    return expenses.similar_rows(rows(spark, d).withColumn("seq", F.col("seq") * 1_000_000 + F.col("code")), 5000.0, 0.3)


@query("j20_split_rows", f"""WITH {R}, k AS (SELECT claim_id, page, floor(amount / 5000) AS amount, seq * 1000000 + code AS seq, description, (quantity % 2)::INT AS rank, list_distinct(list_filter(regexp_extract_all(lower(description), '[a-z0-9]+'), lambda x: length(x) > 1)) AS w FROM r),
    p AS (SELECT a.claim_id, a.seq AS sa, b.seq AS sb, a.description AS da, b.description AS db, a.rank AS ra, b.rank AS rb, len(list_intersect(a.w, b.w)) AS n, len(list_distinct(list_concat(a.w, b.w))) AS u FROM k a JOIN k b USING (claim_id, page, amount) WHERE a.seq < b.seq AND amount <> 0)
    SELECT DISTINCT claim_id, CASE WHEN ra > rb OR (ra = rb AND length(da) >= length(db)) THEN sb ELSE sa END AS seq FROM p WHERE contains(lower(da), lower(db)) OR contains(lower(db), lower(da)) OR (n >= 2 AND n >= 0.4 * u)""", "expenses catalogue")  # fmt: skip
def j20(spark, d):
    r = rows(spark, d).select("claim_id", "page", F.floor(F.col("amount") / 5000).alias("amount"), (F.col("seq") * 1_000_000 + F.col("code")).alias("seq"), "description", (F.col("quantity") % 2).cast("int").alias("rank"))
    return expenses.split_losers(r)


@query("u5_source_union", f"WITH {R} SELECT source, count(*) AS n, round(sum(amount), 0) AS total FROM r GROUP BY source", "expenses catalogue")
def u5(spark, d):
    r = rows(spark, d)
    semantic = r.where("source = 'semantic'").select("claim_id", "amount", "source")
    heuristic = r.where("source = 'heuristic'").select("claim_id", "amount", "source", "page")
    return semantic.unionByName(heuristic, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 0).alias("total"))
