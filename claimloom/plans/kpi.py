"""Operational figures, filters, rankings."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.operators import metrics
from claimloom.plans.registry import query, role
from claimloom.sources.storage import stored

BUCKETS = {"approved": ("COMPLETED",), "processing": ("PROCESSING",), "pending": ("MANUAL_REVIEW_REQUIRED",)}


def latest(df, key: str, time: str, tie: str):
    """The newest row of each key, null times last, larger ids first; no sort of whole groups."""
    order = F.struct(F.col(time).isNotNull(), time, tie)
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def top_n(df, key, order: list, n: int):
    """The first n rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def status_bucket(status):
    """P2."""
    out = F.lit("rejected")
    for name, values in BUCKETS.items():
        out = F.when(status.isin(*values), name).otherwise(out)
    return out


def status_priority(status):
    """P3."""
    return F.when(status == "MANUAL_REVIEW_REQUIRED", "high").when(status == "PROCESSING", "medium").otherwise("low")


BUCKET_SQL = "CASE WHEN status = 'COMPLETED' THEN 'approved' WHEN status = 'PROCESSING' THEN 'processing' WHEN status = 'MANUAL_REVIEW_REQUIRED' THEN 'pending' ELSE 'rejected' END"


@query("a4_count_by_status", "SELECT status, count(*) AS n FROM claims GROUP BY status", "claims")
def a4(spark, d):
    return role(spark, d, "claims").groupBy("status").agg(F.count("*").alias("n"))


@query("a5_count_by_month", "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM claims GROUP BY 1 ORDER BY 1", "claims")
def a5(spark, d):
    return role(spark, d, "claims").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).orderBy("month")


@query("a4_a5_rollup_status_month", "SELECT status, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM claims GROUP BY ROLLUP (1, 2)", "claims")
def rollup(spark, d):
    return role(spark, d, "claims").rollup("status", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("a6_average_per_day", "SELECT round(count(*) / greatest(1, (epoch(max(created_at)) - epoch(min(created_at))) / 86400), 1) AS per_day FROM claims", "claims")
def a6(spark, d):
    days = (F.max("created_at").cast("long") - F.min("created_at").cast("long")) / 86400
    return role(spark, d, "claims").agg(F.round(F.count("*") / F.greatest(F.lit(1.0), days), 1).alias("per_day"))


@query("a7_success_rate", "SELECT round(avg(CASE WHEN status = 'COMPLETED' THEN 1.0 ELSE 0 END) * 100, 4) AS success, round(avg(CASE WHEN status = 'MANUAL_REVIEW_REQUIRED' THEN 1.0 ELSE 0 END) * 100, 4) AS failure FROM claims", "claims")
def a7(spark, d):
    share = lambda s: F.round(F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0)) * 100, 4)
    return role(spark, d, "claims").agg(share("COMPLETED").alias("success"), share("MANUAL_REVIEW_REQUIRED").alias("failure"))


@query("a8_o1_page", "SELECT claim_id, created_at, (SELECT count(*) FROM claims) AS total FROM claims ORDER BY created_at DESC, claim_id LIMIT 20 OFFSET 40", "claims")
def a8(spark, d):
    claims = role(spark, d, "claims")
    page = claims.select("claim_id", "created_at").orderBy(F.desc("created_at"), "claim_id").offset(40).limit(20)
    return page.withColumn("total", claims.agg(F.count("*").alias("n")).scalar())


@query("a14_distinct_codes", "SELECT claim_id, count(DISTINCT CASE WHEN category = 'Pharmacy' THEN code END) AS codes FROM expenses GROUP BY claim_id", "expenses")
def a14(spark, d):
    return role(spark, d, "expenses").groupBy("claim_id").agg(F.countDistinct(F.when(F.col("category") == "Pharmacy", F.col("code"))).alias("codes"))


@query("a15_distinct_texts", "SELECT role, count(DISTINCT lower(trim(text))) AS n FROM conversations GROUP BY role")
def a15(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").groupBy("role").agg(F.countDistinct(F.lower(F.trim("text"))).alias("n"))


@query("a25_suggestions", """SELECT DISTINCT attribute, value FROM (
    SELECT 'status' AS attribute, status AS value FROM claims UNION ALL SELECT 'channel', channel FROM claims UNION ALL SELECT 'policy', policy_id::VARCHAR FROM claims) WHERE value IS NOT NULL AND value <> 'N/A'""", "claims")  # fmt: skip
def a25(spark, d):
    rows = role(spark, d, "claims").select("status", "channel", F.col("policy_id").cast("string").alias("policy"))
    return rows.unpivot([], ["status", "channel", "policy"], "attribute", "value").where("value IS NOT NULL AND value <> 'N/A'").distinct()


@query("a32_processing_seconds", "SELECT user_id, epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT AS seconds FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM activity) GROUP BY user_id", "activity")
def a32(spark, d):
    sec = F.col("ts").cast("long")
    return role(spark, d, "activity").groupBy("user_id").agg((F.max(sec) - F.min(sec)).alias("seconds"))


@query("a33_request_metrics", """SELECT event_type, count(*) AS n, count(*) FILTER (value < 25) AS le_25, count(*) FILTER (value >= 25 AND value < 50) AS le_50, count(*) FILTER (value >= 50 AND value < 100) AS le_100, count(*) FILTER (value >= 100) AS more FROM activity GROUP BY 1""", "activity")
def a33(spark, d):
    v = F.col("value")
    return role(spark, d, "activity").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v < 25).alias("le_25"), F.count_if((v >= 25) & (v < 50)).alias("le_50"), F.count_if((v >= 50) & (v < 100)).alias("le_100"), F.count_if(v >= 100).alias("more"))


RANKS = (0.5, 0.9, 0.99)


def monthly_quantiles(rows, ranks=RANKS):
    """Daily sketches, stored, and merged to months."""
    daily = stored(metrics.daily_sketches(rows, ["event_type"], "ts", "value"))
    monthly = metrics.rolled_up(daily, ["event_type", F.date_format("day", "yyyy-MM").alias("month")])
    return metrics.quantiles(monthly, ["event_type", "month"], ranks)


@query("a33_latency_quantiles")
def a33_quantiles(spark, d):
    found = monthly_quantiles(role(spark, d, "activity"))
    return found.select("event_type", "month", "n", "least", *(F.col("at")[i].alias(f"p{p * 100:.0f}") for i, p in enumerate(RANKS)), "most")


@query("a33_quantile_ranks", """SELECT event_type, strftime(ts, '%Y-%m') AS month, p, count(*) AS n, TRUE AS near
    FROM activity, (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS p) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL""", "activity")  # fmt: skip
def a33_ranks(spark, d):
    rows = role(spark, d, "activity")
    found = stored(monthly_quantiles(rows))
    rows = rows.withColumn("month", F.date_format("ts", "yyyy-MM"))
    ranks = metrics.exact_ranks(rows, found, ["event_type", "month"], "value", RANKS)
    return ranks.select("event_type", "month", "p", "n", metrics.near().alias("near"))


@query("a25_prefix_suggestions", """WITH told AS (
        SELECT 'patient' AS attribute, patient_name AS value FROM claims JOIN patients USING (patient_id)
        UNION ALL SELECT 'policy', policy_id::VARCHAR FROM claims
        UNION ALL SELECT 'channel', channel FROM claims
        UNION ALL SELECT 'hospital', provider_name FROM expenses JOIN providers USING (provider_id)
        UNION ALL SELECT 'diagnosis', description FROM expenses JOIN catalogue USING (code)
        UNION ALL SELECT 'brand', brand FROM expenses JOIN catalogue USING (code)),
    counted AS (SELECT attribute, value, count(*) AS n FROM told WHERE value IS NOT NULL AND value NOT IN ('', 'N/A') GROUP BY ALL),
    prefixes AS (SELECT attribute, value, n, k, lower(left(value, k::INT)) AS prefix FROM counted, range(0, 5) AS r(k) WHERE length(value) >= k)
    SELECT attribute, prefix, row_number() OVER w AS rank, value, n FROM prefixes
    WINDOW w AS (PARTITION BY attribute, k, prefix ORDER BY n DESC, value) QUALIFY rank <= 10""", "claims patients providers catalogue expenses")  # fmt: skip
def a25_prefixes(spark, d):
    claims, expenses = role(spark, d, "claims"), role(spark, d, "expenses")
    # Counted by id before names are looked up, so that joins meet one row for each id.
    count = lambda rows, key: rows.groupBy(key).agg(F.count("*").alias("n"))
    told = lambda rows, value, attribute: rows.select(F.lit(attribute).alias("attribute"), F.col(value).cast("string").alias("value"), "n")
    codes = stored(count(expenses, "code").join(role(spark, d, "catalogue"), "code").select("description", "brand", "n"))
    counts = [
        told(count(claims, "patient_id").join(role(spark, d, "patients"), "patient_id"), "patient_name", "patient"),
        told(count(claims, "policy_id"), "policy_id", "policy"),
        told(count(claims, "channel"), "channel", "channel"),
        told(count(expenses, "provider_id").join(role(spark, d, "providers"), "provider_id"), "provider_name", "hospital"),
        told(codes, "description", "diagnosis"),
        told(codes, "brand", "brand"),
    ]
    return metrics.prefix_suggestions(functools.reduce(lambda a, b: a.unionByName(b), counts), most=10, length=4)


@query("a34_activity_counts", "SELECT user_id, event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM activity GROUP BY 1, 2", "activity")
def a34(spark, d):
    return role(spark, d, "activity").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("p1_by_claim_ids", "SELECT claim_id, seq, code FROM expenses WHERE claim_id IN (SELECT claim_id FROM claims WHERE status = 'MANUAL_REVIEW_REQUIRED')", "claims expenses")
def p1(spark, d):
    chosen = role(spark, d, "claims").where("status = 'MANUAL_REVIEW_REQUIRED'").select("claim_id")
    return role(spark, d, "expenses").select("claim_id", "seq", "code").join(chosen, "claim_id", "left_semi")


@query("p2_p3_status_buckets", f"SELECT {BUCKET_SQL} AS bucket, CASE WHEN status = 'MANUAL_REVIEW_REQUIRED' THEN 'high' WHEN status = 'PROCESSING' THEN 'medium' ELSE 'low' END AS priority, count(*) AS n FROM claims GROUP BY 1, 2", "claims")
def p2(spark, d):
    return role(spark, d, "claims").groupBy(status_bucket(F.col("status")).alias("bucket"), status_priority(F.col("status")).alias("priority")).agg(F.count("*").alias("n"))


@query("p4_review_queue", "SELECT c.claim_id, c.status, c.created_at, p.patient_name FROM claims c LEFT JOIN patients p USING (patient_id) WHERE c.status IN ('MANUAL_REVIEW_REQUIRED', 'VALIDATION_FAILED', 'WORKFLOW_FAILED', 'VALIDATED')", "claims patients")
def p4(spark, d):
    waiting = role(spark, d, "claims").where(F.col("status").isin("MANUAL_REVIEW_REQUIRED", "VALIDATION_FAILED", "WORKFLOW_FAILED", "VALIDATED"))
    return waiting.join(role(spark, d, "patients"), "patient_id", "left").select("claim_id", "status", "created_at", "patient_name")


@query("p5_substring", "SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under')")
def p5(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where(F.lower("text").contains("licensed under")).select("doc_id")


@query("p6_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM activity WHERE json_extract_string(props, '$.k') = '7'", "activity")
def p6(spark, d):
    return role(spark, d, "activity").select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k = '7'")


@query("p7_excluded_documents", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT event_id FROM activity WHERE try_cast(json_extract_string(props, '$.k') AS INT) < 50)", "activity")
def p7(spark, d):
    gone = role(spark, d, "activity").where(F.get_json_object("props", "$.k").try_cast("int") < 50).select(F.col("event_id").alias("doc_id"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source").join(gone, "doc_id", "left_anti")


@query("p14_active_directory", "SELECT provider_id, provider_name FROM providers WHERE balance > 0 ORDER BY provider_name", "providers")
def p14(spark, d):
    return role(spark, d, "providers").where("balance > 0").select("provider_id", "provider_name").orderBy("provider_name")


@query("w1_latest_per_claim", "SELECT patient_id, claim_id, status, created_at FROM claims QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC NULLS LAST, claim_id DESC) = 1", "claims")
def w1(spark, d):
    return latest(role(spark, d, "claims").select("patient_id", "claim_id", "status", "created_at"), "patient_id", "created_at", "claim_id")


@query("w2_last_three", "SELECT patient_id, claim_id, row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, claim_id DESC) AS rank FROM claims QUALIFY rank <= 3", "claims")
def w2(spark, d):
    return top_n(role(spark, d, "claims").select("patient_id", "claim_id", "created_at"), "patient_id", [F.desc("created_at"), F.desc("claim_id")], 3).select("patient_id", "claim_id", F.col("rank").cast("long").alias("rank"))


@query("w2_chat_history", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w2_chat(spark, d):
    return top_n(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role"), "conv_id", [F.desc("turn")], 3).drop("rank")


@query("w4_code_order", "SELECT claim_id, code, row_number() OVER (PARTITION BY claim_id ORDER BY (category = 'Pharmacy') DESC, quantity DESC, seq, code) AS rank FROM expenses QUALIFY rank <= 3", "expenses")
def w4(spark, d):
    rows = top_n(role(spark, d, "expenses").select("claim_id", "code", "category", "quantity", "seq"), "claim_id", [F.desc(F.col("category") == "Pharmacy"), F.desc("quantity"), "seq", "code"], 3)
    return rows.select("claim_id", "code", F.col("rank").cast("long").alias("rank"))


@query("w10_monotonic_progress", "SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM activity", "activity")
def w10(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return role(spark, d, "activity").select("event_id", "user_id", F.max("value").over(w).alias("progress"))


@query("o2_top_scores", "SELECT claim_id, total_amount FROM claims ORDER BY total_amount DESC, claim_id LIMIT 25", "claims")
def o2(spark, d):
    return role(spark, d, "claims").select("claim_id", "total_amount").orderBy(F.desc("total_amount"), "claim_id").limit(25)


@query("o3_top_reasons", "SELECT claim_id, seq, round(amount, 2) AS amount FROM expenses QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY amount DESC, seq, code) <= 5", "expenses")
def o3(spark, d):
    return top_n(role(spark, d, "expenses").select("claim_id", "seq", "amount", "code"), "claim_id", [F.desc("amount"), "seq", "code"], 5).select("claim_id", "seq", F.round("amount", 2).alias("amount"))


@query("o6_ranked_findings", "SELECT user_id, event_id FROM activity QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, value DESC, event_id) <= 12", "activity")
def o6(spark, d):
    severity = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return top_n(role(spark, d, "activity"), "user_id", [severity, F.desc("value"), "event_id"], 12).select("user_id", "event_id")


@query("u1_hit_union", "SELECT claim_id FROM claims WHERE status = 'COMPLETED' UNION SELECT claim_id FROM expenses WHERE quantity >= 49 UNION SELECT claim_id FROM claims WHERE total_amount > 400000", "claims expenses")
def u1(spark, d):
    claims = role(spark, d, "claims")
    found = claims.where("status = 'COMPLETED'").select("claim_id").unionByName(role(spark, d, "expenses").where("quantity >= 49").select("claim_id")).unionByName(claims.where("total_amount > 400000").select("claim_id"))
    return found.distinct()


@query("j1_claim_children", "SELECT c.claim_id, coalesce(e.n, 0) AS n_lines, coalesce(e.codes, 0) AS n_codes FROM claims c LEFT JOIN (SELECT claim_id, count(*) AS n, count(DISTINCT code) AS codes FROM expenses GROUP BY 1) e USING (claim_id)", "claims expenses")
def j1(spark, d):
    lines = role(spark, d, "expenses").groupBy("claim_id").agg(F.count("*").alias("n_lines"), F.countDistinct("code").alias("n_codes"))
    return role(spark, d, "claims").select("claim_id").join(lines, "claim_id", "left").fillna(0, ["n_lines", "n_codes"])


@query("j3_latest_upload", "SELECT a.user_id, c.claim_id, c.created_at FROM (SELECT DISTINCT user_id FROM activity) a JOIN claims c ON c.patient_id = a.user_id WHERE c.status <> 'PROCESSING' QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY c.created_at DESC, c.claim_id DESC) = 1", "activity claims")
def j3(spark, d):
    users = role(spark, d, "activity").select("user_id").distinct()
    rows = role(spark, d, "claims").where("status <> 'PROCESSING'").select(F.col("patient_id").alias("user_id"), "claim_id", "created_at").join(users, "user_id", "left_semi")
    return latest(rows, "user_id", "created_at", "claim_id")


@query("j4_latest_job", "SELECT e.claim_id, e.seq, c.status, (SELECT max(service_date) FROM expenses x WHERE x.claim_id = e.claim_id) AS last_date FROM expenses e JOIN claims c USING (claim_id) WHERE e.quantity > 45", "claims expenses")
def j4(spark, d):
    lines = role(spark, d, "expenses")
    last = lines.groupBy("claim_id").agg(F.max("service_date").alias("last_date"))
    return lines.where("quantity > 45").select("claim_id", "seq").join(role(spark, d, "claims").select("claim_id", "status"), "claim_id").join(last, "claim_id", "left")


@query("j10_type_default", "SELECT e.event_id, coalesce(l.kind, 'UNKNOWN') AS doc_type FROM activity e LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'POOR' END AS kind FROM labels) l ON l.doc_id = e.event_id", "activity")
def j10(spark, d):
    kinds = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("event_id"), F.when(F.col("quality") == 1, "GOOD").otherwise("POOR").alias("kind"))
    return role(spark, d, "activity").select("event_id").join(kinds, "event_id", "left").select("event_id", F.coalesce("kind", F.lit("UNKNOWN")).alias("doc_type"))


@query("j19_known_hashes", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def j19(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.join(docs.where("doc_id % 3 = 0").select("content_hash"), "content_hash", "left_anti").select("doc_id")
