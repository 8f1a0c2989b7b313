"""Lifecycle and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimloom.operators import lifecycle
from claimloom.plans.registry import query, raw, role
from claimloom.streaming import lifecycle as streams


def actions(spark, d):
    e = role(spark, d, "activity")
    kind = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "click", "reject").when(F.col("event_type") == "view", "send_back").otherwise("unknown")
    return e.select(F.col("user_id").alias("claim_id"), kind.alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query("t5_transitions", """WITH a AS (SELECT user_id AS claim_id, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'click' THEN 'REJECTED' WHEN 'view' THEN 'MANUAL_REVIEW_REQUIRED' END AS new_status FROM activity)
    SELECT claim_id, seq, coalesce(lag(new_status) OVER (PARTITION BY claim_id ORDER BY ts, seq), 'RECEIVED') AS old_status, new_status FROM a WHERE new_status IS NOT NULL""", "activity")  # fmt: skip
def t5(spark, d):
    return lifecycle.transitions(actions(spark, d))[0]


@query("t5_rejected_actions", "SELECT user_id AS claim_id, event_id AS seq FROM activity WHERE event_type NOT IN ('purchase', 'click', 'view')", "activity")
def t5_rejected(spark, d):
    return lifecycle.transitions(actions(spark, d))[1].select("claim_id", "seq")


@query("t6_field_edits", """WITH e AS (SELECT user_id AS claim_id, event_type AS field, ts, event_id, floor(value) % 7 AS v FROM activity), f AS (SELECT claim_id, field, arg_min(v, (ts, event_id)) AS first, arg_max(v, (ts, event_id)) AS last FROM e GROUP BY 1, 2)
    SELECT claim_id, field, 'start' AS original, 'v' || last::BIGINT AS corrected FROM f""", "activity")  # fmt: skip
def t6(spark, d):
    e = role(spark, d, "activity").select(F.col("user_id").alias("claim_id"), F.col("event_type").alias("field"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.lit("start").alias("old_value"), F.concat(F.lit("v"), (F.floor("value") % 7).cast("string")).alias("new_value"))
    return lifecycle.edited(e).drop("edits")


@query("t7_replaced_lists", "WITH l AS (SELECT user_id AS claim_id, arg_max([event_type, event_id::VARCHAR], (ts, event_id)) AS items FROM activity GROUP BY 1) SELECT claim_id, unnest([0, 1]) AS position, unnest(items) AS item FROM l", "activity")
def t7(spark, d):
    e = role(spark, d, "activity").select(F.col("user_id").alias("claim_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.array("event_type", F.col("event_id").cast("string")).alias("items"))
    return lifecycle.replaced_lists(e)


@query("t8_job_progress", """WITH j AS (SELECT user_id AS job_id, CASE WHEN value > 2 THEN 'DONE' ELSE 'FAILED' END AS state FROM activity), c AS (SELECT job_id, count(*) AS total, count(*) FILTER (state = 'DONE') AS done, count(*) FILTER (state = 'FAILED') AS failed FROM j GROUP BY 1)
    SELECT *, CASE WHEN done + failed < total THEN 'RUNNING' WHEN done = 0 THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL_SUCCESS' ELSE 'COMPLETED' END AS status FROM c""", "activity")  # fmt: skip
def t8(spark, d):
    return lifecycle.job_progress(role(spark, d, "activity").select(F.col("user_id").alias("job_id"), F.when(F.col("value") > 2, "DONE").otherwise("FAILED").alias("state")))


@query("t9_pipeline_outcome", """WITH s AS (SELECT claim_id, seq AS step_no, CASE WHEN quantity = 9 THEN 'SKIPPED' WHEN quantity > 40 THEN 'FAILED' ELSE 'DONE' END AS state FROM expenses), f AS (SELECT claim_id, min(CASE WHEN state = 'FAILED' THEN step_no END) AS stop FROM s GROUP BY 1)
    SELECT claim_id, step_no, state FROM s JOIN f USING (claim_id) WHERE stop IS NULL OR step_no <= stop""", "expenses")  # fmt: skip
def t9(spark, d):
    code = F.when(F.col("quantity") == 9, 409).when(F.col("quantity") > 40, 500).otherwise(200)
    return lifecycle.pipeline_outcome(role(spark, d, "expenses").select("claim_id", F.col("seq").alias("step_no"), code.alias("code")))


@query("t11_in_progress_gate", "SELECT claim_id, policy_id IN (SELECT policy_id FROM claims WHERE status = 'COMPLETED' AND claim_id % 3 = 0) AS ignored FROM claims", "claims")
def t11(spark, d):
    c = role(spark, d, "claims").withColumn("set_hash", F.col("policy_id"))
    return lifecycle.in_progress(c.select("claim_id", "set_hash"), c.where("status = 'COMPLETED' AND claim_id % 3 = 0")).select("claim_id", "ignored")


def stream(spark, d):
    """The events as a stream over the table's folder or file."""
    source = spark.read.parquet(f"{d}/events.parquet")
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def name() -> str:
    """A name for a run of a stream."""
    return "s" + uuid.uuid4().hex


#: Each type's payload, read as its own type.
PAYLOADS = {"signup": "k bigint", "click": "k double", "purchase": "k string, note string", "view": "k int"}


@query("t1_decoded_stream", """WITH p AS (SELECT event_type, json_extract_string(props, '$.k') AS k FROM activity WHERE event_type <> 'error')
    SELECT event_type, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN k::DOUBLE / 2 WHEN event_type = 'purchase' THEN length(k) ELSE k::DOUBLE END)::DOUBLE AS k FROM p GROUP BY 1""", "activity")  # fmt: skip
def t1(spark, d):
    rows = streams.decoded(stream(spark, d), PAYLOADS)
    k = F.coalesce(F.col("payload_click.k") / 2, F.length("payload_purchase.k").cast("double"), F.col("payload_signup.k").cast("double"), F.col("payload_view.k").cast("double"))
    rows = streams.drained(rows.select("event_type", k.alias("k")), name(), "append")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("t2_deduplicated_stream", "SELECT event_id, event_type FROM activity", "activity")
def t2(spark, d):
    twice = stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.drained(streams.deduplicated(twice, "event_id", "ts", "60 days").select("event_id", "event_type"), name(), "append")


@query("t3_latest_state_stream", "SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM activity GROUP BY 1", "activity")
def t3(spark, d):
    return streams.drained(streams.latest_state(stream(spark, d), "user_id", "event_type", "ts"), name(), "complete")


@query("t4_progress_stream", """WITH r AS (SELECT event_id, user_id, ts, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM activity)
    SELECT event_id, user_id, progress FROM r QUALIFY coalesce(max(progress) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 300""", "activity")  # fmt: skip
def t4(spark, d):
    return streams.drained(streams.monotonic_progress(stream(spark, d), 300.0), name(), "append")


@query("t10_velocity_stream", """WITH o AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) - unnest(range(30)) * INTERVAL 1 DAY AS start FROM activity)
    SELECT user_id, start, count(*) AS n FROM o GROUP BY 1, 2""", "activity")  # fmt: skip
def t10(spark, d):
    out = streams.drained(streams.windowed_counts(stream(spark, d), "user_id", "ts", "30 days", "1 day", "2 days"), name(), "complete")
    return out.select("user_id", F.col("window.start").alias("start"), "n")


def beats(spark, kinds):
    """One row a kind, of a key that nothing has and far in time, that ends what waits for later events.

    The key isn't null: a join on it would leave such rows out before their time is seen.
    """
    rows = [(None, -1, k) for k in kinds]
    return spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumn("ts", F.to_timestamp(F.lit("2100-01-01")))


def timed(spark, d):
    return stream(spark, d).select("event_id", "user_id", "event_type", "ts")


@query("t10_trailing_velocity", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS recent FROM activity", "activity")
def t10_trailing(spark, d):
    counted = lambda rows: streams.trailing_counts(rows, "user_id", "ts", 30, "2 days")
    return streams.drained_to_end(timed(spark, d), counted, beats(spark, ["beat"]), name()).where("user_id >= 0")


@query("t11_gated_stream", """WITH u AS (SELECT * FROM activity WHERE event_type = 'click'), s AS (SELECT user_id, ts FROM activity WHERE event_type = 'signup'), done AS (SELECT DISTINCT patient_id FROM claims WHERE status = 'COMPLETED' AND total_amount > 400000)
    SELECT event_id, user_id, user_id IN (SELECT patient_id FROM done) OR EXISTS (SELECT 1 FROM s WHERE s.user_id = u.user_id AND s.ts <= u.ts AND s.ts >= u.ts - INTERVAL 7 DAY) AS ignored FROM u""", "activity claims")  # fmt: skip
def t11_gated(spark, d):
    done = role(spark, d, "claims").where("status = 'COMPLETED' AND total_amount > 400000").select(F.col("patient_id").alias("user_id"))

    def gate(rows):
        of = lambda kind: rows.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
        return streams.gated(of("click"), of("signup"), done, "user_id", "7 DAYS", "2 days")

    return streams.drained_to_end(timed(spark, d), gate, beats(spark, ["click", "signup"]), name()).where("event_id IS NOT NULL")


@query("s8_replaced_rows", "SELECT claim_id, status FROM claims WHERE claim_id % 5 <> 0 UNION ALL SELECT claim_id, 'REPLACED' FROM claims WHERE claim_id % 5 = 0", "claims")
def s8(spark, d):
    c = role(spark, d, "claims").select("claim_id", "status")
    return lifecycle.replaced_rows(c, c.where("claim_id % 5 = 0").withColumn("status", F.lit("REPLACED")), "claim_id")


@query("s9_upserted", "SELECT claim_id, CASE WHEN claim_id % 5 = 0 THEN 'NEW' ELSE status END AS status, total_amount FROM claims", "claims")
def s9(spark, d):
    c = role(spark, d, "claims").select("claim_id", "status", "total_amount")
    return lifecycle.upserted(c, c.where("claim_id % 5 = 0").select("claim_id", F.lit("NEW").alias("status"), F.lit(None).cast("double").alias("total_amount")), "claim_id")


@query("s11_payloads", "SELECT claim_id, 'CLM*' || claim_id || '~' || string_agg('SV1*HC:' || code || '*' || printf('%.2f', quantity), '~' ORDER BY seq, code, quantity) || '~' AS payload FROM expenses GROUP BY claim_id", "expenses")
def s11(spark, d):
    return lifecycle.payload("x12", role(spark, d, "expenses").select("claim_id", "seq", "code", F.col("quantity").alias("amount")))


@query("s11_fhir", """WITH i AS (SELECT claim_id, code, amount, row_number() OVER (PARTITION BY claim_id ORDER BY seq, code, amount) AS n FROM expenses)
    SELECT claim_id, 'Claim' AS kind, claim_id::VARCHAR AS id, string_agg(n || ':' || code, ',' ORDER BY n) AS items, round(sum(amount), 2) AS total FROM i GROUP BY claim_id""", "expenses")  # fmt: skip
def s11_fhir(spark, d):
    p = lifecycle.payload("fhir", role(spark, d, "expenses").select("claim_id", "seq", "code", "amount"))
    v = F.parse_json("payload")
    items = F.variant_get(v, "$.item", "array<struct<sequence:int,productOrService:struct<coding:array<struct<code:string>>>>>")
    told = F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["sequence"].cast("string"), x["productOrService"]["coding"][0]["code"])), ",")
    return p.select("claim_id", F.variant_get(v, "$.resourceType", "string").alias("kind"), F.variant_get(v, "$.id", "string").alias("id"), told.alias("items"), F.variant_get(v, "$.total.value", "double").alias("total"))


@query("s11_generic", """SELECT claim_id, string_agg(seq || ':' || code || ':' || printf('%.2f', quantity), ',' ORDER BY seq, code, quantity) AS items FROM expenses GROUP BY claim_id""", "expenses")
def s11_generic(spark, d):
    p = lifecycle.payload("some payer", role(spark, d, "expenses").select("claim_id", "seq", "code", F.col("quantity").alias("amount")))
    items = F.from_json("payload", "items array<struct<seq:int,code:string,amount:double>>")["items"]
    return p.select("claim_id", F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["seq"].cast("string"), x["code"], F.format_string("%.2f", x["amount"]))), ",").alias("items"))


@query("s12_deleted", "SELECT claim_id, seq, code FROM expenses WHERE claim_id NOT IN (SELECT claim_id FROM claims WHERE status = 'PROCESSING')", "claims expenses")
def s12(spark, d):
    c = role(spark, d, "claims")
    return lifecycle.deleted(c, {"expenses": role(spark, d, "expenses").select("claim_id", "seq", "code")}, c.where("status = 'PROCESSING'").select("claim_id"))[1]["expenses"]


@query("s12_last_document_stays", "WITH k AS (SELECT source, doc_id, doc_id % 3 = 0 OR source IN ('src1', 'src2') AS gone FROM documents), m AS (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY source) AS l, min(doc_id) OVER (PARTITION BY source) AS f FROM k) SELECT source AS claim_id, doc_id AS document_id FROM m WHERE NOT gone OR (l = 0 AND doc_id = f)")
def s12_last(spark, d):
    docs = raw(spark, d, "documents").select(F.col("source").alias("claim_id"), F.col("doc_id").alias("document_id"))
    return lifecycle.without_documents(docs, docs.where("document_id % 3 = 0 OR claim_id IN ('src1', 'src2')").select("document_id"))


@query("a23_completeness", "SELECT c.claim_id, round(100.0 * (count(DISTINCT e.category)) / 3)::BIGINT AS percent, 3 - count(DISTINCT e.category) AS missing FROM claims c LEFT JOIN expenses e USING (claim_id) GROUP BY 1", "claims expenses")
def a23(spark, d):
    needs = spark.createDataFrame([("Pharmacy",), ("Room Rent",), ("Surgery / OT",)], "requirement string")
    has = role(spark, d, "expenses").select("claim_id", F.col("category").alias("requirement")).distinct()
    return lifecycle.completeness(role(spark, d, "claims"), needs, has).select("claim_id", "percent", F.size("missing").cast("long").alias("missing"))


@query("a24_insights", """SELECT c.claim_id, (1 + (c.total_amount / 500000 >= 0.3)::INT + (c.total_amount > coalesce(e.items, 0))::INT + (coalesce(e.codes, 0) = 0)::INT)::INT AS n FROM claims c LEFT JOIN (SELECT claim_id, sum(amount) AS items, count(DISTINCT code) AS codes, count(*) AS n FROM expenses GROUP BY 1) e USING (claim_id)""", "claims expenses")
def a24(spark, d):
    e = role(spark, d, "expenses").groupBy("claim_id").agg(F.sum("amount").alias("items"), F.countDistinct("code").alias("n_codes"), F.count("*").alias("n_lines"))
    wide = role(spark, d, "claims").join(e, "claim_id", "left").select("claim_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_codes", F.lit(0)).alias("n_codes"), (F.col("total_amount") / 500000).alias("score"), (F.col("total_amount") - F.coalesce("items", F.lit(0.0))).alias("difference"))
    return lifecycle.insights(wide).select("claim_id", F.size("insights").alias("n"))
