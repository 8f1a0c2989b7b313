"""Claim lifecycle: transitions, edits, progress, outcomes, payloads, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decision to the status it leads to (fixed values).
ACTIONS = {"approve": "APPROVED", "reject": "REJECTED", "send_back": "MANUAL_REVIEW_REQUIRED", "request_docs": "DOCUMENTS_REQUESTED", "send_money": "PAID"}
TERMINAL = ("COMPLETED", "FAILED")


def transitions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T5: (audit of status changes with old and new status, rejected actions)."""
    to = F.create_map(*(F.lit(v) for pair in ACTIONS.items() for v in pair))[F.lower(F.trim("action"))]
    rows = actions.withColumn("new_status", to)
    good = rows.where(F.col("new_status").isNotNull())
    old = F.lag("new_status").over(Window.partitionBy("claim_id").orderBy("at", "seq"))
    return good.withColumn("old_status", F.coalesce(old, F.lit("RECEIVED"))).select("claim_id", "seq", "old_status", "new_status"), rows.where(F.col("new_status").isNull()).drop("new_status")


def edited(edits: DataFrame) -> DataFrame:
    """Per (claim, field): the original at the first edit, the last correction, edits that changed something; reverts vanish."""
    log = F.array_sort(F.collect_list(F.struct("at", "seq", "old_value", "new_value")))
    rows = edits.groupBy("claim_id", "field").agg(log.alias("log"))
    first = F.struct(F.col("log")[0]["old_value"].alias("value"), F.lit(0).alias("n"))
    fold = F.aggregate("log", first, lambda a, e: F.struct(e["new_value"].alias("value"), (a["n"] + F.when(e["new_value"] == a["value"], 0).otherwise(1)).alias("n")))
    out = rows.select("claim_id", "field", F.col("log")[0]["old_value"].alias("original"), fold.alias("f"))
    return out.select("claim_id", "field", "original", F.col("f.value").alias("corrected"), F.col("f.n").alias("edits")).where("corrected <> original")


def replaced_lists(edits: DataFrame) -> DataFrame:
    """The last full list of each claim, exploded."""
    return edits.groupBy("claim_id").agg(F.max_by("items", F.struct("at", "seq")).alias("items")).select("claim_id", F.posexplode("items").alias("position", "item"))


def job_progress(documents: DataFrame) -> DataFrame:
    """Processed of total, and FAILED, PARTIAL_SUCCESS, COMPLETED or RUNNING."""
    rows = documents.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "DONE").alias("done"), F.count_if(F.col("state") == "FAILED").alias("failed"))
    status = F.when(F.col("done") + F.col("failed") < F.col("total"), "RUNNING").when(F.col("done") == 0, "FAILED").when(F.col("failed") > 0, "PARTIAL_SUCCESS").otherwise("COMPLETED")
    return rows.withColumn("status", status)


def pipeline_outcome(steps: DataFrame) -> DataFrame:
    """Steps up to the first failed one; code 409 counts as skipped."""
    state = F.when(F.col("code") == 409, "SKIPPED").when(F.col("code") >= 400, "FAILED").otherwise("DONE")
    rows = steps.withColumn("state", state)
    stop = rows.groupBy("claim_id").agg(F.min(F.when(F.col("state") == "FAILED", F.col("step_no"))).alias("stop"))
    return rows.join(stop, "claim_id").where(F.col("stop").isNull() | (F.col("step_no") <= F.col("stop"))).select("claim_id", "step_no", "state")


def in_progress(uploads: DataFrame, claims: DataFrame) -> DataFrame:
    """Uploads whose set hash belongs to a claim that is done or under way are ignored."""
    busy = claims.where(F.col("status").isin("COMPLETED", "PROCESSING")).select("set_hash").distinct()
    return uploads.join(busy.withColumn("known", F.lit(True)), "set_hash", "left").withColumn("ignored", F.coalesce("known", F.lit(False))).drop("known")


def deleted(claims: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A claim's deletion takes every child's rows along."""
    return claims.join(gone, "claim_id", "left_anti"), {k: c.join(gone, "claim_id", "left_anti") for k, c in children.items()}


def without_documents(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents but those to delete; a claim's last document stays."""
    rows = documents.join(gone.withColumn("gone", F.lit(True)), "document_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    left = F.count_if(~F.col("gone")).over(Window.partitionBy("claim_id"))
    first = F.min("document_id").over(Window.partitionBy("claim_id"))
    return rows.withColumn("left", left).withColumn("first", first).where(~F.col("gone") | ((F.col("left") == 0) & (F.col("document_id") == F.col("first")))).drop("gone", "left", "first")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key, column by column where they have a value."""
    cols = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in cols))


def replaced_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that come anew are replaced; the same again changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def generic_payload(lines: DataFrame) -> DataFrame:
    """One JSON per claim."""
    items = F.array_sort(F.collect_list(F.struct("seq", "code", "amount")))
    return lines.groupBy("claim_id").agg(F.to_json(F.struct(F.first("claim_id").alias("claim_id"), items.alias("items"))).alias("payload"))


def fhir_payload(lines: DataFrame) -> DataFrame:
    """A FHIR R4 Claim per claim; without a procedure code one item 99999 stands in; total only where it is a number."""
    items = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("seq", "code", "amount"))))
    rows = lines.groupBy("claim_id").agg(items.alias("items"), F.sum("amount").alias("total"))
    given = F.when(F.size("items") > 0, F.col("items")).otherwise(F.array(F.struct(F.lit(1).alias("seq"), F.lit(99999).cast("long").alias("code"), F.lit(None).cast("double").alias("amount"))))
    item = F.transform(given, lambda x, i: F.struct((i + 1).alias("sequence"), F.struct(F.array(F.struct(F.lit("http://www.ama-assn.org/go/cpt").alias("system"), x["code"].cast("string").alias("code"))).alias("coding")).alias("productOrService")))
    total = F.when(F.col("total").isNotNull(), F.struct(F.round("total", 2).alias("value"), F.lit("INR").alias("currency")))
    return rows.select("claim_id", F.to_json(F.struct(F.lit("Claim").alias("resourceType"), F.col("claim_id").cast("string").alias("id"), F.lit("active").alias("status"), item.alias("item"), total.alias("total"))).alias("payload"))


def x12_payload(lines: DataFrame) -> DataFrame:
    """X12-like segments, one line for each service."""
    seg = F.transform(F.array_sort(F.collect_list(F.struct("seq", "code", "amount"))), lambda x: F.concat_ws("*", F.lit("SV1"), F.concat(F.lit("HC:"), x["code"].cast("string")), F.format_string("%.2f", x["amount"])))
    return lines.groupBy("claim_id").agg(F.array_join(seg, "~").alias("services")).select("claim_id", F.concat(F.lit("CLM*"), F.col("claim_id").cast("string"), F.lit("~"), "services", F.lit("~")).alias("payload"))


PAYLOADS = {"generic": generic_payload, "fhir": fhir_payload, "x12": x12_payload}


def payload(payer: str, lines: DataFrame) -> DataFrame:
    """The payer's format; generic for unknown payers."""
    return PAYLOADS.get(payer, generic_payload)(lines)


def completeness(claims: DataFrame, requirements: DataFrame, present: DataFrame) -> DataFrame:
    """Percent of the requirements (a fixed list) that a claim meets, and what it lacks."""
    wanted = requirements.agg(F.collect_set("requirement")).scalar()
    rows = claims.select("claim_id", F.explode(wanted).alias("requirement")).join(present.withColumn("has", F.lit(True)), ["claim_id", "requirement"], "left")
    has = F.coalesce("has", F.lit(False))
    return rows.groupBy("claim_id").agg(F.round(F.avg(has.cast("double")) * 100).cast("long").alias("percent"), F.array_sort(F.collect_list(F.when(~has, F.col("requirement")))).alias("missing"))


def insights(wide: DataFrame) -> DataFrame:
    """What stands out in a claim, as an array of sentences."""
    c: dict[str, Column] = {k: F.col(k) for k in wide.columns}
    return wide.select("claim_id", F.array_compact(F.array(
        F.format_string("%d expense rows", c["n_lines"]), F.when(c["score"] >= 0.6, "high risk").when(c["score"] >= 0.3, "moderate risk"),
        F.when(c["difference"] > 0, F.lit("billed more than itemised")), F.when(c["n_codes"] == 0, F.lit("no codes")),
    )).alias("insights"))
