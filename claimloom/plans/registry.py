"""Registration of queries, and the roles that the driver's tables play.

An order is a claim, a line item an expense row, a customer a patient, a supplier a provider
and a part a code of the catalogue. Each role is one projection, usable from Spark and DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ROLES: dict[str, tuple[str, dict[str, str]]] = {
    "claims": ("orders", {
        "claim_id": "o_orderkey", "patient_id": "o_custkey", "policy_id": "o_custkey % 997",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'MANUAL_REVIEW_REQUIRED' END",
        "created_at": "o_orderdate", "total_amount": "o_totalprice", "channel": "o_orderpriority",
    }),
    "expenses": ("lineitem", {
        "claim_id": "l_orderkey", "seq": "l_linenumber", "provider_id": "l_suppkey", "code": "l_partkey",
        "category": "CASE l_returnflag WHEN 'A' THEN 'Pharmacy' WHEN 'N' THEN 'Room Rent' ELSE 'Surgery / OT' END",
        "line_status": "l_linestatus", "amount": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "quantity": "l_quantity", "service_date": "l_shipdate",
    }),
    "patients": ("customer", {"patient_id": "c_custkey", "patient_name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal", "sum_insured": "c_acctbal * 50"}),
    "providers": ("supplier", {"provider_id": "s_suppkey", "provider_name": "s_name", "balance": "s_acctbal"}),
    "catalogue": ("part", {"code": "p_partkey", "description": "p_name", "category": "p_type", "brand": "p_brand", "cost": "p_retailprice", "size": "p_size"}),
    "activity": ("events", {"event_id": "event_id", "ts": "ts", "user_id": "user_id", "event_type": "event_type", "value": "value", "props": "props"}),
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a role; only the columns that are used are read."""
    source, columns = ROLES[name]
    return raw(spark, sf_dir, source).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as stored, times without a zone taken as the session's (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(df[c].cast("timestamp").alias(c) if kind == "timestamp_ntz" else df[c] for c, kind in df.dtypes))


def query(name: str, sql: str | None = None, roles: str = ""):
    """Registers a query; its SQL may use the named roles as tables."""

    def register(f):
        QUERIES[name] = f
        if sql:
            parts = [f"{r} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ROLES[r][1].items())} FROM {ROLES[r][0]})" for r in roles.split()]
            body = sql.strip()
            if parts:
                start = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(w)), "")
                body = (start or "WITH ") + ", ".join(parts) + (", " if start else " ") + body[len(start) :]
            ORACLES[name] = body
        return f

    return register
