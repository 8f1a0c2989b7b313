"""Rows of two extractors grouped and merged: against a pass over the lists, one row after another."""

import random
import re

from pyspark.sql import functions as F

from claimloom.functions.scalars import rounded
from claimloom.operators import expenses

SCHEMA = "claim_id long, seq long, source string, heuristic_source string, description string, amount double, category string, confidence double"


def norm(d):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", (d or "").lower())).strip()


def same(a, b, tolerance, least):
    if a["source"] == b["source"]:
        return False
    x, y = norm(a["description"]), norm(b["description"])
    v, w = set(x.split()), set(y.split())
    like = 1.0 if not x and not y else len(v & w) / len(v | w) if v and w else 0.0
    held = bool(x and y) and (x == y or ((x in y or y in x or v <= w or w <= v) and len(x.split()) > 1 and len(y.split()) > 1))
    if (a["amount"] or 0) > 0 and (b["amount"] or 0) > 0 and abs(a["amount"] - b["amount"]) > tolerance:
        return False
    c, d = ((r["category"] or "").strip().lower() for r in (a, b))
    if c and d and "miscellaneous" not in (c, d) and c != d:
        return False
    return like >= least or held


def one_after_another(rows, tolerance, least):
    """seq of the group's first row, for each (source, seq)."""
    rows = sorted(rows, key=lambda r: (r["source"] != "semantic", r["seq"]))
    out, used = {}, set()
    for i, a in enumerate(rows):
        if i not in used:
            for j in range(i, len(rows)):
                if j not in used and (i == j or same(a, rows[j], tolerance, least)):
                    used.add(j)
                    out[rows[j]["source"], rows[j]["seq"]] = a["seq"]
    return out


def test_groups_equal_one_pass_over_the_lists(spark):
    rng = random.Random(4)
    words = ["room", "rent", "icu", "bed", "x-ray", "Pharmacy,", "charges"]
    rows = []
    for claim in range(40):
        for seq in range(rng.randint(2, 12)):
            text = rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 4)))])
            rows.append((claim, seq, rng.choice(["semantic", "heuristic"]), None, text, rng.choice([None, 0.0, 100.0, 100.5, 101.5, 900.0]), rng.choice([None, "", "Room", "room ", "Lab", "Miscellaneous"]), rng.random()))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["claim_id"], r["source"], r["seq"]): r["grp"] for r in expenses.grouped(df, 1.0, 0.5).collect()}
    for claim in range(40):
        mine = [dict(zip(df.columns, r, strict=True)) for r in rows if r[0] == claim]
        for (source, seq), lead in one_after_another(mine, 1.0, 0.5).items():
            assert got[claim, source, seq] == lead
    assert len(got) == len(rows) and sum(lead != seq for (_, _, seq), lead in got.items()) > 10


def test_merged_charge_keeps_the_better_row(spark):
    long = "room rent " + "very " * 60 + "long"
    rows = [
        (1, 1, "semantic", None, "Room rent", 100.0, "", 0.9), (1, 2, "heuristic", "table", "Room rent deluxe", 100.0, "", 0.95),  # near amounts, near confidence: semantic
        (2, 1, "semantic", None, "Room rent", 100.0, "", 0.9), (2, 2, "heuristic", "table", "Room rent", 0.0, "", 0.2),  # amounts differ: heuristic's
        (3, 1, "semantic", None, long, 100.0, "", 0.5), (3, 2, "heuristic", "table", "room rent", 100.0, "", 0.9),  # surer heuristic, longer semantic text
        (4, 2, "heuristic", "summary", "Bed", 5.0, "", None),
    ]
    grouped = expenses.grouped(spark.createDataFrame(rows, SCHEMA), 1.0, 0.5)
    got = {r["claim_id"]: (r["description"], r["amount"], r["confidence"], r["sources"], r["n"]) for r in expenses.merged_charges(grouped).collect()}
    both = ["heuristic", "semantic"]
    assert got == {1: ("Room rent", 100.0, 0.95, both, 2), 2: ("Room rent", 0.0, 0.9, both, 2), 3: (long, 100.0, 0.9, both, 2), 4: ("Bed", 5.0, 0.0, ["heuristic"], 1)}


def test_amounts_are_rounded_as_sql_rounds_them(spark):
    # The double next to 1.005 times 100 is 100.49999999999999; 0.285 times 100 is 28.499999999999996.
    got = [r["x"] for r in spark.createDataFrame([(1.005,), (0.285,), (2.5,), (-2.675,), (0.125,), (None,)], "x double").select(rounded(F.col("x"), 2).alias("x")).collect()]
    assert got == [1.0, 0.28, 2.5, -2.68, 0.13, None]
