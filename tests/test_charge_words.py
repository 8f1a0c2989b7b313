"""Rows that both know their amounts meet by amount alone, and descriptions are made plain once."""

from pyspark.sql import functions as F

from claimloom.operators import expenses

SCHEMA = "claim_id long, seq long, source string, description string, amount double, category string, confidence double"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_descriptions_are_made_plain_once(spark):
    rows = [(1, 1, "semantic", "Room  rent!", 100.0, "Room", 0.5), (1, 2, "heuristic", "room rent", 100.0, "Room", 0.5)]
    made = expenses.grouped(spark.createDataFrame(rows, SCHEMA), 1.0, 0.5)
    assert "regexp_replace" not in plan_of(expenses.merged_charges(made))
    assert [r["n"] for r in expenses.merged_charges(made).collect()] == [2]
    # Rows that come without norm are merged as before.
    assert [tuple(r) for r in expenses.merged_charges(made.drop("norm")).collect()] == [tuple(r) for r in expenses.merged_charges(made).collect()]


def test_unknown_amounts_still_meet_by_word(spark):
    rows = [
        (1, 1, "semantic", "bed charges", None, "", 0.5), (1, 2, "heuristic", "bed charges", 7.0, "", 0.5),  # unknown against known
        (2, 1, "semantic", "bed charges", 7.0, "", 0.5), (2, 2, "heuristic", "bed charges", 0.0, "", 0.5),  # known against unknown
        (3, 1, "semantic", "bed charges", 0.0, "", 0.5), (3, 2, "heuristic", "bed charges", None, "", 0.5),  # both unknown
        (4, 1, "semantic", "bed charges", 7.0, "", 0.5), (4, 2, "heuristic", "bed charges", 9.0, "", 0.5), (4, 3, "heuristic", "bed", None, "", 0.5),  # too far apart; unknown
        (5, 1, "semantic", None, 7.0, "", 0.5), (5, 2, "heuristic", "", None, "", 0.5),  # without words
    ]
    got = expenses.grouped(spark.createDataFrame(rows, SCHEMA), 1.0, 0.5).where(F.col("source") == "heuristic")
    assert {(r["claim_id"], r["seq"]): r["grp"] for r in got.collect()} == {(1, 2): 1, (2, 2): 1, (3, 2): 1, (4, 2): 2, (4, 3): 1, (5, 2): 1}
