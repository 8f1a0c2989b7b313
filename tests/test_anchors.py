"""Lines and columns by running means, against one pass over sorted centres."""

import random

from pyspark.sql import functions as F

from claimloom.operators import layout


def one_pass(values, tolerance):
    groups = []
    for v in sorted(values):
        if groups and abs(v - sum(groups[-1]) / len(groups[-1])) <= tolerance:
            groups[-1].append(v)
        else:
            groups.append([v])
    return groups


def test_drifting_lines_equal_one_pass(spark):
    rng = random.Random(3)
    pages = {1: [i * 2.0 for i in range(60)], 2: [rng.uniform(0, 300) for _ in range(80)], 3: [5.0] * 4, 4: [0.0, 8.0, 16.5, 100.0, 104.0], 5: [i * 0.5 for i in range(400)]}
    rows = [(p, 1, float(i), y - 1, y + 1) for p, ys in pages.items() for i, y in enumerate(rng.sample(ys, len(ys)))]
    df = spark.createDataFrame(rows, "document_id int, page int, x0 double, y0 double, y1 double")
    got = {}
    for r in layout.lines(df, 8.0).orderBy("yc").collect():
        got.setdefault(r["document_id"], {}).setdefault(r["line"], []).append(r["yc"])
    for p, ys in pages.items():
        want = one_pass(ys, 8.0)
        assert [got[p][k] for k in sorted(got[p])] == want and sorted(got[p]) == list(range(1, len(want) + 1))
    assert layout.lines(df.limit(0), 8.0).count() == 0


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_are_shuffled_once_and_come_back_as_they_were(spark):
    rows = [(1, 1, 5.0, 2**60 + 1, "a"), (1, 1, None, None, None), (1, 1, 12.0, 3, ""), (1, 1, float("nan"), 4, "d"), (None, 1, 5.0, 5, "e"), (None, 1, 6.0, 6, "f")]
    df = spark.createDataFrame(rows, "document_id int, page int, yc double, big long, text string")
    got = layout.lines(df, 8.0)
    assert shuffles(got) == 1
    assert {(r["big"], r["text"], r["line"]) for r in got.collect()} == {(2**60 + 1, "a", 2), (None, None, 1), (3, "", 2), (4, "d", 3), (5, "e", 1), (6, "f", 1)}


def test_amounts_alone_gather_no_words(spark):
    rows = [(1, 1, 1, 1, "Bed"), (1, 1, 1, 2, "1,200.50"), (1, 1, 1, 3, "of"), (1, 1, 2, 1, "none"), (1, 1, 3, 4, "(5)"), (1, 1, 3, 2, "₹7"), (1, 1, 3, 1, "7")]
    found = layout.expense_rows(spark.createDataFrame(rows, "document_id int, page int, line int, seq int, text string"))
    assert {(r["line"], r["description"], r["amount"]) for r in found.collect()} == {(1, "Bed of", 1200.5), (3, "7 ₹7", 5.0)}
    assert "collect_list" not in found.select("line", "amount")._jdf.queryExecution().optimizedPlan().toString()


def test_columns_count_lines_near_the_mean(spark):
    rng = random.Random(4)
    tokens = [(1, 1, line, x + rng.uniform(-9, 9)) for line in range(12) for x in (50, 120, 300) if rng.random() < 0.7] + [(1, 1, 3, 200.0)]
    df = spark.createDataFrame(tokens, "document_id int, page int, line int, x double").withColumn("x0", F.col("x") - 2).withColumn("x1", F.col("x") + 2)
    got = sorted((round(r["centre"], 6), r["lines"]) for r in layout.columns(df, 15.0).collect())
    n = len({t[2] for t in tokens})
    want = []
    for g in one_pass([t[3] for t in tokens], 15.0):
        centre = sum(g) / len(g)
        lines = len({t[2] for t in tokens if abs(t[3] - centre) <= 15.0})
        if lines / n >= 0.35:
            want.append((round(centre, 6), lines))
    assert got == sorted(want)


def test_columns_of_many_pages_without_a_join_of_tokens(spark):
    rng = random.Random(7)
    pages = {p: [(rng.randrange(6), rng.choice([rng.uniform(0, 200), float(rng.randrange(0, 200, 10))])) for _ in range(rng.choice([1, 5, 60]))] for p in range(40)}
    pages[40] = [(i % 3, i * 4.0) for i in range(80)]  # drifts all the way
    df = spark.createDataFrame([(p, 1, line, x - 1, x + 1) for p, ts in pages.items() for line, x in ts], "document_id int, page int, line int, x0 double, x1 double")
    found = layout.columns(df, 15.0, 0.0)
    assert shuffles(found) <= 4  # tokens by page, lines by page (two steps), clusters by page
    got = {}
    for r in found.orderBy("col").collect():
        got.setdefault(r["document_id"], []).append((r["col"], round(r["centre"], 6), r["lines"], round(r["share"], 6)))
    for p, tokens in pages.items():
        want = []
        for i, g in enumerate(one_pass([x for _, x in tokens], 15.0)):
            mean = sum(g) / len(g)
            lines = len({line for line, x in tokens if abs(x - mean) <= 15.0})
            want.append((i + 1, round(mean, 6), lines, round(lines / len({line for line, _ in tokens}), 6)))
        assert got[p] == want
