"""Layout queries: a document's words are tokens, its lines rows of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import layout
from claimloom.plans.registry import query, raw, role


def tokens(spark, d):
    """Words with boxes made from their place: lines 20 high, words 10 wide a letter."""
    rows = raw(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("row", "t"))
    words = rows.select("document_id", "page", "row", F.posexplode(F.split("t", " ")).alias("i", "text")).where("text <> ''")
    x, y = (F.col("i") * 100).cast("double"), (F.col("row") * 20 + F.when(F.col("row") % 5 == 0, 40).otherwise(0)).cast("double")
    return words.select("document_id", "page", "row", (F.col("row") * 100_000 + F.col("i")).alias("seq"), "text", x.alias("x0"), (x + 10 * F.length("text")).alias("x1"), y.alias("y0"), (y + 12).alias("y1"), (F.length("text") * 10.0 / 7 - 2).alias("confidence"))


T = """r AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents),
w AS (SELECT document_id, row, unnest(string_split(t, ' ')) AS text, generate_subscripts(string_split(t, ' '), 1) - 1 AS i FROM r),
tok AS (SELECT document_id, row, i, row * 100000 + i AS seq, text, i * 100.0::DOUBLE AS x0, i * 100.0 + 10 * length(text) AS x1, (row * 20 + CASE WHEN row % 5 = 0 THEN 40 ELSE 0 END)::DOUBLE AS y0, length(text) * 10.0::DOUBLE / 7 - 2 AS confidence FROM w WHERE text <> '')"""


def slanted(spark, d):
    """Words on lines of forty that fall by 3 a word, as on a page that was scanned askew."""
    i, row = F.col("seq") % 100_000, F.col("row")
    y = (row * 1000 + F.floor(i / 40)) * 200.0 + (i % 40) * 3.0
    return tokens(spark, d).withColumn("y0", y).withColumn("y1", y)


def fold_sql(source: str, value: str, order: str, tolerance: float) -> str:
    """CTEs folded(document_id, run, k, grp, ...): groups by the running mean of a value, one row after another.

    Rows are cut into runs first, at gaps of more than the tolerance; the recursion is as deep as the longest run.
    """
    return f"""
    gaps AS (SELECT *, {value} AS v, coalesce(({value} - lag({value}) OVER w > {tolerance})::INT, 1) AS f FROM {source} WINDOW w AS (PARTITION BY document_id ORDER BY {value}, {order})),
    runs AS (SELECT *, sum(f) OVER (PARTITION BY document_id ORDER BY v, {order}) AS run FROM gaps),
    steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY document_id, run ORDER BY v, {order}) AS k FROM runs),
    fold AS (
        SELECT document_id, run, k, v AS total, 1 AS n, 0 AS grp FROM steps WHERE k = 1
        UNION ALL
        SELECT s.document_id, s.run, s.k, CASE WHEN abs(s.v - total / n) > {tolerance} THEN s.v ELSE total + s.v END, CASE WHEN abs(s.v - total / n) > {tolerance} THEN 1 ELSE n + 1 END,
            grp + (abs(s.v - total / n) > {tolerance})::INT
        FROM fold JOIN steps s ON s.document_id = fold.document_id AND s.run = fold.run AND s.k = fold.k + 1),
    folded AS (SELECT steps.*, grp FROM steps JOIN fold USING (document_id, run, k))"""


@query("w12_lines", f"""WITH RECURSIVE {T}, slant AS (SELECT *, (row * 1000 + i // 40) * 200.0::DOUBLE + (i % 40) * 3.0::DOUBLE AS y FROM tok), {fold_sql('slant', 'y', 'x0', 8)},
    l AS (SELECT document_id, dense_rank() OVER (PARTITION BY document_id ORDER BY run, grp) AS line FROM folded) SELECT document_id, line, count(*) AS n FROM l GROUP BY 1, 2""")  # fmt: skip
def w12(spark, d):
    centres = slanted(spark, d).select("document_id", "page", ((F.col("y0") + F.col("y1")) / 2).alias("yc"))
    return layout.lines(centres, 8.0).groupBy("document_id", "line").agg(F.count("*").alias("n"))


@query("w11_blocks", f"WITH {T}, l AS (SELECT document_id, row, min(y0) AS top, max(y0) + 12 AS bottom FROM tok GROUP BY 1, 2), b AS (SELECT *, coalesce((top - lag(bottom) OVER (PARTITION BY document_id ORDER BY top, row) > 15)::INT, 1) AS f FROM l) SELECT document_id, sum(f)::BIGINT AS blocks FROM b GROUP BY 1")
def w11(spark, d):
    rows = tokens(spark, d).groupBy("document_id", "page", F.col("row").alias("line")).agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    return layout.blocks(rows, 15.0).groupBy("document_id").agg(F.max("block").alias("blocks"))


@query("w14_columns", f"""WITH RECURSIVE {T}, placed AS (SELECT *, (x0 + x1) / 2 AS xc FROM tok), {fold_sql('placed', 'xc', 'row', 20)},
    c AS (SELECT document_id, run, grp, avg(xc) AS centre FROM folded GROUP BY 1, 2, 3), a AS (SELECT document_id, count(DISTINCT row) AS n FROM tok GROUP BY 1),
    g AS (SELECT c.document_id, run, grp, count(DISTINCT row) AS lines FROM c JOIN placed p ON p.document_id = c.document_id AND p.xc BETWEEN centre - 20 AND centre + 20 GROUP BY 1, 2, 3)
    SELECT document_id, count(*) AS cols, sum(lines)::BIGINT AS lines FROM g JOIN a USING (document_id) WHERE lines / n >= 0.35 GROUP BY 1""")  # fmt: skip
def w14(spark, d):
    return layout.columns(tokens(spark, d).withColumn("line", F.col("row")), 20.0).groupBy("document_id").agg(F.count("*").alias("cols"), F.sum("lines").alias("lines"))


@query("a28_a29_token_stats", f"WITH {T} SELECT document_id, median(x1 - x0) AS width, min(x0) AS x0, max(x1) AS x1, max(y0) + 12 AS y1, count(*) AS tokens FROM tok GROUP BY 1")
def a28(spark, d):
    return layout.token_stats(tokens(spark, d), ["document_id"]).select("document_id", "width", "x0", "x1", "y1", "tokens")


@query("a27_page_texts", f"WITH {T} SELECT document_id, string_agg(text, ' ' ORDER BY seq) AS text, round(avg(CASE WHEN confidence >= 0 THEN confidence END), 2) AS confidence FROM tok GROUP BY 1")
def a27(spark, d):
    return layout.page_texts(tokens(spark, d)).select("document_id", "text", "confidence")


@query("d25_categories", "SELECT code, CASE WHEN regexp_matches(description, '(?i)room|bed\\s+charge|ward') THEN 'Room Rent' WHEN regexp_matches(description, '(?i)lab|patholog|cbc|test|culture') THEN 'Laboratory' WHEN regexp_matches(description, '(?i)service|admin|registration') THEN 'Service Charges' ELSE 'Miscellaneous' END AS category FROM catalogue", "catalogue")
def d25(spark, d):
    return role(spark, d, "catalogue").select("code", layout.category(F.col("description")).alias("category"))


@query("d26_table_kinds", "SELECT claim_id AS table_id, CASE WHEN max(quantity) >= 25 THEN 'expense' ELSE 'other' END AS kind FROM expenses GROUP BY 1", "expenses")
def d26(spark, d):
    return layout.table_kind(role(spark, d, "expenses").select(F.col("claim_id").alias("table_id"), F.lit("Amount").alias("header"), (F.col("quantity") / 50).alias("numeric")))


@query("d27_amount_cells", "SELECT claim_id AS table_id, seq AS row, max(quantity)::BIGINT::VARCHAR AS amount FROM expenses GROUP BY 1, 2", "expenses")
def d27(spark, d):
    e = role(spark, d, "expenses").groupBy("claim_id", "seq").agg(F.max("quantity").cast("long").alias("q"))
    cells = e.select(F.col("claim_id").alias("table_id"), F.col("seq").alias("row"), F.posexplode(F.array(F.struct(F.lit("Item").alias("header"), F.lit("x").alias("cell")), F.struct(F.lit("Rate").alias("header"), F.lit("1").alias("cell")), F.struct(F.lit("Net").alias("header"), F.col("q").cast("string").alias("cell")))).alias("col", "c"))
    return layout.amount_cells(cells.select("table_id", "row", "col", "c.header", "c.cell"))


@query("d28_d36_d37_expense_rows", f"WITH {T}, n AS (SELECT document_id, row, max(seq) FILTER (regexp_matches(text, '^[₹$]?\\(?[0-9][0-9,]*(?:\\.[0-9]+)?\\)?$')) AS at FROM tok GROUP BY 1, 2) SELECT n.document_id, n.row AS line, regexp_replace(t.text, '[,₹$()]', '', 'g')::DOUBLE AS amount FROM n JOIN tok t ON t.document_id = n.document_id AND t.seq = n.at")
def d28(spark, d):
    return layout.expense_rows(tokens(spark, d).withColumn("line", F.col("row"))).select("document_id", "line", "amount")


@query("d29_region_kinds", f"""WITH {T}, g AS (SELECT document_id, count(DISTINCT row) AS lines, avg((regexp_matches(text, '[0-9]'))::INT) AS numeric, count(*) FILTER (contains(lower(text), 'rs')) AS money, count(*) FILTER (contains(text, ':')) AS colons FROM tok GROUP BY 1)
    SELECT document_id, CASE WHEN numeric >= 0.25 AND money > 0 AND lines >= 3 THEN 'expense_table' WHEN numeric >= 0.2 AND lines >= 3 THEN 'table' WHEN colons >= 0.5 * lines THEN 'form' ELSE 'paragraph' END AS kind FROM g""")  # fmt: skip
def d29(spark, d):
    g = tokens(spark, d).groupBy("document_id").agg(F.countDistinct("row").alias("lines"), F.avg(F.col("text").rlike("[0-9]").cast("int")).alias("numeric"), F.count_if(F.lower("text").contains("rs")).alias("money"), F.count_if(F.col("text").contains(":")).alias("colons"))
    return layout.region_kind(g.withColumn("top", F.lit(0.5))).select("document_id", "kind")


@query("d30_label_values", "SELECT event_id AS document_id, 'Name' AS label, event_type AS value FROM activity", "activity")
def d30(spark, d):
    e = role(spark, d, "activity")
    t = e.select(F.col("event_id").alias("document_id"), F.lit(1).alias("page"), F.lit(1).alias("line"), F.inline(F.array(F.struct(F.lit("Name:").alias("text"), F.lit(0.0).alias("x0"), F.lit(40.0).alias("x1")), F.struct(F.col("event_type").alias("text"), F.lit(50.0).alias("x0"), F.lit(90.0).alias("x1")), F.struct(F.lit("far").alias("text"), F.lit(300.0).alias("x0"), F.lit(330.0).alias("x1")))))
    return layout.label_values(t).select("document_id", "label", "value")


@query("d34_d39_assembled", "SELECT claim_id, count(DISTINCT category) AS kinds, count(*) AS expenses FROM expenses GROUP BY 1", "expenses")
def d34(spark, d):
    e = role(spark, d, "expenses")
    kinds = e.groupBy("claim_id", F.col("category").alias("kind")).agg(F.count("*").alias("n"))
    return layout.assembled(kinds, e.select("claim_id", "amount")).select("claim_id", F.size(F.map_keys("tables")).cast("long").alias("kinds"), "expenses")
