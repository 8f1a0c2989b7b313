"""Tokens on pages: lines, blocks, columns, regions, tables, label-value pairs."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = ["document_id", "page"]

#: Row category by keywords, in the order they are tried; room before laboratory (fixed values).
CATEGORIES = (
    ("Room Rent", r"room|bed\s+charge|ward"), ("Nursing", r"nursing"), ("Consultation", r"consult|visit"), ("Surgery / OT", r"surg|operation|theatre|\bot\b"), ("Blood", r"blood"),
    ("USG", r"usg|ultrasound|sonograph"), ("ECG", r"ecg|echo"), ("X-Ray", r"x[\- ]?ray"), ("Laboratory", r"lab|patholog|cbc|test|culture"), ("Injection", r"inj"), ("Tablet", r"tab\b|tablet|capsule"),
    ("Pharmacy", r"pharm|medicine|drug"), ("Consumables", r"consumable|glove|syringe|dressing"), ("Labour / Delivery", r"labou?r|delivery"), ("Diet / Nutrition", r"diet|nutrition"), ("Service Charges", r"service|admin|registration"),
)


def category(description: Column) -> Column:
    """D25."""
    out = F.lit("Miscellaneous")
    for name, pattern in reversed(CATEGORIES):
        out = F.when(description.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def islands(rows: DataFrame, keys: list[str], order: list[str], value: Column, gap: Column | float, name: str) -> DataFrame:
    """Gaps and islands: a new island where the value is more than gap beyond the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.coalesce((value - F.lag(value).over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("__fresh", fresh).withColumn(name, F.sum("__fresh").over(w)).drop("__fresh")


def _folded(tolerance: float):
    """mapInArrow over sorted pages: a new group where a value is beyond the tolerance of its group's mean so far, or unknown."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, group = 0.0, 0, 0
        for rows in batches:
            marks = []
            values = rows.column(rows.schema.get_field_index("__value")).to_numpy(zero_copy_only=False)
            for v, first in zip(values.tolist(), rows.column(rows.schema.get_field_index("__first")).to_pylist(), strict=True):
                if first:
                    total, n, group = 0.0, 0, 1
                elif not abs(v - total / n) <= tolerance:
                    total, n, group = 0.0, 0, group + 1
                total, n = total + v, n + 1
                marks.append(group)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(marks, pa.int64())], [*rows.schema.names, "__group"])

    return fold


def anchored(rows: DataFrame, keys: list[str], order: list[str], tolerance: float, name: str) -> DataFrame:
    """Groups of ascending values, each within the tolerance of the running mean of its group; numbered from 1.

    Each group hangs on the rows before it, so a page is read as one sorted stream: the rows are shuffled and
    sorted once, none are gathered, and three numbers are kept. What a caller doesn't need should be dropped
    first, as it is all shuffled. Equal values of equal order are interchangeable.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    told = rows.withColumn("__first", first).withColumn("__value", F.col(order[0]).cast("double")).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*told.schema.fields, T.StructField("__group", T.LongType())])
    return told.mapInArrow(_folded(tolerance), schema).withColumnRenamed("__group", name).drop("__first", "__value")


def lines(tokens: DataFrame, tolerance: float) -> DataFrame:
    """Adds line, and yc where it isn't there: tokens by centre, each within the tolerance of the mean of its line so far, per document and page."""
    placed = tokens if "yc" in tokens.columns else tokens.withColumn("yc", (F.col("y0") + F.col("y1")) / 2)
    return anchored(placed, PAGE, ["yc"], tolerance, "line")


def blocks(rows: DataFrame, gap: float) -> DataFrame:
    """Adds block: a new one where a line's top is more than gap below the last one's bottom."""
    w = Window.partitionBy(*PAGE).orderBy("top", "line")
    fresh = F.coalesce((F.col("top") - F.lag("bottom").over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("__f", fresh).withColumn("block", F.sum("__f").over(w)).drop("__f")


def _supported(tolerance: float):
    """mapInArrow over pages sorted by centre: each cluster's mean, and how many lines have a centre within the tolerance of it.

    Kept are the centres of the band that an open cluster, or one whose band isn't over, may still need.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, ended, out, page, total, n, begun, group = deque(), deque(), [], None, 0.0, 0, 0.0, 0

        def told(schema: pa.Schema) -> pa.RecordBatch:
            kinds = [*(schema.field(c) for c in PAGE), pa.field("col", pa.int64()), pa.field("centre", pa.float64()), pa.field("lines", pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k.type) for i, k in enumerate(kinds)], schema=pa.schema(kinds))
            out.clear()
            return batch

        def tell(least: float) -> None:
            """Ends the clusters whose bands lie below least, and lets go of what no cluster needs any more."""
            while ended and not abs(least - ended[0][1]) <= tolerance:
                g, mean = ended.popleft()
                out.append((*page, g, mean, len({line for x, line in band if abs(x - mean) <= tolerance})))
            needed = (ended[0][1] if ended else begun) - tolerance
            while band and band[0][0] < needed:
                band.popleft()

        for rows in batches:
            document, number, lines, values, firsts = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in (*PAGE, "line", "xc", "__first"))
            for i, (x, first) in enumerate(zip(values, firsts, strict=True)):
                if first or not abs(x - total / n) <= tolerance:
                    if n:
                        ended.append((group, total / n))
                    if first and n:
                        tell(math.inf)
                        band.clear()
                    page, group, total, n, begun = (document[i], number[i]), 1 if first else group + 1, 0.0, 0, x
                total, n = total + x, n + 1
                if ended:
                    tell(x)
                band.append((x, lines[i]))
            yield told(rows.schema)
        if n:
            ended.append((group, total / n))
            tell(math.inf)
            yield told(rows.schema)

    return fold


def columns(tokens: DataFrame, tolerance: float, support: float = 0.35) -> DataFrame:
    """Column clusters of x-centres, anchored as lines are: col, centre, lines, share.

    A line supports a cluster if it has any centre within the tolerance of the cluster's mean;
    clusters that enough of a page's lines support stay. Centres lie sorted, so those near a mean follow one
    another: they are shuffled once, and no join is made. Tokens without a place aren't columns.
    """
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy("xc")) == 1
    placed = tokens.select(*PAGE, "line", ((F.col("x0") + F.col("x1")) / 2).alias("xc")).where(F.col("xc").isNotNull() & ~F.isnan("xc")).withColumn("__first", first).sortWithinPartitions(*PAGE, "xc")
    kinds = [placed.schema[c] for c in PAGE] + [T.StructField("col", T.LongType()), T.StructField("centre", T.DoubleType()), T.StructField("lines", T.LongType())]
    found = placed.mapInArrow(_supported(tolerance), T.StructType(kinds))
    total = tokens.groupBy(*PAGE).agg(F.countDistinct("line").alias("all"))
    return found.join(total, PAGE).withColumn("share", F.col("lines") / F.col("all")).where(F.col("share") >= support).drop("all")


def token_stats(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Medians, bounding box and counts per group."""
    return tokens.groupBy(*by).agg(
        F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)).alias("height"), F.percentile(F.col("x1") - F.col("x0"), F.lit(0.5)).alias("width"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("tokens"),
    )


def page_texts(tokens: DataFrame) -> DataFrame:
    """Words joined in order and the mean of the confidences that are known, per page."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ")
    return tokens.groupBy(*PAGE).agg(text.alias("text"), F.round(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), 2).alias("confidence"))


def is_number(text: Column) -> Column:
    return text.rlike(r"^[₹$]?\(?[0-9][0-9,]*(?:\.[0-9]+)?\)?$")


def region_kind(regions: DataFrame) -> DataFrame:
    """Kind of each region from its aggregates: tokens, lines, numeric share, money words, colons, page position."""
    c = F.col
    kind = (
        F.when(c("top") < 0.08, "header").when(c("top") > 0.92, "footer").when((c("numeric") >= 0.25) & (c("money") > 0) & (c("lines") >= 3), "expense_table")
        .when((c("numeric") >= 0.2) & (c("lines") >= 3), "table").when(c("colons") >= 0.5 * c("lines"), "form").otherwise("paragraph")
    )
    return regions.withColumn("kind", kind)


def table_kind(columns: DataFrame) -> DataFrame:
    """Kind of a table from its columns' headers and numeric shares."""
    head = F.lower(F.array_join(F.array_sort(F.collect_list("header")), " "))
    rows = columns.groupBy("table_id").agg(head.alias("head"), F.max("numeric").alias("numeric"))
    kind = F.when(F.col("head").rlike("amount|rate|total|charge") & (F.col("numeric") >= 0.5), "expense").when(F.col("head").rlike("dose|frequency|medicine"), "medication").when(F.col("head").rlike("range|result|test"), "lab").when(F.col("head").rlike("pulse|bp|temp"), "vitals").otherwise("other")
    return rows.select("table_id", kind.alias("kind"))


#: Which amount column counts, most wanted first (fixed values).
AMOUNT_HEADERS = ("payable", "net", "gross", "amount", "total", "rate")


def amount_cells(cells: DataFrame) -> DataFrame:
    """Per row the numeric cell of the most wanted amount column, else its last numeric cell."""
    wanted = F.lit(len(AMOUNT_HEADERS))
    for i, word in reversed(list(enumerate(AMOUNT_HEADERS))):
        wanted = F.when(F.lower("header").contains(word), i).otherwise(wanted)
    rows = cells.where(is_number(F.col("cell")))
    return rows.groupBy("table_id", "row").agg(F.min_by("cell", F.struct(wanted, -F.col("col"))).alias("amount"))


def expense_rows(rows: DataFrame) -> DataFrame:
    """Per line the last numeric word is the amount, the rest the description, with its category.

    The amount is told by two numbers a line, so a caller of amounts alone gathers no words.
    """
    place = F.when(is_number(F.col("text")), F.col("seq"))
    amount = F.when(is_number(F.col("text")), F.regexp_replace("text", r"[,₹$()]", "").cast("double"))
    words = F.array_sort(F.collect_list(F.struct("seq", "text")))
    found = rows.groupBy(*PAGE, "line").agg(words.alias("w"), F.max(place).alias("at"), F.max_by(amount, place).alias("amount")).where(F.col("at").isNotNull())
    value = F.filter("w", lambda s: s["seq"] == F.col("at"))[0]["text"]
    rest = F.array_join(F.transform(F.filter("w", lambda s: (s["seq"] != F.col("at")) & (s["text"] != value)), lambda s: s["text"]), " ")
    out = found.select(*PAGE, "line", rest.alias("description"), "amount")
    return out.withColumn("category", category(F.col("description")))


def label_values(tokens: DataFrame, gap: float = 50.0) -> DataFrame:
    """Labels (words that end in a colon) with the words after them, up to a wide gap or the next label."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x0")
    anchor = F.endswith("text", F.lit(":"))
    fresh = anchor | F.coalesce(F.col("x0") - F.lag("x1").over(w) > gap, F.lit(False))
    rows = tokens.withColumn("anchor", anchor).withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(w))
    parts = rows.groupBy(*PAGE, "line", "island").agg(F.max(F.when(F.col("anchor"), F.rtrim(F.regexp_replace("text", ":$", "")))).alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("anchor"), F.struct("x0", "text")))), lambda s: s["text"]), " ").alias("value"))
    return parts.where(F.col("label").isNotNull()).drop("island")


def routed(sections: DataFrame, routes: DataFrame) -> DataFrame:
    """Which sections of a document kind give fields, and which tables."""
    return sections.join(routes, ["doc_kind", "section_type"], "left").withColumn("target", F.coalesce("target", F.lit("none")))


def assembled(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """One nested document per claim: its tables by kind and the computed total."""
    kinds = tables.groupBy("claim_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("tables"))
    total = rows.groupBy("claim_id").agg(F.sum("amount").alias("computed_total"), F.count("*").alias("expenses"))
    return kinds.join(total, "claim_id", "full_outer")
