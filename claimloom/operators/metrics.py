"""Distributions of request durations by mergeable sketches, and suggestions by prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a quantile sketch. By the published error of KLL sketches (2.296 / K ** 0.9723), a quantile's rank
#: is within 0.0035 of the wanted one in 99 of 100 cases; RANK_ERROR is the bound that is promised.
K, RANK_ERROR = 800, 0.01


def daily_sketches(rows: DataFrame, by: list[str], time: str, value: str, k: int = K) -> DataFrame:
    """A33, per key and day: n, total, least, most and a sketch of the values. To be stored, and added to day by day.

    A sketch has a few KB whatever the number of rows, and is begun before the shuffle. Null and NaN
    values aren't counted; keys and times may be null. No rows give no sketches.
    """
    v = F.col(value).cast("double")
    known = rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, F.to_date(time).alias("day"), v.alias("value"))
    return known.groupBy(*by, "day").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"),
    )


def rolled_up(sketches: DataFrame, by: list[Column | str], k: int = K) -> DataFrame:
    """Sketches of finer keys or days merged to those of coarser ones; the rows themselves aren't read again."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
    )


def quantiles(sketches: DataFrame, by: list[str], ranks: tuple[float, ...]) -> DataFrame:
    """Per key: n, total, least, most and `at`, an array of the values at the given ranks (0 to 1)."""
    at = F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(p) for p in ranks)))
    return sketches.select(*by, "n", "total", "least", "most", at.alias("at"))


def exact_ranks(rows: DataFrame, found: DataFrame, by: list[str], value: str, ranks: tuple[float, ...]) -> DataFrame:
    """(by, p, value, n, below, upto): how many values are under each found quantile, and how many not over it.

    One pass that counts; the found rows, few and stored, are joined by key, null keys too.
    """
    v = F.col(value).cast("double")
    known = rows.where(v.isNotNull() & ~F.isnan(v)).select(*(F.col(c).alias(f"__{c}") for c in by), v.alias("__v"))
    same = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in by]
    counts = [f(F.col("__v"), F.col("at")[i]) for i in range(len(ranks)) for f in (lambda a, b: F.count_if(a < b), lambda a, b: F.count_if(a <= b))]
    counted = known.join(found.select(*by, "at"), same).groupBy(*by).agg(F.count("*").alias("n"), F.max("at").alias("at"), *(c.alias(f"c{i}") for i, c in enumerate(counts)))
    each = F.array(*(F.struct(F.lit(p).alias("p"), F.col("at")[i].alias("value"), F.col(f"c{2 * i}").alias("below"), F.col(f"c{2 * i + 1}").alias("upto")) for i, p in enumerate(ranks)))
    return counted.select(*by, "n", F.inline(each)).select(*by, "p", "value", "n", "below", "upto")


def near(error: float = RANK_ERROR) -> Column:
    """Whether a rank of a found value is within `error` of the wanted one; equal values share a range of ranks."""
    n = F.col("n")
    return (F.col("below") <= (F.col("p") + error) * n) & (F.col("upto") >= (F.col("p") - error) * n)


def prefix_suggestions(counts: DataFrame, most: int, length: int) -> DataFrame:
    """Of (attribute, value, n) rows, each prefix's `most` values by n (ties: smaller value), with their rank.

    A prefix has 0 to `length` characters in lower case. Counts of one value are added up first. Tasks pass on only their
    own first `most` rows of a prefix, so that one which all values share costs no more than others.
    Null, empty and `N/A` values are no suggestions.
    """
    told = counts.where("value IS NOT NULL AND value NOT IN ('', 'N/A')").groupBy("attribute", "value").agg(F.sum("n").alias("n"))
    lengths = F.sequence(F.lit(0), F.least(F.length("value"), F.lit(length)))
    by_prefix = told.select("attribute", "value", "n", F.explode(lengths).alias("k")).withColumn("prefix", F.lower(F.substr("value", F.lit(1), F.col("k"))))
    order = Window.partitionBy("attribute", "k", "prefix").orderBy(F.desc("n"), "value")
    return by_prefix.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("attribute", "prefix", "rank", "value", "n")
