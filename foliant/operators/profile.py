"""Profiles of tables: frequencies, shares, means, correlations, histograms, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import durable


#: Ranges of scores in which running sums are taken.
SPANS = 64


def frequency(df: DataFrame, value: Column, name: str, *, top: int | None = None) -> DataFrame:
    """Counts of a value, most frequent first, ties by value; only ``top`` of them if given."""
    counts = df.groupBy(value.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return counts.limit(top) if top else counts


def missing_as(text: Column, label: str) -> Column:
    """Lower case, with a label for null and blank."""
    return F.coalesce(F.nullif(F.trim(F.lower(text)), F.lit("")), F.lit(label))


def filled_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: the share of rows that are neither null nor blank, 0 for an empty table."""
    shares = [F.round(F.coalesce(F.avg((F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("double")), F.lit(0.0)), 4).alias(c) for c in columns]
    return df.agg(*shares).unpivot([], columns, "column", "share")


def grouped_rate(df: DataFrame, key: Column, name: str, flag: Column, *, least: int = 1) -> DataFrame:
    """Rows and the share of a condition in each group of at least ``least`` rows."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.round(F.avg(flag.cast("double")), 6).alias("rate")).where(F.col("n") >= least)


def means(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: its mean."""
    return df.agg(*[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in columns]).unpivot([], columns, "column", "mean")


def correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """A row for each column that varies: its Pearson correlation with the target, in one pass."""
    y = F.col(target).cast("double")
    both = lambda c: F.when(c.isNotNull() & y.isNotNull(), c)
    pairs = []
    for c in columns:
        x = F.col(c).cast("double")
        spread = F.stddev_pop(both(x)) * F.stddev_pop(F.when(x.isNotNull(), y))
        pairs.append(F.round(F.try_divide(F.covar_pop(x, y), spread), 6).alias(c))
    return df.agg(*pairs).unpivot([], columns, "column", "correlation").where("correlation IS NOT NULL")


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in ``bins`` bins of equal width between the least and the greatest value; nulls are left out."""
    rows = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.width_bucket("v", "lo", "hi", F.lit(bins)))).otherwise(1)
    return rows.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row


def ranking(df: DataFrame, label: str, score: str, key: list[str], ks: tuple[int, ...] = (50, 100, 250)) -> DataFrame:
    """ROC-AUC, average precision, and precision, recall and lift at each k of a score against a 0/1 label.

    Rows are reduced to counts per score first, so the windows run over distinct scores, in ranges: running
    sums are taken within ranges of scores and joined with the sums of the ranges before. Ties share a rank in the areas; at k
    they are cut by ``key``. Rows with a null label or score are left out.
    """
    rows = df.select(F.col(label).cast("long").alias("y"), F.col(score).cast("double").alias("s"), *key).where("y IS NOT NULL AND s IS NOT NULL")
    at = rows.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    # Ranges hold about as many scores each, whatever their scale: their bounds are approximate quantiles, SPANS numbers on the driver.
    at = durable(at)
    bounds = sorted(set(at.approxQuantile("s", [k / SPANS for k in range(1, SPANS)], 0.5 / SPANS)))
    at = at.withColumn("span", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("s"))) if bounds else F.lit(0))
    spans = at.groupBy("span").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("sq").over(above), F.lit(0)).alias("q0"))
    within = Window.partitionBy("span").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    run = at.join(F.broadcast(spans), "span").withColumns({"pb": F.col("p0") + F.coalesce(F.sum("p").over(within), F.lit(0)), "qb": F.col("q0") + F.coalesce(F.sum("q").over(within), F.lit(0))})
    areas = run.agg(
        F.sum("p").alias("positives"), F.sum("q").alias("negatives"),
        F.sum(F.col("q") * (F.col("pb") + F.col("p") / 2)).alias("pairs"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * (F.col("pb") + F.col("p")) / (F.col("pb") + F.col("p") + F.col("qb") + F.col("q")))).alias("ap"),
    )
    tops = rows.orderBy(F.desc("s"), *key).limit(max(ks))
    place = F.row_number().over(Window.orderBy(F.desc("s"), *key))  # the top max(ks) rows
    hits = tops.withColumn("k", place).agg(*[F.sum(F.when(F.col("k") <= k, F.col("y"))).alias(f"hits_{k}") for k in ks])
    both = areas.crossJoin(hits)  # one row each
    n = F.col("positives") + F.col("negatives")
    out = [F.round(F.col("pairs") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0)), 6).alias("roc_auc"), F.round(F.col("ap") / F.nullif("positives", F.lit(0)), 6).alias("pr_auc")]
    for k in ks:
        size = F.least(F.lit(k), n)
        precision = F.col(f"hits_{k}") / F.nullif(size, F.lit(0))
        out += [F.round(precision, 6).alias(f"precision_{k}"), F.round(F.col(f"hits_{k}") / F.nullif("positives", F.lit(0)), 6).alias(f"recall_{k}"), F.round(precision * n / F.nullif("positives", F.lit(0)), 6).alias(f"lift_{k}")]
    return both.select("positives", "negatives", *out)
