"""Bestseller charts: totals per book number and their roll-up to records that list several numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t


def chart_totals(chart: DataFrame) -> DataFrame:
    """Appearances, first year, best rank and categories of each book number; rows that are none are left out.

    A row counts if its number normalises to 13 characters and year and rank are integers.
    """
    rows = chart.select(t.norm_isbn(F.col("isbn")).alias("isbn"), F.trim(F.col("year").cast("string")).try_cast("int").alias("year"), F.trim(F.col("rank").cast("string")).try_cast("int").alias("rank"), "category")
    rows = rows.where("length(isbn) = 13 AND year IS NOT NULL AND rank IS NOT NULL")
    return rows.groupBy("isbn").agg(F.count("*").alias("appearances"), F.min("year").alias("first_year"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_set("category")).alias("categories"))  # chart categories: a short list


def roll_up(records: DataFrame, totals: DataFrame, *, key: str = "nkc_id", numbers: str = "czech_isbn", dedupe: bool = False) -> DataFrame:
    """Each record's sums over its pipe-joined numbers; records without a hit get 0, nulls and "false".

    An ISBN-10 and its ISBN-13 on one record are two entries of one number, so its appearances count twice;
    ``dedupe`` counts them once.
    """
    parts = records.select(key, F.explode(t.pipe_list(F.coalesce(numbers, F.lit("")))).alias("raw")).select(key, t.norm_isbn(F.col("raw")).alias("isbn"))
    hits = (parts.distinct() if dedupe else parts).join(totals, "isbn").groupBy(key)
    hits = hits.agg(F.sum("appearances").alias("appearances"), F.min("first_year").alias("first_year"), F.min("best_rank").alias("best_rank"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))), "|").alias("categories"))  # a record's numbers
    both = records.select(key).distinct().join(hits, key, "left")
    return both.withColumns({"appearances": F.coalesce("appearances", F.lit(0)), "categories": F.coalesce("categories", F.lit("")), "bestseller": (F.coalesce("appearances", F.lit(0)) >= 1).cast("string")})


def training_rows(rows: DataFrame, *, least_year: int = 2003, least_ratings: int = 10) -> DataFrame:
    """One row per (author, title) of matched records that pass the gates: most appearances, then earliest year.

    Expects nkc_id, norm_author, norm_title, layer, czech_year, first_czech_year, ratings, appearances.
    Ties go to the smaller nkc_id.
    """
    first = F.coalesce("first_czech_year", F.lit(0))
    kept = rows.where((F.col("layer") != "unmatched") & (F.col("czech_year") >= least_year) & ((first == 0) | (first >= least_year)) & (F.col("ratings") >= least_ratings))
    best = F.min_by(F.struct("nkc_id", "czech_year", "appearances"), F.struct(-F.col("appearances"), F.coalesce("czech_year", F.lit(9999)), "nkc_id")).alias("b")
    return kept.groupBy("norm_author", "norm_title").agg(best, F.count("*").alias("n_rows")).select("norm_author", "norm_title", "b.*", "n_rows")
