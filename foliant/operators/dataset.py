"""The matched table, the training table, and what is counted on the way: funnel, drops, collapsed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import catalogue, charts

BOOK_COLUMNS = ["gr_title", "gr_pub_year", "gr_ratings_count", "gr_average_rating", "gr_text_reviews_count", "gr_popular_shelves", "gr_language_code", "gr_is_ebook"]
CHART_COLUMNS = ["chart_appearances", "chart_first_year", "chart_best_rank", "chart_categories", "chart_bestseller"]


def _filled(value: Column) -> Column:
    """As text; null, empty and zero years give an empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def book_metadata(editions: DataFrame) -> DataFrame:
    """``book_id`` and what the matched table says of a book, as text; of a repeated id the last line. Missing values are empty, shelves are JSON."""
    title = F.coalesce(F.nullif("title_without_series", F.lit("")), "title")
    columns = {
        "gr_title": _filled(title), "gr_pub_year": _filled(F.nullif("pub_year", F.lit(0))), "gr_ratings_count": _filled(F.col("ratings_count")), "gr_average_rating": _filled(F.col("average_rating")),
        "gr_text_reviews_count": _filled(F.col("text_reviews_count")), "gr_popular_shelves": F.to_json("shelves", {"ignoreNullFields": "false"}), "gr_language_code": _filled(F.col("language_code")),
        "gr_is_ebook": F.when(F.lower("is_ebook") == "true", "true").otherwise("false"),
    }
    last = F.max(F.struct("line_no", *[c.alias(n) for n, c in columns.items()])).alias("b")
    return editions.groupBy("book_id").agg(last).select("book_id", *[F.col(f"b.{n}").alias(n) for n in columns])


def matched_table(translations: DataFrame, records: DataFrame, first_years: DataFrame, matches: DataFrame, metadata: DataFrame, totals: DataFrame) -> DataFrame:
    """One row for each distinct catalogue row: its columns, its match, the matched book's metadata, its chart sums.

    ``records``, ``first_years`` and ``matches`` are those of the cascade. Only metadata of matched books is joined
    (a semi join first), and records without a match, or whose book the metadata lack, have empty ``gr_`` columns.
    """
    rows = translations.select(*catalogue.COLUMNS).distinct()
    years = records.join(first_years, ["norm_author", "norm_title"], "left").groupBy("nkc_id").agg(F.min(F.coalesce("first_czech_year", "czech_year")).alias("first_czech_year"))
    won = matches.select("nkc_id", F.col("layer").alias("match_layer"), F.col("book_id").alias("matched_book_id"), F.col("work_id").alias("gr_work_id"), F.col("score").alias("fuzzy_score"))
    heavy = metadata.join(won.select(F.col("matched_book_id").alias("book_id")).distinct(), "book_id", "left_semi").withColumnRenamed("book_id", "matched_book_id")
    sums = charts.roll_up(rows, totals).select("nkc_id", *[F.col(c.removeprefix("chart_")).alias(c) for c in CHART_COLUMNS])
    full = rows.join(years, "nkc_id", "left").join(won, "nkc_id", "left").join(heavy, "matched_book_id", "left").join(sums, "nkc_id", "left")
    carried = [c for k in catalogue.COLUMNS for c in ([k, "first_czech_year"] if k == "czech_pub_year" else [k])]
    return full.select(*carried, F.coalesce("match_layer", F.lit("unmatched")).alias("match_layer"), "matched_book_id", "gr_work_id", "fuzzy_score", *[F.coalesce(c, F.lit("")).alias(c) for c in BOOK_COLUMNS], *CHART_COLUMNS)


def _candidates(matched: DataFrame, least_year: int) -> DataFrame:
    """Matched rows with normalised keys; a row without author or title stands alone, under its book."""
    author, title = t.normalize_author(F.col("author")), t.normalize(F.col("original_title"))
    lone = (F.coalesce(author, F.lit("")) == "") | (F.coalesce(title, F.lit("")) == "")
    year = t.parse_number_as_int(F.col("czech_pub_year"))
    rows = matched.where("match_layer <> 'unmatched'").withColumns({"_author": F.when(lone, F.lit("_solo")).otherwise(author), "_title": F.when(lone, F.col("matched_book_id")).otherwise(title), "_year": year, "_solo": lone})
    return rows.where(F.col("_year") >= least_year)


def training_table(matched: DataFrame, *, least_year: int = 2003, least_ratings: int = 10) -> DataFrame:
    """Of the matched table the rows to train on, one for each (author, title): most appearances, then the earliest year, then the smaller nkc_id.

    Kept are rows of an edition and a first edition from ``least_year`` on whose book has ``least_ratings`` or more.
    """
    first = F.coalesce("first_czech_year", F.lit(0))
    kept = _candidates(matched, least_year).where(((first == 0) | (first >= least_year)) & (t.parse_number_as_int(F.col("gr_ratings_count")) >= least_ratings))
    order = F.struct(-F.col("chart_appearances"), "_year", "nkc_id", "czech_title", "czech_isbn")
    return kept.groupBy("_author", "_title").agg(F.min_by(F.struct(*matched.columns), order).alias("b")).select("b.*")


def training_counts(matched: DataFrame, *, least_year: int = 2003, least_ratings: int = 10) -> DataFrame:
    """One row: candidates, those dropped for an older first edition, groups of several rows, rows collapsed, rows that stand alone, rows kept."""
    rows = _candidates(matched, least_year)
    first = F.coalesce("first_czech_year", F.lit(0))
    old = (first > 0) & (first < least_year)
    kept = ~old & (t.parse_number_as_int(F.col("gr_ratings_count")) >= least_ratings)
    groups = rows.groupBy("_author", "_title").agg(F.count_if(old).alias("old"), F.count_if(kept).alias("n"), F.max("_solo").alias("solo"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return groups.agg(
        zero(F.sum("n")).alias("candidates"), zero(F.sum("old")).alias("dropped_first_year"), F.count_if(F.col("n") > 1).alias("groups_of_several"),
        zero(F.sum(F.when(F.col("n") > 1, F.col("n") - 1))).alias("rows_collapsed"), F.count_if(F.col("solo") & (F.col("n") > 0)).alias("solo"), F.count_if(F.col("n") > 0).alias("works"),
    )


def funnel(matches: DataFrame) -> DataFrame:
    """(measure, n, share): the records of each layer, all matched ones (``matched``) and all records (``records``)."""
    counts = matches.groupBy("layer").agg(F.count("*").alias("n"))
    measures = F.array(F.col("layer"), F.when(F.col("layer") != "unmatched", "matched"), F.lit("records"))
    rows = counts.select("n", F.explode(F.array_compact(measures)).alias("measure")).groupBy("measure").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("measure", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))  # one row
