"""Matched and training tables, their counters, and what the feature join asserts, on small tables."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import codes
from foliant.operators import books, dataset, labels

MATCHED = "nkc_id string, author string, original_title string, czech_pub_year string, first_czech_year int, match_layer string, matched_book_id string, gr_ratings_count string, chart_appearances long, czech_title string, czech_isbn string, extra string"
ROWS = [
    ("a", "Novák, Jan", "Dům", "2005", 2005, "exact", "b1", "50", 0, None, None, "x"), ("b", "NOVAK, Jan", "dum", "2007", 2005, "title", "b2", "50", 3, None, None, "x"), ("c", "Novák, Jan", "Dům", "2004", 2005, "exact", "b1", "50", 3, None, None, "x"),  # one work
    ("d", None, "T", "2010", 2010, "author", "b3", "10", 0, None, None, ""), ("e", "", "U", "2010", None, "author", "b3", "10.0", 0, None, None, ""),  # without author: by the book
    ("f", "X, Y", "old", "2010", 1999, "exact", "b4", "99", 0, None, None, ""), ("g", "X, Y", "few", "2010", 2010, "exact", "b5", "9", 0, None, None, ""), ("h", "X, Y", "none", "2010", 2010, "exact", "b6", "", 0, None, None, ""),
    ("i", "X, Y", "early", "2002", 2002, "exact", "b7", "99", 0, None, None, ""), ("j", "X, Y", "free", "2010", 2010, "unmatched", None, "99", 0, None, None, ""), ("k", "X, Y", "undated", "", None, "exact", "b8", "99", 0, None, None, ""),
]


def test_training(spark):
    df = spark.createDataFrame(ROWS, MATCHED)
    got = dataset.training_table(df)
    assert got.columns == df.columns and sorted(r.nkc_id for r in got.collect()) == ["c", "d"]
    assert dataset.training_counts(df).first().asDict() == {"candidates": 5, "dropped_first_year": 1, "groups_of_several": 2, "rows_collapsed": 3, "solo": 1, "works": 2}
    empty = df.limit(0)
    assert dataset.training_table(empty).count() == 0 and set(dataset.training_counts(empty).first()) == {0}


def test_funnel(spark):
    df = spark.createDataFrame([("a", "exact"), ("b", "title"), ("c", "unmatched"), ("d", "unmatched")], "nkc_id string, layer string")
    assert {r.measure: (r.n, r.share) for r in dataset.funnel(df).collect()} == {"exact": (1, 0.25), "title": (1, 0.25), "unmatched": (2, 0.5), "matched": (2, 0.5), "records": (4, 1.0)}
    assert dataset.funnel(df.limit(0)).count() == 0


def test_metadata_and_pool_counters(spark):
    lines = [
        (1, '{"book_id":"b1","work_id":"w1","title":"A","ratings_count":"60","publication_year":"1990","language_code":"eng","is_ebook":true,"average_rating":null,"popular_shelves":[{"name":null,"count":"2"}]}'),
        (2, '{"book_id":"b1","work_id":"w1","title":"A","title_without_series":"B","ratings_count":"70","publication_year":"0","language_code":"eng"}'), (3, '{"book_id":"b2","work_id":"w1","title":"C","ratings_count":"5","publication_year":"1991","is_ebook":"TRUE"}'),
        (4, '{"book_id":"b3","work_id":"w2","title":"D","ratings_count":"49","publication_year":"1991"}'), (5, '{"book_id":"b4","work_id":"w3","ratings_count":"50","publication_year":"1900"}'), (6, '{"book_id":"b5","work_id":"w4","ratings_count":"50","publication_year":"2000","language_code":"cs"}'), (7, "broken"), (8, None),
    ]
    editions = books.editions(spark.createDataFrame(lines, "line_no long, json_text string"))
    got = {r.book_id: r for r in dataset.book_metadata(editions).collect()}
    assert (got["b1"].gr_title, got["b1"].gr_pub_year, got["b1"].gr_ratings_count, got["b1"].gr_popular_shelves, got["b1"].gr_is_ebook) == ("B", "", "70", "[]", "false") and got["b2"].gr_is_ebook == "true" and got["b4"].gr_title == ""
    assert books.pool_counts(editions).first().asDict() == {"works": 4, "dropped_ratings": 1, "dropped_year": 1, "dropped_language": 1, "kept": 1}
    assert [r.work_id for r in books.candidate_pool(editions).collect()] == ["w1"]


def test_bloat(spark):
    stats = "work_id string, cutoff_year int, pre_cutoff_ratings_count int, pre_cutoff_avg_rating double, pre_cutoff_reviews_with_text int"
    once, twice = [("w", 2010, 3, 4.0, 1)], [("w", 2010, 3, 4.0, 1), ("w", 2010, 4, 4.0, 1)]
    assert labels.bloat(spark.createDataFrame([*once, *once], stats)).first().asDict() == {"keys": 1, "repeated": 0, "added": 0}
    assert labels.bloat(spark.createDataFrame(twice, stats)).first().asDict() == {"keys": 1, "repeated": 1, "added": 1}
    shelves = ", ".join(f"{c} double" for c in labels.SHELF_COLUMNS)
    rows = spark.createDataFrame([("w", 2010, 1, 2000, "eng", *[0.0] * 7)], f"work_id string, cutoff_year int, translated_cz int, pub_year int, language string, {shelves}")
    assert labels.features(rows, spark.createDataFrame([*once, *once], stats), strict=True).count() == 1
    assert labels.features(rows, spark.createDataFrame(twice, stats)).first().pre_cutoff_ratings_count == 4
    with pytest.raises(Exception, match="several statistics"):
        labels.features(rows, spark.createDataFrame(twice, stats), strict=True).collect()


def test_repeated_reviews(spark):
    """Of a review delivered with several dates the earliest valid one counts; reviews without id all count."""
    date = lambda y: f"Sun Jan 01 10:00:00 -0800 {y}"
    reviews = [("r1", "b", 5, "x", date(2012)), ("r1", "b", 5, "x", date(2009)), ("r1", "b", 5, "x", None), (None, "b", 3, " ", date(2009)), (None, "b", 1, "y", date(2009)), ("r2", "b", 9, "z", date(2009))]
    editions = spark.createDataFrame([("b", "w")], "book_id string, work_id string").withColumn("loaded_at", F.lit("2017-01-01").cast("timestamp"))
    asked = spark.createDataFrame([("w", 2010)], "work_id string, cutoff_year int")
    got = labels.pre_cutoff_stats(asked, spark.createDataFrame(reviews, "review_id string, book_id string, rating int, review_text string, date_added string"), editions).first()
    assert (got.pre_cutoff_ratings_count, got.pre_cutoff_avg_rating, got.pre_cutoff_reviews_with_text) == (3, 3.0, 3)


def test_expected_values_of_the_maps(spark):
    """Written out, since the SQL reads the same maps."""
    pairs = [("eng", "en", "eng"), ("ger", "de", "ger"), ("fre|eng", "fr", "fre|eng"), ("cze", "cs", "cze"), ("lat", "la", "lat"), ("", "", ""), (None, "", ""), ("xyz", "", "xyz"), ("en-GB", "", "eng"), ("scr", "hr", "scr")]
    df = spark.createDataFrame([(a,) for a, *_ in pairs], "x string")
    assert [tuple(r) for r in df.select("x", codes.language_prefix(F.col("x")), codes.language_group(F.col("x"))).collect()] == pairs
    shelves = spark.createDataFrame([([("Sci-Fi", 2), ("true crime", 3), ("chick-lit", 4), ("to-read", 9), ("Young Adult", None)],)], "s array<struct<name:string,count:bigint>>")
    assert shelves.select(*[codes.bucket_count(F.col("s"), b) for b in ("scifi", "nonfiction", "romance", "ya", "fiction")]).first()[:] == (2, 3, 4, 0, 0)
