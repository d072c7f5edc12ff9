"""The prioritised cascade of exact and fuzzy joins between catalogue records and books."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import codes
from foliant.functions import text as t
from foliant.functions.fuzzy import token_set_ratio
from foliant.session import durable

#: Stand-in distance where a year is missing.
FAR = 10_000


def keyed_records(translations: DataFrame) -> DataFrame:
    """record id, normalised author and title, Czech year and wanted language prefix of each distinct record."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = translations.select("nkc_id", *[blank(c).alias(c) for c in ("author", "original_title", "czech_pub_year", "source_lang")]).distinct()
    return rows.select("nkc_id", t.normalize_author(F.col("author")).alias("norm_author"), t.normalize(F.col("original_title")).alias("norm_title"), t.parse_year(F.col("czech_pub_year")).alias("czech_year"), codes.language_prefix(F.col("source_lang")).alias("prefix"))


def keyed_books(editions: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book facts, book to normalised author) from the edition and author tables; the latest row of a book counts."""
    from foliant.operators.point_in_time import latest_rows

    now = latest_rows(editions.select("book_id", "work_id", "norm_title", "ratings_count", "pub_year", "language_code", "author_id", "loaded_at"), "book_id", "loaded_at")
    work = F.coalesce(F.nullif(F.trim("work_id"), F.lit("")), F.concat(F.lit("_solo:"), "book_id"))
    facts = now.select("book_id", work.alias("work_id"), F.coalesce("norm_title", F.lit("")).alias("book_title"), F.coalesce("ratings_count", F.lit(0)).alias("ratings"), F.nullif(F.coalesce("pub_year", F.lit(0)), F.lit(0)).alias("pub_year"), F.coalesce("language_code", F.lit("")).alias("language_code"))
    names = authors.where("name <> ''").select("author_id", t.normalize(F.col("name")).alias("norm_author")).where("norm_author <> ''").distinct()
    return facts, now.select("book_id", "author_id").join(names, "author_id").select("book_id", "norm_author").distinct()


def pick(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """One book per record: the best edition of each work, then the best work.

    Editions: wanted language first, then the nearest year, then more ratings. Works: language, then more
    ratings, then the nearest year. Last comes the higher score and the smaller book_id. The reported
    score is the highest of all candidates. All choices are partial aggregates.
    """
    full = candidates.join(facts, "book_id")
    other = (~codes.language_matches(F.col("language_code"), F.col("prefix"))).cast("int")
    far = F.coalesce(F.abs(F.col("pub_year") - F.col("czech_year")), F.lit(FAR))
    full = full.select("nkc_id", "work_id", "book_id", "score", other.alias("other"), far.alias("far"), (-F.col("ratings")).alias("less"))
    edition = F.min(F.struct("other", "far", "less", (-F.col("score")).alias("down"), "book_id")).alias("e")
    works = full.groupBy("nkc_id", "work_id").agg(edition, F.max("score").alias("score"))
    order = F.struct("e.other", "e.less", "e.far", "e.down", "e.book_id", "work_id")
    best = works.groupBy("nkc_id").agg(F.min(order).alias("w"), F.max("score").alias("score"))
    return best.select("nkc_id", F.col("w.book_id").alias("book_id"), F.col("w.work_id").alias("work_id"), "score")


def exact_layer(records: DataFrame, facts: DataFrame, book_authors: DataFrame) -> DataFrame:
    """Equal author and title."""
    books = facts.where("book_title <> ''").join(book_authors, "book_id").select("book_id", F.col("book_title").alias("norm_title"), "norm_author")
    return pick(records.join(books, ["norm_author", "norm_title"]).select("nkc_id", "czech_year", "prefix", "book_id", F.lit(100).alias("score")), facts)


def title_layer(records: DataFrame, facts: DataFrame, book_authors: DataFrame, least: int) -> DataFrame:
    """Equal author, similar title: distinct title pairs of an author are scored once."""
    books = facts.where("book_title <> ''").join(book_authors, "book_id").select("norm_author", "book_title", "book_id")
    pairs = records.select("norm_author", "norm_title").distinct().join(books.select("norm_author", "book_title").distinct(), "norm_author")
    near = pairs.withColumn("score", token_set_ratio("norm_title", "book_title")).where(F.col("score") >= least)
    found = records.join(near, ["norm_author", "norm_title"]).join(books, ["norm_author", "book_title"])
    return pick(found.select("nkc_id", "czech_year", "prefix", "book_id", "score"), facts)


def author_layer(records: DataFrame, facts: DataFrame, book_authors: DataFrame, least: int) -> DataFrame:
    """Equal title, similar author: the best of a book's authors counts."""
    books = facts.where("book_title <> ''").select("book_id", F.col("book_title").alias("norm_title")).join(book_authors.withColumnRenamed("norm_author", "book_author"), "book_id")
    pairs = records.select("norm_title", "norm_author").distinct().join(books.select("norm_title", "book_author").distinct(), "norm_title")
    near = pairs.withColumn("score", token_set_ratio("norm_author", "book_author")).where(F.col("score") >= least)
    found = records.join(near, ["norm_title", "norm_author"]).join(books, ["norm_title", "book_author"]).groupBy("nkc_id", "czech_year", "prefix", "book_id").agg(F.max("score").alias("score"))
    return pick(found, facts)


def cascade(translations: DataFrame, editions: DataFrame, authors: DataFrame, *, least_title: int = 88, least_author: int = 85) -> DataFrame:
    """``cascade_keyed`` from the tables of records, editions and author names."""
    return cascade_keyed(keyed_records(translations), *keyed_books(editions, authors), least_title=least_title, least_author=least_author)


def cascade_keyed(records: DataFrame, facts: DataFrame, book_authors: DataFrame, *, least_title: int = 88, least_author: int = 85) -> DataFrame:
    """(nkc_id, layer, book_id, work_id, score): the first layer that hits wins; the rest is ``unmatched``.

    Layers: author and title equal; author equal and title similar; title equal and author similar. Records
    without author or title take part in none. Each layer sees only what the layers before left over.
    """
    records, facts, book_authors = durable(records), durable(facts), durable(book_authors)
    open_ = records.where("norm_author <> '' AND norm_title <> ''")
    layers = []
    for name, layer in (("exact", exact_layer), ("title", lambda *a: title_layer(*a, least_title)), ("author", lambda *a: author_layer(*a, least_author))):
        hit = durable(layer(open_, facts, book_authors).withColumn("layer", F.lit(name)))
        layers.append(hit)
        open_ = open_.join(hit, "nkc_id", "left_anti")
    found = reduce(DataFrame.unionByName, layers)
    return records.select("nkc_id").distinct().join(found, "nkc_id", "left").select("nkc_id", F.coalesce("layer", F.lit("unmatched")).alias("layer"), "book_id", "work_id", "score")


def first_year(records: DataFrame) -> DataFrame:
    """The earliest Czech year of each (author, title), over all records, matched or not."""
    full = records.where("norm_author <> '' AND norm_title <> '' AND czech_year IS NOT NULL")
    return full.groupBy("norm_author", "norm_title").agg(F.min("czech_year").alias("first_czech_year"))


def first_year_of_works(matched: DataFrame, records: DataFrame) -> DataFrame:
    """The earliest Czech year of each matched work: the author-and-title year, else the record's own."""
    years = records.join(first_year(records), ["norm_author", "norm_title"], "left").select("nkc_id", F.coalesce("first_czech_year", "czech_year").alias("year"))
    return matched.where("work_id IS NOT NULL").join(years, "nkc_id").where("year IS NOT NULL").groupBy("work_id").agg(F.min("year").alias("first_cz_year"))


