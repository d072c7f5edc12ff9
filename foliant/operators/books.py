"""Editions of the book community: tolerant reading, indexes, and one row per work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import codes
from foliant.functions import text as t

#: Numbers are declared as text and parsed tolerantly; lists as text because they arrive in several shapes.
BOOK = T.StructType([T.StructField(c, T.StringType()) for c in ["book_id", "work_id", "title", "title_without_series", "isbn13", "ratings_count", "text_reviews_count", "average_rating", "publication_year", "language_code", "is_ebook", "popular_shelves", "authors"]])
_SHELF, _AUTHOR = "array<struct<name:string,count:string>>", "array<struct<author_id:string,role:string>>"


def _list(text, kind: str):
    """An array from JSON text that is a list, a lone object, or either quoted."""
    plain = F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x")).otherwise(text)
    return F.coalesce(F.from_json(F.when(plain.startswith("{"), F.concat(F.lit("["), plain, F.lit("]"))).otherwise(plain), kind), F.array().cast(kind))


def editions(lines: DataFrame, *, text: str = "json_text") -> DataFrame:
    """One row for each JSON line with a book_id; broken lines give none.

    ``shelves`` is array<struct<name, count bigint>>, ``author_ids`` the non-null ids, in order.
    """
    book = F.from_json(F.col(text), BOOK, {"mode": "PERMISSIVE"})
    rows = lines.select("line_no", book.alias("b")).select("line_no", "b.*").where("book_id <> ''")
    shelves = F.transform(F.filter(_list(F.col("popular_shelves"), _SHELF), lambda s: s.isNotNull()), lambda s: F.struct(s["name"].alias("name"), t.parse_int(s["count"]).cast("bigint").alias("count")))
    authors = F.filter(F.transform(_list(F.col("authors"), _AUTHOR), lambda a: a["author_id"]), lambda a: a.isNotNull() & (a != ""))
    return rows.withColumns({
        "ratings": t.parse_int(F.col("ratings_count")),
        "text_reviews": t.parse_int(F.col("text_reviews_count")),
        "pub_year": t.parse_int(F.col("publication_year")),
        "shelves": shelves,
        "author_ids": authors,
    }).drop("popular_shelves", "authors")


def book_index(books: DataFrame) -> DataFrame:
    """book_id, normalised title without series, ratings, year, language, work; of a repeated id the last line."""
    title = F.coalesce(F.nullif("title_without_series", F.lit("")), "title", F.lit(""))
    last = books.groupBy("book_id").agg(F.max(F.struct("line_no", title.alias("title"), "ratings", "pub_year", F.coalesce("language_code", F.lit("")).alias("language_code"), F.coalesce("work_id", F.lit("")).alias("work_id"))).alias("b")).select("book_id", "b.*")
    return last.select("book_id", t.normalize(t.strip_series(F.col("title"))).alias("norm_title"), "ratings", "pub_year", "language_code", "work_id")


def isbn_index(books: DataFrame) -> DataFrame:
    """isbn13 to book_id; of several books the last line's."""
    keyed = books.withColumn("isbn", t.digits13(F.coalesce("isbn13", F.lit("")))).where("isbn <> ''")
    return keyed.groupBy("isbn").agg(F.max_by("book_id", "line_no").alias("book_id"))


def work_books(books: DataFrame) -> DataFrame:
    """The number of different editions of each work, and its first and last id."""
    return books.where("work_id <> ''").groupBy("work_id").agg(F.countDistinct("book_id").alias("n_books"), F.min("book_id").alias("first_book"), F.max("book_id").alias("last_book"))


def author_index(books: DataFrame, authors: DataFrame) -> DataFrame:
    """(book_id, norm_author) of each author with a name; of a repeated author_id the greatest name."""
    names = authors.where("name <> '' AND author_id <> ''").groupBy("author_id").agg(F.max("name").alias("name"))
    pairs = books.select("book_id", F.explode("author_ids").alias("author_id")).distinct().join(names, "author_id")
    return pairs.select("book_id", t.normalize(F.col("name")).alias("norm_author")).where("norm_author <> ''").distinct()


def _works(books: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Sums over each work's editions, and its most rated edition; a book delivered on several lines counts once (its last line)."""
    known = books.where("work_id <> ''")
    named = {b: codes.bucket_count(F.col("shelves"), b) for b in codes.SHELVES}
    title = F.coalesce(F.nullif("title_without_series", F.lit("")), "title", F.lit(""))
    # shelves are counted before the shuffle: seven numbers go through it, not the lists
    slim = known.select("book_id", "line_no", "work_id", title.alias("title"), codes.language_group(F.col("language_code")).alias("language"), "ratings", "text_reviews", "pub_year", *[c.alias(f"n_{b}") for b, c in named.items()])
    rest = [c for c in slim.columns if c not in ("book_id", "line_no")]
    slim = slim.groupBy("book_id").agg(F.max(F.struct("line_no", *rest)).alias("b")).select("book_id", *[F.col(f"b.{c}").alias(c) for c in rest])
    best = F.min_by(F.struct("book_id", "title", "language", *[f"n_{b}" for b in named]), F.struct(-F.col("ratings"), "book_id")).alias("best")
    year = F.min(F.when(F.col("pub_year").between(*years), F.col("pub_year"))).alias("pub_year")
    return slim.groupBy("work_id").agg(F.sum("ratings").cast("bigint").alias("ratings_count"), F.sum("text_reviews").cast("bigint").alias("text_reviews"), F.count("*").alias("n_editions"), year, best)


def _dropped(least_ratings: int, excluded: tuple[str, ...]) -> Column:
    """Why a work is no candidate, the first reason of: ratings, year, language; null if it is one."""
    return F.when(F.col("ratings_count") < least_ratings, "ratings").when(F.col("pub_year").isNull(), "year").when(F.col("best.language").isin(*excluded), "language")


def candidate_pool(books: DataFrame, *, least_ratings: int = 50, years: tuple[int, int] = (1950, 2017), excluded: tuple[str, ...] = ("cze", "slo")) -> DataFrame:
    """One row per work: sums over its editions, and title, language and shelf shares of the most rated one.

    A book delivered on several lines counts once (its last line). Ties of ratings go to the smaller book_id.
    Works below ``least_ratings``, first published outside ``years`` or of an excluded language are left out.
    All aggregates are partial, so a work with very many editions costs one row per map task.
    """
    works = _works(books, years).where(_dropped(least_ratings, excluded).isNull())
    shares = codes.bucket_shares({b: F.col(f"best.n_{b}") for b in codes.SHELVES})
    return works.select("work_id", F.col("best.book_id").alias("rep_book_id"), F.col("best.title").alias("title"), F.col("best.language").alias("language"), "pub_year", "n_editions", "ratings_count", "text_reviews", *[c.alias(f"shelf_{b}") for b, c in shares.items()])


def pool_counts(books: DataFrame, *, least_ratings: int = 50, years: tuple[int, int] = (1950, 2017), excluded: tuple[str, ...] = ("cze", "slo")) -> DataFrame:
    """One row: all works, those dropped by each filter in its turn, those kept."""
    why = _works(books, years).select(_dropped(least_ratings, excluded).alias("why"))
    return why.agg(F.count("*").alias("works"), *[F.count_if(F.col("why") == x).alias(f"dropped_{x}") for x in ("ratings", "year", "language")], F.count_if(F.col("why").isNull()).alias("kept"))
