"""Labels and cutoffs, review statistics before the cutoff, and the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.point_in_time import latest_rows, written_year

SHELF_COLUMNS = [f"shelf_{b}" for b in ("fiction", "mystery", "romance", "scifi", "nonfiction", "ya", "classics")]
LANGUAGES = ["eng", "ger", "fre", "spa", "ita", "swe"]
FEATURES = [*SHELF_COLUMNS, "pre_cutoff_ratings_count", "pre_cutoff_avg_rating", "log_pre_cutoff_ratings_count", "log_pre_cutoff_text_reviews", "has_precutoff_signal", "age_at_cutoff", *[f"lang_{g}" for g in LANGUAGES]]


def partition(pool: DataFrame, first_years: DataFrame, *, years: tuple[int, int] = (2008, 2017)) -> DataFrame:
    """The pool with ``first_cz_year`` and ``part``: positive, negative (never matched), before or after."""
    year = F.col("first_cz_year")
    part = F.when(year.isNull(), "negative").when(year < years[0], "before").when(year > years[1], "after").otherwise("positive")
    return pool.join(first_years, "work_id", "left").withColumn("part", part)


def year_distribution(partitioned: DataFrame) -> DataFrame:
    """Years of the positives and their counts: one row for each year of the window."""
    return partitioned.where("part = 'positive'").groupBy(F.col("first_cz_year").alias("y")).agg(F.count("*").alias("n"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone, whatever the partitioning."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cutoffs(partitioned: DataFrame, *, seed: int = 0) -> DataFrame:
    """Positives at their first Czech year; negatives at a year drawn from the positives' distribution.

    A negative's year is drawn among the years after its publication (inverse of the cumulative counts).
    Rows without such a year, and rows published in or after their cutoff, are left out.
    """
    running = Window.orderBy("y")  # a row for each year of the label window
    cumulative = year_distribution(partitioned).withColumn("upto", F.sum("n").over(running))
    table = cumulative.agg(F.array_sort(F.collect_list(F.struct("y", "upto"))).alias("years"), F.sum("n").alias("total"))
    both = partitioned.where("part IN ('positive', 'negative')").crossJoin(F.broadcast(table))  # one row
    before = F.coalesce(F.array_max(F.transform(F.filter("years", lambda x: x["y"] <= F.col("pub_year")), lambda x: x["upto"])), F.lit(0))
    goal = draw(F.col("work_id"), seed) * (F.col("total") - before)
    drawn = F.get(F.filter("years", lambda x: (x["y"] > F.col("pub_year")) & (x["upto"] - before > goal)), F.lit(0))["y"]
    cutoff = F.when(F.col("part") == "positive", F.col("first_cz_year")).otherwise(drawn)
    rows = both.withColumns({"translated_cz": (F.col("part") == "positive").cast("int"), "cutoff_year": cutoff})
    return rows.where("cutoff_year IS NOT NULL AND pub_year < cutoff_year").drop("years", "total", "part", "first_cz_year")


def pre_cutoff_stats(labels: DataFrame, reviews: DataFrame, editions: DataFrame) -> DataFrame:
    """Ratings, mean rating and reviews with text of each (work, cutoff), strictly before the cutoff year.

    Every labelled (work, cutoff) has a row: zeros and a null mean without reviews. A review delivered several
    times counts once, in the earliest year it is validly dated, and each one without id counts. A text is reduced to whether it says
    anything before any shuffle, and reviews to sums per (book, year) before they meet works and cutoffs.
    """
    alone = F.when(F.col("review_id").isNull(), F.monotonically_increasing_id())  # null ids are no repeats of each other
    rated = F.col("rating").between(1, 5)
    text = F.trim(F.coalesce("review_text", F.lit(""))) != ""
    rows = reviews.select("review_id", alone.alias("alone"), "book_id", written_year(F.col("date_added")).alias("year"), F.when(rated, F.col("rating")).alias("r"), text.cast("int").alias("t")).where("year IS NOT NULL")
    rows = rows.groupBy("review_id", "alone").agg(F.min(F.struct("year", "book_id", "r", "t")).alias("x")).select("x.*")
    per_book = rows.groupBy("book_id", "year").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum("t").alias("t"))
    work_of = latest_rows(editions.select("book_id", "work_id", "loaded_at"), "book_id", "loaded_at").where("work_id IS NOT NULL").select("book_id", "work_id")
    per_work = per_book.join(work_of, "book_id").groupBy("work_id", "year").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("t").alias("t"))
    asked = labels.select("work_id", "cutoff_year").distinct()
    hits = asked.join(per_work, "work_id").where("year < cutoff_year").groupBy("work_id", "cutoff_year").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("t").alias("t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    mean = F.when(F.col("n") > 0, F.round(F.col("s") / F.col("n"), 4))
    return asked.join(hits, ["work_id", "cutoff_year"], "left").select("work_id", "cutoff_year", zero("n").alias("pre_cutoff_ratings_count"), mean.alias("pre_cutoff_avg_rating"), zero("t").alias("pre_cutoff_reviews_with_text"))


def bloat(stats: DataFrame) -> DataFrame:
    """One row: the keys (work, cutoff) of the statistics, those with several different rows, and the rows that joining all of them would add."""
    keys = stats.distinct().groupBy("work_id", "cutoff_year").agg(F.count("*").alias("n"))
    return keys.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("added"))


def features(labels: DataFrame, stats: DataFrame, *, impute: float = 3.5, signal: int = 5, strict: bool = False) -> DataFrame:
    """Labels with their statistics and derived features, and the split by cutoff year.

    Repeated rows of either table count once; of several statistics of one (work, cutoff) the greatest row, or with
    ``strict`` an error at run time.
    """
    if strict:
        several = F.count("*").over(Window.partitionBy("work_id", "cutoff_year"))
        stats = stats.distinct().withColumn("_n", several)
        stats = stats.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("several statistics of one work and cutoff")).cast("boolean")).otherwise(True)).drop("_n")
    rest = [c for c in stats.columns if c not in ("work_id", "cutoff_year")]
    one = stats.groupBy("work_id", "cutoff_year").agg(F.max(F.struct(*rest)).alias("s")).select("work_id", "cutoff_year", "s.*")
    rows = labels.distinct().join(one, ["work_id", "cutoff_year"], "left")
    count, text = (F.coalesce(c, F.lit(0)) for c in ("pre_cutoff_ratings_count", "pre_cutoff_reviews_with_text"))
    language = F.lower(F.coalesce("language", F.lit("")))
    split = F.when(F.col("cutoff_year") <= 2015, "train").when(F.col("cutoff_year") == 2016, "val").when(F.col("cutoff_year") == 2017, "test")
    return rows.withColumns({
        "log_pre_cutoff_ratings_count": F.log1p(count),
        "log_pre_cutoff_text_reviews": F.log1p(text),
        "has_precutoff_signal": (count >= signal).cast("int"),
        "pre_cutoff_avg_rating": F.coalesce("pre_cutoff_avg_rating", F.lit(impute)),
        "age_at_cutoff": (F.col("cutoff_year") - F.col("pub_year")).cast("int"),
        **{f"lang_{g}": (language == g).cast("int") for g in LANGUAGES},
        "split": split,
        "pre_cutoff_ratings_count": count.cast("int"),
        "pre_cutoff_reviews_with_text": text.cast("int"),
    })


def feature_columns(table: DataFrame) -> list[str]:
    """The model's features: all columns but identifiers, label, split keys and the raw text count."""
    apart = {"work_id", "rep_book_id", "title", "language", "pub_year", "n_editions", "ratings_count_2017", "text_reviews_2017", "translated_cz", "cutoff_year", "pre_cutoff_reviews_with_text", "split"}
    return [c for c in table.columns if c not in apart]


def check_split(table: DataFrame) -> DataFrame:
    """The table, or an error at run time if a row belongs to no split."""
    return table.withColumn("split", F.when(F.col("split").isNull(), F.raise_error(F.lit("a row belongs to no split"))).otherwise(F.col("split")))
