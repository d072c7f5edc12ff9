"""Problem 6: every event joined with what was known at its time, and nothing that became known later.

The current state of each entity is a sequence of versions ordered by when they became available.
Entities (and, of long histories, segments of time) are hashed to buckets, and each bucket runs an
embedded DuckDB ``ASOF LEFT JOIN``. Versions of one entity with the same availability are resolved
before, so that the join never meets a tie.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.session import durable

#: The form of review dates is fixed: "Sun Dec 31 23:30:00 -0800 2016".
DATE_FORM = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{1,2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4}$"
DATE_PATTERN = "MMM d HH:mm:ss Z yyyy"


def written_year(date: Column) -> Column:
    """The year written in a date of the fixed form, in its own offset; null if the date is none.

    Null, empty, differently formed and impossible dates (30 February, 25 o'clock) give null. The instant
    is only a test of validity: its year in UTC may differ from the written one.
    """
    date = F.trim(date)
    form = F.when(date.rlike(DATE_FORM), date)
    sound = F.try_to_timestamp(F.substring(form, 5, 40), F.lit(DATE_PATTERN)).isNotNull()
    return F.when(sound, F.right(form, F.lit(4)).cast("int"))


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per non-null ``key``: of the latest ``order``; ties go to the greatest row by all columns.

    A hot key costs one row per map task: the choice is a partial aggregate (``max`` of a struct).
    """
    rest = [c for c in df.columns if c not in (key, order)]
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in [order, *rest]])


def resolve_versions(versions: DataFrame, entity: str, available_at: str, prefer: list[str]) -> DataFrame:
    """One version per (entity, availability): the greatest by ``prefer``, then by the other columns.

    Rows whose entity or availability is null are no versions and are left out.
    """
    rest = [*prefer, *[c for c in versions.columns if c not in (entity, available_at, *prefer)]]
    known = versions.where(F.col(entity).isNotNull() & F.col(available_at).isNotNull())
    best = known.groupBy(entity, available_at).agg(F.max(F.struct(*[F.col(c) for c in rest])).alias("_best"))
    return best.select(entity, available_at, *[F.col(f"_best.{c}").alias(c) for c in versions.columns if c not in (entity, available_at)])


@lru_cache(maxsize=1)
def _database():
    """One in-memory database for each Python worker; beyond its memory it fails rather than spill to the machine's disk."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def point_in_time_join(
    events: DataFrame,
    versions: DataFrame,
    *,
    entity: str,
    at: str,
    available_at: str,
    values: list[str],
    prefer: list[str] | None = None,
    segment_width: int = 64,
    buckets: int | None = None,
    bucket_rows: int = 50_000,
) -> DataFrame:
    """``events`` with ``values`` of the latest version available strictly before the event.

    Every event row comes out once, with nulls where nothing was known (also if its entity or time is
    null). ``at`` and ``available_at`` are whole numbers (years, days, epoch seconds). Time is cut into
    segments of ``segment_width`` units, and bucket = hash(entity, segment), so an entity whose history is longer than that
    is spread over its segments; the state at the start of a segment is carried into it. ``buckets`` is the number of
    hash buckets, by default one for each ``bucket_rows`` rows of both sides. Names of ``values`` must differ
    from the events' columns; other columns of ``versions`` may clash and are not read.
    """
    clash = set(values) & set(events.columns)
    if clash:
        raise ValueError(f"events already have the columns {sorted(clash)}")
    segment = lambda c: F.floor(F.col(c) / segment_width).cast("long")
    prefer = prefer or []
    state = resolve_versions(versions.select(entity, available_at, *dict.fromkeys([*prefer, *values])), entity, available_at, prefer)
    state = durable(state.select(F.col(entity).alias("_e"), F.col(available_at).cast("long").alias("_t"), F.struct(*values).alias("_v")).withColumn("_s", F.floor(F.col("_t") / segment_width).cast("long")))
    n = buckets or max(1, ceil((state.count() + events.count()) / bucket_rows))

    known = F.col(entity).isNotNull() & F.col(at).isNotNull()
    asked = events.where(known).select(F.col(entity).alias("_e"), segment(at).alias("_s")).distinct()
    ends = state.groupBy("_e", "_s").agg(F.max(F.struct("_t", "_v")).alias("_last"))
    # A row per (entity, segment): at most the number of segments in an entity's history.
    grid = ends.unionByName(asked.withColumn("_last", F.lit(None).cast(ends.schema["_last"].dataType)))
    grid = grid.groupBy("_e", "_s").agg(F.max("_last").alias("_last"), F.max(F.col("_last").isNull()).alias("_asked"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("_e").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    carried = grid.withColumn("_c", before).where(F.col("_asked") & F.col("_c").isNotNull()).select("_e", "_s", F.col("_c._t").alias("_t"), F.col("_c._v").alias("_v"))

    bucket = F.pmod(F.xxhash64("_e", "_s"), F.lit(n)).alias("_b")
    right = state.select("_e", "_s", "_t", "_v").unionByName(carried).select(bucket, "_e", "_s", "_t", "_v.*")
    left = events.where(known).withColumns({"_e": F.col(entity), "_s": segment(at), "_at": F.col(at).cast("long")})
    left = left.select(bucket, *left.columns)
    kinds = {f.name: f for f in state.schema["_v"].dataType.fields}
    out = T.StructType([*events.schema.fields, *[T.StructField(v, kinds[v].dataType, True) for v in values]])
    names = events.columns

    def asof(l: pa.Table, r: pa.Table) -> pa.Table:
        db = _database()
        db.register("l", l)
        db.register("r", r)
        cols = ", ".join([f'l."{c}"' for c in names] + [f'r."{v}"' for v in values])
        try:
            return db.sql(f"SELECT {cols} FROM l ASOF LEFT JOIN r ON l._e = r._e AND l._s = r._s AND l._at > r._t").to_arrow_table()
        finally:
            db.unregister("l")
            db.unregister("r")

    joined = left.groupBy("_b").cogroup(right.groupBy("_b")).applyInArrow(asof, out)
    unknown = events.where(~known)
    return joined.unionByName(unknown.withColumns({v: F.lit(None).cast(kinds[v].dataType) for v in values}))


def review_history(reviews: DataFrame, editions: DataFrame) -> DataFrame:
    """The state of each work after each year of reviews: ``work_id, year, n_ratings``.

    A review counts once per work, in the earliest year it is dated, if its rating is from 1 to 5 and its
    date valid. An edition belongs to the work of its latest row; reviews of unknown books and of editions
    outside any work are left out. Reviews are reduced to counts per book and year before they meet the
    editions, so that a hot book doesn't make a hot join key; the few review_ids seen under several books
    take their own exact way.
    """
    year = written_year(F.col("date_added"))
    valid = reviews.select("review_id", "book_id", "rating", "date_added").where(F.col("rating").between(1, 5)).select("review_id", "book_id", year.alias("year"))
    valid = valid.where(F.col("year").isNotNull() & F.col("review_id").isNotNull() & F.col("book_id").isNotNull())
    each = valid.groupBy("review_id").agg(
        F.min("year").alias("year"),
        F.min("book_id").alias("book_id"),
        F.max("book_id").alias("other"),
        F.collect_set(F.struct("book_id", "year")).alias("all"),
    )
    work_of = latest_rows(editions.select("book_id", "work_id", "loaded_at"), "book_id", "loaded_at").where(F.trim("work_id") != "").select("book_id", "work_id")
    # shared: the id of a review of several books; such a review keeps its id until its books' works are known
    shared = F.when(F.col("book_id") != F.col("other"), F.col("review_id"))
    books = F.when(shared.isNull(), F.array(F.struct("book_id", "year"))).otherwise(F.col("all"))
    per_book = each.select(shared.alias("shared"), F.explode(books).alias("x")).groupBy("x.book_id", "x.year", "shared").agg(F.count("*").alias("n"))
    per_work = per_book.join(work_of, "book_id").groupBy("work_id", "shared", F.when(F.col("shared").isNull(), F.col("year")).alias("own")).agg(F.min("year").alias("year"), F.sum("n").alias("n"))
    per_year = per_work.groupBy("work_id", "year").agg(F.sum(F.when(F.col("shared").isNull(), F.col("n")).otherwise(1)).alias("n"))
    # At most one row for each year of the calendar in a window.
    running = Window.partitionBy("work_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return per_year.select("work_id", "year", F.sum("n").over(running).alias("n_ratings"))


def leaking_stats(stats: DataFrame, reviews: DataFrame, editions: DataFrame) -> DataFrame:
    """(work_id, cutoff_year) of stats rows that count more ratings than were known before the cutoff."""
    asked = stats.where(F.col("pre_cutoff_ratings_count").isNotNull()).select("work_id", "cutoff_year", "pre_cutoff_ratings_count").distinct()
    known = point_in_time_join(asked, review_history(reviews, editions), entity="work_id", at="cutoff_year", available_at="year", values=["n_ratings"], segment_width=16)
    more = F.col("pre_cutoff_ratings_count") > F.coalesce("n_ratings", F.lit(0))
    return known.where(more & F.col("work_id").isNotNull() & F.col("cutoff_year").isNotNull()).select("work_id", "cutoff_year").distinct()
