import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.operators import point_in_time as p


def test_written_year(spark):
    dates = ["Sun Dec 31 23:30:00 -0800 2016", "Mon Jan 01 00:10:00 +0200 2017", "Fri Feb 30 10:00:00 -0800 2015", "", None, "Mon Jan 01 25:10:00 +0200 2017", "Xxx Jan 01 00:10:00 +0200 2017", "2017-01-01", " Sun Dec 31 23:30:00 -0800 2016 ", "Thu Feb 29 01:00:00 +0000 2015", "Thu Feb 29 01:00:00 +0000 2012"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, d string").select("i", p.written_year(F.col("d")).alias("y")).orderBy("i")
    assert [r.y for r in df.collect()] == [2016, 2017, None, None, None, None, None, None, 2016, None, 2012]


def brute(events, versions):
    out = []
    for i, e, at in events:
        known = [(t, v) for k, t, v in versions if e is not None and at is not None and k == e and t is not None and t < at]
        out.append((i, e, at, max(known, key=lambda x: (x[0], x[1] if x[1] is not None else -1))[1] if known else None))
    return out


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_join_against_brute_force(spark, rows, width):
    random.seed(width)
    names = [None, "a", "b", "c"]
    # a third of the events is of one entity, there are ties, nulls and repeated rows
    events = [(i, "hot" if i % 3 == 0 else random.choice(names), random.choice([None, *range(-20, 60)])) for i in range(400)] + [(1000, "a", 5)] * 2
    versions = [(random.choice([*names, "hot", "hot"]), random.choice([None, *range(-30, 50)]), random.choice([None, *range(9)])) for _ in range(300)]
    e = spark.createDataFrame(events, "id int, k string, at int")
    v = spark.createDataFrame([(*x, "noise") for x in versions], "k string, since int, value int, at string")  # a clashing name that isn't read
    got = p.point_in_time_join(e, v, entity="k", at="at", available_at="since", values=["value"], prefer=["value"], segment_width=width)
    assert rows(got) == sorted(brute(events, versions), key=repr)


def test_join_edges(spark):
    e = spark.createDataFrame([(1, "a", 5)], "id int, k string, at int")
    v = spark.createDataFrame([("a", 5, 1)], "k string, since int, value int")
    join = lambda x, y, **k: p.point_in_time_join(x, y, entity="k", at="at", available_at="since", values=["value"], **k)
    assert [tuple(r) for r in join(e, v).collect()] == [(1, "a", 5, None)]  # known only at the event's time: not before it
    assert [tuple(r) for r in join(e, v.limit(0)).collect()] == [(1, "a", 5, None)]
    assert join(e.limit(0), v).count() == 0
    with pytest.raises(ValueError, match="value"):
        join(e.withColumn("value", F.lit(1)), v)


def day(n):
    return datetime(2017, 1, 1) + timedelta(days=n)


EDITIONS = "book_id string, work_id string, loaded_at timestamp"
REVIEWS = "review_id string, book_id string, rating int, date_added string"


def review(i, book, rating, year):
    return (i, book, rating, f"Sun Jan 01 10:00:00 -0800 {year}")


def test_leaking_stats(spark, rows):
    editions = spark.createDataFrame([("b1", "old", day(0)), ("b1", "w", day(1)), ("b2", "w", day(0)), ("b3", " ", day(0)), (None, "w", day(0)), ("b4", "v", day(0))], EDITIONS)
    reviews = spark.createDataFrame(
        [review("r1", "b1", 5, 2010), review("r1", "b1", 5, 2010), review("r2", "b2", 1, 2011), review("r3", "b2", 0, 2010), review("r4", "b2", None, 2010), review("r5", "b3", 3, 2010), review("r6", "zz", 3, 2010), review("r7", "b1", 3, 2012),
         ("r8", "b1", 4, "Fri Feb 30 10:00:00 -0800 2010"), ("r9", "b1", 4, None), review(None, "b1", 4, 2010), review("s", "b1", 4, 2011), review("s", "b2", 4, 2010), review("s", "b4", 4, 2014)],
        REVIEWS,
    )
    history = rows(p.review_history(reviews, editions))
    assert history == [("v", 2014, 1), ("w", 2010, 2), ("w", 2011, 3), ("w", 2012, 4)]  # s counts once for w, in 2010, and once for v
    stats = spark.createDataFrame([("w", 2011, 2), ("w", 2012, 4), ("w", 2012, 4), ("w", 2010, 1), ("w", 2013, 3), ("w", 2014, None), ("unknown", 2015, 0), ("unknown", 2016, 1), (None, 2011, 9)], "work_id string, cutoff_year int, pre_cutoff_ratings_count int")
    assert rows(p.leaking_stats(stats, reviews, editions)) == [("unknown", 2016), ("w", 2010), ("w", 2012)]
    assert rows(p.leaking_stats(stats, reviews.limit(0), editions.limit(0))) == [("unknown", 2016), ("w", 2010), ("w", 2011), ("w", 2012), ("w", 2013)]
    assert rows(p.leaking_stats(stats.limit(0), reviews, editions)) == []


def test_plan_reads_reviews_once(spark):
    d = "/root/testdata/sf0.001"
    df = p.review_history(spark.read.parquet(f"{d}/goodreads_reviews_dedup.parquet"), spark.read.parquet(f"{d}/goodreads_book_details.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("goodreads_reviews_dedup") == 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "review_text" not in plan
