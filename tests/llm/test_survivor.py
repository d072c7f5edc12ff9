from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.llm import survivor as k

SCHEMA = "book_id string, work_id string, norm_title string, ratings_count int, pub_year int, language_code string, author_id string, loaded_at timestamp, field string, votes int"


def day(n):
    return datetime(2017, 1, 1) + timedelta(days=n)


def edition(book, work, count, year, code, loaded=0, title="t"):
    return (book, work, title, count, year, code, None, day(loaded), "clash", 1)


def test_found(spark, rows):
    data = [
        edition("b2", "w", 9, 1700, "mul"), edition("b1", "w", 9, None, " "), edition("b3", "w", 5, 2017, "en"), edition("b4", "w", None, 1800, "de"), edition("b5", "w", -4, 1900, None), edition("b5", "w", -4, 1900, None),
        edition("x1", "x", 1, 2000, "en", 0), edition("x1", "x", 7, 2018, "--", 5), edition("x2", "x", 3, 0, "und"),  # the later row counts
        edition("y1", "y", 1, 2000, "en"), edition("y1", "y", 1, 2000, "en", 3),  # one book only
        edition("m1", "old", 1, 2000, "en", 0), edition("m1", "new", 1, 2000, "en", 1), edition("m2", "new", 0, 2000, "en"), edition("m3", "old", 0, 2000, "en"),
        edition("z1", " ", 1, 2000, "en"), edition("z2", " ", 1, 2000, "en"), edition("z3", None, 1, 2000, "en"), edition(None, "w", 99, 2000, "en"),
    ]
    got = rows(k.found(spark.createDataFrame(data, SCHEMA)))
    assert got == sorted([("w", "record", "b1"), ("w", "language_code", "b3"), ("w", "pub_year", "b3"), ("x", "record", "x1"), ("new", "record", "m1"), ("new", "language_code", "m1"), ("new", "pub_year", "m1")], key=repr)
    assert k.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_votes_add_up_and_decay(spark):
    data = [("a", "g", "x", 3.0, day(0)), ("b", "g", "y", 2.0, day(0)), ("c", "g", "y", 2.0, day(0)), ("d", "g", None, 9.0, day(100)), ("e", "h", None, 1.0, day(0))]
    df = spark.createDataFrame(data, "id string, g string, v string, trust double, at timestamp")
    fields = {"v": k.Field(F.col("v"), F.col("v").isNotNull(), F.col("trust"))}
    elect = lambda **x: {r.g: r for r in k.elect(df, entity="g", record="id", loaded_at="at", fields=fields, **x).collect()}
    assert (elect()["g"].v, elect()["g"].v_votes, elect()["g"].v_record, elect()["g"].n_records) == ("y", 4.0, "b", 4)
    assert elect(per_record=True)["g"].v == "x"
    assert elect()["h"].v is None
    old = elect(half_life_days=100.0)["g"]
    assert old.v == "y" and abs(old.v_votes - 2.0) < 1e-6


def test_golden_runs_on_all(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/goodreads_book_details.parquet")
    assert k.golden(df).count() == df.where("trim(work_id) <> ''").select("work_id").distinct().count()


@pytest.mark.parametrize("hot", [300])
def test_hot_group(spark, hot):
    data = [edition(f"b{i:05d}", "hot", i, 2000, "en") for i in range(hot)]
    got = k.found(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.book_id for r in got} == {f"b{hot - 1:05d}"} and len(got) == 3
