from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliant.streaming import reviews


def test_counts_grow_with_the_stream(spark, tmp_path):
    t0 = datetime(2017, 1, 1)
    row = lambda i, book, rating, year, n: (f"r{i}", book, rating, f"Sun Jan 01 10:00:00 -0800 {year}", t0 + timedelta(days=n))
    schema = "review_id string, book_id string, rating int, date_added string, loaded_at timestamp"
    folder = str(tmp_path / "r.parquet")
    for n, part in enumerate([[row(1, "a", 5, 2010, 0), row(2, "a", 9, 2010, 0)], [row(1, "a", 5, 2010, 900), row(3, "a", 3, 2010, 1)], [row(4, "b", 1, 2011, -4000), row(5, "b", None, 2011, 2)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        got = reviews.drain(reviews.running_counts(reviews.review_stream(spark, folder, files_per_batch=1)))
        want = spark.read.parquet(folder).where("rating BETWEEN 1 AND 5").dropDuplicates(["review_id"]).groupBy("book_id", F.right("date_added", F.lit(4)).cast("int").alias("year")).agg(F.count("*").alias("n"), F.sum("rating").alias("s"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), n
