"""Reviews as a stream: running counts per book and year, for sources that grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.point_in_time import written_year
from foliant.session import shared_folder


def review_stream(spark: SparkSession, path: str, *, files_per_batch: int = 8) -> DataFrame:
    """A folder or file of review Parquet as a stream; the schema is taken from what is there."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return source.option("pathGlobFilter", place.getName()).parquet(str(place.getParent()))  # streams read folders
    return source.parquet(path)


def running_counts(reviews: DataFrame, *, late: str = "36500 days") -> DataFrame:
    """Ratings per book and written year of a stream, each review counted once.

    Reviews may be delivered again at any time, so the state of seen ids has the long horizon ``late`` on the
    arrival time; shorten it where the source bounds its delays.
    """
    rated = reviews.where(F.col("rating").between(1, 5)).withColumn("year", written_year(F.col("date_added"))).where("year IS NOT NULL")
    once = rated.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["review_id"])
    return once.groupBy("book_id", "year").agg(F.count("*").alias("n"), F.sum("rating").alias("s"))


def drain(stream: DataFrame, *, keys: tuple[str, ...] = ("book_id", "year")) -> DataFrame:
    """The state of an aggregated stream after everything that is available now.

    Each micro-batch writes only the groups that it changed, as a part of a table in the shared folder, from the
    executors; of each group the part of the latest batch counts. Nothing passes through the driver.
    """
    place = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/state/batch={number}")
    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    parts = stream.sparkSession.read.schema(schema).option("basePath", f"{place}/state").parquet(f"{place}/state")
    rest = [c for c in stream.columns if c not in keys]
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
