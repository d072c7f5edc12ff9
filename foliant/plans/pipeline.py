"""The whole batch: raw files to catalogue rows, book tables, links, pool, labels, statistics and features.

Each step is a Parquet table under one folder, built when it is missing, so a run that was cut off goes on
where it stopped. ``python -m foliant --help`` lists the commands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import books, cascade, catalogue, charts, dataset, labels
from foliant.sources import readers

REVIEW = "review_id string, book_id string, rating int, review_text string, date_added string"
AUTHOR = "author_id string, name string"
CHART = "year string, week string, category string, rank string, isbn string, author string, title string, publisher string"


@dataclass
class Batch:
    """Paths of the raw files and of the folder for results. Gzip files are spread over ``partitions`` at once."""

    spark: SparkSession
    out: str
    catalogue: str | None = None
    books: str | None = None
    authors: str | None = None
    reviews: str | None = None
    chart: str | None = None
    partitions: int | None = None
    force: bool = False

    def _step(self, name: str, build) -> DataFrame:
        return readers.step(self.spark, f"{self.out}/{name}", build, force=self.force)

    def translations(self, *, limit: int | None = None, min_year: int | None = None) -> DataFrame:
        """Catalogue rows; ``limit`` reads only so many records, for a smoke test.

        A run with ``limit`` or ``min_year`` is a step of another name, so later steps only read the complete table.
        """

        def build() -> DataFrame:
            records = readers.read_catalogue(self.spark, self.catalogue)
            return catalogue.translation_rows(records.limit(limit) if limit is not None else records, min_year=min_year).select(*catalogue.COLUMNS)

        part = "".join(f"-{k}{v}" for k, v in (("limit", limit), ("min", min_year)) if v is not None)
        return self._step(f"translations{part}", build)

    def coverage(self) -> DataFrame:
        return self._step("coverage", lambda: catalogue.inventory(readers.read_catalogue(self.spark, self.catalogue)))

    def editions(self) -> DataFrame:
        def build() -> DataFrame:
            lines = readers.read_text_lines(self.spark, self.books)
            return books.editions(lines.repartition(self.partitions) if self.partitions else lines)

        return self._step("editions", build)

    def author_names(self) -> DataFrame:
        return self._step("author_names", lambda: readers.read_json_lines(self.spark, self.authors, AUTHOR, partitions=self.partitions))

    def details(self) -> DataFrame:
        """Editions in the shape of the edition table: a row for each author, normalised titles."""

        def build() -> DataFrame:
            index = books.book_index(self.editions())
            pairs = self.editions().select("book_id", F.explode_outer("author_ids").alias("author_id")).distinct()
            rows = index.join(pairs, "book_id", "left")
            return rows.select("book_id", "work_id", "norm_title", F.col("ratings").alias("ratings_count"), "pub_year", "language_code", "author_id", F.lit("1970-01-01").cast("timestamp").alias("loaded_at"))

        return self._step("details", build)

    def _books(self) -> tuple[DataFrame, DataFrame]:
        work = F.coalesce(F.nullif("work_id", F.lit("")), F.concat(F.lit("_solo:"), "book_id"))
        facts = self.details().select("book_id", work.alias("work_id"), F.col("norm_title").alias("book_title"), F.col("ratings_count").alias("ratings"), F.nullif("pub_year", F.lit(0)).alias("pub_year"), "language_code").distinct()
        return facts, self._step("book_authors", lambda: books.author_index(self.editions(), self.author_names()))

    def matched(self) -> DataFrame:
        return self._step("matched", lambda: cascade.cascade_keyed(cascade.keyed_records(self.translations()), *self._books()))

    def chart_totals(self) -> DataFrame:
        """Totals of each book number from the chart CSV; none without one."""

        def build() -> DataFrame:
            rows = readers.read_csv(self.spark, self.chart, CHART) if self.chart else self.spark.createDataFrame([], CHART)
            return charts.chart_totals(rows)

        return self._step("chart_totals", build)

    def matched_dataset(self) -> DataFrame:
        """Catalogue columns, match, book metadata and chart sums of every translation."""

        def build() -> DataFrame:
            records = cascade.keyed_records(self.translations())
            return dataset.matched_table(self.translations(), records, cascade.first_year(records), self.matched(), dataset.book_metadata(self.editions()), self.chart_totals())

        return self._step("matched_dataset", build)

    def training(self) -> DataFrame:
        return self._step("training", lambda: dataset.training_table(self.matched_dataset()))

    def funnel(self) -> DataFrame:
        return self._step("funnel", lambda: dataset.funnel(self.matched()))

    def counters(self) -> DataFrame:
        """One row: what the pool's and the training table's filters dropped, and matched works with a Czech year outside the pool."""

        def build() -> DataFrame:
            years = cascade.first_year_of_works(self.matched(), cascade.keyed_records(self.translations()))
            lost = years.join(self.pool().select("work_id"), "work_id", "left_anti").agg(F.count("*").alias("matched_outside_pool"))
            training = dataset.training_counts(self.matched_dataset()).withColumnRenamed("works", "training_works")
            return books.pool_counts(self.editions()).crossJoin(training).crossJoin(lost)  # one row each

        return self._step("counters", build)

    def pool(self) -> DataFrame:
        return self._step("pool", lambda: books.candidate_pool(self.editions()).withColumnsRenamed({"ratings_count": "ratings_count_2017", "text_reviews": "text_reviews_2017"}))

    def labels(self) -> DataFrame:
        def build() -> DataFrame:
            years = cascade.first_year_of_works(self.matched(), cascade.keyed_records(self.translations()))
            return labels.cutoffs(labels.partition(self.pool(), years))

        return self._step("labels", build)

    def stats(self) -> DataFrame:
        def build() -> DataFrame:
            raw = readers.read_json_lines(self.spark, self.reviews, REVIEW, partitions=self.partitions)
            return labels.pre_cutoff_stats(self.labels(), raw, self.details().select("book_id", "work_id", "loaded_at"))

        return self._step("stats", build)

    def features(self) -> DataFrame:
        return self._step("features", lambda: labels.check_split(labels.features(self.labels(), self.stats(), strict=True)))

    def export(self, table: DataFrame, name: str) -> None:
        """A CSV copy of a table, with a header."""
        flat = [c for c, kind in table.dtypes if not kind.startswith(("array", "struct", "map"))]
        readers.write_csv(table, f"{self.out}/{name}.csv", flat)

    def report(self, table: DataFrame, name: str) -> None:
        """A JSON copy of a short table."""
        readers.write_report(table, f"{self.out}/{name}.json")


