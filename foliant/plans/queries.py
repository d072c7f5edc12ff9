"""Registered queries of the core: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import codes
from foliant.functions import text as t
from foliant.operators import books, cascade, catalogue, charts, dataset, labels, models, nested, point_in_time, profile
from foliant.plans.oracle import SQL
from foliant.session import table
from foliant.sources import readers
from foliant.streaming import reviews as review_stream

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    fields = nested.flatten_fields(table(spark, d, "nkc_records"), ["041", "765"], source="nkc_records")
    lists = nested.flatten_json(table(spark, d, "goodreads_books_raw"), {"popular_shelves": "name", "authors": "author_id"}, source="goodreads_books_raw")
    return fields.unionByName(lists)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return point_in_time.leaking_stats(table(spark, d, "pre_cutoff_stats"), table(spark, d, "goodreads_reviews_dedup"), table(spark, d, "goodreads_book_details"))


def p6_known_at_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Each labelled work and cutoff with the number of ratings known before the cutoff."""
    labels = table(spark, d, "translation_labels").select("work_id", "cutoff_year", "translated_cz").distinct()
    history = point_in_time.review_history(table(spark, d, "goodreads_reviews_dedup"), table(spark, d, "goodreads_book_details"))
    return point_in_time.point_in_time_join(labels, history, entity="work_id", at="cutoff_year", available_at="year", values=["n_ratings"])


# ---- catalogue


def catalogue_rows(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.translation_rows(table(spark, d, "nkc_records")).select("line_no", *catalogue.COLUMNS)


def catalogue_inventory(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.inventory(table(spark, d, "nkc_records"))


def source_language_top20(spark: SparkSession, d: str) -> DataFrame:
    rows = catalogue.translation_rows(table(spark, d, "nkc_records"))
    return profile.frequency(rows.select(F.explode(t.pipe_list(F.col("source_lang"))).alias("x")), F.col("x"), "lang", top=20)


def publication_years(spark: SparkSession, d: str) -> DataFrame:
    rows = catalogue.translation_rows(table(spark, d, "nkc_records")).where("czech_pub_year <> ''")
    return rows.groupBy(F.col("czech_pub_year").cast("int").alias("year")).agg(F.count("*").alias("n")).orderBy("year")


def subfield_values(spark: SparkSession, d: str) -> DataFrame:
    """All values of two multi-valued fields, and the first of another, per record."""
    f = F.col("datafield")
    return table(spark, d, "nkc_records").select("line_no", F.array_join(catalogue.values(f, "655", "a"), "|").alias("genres"), F.size(catalogue.instances(f, "700")).alias("n_700"), catalogue.first_value(f, "245", "a").alias("title"))


# ---- books of the community


def book_index(spark: SparkSession, d: str) -> DataFrame:
    return books.book_index(books.editions(table(spark, d, "goodreads_books_raw")))


def isbn_index(spark: SparkSession, d: str) -> DataFrame:
    return books.isbn_index(books.editions(table(spark, d, "goodreads_books_raw")))


def work_books(spark: SparkSession, d: str) -> DataFrame:
    return books.work_books(books.editions(table(spark, d, "goodreads_books_raw")))


def author_index(spark: SparkSession, d: str) -> DataFrame:
    return books.author_index(books.editions(table(spark, d, "goodreads_books_raw")), table(spark, d, "goodreads_author_names"))


def pool_of_works(spark: SparkSession, d: str) -> DataFrame:
    return books.candidate_pool(books.editions(table(spark, d, "goodreads_books_raw")))


def pool_of_rare_works(spark: SparkSession, d: str) -> DataFrame:
    """The pool with a lower threshold of ratings."""
    return books.candidate_pool(books.editions(table(spark, d, "goodreads_books_raw")), least_ratings=5)


def pool_counters(spark: SparkSession, d: str) -> DataFrame:
    return books.pool_counts(books.editions(table(spark, d, "goodreads_books_raw")))


def book_metadata(spark: SparkSession, d: str) -> DataFrame:
    return dataset.book_metadata(books.editions(table(spark, d, "goodreads_books_raw")))


# ---- matching


def _records(spark: SparkSession, d: str) -> DataFrame:
    return cascade.keyed_records(table(spark, d, "nkc_translations"))


def _books(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cascade.keyed_books(table(spark, d, "goodreads_book_details"), table(spark, d, "goodreads_author_names"))


def record_keys(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)


def match_exact(spark: SparkSession, d: str) -> DataFrame:
    facts, authors = _books(spark, d)
    return cascade.exact_layer(_records(spark, d).where("norm_author <> '' AND norm_title <> ''"), facts, authors).select("nkc_id", "book_id", "work_id")


def match_cascade(spark: SparkSession, d: str) -> DataFrame:
    return cascade.cascade(table(spark, d, "nkc_translations"), table(spark, d, "goodreads_book_details"), table(spark, d, "goodreads_author_names"))


def match_layers(spark: SparkSession, d: str) -> DataFrame:
    return match_cascade(spark, d).groupBy("layer").agg(F.count("*").alias("n"))


def first_czech_year(spark: SparkSession, d: str) -> DataFrame:
    return cascade.first_year(_records(spark, d))


def match_funnel(spark: SparkSession, d: str) -> DataFrame:
    return dataset.funnel(match_cascade(spark, d))


def matched_dataset(spark: SparkSession, d: str) -> DataFrame:
    """All catalogue rows with match, metadata and charts (each record with a year stands in for a chart row of its numbers)."""
    translations, records = table(spark, d, "nkc_translations"), _records(spark, d)
    numbers = translations.distinct().select(F.explode(t.pipe_list(F.col("czech_isbn"))).alias("isbn"), t.parse_year(F.col("czech_pub_year")).alias("year"), (F.length("czech_title") % 50 + 1).alias("rank"), F.coalesce("source_lang", F.lit("")).alias("category"))
    totals = charts.chart_totals(numbers.where("year BETWEEN 2003 AND 2017"))
    return dataset.matched_table(translations, records, cascade.first_year(records), match_cascade(spark, d), book_metadata(spark, d), totals)


def training_dataset(spark: SparkSession, d: str) -> DataFrame:
    return dataset.training_table(matched_dataset(spark, d))


def training_counters(spark: SparkSession, d: str) -> DataFrame:
    return dataset.training_counts(matched_dataset(spark, d))


def matched_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the matched books, by a semi join with the winners."""
    facts, _ = _books(spark, d)
    return facts.join(match_cascade(spark, d), "book_id", "left_semi")


def unmatched_works(spark: SparkSession, d: str) -> DataFrame:
    """Works of the pool that no record matches."""
    return table(spark, d, "candidate_pool").select("work_id").distinct().join(match_cascade(spark, d), "work_id", "left_anti")


def matched_outside_pool(spark: SparkSession, d: str) -> DataFrame:
    """Matched works with a Czech year that are not in the pool: positives lost to its filters."""
    years = cascade.first_year_of_works(match_cascade(spark, d), _records(spark, d))
    return years.join(table(spark, d, "candidate_pool").select("work_id").distinct(), "work_id", "left_anti")


# ---- charts: reviews stand in for chart rows (rank = rating, category = language of the edition)


def _chart(spark: SparkSession, d: str) -> DataFrame:
    raw = books.editions(table(spark, d, "goodreads_books_raw")).where("isbn13 <> ''").select("book_id", F.col("isbn13").alias("isbn"), F.coalesce("language_code", F.lit("")).alias("category"))
    rows = table(spark, d, "goodreads_reviews_dedup").dropDuplicates(["review_id"]).select("book_id", F.col("rating").alias("rank"), point_in_time.written_year(F.col("date_added")).alias("year"))
    return rows.join(raw.distinct(), "book_id")


def chart_totals(spark: SparkSession, d: str) -> DataFrame:
    return charts.chart_totals(_chart(spark, d)).withColumn("categories", F.array_join("categories", "|"))


def chart_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Works that list the numbers of their editions, with the sums over them."""
    raw = books.editions(table(spark, d, "goodreads_books_raw")).where("work_id <> '' AND isbn13 <> ''")
    works = raw.groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_list("isbn13")), "|").alias("numbers"))
    return charts.roll_up(works, charts.chart_totals(_chart(spark, d)), key="work_id", numbers="numbers")


def chart_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chart rows read back from pages: a page for each record, with a row for each of its numbers and short rows between."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = lambda i: F.concat(F.lit("<tr>"), cell(esc(i)), cell(esc(F.col("author"))), cell(F.concat(F.lit("<b>"), esc(F.col("original_title")), F.lit("</b>"))), cell(F.lit("x")), F.lit("</tr><tr><td>-</td></tr>"))
    body = F.array_join(F.transform(t.pipe_list(F.col("czech_isbn")), row), "")
    html = F.concat(F.lit('<p>no</p><table class="a ranking"><h2>'), esc(F.col("source_lang")), F.lit("</h2><tbody>"), body, F.lit("</tbody></table><table><tr><td>no</td></tr></table>"))
    pages = table(spark, d, "nkc_translations").distinct().select(F.col("nkc_id").alias("year"), F.col("czech_pub_year").alias("week"), html.alias("html"))
    return readers.chart_rows(pages).select(F.col("year").alias("nkc_id"), "category", "rank", "isbn", "author", "title", "publisher")


def repaired_texts(spark: SparkSession, d: str) -> DataFrame:
    """Names whose letters were read as C1 controls, and names as bytes, repaired."""
    rows = table(spark, d, "nkc_translations").select("nkc_id", "author").distinct()
    broken = F.translate("author", "šžťŠŽŤ", "\x9a\x9e\x9d\x8a\x8e\x8d")
    return rows.select("nkc_id", t.fix_c1(broken).alias("repaired"), t.decode_mixed(F.encode("author", "UTF-8")).alias("decoded"))


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    facts, _ = _books(spark, d)
    records = _records(spark, d)
    found = match_cascade(spark, d).where("book_id IS NOT NULL").select("nkc_id", "book_id", F.lit("matched").alias("layer"))
    rows = records.join(found, "nkc_id").join(facts.select("book_id", "ratings"), "book_id").join(cascade.first_year(records), ["norm_author", "norm_title"], "left").withColumn("appearances", F.col("ratings") % 3)
    return charts.training_rows(rows)


# ---- labels and features


def label_partition(spark: SparkSession, d: str) -> DataFrame:
    found = match_cascade(spark, d)
    return labels.partition(table(spark, d, "candidate_pool").distinct(), cascade.first_year_of_works(found, _records(spark, d))).select("work_id", "title", "pub_year", "first_cz_year", "part")


def label_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return labels.cutoffs(label_partition(spark, d)).select("work_id", "title", "pub_year", "translated_cz", "cutoff_year")


def cutoff_years(spark: SparkSession, d: str) -> DataFrame:
    return labels.year_distribution(label_partition(spark, d))


def review_stats(spark: SparkSession, d: str) -> DataFrame:
    return labels.pre_cutoff_stats(table(spark, d, "translation_labels"), table(spark, d, "goodreads_reviews_dedup"), table(spark, d, "goodreads_book_details"))


def stats_audit(spark: SparkSession, d: str) -> DataFrame:
    """How the delivered counts compare with the recomputed ones."""
    given = table(spark, d, "pre_cutoff_stats").groupBy("work_id", "cutoff_year").agg(F.max("pre_cutoff_ratings_count").alias("given"))
    both = given.join(review_stats(spark, d), ["work_id", "cutoff_year"], "left")
    verdict = F.when(F.col("given").isNull(), "missing").when(F.col("given") > F.coalesce("pre_cutoff_ratings_count", F.lit(0)), "high").when(F.col("given") < F.col("pre_cutoff_ratings_count"), "low").otherwise("equal")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.features(table(spark, d, "translation_labels"), table(spark, d, "pre_cutoff_stats"))
    return rows.withColumns({c: F.round(c, 6) for c in ("log_pre_cutoff_ratings_count", "log_pre_cutoff_text_reviews")}).select("work_id", "cutoff_year", "translated_cz", "split", *labels.FEATURES)


def feature_bloat(spark: SparkSession, d: str) -> DataFrame:
    return labels.bloat(table(spark, d, "pre_cutoff_stats"))


def feature_names(spark: SparkSession, d: str) -> DataFrame:
    """The model's columns of the feature table; identifiers, label and split keys are apart."""
    rows = labels.check_split(labels.features(table(spark, d, "translation_labels"), table(spark, d, "pre_cutoff_stats")))
    return profile.means(rows, labels.feature_columns(rows)).select(F.col("column").alias("feature"))


def popularity_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The baseline of the model comparison: the validation rows ranked by their ratings."""
    return profile.ranking(feature_table(spark, d).where("split = 'val'"), "translated_cz", "pre_cutoff_ratings_count", ["work_id", "cutoff_year"])


def split_summary(spark: SparkSession, d: str) -> DataFrame:
    return feature_table(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.sum("translated_cz").alias("positives"), F.round(F.avg("translated_cz"), 6).alias("rate"), F.min("cutoff_year").alias("first_year"), F.max("cutoff_year").alias("last_year"))


def feature_means(spark: SparkSession, d: str) -> DataFrame:
    return profile.means(feature_table(spark, d), labels.FEATURES)


def feature_correlations(spark: SparkSession, d: str) -> DataFrame:
    return profile.correlations(feature_table(spark, d), labels.FEATURES, "translated_cz")


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return profile.ranking(table(spark, d, "translation_labels").distinct(), "translated_cz", "ratings_count_2017", ["work_id", "cutoff_year"])


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    return models.comparison(feature_table(spark, d), key=["work_id", "cutoff_year"])


# ---- profiles


def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.frequency(table(spark, d, "candidate_pool"), profile.missing_as(F.col("language"), "<missing>"), "language")


def language_groups(spark: SparkSession, d: str) -> DataFrame:
    return profile.frequency(table(spark, d, "goodreads_book_details"), codes.language_group(F.col("language_code")), "language")


def rates_by_language(spark: SparkSession, d: str) -> DataFrame:
    return profile.grouped_rate(table(spark, d, "translation_labels").distinct(), profile.missing_as(F.col("language"), "<unk>"), "language", F.col("translated_cz") == 1, least=10)


def distinct_works(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "goodreads_book_details").agg(F.countDistinct(F.nullif(F.trim("work_id"), F.lit(""))).alias("works"), F.countDistinct("book_id").alias("books"))


def filled_shares(spark: SparkSession, d: str) -> DataFrame:
    return profile.filled_shares(table(spark, d, "nkc_translations"), catalogue.COLUMNS)


def ratings_histogram(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "candidate_pool").where("ratings_count_2017 >= 0")
    return profile.histogram(known, F.log10(F.greatest("ratings_count_2017", F.lit(1))), 50)


def year_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(table(spark, d, "goodreads_book_details").where("pub_year BETWEEN 1800 AND 2017"), F.col("pub_year"), 40)


def zero_signal(spark: SparkSession, d: str) -> DataFrame:
    stats = table(spark, d, "pre_cutoff_stats").distinct()
    return stats.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.coalesce("pre_cutoff_ratings_count", F.lit(0)) == 0, 1.0).otherwise(0.0)), 6).alias("zero_share"), F.round(F.avg("pre_cutoff_ratings_count"), 6).alias("mean_count"))


# ---- scalar functions over whole columns


def isbn_forms(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "nkc_translations").select("nkc_id", F.explode(t.pipe_list(F.col("czech_isbn"))).alias("isbn")).distinct()
    return raw.select("nkc_id", "isbn", t.norm_isbn(F.col("isbn")).alias("isbn13"), t.digits13(F.col("isbn")).alias("digits"))


def written_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nkc_translations").select("nkc_id", "czech_pub_year", t.parse_year(F.col("czech_pub_year")).alias("year")).distinct()


def review_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "goodreads_reviews_dedup").groupBy(point_in_time.written_year(F.col("date_added")).alias("year")).agg(F.count("*").alias("n"), F.countDistinct("review_id").alias("reviews"))


def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nkc_translations").select("nkc_id", t.clean(F.col("original_title")).alias("cleaned"), t.strip_series(F.col("original_title")).alias("plain")).distinct()


def author_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "goodreads_author_names").select("author_id", t.normalize(F.col("name")).alias("norm"), t.normalize_author(F.col("name")).alias("turned")).distinct()


def language_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nkc_translations").select("source_lang").distinct()
    prefix = codes.language_prefix(F.col("source_lang"))
    return rows.select("source_lang", prefix.alias("prefix"), codes.language_matches(F.lit("en-GB"), prefix).alias("english"))


def shelves_as_json(spark: SparkSession, d: str) -> DataFrame:
    """The number of shelves and their summed counts, from the serialised form."""
    rows = books.editions(table(spark, d, "goodreads_books_raw")).select("line_no", F.to_json("shelves").alias("shelves"))
    back = F.from_json("shelves", "array<struct<name:string,count:bigint>>")
    return rows.select("line_no", F.size(back).alias("n_shelves"), F.aggregate(back, F.lit(0).cast("bigint"), lambda a, s: a + s["count"]).alias("total"))


# ---- star schema


def pool_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """The work aggregation over another schema: parts and their line items."""
    rows = table(spark, d, "lineitem")
    best = F.min(F.struct((-F.col("l_quantity")).alias("q"), "l_orderkey", "l_linenumber", "l_returnflag")).alias("b")
    year = F.year("l_shipdate")
    out = rows.groupBy("l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("quantity"), F.count("*").alias("n"), F.min(F.when(year.between(1996, 2000), year)).alias("first_year"), best)
    return out.where("quantity >= 50").select("l_partkey", "quantity", "n", "first_year", F.col("b.l_orderkey").alias("order_key"), F.col("b.l_returnflag").alias("flag"))


def orders_before(spark: SparkSession, d: str) -> DataFrame:
    """Point-in-time join over orders: of each customer's order, the running total before it."""
    orders = table(spark, d, "orders").select("o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"), "o_orderkey")
    days = orders.groupBy("o_custkey", "day").agg(F.count("*").alias("n"))
    state = days.select("o_custkey", F.col("day").alias("since"), F.sum("n").over(Window.partitionBy("o_custkey").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("orders_before"))
    return point_in_time.point_in_time_join(orders, state, entity="o_custkey", at="day", available_at="since", values=["orders_before"], segment_width=365)


def events_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("k_sum"))


# ---- streaming


def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    stream = review_stream.review_stream(spark, f"{d}/goodreads_reviews_dedup.parquet")
    return review_stream.drain(review_stream.running_counts(stream))


_ALL = [
    p4_found, p6_found, p6_known_at_cutoff, catalogue_rows, catalogue_inventory, source_language_top20, publication_years, subfield_values, book_index, isbn_index, work_books, author_index, pool_of_works, record_keys, match_exact,
    match_cascade, match_layers, first_czech_year, matched_metadata, unmatched_works, chart_totals, chart_roll_up, training_rows, label_partition, label_cutoffs, cutoff_years, review_stats, stats_audit, feature_table, split_summary,
    feature_means, feature_correlations, ranking_metrics, model_comparison, language_counts, language_groups, rates_by_language, distinct_works, filled_shares, ratings_histogram, year_histogram, zero_signal, isbn_forms, written_years, review_years,
    clean_titles, author_names, language_targets, shelves_as_json, pool_of_parts, orders_before, events_json, streamed_counts,
    pool_of_rare_works, pool_counters, book_metadata, match_funnel, matched_dataset, training_dataset, training_counters, matched_outside_pool, chart_pages, repaired_texts, feature_bloat, feature_names, popularity_baseline,
]
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

_RATED = """
work_of AS (SELECT book_id, max_by(work_id, loaded_at) AS work_id FROM goodreads_book_details GROUP BY book_id),
rated AS (
  SELECT review_id, book_id, CAST(right(trim(date_added), 4) AS INT) AS year FROM goodreads_reviews_dedup
  WHERE rating BETWEEN 1 AND 5 AND regexp_matches(trim(date_added), '^[A-Z][a-z]{2} [A-Z][a-z]{2} [0-9]{1,2} [0-9:]{8} [+-][0-9]{4} [0-9]{4}$')
    AND try_strptime(substr(trim(date_added), 5), '%b %d %H:%M:%S %z %Y') IS NOT NULL),
per_work AS (SELECT work_id, review_id, min(year) AS year FROM rated JOIN work_of USING (book_id) WHERE trim(work_id) <> '' GROUP BY ALL)
"""

ORACLE: dict[str, str] = {
    "p4_found": """
WITH fields AS (
  SELECT line_no, f.f AS f, f.i - 1 AS pos FROM (SELECT line_no, unnest([{'f': datafield[i], 'i': i} FOR i IN range(1, len(datafield) + 1)]) AS f FROM nkc_records)),
subs AS (
  SELECT line_no, f.tag AS child, pos, s.i - 1 AS sub_pos, s.s.text AS child_value
  FROM (SELECT *, unnest([{'s': f.subfield[i], 'i': i} FOR i IN range(1, len(f.subfield) + 1)]) AS s FROM fields WHERE f.tag IN ('041', '765'))),
docs AS (SELECT line_no, CAST(json_text AS JSON) AS j FROM goodreads_books_raw WHERE json_valid(json_text)),
raw AS (
  SELECT line_no, 'popular_shelves' AS child, 'name' AS k, json_extract(j, '$.popular_shelves') AS l FROM docs
  UNION ALL SELECT line_no, 'authors', 'author_id', json_extract(j, '$.authors') FROM docs),
lists AS (
  SELECT line_no, child, k, CASE WHEN json_type(l) <> 'VARCHAR' THEN l WHEN json_valid(l->>'$') THEN CAST(l->>'$' AS JSON) END AS l FROM raw),
items AS (
  SELECT line_no, child, k, 0 AS pos, l AS e FROM lists WHERE json_type(l) = 'OBJECT'
  UNION ALL SELECT line_no, child, k, i AS pos, json_extract(l, '$[' || i || ']') AS e
  FROM (SELECT line_no, child, k, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS i FROM lists WHERE json_type(l) = 'ARRAY'))
SELECT source_table, line_no, child, CAST(pos AS INT) AS pos, CAST(sub_pos AS INT) AS sub_pos, child_value FROM (
  SELECT 'nkc_records' AS source_table, * FROM subs
  UNION ALL
  SELECT 'goodreads_books_raw', line_no, child, pos, 0, CASE WHEN json_type(e) = 'OBJECT' THEN e->>k WHEN json_type(e) <> 'ARRAY' THEN e->>'$' END FROM items)
WHERE trim(child_value, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''
""",
    "p6_found": f"""
WITH {_RATED},
asked AS (SELECT DISTINCT work_id, cutoff_year, pre_cutoff_ratings_count AS n FROM pre_cutoff_stats)
SELECT DISTINCT work_id, cutoff_year FROM (
  SELECT a.work_id, a.cutoff_year, a.n, count(DISTINCT w.review_id) AS known
  FROM asked a LEFT JOIN per_work w ON w.work_id = a.work_id AND w.year < a.cutoff_year GROUP BY ALL) WHERE n > known
""",
    "p6_known_at_cutoff": f"""
WITH {_RATED}
SELECT l.work_id, l.cutoff_year, l.translated_cz, CAST(nullif(count(w.review_id), 0) AS BIGINT) AS n_ratings
FROM (SELECT DISTINCT work_id, cutoff_year, translated_cz FROM translation_labels) l
LEFT JOIN per_work w ON w.work_id = l.work_id AND w.year < l.cutoff_year GROUP BY ALL
""",
} | SQL
