"""Catalogue records: which are translations, their flat rows, and how well the fields are filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t

COLUMNS = ["nkc_id", "oclc", "czech_isbn", "czech_title", "original_title", "original_isbn", "original_sysnum", "author", "secondary_authors", "czech_pub_year", "source_lang", "genres"]


def _subfields(field: Column) -> Column:
    return F.coalesce(field["subfield"], F.array().cast("array<struct<code:string,text:string>>"))


def instances(fields: Column, tag: str) -> Column:
    """The fields of a tag, in order."""
    return F.filter(F.coalesce(fields, F.array().cast("array<struct<tag:string,ind1:string,ind2:string,subfield:array<struct<code:string,text:string>>>>")), lambda f: f["tag"] == tag)


def values(fields: Column, tag: str, code: str) -> Column:
    """All trimmed texts of (tag, code), in order; a null text is an empty one."""
    own = lambda f: F.transform(F.filter(_subfields(f), lambda s: s["code"] == code), lambda s: F.coalesce(t.strip(s["text"]), F.lit("")))
    return F.flatten(F.transform(instances(fields, tag), own))


def first_value(fields: Column, tag: str, code: str) -> Column:
    """The first text of (tag, code), even if it is empty; null if there is none."""
    return F.get(values(fields, tag, code), F.lit(0))


def distinct_join(items: Column) -> Column:
    """Non-empty elements, each once, in order of first sight, pipe-joined."""
    return F.array_join(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))), "|")


def is_translation(fields: Column, target: str = "cze", unknown: str = "und") -> Column:
    """Whether one language field names ``target`` and a source language that is neither it nor unknown."""

    def qualifies(f: Column) -> Column:
        into = F.exists(_subfields(f), lambda s: (s["code"] == "a") & (F.trim(s["text"]) == target))
        out_of = F.exists(_subfields(f), lambda s: (s["code"] == "h") & ~F.coalesce(F.trim(s["text"]), F.lit("")).isin("", target, unknown))
        return F.coalesce(into, F.lit(False)) & F.coalesce(out_of, F.lit(False))

    return F.exists(instances(fields, "041"), qualifies)


def _row_columns() -> list[Column]:
    """What a record's row holds, and with a leading _ what the inventory asks besides."""
    f = F.col("datafield")
    control = F.filter(F.coalesce("controlfield", F.array().cast("array<struct<tag:string,text:string>>")), lambda c: c["tag"] == "001")
    year = F.coalesce(t.parse_year(first_value(f, "260", "c")), t.parse_year(first_value(f, "264", "c")))
    fallback = F.get(F.filter(F.transform(values(f, "765", "t"), t.clean), lambda x: x.isNotNull()), F.lit(0))
    empty = lambda c: F.coalesce(c, F.lit(""))
    languages = F.filter(values(f, "041", "h"), lambda h: ~h.isin("cze", "und"))
    return [
        empty(F.trim(F.get(F.reverse(control), F.lit(0))["text"])).alias("nkc_id"),
        empty(t.parse_oclc(values(f, "035", "a"))).alias("oclc"),
        distinct_join(F.transform(values(f, "020", "a"), t.clean_isbn)).alias("czech_isbn"),
        empty(t.clean(first_value(f, "245", "a"))).alias("czech_title"),
        empty(F.coalesce(t.clean(first_value(f, "240", "a")), fallback)).alias("original_title"),
        distinct_join(F.transform(values(f, "765", "z"), t.clean_isbn)).alias("original_isbn"),
        distinct_join(values(f, "765", "w")).alias("original_sysnum"),
        empty(t.clean(first_value(f, "100", "a"))).alias("author"),
        distinct_join(F.transform(values(f, "700", "a"), t.clean)).alias("secondary_authors"),
        year.alias("_year"),
        distinct_join(languages).alias("source_lang"),
        distinct_join(F.transform(values(f, "655", "a"), t.clean)).alias("genres"),
        empty(first_value(f, "260", "c")).alias("_c260"),
        empty(first_value(f, "264", "c")).alias("_c264"),
        (F.size(instances(f, "765")) > 0).alias("_has765"),
        (F.size(values(f, "655", "a")) > 0).alias("_has655"),
    ]


def translation_rows(records: DataFrame, *, min_year: int | None = None, least_year: int = 1800) -> DataFrame:
    """The flat row of each translation; a record dated before ``least_year`` is left out.

    With ``min_year`` undated and older records go too. Missing values are empty strings; of a control tag
    that repeats the last counts. ``line_no`` keeps records apart that were delivered twice.
    """
    rows = records.where(is_translation(F.col("datafield"))).select("line_no", *_row_columns())
    rows = rows.where(F.col("_year").isNull() | (F.col("_year") >= least_year))
    if min_year is not None:
        rows = rows.where(F.col("_year") >= min_year)
    return rows.withColumn("czech_pub_year", F.coalesce(F.col("_year").cast("string"), F.lit("")))


def inventory(records: DataFrame, *, least_year: int = 1800) -> DataFrame:
    """One row: records, records with a language field, translations, and the share of them that has each field.

    One scan: a row is built only of records that are translations, beside the counts over all.
    """
    f = F.col("datafield")
    rows = records.select((F.size(instances(f, "041")) > 0).cast("long").alias("n041"), F.when(is_translation(f), F.struct(*_row_columns())).alias("r"))
    rows = rows.select("n041", F.when(F.col("r._year").isNull() | (F.col("r._year") >= least_year), F.col("r")).alias("r"))
    has = lambda c: F.col(f"r.{c}") != ""
    fields = {
        "oclc": has("oclc"), "czech_title": has("czech_title"), "original_title": has("original_title"), "author": has("author"), "c260": has("_c260"), "c264": has("_c264"), "year": F.col("r._year").isNotNull(),
        "link": F.col("r._has765"), "original_isbn": has("original_isbn"), "original_sysnum": has("original_sysnum"), "genre": F.col("r._has655"), "isbn": has("czech_isbn"),
    }
    kept = F.col("r").isNotNull()
    shares = [F.round(F.coalesce(F.avg(F.when(kept, c.cast("double"))), F.lit(0.0)), 4).alias(f"share_{n}") for n, c in fields.items()]
    both = rows.agg(F.count("*").alias("total_records"), F.coalesce(F.sum("n041"), F.lit(0)).alias("records_with_041"), F.count_if(kept).alias("translation_records"), *shares)
    return both.withColumn("filter_rate", F.round(F.col("translation_records") / F.greatest("total_records", F.lit(1)), 4))
