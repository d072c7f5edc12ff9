"""Problem 5: one surviving record for each group of duplicates, chosen field by field.

Fields are unpivoted to long rows, each row votes for its (normalised) value with its source's trust times
a decay of its age, votes are summed per value, the value with most votes wins (``min_by`` over the
negated votes, so that ties go to the smaller record), and the winners are pivoted back to one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.point_in_time import latest_rows


@dataclass(frozen=True)
class Field:
    """A field of the survivor: its value (text), which rows may vote, and their trust."""

    value: Column
    valid: Column
    trust: Column


def elect(df: DataFrame, *, entity: str, record: str, loaded_at: str, fields: dict[str, Field], half_life_days: float | None = None, per_record: bool = False) -> DataFrame:
    """One row per non-blank ``entity``: n_records and, of each field, ``<f>``, ``<f>_record``, ``<f>_votes``.

    Of every ``record`` only its latest row counts, whichever entity that row names; ties of ``loaded_at``
    go to the greatest row. A vote weighs trust * 0.5 ** (age / half_life_days), age counted from the
    latest load of all; without a half-life it is the trust alone. With ``per_record`` each record is its
    own candidate, so the most trusted valid record wins a field; else records of one value add up.
    Equal votes go to the value with the smaller record. A field for which no row is valid (a null test
    counts as not valid) is null. Rows without a record are left out; an empty table gives an empty result.

    A hot entity is no problem: each step is a partial aggregate before its shuffle.
    """
    now = latest_rows(df, record, loaded_at).where(F.trim(entity) != "")
    if half_life_days is not None:
        newest = df.agg(F.max(F.unix_micros(loaded_at)).alias("_newest"))
        now = now.join(F.broadcast(newest))  # one row
        decay = F.pow(F.lit(0.5), (F.col("_newest") - F.unix_micros(loaded_at)) / F.lit(half_life_days * 86_400e6))
    else:
        decay = F.lit(1.0)
    ballots = [
        F.struct(
            F.lit(name).alias("field"),
            F.when(F.coalesce(f.valid, F.lit(False)), f.value.cast("string")).alias("value"),
            F.when(F.coalesce(f.valid, F.lit(False)), f.trust.cast("double") * decay).alias("weight"),
        )
        for name, f in fields.items()
    ]
    long = now.select(F.col(entity).alias("_entity"), F.col(record).alias("_record"), F.explode(F.array(*ballots)).alias("x")).select("_entity", "_record", "x.*")
    candidate = ["_entity", "field", "value", *(["_record"] if per_record else [])]
    sums = [F.sum("weight").alias("votes"), F.count("*").alias("n")]
    votes = long.groupBy(*candidate).agg(*sums, *([] if per_record else [F.min("_record").alias("_record")]))
    order = F.when(F.col("votes").isNotNull(), F.struct(-F.col("votes"), F.col("_record"), F.col("value")))
    winners = votes.groupBy("_entity", "field").agg(F.min_by(F.struct("value", "_record", "votes"), order).alias("w"), F.sum("n").alias("n"))
    pick = lambda name, part: F.max(F.when(F.col("field") == name, F.col(f"w.{part}")))
    back = [c for name in fields for c in (pick(name, "value").alias(name), pick(name, "_record").alias(f"{name}_record"), pick(name, "votes").alias(f"{name}_votes"))]
    return winners.groupBy("_entity").agg(F.max("n").alias("n_records"), *back).withColumnRenamed("_entity", entity)


def edition_fields() -> dict[str, Field]:
    """Fields of an edition: unknown counts (null, negative) are trusted least."""
    count = F.when(F.col("ratings_count") >= 0, F.col("ratings_count")).otherwise(-1)
    code = F.trim("language_code")
    return {
        "record": Field(F.col("book_id"), F.lit(True), count),
        "language_code": Field(code, (code != "") & ~code.isin("und", "--", "mul"), count),
        "pub_year": Field(F.col("pub_year"), F.col("pub_year").between(1800, 2017), count),
    }


def found(editions: DataFrame) -> DataFrame:
    """(work_id, field, book_id) of the trusted edition for each field of works with two editions or more."""
    fields = edition_fields()
    rows = elect(editions.select("book_id", "work_id", "ratings_count", "language_code", "pub_year", "loaded_at"), entity="work_id", record="book_id", loaded_at="loaded_at", fields=fields, per_record=True)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_record").alias("book_id")) for f in fields])).alias("x")
    return rows.where("n_records > 1").select("work_id", cells).select("work_id", "x.*").where("book_id IS NOT NULL")


def golden(editions: DataFrame, half_life_days: float = 365.0) -> DataFrame:
    """One built record per work: votes of equal values add up, weighed by log trust and recency."""
    trust = F.log1p(F.when(F.col("ratings_count") >= 0, F.col("ratings_count")).otherwise(0)) + 0.1
    code, title = F.lower(F.regexp_extract(F.trim("language_code"), "^([A-Za-z]+)", 1)), F.trim("norm_title")
    fields = {
        "title": Field(title, title != "", trust),
        "language": Field(code, (code != "") & ~code.isin("und", "mul"), trust),
        "year": Field(F.col("pub_year"), F.col("pub_year").between(1800, 2017), trust),
    }
    rows = elect(editions.select("book_id", "work_id", "norm_title", "ratings_count", "language_code", "pub_year", "loaded_at"), entity="work_id", record="book_id", loaded_at="loaded_at", fields=fields, half_life_days=half_life_days)
    votes = [c for c in rows.columns if c.endswith("_votes")]
    return rows.withColumns({c: F.round(c, 6) for c in votes})
