"""Language codes and shelf buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalogue language code to the two-letter prefix used by the book community.
LANGUAGE_PREFIX = {
    "eng": "en", "ger": "de", "fre": "fr", "spa": "es", "rus": "ru", "ita": "it", "pol": "pl", "por": "pt", "dut": "nl", "nor": "no", "nob": "no", "nno": "no", "swe": "sv", "dan": "da", "fin": "fi", "jpn": "ja", "chi": "zh", "kor": "ko", "hun": "hu",
    "tur": "tr", "ara": "ar", "heb": "he", "gre": "el", "ukr": "uk", "slo": "sk", "cze": "cs", "rum": "ro", "bul": "bg", "vie": "vi", "tha": "th", "ind": "id", "may": "ms", "cat": "ca", "ice": "is", "lat": "la", "scc": "sr", "scr": "hr",
}
# Spellings of a language code and its group.
LANGUAGE_GROUP = {
    "eng": "eng", "en-us": "eng", "en-gb": "eng", "en-ca": "eng", "en": "eng", "ger": "ger", "de": "ger", "deu": "ger", "fre": "fre", "fr": "fre", "fra": "fre", "spa": "spa", "es": "spa",
    "ita": "ita", "it": "ita", "swe": "swe", "sv": "swe", "cze": "cze", "cs": "cze", "ces": "cze", "slo": "slo", "sk": "slo", "slk": "slo",
}
# Shelves of each bucket.
SHELVES = {
    "fiction": ["fiction", "literary-fiction", "contemporary", "literary"],
    "mystery": ["mystery", "thriller", "crime", "suspense", "detective"],
    "romance": ["romance", "love", "chick-lit"],
    "scifi": ["science-fiction", "sci-fi", "fantasy", "speculative-fiction"],
    "nonfiction": ["non-fiction", "nonfiction", "biography", "memoir", "history", "self-help", "true-crime"],
    "ya": ["young-adult", "ya", "teen", "childrens", "children"],
    "classics": ["classics", "classic", "literary-classics"],
}


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def language_prefix(field: Column) -> Column:
    """The prefix of the first code of a pipe-joined list; empty if there is none."""
    first = F.lower(F.trim(F.get(F.split(field, r"\|"), F.lit(0))))
    return F.coalesce(literal_map(LANGUAGE_PREFIX)[first], F.lit(""))


def language_matches(code: Column, prefix: Column) -> Column:
    """Whether a code starts with a non-empty prefix: en-US with en, but not ger with de."""
    return F.coalesce((prefix != "") & F.lower(code).startswith(prefix), F.lit(False))


def language_group(code: Column) -> Column:
    """The group of a code; a code of none passes in lower case; null gives empty."""
    c = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    return F.coalesce(literal_map(LANGUAGE_GROUP)[c], c)


def shelf_key(name: Column) -> Column:
    return F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit(" "), F.lit("-"))


def bucket_count(shelves: Column, bucket: str) -> Column:
    """The summed counts of a bucket's shelves in ``array<struct<name, count bigint>>``."""
    own = F.filter(shelves, lambda s: shelf_key(s["name"]).isin(*SHELVES[bucket]))
    return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, s: total + F.coalesce(s["count"], F.lit(0).cast("bigint")))


def bucket_shares(counts: dict[str, Column]) -> dict[str, Column]:
    """Each bucket's part of all bucket counts, four decimals; zeros if there are none."""
    total = sum(counts.values(), F.lit(0).cast("bigint"))
    return {b: F.when(total > 0, F.round(c / total, 4)).otherwise(F.lit(0.0)) for b, c in counts.items()}
