"""Text normalisation as column expressions, with an exact Arrow version for what they can't express.

All functions map null to null unless said otherwise and treat texts whole.
"""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that compatibility decomposition leaves whole.
REPLACEMENTS = {
    "ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
    "ß": "ss", "đ": "d", "Đ": "D", "þ": "th", "Þ": "TH", "ı": "i", "İ": "I",
}
# Articles of which one is dropped at the start.
ARTICLES = ["the", "a", "an", "der", "die", "das", "ein", "eine", "le", "la", "les", "un", "une"]
# Ligatures and signs that decompose to several letters and occur in names and titles.
EXPANSIONS = ["Ĳ", "ĳ", "Ŀ", "ŀ", "ŉ", "Ǆ", "ǅ", "ǆ", "Ǉ", "ǈ", "ǉ", "Ǌ", "ǋ", "ǌ", "Ǳ", "ǲ", "ǳ", "…", "ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ", "№", "™", "½", "¼", "¾"]
# The patterns of a written year and of an OCLC number.
YEAR_PATTERN = r"(?U)\b(1\d{3}|20\d{2})\b"
OCLC_PATTERN = r"\(OCoLC\)(?:ocm|ocn|on)?0*(\d+)"
#: What Python takes for white space; the JVM's \s is only a part of it.
SPACE = r"[\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """From and to of ``translate``: every character of the plane that decomposes to one, then those that go."""
    one, gone = {}, []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or c in REPLACEMENTS or c in EXPANSIONS:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == "":
            gone.append(c)
        elif len(plain) == 1 and plain != c:
            one[c] = plain
    return "".join(one) + "".join(gone), "".join(one.values())


def fold(text: Column) -> Column:
    """Without accents and compatibility forms, all in the JVM.

    Characters that decompose to several and are not in EXPANSIONS stay; ``normalize_exact`` has no such gap.
    """
    for a, b in REPLACEMENTS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    for c in EXPANSIONS:
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        text = F.replace(text, F.lit(c), F.lit(plain))
    return F.translate(text, *fold_table())


def normalize(text: Column) -> Column:
    """Folded, lower case, without ASCII punctuation and one leading article, words joined by one space."""
    words = F.regexp_replace(F.translate(F.lower(fold(text)), string.punctuation, ""), SPACE, " ")
    return F.trim(F.regexp_replace(F.trim(words), f"^({'|'.join(ARTICLES)})( |$)", ""))


def normalize_text(text: str) -> str:
    """The rule of ``normalize`` for one string, over all of Unicode."""
    for a, b in REPLACEMENTS.items():
        text = text.replace(a, b)
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    words = "".join(c for c in plain.lower() if c not in string.punctuation).split()
    return " ".join(words[1:] if words and words[0] in ARTICLES else words)


@F.pandas_udf(T.StringType())
def normalize_exact(texts: pd.Series) -> pd.Series:
    """``normalize`` over all of Unicode; use it on distinct values."""
    return texts.map(normalize_text, na_action="ignore")


def turn_name(name: Column) -> Column:
    """"Family, Given" to "Given Family" at the first comma; other names stay."""
    parts = F.split(name, ",", 2)
    return F.when(F.size(parts) > 1, F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0))))).otherwise(name)


def normalize_author(name: Column) -> Column:
    """A catalogue heading in natural order, normalised."""
    return normalize(turn_name(name))


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def clean(text: Column) -> Column:
    """Without closing catalogue punctuation and outer white space; null if nothing is left."""
    return F.nullif(strip(F.rtrim(text, F.lit(" :/.,;"))), F.lit(""))


def strip_series(title: Column) -> Column:
    """Without a closing "(.. #..)"."""
    return strip(F.regexp_replace(title, r"\s*\([^)]*#[^)]*\)\s*$", ""))


def parse_year(text: Column) -> Column:
    """The first free-standing year 1000-1999 or 2000-2099; c1982 holds none."""
    return F.nullif(F.regexp_extract(text, YEAR_PATTERN, 1), F.lit("")).cast("int")


def parse_oclc(values: Column) -> Column:
    """The first OCLC number of an array of identifiers, without prefix and zeros."""
    found = F.transform(values, lambda v: F.nullif(F.regexp_extract(v, OCLC_PATTERN, 1), F.lit("")))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def clean_isbn(value: Column) -> Column:
    """What stands before a bracket, cleaned; null if nothing is left."""
    return clean(strip(F.get(F.split(value, r"\("), F.lit(0))))


def isbn10_to_13(isbn: Column) -> Column:
    """978, nine digits and the check digit of a ten-character ISBN."""
    base = F.concat(F.lit("978"), F.substring(isbn, 1, 9))
    total = sum((F.substring(base, k + 1, 1).cast("int") * (1 if k % 2 == 0 else 3) for k in range(12)), F.lit(0))
    return F.concat(base, ((F.lit(10) - total % 10) % 10).cast("string"))


def norm_isbn(raw: Column) -> Column:
    """Thirteen digits from ISBN-10, ISBN-13 or an ISBN-13 without its first 9; other text without spaces and dashes."""
    s = F.upper(F.regexp_replace(raw, r"(?U)[\s\-]", ""))
    return F.when(s.rlike(r"^\d{9}[\dX]$"), isbn10_to_13(F.when(s.rlike(r"^\d{9}[\dX]$"), s))).when(s.rlike(r"^\d{12}$"), F.concat(F.lit("9"), s)).otherwise(s)


def digits13(raw: Column) -> Column:
    """The digits if they are exactly thirteen, else an empty string."""
    d = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(F.length(d) == 13, d).otherwise(F.lit(""))


def parse_int(value: Column) -> Column:
    """A tolerant integer: null, empty and non-numeric text give 0."""
    return F.coalesce(F.trim(value.cast("string")).try_cast("int"), F.lit(0))


def parse_number_as_int(value: Column) -> Column:
    """Like ``parse_int``, by way of a floating number whose fraction is cut off."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("int"), F.lit(0))


_C1 = {c: bytes([c]).decode("windows-1250", "ignore") for c in range(0x80, 0xA0)}


def fix_c1(text: Column) -> Column:
    """C1 controls read again as Windows-1250; unmapped ones and U+FFFD are deleted."""
    mapped = {chr(c): s for c, s in _C1.items() if s}
    gone = [chr(c) for c, s in _C1.items() if not s] + ["�"]
    return F.translate(text, "".join(mapped) + "".join(gone), "".join(mapped.values()))


def decode_mixed_bytes(content: bytes) -> str:
    """UTF-8 with Windows-1250 for the bytes that break it, then the C1 repair."""
    parts, rest = [], bytes(content)
    while rest:
        try:
            parts.append(rest.decode())
            break
        except UnicodeDecodeError as e:
            parts += [rest[: e.start].decode(), rest[e.start : e.end].decode("windows-1250", "ignore")]
            rest = rest[e.end :]
    return "".join(_C1.get(ord(c), c) for c in "".join(parts) if c != "�")


@F.pandas_udf(T.StringType())
def decode_mixed(content: pd.Series) -> pd.Series:
    """Column version of ``decode_mixed_bytes``."""
    return content.map(decode_mixed_bytes, na_action="ignore")


def pipe_list(text: Column) -> Column:
    """The non-empty elements of a pipe-joined list, in order."""
    return F.filter(F.split(text, r"\|"), lambda x: x != "")
