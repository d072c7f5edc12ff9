"""Problem 3: text that looks the same brought to one consistent form.

Ignorable characters are deleted, compatibility forms and separate accents normalised (NFKC), all spaces
become U+0020. A word that mixes scripts spans a lattice of look-alike letters, and the Viterbi path with
the best character n-gram score under one script is its consistent spelling. The n-gram counts are taken
from all single-script words of the columns themselves.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look alike in Latin, Cyrillic and Greek (a dot: no such letter).
LOOKALIKES = [
    "aаα", "cс.", "eе.", "iіι", "jј.", "oоο", "pрρ", "sѕ.", "xхχ", "yуγ", "hһ.", "dԁ.", "qԛ.", "wԝ.", "v.ν", "u.υ", "n.η", "k.κ",
    "AАΑ", "BВΒ", "CС.", "EЕΕ", "HНΗ", "IІΙ", "JЈ.", "KКΚ", "MМΜ", "N.Ν", "OОΟ", "PРΡ", "SЅ.", "TТΤ", "XХΧ", "YУΥ", "Z.Ζ", "QԚ.", "WԜ.",
]
# Code points that are default-ignorable in Unicode, without the tags and variation supplements.
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0￰-￸"
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")

_IGNORE = re.compile(f"[{IGNORABLE}\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]")
_SPACES = re.compile(r"[\t\n\x0b\x0c\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_ALTERNATIVES = {c: "".join(x for x in row if x != ".") for row in LOOKALIKES for c in row if c != "."}
#: Log-probability lost at each change of script within a word.
SWITCH = -25.0
#: Log-probability lost by each letter that is not the written one: settles ties in favour of the text.
CHANGE = -0.01


@lru_cache(maxsize=8192)
def script(c: str) -> int:
    """Place in SCRIPTS, or -1."""
    name = unicodedata.name(c, "")
    return next((k for k, s in enumerate(SCRIPTS) if name.startswith(s)), -1)


def _letters(word: str) -> list[tuple[str, str]]:
    """(letter, its accents) of a word."""
    out: list[tuple[str, str]] = []
    for c in unicodedata.normalize("NFD", word):
        if out and unicodedata.combining(c):
            out[-1] = (out[-1][0], out[-1][1] + c)
        else:
            out.append((c, ""))
    return out


def bigrams(text: str) -> Counter:
    """(script, pair) counts of the single-script words of a text; ^ and $ stand for the word's ends."""
    out: Counter = Counter()
    for word in _WORD.findall(unicodedata.normalize("NFKC", _IGNORE.sub("", text))):
        base = [a.lower()[:1] for a, _ in _letters(word)]
        kinds = {script(c) for c in base}
        if len(kinds) == 1 and (k := kinds.pop()) >= 0:
            line = ["^", *base, "$"]
            out.update((k, a + b) for a, b in zip(line, line[1:], strict=False))
    return out


class Model:
    """Add-one bigram log-probabilities of each script, and of each script itself (its share of words)."""

    def __init__(self, counts: dict[tuple[int, str], int]):
        self.first: Counter = Counter()
        self.pair = {k: float(n) for k, n in counts.items()}
        size: dict[int, set[str]] = {}
        for (k, ab), n in counts.items():
            self.first[k, ab[0]] += n
            size.setdefault(k, set()).add(ab[1])
        self.size = {k: len(v) + 1 for k, v in size.items()}
        total = sum(self.first[k, "^"] for k in range(len(SCRIPTS)))
        self.prior = [math.log((self.first[k, "^"] + 1) / (total + len(SCRIPTS))) for k in range(len(SCRIPTS))]

    def score(self, k: int, a: str, b: str) -> float:
        return math.log((self.pair.get((k, a + b), 0.0) + 1) / (self.first.get((k, a), 0) + self.size.get(k, 30)))

    def spell(self, word: str) -> str:
        """The word in one script where look-alikes allow it; a word of one script is returned as it is."""
        parts = _letters(word)
        kinds = {script(a) for a, _ in parts} - {-1}
        if len(kinds) < 2:
            return word
        paths: dict[tuple[int, str], tuple[float, str]] = {(-2, "^"): (0.0, "")}
        for written, _ in parts:
            step: dict[tuple[int, str], tuple[float, str]] = {}
            for c in _ALTERNATIVES.get(written, written):
                k, low = script(c), c.lower()[:1]
                cost = CHANGE * (c != written)
                start = self.score(k, "^", low) + (self.prior[k] if k >= 0 else 0.0)
                best = None
                for (last, before), (total, text) in paths.items():
                    move = start if last == -2 else self.score(k, before, low) if last == k else SWITCH + start
                    if best is None or total + move + cost > best[0]:
                        best = (total + move + cost, text + c)
                if (k, low) not in step or best[0] > step[k, low][0]:
                    step[k, low] = best
            paths = step
        _, text = max((total + self.score(k, low, "$"), text) for (k, low), (total, text) in paths.items())
        return unicodedata.normalize("NFC", "".join(c + m for c, (_, m) in zip(text, parts, strict=True)))

    def consistent(self, text: str | None) -> str | None:
        if text is None or (text.isascii() and text.isprintable()):
            return text
        plain = _SPACES.sub(" ", unicodedata.normalize("NFKC", _IGNORE.sub("", _SPACES.sub(" ", text))))
        return unicodedata.normalize("NFC", self._lone_letters(_WORD.sub(lambda m: self.spell(m[0]), plain)))

    @staticmethod
    def _lone_letters(text: str) -> str:
        """Foreign words of one letter become Latin if all other words are; a Latin letter elsewhere may be a numeral."""
        words = [m for m in _WORD.finditer(text)]
        kinds = [script(m[0][0]) for m in words]
        if len(set(kinds)) < 2:
            return text
        for m, k in zip(words, kinds, strict=True):
            others = {x for n, x in zip(words, kinds, strict=True) if n is not m and len(_letters(n[0])) > 1}
            if len(_letters(m[0])) == 1 and k > 0 and others == {0}:
                like = next((c for c in _ALTERNATIVES.get(m[0][0], "") if script(c) == 0), None)
                if like:
                    text = text[: m.start()] + like + text[m.start() + 1 :]
        return text


def ngram_model(df: DataFrame, columns: list[str]) -> Model:
    """Bigram counts over all values of ``columns``.

    What reaches the driver is a count for each pair of letters of one script, so its size is bounded by the
    alphabets, whatever the number of rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for column in batch.columns:
                for text, n in Counter(column.to_pylist()).items():
                    if text:
                        for key, m in bigrams(text).items():
                            seen[key] += m * n
            yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in seen], pa.int32()), "ab": pa.array([ab for _, ab in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = df.select(*columns).mapInArrow(count, "k int, ab string, n long").groupBy("k", "ab").agg(F.sum("n").alias("n")).collect()
    return Model({(r["k"], r["ab"]): r["n"] for r in rows})


def consistent_form(model: Model) -> Callable[[Column], Column]:
    """A column function: the consistent form of a text. Null stays null, empty stays empty."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(model.consistent, na_action="ignore")

    return form


def unify(df: DataFrame, columns: list[str], *, suffix: str = "_consistent") -> DataFrame:
    """``df`` with a column ``<c><suffix>`` for each of ``columns``; raises if such a column exists.

    Double spaces, case, composed accents, typographic quotes and dashes and words wholly of another script
    stay; only a single letter among Latin words (an initial, an article) becomes Latin. Nulls stay null; an empty table gives an empty result; long texts are treated whole.
    """
    if clash := {f"{c}{suffix}" for c in columns} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    form = consistent_form(ngram_model(df, columns))
    return df.withColumns({f"{c}{suffix}": form(F.col(c)) for c in columns})


def found(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field) of each value whose consistent form differs from it, no row twice."""
    both = unify(df.select(key, *columns), columns)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.col(c) != F.col(f"{c}_consistent")).alias("hit")) for c in columns])).alias("x")
    return both.select(key, cells).where("x.hit").select(key, "x.field").distinct()
