"""Problem 2: records of two sources that share no key, linked with a confidence.

Probabilistic record linkage. Several blocking passes bring candidates together, every attribute is compared
to an agreement level, expectation-maximisation over the counts of agreement patterns estimates how often
matches and non-matches show each level, and the posterior of a pair's pattern is its confidence.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.llm import lookalike, names
from foliant.llm.names import fold, near, skeleton
from foliant.operators.point_in_time import latest_rows
from foliant.session import durable

# Latin for Cyrillic letters; articles; names of a volume; words that join nouns; language codes.
CYRILLIC = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "ё": "e", "і": "i"}
ARTICLES = {*text.ARTICLES, *"el los las il lo l".split()}
VOLUME = "volume|vol|v|part|pt|band|bd|teil|tome|dil|svazek|sv|tom|t|no|nr"
JOINING = set("and und et i u".split())
LANGUAGES = {"en": "eng", "de": "ger", "fr": "fre", "ru": "rus", "cs": "cze", "es": "spa", "it": "ita", "pl": "pol", "deu": "ger", "fra": "fre", "ces": "cze"}
UNKNOWN_LANGUAGES = {"", "und", "mul", "--", "zxx", "lat"}

_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_VOLUME_WRITTEN = re.compile(rf"[\s.,:;]+(?:(?:{VOLUME})\b\.?\s*)?(\d{{1,3}}|[ivx]+)$")
_SERIES = re.compile(r"\(([^()]*)\)\s*$")
_WORDS = re.compile(r"[^\W_]+")
_YEAR = re.compile(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)")
_TRANSLATE = str.maketrans(CYRILLIC)


def _tokens(text: str) -> list[str]:
    return [skeleton(fold(w.translate(_TRANSLATE))).replace("kh", "h") for w in _WORDS.findall(text.replace("'", "").replace("’", ""))]


def title_key(text: str | None, subtitles: frozenset[str] = frozenset()) -> tuple[str, int]:
    """The comparable words of a title and its volume, 0 if it names none.

    Quotes, subtitle, series statement, leading or moved article, and joining words are left out; Cyrillic is
    written in Latin. A subtitle stands after a colon, or at the end if it is one of ``subtitles``.
    """
    if not text:
        return "", 0
    text = text.lower().strip(" „“”\"«»/;.=\t")
    text = _SERIES.sub("", text).strip(" „“”\"/;.")
    if m := re.search(r",\s*(\w+)$", text):
        if m[1] in ARTICLES:
            text = text[: m.start()].strip()
    main, _, rest = text.partition(":")
    volume = 0
    for part in (rest, main):
        m = _VOLUME_WRITTEN.search(" " + part.strip(" .,;/“”\""))
        if m and (n := int(m[1]) if m[1].isdigit() else _ROMAN.get(m[1], 0)):
            volume = volume or n
            if part is main:
                main = (" " + part.strip(" .,;/“”\""))[: m.start()]
    words = _tokens(main)
    for k in range(1, len(words)):
        if " ".join(words[k:]) in subtitles:
            words = words[:k]
            break
    if not volume and len(words) > 1:  # the volume before a subtitle that no colon parts
        m = _VOLUME_WRITTEN.search(" " + " ".join(words))
        if m and (n := int(m[1]) if m[1].isdigit() else _ROMAN.get(m[1], 0)):
            volume, words = n, _tokens((" " + " ".join(words))[: m.start()])
    if len(words) > 1 and words[0] in ARTICLES:
        words = words[1:]
    return " ".join(w for w in words if w not in JOINING), volume


def original_title(original: str | None, translated: str | None) -> str | None:
    """The original title: as given, or what stands after = or / in the translated one."""
    if original and original.strip():
        return original
    parts = re.split(r"\s[=/]\s", translated or "")
    return parts[-1] if len(parts) > 1 and parts[-1].strip() else None


def written_year(text: str | None) -> int | None:
    m = _YEAR.search(text or "")
    return int(m[1]) if m else None


def language(code: str | None) -> str | None:
    c = re.split(r"[-_|]", (code or "").strip().lower())[0]
    return None if c in UNKNOWN_LANGUAGES else LANGUAGES.get(c, c)


def words_level(a: str, b: str) -> int:
    """4 equal; 3 equal but for slips, word by word; 2 one holds the other; 1 half of the words; 0 less."""
    if a == b:
        return 4
    x, y = a.split(), b.split()
    if len(x) == len(y) and all(near(p, q) for p, q in zip(x, y, strict=True)):
        return 3
    if near(a.replace(" ", ""), b.replace(" ", "")):
        return 3
    rest, same = list(y), 0
    for p in x:
        hit = next((q for q in rest if p == q or (len(p) > 3 and near(p, q))), None)
        if hit is not None:
            rest.remove(hit)
            same += 1
    if same == min(len(x), len(y)) and same > 1:
        return 2
    return 1 if 2 * same >= max(len(x), len(y)) else 0


#: The compared attributes and their highest levels.
#: Author: 4 the same entity, 3 one family and a slip or nickname of the first name, 2 one family and the first name or an initial that fits, 1 one family; -1 unknown.
#: Title: 5 equal, 4 but for slips, 3 one holds the other, each with the same volume or none; 2 that far, but only one names a volume; 1 half of the words; 0 less, or another volume.
ATTRIBUTES = {"author": 4, "title": 5, "year": 1, "language": 1}


def title_level(words: Column, a: Column, b: Column) -> Column:
    """The level of the title from that of its words and both volumes (0: none named)."""
    return F.when((words < 2) & ((a == b) | (a == 0) | (b == 0)), words).when(a == b, words + 1).when((a > 0) & (b > 0), 0).otherwise(2)


def monotone(m: dict[int, float], u: dict[int, float]) -> dict[int, float]:
    """Log-likelihood ratio of each level, made non-decreasing: more agreement never speaks against a match.

    Neighbouring levels out of order are pooled and share the ratio of their sums.
    """
    pools: list[list] = []
    for v in sorted(m):
        pools.append([m[v], u[v], [v]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            x = pools.pop()
            pools[-1] = [pools[-1][0] + x[0], pools[-1][1] + x[1], pools[-1][2] + x[2]]
    return {v: math.log(a / b) for a, b, levels in pools for v in levels}


@dataclass
class Weights:
    """m and u probabilities of each attribute's levels, and the share of matches among candidates."""

    m: list[dict[int, float]]
    u: list[dict[int, float]]
    share: float

    def __post_init__(self) -> None:
        self.ratio = [monotone(m, u) for m, u in zip(self.m, self.u, strict=True)]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        odds = math.log(self.share) - math.log1p(-self.share)
        odds += sum(r.get(level, 0.0) for level, r in zip(pattern, self.ratio, strict=True) if level >= 0)
        return 1 / (1 + math.exp(min(700.0, -odds)))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int, bool]], levels: list[int], rounds: int = 10_000) -> Weights:
    """Fit on (pattern, count, possible) of agreement patterns; a level of -1 is unknown and says nothing.

    Pairs that are not possible are known non-matches: they tell how often non-matches agree. Starts from full agreement
    as match, and ends when the share of matches moves by less than 1e-7; warns if that takes more than ``rounds``.
    """
    if not patterns:
        return Weights([{} for _ in levels], [{} for _ in levels], 0.5)
    count = np.array([n for _, n, _ in patterns], float)
    possible = np.array([p for _, _, p in patterns], bool)
    table = np.array([p for p, _, _ in patterns], int).reshape(len(patterns), len(levels))
    g = np.clip(np.mean([np.where(table[:, k] < 0, 0.5, table[:, k] / max(1, top)) for k, top in enumerate(levels)], axis=0), 0.01, 0.99) ** 3 * possible
    share, weights = 0.5, None
    for _ in range(rounds):
        m, u = [], []
        for k, top in enumerate(levels):
            known = table[:, k] >= 0
            pm, pu = {}, {}
            for v in range(top + 1):
                own = known & (table[:, k] == v)
                pm[v] = (float((count * g)[own].sum()) + 0.1) / (float((count * g)[known].sum()) + 0.1 * (top + 1))
                pu[v] = (float((count * (1 - g))[own].sum()) + 0.1) / (float((count * (1 - g))[known].sum()) + 0.1 * (top + 1))
            m.append(pm)
            u.append(pu)
        new = min(0.999, max(1e-9, float((count * g).sum() / max(count.sum(), 1.0))))
        weights = Weights(m, u, new)
        g = np.array([weights.posterior(p) for p, _, _ in patterns]) * possible
        if abs(new - share) < 1e-7:
            return weights
        share = new
    warnings.warn(f"no convergence in {rounds} rounds", stacklevel=2)
    return weights


def _subtitles(records: DataFrame) -> frozenset[str]:
    """Subtitles of at least one in a thousand of the titles that have one: at most a thousand."""
    after = F.lower(F.trim(F.regexp_extract("original_title", r"\s?:\s([^:=/(.\d]+)", 1)))
    counts = records.select(after.alias("s")).where("s <> ''").groupBy("s").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.join(F.broadcast(total)).where("n >= greatest(3, total * 0.001)").select("s").collect()
    return frozenset(" ".join(_tokens(r["s"])) for r in rows)


def _prepare_records(records: DataFrame, model: lookalike.Model, subtitles: frozenset[str]) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, author, original, translated, year, lang in b.itertuples(index=False):
                title = original_title(model.consistent(original), model.consistent(translated))
                words, volume = title_key(title, subtitles)
                rows.append((key, author, words, volume, " ".join(_tokens(re.split(r"\s[=/]\s", model.consistent(translated) or "")[0])), written_year(year), language(lang)))
            yield pd.DataFrame(rows, columns=["nkc_id", "author", "title", "volume", "czech", "year", "lang"]).astype({"year": "Int64", "volume": "int64"})

    kept = records.select("nkc_id", "author", "original_title", "czech_title", "czech_pub_year", "source_lang").where("nkc_id IS NOT NULL").distinct()
    return kept.mapInPandas(parse, "nkc_id string, author string, title string, volume long, czech string, year long, lang string")


def _prepare_works(now: DataFrame, subtitles: frozenset[str]) -> tuple[DataFrame, DataFrame]:
    """Of the editions' latest rows, titles of each work with their number of editions; its first known year, whether an edition's year is open, its languages."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [title_key(t, subtitles) for t in b["norm_title"]]
            yield pd.DataFrame({"norm_title": b["norm_title"], "title": [k[0] for k in keys], "volume": [k[1] for k in keys]})

    distinct = now.select("norm_title").where(F.trim("norm_title") != "").distinct()
    parsed = distinct.mapInPandas(parse, "norm_title string, title string, volume long").where("title <> ''")
    titles = now.join(parsed, "norm_title").groupBy("work_id", "title", "volume").agg(F.count("*").alias("n"))
    code = F.element_at(F.split(F.lower(F.trim("language_code")), "[-_]"), 1)
    known = F.when(~code.isin(*UNKNOWN_LANGUAGES), F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[code], code))
    year = F.when(F.col("pub_year").between(1500, 2017), F.col("pub_year"))
    works = now.groupBy("work_id").agg(F.min(year).alias("first_year"), F.max(year.isNull()).alias("open"), F.collect_set(known).alias("langs"))  # a set of language codes
    return titles, works


def _word_table(forms: DataFrame, works: DataFrame) -> DataFrame:
    """(text, df, near) of each word of a title, and of each title written as one word (=...): its works, and the spellings one slip away."""

    def texts(df: DataFrame, n: Column) -> DataFrame:
        return df.select("title", n.alias("n")).distinct().select(F.explode(F.concat(F.array_distinct(F.split("title", " ")), F.array(_joined(F.col("title"))))).alias("text"), "n")

    counted = texts(works, F.lit(1)).unionAll(texts(forms, F.lit(0))).groupBy("text").agg(F.sum("n").alias("df"))
    counted = durable(counted.select(F.when(F.startswith("text", F.lit("=")), "title").otherwise("word").alias("kind"), "text", "df"))
    return durable(counted.join(names.close_spellings(counted), ["kind", "text"], "left").select("text", "df", F.coalesce("near", F.array().cast("array<string>")).alias("near")))


def _joined(title: Column) -> Column:
    return F.concat(F.lit("="), F.replace(title, F.lit(" "), F.lit("")))


def _titles(df: DataFrame, table: DataFrame) -> DataFrame:
    """(id, family, title, words, rare, whole) of each title of a family: its words, the rarest in all its spellings (short words only if there are no others), the title as one word in all its spellings."""
    titles = df.where("family IS NOT NULL").select("family", "title").distinct()
    words = titles.select("title").distinct().select("title", F.explode(F.concat(F.array_distinct(F.split("title", " ")), F.array(_joined(F.col("title"))))).alias("text")).join(table, "text")
    one = F.struct(F.startswith("text", F.lit("=")).alias("whole"), (F.length("text") < 3).alias("short"), "df", "text", "near")
    rows = words.groupBy("title").agg(F.array_sort(F.collect_list(one)).alias("w"))  # the words of one title; the whole comes last
    spellings = lambda x: F.concat(F.array(x["text"]), x["near"])
    rows = rows.select("title", F.slice("w.text", F.lit(1), F.size("w") - 1).alias("words"), spellings(F.get("w", F.lit(0))).alias("rare"), spellings(F.element_at("w", -1)).alias("whole"))
    return durable(titles.join(rows, "title").select(F.monotonically_increasing_id().alias("id"), "family", "title", "words", "rare", "whole"))


def title_pairs(records: DataFrame, works: DataFrame, block_pairs: int = 50_000) -> DataFrame:
    """(family, r_title, w_title): the titles of one family name that may agree, each pair once.

    Of two titles that agree but for slips or one of which holds the other, all words of the shorter are in the longer or
    one slip away from a word of it. So passes 1 and 2 join the rarest word of one title, in all its spellings,
    with all words of the other: every such pair meets. Pass 3 joins titles that as one word are a slip apart (spaces moved).
    Blocks travel as hashes with the titles' numbers.
    A block of more than ``block_pairs`` pairs is cut on both sides into parts, and each pair of parts is a cell of about
    so many pairs at most; so tasks stay small and the pairs are the same whatever ``block_pairs``.
    """
    table = _word_table(records, works)
    left, right = _titles(records, table), _titles(works, table)
    keys = lambda tag, xs: F.transform(xs, lambda x: F.xxhash64(F.lit(tag), "family", x))
    a = left.select(F.col("id").alias("a"), F.explode(F.concat(keys(1, "rare"), keys(2, "words"), keys(3, "whole"))).alias("key"))
    b = right.select(F.col("id").alias("b"), F.explode(F.concat(keys(1, "words"), keys(2, "rare"), keys(3, F.slice("whole", 1, 1)))).alias("key"))
    side = max(1, math.isqrt(block_pairs))
    parts = lambda n: F.ceil(F.col(n) / side).cast("int")
    size = a.groupBy("key").agg(F.count("*").alias("na")).join(b.groupBy("key").agg(F.count("*").alias("nb")), "key").where(F.col("na") * F.col("nb") > block_pairs)
    size = durable(size.select("key", parts("na").alias("pa"), parts("nb").alias("pb")))  # blocks that are too large for one task: seldom any

    def cells(df: DataFrame, form: str, own: str, other: str) -> DataFrame:
        """Each row in one part of its side of the block, and in a row for each part of the other side."""
        cut = df.join(F.broadcast(size) if few else size, "key", "left")
        mine = F.pmod(F.xxhash64(form), F.coalesce(own, F.lit(1))).cast("int").alias(own)
        return cut.select(*df.columns, mine, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other))

    hot = size.limit(1001).count()
    few = hot <= 1000
    if hot:
        a, b = cells(a, "a", "pa", "pb"), cells(b, "b", "pb", "pa")
    met = a.join(b, ["key", *(["pa", "pb"] if hot else [])]).select("a", "b").distinct()
    met = met.join(left.select(F.col("id").alias("a"), F.col("family").alias("family"), F.col("title").alias("r_title")), "a")
    met = met.join(right.select(F.col("id").alias("b"), F.col("family").alias("w_family"), F.col("title").alias("w_title")), "b")
    return met.where("family = w_family").select("family", "r_title", "w_title")  # the hashes of two families may agree


def candidates(records: DataFrame, works: DataFrame, block_pairs: int = 50_000) -> DataFrame:
    """Pairs (record form, work title) with the levels of author and title, from several passes, none twice.

    Passes 1 to 3: ``title_pairs`` within a family name. Each pair of titles is compared once, whoever bears them; Python sees only unequal ones.
    Pass 4 goes without the family name, where one side has no author: the same title, if it is that of one work only (of one only of the works without author).
    """

    @F.pandas_udf("int")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([words_level(*x) for x in zip(a, b, strict=True)], dtype="int32")

    pairs = durable(title_pairs(records, works, block_pairs))
    pairs = durable(pairs.where("r_title = w_title").withColumn("level", F.lit(4)).unionByName(pairs.where("r_title <> w_title").withColumn("level", compare("r_title", "w_title"))))
    a = records.where("family IS NOT NULL").select("family", "r_entity", F.col("first").alias("r_first"), F.col("title").alias("r_title"), F.col("volume").alias("r_volume"))
    b = works.where("family IS NOT NULL").select("family", "work_id", "w_entity", F.col("first").alias("w_first"), F.col("title").alias("w_title"), F.col("volume").alias("w_volume"))
    r, w = F.col("r_first"), F.col("w_first")
    either, initial = (F.length(r) <= 1) | (F.length(w) <= 1), lambda x: F.substring(x, 1, 1)
    fits = (r == w) | either & ((r == "") | (w == "") | F.arrays_overlap(F.transform(names.forms_of(r), initial), F.transform(names.forms_of(w), initial)))
    slip = ~either & (F.arrays_overlap(names.forms_of(r), names.forms_of(w)) | (F.least(F.length(r), F.length(w)) > 4) & names.near_column(r, w))
    author = F.when(F.col("r_entity") == F.col("w_entity"), 4).when(fits, 2).when(slip, 3).otherwise(1).alias("author")
    out = ["r_entity", "r_title", "r_volume", "work_id", "w_title", "w_volume"]
    pairs = a.join(pairs, ["family", "r_title"]).join(b, ["family", "w_title"]).select(*out, author, F.col("level").alias("title"))

    by = ["title", "volume"]
    only = works.groupBy(*by).agg(F.min("work_id").alias("work_id"), F.max("work_id").alias("other")).where("work_id = other").select(*by, "work_id")
    nameless = records.where("family IS NULL AND title <> ''").select(*by, "r_entity").join(only, by)
    anonymous = works.where("family IS NULL").groupBy(*by).agg(F.min("work_id").alias("work_id"), F.max("work_id").alias("other")).where("work_id = other").select(*by, "work_id")
    named = records.where("family IS NOT NULL AND title <> ''").select(*by, "r_entity").join(anonymous, by)
    r_title, w_title = [[F.col("title").alias(f"{s}_title"), F.col("volume").alias(f"{s}_volume")] for s in "rw"]
    return pairs.unionByName(nameless.unionByName(named).select("r_entity", *r_title, "work_id", *w_title, F.lit(-1).alias("author"), F.lit(4).alias("title")))


def _fit_by_chance(left: DataFrame, right: DataFrame) -> float:
    """How often two first names drawn from both sides fit: equal, or an initial and a name (or initial) that begins with it."""
    total = float(left.count()) * right.count()
    if not total:
        return 0.0
    counts = lambda df, name: df.groupBy("first").agg(F.count("*").cast("double").alias(name))
    equal = counts(left, "a").join(counts(right, "b"), "first").where("length(first) > 1").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0
    kinds = lambda df: {(r["i"], r["short"]): r["n"] for r in df.groupBy(F.substring("first", 1, 1).alias("i"), (F.length("first") <= 1).alias("short")).agg(F.count("*").alias("n")).collect()}  # noqa: E731  # two rows for each letter
    a, b = kinds(left), kinds(right)
    initial = sum(n * m for (i, s), n in a.items() for (j, t), m in b.items() if i == j and (s or t))
    return (equal + initial) / total


def link(translations: DataFrame, editions: DataFrame, authors: DataFrame, *, entities: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(nkc_id, work_id, confidence, pattern columns): the work that each record translates, if any is listed.

    A record gets the work of highest posterior, of at least ``least``. What the definition of a translation rules out,
    another volume and a Czech year before the work's first (which is known only if the year
    of every edition is), is a known non-match and teaches the model as such; all else the posterior decides. Ties go
    to the higher level of the title and the author, the work whose first known year is least after the Czech one, then to the older work (it has had longer to
    be translated), the title that more editions bear, the smaller work_id. A record without an original title
    takes that of a record of the same author and Czech title, if all such agree. Several rows of one nkc_id
    are one record's versions; the best is kept. Records without title and blank work_ids have no row; empty
    tables give an empty result. ``entities``: (name, entity, family, first) of all names of both sides, as ``names.resolve``
    gives them; computed if not given.
    """
    spark = translations.sparkSession
    # authors: one entity for all spellings of both sources
    owners = authors.where(F.trim("name") != "").select("author_id", "name").distinct()
    if entities is None:
        others = translations.select(F.explode(F.split("secondary_authors", r"\|")).alias("name"))  # spellings that bridge others
        entities = names.resolve(translations.select(F.col("author").alias("name")).unionAll(others).unionAll(owners.select("name")))
    entities = durable(entities.select("name", "entity", "family", "first"))
    model = lookalike.ngram_model(translations, ["original_title", "czech_title"])
    subtitles = _subtitles(translations)
    records = _prepare_records(translations, model, subtitles)
    records = records.join(entities.withColumnsRenamed({"name": "author", "entity": "r_entity"}), "author", "left")
    records = durable(records)
    lent = records.where("title <> '' AND czech <> '' AND r_entity IS NOT NULL").groupBy("r_entity", "czech").agg(F.min(F.struct("title", "volume")).alias("lent"), F.max(F.struct("title", "volume")).alias("_last"))
    lent = lent.where("lent = _last").drop("_last")
    lacking = records.where("title = ''").join(lent, ["r_entity", "czech"]).withColumns({"title": F.col("lent.title"), "volume": F.col("lent.volume")}).select(*records.columns)
    records = durable(records.where("title <> ''").unionByName(lacking))

    now = latest_rows(editions.select("book_id", "work_id", "norm_title", "pub_year", "language_code", "author_id", "loaded_at"), "book_id", "loaded_at")
    now = durable(now.where(F.trim("work_id") != ""))
    titles, works = _prepare_works(now, subtitles)
    titles = durable(titles)
    by = now.select("work_id", "author_id").distinct().join(owners, "author_id").join(entities, "name").select("work_id", F.col("entity").alias("w_entity"), "family", "first").distinct()
    named = durable(titles.join(by, "work_id", "left"))
    forms = records.select("r_entity", "family", "first", "title", "volume").distinct()
    pairs = candidates(forms, named)

    scored = pairs.withColumn("title", title_level(F.col("title"), F.col("r_volume"), F.col("w_volume"))).withColumn("other_volume", (F.col("r_volume") > 0) & (F.col("w_volume") > 0) & (F.col("r_volume") != F.col("w_volume")))
    scored = scored.join(titles.select("work_id", F.col("title").alias("w_title"), F.col("volume").alias("w_volume"), "n"), ["work_id", "w_title", "w_volume"])
    best = F.max(F.struct("title", (~F.col("other_volume")).alias("possible"), "author", "n")).alias("b")
    scored = scored.groupBy("r_entity", "r_title", "r_volume", "work_id").agg(best).select("r_entity", "r_title", "r_volume", "work_id", "b.*")

    per_record = records.select("nkc_id", "r_entity", F.col("title").alias("r_title"), F.col("volume").alias("r_volume"), "year", "lang")
    same = [per_record[c].eqNullSafe(scored[c]) for c in ("r_entity", "r_title", "r_volume")]
    full = per_record.join(scored, same[0] & same[1] & same[2]).select(per_record["nkc_id"], "year", "lang", "work_id", "title", "possible", "author", "n").join(works, "work_id")
    year = F.when(F.col("year") >= F.col("first_year"), 1).when((F.col("year") < F.col("first_year")) & ~F.col("open"), 0).otherwise(-1)
    spoken = F.when(F.col("lang").isNull() | (F.size("langs") == 0), -1).when(F.array_contains("langs", F.col("lang")), 1).otherwise(0)
    early = F.greatest(F.col("first_year") - F.col("year"), F.lit(0))
    full = durable(full.select("nkc_id", "work_id", "n", "author", "title", (F.col("possible") & (year != 0)).alias("possible"), year.alias("year"), spoken.alias("language"), F.coalesce(early, F.lit(0)).alias("early"), "first_year"))

    rows = full.groupBy(*ATTRIBUTES, "possible").agg(F.count("*").alias("c")).collect()  # at most one row for each pattern of levels
    patterns = [(tuple(x[a] for a in ATTRIBUTES), x["c"], x["possible"]) for x in rows]
    # pairs of one author, or one family, that no block brought together: their titles differ
    pairs_of = lambda by: (records.groupBy(by).agg(F.countDistinct("nkc_id").alias("a")).join(named.withColumnRenamed("w_entity", "r_entity").groupBy(by).agg(F.countDistinct("work_id").alias("b")), by).agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0)
    same = pairs_of("r_entity")
    other = pairs_of("family") - same
    # of two people of one family, so many have first names that fit by chance
    chance = _fit_by_chance(records.where("family IS NOT NULL").select("first"), named.where("family IS NOT NULL").select("first"))
    met = lambda *levels: sum(n for p, n, _ in patterns if p[0] in levels)
    rest = {4: same - met(4), 2: chance * (other - met(1, 2, 3)), 1: (1 - chance) * (other - met(1, 2, 3))}
    patterns += [((level, 0, -1, -1), n, False) for level, n in rest.items() if n > 0]
    weights = expectation_maximisation(patterns, list(ATTRIBUTES.values()))
    scores = [(*p, weights.posterior(p)) for p in {p for p, _, possible in patterns if possible}] or [(*(-9 for _ in ATTRIBUTES), 0.0)]
    table = spark.createDataFrame(scores, ", ".join(f"{a} int" for a in ATTRIBUTES) + ", confidence double")
    judged = full.where("possible").join(F.broadcast(table), list(ATTRIBUTES)).where(F.col("confidence") >= least)  # a row for each pattern
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("title")).alias("t"), (-F.col("author")).alias("a"), "early", F.coalesce("first_year", F.lit(9999)).alias("first"), (-F.col("n")).alias("n"), "work_id")
    best = judged.groupBy("nkc_id").agg(F.min_by(F.struct("work_id", "confidence", *ATTRIBUTES), order).alias("x"))
    return best.select("nkc_id", "x.*")
