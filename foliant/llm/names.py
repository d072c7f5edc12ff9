"""Problem 1: the spellings under which one person or organisation appears.

Merge-and-rematch resolution. Each distinct spelling is parsed into a profile: family name and given names, each
full, a nickname or an initial; of an organisation its first word and the others, each full or abbreviated.
A round of blocking lets every profile ask what it lacks of those it may be one with: an initial the only full
name it fits, a nickname its formal name if someone in the family bears it, a missing middle name the only known
one, an abbreviated word the only full one, a rare spelling the frequent one a slip away. What merges is united:
a merged profile goes on offering every spelling its mentions have, and meets others through each of them. The richer
profiles go back into blocking until a round merges nothing more.

Blocks are never expanded into pairs. Profiles *offer* facts under block keys, facts are reduced to their least and
greatest value ("the only one" is where both agree), and profiles *ask* for the facts of their keys: three shuffles a
round, linear in the profiles. Which spellings are a slip apart never changes, so it is computed once, from keys with
one letter left out; the spellings that can share such a key are bounded by the alphabet. Repeated mentions are reduced
to distinct profiles first, so a hot name costs one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import lookalike
from foliant.session import durable, successive

# Short forms of given names (without accents) and the name they stand for.
NICKNAMES = {
    "abby": "abigail", "sasha": "alexander", "sandy": "alexander", "andy": "andrew", "drew": "andrew", "anicka": "anna", "bara": "barbora",
    "becky": "rebecca", "reba": "rebecca", "bea": "beatrice", "trixie": "beatrice", "ben": "benjamin", "benny": "benjamin", "bert": "albert", "beta": "alzbeta", "betka": "alzbeta", "eliska": "elizabeth",
    "bess": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "libby": "elizabeth", "bill": "william", "billy": "william", "will": "william", "willy": "william",
    "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "charlie": "charles", "chuck": "charles", "chris": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah",
    "dick": "richard", "rick": "richard", "rich": "richard", "dolly": "dorothy", "dot": "dorothy", "dottie": "dorothy", "ed": "edward", "eddie": "edward", "ned": "edward", "theo": "theodore",
    "fanny": "frances", "fran": "frances", "francie": "frances", "fanda": "frantisek", "franta": "frantisek", "frantik": "frantisek", "fred": "frederick", "freddie": "frederick", "gabi": "gabriela", "greg": "gregory", "hank": "henry", "hal": "henry", "harry": "henry",
    "honza": "jan", "jenda": "jan", "jim": "james", "jimmy": "james", "jamie": "james", "jirka": "jiri", "joe": "joseph", "judy": "judith", "janicka": "jana", "jarda": "jaroslav", "kaja": "karel", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine", "kay": "katherine",
    "kvetka": "kveta", "lada": "vladimir", "vlada": "vladimir", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "lida": "ludmila", "lidka": "ludmila", "lottie": "charlotte", "maggie": "margaret", "marge": "margaret", "meg": "margaret", "peggy": "margaret", "peg": "margaret", "mandy": "amanda", "marenka": "marie", "maruska": "marie",
    "matt": "matthew", "mike": "michael", "mick": "michael", "mina": "wilhelmina", "minnie": "wilhelmina", "nell": "eleanor", "nellie": "eleanor", "ellie": "eleanor", "nora": "eleanor", "nick": "nicholas", "nicky": "nicholas", "odie": "odile", "olina": "olga", "ota": "otakar", "patty": "patricia", "trish": "patricia", "tricia": "patricia",
    "pepa": "josef", "pepik": "josef", "pete": "peter", "petr": "peter", "ron": "ronald", "sam": "samuel", "steve": "stephen", "steven": "stephen", "sue": "susan", "susie": "susan", "suzy": "susan", "terka": "tereza", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "vasek": "vaclav", "venca": "vaclav", "verca": "veronika", "vera": "veronika", "vicky": "victoria", "vickie": "victoria",
    "walt": "walter", "wally": "walter", "zdenda": "zdenek", "zuzka": "zuzana", "zuza": "zuzana",
}
# Short forms that stand for several names; which one, the family decides.
SHARED_NICKNAMES = {"ted": ["edward", "theodore"], "teddy": ["edward", "theodore"], "pat": ["patricia", "patrick"], "alex": ["alexander", "alexandra"], "al": ["albert", "alan", "alfred"]}
# Words that are no part of a name, particles, and some words that name a kind of organisation; more are learned.
TITLES = set("prof dr phd phdr mudr judr rndr ing mgr bc doc csc drsc sir jr sr jun sen ed eds ill trans".split())
PARTICLES = set("de del della der den di du da dos la le van von vom zu zum zur af ter ten".split())
ORGANISATIONS = set("institute department laboratory museum council society association academy foundation committee group press university publishing library company centre center office college agency bureau union ministry".split())
# Abbreviations that are not the beginning of what they stand for, or too short; words between a kind of organisation and its name.
ORGANISATION_SHORT = {"inst": "institute", "dept": "department", "lab": "laboratory", "mus": "museum", "cncl": "council", "soc": "society", "assoc": "association", "acad": "academy", "found": "foundation", "comm": "committee", "grp": "group", "univ": "university", "publ": "publishing"}
#: A given name is common if it has this share of all first given names; at most 1 / COMMON names are. Likewise the words that name a kind of organisation.
COMMON = 0.001
#: Family names shorter than this are corrected only if two full given names agree, those of less than three letters never; words of organisations that are shorter may be cut and are no slips of others.
LEAST_FAMILY = 5

OF = set("of for für".split())

_BASE = 0x9E3779B97F4A7C15
_DATES = re.compile(r"[,\s]*\(?\b\d{3,4}\??\s*[-–—]?\s*(?:\d{3,4})?\)?")
_BRACKETS = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_TOKEN = re.compile(r"[^\W\d_]+")
_SKELETON = [("rzh", "r"), ("zh", "z"), ("sh", "s"), ("ch", "c"), ("ue", "u"), ("oe", "o"), ("ae", "a")]
_SPECIAL = str.maketrans({"ß": "ss", "ł": "l", "ø": "o", "đ": "d", "æ": "a", "œ": "o", "’": "'", "‘": "'", "ʼ": "'"})


def fold(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFKD", text.lower().translate(_SPECIAL))
    return "".join(c for c in plain if not unicodedata.combining(c))


def skeleton(word: str) -> str:
    """A form in which transliterated and plain letters agree: ü, ue and u are one, ž and zh, and so on."""
    for a, b in _SKELETON:
        word = word.replace(a, b)
    return word


def near(a: str, b: str) -> bool:
    """At most one letter put in, left out, changed, or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def deletions(word: str) -> set[str]:
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


def slip_keys(word: str) -> np.ndarray:
    """Hashes of which two words at most one slip apart share one: of the word (the last), and of all that one letter less leaves.

    A hash joins those of the letters before and after the gap, so a word costs as many steps as it has letters.
    Words may share a hash by accident; ``near`` decides.
    """
    codes = np.array([ord(c) for c in word], np.uint64)
    power = np.cumprod(np.full(len(codes) + 1, _BASE, np.uint64))
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:-1])])  # of the first k letters
    after = np.concatenate([np.cumsum((codes[1:] * power[:-2])[::-1])[::-1], np.zeros(1, np.uint64)])[: len(codes)]  # of those after the gap, one place to the left
    return np.append(np.unique(before[:-1] + after), before[-1]).view(np.int64)


@dataclass(frozen=True)
class Parsed:
    kind: str  # person, organisation
    family: str  # of an organisation its first word and three letters of each other
    first: str  # a nickname is written with what it may stand for: bob=robert; of an organisation its other words
    second: str = ""
    third: str = ""  # and all later names


class Parser:
    """Names to profiles, given the common given names and the words that name kinds of organisation."""

    def __init__(self, model: lookalike.Model, common: set[str] = frozenset(), heads: set[str] = frozenset()):
        self.model = model
        self.common = {skeleton(x) for x in common}
        self.formal = {skeleton(a): (skeleton(b),) for a, b in NICKNAMES.items()} | {a: tuple(map(skeleton, b)) for a, b in SHARED_NICKNAMES.items()}
        written = {*common, *NICKNAMES, *NICKNAMES.values(), *SHARED_NICKNAMES, *(x for v in SHARED_NICKNAMES.values() for x in v)}
        self.given = {skeleton(x) for x in written}
        self.longest = max(map(len, written))
        self.spelling: dict[str, list[tuple[str, str]]] = {}
        for form, name in sorted({(f, skeleton(x)) for x in written for f in (x, skeleton(x))}):  # a slip may fall into a transliterated letter
            if len(form) >= 4:
                for key in deletions(form):
                    self.spelling.setdefault(key, []).append((form, name))
        self.heads = ORGANISATIONS | set(heads)
        self.sorted_heads = sorted(self.heads)

    def known(self, token: str) -> str | None:
        """The given name that a folded token is or misspells; None if it is none."""
        for form in dict.fromkeys((skeleton(token), token)):  # a slip may look like a transliteration
            if form in self.given:
                return form
        for form in dict.fromkeys((skeleton(token), token)):
            if 4 <= len(form) <= self.longest + 1:
                found = {n for key in deletions(form) for f, n in self.spelling.get(key, ()) if near(form, f)}
                for group in (found & self.common, found):  # a slip of a common name before one of a rare name
                    if len(group) == 1:
                        return min(group)
                    if len(meant := {self.formal.get(n, (n,)) for n in group}) == 1:
                        return meant.pop()[0]
        return None

    def token(self, word: str) -> str:
        """A given name as profiles hold it: an initial, a name, or a nickname with what it may stand for."""
        if len(word) == 1:
            return word
        name = self.known(word) or skeleton(word)
        return f"{name}={','.join(self.formal[name])}" if name in self.formal else name

    def _head(self, word: str) -> str | None:
        """The kind of organisation that a word names, be it abbreviated or misspelt."""
        word = ORGANISATION_SHORT.get(word, word)
        if word in self.heads:
            return word
        return next((h for h in self.sorted_heads if len(word) > 4 and near(word, h)), None)

    def _organisation(self, tokens: list[str]) -> Parsed | None:
        """The profile if a word names a kind of organisation; after a given name only as one of three words or more and well spelt."""
        if len(tokens) < 2:
            return None
        if self.known(tokens[0]):
            if len(tokens) < 3 or not any(ORGANISATION_SHORT.get(t, t) in self.heads for t in tokens):
                return None
        elif not any(self._head(t) for t in (tokens if len(tokens) > 2 else tokens[1:])):
            return None
        if k := next((k for k, t in enumerate(tokens[1:3], 1) if t in OF), 0):  # "Academy of X Y Z" is "X Y Z Academy"
            tokens = tokens[k + 1 :] + tokens[:k]
        tokens = [self._head(t) or t for t in tokens if t not in OF and t not in ("the", "and")]
        if len(tokens) < 2:
            return None
        return Parsed("organisation", " ".join([tokens[0], *(t[:3] for t in tokens[1:])]), " ".join(tokens[1:]))

    def split(self, text: str | None) -> tuple[list[str], list[str], bool] | Parsed | None:
        """Family and given tokens (folded), and whether a comma told them apart."""
        if text is None:
            return None
        text = self.model.consistent(text) or ""
        text = _BRACKETS.sub(" ", text)
        text = fold(_DATES.sub(" ", text))
        parts = [[t for t in _TOKEN.findall(p.replace("'", "")) if t not in TITLES] for p in text.split(",")]
        parts = [p for p in parts if p]
        if not parts:
            return None
        if len(parts) == 1 and (organisation := self._organisation(_TOKEN.findall(text))):
            return organisation
        if len(parts) > 1:
            return parts[0], parts[1], True
        return parts[0][-1:], parts[0][:-1], False

    def parse(self, text: str | None) -> Parsed | None:
        """The profile of a name; None if it holds no word."""
        got = self.split(text)
        if got is None or isinstance(got, Parsed):
            return got
        family, given, comma = got
        strip = lambda ts: [t for t in ts if t not in PARTICLES]
        family, given = strip(family) or family, strip(given)
        if not comma and given:  # "Family Given" without a comma
            first, last = given[0], family[0]
            if len(first) > 1 and (len(last) == 1 or (self.known(first) is None and self.known(last) is not None)):
                family, given = given[:1], [*given[1:], *family]
        base = "".join(family)
        if len(base) > 6 and base.endswith("ova"):
            base = base[:-3]
        names = [*map(self.token, given), "", ""]
        return Parsed("person", base, names[0], names[1], " ".join(t.partition("=")[0] for t in names[2:-2]))


def _common(names: DataFrame, name: str, take: Callable[[str], str | None]) -> set[str]:
    """Words that make up COMMON of all that ``take`` finds, and two of them at least: at most 1 / COMMON words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"g": pa.array([w for text in batch.column(0).to_pylist() if (w := take(text))], pa.string())})

    counts = names.select(name).mapInArrow(words, "g string").groupBy("g").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * COMMON)).select("g").collect()
    return {r["g"] for r in rows}


def common_given(names: DataFrame, name: str, parser: Parser) -> set[str]:
    """The common ones of all first given names written after a comma."""

    def first(text: str) -> str | None:
        got = parser.split(text)
        return got[1][0] if isinstance(got, tuple) and got[2] and len(got[1][0]) > 1 else None

    return _common(names, name, first)


def organisation_heads(names: DataFrame, name: str, parser: Parser) -> set[str]:
    """Words that name a kind of organisation: the common ones of all that open a name without a comma before "of"."""

    def head(text: str) -> str | None:
        if "," in (text or ""):
            return None
        words = _TOKEN.findall(fold(parser.model.consistent(text) or ""))
        return words[0] if len(words) > 2 and words[1] in OF and len(words[0]) > 3 and not parser.known(words[0]) else None

    return _common(names, name, head)


PROFILE = ["kind", "family", "first", "second", "third"]
_OWN = [f"own_{c}" for c in PROFILE]


def _skeleton(family: Column) -> Column:
    for a, b in _SKELETON:
        family = F.replace(family, F.lit(a), F.lit(b))
    return family


def near_column(a: Column, b: Column) -> Column:
    """For words that share a key: one letter put in, left out or changed, or two swapped, or the same skeleton."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    apart = F.levenshtein(a, b, 2)  # -1 beyond two; the bound keeps long names cheap
    swapped = (F.length(a) == F.length(b)) & (apart == 2) & (letters(a) == letters(b))
    return apart.isin(0, 1) | swapped | (_skeleton(a) == _skeleton(b))


def close_spellings(texts: DataFrame) -> DataFrame:
    """(kind, text, near): to each (kind, text), distinct, the other texts of its kind that are one slip away; only those that have some.

    Texts of less than three letters have none. No text is compared with all of a group: what can share a key is bounded by the alphabet.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(np.append(slip_keys(t), slip_keys("~" + skeleton(t))[-1])) ^ k if len(t) > 2 else np.empty(0, np.int64) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            place = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), pa.array(np.concatenate([np.empty(0, np.int64), *own]))], names=["id", "key"])

    texts = texts.select(F.xxhash64("kind", "text").alias("id"), "kind", "text")  # numbers travel, not texts
    shared = texts.select("id", "text", F.xxhash64("kind")).mapInArrow(keys, "id long, key long").groupBy("key").agg(F.collect_set("id").alias("ids"))
    pairs = shared.where("size(ids) > 1").select("ids", F.explode("ids").alias("a")).select("a", F.explode("ids").alias("b")).where("a <> b").distinct()
    sides = [texts.select(F.col("id").alias(i), F.col("kind").alias(f"kind_{i}"), F.col("text").alias(f"text_{i}")) for i in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").where((F.col("kind_a") == F.col("kind_b")) & near_column(F.col("text_a"), F.col("text_b")))
    return both.groupBy(F.col("kind_a").alias("kind"), F.col("text_a").alias("text")).agg(F.array_sort(F.collect_set("text_b")).alias("near"))


def _spellings(nodes: DataFrame) -> DataFrame:
    """(kind, text, f, near): each family name, and each other word of an organisation (kind ``word``), its mentions, and the spellings one slip away."""
    families = nodes.select("kind", F.col("family").alias("text"), "n")
    words = nodes.where("kind = 'organisation'").select(F.lit("word").alias("kind"), F.explode(F.split("first", " ")).alias("text"), "n")
    counted = durable(families.unionAll(words).groupBy("kind", "text").agg(F.sum("n").alias("f")))
    return counted.join(close_spellings(counted), ["kind", "text"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>")))


def _start(parsed: DataFrame) -> DataFrame:
    """A row for each profile, with what never changes: ``own_*`` as parsed, ``near`` spellings of the family, ``near_words``."""
    nodes = durable(parsed.groupBy(*PROFILE).agg(F.sum("n").alias("n")))
    spelt = durable(_spellings(nodes))
    of = lambda kind: spelt.where(F.col("kind") == kind).select("text", "f", "near")
    organisations = nodes.where("kind = 'organisation'").select("family", "first", F.posexplode(F.split("first", " ")).alias("k", "text")).join(of("word"), "text")
    words = organisations.groupBy("family", "first").agg(F.array_sort(F.collect_list(F.struct("k", "f", "near"))).alias("w"))  # the words of one name
    words = words.select(F.lit("organisation").alias("kind"), "family", "first", F.col("w.f").alias("word_f"), F.col("w.near").alias("near_words"))
    nodes = nodes.join(spelt.withColumnRenamed("text", "family"), ["kind", "family"]).join(words, ["kind", "family", "first"], "left")
    own = F.concat_ws("|", *PROFILE).alias("own")
    return nodes.select(own, *[F.col(c).alias(f"own_{c}") for c in PROFILE], *PROFILE, "f", "near", "word_f", "near_words", F.lit(True).alias("changed"))


def _name(token: Column) -> Column:
    return F.substring_index(token, "=", 1)


def _formals(token: Column) -> Column:
    return F.when(F.contains(token, F.lit("=")), F.split(F.substring_index(token, "=", -1), ",")).otherwise(F.array().cast("array<string>"))


def forms_of(token: Column) -> Column:
    return F.concat(F.array(_name(token)), _formals(token))


def _key(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])


FULL, INITIAL = "length({0}) > 1", "length({0}) = 1"


def _levels() -> list[tuple[str, Column, Column]]:
    """(name, path, whether those before are known well enough to fill it) of each given name but the first."""
    c = F.col
    return [
        ("second", _key(c("kind"), c("family"), c("first")), F.expr(FULL.format("first")) | (c("first") == "")),
        ("third", _key(c("kind"), c("family"), c("first"), c("second")), F.expr(FULL.format("second"))),
    ]


def _offers() -> Column:
    """(key, m, v) rows: what profiles tell those that may be one with them."""
    c, initial = F.col, lambda t: F.substring(t, 1, 1)
    person, organisation = c("kind") == "person", c("kind") == "organisation"
    block = _key(c("kind"), c("family"))
    fact = lambda key, v, m=F.lit(0).cast("long"): F.struct(key.alias("key"), m.alias("m"), v.alias("v"))
    none = F.array().cast("array<struct<key:string,m:bigint,v:string>>")
    given = lambda cond, rows: F.when(cond, rows).otherwise(none)
    each = lambda keys, what, level, path, v: F.transform(keys, lambda x: fact(_key(what, level, path, x), v))
    full = person & F.expr(FULL.format("first"))
    initials = F.array_distinct(F.transform(forms_of(c("first")), initial))
    beside = F.when(c("second") == "", F.lit("=")).otherwise(initial(c("second")))
    rows = [given(full, F.transform(initials, lambda i: fact(_key("A", block, i, ""), c("first")))), given(full, F.transform(initials, lambda i: fact(_key("A", block, i, beside), c("first"))))]
    for level, path in (("first", block), ("second", _levels()[0][1])):
        certain = person & F.expr(FULL.format(level)) & (F.size(_formals(c(level))) <= 1)
        rows.append(given(certain, each(forms_of(c(level)), "N", level, path, c(level))))
    for level, path, fits in _levels():
        long = F.expr(FULL.format(level))
        keys = F.array(F.lit(""), initial(c(level)))
        rows.append(given(person & fits & (c(level) != ""), each(keys, "B", level, path, initial(c(level)))))
        rows.append(given(person & fits & long, each(keys, "L", level, path, c(level))))
    # under the own spelling, the family that the merged profile has
    family = lambda key: fact(key, c("family"), c("f"))
    rows.append(given(full, F.transform(F.concat(forms_of(c("first")), initials), lambda x: family(_key("C", c("kind"), c("own_family"), x)))))
    rows.append(given(full & F.expr(FULL.format("second")) & (F.length("own_family") <= LEAST_FAMILY), F.transform(forms_of(c("first")), lambda x: family(_key("S", c("kind"), c("own_family"), x, _name(c("second")))))))
    rows.append(given(organisation, F.array(family(_key("C", c("kind"), c("own_family"), "")))))
    # each word of an organisation, and what it may be cut to
    words = F.split("first", " ")
    place = F.sequence(F.lit(0), F.size(words) - 1)
    word = lambda k: F.get(words, k)
    cut = lambda k: F.when(F.length(word(k)) > 3, F.transform(F.sequence(F.lit(3), F.length(word(k)) - 1), lambda n: fact(_key("W<", block, k.cast("string"), F.substring(word(k), F.lit(1), n)), word(k), F.get("word_f", k)))).otherwise(none)
    rows.append(given(organisation, F.transform(place, lambda k: fact(_key("W=", block, k.cast("string"), word(k)), word(k), F.get("word_f", k)))))
    rows.append(given(organisation, F.flatten(F.transform(place, cut))))
    return F.concat(*rows)


def _asks() -> Column:
    """(what, place, say, self, key) rows: what profiles lack. Complete ones with no spelling near theirs ask nothing."""
    c, initial = F.col, lambda t: F.substring(t, 1, 1)
    person, organisation = c("kind") == "person", c("kind") == "organisation"
    block = _key(c("kind"), c("family"))
    null = F.lit(None).cast("string")
    ask = lambda what, key, place=F.lit(0), say=null, self=null: F.struct(F.lit(what).alias("what"), place.cast("int").alias("place"), say.alias("say"), self.alias("self"), key.alias("key"))
    none = F.array().cast("array<struct<what:string,place:int,say:string,self:string,key:string>>")
    given = lambda cond, rows: F.when(cond, rows).otherwise(none)
    formal = lambda level, path, only: F.transform(_formals(c(level)), lambda x: ask(f"N {level}", _key("N", level, path, x), say=x, self=only))
    short = person & F.expr(INITIAL.format("first"))
    two = c("second") != ""
    rows = [
        given(short & ~two, F.array(ask("A", _key("A", block, c("first"), "")))),
        given(short & two, F.array(ask("A", _key("A", block, c("first"), initial(c("second")))), ask("A", _key("A", block, c("first"), "="), F.lit(1)), ask("A", _key("A", block, c("first"), ""), F.lit(9)))),
    ]
    for level, path in (("first", block), ("second", _levels()[0][1])):
        only = F.when(F.size(_formals(c(level))) == 1, c(level))
        rows.append(given(person & F.contains(c(level), F.lit("=")), formal(level, path, only)))
    for level, path, fits in _levels():
        lacks = person & fits & (F.length(level) <= 1)
        rows.append(given(lacks, F.array(ask(f"B {level}", _key("B", level, path, c(level))), ask(f"L {level}", _key("L", level, path, c(level))))))
    # by every spelling one slip away, and by the spelling taken over, whose bearers may have moved on
    others = F.array_except(F.array_union("near", F.array("family")), F.array("own_family"))
    brief = lambda b: (F.length("own_family") < LEAST_FAMILY) | (F.length(b) < LEAST_FAMILY)
    long = F.filter(others, lambda b: ~brief(b) | (b == c("family")))
    meets = F.when(organisation, F.array(F.lit(""))).otherwise(forms_of(c("first")))
    full = person & F.expr(FULL.format("first"))
    rows.append(given(full | organisation, F.flatten(F.transform(long, lambda b: F.transform(meets, lambda x: ask("C", _key("C", c("kind"), b, x)))))))
    rows.append(given(full & F.expr(FULL.format("second")), F.flatten(F.transform(F.filter(others, brief), lambda b: F.transform(meets, lambda x: ask("C", _key("S", c("kind"), b, x, _name(c("second")))))))))
    rows.append(given(short, F.transform(long, lambda b: ask("D", _key("C", c("kind"), b, c("first"))))))
    words = F.split("first", " ")
    place = F.sequence(F.lit(0), F.size(words) - 1)
    rows.append(given(organisation, F.transform(place, lambda k: ask("W<", _key("W<", block, k.cast("string"), F.get(words, k)), k))))
    rows.append(given(organisation, F.flatten(F.transform(place, lambda k: F.transform(F.filter(F.get("near_words", k), lambda w: F.length(w) >= LEAST_FAMILY), lambda w: ask("W=", _key("W=", block, k.cast("string"), w), k))))))
    return F.concat(*rows)


def _round(nodes: DataFrame, offers: Column, asks: Column) -> DataFrame:
    """All profiles after one round of asking, with whether they changed."""
    c = F.col
    facts = nodes.select(F.explode(offers).alias("x")).select("x.*").groupBy("key").agg(F.min(F.struct("m", "v")).alias("lo"), F.max(F.struct("m", "v")).alias("hi"))
    told = nodes.select("own", F.explode(asks).alias("x")).select("own", "x.*").join(facts, "key")
    one = c("lo.v") == c("hi.v")
    is_ = lambda what: c("what") == what
    said = lambda what: F.when(is_(what) & (c("self").isNull() | (c("lo.v") != c("self")) | (c("hi.v") != c("self"))), c("say"))
    parts = [
        F.min_by("hi.v", F.when(is_("A") & one & (c("place") < 9), c("place"))).alias("a"), F.max(is_("A")).alias("fitted"), F.max(F.when(is_("C"), c("hi"))).alias("c"), F.min(F.when(is_("D"), c("lo"))).alias("d"), F.max(F.when(is_("D"), c("hi"))).alias("d_last"),
        F.collect_list(F.when(is_("W<") & one, F.struct("place", c("hi.m").alias("m"), c("hi.v").alias("v")))).alias("full"), F.collect_list(F.when(is_("W="), F.struct("place", c("hi.m").alias("m"), c("hi.v").alias("v")))).alias("slips"),  # by the words of one name
    ]
    for level in ("first", "second"):
        parts += [F.min(said(f"N {level}")).alias(f"n_{level}"), F.max(said(f"N {level}")).alias(f"n_{level}_last")]
    for level in ("second", "third"):
        parts += [F.max(F.when(is_(f"B {level}") & one, c("hi.v"))).alias(f"b_{level}"), F.max(is_(f"L {level}")).alias(f"any_{level}"), F.max(F.when(is_(f"L {level}") & one, c("hi.v"))).alias(f"l_{level}")]
    answers = told.groupBy("own").agg(*parts)
    both = nodes.join(answers, "own", "left")
    initial = F.expr(INITIAL.format("first"))
    formal = lambda level: F.when(F.contains(c(level), F.lit("=")) & (c(f"n_{level}") == c(f"n_{level}_last")), c(f"n_{level}"))
    filled = lambda level: F.when(c(f"b_{level}").isNotNull(), F.when(c(f"any_{level}"), c(f"l_{level}")).otherwise(c(f"b_{level}")))
    better = F.struct(c("c.m").alias("m"), c("c.v").alias("v")) > F.struct(c("f").alias("m"), c("family").alias("v"))
    lone = initial & ~F.coalesce("fitted", F.lit(False)) & (c("d") == c("d_last")) & (c("d.v") != c("family")) & (c("d.m") >= c("f"))
    family = F.when(better, c("c")).when(lone, c("d")).otherwise(F.struct(c("f").alias("m"), c("family").alias("v")))
    words = F.split("first", " ")

    def word(k: Column) -> Column:
        now = F.struct(F.get("word_f", k).alias("m"), F.get(words, k).alias("v"))
        at = lambda x: F.transform(F.filter(x, lambda y: y["place"] == k), lambda y: F.struct(y["m"].alias("m"), y["v"].alias("v")))
        return F.coalesce(F.get(at(c("full")), F.lit(0)), F.array_max(F.concat(at(c("slips")), F.array(now))))

    spelt = F.when((c("kind") == "organisation") & c("full").isNotNull(), F.transform(F.sequence(F.lit(0), F.size(words) - 1), word))
    both = both.withColumns({"_family": family, "_words": spelt})
    after = {
        "first": F.coalesce(F.array_join("_words.v", " "), F.when(initial, c("a")), formal("first"), "first"),
        "second": F.coalesce(F.when(F.length("second") <= 1, filled("second")), formal("second"), "second"),
        "third": F.coalesce(F.when(F.length("third") <= 1, filled("third")), "third"),
    }
    moved = both.select("own", *_OWN, "kind", c("_family.v").alias("family"), *[x.alias(k) for k, x in after.items()], c("_family.m").alias("f"), "near", F.coalesce("_words.m", "word_f").alias("word_f"), "near_words", F.struct(*PROFILE).alias("_before"))
    return moved.withColumn("changed", F.struct(*PROFILE) != c("_before")).drop("_before")


def resolve(mentions: DataFrame, *, name: str = "name") -> DataFrame:
    """(name, entity, kind, family, first) of each distinct non-blank name; equal entities are one person or organisation.

    ``first`` is written as in ``Parsed``.

    Rounds go on until one merges nothing. They end by themselves: a change makes an initial full, fills a gap, or
    goes to a more frequent spelling, and none of these is ever undone. Where a form fits
    several people of a family ("J. Smith" of Jan and Josef) it stays apart from all of them. Null and blank
    names and names without a letter have no row; an empty table gives an empty result.
    """
    spark = mentions.sparkSession
    counted = durable(mentions.select(F.col(name).alias("name")).where(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("n")))
    plain = Parser(lookalike.ngram_model(counted, ["name"]))
    common = common_given(counted, "name", plain)
    heads = organisation_heads(counted, "name", Parser(plain.model, common))
    parser = spark.sparkContext.broadcast(Parser(plain.model, common, heads))  # at most 1 / COMMON names and words

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(t, n, p) for t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (p := parser.value.parse(t))]
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), *(pa.array([getattr(g[2], c) for g in got], pa.string()) for c in PROFILE)]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "n", *PROFILE])

    parsed = durable(counted.mapInArrow(profile, "name string, n long, " + ", ".join(f"{c} string" for c in PROFILE)))
    offers, asks = _offers(), _asks()  # long expressions: built once for all rounds
    nodes = successive(_start(parsed), lambda df: _round(df, offers, asks), lambda df: df.where("changed").limit(1).count() == 0)
    bare = [F.substring_index(c, "=", 1).alias(c) if c in ("first", "second") else F.col(c) for c in PROFILE]
    own = nodes.select(*[F.col(o).alias(c) for o, c in zip(_OWN, PROFILE, strict=True)], F.concat_ws("|", *bare).alias("entity"), F.col("family").alias("_family"), F.col("first").alias("_first"))
    return parsed.select("name", *PROFILE).join(own, PROFILE).select("name", "entity", "kind", F.col("_family").alias("family"), F.col("_first").alias("first"))


def mentions_of(translations: DataFrame, *, key: str = "nkc_id", author: str = "author", others: str = "secondary_authors") -> DataFrame:
    """(key_b, name) of each mention: number 0 is the author, from 1 the elements of ``others`` split at |."""
    parts = F.posexplode(F.concat(F.array(author), F.coalesce(F.split(others, r"\|"), F.array().cast("array<string>")))).alias("k", "name")
    rows = translations.select(key, parts).where(F.trim("name") != "")
    return rows.select(F.concat_ws("#", key, F.col("k").cast("string")).alias("key_b"), "name").distinct()


def members(translations: DataFrame, authors: DataFrame) -> DataFrame:
    """(key, author, entity) of each author id (``author``) and each mention: the class that it belongs to.

    One row for each pair of key and entity; an author id with names of two people has two. Null keys and
    blank names have no row.
    """
    mentions = mentions_of(translations).select(F.col("key_b").alias("key"), "name", F.lit(False).alias("author"))
    owners = authors.where(F.trim("name") != "").select(F.col("author_id").alias("key"), "name", F.lit(True).alias("author"))
    said = durable(mentions.unionAll(owners).where("key IS NOT NULL").distinct())
    entities = resolve(said)
    return said.join(entities, "name").select("key", "author", "entity").distinct()


def class_links(member: DataFrame) -> DataFrame:
    """``members`` with ``links``: the number of pairs of ``found`` that the key stands in, by its class's counts."""
    sizes = member.groupBy("entity").agg(F.sum(F.col("author").cast("long")).alias("a"), F.sum((~F.col("author")).cast("long")).alias("b"))
    return member.join(sizes, "entity").select("key", "author", "entity", F.when(F.col("author"), F.col("a") - 1 + F.col("b")).otherwise(F.col("a")).alias("links"))


def found(translations: DataFrame, authors: DataFrame, *, cell: int = 1_000) -> DataFrame:
    """(key_a, key_b): pairs of author ids, and of an author id and a mention, that name the same entity.

    The pairs are what is asked for; ``members`` holds the same in one row a key. A class of more than ``cell`` keys is
    cut into cells, so no task expands a large class alone.
    """
    member = durable(members(translations, authors))
    large = durable(member.groupBy("entity").agg(F.count("*").alias("size")).where(F.col("size") > cell).select("entity", F.ceil(F.col("size") / cell).cast("int").alias("cells")))
    cut = member.join(large, "entity", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    right = cut.select("entity", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int").alias("cell"), F.col("key").alias("key_b"), "author")
    left = cut.where("author").select("entity", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("key").alias("key_a"))
    pairs = left.join(right, ["entity", "cell"]).where("NOT author OR key_a < key_b")
    return pairs.select("key_a", "key_b").distinct()
