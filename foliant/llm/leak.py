"""Problem 7: held-out passages that occur, whole or in part, in a corpus.

A prefix-filtered set join. The five-word shingles of the held-out items are ordered by rarity in the corpus; a
document that reproduces enough of an item shares a known number of its shingles (``least_shingles``, which follows
from what the verification accepts), so it must share one of the item's rarest, and only those are joined.
Candidates are bounded by how many of the item's shingles they share (length) and by how close these lie in
the document (position: a piece has no gap of more than ``MOST_GAP`` between its shingles), and verified by word
alignment in these windows: exact runs that may hold single altered words.

The items are the query set: they go to all executors in blocks of bounded size, and the corpus is scanned
in place, twice for each block (rarity, search). Nothing of the corpus but counts of item shingles and found pairs is ever shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import durable

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+")
#: Words in a shingle.
SHINGLE = 5
#: Exact words that must follow a single altered word for a run to go on.
RESUME = 3
#: One altered word in so many: between two of a run lie at least ALTERED_EVERY - 1 exact ones ("here and there").
ALTERED_EVERY = 8
#: Words put in or dropped between two runs that make one piece.
SLACK = 2
#: Shortest run that is a piece of a passage and not a quoted phrase or a stock sentence; of a shorter item, all of it.
LEAST_PIECE = 8
#: The larger piece has at least so many words (of a shorter item, all), and this share of the item's; two stock sentences have not.
LEAST_LARGER, LEAST_LARGER_SHARE = 14, 0.2
#: Between the starts of two neighbouring shingles of one piece: the rest of a shingle, an altered word and SHINGLE - 1 words at the end of one run, words put in, and the same at the start of the next.
MOST_GAP = SHINGLE + (1 + SHINGLE - 1) + SLACK + (SHINGLE - 1 + 1)


def words(text: str | None) -> list[str]:
    """The words of a text without markup, case and punctuation; an apostrophe parts no word."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text if text.isascii() else unicodedata.normalize("NFKC", text).replace("\u2019", "'")
    return _WORD.findall(text.replace("'", "").lower())


def passages(items: DataFrame, *, item: str = "item_id", text: str = "text", stock_items: int = 3) -> DataFrame:
    """(item, text) without the leading sentences that are stock: each followed by ``stock_items`` or more different texts in all items.

    The last sentence always stays. Counted over all items, so it doesn't depend on how they are cut into blocks.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_SENTENCE.split(t.strip()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], names=["i", "s"])

    cut = items.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.trim("t") != "").mapInArrow(split, f"i {dict(items.dtypes)[item]}, s array<string>")
    rest = F.slice("s", F.col("k") + 2, F.size("s"))
    rows = cut.select("i", "s", F.posexplode(F.slice("s", 1, F.size("s") - 1)).alias("k", "sentence")).select("i", "k", "sentence", F.xxhash64(F.concat_ws(" ", rest)).alias("rest"))
    stock = rows.groupBy("sentence").agg(F.countDistinct("rest").alias("n")).where(F.col("n") >= stock_items).select("sentence", F.lit(True).alias("stock"))
    kept = rows.join(stock, "sentence", "left").where("stock IS NULL").groupBy("i").agg(F.min("k").alias("first"))
    first = F.coalesce("first", F.size("s") - 1)
    return cut.join(kept, "i", "left").select(F.col("i").alias(item), F.concat_ws(" ", F.slice("s", first + 1, F.size("s"))).alias(text))


def least_shingles(length: int, share: float) -> int:
    """The fewest shingles of an item of ``length`` words that a document shares if ``reproduced`` gives it ``share``.

    A run is made of exact stretches, SHINGLE or longer one of them, with an altered word between each two; a stretch of s words has
    s - 4 shingles, and one between two altered words has at least 7 words. So a run that counts n words has n / 7 shingles or more where it
    is joined to others (5 words, an altered one, and 4: 7 counted, one shingle), and (n - 1) / 7 where it opens a piece, of which there are two.
    """
    return max(1, ceil((ceil(length * share - 1e-9) - 2) / 7))


def _align(doc: list[int], item: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Maximal runs (matched words, altered words, start in doc, start in item, length) through the seeds."""

    def extend(step: int, x: int, y: int, since: int, floor: int) -> tuple[int, int, int, int]:
        """End, matched and altered words, and the exact ones before the first altered word; ``since``: exact words behind; ``floor``: the first free word."""
        same = altered = 0
        until = None
        fits = lambda k: floor <= x + step * k < len(doc) and 0 <= y + step * k < len(item) and doc[x + step * k] == item[y + step * k]
        while True:
            if fits(0):
                same, since = same + 1, since + 1
            elif since >= ALTERED_EVERY - 1 and all(fits(k) for k in range(1, RESUME + 1)):
                until = same if until is None else until
                altered, since = altered + 1, 0
            else:
                return x, same, altered, same if until is None else until
            x, y = x + step, y + step

    runs, reached = [], {}
    for p, q in sorted(seeds):
        if reached.get(p - q, -1) > p:
            continue
        right, n1, a1, near = extend(1, p, q, len(doc), 0)  # nothing altered yet: the first may come at once
        left, n2, a2, _ = extend(-1, p - 1, q - 1, near if a1 else len(doc), max(0, reached.get(p - q, 0)))  # not into the run before
        reached[p - q] = right
        runs.append((n1 + n2, a1 + a2, left + 1, q - (p - left - 1), right - left - 1))
    return runs


def reproduced(doc: list[int], item: list[int], seeds: list[tuple[int, int]]) -> float:
    """The share of the item's words that the document reproduces in its two best pieces.

    A piece is a run, or runs that follow each other in both texts with at most two words between (a word
    dropped or put in). An altered word is not counted and takes one more, so that sentences built alike
    about other things, where altered words are many, fall short; and the larger piece must be more than a
    stock sentence. The pieces may stand anywhere in the document and in any order.
    """
    pieces: list[list[int]] = []
    for n, a, x, y, length in sorted(_align(doc, item, seeds), key=lambda r: r[2]):
        last = pieces[-1] if pieces else None
        if last and 0 <= x - last[3] <= SLACK and 0 <= y - last[4] <= SLACK and n >= SHINGLE:
            last[0] += n - a - 1
            last[3], last[4] = x + length, y + length
        else:
            pieces.append([n - a, x, y, x + length, y + length])
    pieces = sorted((p for p in pieces if p[0] >= min(LEAST_PIECE, len(item))), reverse=True)
    best = 0
    for k, first in enumerate(pieces):
        if first[0] < max(min(LEAST_LARGER, len(item)), LEAST_LARGER_SHARE * len(item)):
            break
        other = next((p[0] for p in pieces[k + 1 :] if (p[4] <= first[2] or p[2] >= first[4]) and (p[3] <= first[1] or p[1] >= first[3])), 0)
        best = max(best, first[0] + other)
    return best / len(item)


class ItemIndex:
    """Shingles of a block of items."""

    def __init__(self, items: dict[int, list[str]], share: float):
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, w in items.items():
            if 0 < len(w) < SHINGLE:
                self.short[tuple(w)].append(i)
        items = {i: w for i, w in items.items() if len(w) >= SHINGLE}
        self.ids = list(items)
        vocabulary = sorted({w for ws in items.values() for w in ws})
        self.word = {w: k + 1 for k, w in enumerate(vocabulary)}  # 0 is any other word
        self.texts = [[self.word[w] for w in items[i]] for i in self.ids]
        self.share = share
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.texts):
            for p, code in enumerate(self.codes(np.array(t, np.int64)).tolist()):
                postings[code].append((k, p))
        self.code = np.array(sorted(postings), np.uint64)
        self.postings = [postings[c] for c in self.code.tolist()]
        self.prefix: list[frozenset[int]] | None = None

    @staticmethod
    def codes(ids: np.ndarray) -> np.ndarray:
        if len(ids) < SHINGLE:
            return np.empty(0, np.uint64)
        code = np.zeros(len(ids) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            code = code * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - SHINGLE + 1 + k].astype(np.uint64)
            code ^= code >> np.uint64(29)
        return code

    def ids_of(self, found: list[str]) -> list[int]:
        get = self.word.get
        return [get(w, 0) for w in found]

    def hits(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the document, number of the shingle) of the item shingles in a document."""
        codes = self.codes(np.array(ids, np.int64))
        if not len(codes) or not len(self.code):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        at = np.flatnonzero(self.code[k] == codes)
        return at, k[at]

    def order(self, frequency: dict[int, int]) -> None:
        """Fix each item's prefix: its rarest shingles, until fewer places of it are left than a leak must share."""
        own: dict[int, Counter] = defaultdict(Counter)
        for s, places in enumerate(self.postings):
            for item, _ in places:
                own[item][s] += 1
        joined: dict[int, set[int]] = defaultdict(set)
        for item, shingles in own.items():
            need, left = least_shingles(len(self.texts[item]), self.share), sum(shingles.values())
            for s in sorted(shingles, key=lambda s: (frequency.get(s, 0), s)):
                if left < need:
                    break
                joined[s].add(item)
                left -= shingles[s]
        self.prefix = [frozenset(joined.get(s, ())) for s in range(len(self.postings))]

    def leaks(self, text: str | None, *, filtered: bool = True) -> list[tuple[int, float]]:
        """(item, share) of the items that a text leaks; the same without the filters, only later."""
        found = words(text)
        if 0 < len(found) < SHINGLE:
            return [(i, 1.0) for i in self.short.get(tuple(found), ())]
        ids = self.ids_of(found)
        at, shingle = self.hits(ids)
        if not len(at):
            return []
        candidates = set().union(*[self.prefix[s] for s in set(shingle.tolist())]) if filtered else set(range(len(self.texts)))
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, s in zip(at.tolist(), shingle.tolist(), strict=True):
            for item, q in self.postings[s]:
                if item in candidates:
                    seeds[item].append((p, q))
        out = []
        for item, pairs in seeds.items():
            if filtered and not self.enough(pairs, least_shingles(len(self.texts[item]), self.share)):
                continue
            share = reproduced(ids, self.texts[item], pairs)
            if share >= self.share - 1e-9:
                out.append((self.ids[item], share))
        return out

    @staticmethod
    def enough(pairs: list[tuple[int, int]], need: int) -> bool:
        """Length and position: the two windows richest in different places of the item hold as many as a leak must share."""
        if len({q for _, q in pairs}) < need:
            return False
        windows: list[set[int]] = []
        last = None
        for p, q in sorted(pairs):
            if last is None or p - last > MOST_GAP:
                windows.append(set())
            windows[-1].add(q)
            last = p
        return sum(sorted(map(len, windows))[-2:]) >= need


def find_leaks(corpus: DataFrame, items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text", share: float = 1 / 3, block_items: int = 20_000, block_chars: int = 20_000_000) -> DataFrame:
    """(doc, item, share) of each document that reproduces ``share`` or more of an item's passage.

    Case, punctuation, markup and line breaks don't count; an item's leading stock sentences
    are no part of its passage; a passage may stand in one piece or two, with single
    altered words. Items go to the executors in blocks of about ``block_items`` items and ``block_chars`` characters at most, each block against all documents,
    so the size of what is broadcast doesn't depend on the number of items, and the result not on the blocks. Whole texts are searched.

    Null and empty texts leak nothing; an item of fewer than five words is leaked only by a document that consists of it, one of
    up to fourteen only as a whole; an item repeated
    under one id counts once (the greater text); each (doc, item) comes out once; other columns are not
    read; empty tables give an empty result.
    """
    spark = corpus.sparkSession
    asked = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).groupBy(item).agg(F.max(text).alias(text))
    asked = durable(passages(asked, item=item, text=text))
    n, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    blocks = max(1, ceil(n / block_items), ceil(chars / block_chars))
    docs = corpus.select(F.col(doc).alias("d"), F.col(text).alias("t"))
    kind = dict(items.dtypes)[item]
    results = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b).collect()  # bounded by the block
        index = ItemIndex({r[item]: words(r[text]) for r in rows}, share)
        shared = spark.sparkContext.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for t in batch.column(1).to_pylist():
                    seen.update(set(shared.value.hits(shared.value.ids_of(words(t)))[1].tolist()))
            yield pa.RecordBatch.from_pydict({"s": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

        frequency = docs.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()  # at most a row for each shingle of the block
        index.order({r["s"]: r["n"] for r in frequency})
        ordered = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], ordered=ordered) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(k, i, s) for k, t in enumerate(batch.column(1).to_pylist()) for i, s in ordered.value.leaks(t)]
                if hits:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([h[0] for h in hits])), pa.array([h[1] for h in hits]), pa.array([h[2] for h in hits], pa.float64())], names=["d", "i", "share"])

        results.append(docs.mapInArrow(search, f"d {dict(docs.dtypes)['d']}, i {kind}, share double"))
    found = reduce(DataFrame.unionByName, results)
    return found.groupBy("d", "i").agg(F.max("share").alias("share")).select(F.col("d").alias(doc), F.col("i").alias(item), "share")
