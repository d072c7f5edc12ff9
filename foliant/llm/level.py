"""Problem 9: the reading level of each document.

A smoothed unigram language model for each grade level, trained on the rated documents. A document's level is the one
of highest posterior, all levels being equally likely before, by the likelihood of all its words. As an option each sentence has a posterior and their
mean decides, so that a long quotation from another level doesn't decide by its sheer likelihood.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = (1, 2, 3, 4)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Upper bounds of the LIX readability formula for levels 1 to 3, used to seed a level that nobody rated.
LIX_BOUNDS = (25.0, 40.0, 58.0)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence or line, lower case, without markup."""
    plain = _TAG.sub("\n", html.unescape(text) if "&" in text else text)
    return [w for s in _SENTENCE.split(plain.lower()) if (w := _WORD.findall(s))]


def formula_level(text: str) -> int:
    """The level that the LIX formula gives: words a sentence plus the share of words over six letters."""
    split = sentences(text)
    n = sum(map(len, split))
    lix = n / max(1, len(split)) + 100 * sum(len(w) > 6 for s in split for w in s) / max(1, n)
    return 1 + sum(lix > b for b in LIX_BOUNDS)


@dataclass
class LevelModel:
    """Log-probabilities of the vocabulary under each level's language model."""

    place: dict[str, int]
    log_p: np.ndarray

    def posterior(self, text: str, *, by_sentence: bool = False) -> np.ndarray | None:
        """Posterior over LEVELS, of the whole text or as the mean of its sentences'; None if the text has no word."""
        split = sentences(text)
        if not split:
            return None
        unknown = len(self.place)
        get = self.place.get
        ids = np.fromiter((get(w, unknown) for s in split for w in s), np.int64)
        starts = np.cumsum([0, *map(len, split[:-1])]) if by_sentence else np.zeros(1, np.int64)
        score = np.add.reduceat(self.log_p[ids], starts, axis=0)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return (p / p.sum(axis=1, keepdims=True)).mean(axis=0)


def train(documents: DataFrame, ratings: DataFrame, *, doc: str = "doc_id", text: str = "text", band: str = "band", max_documents: int = 50_000, least_documents: int = 3, smoothing: float = 0.5) -> LevelModel:
    """Fit the unigram models on at most ``max_documents`` rated documents (chosen by a hash of the id).

    The bound is what keeps the model small: words that fewer than ``least_documents`` of the sample use are
    left to smoothing. Each rater of a document gives an equal part of its words to a level; ratings outside
    1 to 4 and ratings of unknown documents are left out. If nobody rated a level, documents of a sample of
    the same size are seeded by the formula for it.
    """
    rated = ratings.where(F.col(band).isin(*LEVELS) & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("_doc"))
    votes = rated.agg(*[F.avg((F.col(band) == b).cast("double")).alias(f"v{b}") for b in LEVELS])
    votes = votes.orderBy(F.xxhash64("_doc"), "_doc").limit(max_documents)
    sample = documents.where(F.col(text).isNotNull()).join(F.broadcast(votes), F.col(doc) == F.col("_doc")).select(F.col(text).alias("t"), *[f"v{b}" for b in LEVELS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, list[float]] = defaultdict(lambda: [0.0] * 5)
        for batch in batches:
            columns = batch.to_pydict()
            for t, *v in zip(*columns.values(), strict=True):
                if v[0] is None:  # not rated
                    v = [float(formula_level(t) == b) for b in LEVELS]
                for w, n in Counter(w for s in sentences(t) for w in s).items():
                    row = table[w]
                    row[4] += 1
                    for k in range(4):
                        row[k] += n * v[k]
        names = ["w", "c1", "c2", "c3", "c4", "df"]
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(table), pa.string())} | {c: pa.array([r[k] for r in table.values()], pa.float64()) for k, c in enumerate(names[1:])})

    def counted(rows: DataFrame) -> list:
        words = rows.mapInArrow(count, "w string, c1 double, c2 double, c3 double, c4 double, df double").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("c1", "c2", "c3", "c4", "df")])
        return words.where(F.col("df") >= least_documents).orderBy("w").collect()  # words of the bounded sample

    rows = counted(sample)
    counts = np.array([[r["c1"], r["c2"], r["c3"], r["c4"]] for r in rows]).reshape(-1, 4)
    missing = [k for k in range(4) if not counts[:, k].sum()]
    if missing:
        none = [F.lit(None).cast("double").alias(f"v{b}") for b in LEVELS]
        chosen = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("_doc")).distinct().orderBy(F.xxhash64("_doc"), "_doc").limit(max_documents)  # ids alone are ordered
        seeds = documents.where(F.col(text).isNotNull()).join(F.broadcast(chosen), F.col(doc) == F.col("_doc")).select(F.col(text).alias("t"), *none)
        seeded = {r["w"]: [r["c1"], r["c2"], r["c3"], r["c4"]] for r in counted(seeds)}
        known = {r["w"]: list(c) for r, c in zip(rows, counts.tolist(), strict=True)}
        for w, c in seeded.items():
            own = known.setdefault(w, [0.0] * 4)
            for k in missing:
                own[k] = c[k]
        words = sorted(known)
        counts = np.array([known[w] for w in words]).reshape(-1, 4)
    else:
        words = [r["w"] for r in rows]
    smooth = counts + smoothing
    log_p = np.log(smooth / np.maximum(smooth.sum(axis=0, keepdims=True), 1e-9)) if len(words) else np.zeros((0, 4))
    return LevelModel({w: k for k, w in enumerate(words)}, np.vstack([log_p, np.zeros((1, 4))]).astype(np.float64))


def assign(documents: DataFrame, model: LevelModel, *, doc: str = "doc_id", text: str = "text", least_words: int = 40, by_sentence: bool = False) -> DataFrame:
    """(doc, band, p1 .. p4) of each document of ``least_words`` whitespace-separated words or more.

    Null texts and shorter ones have no row; a text with enough words none of which has a letter gets band 3,
    the general level, with equal posteriors. Ties go to the lower level. A narrow map: nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)[doc]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, bands, parts = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                if t is None or len(t.split()) < least_words:
                    continue
                p = shared.value.posterior(t, by_sentence=by_sentence)
                keep.append(k)
                bands.append(3 if p is None else int(p.argmax()) + 1)
                parts.append(np.full(4, 0.25) if p is None else p)
            table = np.array(parts).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(bands, pa.int32()), *[pa.array(table[:, k]) for k in range(4)]], names=["d", "band", "p1", "p2", "p3", "p4"])

    rows = documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInArrow(score, f"d {kind}, band int, p1 double, p2 double, p3 double, p4 double")
    return rows.withColumnRenamed("d", doc)


def found(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, band), no row twice."""
    return assign(documents, train(documents, ratings)).select("doc_id", "band").distinct()
