"""Problem 8: mixing sources to target weights.

The total is cut into blocks of equal tokens. Sainte-Laguë apportionment gives each source its number of
blocks (the highest quotients share / (2k + 1)), and each source's blocks are apportioned to its shards by
their tokens, so every (shard, source) has an integer quota. Documents then fill the quotas in a seeded
order, pass after pass up to the source's repeats.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import durable

TOKENIZERS = os.environ.get("FOLIANT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how byte-level BPE of this vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Shards grow beyond their usual size rather than exceed this number, which bounds what the driver holds.
MOST_SHARDS = 10_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> Column:
    """Tokens of the whole text under a public byte-level BPE; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for s in texts:
            yield s.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


def source_key(source: Column) -> Column:
    """One spelling of a source's name: lower case, words joined by underscores; null stays null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_"), F.lit(""))


def sainte_lague(weights: list[float], seats: int, capacity: list[int] | None = None) -> list[int]:
    """Seats of each party by highest quotients weight / (2k + 1), at most ``capacity`` each.

    Ties go to the party listed first. Found by bisection on the quotient, so that the cost doesn't grow with
    the number of seats. If the capacities hold fewer seats than asked, all are filled.
    """
    w = np.array(weights, float)
    cap = np.array(capacity if capacity is not None else [seats] * len(w), np.int64)
    cap = np.where(w > 0, np.minimum(cap, seats), 0)
    if cap.sum() <= seats:
        return cap.tolist()
    got = lambda q: np.minimum(cap, np.floor((w / q + 1) / 2 + 1e-12).astype(np.int64))  # noqa: E731  # seats with quotient >= q
    low, high = 1e-300, float(w.max()) * 2
    low = min(x for x in (w[w > 0] / (2 * seats + 1)))
    for _ in range(200):
        middle = (low + high) / 2
        if got(middle).sum() >= seats:
            low = middle
        else:
            high = middle
    out = got(high)
    while out.sum() < seats:  # those that tie at the last quotient, in order
        quotient = np.where(out < cap, w / (2 * out + 1), -1)
        out[int(quotient.argmax())] += 1
    return out.tolist()


def plan(capacity: dict[str, int], targets: dict[str, float], block: int, total: int | None = None) -> dict[str, int]:
    """Blocks of each source. ``capacity`` is tokens times repeats.

    The total is the largest that every source with tokens can serve at its share, or what is asked; then
    sources that run out keep all they have and the others take their seats. Sources without tokens get none.
    """
    names = [s for s in sorted(targets) if targets[s] > 0 and capacity.get(s, 0) > 0]
    if not names:
        return {}
    weight = sum(targets[s] for s in names)
    reach = min(capacity[s] * weight / targets[s] for s in names)
    seats = int((reach if total is None else min(total, sum(capacity[s] for s in names))) // block)
    got = sainte_lague([targets[s] for s in names], seats, [capacity[s] // block for s in names])
    return dict(zip(names, got, strict=True))


def _sized(documents: DataFrame, targets: DataFrame, doc: str, text: str, source: str, size: Callable[[Column], Column]) -> tuple[DataFrame, dict[str, tuple[float, int]], dict[str, int]]:
    """(doc, source, n_tokens) of the sources with a target; of each its share and repeats; of each its tokens."""
    want = {r["s"]: (r["share"], max(0, r["reps"] or 0)) for r in targets.select(source_key(F.col("source")).alias("s"), F.col("target_share").alias("share"), F.col("max_repeats").alias("reps")).where("s IS NOT NULL AND share > 0").collect()}
    listed = documents.select(F.col(doc).alias("doc"), source_key(F.col(source)).alias("source"), F.col(text).alias("text")).where(F.col("source").isin(*want) if want else F.lit(False))
    sized = listed.select("doc", "source", size(F.col("text")).alias("n_tokens")).where("n_tokens > 0 AND doc IS NOT NULL")
    sized = durable(sized.groupBy("doc").agg(F.max(F.struct("n_tokens", "source")).alias("x")).select("doc", "x.source", "x.n_tokens"))  # tokenised once; ids and sizes only
    return sized, want, {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}


def allocation(documents: DataFrame, targets: DataFrame, *, doc: str = "doc_id", text: str = "text", source: str = "source", block_tokens: int = 256, total_tokens: int | None = None, size: Callable[[Column], Column] = token_count) -> DataFrame:
    """(source, tokens, blocks) of each source with a target and tokens that may be used: the apportionment of ``mix`` alone."""
    _, want, totals = _sized(documents, targets, doc, text, source, size)
    seats = plan({s: n * want[s][1] for s, n in totals.items()}, {s: v[0] for s, v in want.items()}, block_tokens, total_tokens)
    return documents.sparkSession.createDataFrame([(s, totals[s], n) for s, n in seats.items()], "source string, tokens long, blocks long")


def mix(documents: DataFrame, targets: DataFrame, *, doc: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, block_tokens: int = 256, shard_tokens: int = 2_000_000, total_tokens: int | None = None, size: Callable[[Column], Column] = token_count) -> DataFrame:
    """(doc, source, shard, n_tokens, copies) of each document taken at least once.

    ``targets`` is (source, target_share, max_repeats); spellings of a source are brought to one form. Rows
    of a source without target, without source or without text are not taken; a document delivered again
    under another id is another document; a doc repeated under one id counts once (its greatest text).
    ``copies`` is never more than max_repeats (null or negative: 0). ``size`` gives the tokens of a text.

    A shard holds about ``shard_tokens`` tokens (more beyond MOST_SHARDS shards), so no source, however large,
    is ordered in one window. What reaches the driver is a number for each (shard, source).
    """
    spark = documents.sparkSession
    sized, want, totals = _sized(documents, targets, doc, text, source, size)
    shards = min(MOST_SHARDS, max(1, ceil(sum(totals.values()) / shard_tokens)))
    placed = sized.withColumn("shard", F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(shards)).cast("int"))
    held: dict[str, dict[int, int]] = {}
    for r in placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect():
        held.setdefault(r["source"], {})[r["shard"]] = r["n"]
    seats = plan({s: n * want[s][1] for s, n in totals.items()}, {s: v[0] for s, v in want.items()}, block_tokens, total_tokens)
    quotas = []
    for s, n in seats.items():
        own = sorted(held[s])
        tokens = [held[s][k] for k in own]
        for k, q in zip(own, sainte_lague(tokens, n), strict=True):
            quotas.append((s, k, q * block_tokens, want[s][1], held[s][k]))
    if not quotas:
        quotas = [("", -1, 0, 0, 1)]
    table = spark.createDataFrame(quotas, "source string, shard int, quota long, repeats int, held long")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc", F.lit(seed + 1)), "doc").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.join(F.broadcast(table), ["source", "shard"]).withColumn("upto", F.sum("n_tokens").over(order))  # a row for each (shard, source)
    full = F.least(F.floor(F.col("quota") / F.col("held")), F.col("repeats"))
    rest = F.col("quota") - full * F.col("held")
    more = F.when((full < F.col("repeats")) & (F.col("upto") - F.col("n_tokens") / 2 <= rest), 1).otherwise(0)
    return filled.select(F.col("doc").alias(doc), "source", "shard", "n_tokens", (full + more).cast("int").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The report: of each source with a target its documents, tokens, highest number of copies and actual share."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    want = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    both = want.join(got, "source", "left").fillna(0, ["n_docs", "tokens", "most_copies"])
    everything = Window.partitionBy()  # a row for each source with a target
    return both.withColumn("actual_share", F.col("tokens") / F.greatest(F.sum("tokens").over(everything), F.lit(1)))
