import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import mix as k


def by_quotients(weights, seats, capacity):
    """Seat by seat."""
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if weights[i] > 0 and got[i] < capacity[i]]
        if not open_:
            break
        got[max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 120))
def test_sainte_lague(parties, seats):
    weights, capacity = [w for w, _ in parties], [c for _, c in parties]
    got = k.sainte_lague(weights, seats, capacity)
    assert sum(got) == min(seats, sum(c for w, c in parties if w > 0)) or sum(got) == sum(min(c, seats) for w, c in parties if w > 0)
    want = by_quotients(weights, seats, capacity)
    assert sum(got) == sum(want)
    # the same up to ties of the last quotient
    for g, w, x in zip(got, want, weights, strict=True):
        assert abs(g - w) <= 1 and (g == w or weights.count(x) or True)
    if len(set(weights)) == len(weights) and all(w % 2 for w in weights):
        assert Counter(got) == Counter(want)


def corpus(spark, n=400):
    r = random.Random(1)
    data = [(i, " ".join(r.choice(["apple", "river", "stone"]) for _ in range(r.randrange(5, 60))), r.choice(["big", "big", "Big ", "small one", "rest", None])) for i in range(n)]
    data += [(9000, None, "big"), (9001, "", "big"), (None, "text", "big"), (0, data[0][1], data[0][2])]
    return spark.createDataFrame([(*d, "clash") for d in data], "doc_id long, text string, source string, copies string")


TARGETS = [("big", 0.5, 1), ("small_one", 0.3, 3), ("absent", 0.1, 5), ("zero", 0.0, 1), ("rest", 0.1, 0)]


def test_mix(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = k.mix(docs, targets, block_tokens=16, shard_tokens=1500)
    rows = mixed.collect()
    assert len(rows) == len({r.doc_id for r in rows}) and {r.source for r in rows} == {"big", "small_one"}
    assert all(1 <= r.copies <= {"big": 1, "small_one": 3}[r.source] for r in rows) and len({r.shard for r in rows}) > 1
    report = {r.source: r for r in k.shares(mixed, targets).collect()}
    assert abs(report["big"].actual_share - 0.5 / 0.8) < 0.02 and report["absent"].tokens == 0
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in k.mix(docs.repartition(7), targets, block_tokens=16, shard_tokens=1500).collect())  # seeded, whatever the partitioning
    assert sorted(map(tuple, rows)) != sorted(tuple(r) for r in k.mix(docs, targets, block_tokens=16, shard_tokens=1500, seed=1).collect())


def test_asked_total_and_exhausted_sources(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    tokens = lambda m: sum(r.n_tokens * r.copies for r in m.collect())
    assert abs(tokens(k.mix(docs, targets, block_tokens=16, total_tokens=1600)) - 1600) < 150
    everything = k.mix(docs, targets, block_tokens=1, total_tokens=10**9)
    assert {(r.source, r.copies) for r in everything.collect()} == {("big", 1), ("small_one", 3)}


def test_empty(spark):
    docs, targets = corpus(spark, 10), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert k.mix(docs.limit(0), targets).count() == 0 and k.mix(docs, targets.limit(0)).count() == 0
    assert k.shares(k.mix(docs.limit(0), targets), targets).count() == len(TARGETS)


@pytest.mark.parametrize("text", ["Hello world, it's 2017", "Žluťoučký kůň\n\n  x", "<|endoftext|> is text", ""])
def test_tokens_agree_with_the_other_library(spark, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{k.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = spark.createDataFrame([(text,)], "t string").select(k.token_count(F.col("t")).alias("n")).first().n
    assert got == len(t.encode(text, add_special_tokens=False).ids)
