import random

import pytest

from foliant.llm import leak as k

random.seed(3)
VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "mo", "ri", "tu", "ze") for b in ("lan", "dor", "mis", "pek") for c in ("a", "o", "en", "ik")]


def passage(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


ITEMS = {i: passage(60 + 5 * i, i) for i in range(8)}
PROMPT = "Read this and answer."


def filler(n, seed):
    r = random.Random(f"f{seed}")
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def altered(words, every):
    return [w if i % every else "changed" for i, w in enumerate(words, 1)]


DOCS = {
    1: filler(50, 1) + ITEMS[0] + filler(50, 2),  # whole
    2: filler(80, 3) + ITEMS[1][10:40],  # a part
    3: ITEMS[2][:14] + filler(40, 4) + ITEMS[2][40:56],  # two pieces
    4: filler(10, 5) + altered(ITEMS[3], 9),  # altered words
    5: filler(50, 6) + ITEMS[4][:12],  # a quoted phrase only
    6: altered(ITEMS[5], 3),  # built alike, every third word another
    7: filler(200, 7),
    8: ITEMS[6][:30] + filler(5, 8) + ITEMS[7][:45],  # two items
    10: ITEMS[0][40:] + filler(400, 10) + ITEMS[0][:15],  # two pieces far apart, in the other order
    11: ITEMS[4][:13] + filler(9, 11) + ITEMS[4][50:63],  # two quoted sentences
    9: ITEMS[0][:25] + ["put", "in"] + ITEMS[0][25:45],
}
EXPECTED = {(1, 0), (2, 1), (3, 2), (4, 3), (8, 6), (8, 7), (9, 0), (10, 0)}


def tables(spark):
    docs = [(i, " ".join(w), "clash") for i, w in DOCS.items()] + [(20, None, ""), (21, "", ""), (22, " ".join(ITEMS[0]).upper().replace(" ", " <b>,\n> </b>"), ""), (23, PROMPT, "")]
    items = [(i, (PROMPT + " " if i % 2 else "") + " ".join(w), "clash") for i, w in ITEMS.items()] + [(100, None, ""), (101, "too short", ""), (0, " ".join(ITEMS[0]), ""), (None, "x " * 50, "")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block", [20_000, 3])
def test_found(spark, block):
    docs, items = tables(spark)
    rows = [(r.doc_id, r.item_id) for r in k.find_leaks(docs, items, block_items=block).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == EXPECTED | {(22, 0)}


def test_long_texts_are_searched_whole(spark):
    docs = spark.createDataFrame([(1, " ".join(filler(60_000, 9) + ITEMS[0]))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.share) for r in k.find_leaks(docs, tables(spark)[1]).collect()] == [(1, 0, 1.0)]


def test_empty(spark):
    docs, items = tables(spark)
    assert k.find_leaks(docs.limit(0), items).count() == 0
    assert k.find_leaks(docs, items.limit(0)).count() == 0


def test_words():
    assert k.words("Sam's <b>DOG</b>,\n> don’t &amp; stop–now") == ["sams", "dog", "dont", "stop", "now"]
    assert k.words(None) == k.words("") == []


def test_stock_prompts_are_no_passage(spark):
    items = [(i, f"Answer this. {' '.join(passage(20, i))}") for i in range(3)] + [(9, "Only once. " + " ".join(passage(20, 9)))] + [(20 + i, "The same. " + " ".join(passage(20, 20))) for i in range(3)]
    got = {r.item_id: k.words(r.text) for r in k.passages(spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[0] == passage(20, 0) and got[9][:2] == ["only", "once"] and got[20][:2] == ["the", "same"]  # copies of one item are no stock


def test_prompts_are_counted_over_all_blocks(spark):
    prompt = "Please read the following passage with great care and answer every question about it that follows below."
    items = spark.createDataFrame([(i, f"{prompt} {' '.join(passage(40, i))}") for i in range(4)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{prompt} {' '.join(filler(30, i))} {' '.join(passage(40, i)[:12])}") for i in range(4)], "doc_id long, text string")
    for n in (20_000, 2, 1):
        assert k.find_leaks(docs, items, block_items=n).count() == 0


def test_short_items(spark):
    """From five words on an item is found where it stands as a whole; a shorter one where it is the document."""
    items = {n: passage(n, 100 + n) for n in (1, 3, 4, 5, 8, 10, 12, 13, 14)}
    docs = [(n, " ".join(filler(20, n) + w + filler(20, n + 50))) for n, w in items.items()] + [(100 + n, " ".join(w)) for n, w in items.items()] + [(200 + n, " ".join(filler(9, n) + w[:-1] + filler(9, n))) for n, w in items.items() if n < 14]
    got = k.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(n, n) for n in items if n > 4} | {(100 + n, n) for n in items}


def brute(doc, item):
    """The longest two exact runs of at least LEAST_PIECE words, as a share of the item."""
    runs = []
    for x in range(len(doc)):
        for y in range(len(item)):
            if x and y and doc[x - 1] == item[y - 1]:
                continue
            n = 0
            while x + n < len(doc) and y + n < len(item) and doc[x + n] == item[y + n]:
                n += 1
            if n >= k.LEAST_PIECE:
                runs.append((n, x, y))
    enough = max(k.LEAST_LARGER, k.LEAST_LARGER_SHARE * len(item))
    best = max((a[0] for a in runs if a[0] >= enough), default=0)
    for a in runs:
        for b in runs:
            if max(a[0], b[0]) >= enough and a[1] + a[0] <= b[1] and (a[2] + a[0] <= b[2] or b[2] + b[0] <= a[2]):
                best = max(best, a[0] + b[0])
    return best / len(item)


def test_against_brute_force():
    """Unaltered pieces at random places: found exactly when the brute force reaches the share."""
    index = k.ItemIndex(ITEMS, 1 / 3)
    index.order({})
    r = random.Random(5)
    for n in range(150):
        item = r.choice(list(ITEMS))
        a, la, lb = r.randrange(20), r.randrange(8, 30), r.randrange(8, 20)
        doc = filler(r.randrange(30), n) + ITEMS[item][a : a + la] + filler(r.randrange(3, 20), n + 500) + ITEMS[item][a + la + 2 : a + la + 2 + lb] + filler(5, n + 900)
        found = {i for i, _ in index.leaks(" ".join(doc))}
        want = {i for i, w in ITEMS.items() if brute(doc, w) >= 1 / 3}
        assert found == want, (n, found, want)


@pytest.mark.parametrize("length", [10, 20, 60, 120, 300, 500])
def test_filters_lose_nothing(length):
    """The prefix, the length and the position bound give what the verification of every pair gives, however many words are altered."""
    r = random.Random(length)
    items = {i: [f"{w}{r.randrange(30)}" for w in passage(length, 1000 * length + i)] for i in range(4)}
    index = k.ItemIndex(items, 1 / 3)
    index.order({s: r.randrange(1000) for s in range(len(index.postings))})
    hits = 0
    for n in range(120):
        item = items[r.randrange(4)]
        pieces = []
        for _ in range(r.choice([1, 1, 2, 3])):
            a = r.choice([0, r.randrange(length)])
            piece = item[a : a + max(6, int(length * r.uniform(0.15, 1.1)))]
            every = r.choice([3, 4, 5, 6, 7, 8, 9, 12, 1000])
            piece = [w if (k_ + 1) % every else r.choice(["changed", "changed extra", ""]) for k_, w in enumerate(piece)]
            pieces += piece + filler(r.randrange(0, 30), n)
        text = " ".join(pieces)
        got = sorted(index.leaks(text))
        assert got == sorted(index.leaks(text, filtered=False)), (length, n)
        hits += len(got)
    assert hits > 1


def test_longest_gap_and_fewest_shingles():
    """The bounds hold with equality for the sparsest run that verification takes."""
    item = passage(9, 77)
    doc = [*item[:5], "changed", *item[6:9]]
    ids = {w: n + 1 for n, w in enumerate(sorted(set(item)))}
    runs = k._align([ids.get(w, 0) for w in doc], [ids[w] for w in item], [(0, 0)])
    assert runs == [(8, 1, 0, 0, 9)] and k.least_shingles(27, 1 / 3) == 1 and k.MOST_GAP == 17
