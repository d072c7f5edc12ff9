import random

import pytest

from foliant.llm import linkage as k


@pytest.mark.parametrize(
    ("text", "key"),
    [
        ("The Sleepless Violin and the Sparrow. Volume 2", ("sleepless violin the sparrow", 2)), ("sleepless violin and the sparrow ii", ("sleepless violin the sparrow", 2)), ("Leaving the Wolf. 3", ("leaving the wolf", 3)), ("Brücke von Nitom, Die", ("brucke von nitom", 0)),
        ("„Der große Fahrmann“ : a novel", ("grosse fahrmann", 0)), ("Mill, Tide (Kratum saga ; 2)", ("mill tide", 0)), ("Чайник в деревне, пароход", ("cainik v derevne parohod", 0)), ("chainik v derevne parokhod", ("cainik v derevne parohod", 0)), (None, ("", 0)), ("  ", ("", 0)), ("A", ("a", 0)),
        ("mill of vidu volume 3 a memoir", ("mill of vidu", 3)),
    ],
)
def test_title_key(text, key):
    assert k.title_key(text, frozenset({"a memoir"})) == key


def test_levels():
    pairs = [("red mill", "red mill", 4), ("red mill", "red mlil", 3), ("red mill", "redmill", 3), ("red mill", "red mill tales", 2), ("red mill", "red tower", 1), ("red mill", "blue tower", 0)]
    assert [k.words_level(a, b) for a, b, _ in pairs] == [n for *_, n in pairs]


def test_title_levels(spark):
    cases = [(4, 0, 0, 5), (3, 2, 2, 4), (2, 0, 0, 3), (4, 1, 0, 2), (2, 0, 3, 2), (4, 1, 2, 0), (1, 1, 2, 0), (1, 0, 2, 1), (0, 1, 1, 0)]
    rows = spark.createDataFrame([c[:3] for c in cases], "w int, a int, b int")
    assert [r[0] for r in rows.select(k.title_level(*[rows[c] for c in "wab"])).collect()] == [c[3] for c in cases]


def test_years_languages_and_parallel_titles():
    assert [k.written_year(x) for x in ("[1945?]", "c2019", "1999-2001", "[19--]", None)] == [1945, 2019, 1999, None, None]
    assert [k.language(x) for x in ("en-US", "eng|lat", "und", None, "xx")] == ["eng", "eng", None, None, "xx"]
    assert k.original_title(" ", "Noc / The Night") == "The Night" and k.original_title("A", "b / c") == "A" and k.original_title(None, "b") is None


def test_expectation_maximisation_finds_planted_probabilities():
    random.seed(7)
    counts = {}
    for _ in range(20_000):
        match = random.random() < 0.3
        p = tuple(int(random.random() < (q if match else u)) for q, u in ((0.95, 0.1), (0.9, 0.05), (0.8, 0.3)))
        counts[p] = counts.get(p, 0) + 1
    w = k.expectation_maximisation([(p, n, True) for p, n in sorted(counts.items())], [1, 1, 1])
    assert abs(w.share - 0.3) < 0.03 and abs(w.m[0][1] - 0.95) < 0.03 and abs(w.u[1][1] - 0.05) < 0.03
    assert w.posterior((1, 1, 1)) > 0.9 > 0.1 > w.posterior((0, 0, 0)) and 0 < w.posterior((-1, -1, -1)) < 1


def test_impossible_pairs_teach_what_non_matches_look_like():
    patterns = [((1, 1, 1), 900, True), ((1, 1, 0), 50, True), ((1, 0, 1), 40, True), ((1, 1, 1), 500, False), ((1, 0, 1), 5_000, False), ((0, 0, 1), 4_000, False), ((0, 0, 0), 9_000, False)]
    free, taught = (k.expectation_maximisation([(p, n, q or free) for p, n, q in patterns], [1, 1, 1]) for free in (True, False))
    assert taught.posterior((1, 0, 1)) < free.posterior((1, 0, 1)) and taught.posterior((1, 0, 1)) < 0.1 < 0.5 < taught.posterior((1, 1, 1))


def test_more_agreement_never_speaks_against_a_match():
    ratio = k.monotone({0: 0.1, 1: 0.2, 2: 0.3, 3: 0.4}, {0: 0.7, 1: 0.01, 2: 0.09, 3: 0.2})
    values = [ratio[v] for v in range(4)]
    assert values == sorted(values) and values[1] == values[2] == values[3] and values[0] < 0 < values[1]
    assert k.monotone({0: 0.2, 1: 0.8}, {0: 0.9, 1: 0.1}) == pytest.approx({0: -1.504, 1: 2.079}, abs=1e-3)


def test_no_convergence_is_told():
    with pytest.warns(UserWarning, match="convergence"):
        k.expectation_maximisation([((1,), 10, True), ((0,), 20, True)], [1], rounds=1)
    assert k.expectation_maximisation([], [1]).posterior((1,)) > 0


TRANSLATIONS = "nkc_id string, author string, secondary_authors string, original_title string, czech_title string, czech_pub_year string, source_lang string, work_id string"
EDITIONS = "book_id string, work_id string, norm_title string, ratings_count int, pub_year int, language_code string, author_id string, loaded_at timestamp, title string"


def tables(spark):
    from datetime import datetime

    t0 = datetime(2017, 1, 1)
    works = [("Hidden Mill of Vanor", 1990, "a1"), ("Red River", 1980, "a1"), ("Tower at Lemur", 2000, "a2"), ("Quiet Garden. 1", 1970, "a2"), ("Quiet Garden. 2", 1972, "a2")]
    editions = [(f"b{i}{j}", f"w{i}", k.title_key(t)[0].replace("quiet garden", f"quiet garden volume {k.title_key(t)[1]}"), 5, y + j, "eng", a, t0, "clash") for i, (t, y, a) in enumerate(works) for j in range(2)]
    filler = [(f"f{i}", f"x{i}", f"story {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}mo of gal", 1, 1950, "eng", f"c{i}", t0, "clash") for i in range(60)]
    records = [
        ("n1", "Nováková, Eva", None, "The Hidden Mill of Vanor", "Mlýn", "1995", "eng"), ("n2", "Novak, E.", "", "Hidden Mlil of Vanor, The", "Mlýn 2", "", "eng"), ("n3", "Novák, Eva", None, None, "Řeka = Red River", "1985", None), ("n4", "Novák, Eva", None, "Red River", "Řeka", "1970", "eng"),
        ("n5", "Dlouhý, Jan", None, "Quiet Garden, vol. 2", "Zahrada", "1980", "eng"), ("n6", "Dlouhý, Jan", None, "Nothing Like It", "Nic", "1980", "eng"), ("n7", "Dlouhý, Jan", None, None, "Zahrada", "1982", "eng"), ("n8", None, None, None, None, None, None), (None, "x", None, "y", None, None, None),
        ("n1", "Nováková, Eva", None, "The Hidden Mill of Vanor", "Mlýn", "1995", "eng"),
    ] + [(f"m{i}", f"Fam{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}mo, Jan", None, f"Story {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}mo of Gal", "c", "1999", "eng") for i in range(60)]
    names = [("a1", "Eva Novák"), ("a2", "Jan Dlouhý"), ("a3", None), *[(f"c{i}", f"Jan Fam{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}mo") for i in range(60)]]
    return spark.createDataFrame([(*r, "clash") for r in records], TRANSLATIONS), spark.createDataFrame([*editions, *filler, ("z", " ", "red river", 1, 1950, None, "a1", t0, "")], EDITIONS), spark.createDataFrame(names, "author_id string, name string")


def test_link(spark):
    rows = k.link(*tables(spark)).collect()
    got = {r.nkc_id: r.work_id for r in rows}
    assert len(rows) == len(got)
    assert {n: w for n, w in got.items() if n.startswith("n")} == {"n1": "w0", "n2": "w0", "n3": "w1", "n5": "w4", "n7": "w4"}  # n4 is older than the work
    assert sum(got.get(f"m{i}") == f"x{i}" for i in range(60)) == 60
    assert all(0.5 <= r.confidence <= 1 for r in rows)


def test_refined_blocks_find_the_same(spark):
    """Blocks held too large for pairs go another way and lose none of these links."""
    translations, editions, authors = tables(spark)
    usual = {(r.nkc_id, r.work_id) for r in k.link(translations, editions, authors).collect()}
    old = k.candidates.__defaults__
    k.candidates.__defaults__ = (0,)
    try:
        assert {(r.nkc_id, r.work_id) for r in k.link(translations, editions, authors).collect()} == usual
    finally:
        k.candidates.__defaults__ = old


FORM = "family string, r_entity string, first string, title string, volume long"
WORK = "family string, work_id string, w_entity string, first string, title string, volume long"


def test_large_blocks_have_the_pairs_of_small_ones(spark):
    """Titles with a slip in each word, or within a longer title, are compared whatever the size of their block."""
    works = ["frozen chapel lantern", "frozen chapel garden", "silent chapel", "red moon river", "alpha bravo gamma delta epsilon", *[f"lantern {chr(97 + i)}oru" for i in range(20)]]
    records = ["frosen chapal lantern", "frosen chapel", "silent chapel", "rad moom river", "alpa bravo gamna delta epsilom", *[f"lantern {chr(97 + i)}omu" for i in range(20)]]
    left = spark.createDataFrame([("novak", "p|novak|eva", "eva", t, 0) for t in records], FORM)
    right = spark.createDataFrame([("novak", f"w{i}", "p|novak|eva", "eva", t, 0) for i, t in enumerate(works)], WORK)
    pairs = lambda n: sorted((r.r_title, r.w_title) for r in k.candidates(left, right, n).collect())
    usual = pairs(10**9)
    assert {("frosen chapal lantern", works[0]), ("frosen chapel", works[1]), ("rad moom river", works[3]), (records[4], works[4])} <= set(usual) and len(set(usual)) == len(usual) > 20
    for n in (0, 1, 50):
        assert pairs(n) == usual


def test_candidates_lose_no_pair_that_agrees(spark):
    """All pairs of titles that are equal but for slips, or one of which holds the other, meet, and each once."""
    r = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("lan", "dor", "mis", "pek", "o") for b in ("terna", "wood", "tin", "a", "eli")]

    def slip(t):
        words = t.split()
        if len(words) > 1 and r.random() < 0.2:
            k = r.randrange(len(words) - 1)
            words[k : k + 2] = [words[k] + words[k + 1]]
        for k, w in enumerate(words):
            if len(w) > 3 and r.random() < 0.6:
                p = r.randrange(len(w))
                words[k] = r.choice([w[:p] + w[p + 1 :], w[:p] + "x" + w[p:], w[:p] + w[p + 1 : p + 2] + w[p] + w[p + 2 :]])
        return " ".join(words)

    works = sorted({" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 5))) for _ in range(60)})
    records = sorted({slip(" ".join(w.split()[: r.randrange(1, 5)] if r.random() < 0.5 else [*w.split(), r.choice(vocabulary)])) for w in works for _ in range(2)} - {""})
    left = spark.createDataFrame([("novak", "p|novak|eva", "eva", t, 0) for t in records], FORM)
    right = spark.createDataFrame([("novak", f"w{i}", "p|novak|eva", "eva", t, 0) for i, t in enumerate(works)], WORK)
    got = [(x.r_title, x.w_title) for x in k.candidates(left, right).collect()]
    want = {(a, b) for a in records for b in works if k.words_level(a, b) > 1}
    assert len(want) > 100 and len(got) == len(set(got)) and want <= set(got) and len(got) < len(records) * len(works) / 2


def test_a_side_without_author_meets_by_its_title(spark):
    left = spark.createDataFrame([(None, None, None, "red mill", 0), (None, None, None, "two homes", 0), ("novak", "p|novak|eva", "eva", "blue tower", 1)], FORM)
    right = spark.createDataFrame([("kral", "w1", "p|kral|jan", "jan", "red mill", 0), ("kral", "w2", "p|kral|jan", "jan", "two homes", 0), (None, "w3", None, None, "two homes", 0), (None, "w4", None, None, "blue tower", 1), ("kral", "w5", "p|kral|jan", "jan", "blue tower", 1)], WORK)
    assert sorted((x.r_title, x.work_id, x.author) for x in k.candidates(left, right).collect()) == [("blue tower", "w4", -1), ("red mill", "w1", -1)]


def test_entities_may_be_given(spark):
    translations, editions, authors = tables(spark)
    spelt = translations.select("author").union(authors.select("name")).toDF("name")
    given = k.names.resolve(spelt)
    assert {tuple(r) for r in k.link(translations, editions, authors, entities=given).select("nkc_id", "work_id").collect()} == {tuple(r) for r in k.link(translations, editions, authors).select("nkc_id", "work_id").collect()}


def test_empty(spark):
    translations, editions, authors = tables(spark)
    assert k.link(translations.limit(0), editions.limit(0), authors.limit(0)).count() == 0
    assert k.link(translations, editions.limit(0), authors).count() == 0
