import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import lookalike as k

WORDS = "the hidden mill of vanor corridor passenger storm atlas night winter dopis šťastný mlýn".split() + "колокол дорога сестра метель пароход остров вагон".split()
MODEL = k.Model({key: n for word in WORDS for key, n in k.bigrams(word).items()})

CASES = [
    ("Ｆｕｌｌ　width", "Full width"), ("Stár", "Stár"), ("a b c", "a b c"), ("hid​den﻿", "hidden"), ("so­ft", "soft"), ("Cοrrіdor", "Corridor"), ("ﬆorm", "storm"), ("Krak", "Krak"), ("дopога", "дорога"), ("mlýn‍", "mlýn"), ("Άtlas", "Átlas"),
    # ordinary texts stay
    ("Šťastný mlýn", "Šťastný mlýn"), ("„quoted“ – dash", "„quoted“ – dash"), ("two  spaces", "two  spaces"), ("Дорога в саду", "Дорога в саду"), ("Ostrov / Остров", "Ostrov / Остров"), ("", ""), (None, None), ("Стоп", "Стоп"),
    ("Novák, Ο.", "Novák, O."), ("А Corridor", "A Corridor"), ("Noc / о лесе", "Noc / о лесе"), ("а", "а"), ("Сестра в лесу I", "Сестра в лесу I"),
]


@pytest.mark.parametrize(("text", "form"), CASES)
def test_consistent(text, form):
    assert MODEL.consistent(text) == form


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_form_is_stable(text):
    once = MODEL.consistent(text)
    assert MODEL.consistent(once) == once


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([w for w in WORDS if w.isascii() and len(w) > 3]), st.data())
def test_swapped_letters_are_found(word, data):
    places = [i for i, c in enumerate(word) if c in k._ALTERNATIVES]
    chosen = data.draw(st.lists(st.sampled_from(places), max_size=len(word) // 2, unique=True)) if places else []
    spoilt = "".join(data.draw(st.sampled_from(k._ALTERNATIVES[c])) if i in chosen else c for i, c in enumerate(word))
    kinds = {k.script(c) for c in spoilt}
    if 0 in kinds and any(k.script(c) == 0 and c not in k._ALTERNATIVES for c in spoilt):  # a letter that only Latin has
        assert MODEL.consistent(spoilt) == word


def test_operators(spark):
    data = [("1", "Hidden m​ill", None, "x"), ("1", "Hidden m​ill", None, "x"), ("2", "ordinary", "", "x"), ("3", "Cοrridor " * 20_000, "a b", "x"), (None, "a b", "ok", "x")]
    df = spark.createDataFrame(data, "id string, a string, b string, field string")
    got = sorted((tuple(r) for r in k.found(df, "id", ["a", "b"]).collect()), key=repr)
    assert got == sorted([("1", "a"), ("3", "a"), ("3", "b"), (None, "a")], key=repr)
    both = k.unify(df, ["a"])
    assert both.columns == ["id", "a", "b", "field", "a_consistent"] and both.where("id = '3'").first().a_consistent == "Corridor " * 20_000
    assert k.found(df.limit(0), "id", ["a", "b"]).count() == 0
    with pytest.raises(ValueError, match="a_consistent"):
        k.unify(both, ["a"])


def test_all_of_a_table_is_brought_to_one_script(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/nkc_translations.parquet")
    for r in k.unify(df.select("nkc_id", "original_title", "author"), ["original_title", "author"]).collect():
        for text in (r.original_title_consistent, r.author_consistent):
            for word in k._WORD.findall(text or ""):
                assert len({k.script(c) for c, _ in k._letters(word)} - {-1}) <= 1
