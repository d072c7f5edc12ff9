import json

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.operators import nested

LISTS = {"authors": "author_id", "popular_shelves": "name"}


def plain(texts):
    """The same rows by parsing each text."""
    out = set()
    for i, text in enumerate(texts):
        try:
            top = json.loads(text, parse_constant=lambda c: 1 / 0)
        except Exception:
            continue
        if not isinstance(top, dict):
            continue
        for key, value_key in LISTS.items():
            items = top.get(key)
            if isinstance(items, str):
                try:
                    items = json.loads(items)
                except ValueError:
                    continue
            items = [items] if isinstance(items, dict) else items if isinstance(items, list) else []
            for pos, item in enumerate(items):
                value = item.get(value_key) if isinstance(item, dict) else item
                if isinstance(value, str) and value.strip():
                    out.add((i, key, pos, value))
    return out


values = st.one_of(st.none(), st.text('ab"\\{}[],: č \n', max_size=6))
entry = st.one_of(st.none(), st.dictionaries(st.sampled_from(["author_id", "name", "x", "\\"]), values, max_size=3), values, st.lists(values, max_size=2))
entries = st.one_of(values, st.lists(entry, max_size=4), entry)
records = st.dictionaries(st.sampled_from(["authors", "popular_shelves", "other", 'q"q']), entries, max_size=4)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(records, st.booleans(), st.integers(0, 400), st.booleans()), max_size=6))
def test_index_equals_parsing(drawn):
    texts = []
    for record, ascii_only, cut, quoted in drawn:
        if quoted and "authors" in record:
            record = record | {"authors": json.dumps(record["authors"], ensure_ascii=ascii_only)}
        text = json.dumps(record, ensure_ascii=ascii_only, indent=cut % 3 or None)
        texts.append(text[:cut] if cut < 40 else text)
    assert set(nested.json_children(texts, LISTS)) == plain(texts)


def valid(text):
    try:
        return isinstance(json.loads(text, parse_constant=lambda c: 1 / 0), (dict, list))
    except Exception:
        return False


def sound(texts):
    return nested.StructuralIndex(*nested._buffer([t.encode() for t in texts])).sound().tolist()


json_values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-50, 50), st.floats(allow_nan=False, allow_infinity=False), st.text("ab č", max_size=3)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text("ab", max_size=2), x, max_size=3)), max_leaves=8)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.tuples(json_values, st.integers(0, 60), st.text('{}[],:" 1a\\\n', max_size=2), st.sampled_from(["keep", "cut", "put", "swap"])), min_size=1, max_size=5))
def test_what_the_index_vouches_for_is_valid(drawn):
    """Texts with a character lost, put in or changed: none that is broken is called sound, and plain valid ones all are."""
    texts = []
    for value, place, extra, how in drawn:
        text = json.dumps(value, ensure_ascii=False)
        text = {"keep": text, "cut": text[:place] + text[place + 1 :], "put": text[:place] + extra + text[place:], "swap": text[:place] + extra + text[place + len(extra) :]}[how]
        texts.append(text)
    for text, good in zip(texts, sound(texts), strict=True):
        assert not good or valid(text), text
        assert good or not valid(text) or "\\" in text or "\n" in text, text


def test_the_index_vouches_for_most_of_a_table():
    texts = pq.read_table("/root/testdata/sf0.01/goodreads_books_raw.parquet").column("json_text").to_pylist()
    good = sound(texts)
    assert all(valid(t) for t, g in zip(texts, good, strict=True) if g) and sum(good) > 0.5 * len(texts)


def test_shapes_and_broken_lines():
    texts = [
        '{"authors":[{"author_id":"a\\"b"},null,"x",5,{"author_id":7},{"b":{"author_id":"no"}},[1,2]]}',
        '{"authors":"[{\\"author_id\\":\\"q\\\\\\"z\\"}]"}', '{"a":"\\\\","authors":{"author_id":"k"}}', '{"authors":[{"author_id":"1"}]', '"abc', '[{"authors":[1]}]', None, "",
        '   {"authors" : [ "a" , "b" ] , "x":[]} ', '{"x":{"authors":["n"]},"authors":["y"],"authors":["z"]}', '{"authors":[1,]}', '{"auth\\u006frs":["esc"]}', '{"authors":[NaN]}', '{"authors":"broken ["}',
    ]
    got = nested.json_children(texts, {"authors": "author_id"})
    assert sorted((k, p, v) for k, _, p, v in got) == [(0, 0, 'a"b'), (0, 2, "x"), (0, 3, "5"), (0, 4, "7"), (1, 0, 'q"z'), (2, 0, "k"), (8, 0, "a"), (8, 1, "b"), (9, 0, "z"), (11, 0, "esc")]


def test_all_of_a_table():
    texts = pq.read_table("/root/testdata/sf0.01/goodreads_books_raw.parquet").column("json_text").to_pylist()
    assert set(nested.json_children(texts, LISTS)) == plain(texts)


def test_json_operator(spark, rows):
    long = "y" * 300_000
    df = spark.createDataFrame([(1, '{"authors":["a"]}', "extra"), (2, '{"authors":["a"]}', None), (3, None, "x"), (4, json.dumps({"authors": [long, " ", ""]}), "x")], "line_no long, json_text string, child string")
    got = rows(nested.flatten_json(df, {"authors": "author_id"}, source="s"))
    assert got == sorted([("s", 1, "authors", 0, 0, "a"), ("s", 2, "authors", 0, 0, "a"), ("s", 4, "authors", 0, 0, long)], key=repr)
    assert nested.flatten_json(df.limit(0), {"authors": "author_id"}, source="s").count() == 0


def test_field_operator(spark, rows):
    schema = "line_no long, datafield array<struct<tag:string,ind1:string,ind2:string,subfield:array<struct<code:string,text:string>>>>, pos int"
    data = [
        (1, [("041", " ", " ", [("a", "cze"), ("h", None), ("h", " eng ")]), None, ("765", None, None, None), ("765", "0", "8", [None, ("t", " "), ("t", "T")]), ("100", "", "", [("a", "no")])], 9),
        (2, None, 9), (3, [], 9), (None, [(None, None, None, [("a", "x")]), ("041", "", "", [("a", "n")])], 9),
    ]
    df = spark.createDataFrame(data, schema)
    got = rows(nested.flatten_fields(df, ["041", "765"], source="n"))
    assert got == sorted([("n", 1, "041", 0, 0, "cze"), ("n", 1, "041", 0, 2, " eng "), ("n", 1, "765", 3, 2, "T"), ("n", None, "041", 1, 0, "n")], key=repr)
    assert nested.flatten_fields(df.limit(0), ["041"], source="n").count() == 0
