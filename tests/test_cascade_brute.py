"""The fuzzy cascade against a record-by-record version, on whole small tables."""

import pytest

from foliant.functions.fuzzy import token_set
from foliant.functions.text import normalize_text
from foliant.operators import cascade


def turned(name):
    return " ".join([p.strip() for p in reversed(name.split(",", 1))]) if "," in name else name


def brute(records, facts, authors):
    of = {}
    for b, a in authors:
        of.setdefault(b, set()).add(a)

    def choose(r, hits):
        far = lambda b: abs(b["pub_year"] - r["czech_year"]) if b["pub_year"] is not None and r["czech_year"] is not None else cascade.FAR
        other = lambda b: not (r["prefix"] and b["language_code"].lower().startswith(r["prefix"]))
        works = {}
        for s, b in hits:
            works.setdefault(b["work_id"], []).append((other(b), far(b), -b["ratings"], -s, b["book_id"]))
        best = min((e[0], e[2], e[1], e[3], e[4], w) for w, e in ((w, min(c)) for w, c in works.items()))
        return best[4], best[5], max(s for s, _ in hits)

    out = {}
    for r in records:
        a, t = r["norm_author"], r["norm_title"]
        out[r["nkc_id"]] = ("unmatched", None, None, None)
        if not a or not t:
            continue
        titled = [b for b in facts if b["book_title"]]
        layers = [
            ("exact", [(100, b) for b in titled if b["book_title"] == t and a in of.get(b["book_id"], ())]),
            ("title", [(int(token_set(t, b["book_title"])), b) for b in titled if a in of.get(b["book_id"], ())]),
            ("author", [(max(int(token_set(a, x)) for x in of[b["book_id"]]), b) for b in titled if b["book_title"] == t and of.get(b["book_id"])]),
        ]
        for name, hits in layers:
            hits = [(s, b) for s, b in hits if s >= {"exact": 100, "title": 88, "author": 85}[name]]
            if hits:
                out[r["nkc_id"]] = (name, *choose(r, hits))
                break
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_cascade(spark, folder):
    translations, editions, authors = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("nkc_translations", "goodreads_book_details", "goodreads_author_names"))
    records = [r.asDict() for r in cascade.keyed_records(translations).collect()]
    facts, book_authors = cascade.keyed_books(editions, authors)
    want = brute(records, [r.asDict() for r in facts.collect()], [tuple(r) for r in book_authors.collect()])
    got = {r.nkc_id: (r.layer, r.book_id, r.work_id, r.score) for r in cascade.cascade(translations, editions, authors).collect()}
    assert got == want
    assert {"exact", "unmatched"} <= {v[0] for v in got.values()}
    for r in translations.collect():  # the keys themselves
        if r.author and r.author.isascii():
            assert normalize_text(turned(r.author)) in {x["norm_author"] for x in records if x["nkc_id"] == r.nkc_id}
