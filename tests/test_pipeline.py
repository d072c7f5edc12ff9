"""The whole batch on small raw files."""

import gzip
import json

from foliant.__main__ import main
from foliant.plans.pipeline import Batch


def record(n, author, title, year):
    sub = lambda c, x: f'<subfield code="{c}">{x}</subfield>'
    field = lambda tag, *s: f'<datafield tag="{tag}" ind1=" " ind2=" ">{"".join(s)}</datafield>'
    return f'<record><controlfield tag="001">{n}</controlfield>{field("041", sub("a", "cze"), sub("h", "eng"))}{field("100", sub("a", author))}{field("240", sub("a", title))}{field("245", sub("a", "Česky /"))}{field("260", sub("c", year))}</record>'


def raw(tmp_path):
    works = [("King, Stephen", "Stephen King", f"Book {w}", 1990 + i, 2009 + i) for i, w in enumerate(["one", "two", "three", "four", "five"])]
    (tmp_path / "c.xml").write_text('<collection xmlns="x">' + "".join(record(f"n{i}", a, f"The {t}", y) for i, (a, _, t, _, y) in enumerate(works[:3])) + "</collection>")
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        for i, (_, _, t, y, _) in enumerate(works):
            f.write(json.dumps({"book_id": f"b{i}", "work_id": f"w{i}", "title": t, "ratings_count": "60", "text_reviews_count": "2", "publication_year": str(y), "language_code": "eng", "authors": [{"author_id": "a1", "role": ""}], "popular_shelves": [{"name": "fantasy", "count": "7"}]}) + "\n")
        f.write("broken\n")
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(json.dumps({"author_id": "a1", "name": "Stephen King"}) + "\n")
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        for i, (b, y, g, x) in enumerate([("b0", 2008, 4, "good"), ("b0", 2009, 5, "too late"), ("b1", 2005, 0, " "), ("b1", 2005, 3, "fine")]):
            f.write(json.dumps({"review_id": f"r{i}", "book_id": b, "rating": g, "review_text": x, "date_added": f"Sun Jan 01 10:00:00 -0800 {y}"}) + "\n")
    return {"catalogue": str(tmp_path / "c.xml"), "books": str(tmp_path / "b.json.gz"), "authors": str(tmp_path / "a.json.gz"), "reviews": str(tmp_path / "r.json.gz")}


def test_batch(spark, tmp_path, capsys):
    paths = raw(tmp_path)
    batch = Batch(spark, str(tmp_path / "out"), **paths, partitions=2)
    features = {r.work_id: r for r in batch.features().collect()}
    assert {r.layer for r in batch.matched().collect()} == {"exact"}
    assert {w: r.translated_cz for w, r in features.items()} == {"w0": 1, "w1": 1, "w2": 1, "w3": 0, "w4": 0}
    assert (features["w0"].cutoff_year, features["w0"].pre_cutoff_ratings_count, features["w0"].pre_cutoff_avg_rating) == (2009, 1, 4.0)
    assert (features["w1"].pre_cutoff_ratings_count, features["w1"].pre_cutoff_reviews_with_text, features["w2"].pre_cutoff_avg_rating) == (1, 1, 3.5)
    assert all(r.split == "train" and r.shelf_scifi == 1.0 and r.lang_eng == 1 for r in features.values())
    main(["parse", "--out", str(tmp_path / "cli"), "--catalogue", paths["catalogue"], "--limit", "2", "--min-year", "2010", "--csv", "--report"])
    assert "parse: 1 rows" in capsys.readouterr().out
    assert list((tmp_path / "cli" / "parse.csv").glob("*.csv")) and list((tmp_path / "cli" / "coverage_report.json").glob("*.json"))


def test_matched_and_training_tables(spark, tmp_path):
    paths = raw(tmp_path)
    (tmp_path / "chart.csv").write_text("year,week,category,rank,isbn,author,title,publisher\n2010,1,x,3,978-80-00-00000-1,a,t,p\n")
    batch = Batch(spark, str(tmp_path / "out"), **paths, chart=str(tmp_path / "chart.csv"))
    rows = {r.nkc_id: r for r in batch.matched_dataset().collect()}
    assert set(rows) == {"n0", "n1", "n2"} and rows["n1"].match_layer == "exact" and rows["n1"].gr_work_id == "w1" and rows["n1"].gr_ratings_count == "60" and rows["n1"].gr_is_ebook == "false"
    assert rows["n0"].gr_popular_shelves == '[{"name":"fantasy","count":7}]' and rows["n0"].gr_average_rating == "" and rows["n0"].chart_appearances == 0 and rows["n0"].chart_bestseller == "false"
    assert rows["n0"].first_czech_year == 2009 and {r.nkc_id for r in batch.training().collect()} == set(rows)
    assert {r.measure: (r.n, r.share) for r in batch.funnel().collect()} == {"exact": (3, 1.0), "matched": (3, 1.0), "records": (3, 1.0)}
    c = batch.counters().first()
    assert (c.works, c.kept, c.dropped_ratings, c.candidates, c.rows_collapsed, c.matched_outside_pool) == (5, 5, 0, 3, 0, 0)
    assert [r.isbn for r in batch.chart_totals().collect()] == ["9788000000001"]


def test_limited_parse_is_no_step_of_later_commands(spark, tmp_path):
    paths = raw(tmp_path)
    batch = Batch(spark, str(tmp_path / "out"), **paths)
    assert (batch.translations(limit=1).count(), batch.translations(min_year=2010).count(), batch.translations(limit=2, min_year=2010).count()) == (1, 2, 1)
    assert batch.translations(limit=2).count() == 2  # not the rows of another limit
    assert batch.translations().count() == 3
    assert {r.layer for r in batch.matched().collect()} == {"exact"} and batch.matched().count() == 3
    assert batch.labels().where("translated_cz = 1").count() == 3
