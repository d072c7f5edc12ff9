import gzip
import json

import pytest
from pyspark.sql import functions as F

from foliant.functions.fuzzy import token_set
from foliant.functions.text import normalize_text
from foliant.operators import books, cascade, catalogue, charts, labels, profile
from foliant.sources import readers

FIELDS = "line_no long, controlfield array<struct<tag:string,text:string>>, datafield array<struct<tag:string,ind1:string,ind2:string,subfield:array<struct<code:string,text:string>>>>"


def field(tag, *subs):
    return (tag, " ", " ", list(subs))


def test_translations_only(spark):
    cases = {
        1: [field("041", ("a", "cze"), ("h", "eng"))], 2: [field("041", ("a", "cze"))], 3: [field("041", ("a", "cze"), ("h", "cze"))], 4: [field("041", ("a", "cze"), ("h", "und"))],
        5: [field("041", ("a", "eng"), ("h", "ger")), field("041", ("a", "cze"))], 6: None, 7: [("041", None, None, None)], 8: [field("041", ("a", "cze"), ("h", ""), ("h", "fre"))],
    }
    df = spark.createDataFrame([(k, [("001", f"n{k}")], v) for k, v in cases.items()], FIELDS)
    assert sorted(r.line_no for r in catalogue.translation_rows(df).collect()) == [1, 8]


def test_flat_row(spark):
    data = [field("041", ("a", "cze"), ("h", "eng"), ("h", "und"), ("h", "ger"), ("h", "eng")), field("020", ("a", "80-7203-410-3 (váz.)")), field("020", ("a", "(brož.)")), field("035", ("a", "(OCoLC)ocm0099")), field("100", ("a", "King, Stephen,")),
            field("240", ("a", " /")), field("245", ("a", "Nazev : /")), field("260", ("c", "c1982")), field("260", ("c", "1990")), field("264", ("c", "[1983]")), field("765", ("t", ":"), ("t", "Original ;"), ("z", "0-1 (x)"), ("w", "(OCoLC)5")), field("655", ("a", "a."), ("a", "a")), field("700", ("a", "B, C"))]
    df = spark.createDataFrame([(1, [("001", "x"), ("001", " y ")], data), (2, [], [field("041", ("a", "cze"), ("h", "eng")), field("260", ("c", "1700"))])], FIELDS)
    (row,) = catalogue.translation_rows(df).select(*catalogue.COLUMNS).collect()
    assert tuple(row) == ("y", "99", "80-7203-410-3", "Nazev", "Original", "0-1", "(OCoLC)5", "King, Stephen", "B, C", "1983", "eng|ger", "a")
    assert catalogue.translation_rows(df, min_year=1990).count() == 0
    report = catalogue.inventory(df).first()
    assert (report.total_records, report.translation_records, report.filter_rate, report.share_c264, report.share_year) == (2, 1, 0.5, 1.0, 1.0)
    assert catalogue.inventory(df.limit(0)).first().total_records == 0


def lines(spark, objects):
    return spark.createDataFrame([(i, o if o is None or isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects, 1)], "line_no long, json_text string")


def test_pool(spark):
    df = lines(spark, [
        {"book_id": "2", "work_id": "w", "title": "T (S, #1)", "ratings_count": "30", "publication_year": "1990", "language_code": "en-US", "popular_shelves": [{"name": "Sci Fi", "count": "3"}, {"name": "Fantasy", "count": 1}, {"name": "love", "count": "1"}]},
        {"book_id": "1", "work_id": "w", "title": "U", "ratings_count": 30, "publication_year": "2087", "language_code": "ger", "popular_shelves": {"name": "classics", "count": 2}},
        {"book_id": "3", "work_id": "x", "title": "C", "ratings_count": "99", "publication_year": "1990", "language_code": "cze"}, {"book_id": "4", "work_id": "", "title": "S", "ratings_count": "99"}, "broken {", None, {"work_id": "w"},
    ])
    editions = books.editions(df)
    (row,) = books.candidate_pool(editions).collect()
    assert (row.work_id, row.rep_book_id, row.title, row.language, row.pub_year, row.n_editions, row.ratings_count, row.shelf_classics) == ("w", "1", "U", "ger", 1990, 2, 60, 1.0)
    index = {r.book_id: r.norm_title for r in books.book_index(editions).collect()}
    assert index["2"] == "t" and set(index) == {"1", "2", "3", "4"}
    assert books.candidate_pool(books.editions(df.limit(0))).count() == 0


def sources(spark):
    translations = spark.createDataFrame(
        [("n1", "King, Stephen", "The Stand", "1990", "eng"), ("n2", "King, Stephen", "The Stend of it", "1990", "eng"), ("n3", "Kings, Stephen", "It", "1990", "eng"), ("n4", "Nobody", "None", "1990", "eng"), ("n5", None, "It", "", None), ("n6", "King, Stephen", None, None, "eng"), ("n1", "King, Stephen", "The Stand", "1990", "eng")],
        "nkc_id string, author string, original_title string, czech_pub_year string, source_lang string",
    )
    editions = spark.createDataFrame(
        [("b1", "w1", "stand", 5, 1978, "en", "a1"), ("b2", "w1", "stand", 9, 1991, "eng", "a1"), ("b3", "w2", "stand", 50, 1980, "de", "a1"), ("b4", "w3", "it", 7, 1986, "en", "a1"), ("b5", None, "stand of it", 1, None, None, "a1"), ("b6", "w4", None, 1, 0, "en", "a1"), ("b7", "w4", "x", 1, 0, "en", None)],
        "book_id string, work_id string, norm_title string, ratings_count int, pub_year int, language_code string, author_id string",
    ).withColumn("loaded_at", F.lit("2017-01-01").cast("timestamp"))
    authors = spark.createDataFrame([("a1", "Stephen King"), ("a2", None), ("a1", "Stephen King")], "author_id string, name string")
    return translations, editions, authors


def test_cascade(spark):
    got = {r.nkc_id: (r.layer, r.book_id, r.work_id, r.score) for r in cascade.cascade(*sources(spark)).collect()}
    assert got["n1"] == ("exact", "b2", "w1", 100)  # language first, then the nearer year; across works language before ratings
    assert got["n2"][0] == "title" and got["n2"][1] in ("b4", "b5")  # "it" lies within the title's words
    assert got["n3"] == ("author", "b4", "w3", int(token_set("stephen kings", "stephen king")))
    assert got["n4"][0] == got["n5"][0] == got["n6"][0] == "unmatched"
    assert len(got) == 6


def test_cascade_reports_the_highest_score(spark):
    """The winner is chosen by the tie-break, and the score may be another candidate's."""
    facts = spark.createDataFrame([("a", "w1", "t", 1, 2000, "de"), ("b", "w2", "t", 1, 2000, "en")], "book_id string, work_id string, book_title string, ratings int, pub_year int, language_code string")
    found = spark.createDataFrame([("n", 2000, "en", "a", 100), ("n", 2000, "en", "b", 90)], "nkc_id string, czech_year int, prefix string, book_id string, score int")
    assert [tuple(r) for r in cascade.pick(found, facts).collect()] == [("n", "b", "w2", 100)]


def test_cascade_on_empty_tables(spark):
    translations, editions, authors = sources(spark)
    assert {r.layer for r in cascade.cascade(translations, editions.limit(0), authors).collect()} == {"unmatched"}
    assert cascade.cascade(translations.limit(0), editions, authors).count() == 0


def test_charts(spark):
    chart = spark.createDataFrame([("80-7203-410-3", "2005", "3", "x"), ("9788072034109", "2004", "7", "y"), ("97880720341", "2004", "1", "y"), ("9788072034109", "x", "1", "y"), (None, "2004", "1", "y"), ("9788072034109", "2004", "2", None)], "isbn string, year string, rank string, category string")
    totals = charts.chart_totals(chart)
    assert [tuple(r) for r in totals.collect()] == [("9788072034109", 3, 2004, 2, ["x", "y"])]
    records = spark.createDataFrame([("r1", "80-7203-410-3|9788072034109"), ("r2", ""), ("r3", None)], "nkc_id string, czech_isbn string")
    got = {r.nkc_id: (r.appearances, r.best_rank, r.categories, r.bestseller) for r in charts.roll_up(records, totals).collect()}
    assert got == {"r1": (6, 2, "x|y", "true"), "r2": (0, None, "", "false"), "r3": (0, None, "", "false")}
    assert {r.nkc_id: r.appearances for r in charts.roll_up(records, totals, dedupe=True).collect()}["r1"] == 3


def test_training_rows(spark):
    rows = spark.createDataFrame(
        [("n1", "a", "t", "exact", 2005, 2005, 20, 0), ("n2", "a", "t", "exact", 2009, 2005, 20, 3), ("n3", "a", "t", "exact", 2004, 2005, 20, 3), ("n4", "b", "t", "exact", 2005, 1999, 20, 3), ("n5", "c", "t", "unmatched", 2005, None, 20, 3), ("n6", "d", "t", "exact", 2005, None, 9, 3)],
        "nkc_id string, norm_author string, norm_title string, layer string, czech_year int, first_czech_year int, ratings int, appearances int",
    )
    assert [(r.nkc_id, r.n_rows) for r in charts.training_rows(rows).collect()] == [("n3", 3)]


def test_labels(spark):
    pool = spark.createDataFrame([("p", 2000), ("q", 2000), ("n", 2005), ("late", 2017), ("old", 1990), ("m", None), ("own", 2012)], "work_id string, pub_year int")
    years = spark.createDataFrame([("p", 2010), ("q", 2012), ("old", 2000), ("own", 2012), ("gone", 2010)], "work_id string, first_cz_year int")
    parts = labels.partition(pool, years)
    assert {r.work_id: r.part for r in parts.collect()} == {"p": "positive", "q": "positive", "n": "negative", "late": "negative", "old": "before", "m": "negative", "own": "positive"}
    got = {r.work_id: (r.translated_cz, r.cutoff_year) for r in labels.cutoffs(parts).collect()}
    assert set(got) == {"p", "q", "n"} and got["p"] == (1, 2010) and got["n"][1] in (2010, 2012)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {r.work_id: (r.translated_cz, r.cutoff_year) for r in labels.cutoffs(parts).collect()} == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_features(spark):
    shelves = {c: 0.0 for c in labels.SHELF_COLUMNS}
    base = {"rep_book_id": "b", "title": "t", "n_editions": 1, "ratings_count_2017": 5, "text_reviews_2017": 1, **shelves}
    schema = "work_id string, rep_book_id string, title string, language string, pub_year int, n_editions int, ratings_count_2017 int, text_reviews_2017 int, " + ", ".join(f"{c} double" for c in shelves) + ", translated_cz int, cutoff_year int"
    data = [{"work_id": w, "language": g, "pub_year": 2000, "translated_cz": 1, "cutoff_year": y, **base} for w, g, y in (("a", "ENG", 2015), ("b", None, 2016), ("c", "ger", 2017))]
    table = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in data], schema)
    stats = spark.createDataFrame([("a", 2015, 5, 4.0, 2), ("a", 2015, 5, 4.0, 2), ("b", 2016, 4, None, 0), ("c", 2016, 9, 1.0, 9)], "work_id string, cutoff_year int, pre_cutoff_ratings_count int, pre_cutoff_avg_rating double, pre_cutoff_reviews_with_text int")
    rows = labels.features(table, stats)
    got = {r.work_id: (r.pre_cutoff_ratings_count, r.pre_cutoff_avg_rating, r.has_precutoff_signal, r.split, r.lang_eng, r.age_at_cutoff) for r in rows.collect()}
    assert got == {"a": (5, 4.0, 1, "train", 1, 15), "b": (4, 3.5, 0, "val", 0, 16), "c": (0, 3.5, 0, "test", 0, 17)}
    assert sorted(labels.feature_columns(rows)) == sorted(labels.FEATURES) and len(labels.FEATURES) == 19
    with pytest.raises(Exception, match="no split"):
        labels.check_split(labels.features(table.withColumn("cutoff_year", F.lit(2018)), stats)).collect()


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 2.0), ("a", 2.0, 0, 2.0), (" ", 3.0, 1, 2.0), (None, None, 0, 2.0)], "s string, v double, y int, k double")
    assert [tuple(r) for r in profile.frequency(df, profile.missing_as(F.col("s"), "<m>"), "s").collect()] == [("<m>", 2), ("a", 2)]
    assert {r["column"]: r["share"] for r in profile.filled_shares(df, ["s", "v"]).collect()} == {"s": 0.5, "v": 0.75}
    assert {r["column"] for r in profile.correlations(df, ["v", "k"], "y").collect()} == {"v"}  # k is constant
    assert sorted(tuple(r) for r in profile.histogram(df, F.col("v"), 2).collect()) == [(1, 1), (2, 2)]
    assert [tuple(r) for r in profile.histogram(df, F.col("k"), 3).collect()] == [(1, 4)]
    assert profile.histogram(df.limit(0), F.col("v"), 3).count() == 0
    assert [tuple(r) for r in profile.grouped_rate(df, F.col("s"), "s", F.col("y") == 1, least=2).collect()] == [("a", 2, 0.5)]


def test_ranking_against_brute_force(spark):
    import random

    random.seed(4)
    data = [(i, random.randint(0, 1), float(random.randint(-5, 40))) for i in range(300)]
    got = profile.ranking(spark.createDataFrame([*data, (999, None, 1.0), (998, 1, None)], "id int, y int, s double"), "y", "s", ["id"], (10, 1000)).first()
    pos, neg = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    top = sum(y for _, y, _ in sorted(data, key=lambda r: (-r[2], r[0]))[:10])
    assert abs(got.roc_auc - auc) < 1e-5 and abs(got.precision_10 - top / 10) < 1e-9 and got.recall_1000 == 1.0 and abs(got.lift_10 - top / 10 / (len(pos) / 300)) < 1e-5


def test_xml_source(spark, tmp_path):
    record = '<record><controlfield tag="001">n1</controlfield><datafield tag="041" ind1="1" ind2=" "><subfield code="a">cze</subfield><subfield code="h">eng</subfield></datafield><datafield tag="245" ind1=" " ind2=" "><subfield code="a">Krakatit /</subfield></datafield></record>'
    path = tmp_path / "dump.xml.gz"
    path.write_text(f'<collection xmlns="http://www.loc.gov/MARC21/slim">{record}{record}</collection>')
    copy = readers.plain_copy(spark, str(path))
    assert copy.endswith("/dump.xml")
    rows = catalogue.translation_rows(readers.read_catalogue(spark, copy))
    assert [(r.nkc_id, r.czech_title) for r in rows.collect()] == [("n1", "Krakatit")] * 2
    with gzip.open(tmp_path / "real.gz", "wt") as f:
        f.write("x")
    assert readers.plain_copy(spark, str(tmp_path / "real.gz")) == str(tmp_path / "real.gz") and readers.plain_copy(spark, "x.xml") == "x.xml"


def test_xml_shapes(spark, tmp_path):
    """Prefixes, line breaks, entities, CDATA, comments, empty records and faults, whatever the size of the parts."""
    ns = '<marc:record xmlns:marc="m"><marc:controlfield tag="001"> n2 </marc:controlfield><marc:datafield tag="245" ind1="1" ind2=" "><marc:subfield code="a"><![CDATA[A & B]]></marc:subfield><!-- no --></marc:datafield></marc:record>'
    texts = ["<record>\n<controlfield tag='001'>n&amp;1</controlfield>\n</record>", "<record type='x'></record>", '<record><controlfield tag="001">n & 3</controlfield><datafield tag="245" ind1=" " ind2=" "><subfield code="a">T</subfield></record>']
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?>\n<records><!-- head -->" + "\n".join(texts * 50) + "</records>\n")
    (tmp_path / "b.xml").write_text(f"<marc:collection>{ns}</marc:collection>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = readers.read_catalogue(spark, str(tmp_path / "a.xml")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert len(got) == 150 == len({r.line_no for r in got})
    one = lambda r: ([tuple(c) for c in r.controlfield], [(f.tag, f.ind1, [tuple(s) for s in f.subfield]) for f in r.datafield])
    assert {str(one(r)) for r in got} == {str(x) for x in [([("001", "n&1")], []), ([], []), ([("001", "n & 3")], [("245", " ", [("a", "T")])])]}
    assert [one(r) for r in readers.read_catalogue(spark, str(tmp_path / "b.xml"), row_tag="marc:record").collect()] == [([("001", "n2")], [("245", "1", [("a", "A & B")])])]


PAGE = """<table class="x"><tr><td>no</td></tr></table><table class="ranking big"><thead><tr><th><h2> Próza </h2></th></tr></thead>
<tbody><tr><td>978-1</td><td>A</td><td><b>T</b> t</td><td>P</td></tr><tr><td>short</td></tr><tr><td>978-2</td><td>B</td><td>U</td><td>Q</td><td>more</td></tr></tbody>
<h2>Děti</h2><tbody><tr><td>978-3</td><td>C</td><td>V</td><td>R</td></tr></tbody></table><table class="ranking"><h2>Z</h2><tbody><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></tbody></table>"""


def test_chart_pages(spark):
    pages = spark.createDataFrame([(2004, 1, PAGE), (2004, 2, ""), (2004, 3, None), (2004, 4, "<table class='ranking'><h2>open")], "year int, week int, html string")
    assert [tuple(r) for r in readers.chart_rows(pages).orderBy("isbn").collect()] == [(2004, 1, "Próza", 1, "978-1", "A", "Tt", "P"), (2004, 1, "Próza", 3, "978-2", "B", "U", "Q"), (2004, 1, "Děti", 1, "978-3", "C", "V", "R")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc', None), (2, "", "x")], "i int, s string, t string")
    readers.write_csv(df, str(tmp_path / "csv"), ["i", "s", "t"])
    back = readers.read_csv(spark, str(tmp_path / "csv"), "i int, s string, t string", fill=True)
    assert sorted(tuple(r) for r in back.collect()) == [(1, 'a "q", b\nc', ""), (2, "", "x")]
    readers.write_report(df.limit(1), str(tmp_path / "json"))
    assert readers.read_json_lines(spark, str(tmp_path / "json"), "i int, s string", partitions=2).count() == 1
    built = []
    make = lambda: built.append(1) or df
    for force in (False, False, True):
        assert readers.step(spark, str(tmp_path / "step"), make, force=force).count() == 2
    assert len(built) == 2


def test_normalised_keys_agree_with_the_rule(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/goodreads_author_names.parquet").where("name IS NOT NULL")
    from foliant.functions import text as t

    assert all(r.n == normalize_text(r.name) for r in rows.select("name", t.normalize(F.col("name")).alias("n")).collect())


def test_models_beat_chance(spark):
    from foliant.operators import models
    from foliant.plans.queries import feature_table

    table = feature_table(spark, "/root/testdata/sf0.001").withColumn("split", F.when(F.pmod(F.xxhash64("work_id"), F.lit(3)) == 0, "val").otherwise("train"))
    table = table.withColumn("translated_cz", (F.col("shelf_fiction") > 0.15).cast("int"))  # a label that one feature decides
    got = {r.model: r for r in models.comparison(table, key=["work_id", "cutoff_year"]).collect()}
    assert set(got) == {"popularity", "logistic_balanced", "boosted_trees"} and got["logistic_balanced"].roc_auc > 0.8 and got["boosted_trees"].roc_auc > 0.9


def test_reviews_without_id_count_each(spark):
    from datetime import datetime

    written = "Sun Jan 01 10:00:00 -0800 2005"
    rows = [(None, "b1", 4, "good", written), (None, "b1", 2, "", written), (None, "b1", 2, "", written), ("r1", "b1", 5, "fine", written), ("r1", "b1", 5, "fine", written)]
    reviews = spark.createDataFrame(rows, "review_id string, book_id string, rating int, review_text string, date_added string").repartition(3)
    asked = spark.createDataFrame([("w1", 2010), ("w1", 2004)], "work_id string, cutoff_year int")
    editions = spark.createDataFrame([("b1", "w1", datetime(2017, 1, 1))], "book_id string, work_id string, loaded_at timestamp")
    assert sorted(map(tuple, labels.pre_cutoff_stats(asked, reviews, editions).collect())) == [("w1", 2004, 0, None, 0), ("w1", 2010, 4, 3.25, 2)]


def test_broken_xml_records_are_kept(spark, tmp_path):
    record = '<record><controlfield tag="001">%s</controlfield><datafield tag="041" ind1="1" ind2=" "><subfield code="a">cze</subfield><subfield code="h">eng</subfield></datafield><datafield tag="245" ind1=" " ind2=" "><subfield code="a">%s</datafield></record>'
    whole = [("n1", "Dobro &amp; zlo</subfield>"), ("n2", "Krakatit</subfield>")]
    broken = [("n3", "Dobro & zlo</subfield>"), ("n4", "Bez konce"), ("n5", "Jiny konec</subfeld>")]
    path = tmp_path / "dump.xml"
    path.write_text('<collection xmlns="http://www.loc.gov/MARC21/slim">' + "\n".join(record % x for x in [whole[0], *broken, whole[1]]) + "</collection>")
    records = readers.read_catalogue(spark, str(path))
    assert {r.nkc_id: r.czech_title for r in catalogue.translation_rows(records).collect()} == {"n1": "Dobro & zlo", "n2": "Krakatit", "n3": "Dobro & zlo", "n4": "Bez konce", "n5": "Jiny konec"}
    assert catalogue.inventory(records).first().total_records == 5
