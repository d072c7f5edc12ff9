"""DuckDB SQL of the core's queries, written from the definitions and not from the plans."""

from __future__ import annotations

import string
import unicodedata

from foliant.functions.codes import LANGUAGE_GROUP, LANGUAGE_PREFIX, SHELVES
from foliant.functions.text import ARTICLES, REPLACEMENTS

_WIDE = [chr(c) for c in range(0xFF01, 0xFF5F)]
_OTHER = {"Ĳ": "IJ", "ĳ": "ij", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬅ": "st", "ﬆ": "st", "K": "K", "…": "..."}
_SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _quote(text: str) -> str:
    return text.replace("'", "''")


def norm(x: str) -> str:
    """SQL of the text normalisation."""
    for a, b in {**REPLACEMENTS, **_OTHER}.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"translate({x}, '{_quote(''.join(_WIDE))}{_SPACES}', '{_quote(''.join(unicodedata.normalize('NFKD', c) for c in _WIDE))}{' ' * len(_SPACES)}')"
    x = f"translate(lower(strip_accents(nfc_normalize({x}))), '{_quote(string.punctuation)}', '')"
    x = f"trim(regexp_replace({x}, '[\\s]+', ' ', 'g'))"
    return f"trim(regexp_replace({x}, '^({'|'.join(ARTICLES)})( |$)', ''))"


def norm_author(x: str) -> str:
    turned = f"CASE WHEN contains({x}, ',') THEN trim(substr({x}, strpos({x}, ',') + 1)) || ' ' || trim(substr({x}, 1, strpos({x}, ',') - 1)) ELSE {x} END"
    return norm(f"({turned})")


def year(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '(?:^|[^0-9A-Za-zÀ-ž_])(1[0-9]{{3}}|20[0-9]{{2}})(?:$|[^0-9A-Za-zÀ-ž_])', 1), '') AS INT)"


def _case(entries: dict[str, str], x: str, other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in entries.items()) + f" ELSE {other} END"


def prefix(x: str) -> str:
    return f"coalesce({_case(LANGUAGE_PREFIX, f'lower(trim(split_part({x}, chr(124), 1)))', chr(39) * 2)}, '')"


def group(x: str) -> str:
    low = f"lower(trim(coalesce({x}, '')))"
    return _case(LANGUAGE_GROUP, low, low)


def _clean(x: str) -> str:
    return f"nullif(trim(rtrim({x}, ' :/.,;')), '')"


# ---- catalogue


def _vals(tag: str, code: str) -> str:
    inner = f"list_transform(list_filter(coalesce(f.subfield, []), lambda s: s.code = '{code}'), lambda s: coalesce(trim(s.text), ''))"
    return f"flatten(list_transform(list_filter(coalesce(datafield, []), lambda f: f.tag = '{tag}'), lambda f: {inner}))"


def _join(x: str) -> str:
    """Non-empty elements once each, in order."""
    kept = f"list_filter({x}, lambda v: v IS NOT NULL AND v <> '')"
    return f"coalesce(array_to_string(list_filter({kept}, lambda v, i: list_position({kept}, v) = i), '|'), '')"


_ISBN = _clean("trim(split_part(v, '(', 1))")
_ROWS = f"""
rows_ AS (
  SELECT line_no, datafield, coalesce(trim(list_filter(coalesce(controlfield, []), lambda c: c.tag = '001')[-1].text), '') AS nkc_id,
    coalesce(list_filter(list_transform({_vals("035", "a")}, lambda v: nullif(regexp_extract(v, '\\(OCoLC\\)(?:ocm|ocn|on)?0*([0-9]+)', 1), '')), lambda v: v IS NOT NULL)[1], '') AS oclc,
    {_join(f"list_transform({_vals('020', 'a')}, lambda v: {_ISBN})")} AS czech_isbn,
    coalesce({_clean(f"({_vals('245', 'a')})[1]")}, '') AS czech_title,
    coalesce({_clean(f"({_vals('240', 'a')})[1]")}, list_filter(list_transform({_vals('765', 't')}, lambda v: {_clean('v')}), lambda v: v IS NOT NULL)[1], '') AS original_title,
    {_join(f"list_transform({_vals('765', 'z')}, lambda v: {_ISBN})")} AS original_isbn,
    {_join(_vals("765", "w"))} AS original_sysnum,
    coalesce({_clean(f"({_vals('100', 'a')})[1]")}, '') AS author,
    {_join(f"list_transform({_vals('700', 'a')}, lambda v: {_clean('v')})")} AS secondary_authors,
    coalesce({year(f"({_vals('260', 'c')})[1]")}, {year(f"({_vals('264', 'c')})[1]")}) AS y,
    {_join(f"list_filter({_vals('041', 'h')}, lambda v: v NOT IN ('cze', 'und'))")} AS source_lang,
    {_join(f"list_transform({_vals('655', 'a')}, lambda v: {_clean('v')})")} AS genres,
    coalesce(({_vals("260", "c")})[1], '') AS c260, coalesce(({_vals("264", "c")})[1], '') AS c264, len({_vals("655", "a")}) > 0 AS has655, len(list_filter(datafield, lambda f: f.tag = '765')) > 0 AS has765
  FROM nkc_records
  WHERE len(list_filter(coalesce(datafield, []), lambda f: f.tag = '041'
    AND len(list_filter(coalesce(f.subfield, []), lambda s: s.code = 'a' AND trim(s.text) = 'cze')) > 0
    AND len(list_filter(coalesce(f.subfield, []), lambda s: s.code = 'h' AND coalesce(trim(s.text), '') NOT IN ('', 'cze', 'und'))) > 0)) > 0),
kept AS (SELECT *, coalesce(CAST(y AS VARCHAR), '') AS czech_pub_year FROM rows_ WHERE y IS NULL OR y >= 1800)"""
_COLUMNS = "nkc_id, oclc, czech_isbn, czech_title, original_title, original_isbn, original_sysnum, author, secondary_authors, czech_pub_year, source_lang, genres"


def _share(name: str, test: str) -> str:
    return f"round(coalesce(avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END), 0), 4) AS share_{name}"


# ---- books

_JSON = """
j AS (SELECT line_no, CAST(json_text AS JSON) AS j FROM goodreads_books_raw WHERE json_valid(json_text)),
raw_ AS (
  SELECT line_no, j->>'$.book_id' AS book_id, j->>'$.work_id' AS work_id, coalesce(nullif(j->>'$.title_without_series', ''), j->>'$.title', '') AS title, j->>'$.isbn13' AS isbn13, coalesce(j->>'$.language_code', '') AS language_code,
    coalesce(TRY_CAST(trim(j->>'$.ratings_count') AS INT), 0) AS ratings, coalesce(TRY_CAST(trim(j->>'$.text_reviews_count') AS INT), 0) AS text_reviews, coalesce(TRY_CAST(trim(j->>'$.publication_year') AS INT), 0) AS pub_year,
    json_extract(j, '$.popular_shelves') AS s0, json_extract(j, '$.authors') AS a0 FROM j WHERE j->>'$.book_id' <> ''),
norm_ AS (
  SELECT *, CASE WHEN json_type(s0) = 'VARCHAR' THEN CAST(s0->>'$' AS JSON) ELSE s0 END AS s1, CASE WHEN json_type(a0) = 'VARCHAR' THEN CAST(a0->>'$' AS JSON) ELSE a0 END AS a1 FROM raw_),
books AS (
  SELECT * EXCLUDE (s0, a0, s1, a1),
    list_transform(list_filter(CASE json_type(s1) WHEN 'ARRAY' THEN CAST(s1 AS JSON[]) WHEN 'OBJECT' THEN [s1] ELSE [] END, lambda x: json_type(x) = 'OBJECT'), lambda x: {'name': x->>'$.name', 'count': coalesce(TRY_CAST(trim(x->>'$.count') AS BIGINT), 0)}) AS shelves,
    list_filter(list_transform(CASE json_type(a1) WHEN 'ARRAY' THEN CAST(a1 AS JSON[]) WHEN 'OBJECT' THEN [a1] ELSE [] END, lambda x: x->>'$.author_id'), lambda x: x <> '') AS author_ids
  FROM norm_),
last_ AS (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY line_no DESC) = 1)"""


def _bucket(names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"coalesce(list_sum(list_transform(list_filter(shelves, lambda s: replace(lower(coalesce(s.name, '')), ' ', '-') IN ({listed})), lambda s: s.count)), 0)"


_BUCKETS = ", ".join(f"{_bucket(v)} AS n_{k}" for k, v in SHELVES.items())
_TOTAL = " + ".join(f"b.n_{k}" for k in SHELVES)
_SHARES = ", ".join(f"CASE WHEN {_TOTAL} > 0 THEN round(b.n_{k} / ({_TOTAL})::DOUBLE, 4) ELSE 0.0 END AS shelf_{k}" for k in SHELVES)

# ---- matching

_FACTS = f"""
now_ AS (SELECT DISTINCT * FROM goodreads_book_details QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY loaded_at DESC, work_id DESC NULLS LAST) = 1),
facts AS (
  SELECT book_id, coalesce(nullif(trim(work_id), ''), '_solo:' || book_id) AS work_id, coalesce(norm_title, '') AS book_title, coalesce(ratings_count, 0) AS ratings, nullif(coalesce(pub_year, 0), 0) AS pub_year, coalesce(language_code, '') AS language_code, author_id FROM now_),
names_ AS (SELECT DISTINCT author_id, {norm("name")} AS norm_author FROM goodreads_author_names WHERE name <> ''),
book_authors AS (SELECT DISTINCT book_id, norm_author FROM facts JOIN names_ USING (author_id) WHERE norm_author <> ''),
records AS (
  SELECT DISTINCT nkc_id, {norm_author("coalesce(author, '')")} AS norm_author, {norm("coalesce(original_title, '')")} AS norm_title, {year("coalesce(czech_pub_year, '')")} AS czech_year, {prefix("coalesce(source_lang, '')")} AS prefix FROM nkc_translations),
cand AS (
  SELECT r.nkc_id, f.book_id, f.work_id, CASE WHEN r.prefix <> '' AND starts_with(lower(f.language_code), r.prefix) THEN 0 ELSE 1 END AS other, coalesce(abs(f.pub_year - r.czech_year), 10000) AS far, -f.ratings AS less
  FROM records r JOIN book_authors a USING (norm_author) JOIN facts f ON f.book_id = a.book_id AND f.book_title = r.norm_title WHERE r.norm_author <> '' AND r.norm_title <> ''),
per_work AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY nkc_id, work_id ORDER BY other, far, less, book_id) = 1),
exact AS (SELECT nkc_id, book_id, work_id FROM per_work QUALIFY row_number() OVER (PARTITION BY nkc_id ORDER BY other, less, far, book_id, work_id) = 1),
first_ AS (SELECT norm_author, norm_title, min(czech_year) AS first_czech_year FROM records WHERE norm_author <> '' AND norm_title <> '' AND czech_year IS NOT NULL GROUP BY ALL)"""

def _best(name: str, source: str) -> str:
    """CTEs of the winners among candidates (nkc_id, prefix, czech_year, book_id, score)."""
    return f"""
{name}_c AS (SELECT c.nkc_id, c.score, f.book_id, f.work_id, CASE WHEN c.prefix <> '' AND starts_with(lower(f.language_code), c.prefix) THEN 0 ELSE 1 END AS other, coalesce(abs(f.pub_year - c.czech_year), 10000) AS far, -f.ratings AS less FROM {source} c JOIN facts f USING (book_id)),
{name}_w AS (SELECT *, max(score) OVER (PARTITION BY nkc_id) AS top FROM {name}_c QUALIFY row_number() OVER (PARTITION BY nkc_id, work_id ORDER BY other, far, less, -score, book_id) = 1),
{name} AS (SELECT w.nkc_id, w.book_id, w.work_id, m.score FROM {name}_w w JOIN (SELECT nkc_id, max(score) AS score FROM {name}_c GROUP BY 1) m USING (nkc_id) QUALIFY row_number() OVER (PARTITION BY w.nkc_id ORDER BY other, less, far, -w.score, book_id, work_id) = 1)"""


def _similar(name: str, source: str, a: str, b: str) -> str:
    """CTEs that add ``score``, the token-set similarity of two texts: the longest common subsequence runs bit-parallel over whole numbers of 128 bits."""
    words = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> ''))"
    mask = "list_transform(list_filter(string_split(r, ''), lambda c: c <> ''), lambda c: coalesce(CAST(list_sum(list_transform(range(1, CAST(length(l) + 1 AS BIGINT)), lambda i: CASE WHEN l[i] = c THEN CAST(pow(2, i - 1) AS HUGEINT) ELSE 0::HUGEINT END)) AS HUGEINT), 0::HUGEINT))"
    full = "(CAST(pow(2, length(l)) AS HUGEINT) - 1)"
    ratio = "CASE WHEN {t} > 0 THEN 100::DOUBLE * (1 - ({d})::DOUBLE / ({t})) ELSE 100::DOUBLE END"
    whole = ratio.format(t="2 * (s + g) + length(l) + length(r)", d="d")
    left, right = (ratio.format(t=f"2 * s + g + length({x})", d=f"g + length({x})") for x in "lr")
    return f"""
{name}_1 AS (SELECT *, {words.format(a)} AS x, {words.format(b)} AS y FROM {source}),
{name}_2 AS (SELECT *, list_sort(list_filter(x, lambda w: NOT list_contains(y, w))) AS ox, list_sort(list_filter(y, lambda w: NOT list_contains(x, w))) AS oy, list_filter(x, lambda w: list_contains(y, w)) AS both_ FROM {name}_1),
{name}_3 AS (SELECT *, coalesce(array_to_string(ox, ' '), '') AS l, coalesce(array_to_string(oy, ' '), '') AS r, length(coalesce(array_to_string(both_, ' '), '')) AS s, CASE WHEN len(both_) > 0 THEN 1 ELSE 0 END AS g FROM {name}_2),
{name}_4 AS (SELECT *, length(l) + length(r) - 2 * (length(l) - bit_count(list_reduce({mask}, lambda acc, m: ((acc + (acc & m)) | (acc - (acc & m))) & {full}, {full}))) AS d FROM {name}_3),
{name} AS (SELECT * EXCLUDE (x, y, ox, oy, both_, l, r, s, g, d), CAST(floor(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN s > 0 AND (len(ox) = 0 OR len(oy) = 0) THEN 100 WHEN s > 0 THEN greatest({whole}, {left}, {right}) ELSE {whole} END) AS INT) AS score FROM {name}_4)"""


_CASCADE = f"""{_FACTS},
keyed AS (SELECT * FROM records WHERE norm_author <> '' AND norm_title <> ''),
titled AS (SELECT DISTINCT f.book_id, f.book_title, a.norm_author FROM facts f JOIN book_authors a USING (book_id) WHERE f.book_title <> ''),
hit1 AS (SELECT nkc_id, prefix, czech_year, book_id, 100 AS score FROM keyed k JOIN titled b ON b.norm_author = k.norm_author AND b.book_title = k.norm_title),{_best("win1", "hit1")},
open2 AS (SELECT * FROM keyed WHERE nkc_id NOT IN (SELECT nkc_id FROM win1)),
pair2 AS (SELECT DISTINCT k.norm_author, k.norm_title, b.book_title FROM open2 k JOIN titled b USING (norm_author)),{_similar("score2", "pair2", "norm_title", "book_title")},
hit2 AS (SELECT k.nkc_id, k.prefix, k.czech_year, b.book_id, s.score FROM open2 k JOIN score2 s USING (norm_author, norm_title) JOIN titled b USING (norm_author, book_title) WHERE s.score >= 88),{_best("win2", "hit2")},
open3 AS (SELECT * FROM open2 WHERE nkc_id NOT IN (SELECT nkc_id FROM win2)),
pair3 AS (SELECT DISTINCT k.norm_title, k.norm_author, b.norm_author AS book_author FROM open3 k JOIN titled b ON b.book_title = k.norm_title),{_similar("score3", "pair3", "norm_author", "book_author")},
hit3 AS (SELECT k.nkc_id, k.prefix, k.czech_year, b.book_id, max(s.score) AS score FROM open3 k JOIN score3 s USING (norm_title, norm_author) JOIN titled b ON b.book_title = s.norm_title AND b.norm_author = s.book_author WHERE s.score >= 85 GROUP BY ALL),{_best("win3", "hit3")},
won AS (SELECT 'exact' AS layer, * FROM win1 UNION ALL SELECT 'title', * FROM win2 UNION ALL SELECT 'author', * FROM win3),
matches AS (SELECT r.nkc_id, coalesce(w.layer, 'unmatched') AS layer, w.book_id, w.work_id, w.score FROM (SELECT DISTINCT nkc_id FROM records) r LEFT JOIN won w USING (nkc_id))"""


def _isbn13(x: str) -> str:
    s = f"upper(regexp_replace({x}, '[\\s\\-]', '', 'g'))"
    b = f"'978' || substr({s}, 1, 9)"
    check = f"CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({b}, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS INT)::VARCHAR"
    return f"CASE WHEN regexp_matches({s}, '^[0-9]{{9}}[0-9X]$') THEN {b} || {check} WHEN regexp_matches({s}, '^[0-9]{{12}}$') THEN '9' || {s} ELSE {s} END"


_REVIEWS = """
work_of AS (SELECT book_id, max_by(work_id, loaded_at) AS work_id FROM goodreads_book_details GROUP BY book_id),
rv AS (
  SELECT *, CASE WHEN regexp_matches(trim(date_added), '^[A-Z][a-z]{2} [A-Z][a-z]{2} [0-9]{1,2} [0-9:]{8} [+-][0-9]{4} [0-9]{4}$')
    AND try_strptime(substr(trim(date_added), 5), '%b %d %H:%M:%S %z %Y') IS NOT NULL THEN CAST(right(trim(date_added), 4) AS INT) END AS year
  FROM (SELECT DISTINCT ON (review_id) * FROM goodreads_reviews_dedup))"""

_STATS = """
asked AS (SELECT DISTINCT work_id, cutoff_year FROM translation_labels),
hits AS (
  SELECT a.work_id, a.cutoff_year, rv.rating, rv.review_text FROM asked a JOIN work_of USING (work_id) JOIN rv ON rv.book_id = work_of.book_id AND rv.year < a.cutoff_year),
stats AS (
  SELECT a.work_id, a.cutoff_year, CAST(count(CASE WHEN rating BETWEEN 1 AND 5 THEN 1 END) AS BIGINT) AS pre_cutoff_ratings_count, round(avg(CASE WHEN rating BETWEEN 1 AND 5 THEN rating END), 4) AS pre_cutoff_avg_rating,
    CAST(count(CASE WHEN trim(review_text) <> '' THEN 1 END) AS BIGINT) AS pre_cutoff_reviews_with_text
  FROM asked a LEFT JOIN hits USING (work_id, cutoff_year) GROUP BY ALL)"""

_CHART = """
chart AS (SELECT r.book_id, b.isbn13 AS isbn, b.category, rv.rating AS rank, rv.year FROM rv JOIN (SELECT DISTINCT book_id, isbn13, language_code AS category FROM books WHERE isbn13 <> '') b USING (book_id) JOIN (SELECT DISTINCT book_id FROM rv) r USING (book_id)),
totals AS (
  SELECT isbn, count(*) AS appearances, min(year) AS first_year, min(rank) AS best_rank, list_sort(list(DISTINCT category)) AS categories
  FROM chart WHERE length(isbn) = 13 AND year IS NOT NULL AND rank IS NOT NULL GROUP BY isbn)"""

_COLUMN_LIST = "nkc_id, oclc, czech_isbn, czech_title, original_title, original_isbn, original_sysnum, author, secondary_authors, czech_pub_year, source_lang, genres"
_METADATA = """
meta AS (
  SELECT b.book_id, coalesce(title, '') AS gr_title, coalesce(CAST(nullif(pub_year, 0) AS VARCHAR), '') AS gr_pub_year, coalesce(j.j->>'$.ratings_count', '') AS gr_ratings_count, coalesce(j.j->>'$.average_rating', '') AS gr_average_rating,
    coalesce(j.j->>'$.text_reviews_count', '') AS gr_text_reviews_count, CAST(to_json(shelves) AS VARCHAR) AS gr_popular_shelves, language_code AS gr_language_code, CASE WHEN lower(j.j->>'$.is_ebook') = 'true' THEN 'true' ELSE 'false' END AS gr_is_ebook
  FROM last_ b JOIN j USING (line_no))"""
_MATCHED = f"""{_CASCADE}, {_JSON}, {_METADATA},
rows_ AS (SELECT DISTINCT {_COLUMN_LIST} FROM nkc_translations),
numbers AS (SELECT nkc_id, czech_pub_year, czech_title, source_lang, {_isbn13("n")} AS isbn FROM (SELECT *, unnest(list_filter(string_split(czech_isbn, '|'), lambda v: v <> '')) AS n FROM rows_)),
chart AS (SELECT isbn, {year("czech_pub_year")} AS y, length(czech_title) % 50 + 1 AS rank, coalesce(source_lang, '') AS category FROM numbers),
totals AS (SELECT isbn, count(*) AS appearances, min(y) AS first_year, min(rank) AS best_rank, list_distinct(list(category)) AS categories FROM chart WHERE length(isbn) = 13 AND y BETWEEN 2003 AND 2017 AND rank IS NOT NULL GROUP BY isbn),
sums AS (SELECT nkc_id, CAST(sum(appearances) AS BIGINT) AS appearances, min(first_year) AS first_year, CAST(min(best_rank) AS INT) AS best_rank, array_to_string(list_sort(list_distinct(flatten(list(categories)))), '|') AS categories FROM numbers JOIN totals USING (isbn) GROUP BY 1),
years_of AS (SELECT nkc_id, min(coalesce(f.first_czech_year, r.czech_year)) AS first_czech_year FROM records r LEFT JOIN first_ f USING (norm_author, norm_title) GROUP BY 1),
matched AS (
  SELECT t.*, y.first_czech_year, coalesce(m.layer, 'unmatched') AS match_layer, m.book_id AS matched_book_id, m.work_id AS gr_work_id, m.score AS fuzzy_score,
    {", ".join(f"coalesce(h.{c}, '') AS {c}" for c in ("gr_title", "gr_pub_year", "gr_ratings_count", "gr_average_rating", "gr_text_reviews_count", "gr_popular_shelves", "gr_language_code", "gr_is_ebook"))},
    coalesce(s.appearances, 0) AS chart_appearances, s.first_year AS chart_first_year, s.best_rank AS chart_best_rank, coalesce(s.categories, '') AS chart_categories, CASE WHEN coalesce(s.appearances, 0) >= 1 THEN 'true' ELSE 'false' END AS chart_bestseller
  FROM rows_ t LEFT JOIN years_of y USING (nkc_id) LEFT JOIN matches m USING (nkc_id) LEFT JOIN meta h ON h.book_id = m.book_id LEFT JOIN sums s USING (nkc_id))"""
_TRAINING = f"""{_MATCHED},
asked AS (
  SELECT *, coalesce(TRY_CAST(trim(czech_pub_year) AS DOUBLE), 0)::INT AS _year, coalesce(TRY_CAST(trim(gr_ratings_count) AS DOUBLE), 0) >= 10 AS rated, coalesce(first_czech_year, 0) BETWEEN 1 AND 2002 AS old,
    coalesce({norm_author("author")}, '') AS _author, coalesce({norm("original_title")}, '') AS _title FROM matched WHERE match_layer <> 'unmatched'),
grouped AS (SELECT *, CASE WHEN _author = '' OR _title = '' THEN '_solo' || matched_book_id ELSE _author || chr(9) || _title END AS k, _author = '' OR _title = '' AS solo FROM asked WHERE _year >= 2003)"""

_PARTS = """
years_ AS (SELECT e.work_id, min(coalesce(f.first_czech_year, r.czech_year)) AS first_cz_year FROM matches e JOIN records r USING (nkc_id) LEFT JOIN first_ f USING (norm_author, norm_title) WHERE e.work_id IS NOT NULL AND coalesce(f.first_czech_year, r.czech_year) IS NOT NULL GROUP BY 1),
parts AS (
  SELECT p.work_id, p.title, p.pub_year, y.first_cz_year, CASE WHEN y.first_cz_year IS NULL THEN 'negative' WHEN y.first_cz_year < 2008 THEN 'before' WHEN y.first_cz_year > 2017 THEN 'after' ELSE 'positive' END AS part
  FROM (SELECT DISTINCT * FROM candidate_pool) p LEFT JOIN years_ y USING (work_id)),
dist AS (SELECT first_cz_year AS y, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY first_cz_year) AS BIGINT) AS upto, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM parts WHERE part = 'positive' GROUP BY 1),
before_ AS (SELECT p.work_id, p.title, p.pub_year, p.part, p.first_cz_year, coalesce(max(d.upto), 0) AS b FROM parts p LEFT JOIN dist d ON d.y <= p.pub_year WHERE part IN ('positive', 'negative') GROUP BY ALL),
drawn AS (
  SELECT b.work_id, b.title, b.pub_year, CASE WHEN part = 'positive' THEN 1 ELSE 0 END AS translated_cz,
    CASE WHEN part = 'positive' THEN first_cz_year ELSE (SELECT min(d.y) FROM dist d WHERE d.y > b.pub_year AND d.upto - b.b > ('0x' || substr(md5(b.work_id || '|0'), 1, 8))::BIGINT / 4294967296.0 * (d.total - b.b)) END AS cutoff_year
  FROM before_ b)"""

_LANGS = ["eng", "ger", "fre", "spa", "ita", "swe"]
_FEATURES = f"""
one AS (SELECT * FROM pre_cutoff_stats QUALIFY row_number() OVER (PARTITION BY work_id, cutoff_year ORDER BY pre_cutoff_ratings_count DESC NULLS LAST, pre_cutoff_avg_rating DESC NULLS LAST, pre_cutoff_reviews_with_text DESC NULLS LAST) = 1),
ft AS (
  SELECT l.work_id, l.cutoff_year, l.translated_cz, CASE WHEN l.cutoff_year <= 2015 THEN 'train' WHEN l.cutoff_year = 2016 THEN 'val' WHEN l.cutoff_year = 2017 THEN 'test' END AS split,
    {", ".join(f"shelf_{k}" for k in SHELVES)}, CAST(coalesce(s.pre_cutoff_ratings_count, 0) AS INT) AS pre_cutoff_ratings_count, coalesce(s.pre_cutoff_avg_rating, 3.5) AS pre_cutoff_avg_rating,
    round(ln(1 + coalesce(s.pre_cutoff_ratings_count, 0)), 6) AS log_pre_cutoff_ratings_count, round(ln(1 + coalesce(s.pre_cutoff_reviews_with_text, 0)), 6) AS log_pre_cutoff_text_reviews,
    CASE WHEN coalesce(s.pre_cutoff_ratings_count, 0) >= 5 THEN 1 ELSE 0 END AS has_precutoff_signal, CAST(l.cutoff_year - l.pub_year AS INT) AS age_at_cutoff,
    {", ".join(f"CASE WHEN lower(coalesce(language, '')) = '{g}' THEN 1 ELSE 0 END AS lang_{g}" for g in _LANGS)}
  FROM (SELECT DISTINCT * FROM translation_labels) l LEFT JOIN one s USING (work_id, cutoff_year))"""
_FEATURE_NAMES = [*[f"shelf_{k}" for k in SHELVES], "pre_cutoff_ratings_count", "pre_cutoff_avg_rating", "log_pre_cutoff_ratings_count", "log_pre_cutoff_text_reviews", "has_precutoff_signal", "age_at_cutoff", *[f"lang_{g}" for g in _LANGS]]


def _long(select: str, names: list[str], value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"column\", {select.format(c=n)} AS {value} FROM ft" for n in names)


def _histogram(value: str, source: str, bins: int) -> str:
    return f"""
WITH v AS (SELECT {value} AS v FROM {source}), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v WHERE v IS NOT NULL)
SELECT CAST(CASE WHEN hi > lo THEN least({bins}, floor((v - lo) / ((hi - lo) / {bins}.0)) + 1) ELSE 1 END AS INT) AS bin, count(*) AS n FROM v, e WHERE v IS NOT NULL GROUP BY 1"""


def _at(k: int) -> str:
    return f"round(sum(CASE WHEN rk <= {k} THEN y END) / least({k}, count(*)), 6) AS precision_{k}, round(sum(CASE WHEN rk <= {k} THEN y END) / sum(y), 6) AS recall_{k}, round(sum(CASE WHEN rk <= {k} THEN y END) / least({k}, count(*)) * count(*) / sum(y), 6) AS lift_{k}"


SQL: dict[str, str] = {
    "catalogue_rows": f"WITH {_ROWS} SELECT line_no, {_COLUMNS} FROM kept",
    "catalogue_inventory": f"""
WITH {_ROWS},
t AS (SELECT count(*) AS total_records, CAST(coalesce(sum(CASE WHEN len(list_filter(coalesce(datafield, []), lambda f: f.tag = '041')) > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS records_with_041 FROM nkc_records),
s AS (SELECT count(*) AS translation_records, {", ".join(_share(n, x) for n, x in [("oclc", "oclc <> ''"), ("czech_title", "czech_title <> ''"), ("original_title", "original_title <> ''"), ("author", "author <> ''"), ("c260", "c260 <> ''"), ("c264", "c264 <> ''"), ("year", "czech_pub_year <> ''"), ("link", "has765"), ("original_isbn", "original_isbn <> ''"), ("original_sysnum", "original_sysnum <> ''"), ("genre", "has655"), ("isbn", "czech_isbn <> ''")])} FROM kept)
SELECT *, round(translation_records / greatest(total_records, 1), 4) AS filter_rate FROM t, s""",
    "source_language_top20": f"WITH {_ROWS} SELECT lang, count(*) AS n FROM (SELECT unnest(string_split(source_lang, '|')) AS lang FROM kept) WHERE lang <> '' GROUP BY lang ORDER BY n DESC, lang LIMIT 20",
    "publication_years": f"WITH {_ROWS} SELECT y AS year, count(*) AS n FROM kept WHERE y IS NOT NULL GROUP BY y",
    "subfield_values": f"SELECT line_no, array_to_string({_vals('655', 'a')}, '|') AS genres, CAST(len(list_filter(coalesce(datafield, []), lambda f: f.tag = '700')) AS INT) AS n_700, ({_vals('245', 'a')})[1] AS title FROM nkc_records",
    "book_index": f"WITH {_JSON} SELECT book_id, {norm(chr(116) + 'rim(regexp_replace(title, ' + chr(39) + r'\s*\([^)]*#[^)]*\)\s*$' + chr(39) + ', ' + chr(39) * 2 + '))')} AS norm_title, ratings, pub_year, language_code, coalesce(work_id, '') AS work_id FROM last_",
    "isbn_index": f"WITH {_JSON} SELECT regexp_replace(isbn13, '[^0-9]', '', 'g') AS isbn, max_by(book_id, line_no) AS book_id FROM books WHERE length(regexp_replace(isbn13, '[^0-9]', '', 'g')) = 13 GROUP BY 1",
    "work_books": f"WITH {_JSON} SELECT work_id, count(DISTINCT book_id) AS n_books, min(book_id) AS first_book, max(book_id) AS last_book FROM books WHERE work_id <> '' GROUP BY 1",
    "author_index": f"""
WITH {_JSON}, n AS (SELECT author_id, {norm("max(name)")} AS norm_author FROM goodreads_author_names WHERE name <> '' AND author_id <> '' GROUP BY 1)
SELECT DISTINCT book_id, norm_author FROM (SELECT book_id, unnest(author_ids) AS author_id FROM books) JOIN n USING (author_id) WHERE norm_author <> ''""",
    "pool_of_works": f"""
WITH {_JSON}, c AS (SELECT *, {group("language_code")} AS language, {_BUCKETS} FROM last_q),
w AS (SELECT work_id, CAST(sum(ratings) AS BIGINT) AS ratings_count, CAST(sum(text_reviews) AS BIGINT) AS text_reviews, count(*) AS n_editions, min(CASE WHEN pub_year BETWEEN 1950 AND 2017 THEN pub_year END) AS pub_year FROM c GROUP BY 1),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY ratings DESC, book_id) = 1)
SELECT w.work_id, b.book_id AS rep_book_id, b.title, b.language, w.pub_year, w.n_editions, w.ratings_count, w.text_reviews, {_SHARES} FROM w JOIN b USING (work_id)
WHERE w.ratings_count >= 50 AND w.pub_year IS NOT NULL AND b.language NOT IN ('cze', 'slo')""".replace("last_q", "(SELECT * FROM books WHERE work_id <> '' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY line_no DESC) = 1)"),
    "pool_of_rare_works": f"""
WITH {_JSON}, c AS (SELECT *, {group("language_code")} AS language, {_BUCKETS} FROM last_q),
w AS (SELECT work_id, CAST(sum(ratings) AS BIGINT) AS ratings_count, CAST(sum(text_reviews) AS BIGINT) AS text_reviews, count(*) AS n_editions, min(CASE WHEN pub_year BETWEEN 1950 AND 2017 THEN pub_year END) AS pub_year FROM c GROUP BY 1),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY ratings DESC, book_id) = 1)
SELECT w.work_id, b.book_id AS rep_book_id, b.title, b.language, w.pub_year, w.n_editions, w.ratings_count, w.text_reviews, {_SHARES} FROM w JOIN b USING (work_id)
WHERE w.ratings_count >= 5 AND w.pub_year IS NOT NULL AND b.language NOT IN ('cze', 'slo')""".replace("last_q", "(SELECT * FROM books WHERE work_id <> '' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY line_no DESC) = 1)"),
    "pool_counters": f"""
WITH {_JSON}, c AS (SELECT *, {group("language_code")} AS language, {_BUCKETS} FROM last_q),
w AS (SELECT work_id, CAST(sum(ratings) AS BIGINT) AS ratings_count, CAST(sum(text_reviews) AS BIGINT) AS text_reviews, count(*) AS n_editions, min(CASE WHEN pub_year BETWEEN 1950 AND 2017 THEN pub_year END) AS pub_year FROM c GROUP BY 1),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY ratings DESC, book_id) = 1)

SELECT count(*) AS works, count(*) FILTER (w.ratings_count < 50) AS dropped_ratings, count(*) FILTER (w.ratings_count >= 50 AND w.pub_year IS NULL) AS dropped_year,
  count(*) FILTER (w.ratings_count >= 50 AND w.pub_year IS NOT NULL AND b.language IN ('cze', 'slo')) AS dropped_language, count(*) FILTER (w.ratings_count >= 50 AND w.pub_year IS NOT NULL AND b.language NOT IN ('cze', 'slo')) AS kept FROM w JOIN b USING (work_id)""".replace("last_q", "(SELECT * FROM books WHERE work_id <> '' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY line_no DESC) = 1)"),
    "record_keys": f"WITH {_FACTS} SELECT * FROM (SELECT nkc_id, {norm_author('author')} AS norm_author, {norm('original_title')} AS norm_title, {year('czech_pub_year')} AS czech_year, {prefix('source_lang')} AS prefix FROM (SELECT DISTINCT nkc_id, coalesce(author, '') AS author, coalesce(original_title, '') AS original_title, coalesce(czech_pub_year, '') AS czech_pub_year, coalesce(source_lang, '') AS source_lang FROM nkc_translations))",
    "match_exact": f"WITH {_FACTS} SELECT * FROM exact",
    "match_cascade": f"WITH {_CASCADE} SELECT * FROM matches",
    "match_layers": f"WITH {_CASCADE} SELECT layer, count(*) AS n FROM matches GROUP BY 1",
    "match_funnel": f"""
WITH {_CASCADE}, m AS (SELECT layer AS measure, count(*) AS n FROM matches GROUP BY 1 UNION ALL SELECT 'matched', count(*) FROM matches WHERE layer <> 'unmatched' HAVING count(*) > 0 UNION ALL SELECT 'records', count(*) FROM matches)
SELECT measure, n, round(n / (SELECT count(*) FROM matches), 4) AS share FROM m""",
    "book_metadata": f"WITH {_JSON}, {_METADATA} SELECT * FROM meta",
    "matched_dataset": f"WITH {_MATCHED} SELECT * FROM matched",
    "training_dataset": f"""
WITH {_TRAINING}
SELECT * EXCLUDE (_year, rated, old, _author, _title, k, solo) FROM grouped WHERE NOT old AND rated QUALIFY row_number() OVER (PARTITION BY k ORDER BY chart_appearances DESC, _year, nkc_id, czech_title NULLS FIRST, czech_isbn NULLS FIRST) = 1""",
    "training_counters": f"""
WITH {_TRAINING}, g AS (SELECT k, bool_or(solo) AS solo, count(*) FILTER (old) AS o, count(*) FILTER (NOT old AND rated) AS n FROM grouped GROUP BY k)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS candidates, CAST(coalesce(sum(o), 0) AS BIGINT) AS dropped_first_year, count(*) FILTER (n > 1) AS groups_of_several, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS rows_collapsed, count(*) FILTER (solo AND n > 0) AS solo, count(*) FILTER (n > 0) AS works FROM g""",
    "matched_outside_pool": f"WITH {_CASCADE}, {_PARTS} SELECT * FROM years_ WHERE work_id NOT IN (SELECT work_id FROM candidate_pool)",
    "matched_metadata": f"WITH {_CASCADE} SELECT * EXCLUDE (author_id) FROM facts WHERE book_id IN (SELECT book_id FROM matches)",
    "unmatched_works": f"WITH {_CASCADE} SELECT DISTINCT work_id FROM candidate_pool WHERE work_id NOT IN (SELECT work_id FROM matches WHERE work_id IS NOT NULL)",
    "label_partition": f"WITH {_CASCADE}, {_PARTS} SELECT * FROM parts",
    "label_cutoffs": f"WITH {_CASCADE}, {_PARTS} SELECT * FROM drawn WHERE cutoff_year IS NOT NULL AND pub_year < cutoff_year",
    "cutoff_years": f"WITH {_CASCADE}, {_PARTS} SELECT y, n FROM dist",
    "chart_pages": """
WITH r AS (SELECT DISTINCT * FROM nkc_translations),
n AS (SELECT *, list_filter(string_split(czech_isbn, '|'), lambda v: v <> '') AS l FROM r),
u AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM n)
SELECT nkc_id, trim(coalesce(source_lang, '')) AS category, CAST(2 * i - 1 AS INT) AS rank, trim(l[i]) AS isbn, trim(coalesce(author, '')) AS author, trim(coalesce(original_title, '')) AS title, 'x' AS publisher FROM u""",
    "repaired_texts": "SELECT DISTINCT nkc_id, author AS repaired, author AS decoded FROM nkc_translations",
    "first_czech_year": f"WITH {_FACTS} SELECT * FROM first_",
    "chart_totals": f"WITH {_JSON}, {_REVIEWS}, {_CHART} SELECT isbn, appearances, first_year, best_rank, array_to_string(categories, '|') AS categories FROM totals",
    "chart_roll_up": f"""
WITH {_JSON}, {_REVIEWS}, {_CHART}, w AS (SELECT work_id, isbn13 AS isbn FROM books WHERE work_id <> '' AND isbn13 <> '')
SELECT work_id, CAST(coalesce(sum(appearances), 0) AS BIGINT) AS appearances, min(first_year) AS first_year, min(best_rank) AS best_rank, coalesce(array_to_string(list_sort(list_distinct(flatten(list(categories) FILTER (categories IS NOT NULL)))), '|'), '') AS categories,
  CASE WHEN coalesce(sum(appearances), 0) >= 1 THEN 'true' ELSE 'false' END AS bestseller FROM w LEFT JOIN totals USING (isbn) GROUP BY 1""",
    "training_rows": f"""
WITH {_CASCADE}, r AS (
  SELECT r.nkc_id, norm_author, norm_title, czech_year, CAST(f.ratings % 3 AS INT) AS appearances FROM records r JOIN matches e USING (nkc_id) JOIN facts f ON f.book_id = e.book_id LEFT JOIN first_ y USING (norm_author, norm_title)
  WHERE czech_year >= 2003 AND (coalesce(first_czech_year, 0) = 0 OR first_czech_year >= 2003) AND f.ratings >= 10)
SELECT norm_author, norm_title, nkc_id, czech_year, appearances, n_rows FROM (SELECT *, count(*) OVER (PARTITION BY norm_author, norm_title) AS n_rows FROM r)
QUALIFY row_number() OVER (PARTITION BY norm_author, norm_title ORDER BY appearances DESC, czech_year, nkc_id) = 1""",
    "review_stats": f"WITH {_REVIEWS}, {_STATS} SELECT * FROM stats",
    "stats_audit": f"""
WITH {_REVIEWS}, {_STATS}, g AS (SELECT work_id, cutoff_year, max(pre_cutoff_ratings_count) AS given FROM pre_cutoff_stats GROUP BY ALL)
SELECT CASE WHEN given IS NULL THEN 'missing' WHEN given > coalesce(pre_cutoff_ratings_count, 0) THEN 'high' WHEN given < pre_cutoff_ratings_count THEN 'low' ELSE 'equal' END AS verdict, count(*) AS n FROM g LEFT JOIN stats USING (work_id, cutoff_year) GROUP BY 1""",
    "feature_table": f"WITH {_FEATURES} SELECT * FROM ft",
    "feature_bloat": "WITH k AS (SELECT work_id, cutoff_year, count(*) AS n FROM (SELECT DISTINCT * FROM pre_cutoff_stats) GROUP BY ALL) SELECT count(*) AS keys, count(*) FILTER (n > 1) AS repeated, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS added FROM k",
    "feature_names": " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in _FEATURE_NAMES),
    "split_summary": f"WITH {_FEATURES} SELECT split, count(*) AS n, CAST(sum(translated_cz) AS BIGINT) AS positives, round(avg(translated_cz), 6) AS rate, min(cutoff_year) AS first_year, max(cutoff_year) AS last_year FROM ft GROUP BY split",
    "feature_means": f"WITH {_FEATURES} {_long('round(avg({c}), 6)', _FEATURE_NAMES, 'mean')}",
    "feature_correlations": f"WITH {_FEATURES}, long_ AS ({_long('CASE WHEN stddev_pop({c}) > 0 AND stddev_pop(translated_cz) > 0 THEN round(corr({c}, translated_cz), 6) END', _FEATURE_NAMES, 'correlation')}) SELECT * FROM long_ WHERE correlation IS NOT NULL",
    "ranking_metrics": f"""
WITH r AS (
  SELECT translated_cz AS y, ratings_count_2017 AS s, row_number() OVER (ORDER BY ratings_count_2017 DESC, work_id, cutoff_year) AS rk
  FROM (SELECT DISTINCT * FROM translation_labels) WHERE translated_cz IS NOT NULL AND ratings_count_2017 IS NOT NULL),
a AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM r GROUP BY s),
b AS (SELECT *, coalesce(sum(p) OVER w, 0) AS pb, coalesce(sum(q) OVER w, 0) AS qb FROM a WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT round(sum(q * (pb + p / 2)) / (sum(p) * sum(q)), 6) AS roc_auc, round(sum(CASE WHEN p > 0 THEN p * (pb + p) / (pb + p + qb + q) END) / sum(p), 6) AS pr_auc FROM b)
SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, any_value(c.roc_auc) AS roc_auc, any_value(c.pr_auc) AS pr_auc, {_at(50)}, {_at(100)}, {_at(250)} FROM r, c""",
    "popularity_baseline": f"""
WITH {_FEATURES}, r AS (
  SELECT translated_cz AS y, pre_cutoff_ratings_count AS s, row_number() OVER (ORDER BY pre_cutoff_ratings_count DESC, work_id, cutoff_year) AS rk
  FROM ft WHERE split = 'val' AND translated_cz IS NOT NULL AND pre_cutoff_ratings_count IS NOT NULL),
a AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM r GROUP BY s),
b AS (SELECT *, coalesce(sum(p) OVER w, 0) AS pb, coalesce(sum(q) OVER w, 0) AS qb FROM a WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT round(sum(q * (pb + p / 2)) / (sum(p) * sum(q)), 6) AS roc_auc, round(sum(CASE WHEN p > 0 THEN p * (pb + p) / (pb + p + qb + q) END) / sum(p), 6) AS pr_auc FROM b)
SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, any_value(c.roc_auc) AS roc_auc, any_value(c.pr_auc) AS pr_auc, {_at(50)}, {_at(100)}, {_at(250)} FROM r, c""",
    "language_counts": "SELECT coalesce(nullif(trim(lower(language)), ''), '<missing>') AS language, count(*) AS n FROM candidate_pool GROUP BY 1",
    "language_groups": f"SELECT {group('language_code')} AS language, count(*) AS n FROM goodreads_book_details GROUP BY 1",
    "rates_by_language": "SELECT coalesce(nullif(trim(lower(language)), ''), '<unk>') AS language, count(*) AS n, round(avg(translated_cz), 6) AS rate FROM (SELECT DISTINCT * FROM translation_labels) GROUP BY 1 HAVING count(*) >= 10",
    "distinct_works": "SELECT count(DISTINCT nullif(trim(work_id), '')) AS works, count(DISTINCT book_id) AS books FROM goodreads_book_details",
    "filled_shares": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(coalesce(avg(CASE WHEN trim({c}) <> '' THEN 1.0 ELSE 0.0 END), 0), 4) AS share FROM nkc_translations" for c in _COLUMNS.split(", ")),
    "ratings_histogram": _histogram("log10(greatest(ratings_count_2017, 1))", "candidate_pool WHERE ratings_count_2017 >= 0", 50),
    "year_histogram": _histogram("pub_year", "goodreads_book_details WHERE pub_year BETWEEN 1800 AND 2017", 40),
    "zero_signal": "SELECT count(*) AS n, round(avg(CASE WHEN coalesce(pre_cutoff_ratings_count, 0) = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, round(avg(pre_cutoff_ratings_count), 6) AS mean_count FROM (SELECT DISTINCT * FROM pre_cutoff_stats)",
    "isbn_forms": """
WITH r AS (SELECT DISTINCT nkc_id, isbn FROM (SELECT nkc_id, unnest(string_split(czech_isbn, '|')) AS isbn FROM nkc_translations) WHERE isbn <> ''),
s AS (SELECT *, upper(regexp_replace(isbn, '[\\s\\-]', '', 'g')) AS s FROM r),
b AS (SELECT *, CASE WHEN regexp_matches(s, '^[0-9]{9}[0-9X]$') THEN '978' || substr(s, 1, 9) END AS b FROM s)
SELECT nkc_id, isbn, CASE WHEN b IS NOT NULL THEN b || CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(b, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS INT)::VARCHAR
  WHEN regexp_matches(s, '^[0-9]{12}$') THEN '9' || s ELSE s END AS isbn13, CASE WHEN length(regexp_replace(isbn, '[^0-9]', '', 'g')) = 13 THEN regexp_replace(isbn, '[^0-9]', '', 'g') ELSE '' END AS digits FROM b""",
    "written_years": f"SELECT DISTINCT nkc_id, czech_pub_year, {year('czech_pub_year')} AS year FROM nkc_translations",
    "review_years": f"WITH {_REVIEWS.replace('(SELECT DISTINCT ON (review_id) * FROM goodreads_reviews_dedup)', 'goodreads_reviews_dedup')} SELECT year, count(*) AS n, count(DISTINCT review_id) AS reviews FROM rv GROUP BY 1",
    "clean_titles": f"SELECT DISTINCT nkc_id, {_clean('original_title')} AS cleaned, trim(regexp_replace(original_title, '\\s*\\([^)]*#[^)]*\\)\\s*$', '')) AS plain FROM nkc_translations",
    "author_names": f"SELECT DISTINCT author_id, {norm('name')} AS norm, {norm_author('name')} AS turned FROM goodreads_author_names",
    "language_targets": f"SELECT DISTINCT source_lang, {prefix('source_lang')} AS prefix, coalesce({prefix('source_lang')} <> '' AND starts_with('en-gb', {prefix('source_lang')}), false) AS english FROM nkc_translations",
    "shelves_as_json": f"WITH {_JSON} SELECT line_no, CAST(len(shelves) AS INT) AS n_shelves, CAST(coalesce(list_sum(list_transform(shelves, lambda s: s.count)), 0) AS BIGINT) AS total FROM books",
    "pool_of_parts": """
WITH w AS (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n, CAST(min(CASE WHEN year(l_shipdate) BETWEEN 1996 AND 2000 THEN year(l_shipdate) END) AS INT) AS first_year FROM lineitem GROUP BY 1),
b AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_returnflag) = 1)
SELECT w.l_partkey, quantity, n, first_year, l_orderkey AS order_key, l_returnflag AS flag FROM w JOIN b USING (l_partkey) WHERE quantity >= 50""",
    "orders_before": """
WITH o AS (SELECT o_custkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day, o_orderkey FROM orders)
SELECT o.o_custkey, o.day, o.o_orderkey, (SELECT nullif(count(*), 0) FROM o p WHERE p.o_custkey = o.o_custkey AND p.day < o.day) AS orders_before FROM o""",
    "events_json": "SELECT event_type, count(*) AS n, CAST(sum(TRY_CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1",
    "streamed_counts": f"WITH {_REVIEWS} SELECT book_id, year, count(*) AS n, CAST(sum(rating) AS BIGINT) AS s FROM rv WHERE rating BETWEEN 1 AND 5 AND year IS NOT NULL GROUP BY ALL",
}
