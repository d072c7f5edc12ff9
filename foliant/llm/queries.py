"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import leak, level, linkage, lookalike, mix, names, survivor
from foliant.session import durable, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "nkc_translations"), table(spark, d, "goodreads_author_names"))


def p2_linked(spark: SparkSession, d: str) -> DataFrame:
    """Each linked record with its work, confidence and agreement levels."""
    return linkage.link(table(spark, d, "nkc_translations"), table(spark, d, "goodreads_book_details"), table(spark, d, "goodreads_author_names"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_linked(spark, d).select("nkc_id", "work_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(table(spark, d, "nkc_translations"), "nkc_id", ["original_title", "czech_title", "author"])


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    names = ["original_title", "czech_title", "author"]
    return lookalike.unify(table(spark, d, "nkc_translations").select("nkc_id", *names), names)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.found(table(spark, d, "goodreads_book_details"))


def p5_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivor.golden(table(spark, d, "goodreads_book_details"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Of each target whether the mix keeps to it: its tokens within a document and a block of its share (among sources that have texts), no document more often than allowed."""
    mixed = durable(p8_mix(spark, d))
    held = table(spark, d, "documents").where("text <> ''").select(mix.source_key(F.col("source")).alias("source")).distinct().withColumn("held", F.lit(True))
    rows = mix.shares(mixed, table(spark, d, "mix_targets")).join(held, "source", "left")
    total = rows.agg(F.sum("tokens").alias("total"), F.sum(F.when(F.col("held"), F.col("target_share"))).alias("reached"))
    both = rows.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(mixed.agg(F.max("n_tokens").alias("longest"))))  # one row each
    off = F.abs(F.col("tokens") - F.col("target_share") / F.col("reached") * F.col("total"))
    near = F.when(F.col("held"), off <= F.col("longest") + 256).otherwise(F.col("tokens") == 0)
    return both.select("source", "target_share", near.alias("near"), (F.col("most_copies") <= F.col("max_repeats")).alias("allowed"))


def p8_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The apportionment alone, with sizes in words."""
    return mix.allocation(table(spark, d, "documents"), table(spark, d, "mix_targets"), size=lambda text: F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return level.found(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_linked, p3_found, p3_consistent, p5_found, p5_golden, p7_found, p8_mix, p8_shares, p8_kept, p8_blocks, p9_found)}

_FOREIGN = r"\p{Cyrillic}\p{Greek}"
_ODD = [
    # invisible characters and controls, spaces other than U+0020
    r"[\x{00}-\x{1F}\x{7F}-\x{A0}\x{AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{1680}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]",
    # compatibility forms
    r"[\x{AA}\x{B2}\x{B3}\x{B9}\x{BA}\x{BC}-\x{BE}\x{0132}\x{0133}\x{0149}\x{01C4}-\x{01CC}\x{01F1}-\x{01F3}\x{2026}\x{2070}-\x{209C}\x{2100}-\x{214D}\x{2150}-\x{217F}\x{2460}-\x{24FF}\x{FB00}-\x{FB06}\x{FF01}-\x{FF9F}\x{1D400}-\x{1D7FF}]",
    # a word of two scripts
    rf"\p{{Latin}}[\p{{L}}\p{{M}}]*[{_FOREIGN}]", rf"[{_FOREIGN}][\p{{L}}\p{{M}}]*\p{{Latin}}", r"\p{Cyrillic}[\p{L}\p{M}]*\p{Greek}", r"\p{Greek}[\p{L}\p{M}]*\p{Cyrillic}",
]
_LONE_LETTERS = "".join(c for row in lookalike.LOOKALIKES for c in row[1:] if c != "." and row[0] != ".")


def _odd(c: str) -> str:
    """SQL of whether a value holds a character that is not the ordinary one; without the lattice, by the scripts alone."""
    tests = [f"regexp_matches({c}, '{x}')" for x in _ODD]
    # a single foreign letter among Latin words only
    lone = f"regexp_matches({c}, '(^|[^\\p{{L}}\\p{{M}}])[{_LONE_LETTERS}]([^\\p{{L}}\\p{{M}}]|$)') AND regexp_matches({c}, '\\p{{Latin}}[\\p{{L}}\\p{{M}}]*\\p{{L}}') AND NOT regexp_matches({c}, '[{_FOREIGN}][\\p{{L}}\\p{{M}}]*[{_FOREIGN}]')"
    return f"({' OR '.join(tests)} OR nfc_normalize({c}) <> {c} OR ({lone}))"


_UNESCAPED = "text"
for _name, _char in {"nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "#39": "''", "amp": "&"}.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '&{_name};', '{_char}')"

_NOW = """now AS (
  SELECT DISTINCT * FROM goodreads_book_details QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY loaded_at DESC, work_id DESC NULLS LAST) = 1)"""

ORACLE = {
    "p3_found": "SELECT DISTINCT nkc_id, field FROM (" + " UNION ALL ".join(f"SELECT nkc_id, '{c}' AS field, {c} AS v FROM nkc_translations" for c in ("original_title", "czech_title", "author")) + f") WHERE {_odd('v')}",
    "p9_found": f"""
WITH d AS (SELECT doc_id, text, regexp_replace({_UNESCAPED}, '</?[a-zA-Z][^<>]*>', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
cnt AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) AS w FROM d) GROUP BY ALL),
v AS (SELECT doc_id, {", ".join(f"avg((band = {b})::INT) AS v{b}" for b in level.LEVELS)} FROM reading_labels WHERE band BETWEEN 1 AND 4 AND doc_id IS NOT NULL GROUP BY 1),
voc AS (SELECT w, {", ".join(f"sum(n * v{b}) + 0.5::DOUBLE AS c{b}" for b in level.LEVELS)} FROM cnt JOIN v USING (doc_id) GROUP BY w HAVING count(*) >= 3),
total AS (SELECT {", ".join(f"sum(c{b}) AS t{b}" for b in level.LEVELS)} FROM voc),
sc AS (SELECT doc_id, {", ".join(f"sum(n * ln(c{b} / t{b})) AS s{b}" for b in level.LEVELS)} FROM cnt JOIN voc USING (w), total GROUP BY 1)
SELECT DISTINCT d.doc_id, CASE WHEN NOT regexp_matches(t, '\\p{{L}}') THEN 3 WHEN s1 IS NULL OR s1 >= greatest(s2, s3, s4) THEN 1 WHEN s2 >= greatest(s3, s4) THEN 2 WHEN s3 >= s4 THEN 3 ELSE 4 END AS band
FROM d LEFT JOIN sc USING (doc_id) WHERE len(list_filter(regexp_split_to_array(text, '[\\s\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '')) >= 40
""",
    "p8_kept": "SELECT source, target_share, true AS near, true AS allowed FROM mix_targets",
    "p8_blocks": """
WITH w AS (
  SELECT max_by(s, (n, s)) AS source, max(n) AS n FROM (
    SELECT doc_id, nullif(regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g'), '') AS s, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
  WHERE n > 0 AND s IN (SELECT source FROM mix_targets) GROUP BY doc_id),
t AS (SELECT w.source, sum(n) AS tokens, any_value(target_share) AS share, any_value(max_repeats) AS reps FROM w JOIN mix_targets m ON m.source = w.source WHERE target_share > 0 GROUP BY 1),
r AS (SELECT *, tokens * reps // 256 AS cap FROM t WHERE tokens * reps > 0),
seats AS (SELECT CAST(floor(min(tokens * reps * (SELECT sum(share) FROM r) / share) / 256) AS BIGINT) AS n FROM r),
q AS (SELECT source, share / (2 * k + 1) AS quotient, k FROM (SELECT source, share, unnest(range(CAST(cap AS BIGINT))) AS k FROM r)),
got AS (SELECT source, count(*) AS blocks FROM (SELECT * FROM q QUALIFY row_number() OVER (ORDER BY quotient DESC, source, k) <= (SELECT n FROM seats)) GROUP BY 1)
SELECT source, CAST(tokens AS BIGINT) AS tokens, coalesce(blocks, 0) AS blocks FROM r LEFT JOIN got USING (source)
""",
    "p5_found": f"""
WITH {_NOW},
e AS (
  SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY CASE WHEN ratings_count >= 0 THEN ratings_count ELSE -1 END DESC, book_id) AS rk,
    count(*) OVER (PARTITION BY work_id) AS n
  FROM now WHERE trim(work_id) <> ''),
c AS (
  SELECT work_id, 'record' AS field, book_id, rk FROM e WHERE n > 1
  UNION ALL SELECT work_id, 'language_code', book_id, rk FROM e WHERE n > 1 AND trim(language_code) NOT IN ('', 'und', '--', 'mul')
  UNION ALL SELECT work_id, 'pub_year', book_id, rk FROM e WHERE n > 1 AND pub_year BETWEEN 1800 AND 2017)
SELECT work_id, field, min_by(book_id, rk) AS book_id FROM c GROUP BY work_id, field
""",
    "p5_golden": f"""
WITH {_NOW},
e AS (
  SELECT work_id, book_id, norm_title, pub_year, lower(regexp_extract(trim(language_code), '^([A-Za-z]+)', 1)) AS code,
    (ln(1 + CASE WHEN ratings_count >= 0 THEN ratings_count ELSE 0 END) + 0.1) * pow(0.5, (epoch_us((SELECT max(loaded_at) FROM goodreads_book_details)) - epoch_us(loaded_at)) / (365 * 86400e6)) AS w
  FROM now WHERE trim(work_id) <> ''),
v AS (
  SELECT work_id, 'title' AS f, trim(norm_title) AS value, sum(w) AS votes, min(book_id) AS record FROM e WHERE trim(norm_title) <> '' GROUP BY ALL
  UNION ALL SELECT work_id, 'language', code, sum(w), min(book_id) FROM e WHERE code <> '' AND code NOT IN ('und', 'mul') GROUP BY ALL
  UNION ALL SELECT work_id, 'year', CAST(pub_year AS VARCHAR), sum(w), min(book_id) FROM e WHERE pub_year BETWEEN 1800 AND 2017 GROUP BY ALL),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY work_id, f ORDER BY votes DESC, record) = 1)
SELECT g.work_id, g.n_records, {", ".join(f"max(CASE WHEN f = '{f}' THEN value END) AS {f}, max(CASE WHEN f = '{f}' THEN record END) AS {f}_record, max(CASE WHEN f = '{f}' THEN round(votes, 6) END) AS {f}_votes" for f in ("title", "language", "year"))}
FROM (SELECT work_id, count(*) AS n_records FROM e GROUP BY 1) g LEFT JOIN b USING (work_id) GROUP BY ALL
""",
}
