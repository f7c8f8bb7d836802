"""Registered queries: text scalars, lines, boxes, fields of cards and sheets, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, layout
from .fixtures import duck, fixture

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS text FROM documents")
def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "texts").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("text"))


_ASCII = "regexp_replace(text, '[^ -~\\n]', '', 'g')"


@query(f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(lower({_ASCII}), '-\\s*\\n\\s*', '', 'g'), '\\s+', '', 'g') AS s FROM documents)
    SELECT doc_id, md5(s) AS schema_form, md5(regexp_replace(s, '[^0-9a-z\\-]+', '', 'g')) AS content_form FROM a""")
def q_cer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_only = F.regexp_replace("text", "[^ -~\n]", "")
    return fixture(spark, sf_dir, "texts").select("doc_id", F.md5(T.schema_form(ascii_only)).alias("schema_form"), F.md5(T.content_form(ascii_only)).alias("content_form"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(s, '([0-9])\\.([0-9])', '\\1,\\2', 'g'), '([0-9])\\.([0-9])', '\\1,\\2', 'g') AS text FROM (SELECT c_custkey, concat('v. ', c_custkey, '.', c_nationkey, '.7.8 end.') AS s FROM customer)")
def q_decimal_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture(spark, sf_dir, "texts")
    text = F.concat(F.lit("v. "), F.col("c_custkey").cast("string"), F.lit("."), F.col("c_nationkey").cast("string"), F.lit(".7.8 end."))
    return spark.table("customer").select("c_custkey", T.decimal_comma(text).alias("text"))


@query("SELECT page_id, replace(lower(strip_accents(concat('Ördner', chr(92), url, 'É.JPG'))), chr(92), '/') AS key FROM pages")
def q_file_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture(spark, sf_dir, "texts")
    return spark.table("pages").select("page_id", T.file_key(F.concat(F.lit("Ördner\\"), "url", F.lit("É.JPG"))).alias("key"))


_LINES = """l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {t}),
    l1 AS (SELECT doc_id, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM l0),
    lines AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS line_no, line FROM l1 WHERE line <> '')"""
_ALNUM = "length(regexp_replace(line, '[^\\p{L}\\p{N}]', '', 'g'))"
_SYMBOLS = "length(regexp_replace(line, '[A-Za-zÄÖÜäöüß0-9\\s]', '', 'g')) / greatest(1, length(line))"
_NOISE = f"(({_ALNUM} = 0 AND length(line) <= 3) OR length(line) <= 1 OR ({_SYMBOLS} > 0.85 AND {_ALNUM} = 0))"
_PARAGRAPH = "(length(line) >= 75 OR (len(string_split(line, ' ')) >= 12 AND length(line) >= 55) OR (regexp_matches(line, '[.!?]') AND length(line) >= 60))"
_MEASURE = """(regexp_matches(line, '[£L]\\s*[0-9]') OR regexp_matches(line, '\\bB\\s*[0-9]') OR regexp_matches(line, '\\b(D|T)\\s*[0-9]')
    OR regexp_matches(line, '[0-9]+(,[0-9]+)?\\s*[xX×]\\s*[0-9]+(,[0-9]+)?\\s*[xX×]\\s*[0-9]+(,[0-9]+)?') OR (contains(lower(line), 'cm') AND regexp_matches(line, '[0-9]'))
    OR len(regexp_extract_all(line, '[0-9]+,[0-9]+')) >= 2)"""


@query(f"WITH {_LINES.format(t='documents')} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {_NOISE}) AS noise, count(*) FILTER (WHERE {_PARAGRAPH}) AS paragraphs, count(*) FILTER (WHERE length(line) >= 40) AS long FROM lines GROUP BY doc_id")
def q_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.line_classes(layout.text_lines(fixture(spark, sf_dir, "texts"), "doc_id", "text"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("noise").alias("noise"), F.count_if("paragraph").alias("paragraphs"), F.count_if(F.length("line") >= 40).alias("long"))


@query(f"WITH {_LINES.format(t=duck('sheets'))} SELECT doc_id, line_no, line, {_NOISE} AS noise, {_MEASURE} AS measurement FROM lines")
def q_measurement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.line_classes(layout.text_lines(fixture(spark, sf_dir, "sheets"), "doc_id", "text"))
    return lines.select("doc_id", "line_no", "line", "noise", "measurement")


#: The sheets' lines after clean-up, written out from the recipe of the fixture.
_CLEAN = f"""raw AS (SELECT p_partkey AS doc_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS line_no, unnest([p_name,
        concat(CASE p_partkey % 3 WHEN 0 THEN 'J=ab' WHEN 1 THEN 'Kq.' ELSE 'x' END, 1000 + p_partkey % 9000),
        CASE p_partkey % 4 WHEN 0 THEN 'L 4,3 B 2,1 D 0,7' WHEN 1 THEN '3,0 x 2,0 x 1,0' WHEN 2 THEN 'L 5,5' ELSE 'B 7 cm' END,
        CASE WHEN p_partkey % 2 = 0 THEN 'Fundort: Halde Fundzeit: 1890' ELSE concat('Fundort - ', p_brand) END,
        concat(lower(p_type), ' scheibe klein'), p_brand, 'eine lange Beschreibung mit vielen Worten steht hier auf einer einzigen Zeile, die kein Ende hat.', concat('Rest ', p_name)]) AS line FROM part)"""


@query(f"WITH {_CLEAN} SELECT doc_id, line_no, line FROM raw")
def q_dehyphen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clean_sheet_lines(fixture(spark, sf_dir, "sheets"), "doc_id", "text")


@query("""SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN '4,3' WHEN 1 THEN '3,0' WHEN 2 THEN '5,5' ELSE '' END AS "L", CASE p_partkey % 4 WHEN 0 THEN '2,1' WHEN 1 THEN '2,0' WHEN 2 THEN '' ELSE '7cm' END AS "B",
    CASE p_partkey % 4 WHEN 0 THEN '0,7' WHEN 1 THEN '1,0' ELSE '' END AS "D", '2' AS used FROM part""")
def q_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.clean_sheet_lines(fixture(spark, sf_dir, "sheets"), "doc_id", "text")
    return layout.measures(lines, "doc_id").withColumn("used", F.array_join("used", ","))


@query("SELECT p_partkey AS doc_id, concat(CASE p_partkey % 3 WHEN 0 THEN 'J=ab' WHEN 1 THEN 'Kq.' ELSE 'x' END, 1000 + p_partkey % 9000) AS number, 1 AS line_no FROM part")
def q_inventory_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet, also those whose number is found by the fallback."""
    lines = layout.clean_sheet_lines(fixture(spark, sf_dir, "sheets"), "doc_id", "text")
    return layout.inventory_number(lines, "doc_id")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'Halde' ELSE p_brand END AS value, 3 AS line_no FROM part")
def q_marker_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.clean_sheet_lines(fixture(spark, sf_dir, "sheets"), "doc_id", "text")
    return layout.marker_value(lines, "doc_id", "Fundort", ["Fundzeit"])


@query("""SELECT p_partkey AS doc_id, p_name AS heading, concat(CASE p_partkey % 3 WHEN 0 THEN 'J=ab' WHEN 1 THEN 'Kq.' ELSE 'x' END, 1000 + p_partkey % 9000) AS number,
    CASE p_partkey % 4 WHEN 0 THEN '4,3' WHEN 1 THEN '3,0' WHEN 2 THEN '5,5' ELSE '' END AS size_l, CASE p_partkey % 4 WHEN 0 THEN '2,1' WHEN 1 THEN '2,0' WHEN 2 THEN '' ELSE '7cm' END AS size_b,
    CASE p_partkey % 4 WHEN 0 THEN '0,7' WHEN 1 THEN '1,0' ELSE '' END AS size_d, concat(lower(p_type), ' scheibe klein ', p_brand) AS object_name,
    CASE WHEN p_partkey % 2 = 0 THEN 'Halde' ELSE p_brand END AS place, CASE WHEN p_partkey % 2 = 0 THEN '1890' ELSE '' END AS time,
    concat('eine lange Beschreibung mit vielen Worten steht hier auf einer einzigen Zeile, die kein Ende hat. Rest ', p_name) AS description FROM part""")
def q_sheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet."""
    sheets = fixture(spark, sf_dir, "sheets")
    # one small file is one task
    sheets = sheets.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    return layout.sheet_records(sheets, "doc_id", "text")


_CARD = """WITH c AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'J=ab' WHEN 1 THEN 'Kq.' ELSE 'Zz/' END || p_partkey AS inv, lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN '{a}' ELSE '{b}' END || ' und ' || lower(p_brand) AS mat FROM part),
    f AS (SELECT p_partkey AS doc_id, 'Gegenstand' AS key, p_name AS value FROM c UNION ALL SELECT p_partkey, 'Inv.Nr', inv FROM c WHERE p_partkey % 3 > {n} UNION ALL SELECT p_partkey, 'Material', mat FROM c
      UNION ALL SELECT p_partkey, 'Preis', p_size || ' DM Wert unklar' FROM c WHERE p_partkey % 4 = 0"""


@query(_CARD.format(n=-1, a=", gold", b=", silber") + """ UNION ALL SELECT p_partkey, 'Vers.-Wert', p_size || ' DM' FROM c WHERE p_partkey % 4 = 0
      UNION ALL SELECT p_partkey, 'Herkunft', 'Fundus' FROM c WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, 'Gewicht', '12 g' FROM c WHERE p_partkey % 4 > 0
      UNION ALL SELECT p_partkey, 'Beschreibung', p_name || ' ' || p_name || ' glatt' FROM c WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'Literatur', 'keine' FROM c WHERE p_partkey % 5 > 0) SELECT * FROM f""")
def q_segment_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fields_by_span(fixture(spark, sf_dir, "cards"), "doc_id", "text")


@query(_CARD.format(n=0, a=" , gold", b=",silber") + """ UNION ALL SELECT p_partkey, 'Herkunft', 'Fundus Gewicht' FROM c WHERE p_partkey % 4 > 0
      UNION ALL SELECT p_partkey, 'Beschreibung', p_name || ' ' || p_name || ' glatt' FROM c WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'Literatur', 'keine' FROM c WHERE p_partkey % 5 > 0) SELECT * FROM f""")
def q_segment_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fields_by_line(layout.text_lines(fixture(spark, sf_dir, "cards"), "doc_id", "text"), "doc_id")


@query("""WITH c AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'J=ab' WHEN 1 THEN 'Kq.' ELSE 'Zz/' END || p_partkey AS inv FROM part)
    SELECT p_partkey AS doc_id, 'Inv.Nr' AS key, inv AS value FROM c UNION ALL SELECT p_partkey, 'Herkunft', 'Fundus Gewicht: 12 g' FROM c WHERE p_partkey % 4 > 0
    UNION ALL SELECT p_partkey, 'Beschreibung', p_name || ' glatt' FROM c WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'Literatur', 'keine' FROM c WHERE p_partkey % 5 > 0
    UNION ALL SELECT p_partkey, 'Gegenstand', p_name FROM c UNION ALL SELECT p_partkey, 'Material', lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' , gold' ELSE ',silber' END || ' und ' || lower(p_brand) FROM c
    UNION ALL SELECT p_partkey, 'Preis', p_size || ' DM Wert unklar' FROM c WHERE p_partkey % 4 = 0""")
def q_segment_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field that is found."""
    return layout.fields_by_header(layout.text_lines(fixture(spark, sf_dir, "cards"), "doc_id", "text"), "doc_id")


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(replace(text, 'Inv. Nr.', 'Inv.Nr'), 'Inv Nr:', 'Inv Nr:') AS text FROM {duck('cards')}),
    l AS (SELECT doc_id, text, string_split(text, chr(10))[2] AS line FROM t)
    SELECT doc_id, text, 'Inv.Nr' AS key FROM l""")
def q_label_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.clean_labels(F.col("text"))
    label = F.regexp_extract(text, r"\n(Inv[^:]*):", 1)
    return fixture(spark, sf_dir, "cards").select("doc_id", text.alias("text"), layout.canonical(label).alias("key"))


_BOXES = f"""b AS (SELECT doc_id, i AS det_id, word AS text, x, y, h FROM {duck('words')} WHERE conf IS NULL OR conf >= 30),
    g AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) > 0.7 * greatest(h, lag(h) OVER w) THEN 1 ELSE 0 END AS brk FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY y, x, det_id)),
    n AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY y, x, det_id) AS line_no FROM g),
    r AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, string_agg(text, ' ' ORDER BY x, y, det_id) AS line FROM n GROUP BY ALL)"""


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fixture(spark, sf_dir, "words")
    corner = lambda dx, dy: F.array(*[(F.col(a) + d).cast("double") for a, d in (("x", dx), ("y", dy))])
    box = F.array(corner(0, F.lit(0)), corner(40, F.lit(0)), corner(40, F.col("h")), corner(0, F.col("h")))
    return words.select("doc_id", F.col("i").alias("det_id"), box.alias("bbox"), F.col("word").alias("text"), F.col("conf").cast("double").alias("conf"))


@query(f"WITH {_BOXES} SELECT doc_id, line_no, line FROM r")
def q_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = layout.box_edges(layout.confident(_detections(spark, sf_dir), 30))
    return layout.reading_order(boxes, "doc_id")


@query(f"WITH {_BOXES} SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM r GROUP BY doc_id")
def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = layout.box_edges(layout.confident(_detections(spark, sf_dir), 30))
    return layout.page_text(layout.reading_order(boxes, "doc_id"), "doc_id")


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS det_id, word AS text, CAST(conf AS DOUBLE) AS conf, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(h AS DOUBLE) AS h FROM {duck('words')} WHERE i % 5 > 0")
def q_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fixture(spark, sf_dir, "words")
    n = lambda *c: F.array(*[x.cast("double") for x in c])
    # only the numbers travel, as arrays of four bytes each; a list leaves out nulls, so a missing confidence is the least number
    least = F.lit(-(1 << 31))
    numbers = [F.collect_list(F.coalesce(F.col(c).cast("int"), least)).alias(c) for c in ("i", "conf", "x", "y", "h")]
    packed = words.groupBy("doc_id").agg(*numbers, F.collect_list("word").alias("word"))
    boxes = packed.select("doc_id", F.array_sort(F.arrays_zip("i", "conf", "x", "y", "h", "word")).alias("b"))

    def polygon(e):
        x, y, h = e["x"], e["y"], e["h"]
        return F.when(e["i"] % 5 > 0, n(x, y, x + 40, y, x + 40, y + h, x, y + h)).otherwise(n(x, y))

    part = lambda make: F.transform("b", make)
    score = part(lambda e: F.when(e["conf"] > least, e["conf"].cast("double")))
    raw = boxes.select("doc_id", part(lambda e: e["word"]).alias("rec_texts"), score.alias("rec_scores"), part(polygon).alias("rec_polys"))
    return layout.box_edges(layout.detections(raw, "doc_id")).drop("bbox")


@query("SELECT n, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(n, '([0-9]+)', 1) AS BIGINT), n) AS INTEGER) AS place FROM (SELECT concat('img', s_suppkey % 50, '_', s_nationkey, '_', s_suppkey) AS n FROM supplier)")
def q_natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("img"), (F.col("s_suppkey") % 50).cast("string"), F.lit("_"), F.col("s_nationkey").cast("string"), F.lit("_"), F.col("s_suppkey").cast("string")).alias("n"))
    return layout.natural_order(names, "n")


@query("""WITH w AS (SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', '', 'g'), ' ') AS w FROM documents),
    t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w), f AS (SELECT doc_id, word, min(i) AS i FROM t GROUP BY ALL)
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS tokens FROM f GROUP BY doc_id""")
def q_distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9 ]", "")
    return fixture(spark, sf_dir, "texts").select("doc_id", F.array_join(F.array_distinct(F.split(folded, " ")), " ").alias("tokens"))


# -- files -----------------------------------------------------------------------------------------------------------

_FILES = f"n AS (SELECT * FROM {duck('names')}), f AS (SELECT path, string_split(path, '/')[-1] AS base FROM {duck('files')})"


@query(f"""WITH {_FILES}, e AS (SELECT doc_id, path, 1 AS rule FROM n JOIN f ON name = base UNION ALL SELECT doc_id, path, 2 FROM n JOIN f ON lower(name) = lower(base)
      UNION ALL SELECT doc_id, path, 3 FROM n JOIN f ON regexp_extract(lower(name), '(\\(\\s*[0-9]+\\s*\\)\\.(jpe?g|png|tiff?))$', 1) = regexp_extract(lower(base), '(\\(\\s*[0-9]+\\s*\\)\\.(jpe?g|png|tiff?))$', 1) AND name LIKE '%)%'),
    b AS (SELECT doc_id, min(rule) AS rule FROM e GROUP BY doc_id), k AS (SELECT e.doc_id, min(path) AS path, e.rule FROM e JOIN b ON e.doc_id = b.doc_id AND e.rule = b.rule GROUP BY ALL)
    SELECT doc_id, path, rule FROM k UNION ALL SELECT doc_id, min(path), 4 FROM n JOIN f ON contains(lower(path), lower(name)) WHERE doc_id NOT IN (SELECT doc_id FROM k) GROUP BY doc_id""")
def q_resolve_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.resolve_files(fixture(spark, sf_dir, "names"), fixture(spark, sf_dir, "files"), "doc_id", "name")


_STEM = f"""WITH {_FILES}, a AS (SELECT doc_id, lower(name) AS base, regexp_replace(lower(name), '\\.[^.]*$', '') AS stem FROM n),
    x AS (SELECT lower(base) AS base, min(path) AS p FROM f GROUP BY 1), y AS (SELECT regexp_replace(lower(base), '\\.[^.]*$', '') AS stem, min(path) AS q FROM f GROUP BY 1),
    s AS (SELECT doc_id, coalesce(p, q) AS path, CASE WHEN coalesce(p, q) IS NULL THEN 'not found' END AS reason FROM a LEFT JOIN x USING (base) LEFT JOIN y USING (stem))"""


@query(f"{_STEM} SELECT doc_id, path, reason FROM s")
def q_resolve_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.resolve_by_stem(fixture(spark, sf_dir, "names"), fixture(spark, sf_dir, "files"), "doc_id", "name")


@query(f"{_STEM} SELECT coalesce(reason, 'found') AS reason, count(*) AS n FROM s GROUP BY 1")
def q_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.resolve_by_stem(fixture(spark, sf_dir, "names"), fixture(spark, sf_dir, "files"), "doc_id", "name")
    return found.groupBy(F.coalesce("reason", F.lit("found")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH f AS (SELECT path, string_split(path, '/')[-1] AS base FROM {duck('files')}), n AS (SELECT c_custkey AS doc_id, replace(c_name, '#', '') AS stem FROM customer),
    t AS (SELECT doc_id, path, r FROM n, (VALUES (0, '.tif'), (1, '.jpg'), (2, '.png')) v(r, ext) JOIN f ON base = concat(stem, ext)) SELECT doc_id, arg_min(path, r) AS path FROM t GROUP BY doc_id""")
def q_resolve_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture(spark, sf_dir, "files")
    names = spark.table("customer").select(F.col("c_custkey").alias("doc_id"), F.replace("c_name", F.lit("#"), F.lit("")).alias("stem"))
    return align.resolve_by_extension(names, files, "doc_id", "stem", (".tif", ".jpg", ".png"))


@query("SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 4 <> 0")
def q_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = fixture(spark, sf_dir, "names").select("doc_id")
    return align.without_done(work, work.where("doc_id % 4 = 0"), "doc_id")
