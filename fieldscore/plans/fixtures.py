"""Input tables for the registered queries, derived from the given tables by SQL that Spark and DuckDB both run.

Values inside JSON are strings and integers only; choices are made by ``key % n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def _record(name: str = "p_name", brand: str = "p_brand", size: str = "CAST(p_size AS STRING)", kind: str = "p_type", note: str = "''", extra: str = "") -> str:
    return f"""concat('{{"Name":"', {name}, '","Brand":"', {brand}, '","Dims":{{"Size":"', {size}, '","Type":"', {kind}, '"}},"Note":"', {note}, '"{extra}}}')"""


_NO_BRAND = """concat('{"Name":"', p_name, '","Dims":{"Size":"', CAST(p_size AS STRING), '","Type":"', p_type, '"},"Note":""}')"""

_F1 = f"""SELECT p_partkey AS doc_id, {_record()} AS gt,
    CASE p_partkey % 10 WHEN 0 THEN {_NO_BRAND} WHEN 1 THEN substr({_record()}, 1, 30)
      WHEN 2 THEN concat('```json', chr(10), {_record()}, chr(10), '```') WHEN 3 THEN {_record(name="replace(p_name, 'i', 'l')")}
      WHEN 4 THEN {_record(extra=',"Extra":"x"')} WHEN 5 THEN {_record(brand="''")} WHEN 6 THEN 'no text can be read'
      WHEN 7 THEN {_record(note="'by hand'")} WHEN 8 THEN {_record(kind="'STANDARD'")} ELSE {_record()} END AS pred
  FROM part"""


def _stairs(up: str, zone: str = "p_brand", gap: str = "") -> str:
    """A record with objects five levels deep, lists and a grid."""
    return f"""concat('{{{gap}"Zone":{gap}"', {zone}, '","Runs":{{"Up":', {up}, ',{gap}"Down":{{"Deep":{{"At":{{"Last":{{"Leaf":"', p_type, '"}}}}}}}}}},"Area":{{"north":{{"w":', CAST(p_size AS STRING), ',"note":" ',
        p_name, '"}},"south":{{"note":"a|b",{gap}"w":', CAST(p_size + 1 AS STRING), '}}}},"Marks":[{gap}', CAST(p_size AS STRING), ',true],"Also":{{}},"Free":null}}')"""


_UP = """concat('["', p_name, '","', p_brand, '"]')"""
_STAIRS = f"""SELECT p_partkey AS doc_id, {_stairs(_UP)} AS gt,
    CASE p_partkey % 6 WHEN 0 THEN {_stairs(_UP, gap="' || chr(10) || '  ")} WHEN 1 THEN {_stairs("""concat('["', p_brand, '","', replace(p_name, 'e', 'c'), '"]')""")}
      WHEN 2 THEN 'no text can be read' WHEN 3 THEN {_stairs("""concat('"', p_name, '"')""")} WHEN 4 THEN {_stairs("""concat('["', p_name, '"]')""", zone="''")}
      ELSE {_stairs("'[]'", zone="substr(p_brand, 1, 5)")} END AS pred
  FROM part"""

FIXTURES: dict[str, str] = {
    # record pairs
    "f1": _F1,
    # record pairs with deep objects, lists and grids
    "stairs": _STAIRS,
    # prediction lines under five sets of key names
    "f1b": f"""SELECT doc_id, CASE doc_id % 5
        WHEN 0 THEN concat('{{"image_name":"', CAST(doc_id AS STRING), '","predicted_json":', CASE WHEN doc_id % 10 = 0 THEN gt ELSE '{{}}' END, ',"predicted_text":"free text","target_json":', gt, '}}')
        WHEN 1 THEN concat('{{"image_name":"', CAST(doc_id AS STRING), '","prediction_raw":" some words ","ground_truth":"', 'plain words', '"}}')
        WHEN 2 THEN concat('{{"file_name":"', CAST(doc_id AS STRING), '","prediction_string":"', replace(gt, '"', concat(chr(92), '"')), '","prediction_json":null,"ground_truth_json_string":"', replace(gt, '"', concat(chr(92), '"')), '"}}')
        WHEN 3 THEN concat('{{"image_name":"', CAST(doc_id AS STRING), '","predicted_json":', gt, ',"ground_truth":', gt, ',"raw_response":""}}')
        ELSE concat('{{"image_name":"', CAST(doc_id AS STRING), '","prediction":"', '{{}}', '","ground_truth":"   ","sample_index":', CAST(doc_id AS STRING), '}}') END AS raw
      FROM ({_F1}) AS f""",
    # wrapped model output
    "f3": f"""SELECT doc_id, gt, CASE doc_id % 8
        WHEN 0 THEN concat('User: OCR: Assistant: ', gt) WHEN 1 THEN concat('Here it is: ', gt, ' That is all.')
        WHEN 2 THEN concat('```json', chr(10), gt, chr(10), '```', chr(10), 'done') WHEN 3 THEN concat('{{"note":"first"}} and then ', gt)
        WHEN 4 THEN concat(gt, ' {{ left open') WHEN 5 THEN 'nothing here' WHEN 6 THEN concat('assistant: OCR:  ', replace(gt, '"', concat(chr(92), '"')))
        ELSE concat('{{"outer":', gt, '}}') END AS response
      FROM ({_F1}) AS f""",
    # cards of labels and values
    "cards": """SELECT p_partkey AS doc_id, concat(
        'Gegenstand: ', p_name, chr(10),
        CASE p_partkey % 3 WHEN 0 THEN 'Inv. Nr.: J=ab' WHEN 1 THEN 'Inv Nr: Kq.' ELSE 'Inv.Nr: Zz/' END, CAST(p_partkey AS STRING), chr(10),
        'Material: ', lower(p_type), CASE WHEN p_partkey % 2 = 0 THEN ' , gold' ELSE ',silber' END, chr(10), 'und ', lower(p_brand), chr(10),
        CASE WHEN p_partkey % 4 = 0 THEN concat('Preis: ', CAST(p_size AS STRING), ' DM', chr(10), 'Wert unklar') ELSE 'Herkunft: Fundus Gewicht: 12 g' END, chr(10),
        CASE WHEN p_partkey % 5 = 0 THEN concat('Beschreibung: ', p_name, chr(10), p_name, chr(10), 'glatt') ELSE 'Literatur: keine' END) AS text
      FROM part""",
    # inventory sheets
    "sheets": """SELECT p_partkey AS doc_id, concat(
        p_name, chr(10), CASE p_partkey % 3 WHEN 0 THEN 'J=ab' WHEN 1 THEN 'Kq.' ELSE 'x' END, CAST(1000 + p_partkey % 9000 AS STRING), chr(10),
        CASE p_partkey % 4 WHEN 0 THEN 'L 4.3 B 2,1 D 0,7' WHEN 1 THEN '3,0 x 2,0 x 1,0' WHEN 2 THEN 'L 5,5' ELSE 'B 7 cm' END, chr(10),
        CASE WHEN p_partkey % 2 = 0 THEN 'Fundort: Halde Fundzeit: 1890' ELSE concat('Fundort - ', p_brand) END, chr(10),
        lower(p_type), ' schei-', chr(10), 'be klein', chr(10), '%%', chr(10), p_brand, chr(10),
        'eine lange Beschreibung mit vielen Worten steht hier auf einer einzigen Zeile, die kein Ende hat.', chr(10), 'Rest ', p_name) AS text
      FROM part""",
    # plain lines of documents
    "texts": "SELECT doc_id, text, lang, source FROM documents",
    # boxes: words of documents at computed places
    "words": """SELECT doc_id, i, word, (i // 8) * 20 + (i * 7919) % 5 AS y, (i % 8) * 50 AS x, 12 + i % 3 AS h,
        CASE WHEN i % 17 = 0 THEN NULL ELSE (i * 31) % 100 END AS conf FROM {words}""",
    # short texts and what readers made of them, some with letters beyond ASCII
    "readings": """SELECT p_partkey AS doc_id, p_brand AS brand, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS ref,
        CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'i', 'ü') WHEN 2 THEN reverse(p_name) WHEN 3 THEN concat(substr(p_name, 3), p_brand) WHEN 4 THEN '' ELSE p_type END AS hyp FROM part""",
    # histories and trials
    "epochs": "SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value, ts FROM events",
    "trials": """SELECT o_custkey % 20 AS study, o_orderkey AS trial, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETE' WHEN o_orderstatus = 'P' THEN 'PRUNED' ELSE 'FAIL' END AS state,
        CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders""",
    # names and files
    "names": """SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 1 THEN upper(concat(replace(c_name, '#', ''), '.jpg')) WHEN 3 THEN concat('card (', CAST(c_custkey AS STRING), ').jpg')
        WHEN 5 THEN concat('omer', substr(c_name, 10)) ELSE concat(replace(c_name, '#', ''), '.jpg') END AS name FROM customer""",
    "files": """SELECT concat('/scans/', CASE c_custkey % 6 WHEN 2 THEN concat(replace(c_name, '#', ''), '.png') WHEN 3 THEN concat('IMG (', CAST(c_custkey AS STRING), ').JPG')
        WHEN 4 THEN concat('other', CAST(c_custkey AS STRING), '.jpg') WHEN 5 THEN concat('customer', substr(c_name, 10), '.tif') ELSE concat(replace(c_name, '#', ''), '.jpg') END) AS path, c_custkey FROM customer""",
    # requests
    "requests": "SELECT event_id, event_type AS model, props AS content, value AS latency, ts FROM events",
    # log lines of runs, in the order of their files
    "logs": """SELECT run, dataset, CAST(epoch * 3 + k AS INT) AS line_no, CASE k
          WHEN 0 THEN concat('Inventory CER Callback: COMPUTING CER ON VALIDATION SUBSET (Epoch ', CAST(epoch AS STRING), ')')
          WHEN 1 THEN CASE WHEN epoch % 7 = 0 THEN '   Validating 1/30: a.jpg' WHEN epoch % 7 = 1 THEN concat('   NEW BEST CER: 0.', m, ' (improved by inf)') ELSE concat('{', chr(39), 'loss', chr(39), ': 0.', m, ', ', chr(39), 'grad_norm', chr(39), ': 1.5, ', chr(39), 'epoch', chr(39), ': ', CAST(epoch AS STRING), '.0}') END
          ELSE concat('   Validation CER (Epoch ', CAST(epoch AS STRING), '): 0.', m, ' (9.99%)') END AS line
        FROM (SELECT run, dataset, epoch, m, unnest_k AS k FROM (SELECT user_id AS run, concat('set', CAST(user_id % 3 AS STRING)) AS dataset, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
            CAST(1000 + CAST(round(value * 100) AS BIGINT) % 9000 AS STRING) AS m FROM events) AS e CROSS JOIN (SELECT 0 AS unnest_k UNION ALL SELECT 1 UNION ALL SELECT 2) AS three) AS f""",
}

#: Letters that the texts have beside ASCII, mapped so that both engines count them as one character each.
LETTERS_FROM, LETTERS_TO = "äöüßéèêàâçñíóúáîôûëïùœ", "aouseeeaacniouaioueiuo"

#: Characters of a piece; they bound the edit distances.
PIECE = 200


def pairs_sql(duck: bool) -> str:
    """Text pairs of the whole text of a document: consecutive pieces numbered from 0, each with what a reader made of it."""
    g, explode = (", 'g'", "unnest(range(0, greatest(1, (length(s) + {n} - 1) // {n})))") if duck else ("", "explode(sequence(0, greatest(1, (length(s) + {n} - 1) DIV {n}) - 1))")
    return f"""SELECT doc_id, lang, source, pos, ref, CASE doc_id % 5 WHEN 0 THEN ref WHEN 1 THEN replace(ref, 'e', 'c') WHEN 2 THEN concat(ref, ' and more') WHEN 3 THEN '' ELSE concat(substr(ref, 1, 10), substr(ref, 15)) END AS hyp
        FROM (SELECT doc_id, lang, source, pos, substr(s, CAST(pos * {PIECE} + 1 AS INT), {PIECE}) AS ref
          FROM (SELECT doc_id, lang, source, s, {explode.format(n=PIECE)} AS pos
            FROM (SELECT doc_id, lang, source, regexp_replace(translate(lower(coalesce(text, '')), '{LETTERS_FROM}', '{LETTERS_TO}'), '[^a-z0-9 ]', ''{g}) AS s FROM documents) AS a) AS b) AS d"""


#: Characters of a piece that is compared in two forms.
FORM_PIECE = 150


def forms_sql(duck: bool) -> str:
    """Consecutive pieces of the printable ASCII characters of whole documents, numbered from 0."""
    g, explode = (", 'g'", "unnest(range(0, greatest(1, (length(s) + {n} - 1) // {n})))") if duck else ("", "explode(sequence(0, greatest(1, (length(s) + {n} - 1) DIV {n}) - 1))")
    return f"""SELECT doc_id, pos, substr(s, CAST(pos * {FORM_PIECE} + 1 AS INT), {FORM_PIECE}) AS ref
        FROM (SELECT doc_id, s, {explode.format(n=FORM_PIECE)} AS pos FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', ''{g}) AS s FROM documents) AS a) AS b"""


def words_sql(duck: bool) -> str:
    """Words of the whole text of a document, numbered from 0, at the places of boxes."""
    if duck:
        source = "(SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM (SELECT doc_id, string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS w FROM documents)) AS q"
        return FIXTURES["words"].format(words=source)
    source = "(SELECT doc_id, i, word FROM documents LATERAL VIEW posexplode(split(regexp_replace(lower(text), '[^a-z0-9]+', ' '), ' ')) w AS i, word) AS q"
    return FIXTURES["words"].format(words=source).replace("i // 8", "i DIV 8")


def tables(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str, spread: tuple[str, str] | None = None) -> DataFrame:
    """A derived table in Spark; ``spread`` names a table and its key whose rows are dealt to tasks before anything is made of them."""
    tables(spark, sf_dir)
    if spread:
        spark.table(spread[0]).repartition(4 * spark.sparkContext.defaultParallelism, spread[1]).createOrReplaceTempView(spread[0])
    special = {"pairs": pairs_sql, "words": words_sql, "forms": forms_sql}
    return spark.sql(special[name](False) if name in special else FIXTURES[name])


def duck(name: str) -> str:
    """The same table as DuckDB SQL, in brackets."""
    special = {"pairs": pairs_sql, "words": words_sql, "forms": forms_sql}
    return f"({special[name](True) if name in special else FIXTURES[name]})"
