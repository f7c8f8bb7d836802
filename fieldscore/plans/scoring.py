"""Registered queries: resolving, shaping and scoring records."""

from __future__ import annotations

from functools import partial
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions.distance import edit_ops, list_anls, string_anls
from ..functions.text import ascii_fold
from ..operators import align, metrics, resolve, shape
from ..registry import thresholds
from .fixtures import duck, fixture

PATHS = ("Name", "Brand", "Dims.Size", "Dims.Type", "Note", "Extra")
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, as sums come in another order each time."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows spread by keys before Python work, as one small file is one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _longs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f1 = _spread(fixture(spark, sf_dir, "f1"), "doc_id")
    documents = f1.select("doc_id", J.strict_object(F.col("pred")).isNotNull().alias("valid"))
    return shape.flatten_typed(f1, ["doc_id"], "gt", PATHS), shape.flatten_typed(f1, ["doc_id"], "pred", PATHS), documents


def _path(p: str, j: str) -> str:
    return f"json_extract_string({j}, '$." + ".".join(f'"{x}"' for x in p.split(".")) + "')"


_OBJ = "CASE WHEN json_type(TRY_CAST({x} AS JSON)) = 'OBJECT' THEN TRY_CAST({x} AS JSON) END"
_PARSED = f"p AS (SELECT doc_id, gt::JSON AS g, {_OBJ.format(x='pred')} AS q FROM {duck('f1')})"
_LONG = ", ".join(["gl AS (" + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS path, {_path(x, 'g')} AS value FROM p WHERE {_path(x, 'g')} IS NOT NULL" for x in PATHS) + ")",
                   "ql AS (" + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS path, {_path(x, 'q')} AS value FROM p WHERE {_path(x, 'q')} IS NOT NULL" for x in PATHS) + ")"])
_COUNTS = f"""WITH {_PARSED}, {_LONG},
    j AS (SELECT doc_id, path, g.value AS gt, q.value AS pred FROM (SELECT * FROM gl WHERE value <> '') g FULL JOIN (SELECT * FROM ql WHERE value <> '') q USING (doc_id, path)),
    v AS (SELECT j.*, p.q IS NOT NULL AS valid, CASE WHEN p.q IS NOT NULL AND gt IS NOT NULL AND pred IS NOT NULL THEN 1 - levenshtein(pred, gt) / length(gt)::DOUBLE END AS share FROM j JOIN p USING (doc_id)),
    c AS (SELECT *, coalesce(share >= threshold, false) AS hit FROM v, (VALUES (0.8::DOUBLE), (0.7::DOUBLE), (0.5::DOUBLE), (0.3::DOUBLE)) t(threshold) WHERE valid OR gt IS NOT NULL),
    n AS (SELECT path, threshold, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit AND valid AND pred IS NOT NULL) AS fp, count(*) FILTER (WHERE NOT hit AND gt IS NOT NULL) AS fn FROM c GROUP BY ALL)"""


@query(f"""{_COUNTS}, m AS (SELECT threshold, avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END) AS precision, avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) AS recall FROM n GROUP BY threshold)
    SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m""")
def q_map_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred, documents = _longs(spark, sf_dir)
    return rounded(metrics.overlap_scores(metrics.overlap_counts(gt, pred, documents, "doc_id")))


@query(f"{_COUNTS} SELECT path, threshold, tp, fp, fn FROM n")
def q_map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred, documents = _longs(spark, sf_dir)
    return metrics.overlap_counts(gt, pred, documents, "doc_id")


@query(f"WITH {_PARSED}, {_LONG} SELECT doc_id, path, value FROM ql")
def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.flatten(fixture(spark, sf_dir, "f1"), ["doc_id"], "pred")


@query(f"WITH {_PARSED}, {_LONG} SELECT doc_id, path, value FROM gl")
def q_paths_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(spark, sf_dir)[0]


_FIELDS = f"""WITH {_PARSED}, {_LONG}, f AS (SELECT doc_id, path, gl.value AS gt, coalesce(ql.value, '') AS pred FROM gl LEFT JOIN ql USING (doc_id, path)),
    s AS (SELECT doc_id, path, CASE WHEN gt = '' THEN length(pred) WHEN pred = '' THEN length(gt) ELSE levenshtein(pred, gt) END AS edits, length(gt) AS ref_len FROM f)"""


@query(f"{_FIELDS} SELECT path, count(*) AS fields, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_len) AS BIGINT) AS ref_len, round(avg(edits / greatest(1, ref_len)), 6) AS cer FROM s GROUP BY path")
def q_field_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred, _ = _longs(spark, sf_dir)
    fields = metrics.field_cer(gt, pred, "doc_id")
    return rounded(fields.groupBy("path").agg(F.count(F.lit(1)).alias("fields"), F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_len"), F.avg("cer").alias("cer")))


@query(f"""{_FIELDS}, d AS (SELECT doc_id, avg(edits / greatest(1, ref_len)) AS macro, sum(edits) / greatest(sum(ref_len), 1) AS micro, sum(edits) AS edits, sum(ref_len) AS ref_len FROM s GROUP BY doc_id)
    SELECT count(*) AS documents, round(avg(macro), 6) AS macro, round(avg(micro), 6) AS mean_micro, round(sum(edits) / sum(ref_len), 6) AS micro FROM d""")
def q_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred, _ = _longs(spark, sf_dir)
    return rounded(metrics.field_summary(metrics.field_cer(gt, pred, "doc_id"), "doc_id")[1])


@query(f"""SELECT count(*) FILTER (WHERE q IS NOT NULL) AS valid, count(*) AS total, round(count(*) FILTER (WHERE q IS NOT NULL) / count(*), 6) AS rate,
    concat(count(*) FILTER (WHERE q IS NOT NULL), '/', count(*), ' (', printf('%.1f', 100.0 * count(*) FILTER (WHERE q IS NOT NULL) / count(*)), '%)') AS text
    FROM (SELECT {_OBJ.format(x='pred')} AS q FROM {duck('f1')})""")
def q_json_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.validity(fixture(spark, sf_dir, "f1"), J.strict_object(F.col("pred")).isNotNull()))


_LEAVES = f"""WITH {_PARSED}, {_LONG}, j AS (SELECT doc_id, path, gl.value AS gt, ql.value AS pred FROM gl FULL JOIN ql USING (doc_id, path)),
    s AS (SELECT doc_id, path, CASE WHEN gt IS NULL OR pred IS NULL THEN 0.0 WHEN gt = '' AND pred = '' THEN 1.0 WHEN gt = '' OR pred = '' THEN 0.0
        WHEN 1 - levenshtein(pred, gt) / greatest(length(pred), length(gt))::DOUBLE >= 0.5 THEN 1 - levenshtein(pred, gt) / greatest(length(pred), length(gt))::DOUBLE ELSE 0.0 END AS score FROM j)"""


@query(f"""{_LEAVES}, n AS (SELECT doc_id, path, score FROM s UNION ALL SELECT doc_id, 'Dims', score FROM s WHERE path LIKE 'Dims.%' UNION ALL SELECT doc_id, '', score FROM s),
    d AS (SELECT doc_id, path, avg(score) AS score FROM n GROUP BY ALL) SELECT path, count(*) AS records, round(avg(score), 6) AS anls FROM d GROUP BY path""")
def q_anls_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred, _ = _longs(spark, sf_dir)
    nodes = metrics.anls_paths(metrics.anls_leaves(gt, pred, "doc_id"), "doc_id")
    return rounded(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("records"), F.avg("score").alias("anls")))


def _list_scores(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """All words of a document as lists of ``size``, matched against what a reader made of them."""
    pairs = fixture(spark, sf_dir, "pairs").select("doc_id", F.split("hyp", " ").alias("h"), F.split("ref", " ").alias("r"))
    last = F.floor((F.greatest(F.size("h"), F.size("r")) - 1) / size).cast("int")
    rows = pairs.select("doc_id", "h", "r", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    part = lambda c: F.slice(c, F.col("k") * size + 1, F.lit(size))
    scored = _spread(rows.select("doc_id", "k", part("h").alias("h"), part("r").alias("r")), "doc_id", "k").select("doc_id", list_anls(F.col("h"), F.reverse("r")).alias("score"))
    return rounded(scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lists"), F.avg("score").alias("score")))


@query()
def q_anls_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of six words, all of a document; too many orders for SQL, tested against permutations."""
    return _list_scores(spark, sf_dir, 6)


FOUR = range(1, 5)
#: The score of an item on each side; items that a list doesn't have score 0.
_ITEM = """CAST(CASE WHEN h[{i}] = r[{j}] THEN 1 WHEN h[{i}] = '' OR r[{j}] = '' THEN 0 WHEN 1 - levenshtein(h[{i}], r[{j}]) / greatest(length(h[{i}]), length(r[{j}]))::DOUBLE >= 0.5
    THEN 1 - levenshtein(h[{i}], r[{j}]) / greatest(length(h[{i}]), length(r[{j}]))::DOUBLE ELSE 0 END AS DOUBLE) AS s{i}{j}"""
_ITEMS = ", ".join(_ITEM.format(i=i, j=j) for i in FOUR for j in FOUR)
_ORDERS = ", ".join(" + ".join(f"s{i}{j}" for i, j in zip(FOUR, order, strict=True)) for order in permutations(FOUR))


@query(f"""WITH w AS (SELECT doc_id, string_split(hyp, ' ') AS h, string_split(ref, ' ') AS r FROM {duck('pairs')}),
    k AS (SELECT doc_id, h, r, unnest(range(0, (greatest(len(h), len(r)) - 1) // 4 + 1)) AS k FROM w),
    l AS (SELECT doc_id, h[k * 4 + 1 : k * 4 + 4] AS h, r[k * 4 + 1 : k * 4 + 4] AS r FROM k), s AS (SELECT doc_id, greatest(len(h), len(r)) AS n, {_ITEMS} FROM l)
    SELECT doc_id, count(*) AS lists, round(avg(greatest({_ORDERS}) / n), 6) AS score FROM s GROUP BY doc_id""")
def q_anls_lists_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of four words, all of a document; the SQL tries all 24 orders."""
    return _list_scores(spark, sf_dir, 4)


@query(f"""SELECT doc_id, pos, round(CASE WHEN hyp = '' AND ref = '' THEN 1.0 WHEN hyp = '' OR ref = '' THEN 0.0 WHEN 1 - levenshtein(hyp, ref) / greatest(length(hyp), length(ref))::DOUBLE >= 0.5
    THEN 1 - levenshtein(hyp, ref) / greatest(length(hyp), length(ref))::DOUBLE ELSE 0.0 END, 6) AS anls FROM {duck('pairs')}""")
def q_anls_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _spread(fixture(spark, sf_dir, "pairs").select("doc_id", "pos", "hyp", "ref"), "doc_id", "pos")
    return rounded(pairs.select("doc_id", F.col("pos").cast("long"), string_anls(F.col("hyp"), F.col("ref")).alias("anls")))


# -- text pairs ------------------------------------------------------------------------------------------------------

_EDITS = "CASE WHEN hyp = '' THEN length(ref) WHEN ref = '' THEN length(hyp) ELSE levenshtein(hyp, ref) END"
_SCORED = f"WITH s AS (SELECT *, {_EDITS} AS edits, length(ref) AS ref_len, {_EDITS} / greatest(1, length(ref)) AS cer FROM {duck('pairs')})"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pieces of one file are scored by all tasks
    return metrics.pair_scores(_spread(fixture(spark, sf_dir, "pairs"), "doc_id", "pos"))


_SCORED_ALL = f"""WITH e AS (SELECT *, {_EDITS} AS edits, length(ref) AS ref_len FROM {duck('pairs')}),
    s AS (SELECT doc_id, lang, source, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_len) AS BIGINT) AS ref_len, sum(edits) / greatest(1, sum(ref_len)) AS cer FROM e GROUP BY ALL)"""


def _scored_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: the edits of their pieces together."""
    pieces = metrics.pair_scores(_spread(fixture(spark, sf_dir, "pairs"), "doc_id", "pos")).groupBy("doc_id", "lang", "source").agg(F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_len"))
    return pieces.withColumn("cer", F.col("edits") / F.greatest(F.lit(1), "ref_len"))


@query(f"{_SCORED} SELECT doc_id, edits, ref_len, round(cer, 6) AS cer FROM s")
def q_cer(spark: SparkSession, sf_dir: str, scored=_scored) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("doc_id", "edits", "ref_len", "cer"))


@query(f"""{_SCORED} SELECT lang, count(*) AS n, round(avg(cer), 6) AS mean, round(median(cer), 6) AS median, round(min(cer), 6) AS min, round(max(cer), 6) AS max, round(stddev_pop(cer), 6) AS std,
    count(*) FILTER (WHERE cer = 0) AS perfect, count(*) FILTER (WHERE cer < 0.1) AS good FROM s GROUP BY lang""")
def q_cer_stats(spark: SparkSession, sf_dir: str, scored=_scored) -> DataFrame:
    return rounded(metrics.cer_statistics(scored(spark, sf_dir), ["lang"]))


@query(f"""{_SCORED} SELECT source, round(coalesce(avg(CASE WHEN ref_len > 0 THEN cer END), 1.0), 6) AS macro_cer, round(avg(CASE WHEN ref_len > 0 THEN cer WHEN edits = 0 THEN 0 ELSE 1 END), 6) AS macro_rated,
    round(sum(edits) / sum(ref_len), 6) AS micro_cer, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_len) AS BIGINT) AS ref_chars FROM s GROUP BY source""")
def q_macro_micro(spark: SparkSession, sf_dir: str, scored=_scored) -> DataFrame:
    return rounded(metrics.error_rates(scored(spark, sf_dir), ["source"]))


@query(f"{_SCORED} SELECT lang, round(sum(floor(cer * ref_len)) / sum(ref_len), 6) AS weighted_cer, round(sum(round_even(cer * ref_len, 0)) / sum(ref_len), 6) AS weighted_rounded FROM s GROUP BY lang")
def q_weighted(spark: SparkSession, sf_dir: str, scored=_scored) -> DataFrame:
    both = (metrics.weighted_rate().alias("weighted_cer"), metrics.weighted_rate("even").alias("weighted_rounded"))
    return rounded(scored(spark, sf_dir).groupBy("lang").agg(*both))


@query(f"{_SCORED} SELECT CASE WHEN cer = 0 THEN 'perfect' WHEN cer < 0.1 THEN 'good' WHEN cer < 0.3 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM s GROUP BY 1")
def q_bands(spark: SparkSession, sf_dir: str, scored=_scored) -> DataFrame:
    return scored(spark, sf_dir).groupBy(metrics.cer_band(F.col("cer")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_SCORED} SELECT CASE WHEN GROUPING(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n, round(avg(cer), 6) AS macro_cer, round(sum(edits) / sum(ref_len), 6) AS micro_cer FROM s GROUP BY ROLLUP (lang)""")
def q_rollup(spark: SparkSession, sf_dir: str, scored=_scored) -> DataFrame:
    return rounded(metrics.rollup_cer(scored(spark, sf_dir), "lang"))


@query()
def q_cer_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as one pair each, all letters kept; too slow in SQL, tested against a plain table."""
    text = F.coalesce("text", F.lit(""))
    hyp = F.when(F.col("doc_id") % 4 == 0, text).when(F.col("doc_id") % 4 == 1, F.replace(text, F.lit("ä"), F.lit("a"))).when(F.col("doc_id") % 4 == 2, F.concat(text, F.lit(" Ende"))).otherwise(F.regexp_replace(text, "(.{80}).", "$1"))
    pairs = fixture(spark, sf_dir, "texts").select("doc_id", text.alias("ref"), hyp.alias("hyp"))
    return rounded(metrics.pair_scores(_spread(pairs, "doc_id"), whole=True).select("doc_id", "edits", "ref_len", "cer"))


for _name in ("q_cer", "q_cer_stats", "q_macro_micro", "q_weighted", "q_bands", "q_rollup"):  # the same over whole documents
    QUERIES[f"{_name}_all"] = partial(QUERIES[_name], scored=_scored_all)
    ORACLE[f"{_name}_all"] = ORACLE[_name].replace(_SCORED, _SCORED_ALL)


@query(f"{_SCORED} SELECT lang, CAST(sum(edits) AS BIGINT) AS edits, true AS adds_up FROM s GROUP BY lang")
def q_edit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("ops", edit_ops(F.col("ref"), F.col("hyp")))
    total = F.sum(F.col("ops.substitutions") + F.col("ops.deletions") + F.col("ops.insertions"))
    return rows.groupBy("lang").agg(total.alias("edits"), (total == F.sum("edits")).alias("adds_up"))


#: The table of distances cell by cell, ``1000 * distance + substitutions`` in each: of equally cheap ways a match or
#: substitution comes first, then a deletion.
_CELLS = f"""WITH RECURSIVE t AS (SELECT doc_id, brand, ref, hyp, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS above, [x * 1000 for x in range(0, length(hyp) + 1)] AS here FROM {duck('readings')}
    UNION ALL SELECT doc_id, brand, ref, hyp, CASE WHEN j > length(hyp) THEN i + 1 ELSE i END, CASE WHEN j > length(hyp) THEN here ELSE above END,
        CASE WHEN j > length(hyp) THEN [(i + 1) * 1000] ELSE list_append(here, CASE WHEN slant // 1000 <= above[j + 1] // 1000 + 1 AND slant // 1000 <= here[j] // 1000 + 1 THEN slant
            WHEN above[j + 1] // 1000 <= here[j] // 1000 THEN above[j + 1] + 1000 ELSE here[j] + 1000 END) END
      FROM (SELECT *, len(here) AS j, above[len(here)] + CASE WHEN substr(ref, i, 1) = substr(hyp, len(here), 1) THEN 0 ELSE 1001 END AS slant FROM t WHERE i < length(ref) OR len(here) <= length(hyp)) AS c),
    o AS (SELECT doc_id, brand, length(ref) AS n, here[-1] // 1000 AS edits, here[-1] % 1000 AS substitutions, length(ref) - length(hyp) AS apart FROM t WHERE i = length(ref) AND len(here) = length(hyp) + 1),
    e AS (SELECT doc_id, brand, n, edits, substitutions, (edits - substitutions + apart) // 2 AS deletions, (edits - substitutions - apart) // 2 AS insertions FROM o)"""


@query(f"{_CELLS} SELECT doc_id, substitutions, deletions, insertions FROM e")
def q_edit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spread(fixture(spark, sf_dir, "readings"), "doc_id")
    return rows.select("doc_id", edit_ops(F.col("ref"), F.col("hyp")).alias("ops")).select("doc_id", "ops.*")


@query(f"""{_CELLS} SELECT brand, CAST(sum(substitutions) AS BIGINT) AS substitutions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(insertions) AS BIGINT) AS insertions,
    CAST(sum(n) AS BIGINT) AS ref_chars, round(sum(edits) / sum(n), 6) AS micro, round(avg(edits / n), 6) AS macro FROM e WHERE n > 0 GROUP BY brand""")
def q_error_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.error_split(_spread(fixture(spark, sf_dir, "readings"), "doc_id"), "brand"))


@query(f"""WITH x AS (SELECT doc_id, regexp_replace(lower(gt), '[^a-z0-9{{}}":,]', '', 'g') AS a, regexp_replace(lower(pred), '[^a-z0-9{{}}":,]', '', 'g') AS b FROM {duck('f1')}),
    y AS (SELECT doc_id, CASE WHEN json_type(TRY_CAST(b AS JSON)) = 'OBJECT' THEN 1 ELSE 0 END AS structured, levenshtein(a, b) AS raw FROM x)
    SELECT count(*) AS n, CAST(sum(structured) AS BIGINT) AS structured, CAST(sum(raw) AS BIGINT) AS raw_edits FROM y""")
def q_structured_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.regexp_replace(F.lower(c), r'[^a-z0-9{}":,]', "")
    f = fixture(spark, sf_dir, "f1").select(fold("gt").alias("ref"), fold("pred").alias("hyp"))
    s = metrics.pair_scores(f)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count(J.strict_object(F.col("hyp"))).alias("structured"), F.sum("edits").alias("raw_edits"))


@query(f"""WITH {_PARSED}, c AS (SELECT doc_id, concat('{{"Brand":"', g->>'Brand', '","Dims":{{"Size":"', g->'Dims'->>'Size', '","Type":"', g->'Dims'->>'Type', '"}},"Name":"', g->>'Name', '","Note":""}}') AS a,
    q, f.pred AS raw FROM p JOIN {duck('f1')} f USING (doc_id)),
    b AS (SELECT a, CASE WHEN q IS NULL THEN raw ELSE concat('{{', CASE WHEN q->>'Brand' IS NOT NULL THEN concat('"Brand":"', q->>'Brand', '",') ELSE '' END, '"Dims":{{"Size":"', q->'Dims'->>'Size', '","Type":"', q->'Dims'->>'Type', '"}},',
        CASE WHEN q->>'Extra' IS NOT NULL THEN '"Extra":"x",' ELSE '' END, '"Name":"', q->>'Name', '","Note":"', q->>'Note', '"}}') END AS h FROM c)
    SELECT count(*) AS n, round(sum(levenshtein(h, a)) / sum(length(a)), 6) AS micro, round(avg(levenshtein(h, a) / length(a)), 6) AS macro FROM b""")
def q_structured_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.structured_cer(fixture(spark, sf_dir, "f1"), "pred", "gt")
    return rounded(s.agg(F.count(F.lit(1)).alias("n"), (F.sum("edits") / F.sum("ref_len")).alias("micro"), F.avg("cer").alias("macro")))


@query(f"""WITH n AS (SELECT regexp_replace(lower(ref), '\\s+', '', 'g') AS s, doc_id FROM {duck('forms')}),
    p AS (SELECT s AS ref, replace(s, 'e', '.') AS hyp FROM n), c AS (SELECT *, regexp_replace(ref, '[^0-9a-z\\-]+', '', 'g') AS cref, regexp_replace(hyp, '[^0-9a-z\\-]+', '', 'g') AS chyp FROM p)
    SELECT round(sum({_EDITS}) / sum(length(ref)), 6) AS schema_micro, round(avg({_EDITS} / greatest(1, length(ref))), 6) AS schema_macro,
           round(sum(CASE WHEN chyp = '' THEN length(cref) WHEN cref = '' THEN length(chyp) ELSE levenshtein(chyp, cref) END) / sum(length(cref)), 6) AS content_micro,
           round(avg(CASE WHEN chyp = '' THEN length(cref) WHEN cref = '' THEN length(chyp) ELSE levenshtein(chyp, cref) END / greatest(1, length(cref))), 6) AS content_macro FROM c""")
def q_two_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents are spread, not their pieces: one file is few tasks, and to cut it up takes as long as to score it
    pairs = fixture(spark, sf_dir, "forms", spread=("documents", "doc_id")).select("ref", F.replace(F.lower("ref"), F.lit("e"), F.lit(".")).alias("hyp"))
    return rounded(metrics.two_forms(pairs, "hyp", "ref"))


@query(f"""WITH g AS (SELECT doc_id FROM {duck('f1')}), p AS (SELECT doc_id, 0.25::DOUBLE AS cer FROM {duck('f1')} WHERE doc_id % 3 > 0)
    SELECT coalesce(error, '') AS error, count(*) AS n, round(avg(cer), 6) AS macro FROM (SELECT CASE WHEN p.cer IS NULL THEN 'no prediction' END AS error, coalesce(p.cer, 1.0) AS cer FROM g LEFT JOIN p USING (doc_id)) GROUP BY 1""")
def q_with_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = fixture(spark, sf_dir, "f1").select("doc_id")
    pred = gt.where("doc_id % 3 > 0").withColumn("cer", F.lit(0.25))
    out = align.with_predictions(gt, pred, "doc_id", "cer")
    return rounded(out.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.avg("cer").alias("macro")))


# -- resolving and shaping -------------------------------------------------------------------------------------------

_GT_SORTED = """concat('{"Brand":"', g->>'Brand', '","Dims":{"Size":"', g->'Dims'->>'Size', '","Type":"', g->'Dims'->>'Type', '"},"Name":"', g->>'Name', '","Note":""}')"""


@query(f"""WITH f AS (SELECT doc_id, gt, gt::JSON AS g FROM {duck('f1')}), s AS (SELECT doc_id, gt, {_GT_SORTED} AS o FROM f)
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 10 = 0 THEN o END WHEN 2 THEN o WHEN 3 THEN o WHEN 4 THEN '{{}}' END AS pred_json,
      CASE doc_id % 5 WHEN 0 THEN 'free text' WHEN 1 THEN 'some words' WHEN 2 THEN gt WHEN 4 THEN '{{}}' END AS pred_str,
      CASE doc_id % 5 WHEN 0 THEN o WHEN 2 THEN o WHEN 3 THEN o END AS gt_json, CASE doc_id % 5 WHEN 1 THEN 'plain words' WHEN 2 THEN gt END AS gt_str FROM s""")
def q_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_rows(fixture(spark, sf_dir, "f1b")).drop("raw")


@query("""SELECT path_taken, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_partkey % 10 = 0 THEN 'json' ELSE 'string' END WHEN 1 THEN 'string' WHEN 2 THEN 'json' WHEN 3 THEN 'json' ELSE 'skipped' END AS path_taken FROM part) GROUP BY 1""")
def q_path_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.resolve_rows(fixture(spark, sf_dir, "f1b"))
    taken = resolve.path_taken(*[F.col(c) for c in ("pred_json", "gt_json", "pred_str", "gt_str")])
    return rows.groupBy(taken.alias("path_taken")).agg(F.count(F.lit(1)).alias("n"))


_WRAPPED = f"(SELECT doc_id, gt, response, doc_id % 8 AS k FROM {duck('f3')})"


def _extract(mode: str, cases: str):
    """A query of one way to find the object; ``cases`` says by ``k`` what it finds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixture(spark, sf_dir, "f3").select("doc_id", J.extract_object(F.col("response"), mode).alias("found"))

    QUERIES[f"q_extract_{mode}"] = run
    ORACLE[f"q_extract_{mode}"] = f"SELECT doc_id, CASE k {cases} ELSE '{{}}' END AS found FROM {_WRAPPED}"


_OUT = """WHEN 7 THEN concat('{"outer":', gt, '}')"""
_extract("fence_strip", f"WHEN 2 THEN gt {_OUT}")
_extract("outer_span", f"WHEN 0 THEN gt WHEN 1 THEN gt WHEN 2 THEN gt WHEN 4 THEN gt {_OUT}")
_extract("greedy", f"WHEN 0 THEN gt WHEN 1 THEN gt WHEN 2 THEN gt WHEN 4 THEN gt {_OUT}")
_extract("first_balanced", f"""WHEN 0 THEN gt WHEN 1 THEN gt WHEN 2 THEN gt WHEN 3 THEN '{{"note":"first"}}' WHEN 4 THEN gt {_OUT}""")
_extract("longest_prefix", f"""WHEN 0 THEN gt WHEN 1 THEN gt WHEN 2 THEN gt WHEN 3 THEN '{{"note":"first"}}' WHEN 4 THEN gt {_OUT}""")
_extract("nested_regex", "WHEN 0 THEN gt WHEN 1 THEN gt WHEN 2 THEN gt WHEN 3 THEN gt WHEN 4 THEN gt WHEN 7 THEN gt")


@query(f"""SELECT doc_id, CASE WHEN k IN (0, 1, 2, 4) THEN gt WHEN k = 7 THEN concat('{{"outer":', gt, '}}') END AS record, CASE WHEN k IN (3, 5, 6) THEN 'no object' END AS error, CASE WHEN k IN (3, 5, 6) THEN response END AS raw FROM {_WRAPPED}""")
def q_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.with_errors(fixture(spark, sf_dir, "f3"), "response", "doc_id")


@query(f"SELECT doc_id, CASE k WHEN 0 THEN gt WHEN 6 THEN replace(gt, '\"', concat(chr(92), '\"')) ELSE response END AS text FROM {_WRAPPED}")
def q_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "f3").select("doc_id", J.strip_chat_prefix(F.col("response")).alias("text"))


@query(f"SELECT doc_id, CASE k WHEN 0 THEN gt WHEN 2 THEN replace(response, chr(10), ' ') WHEN 6 THEN gt ELSE response END AS text FROM {_WRAPPED}")
def q_prediction_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import normalize_text

    text = F.trim(J.unescape_once(J.strip_chat_prefix(normalize_text(F.col("response")))))
    return fixture(spark, sf_dir, "f3").select("doc_id", text.alias("text"))


@query(f"SELECT doc_id, replace(gt, '\"', concat(chr(92), '\"')) AS escaped, gt AS text FROM {duck('f1')}")
def q_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace("gt", F.lit('"'), F.lit('\\"'))
    return fixture(spark, sf_dir, "f1").select("doc_id", escaped.alias("escaped"), J.unescape_once(escaped).alias("text"))


@query(f"WITH p AS (SELECT doc_id, gt::JSON AS g FROM {duck('f1')}) SELECT doc_id, {_GT_SORTED} AS record FROM p")
def q_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "f1").select("doc_id", J.sorted_string(J.strict_object(F.col("gt"))).alias("record"))


@query(f"SELECT doc_id, CASE WHEN json_type(TRY_CAST(pred AS JSON)) = 'OBJECT' THEN pred END AS record FROM {duck('f1')}")
def q_canonical_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "f1").select("doc_id", J.ordered_string(F.col("pred")).alias("record"))


_TEMPLATE = ("Brand", "Name", "Dims.Size", "Note", "Missing")


@query(f"""WITH {_PARSED} SELECT doc_id, position, path, coalesce(value, '') AS value FROM ({" UNION ALL ".join(f"SELECT doc_id, {i} AS position, '{x}' AS path, {_path(x, 'q')} AS value FROM p WHERE q IS NOT NULL" for i, x in enumerate(_TEMPLATE))})""")
def q_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.conform(_longs(spark, sf_dir)[1], ["doc_id"], _TEMPLATE)


@query(f"""WITH {_PARSED} SELECT doc_id, concat('{{"Brand":"', coalesce(q->>'Brand', ''), '","Name":"', q->>'Name', '","Dims.Size":"', q->'Dims'->>'Size', '","Note":"', q->>'Note', '","Missing":""}}') AS record FROM p WHERE q IS NOT NULL""")
def q_template_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.template_string(shape.conform(_longs(spark, sf_dir)[1], ["doc_id"], _TEMPLATE), ["doc_id"])


@query(f"WITH {_PARSED}, {_LONG} SELECT path, count(*) AS n FROM ql WHERE path IN ('Dims.Type', 'Extra') GROUP BY path")
def q_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.extras(_longs(spark, sf_dir)[1], _TEMPLATE).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PARSED}, {_LONG} SELECT replace(replace(path, 'Dims', 'Masse'), 'Size', 'Grad') AS path, count(*) AS n FROM gl GROUP BY 1")
def q_rename_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("Dims", "Masse"), ("Size", "Grad")], "old string, new string")
    return shape.rename_keys(_longs(spark, sf_dir)[0], names).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PARSED}, {_LONG} SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS dataset, path, count(*) AS n FROM gl WHERE NOT (doc_id % 2 = 0 AND path = 'Name') AND NOT (doc_id % 2 = 1 AND path LIKE 'Dims%') GROUP BY ALL")
def q_drop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _longs(spark, sf_dir)[0].withColumn("dataset", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    excluded = spark.createDataFrame([("a", "Name"), ("b", "Dims")], "dataset string, key string")
    return shape.drop_keys(long, excluded).groupBy("dataset", "path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PARSED} SELECT doc_id, unnest([0, 1, 2]) AS position, unnest(['id', 'Name', 'Gone']) AS path, unnest([doc_id::VARCHAR, g->>'Name', '']) AS value FROM p")
def q_merge_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.merge_into_template(_longs(spark, sf_dir)[0], "doc_id", ("id", "Name", "Gone"), "id")


@query(f"WITH {_PARSED}, {_LONG} SELECT doc_id, string_agg(value, ' ' ORDER BY path) AS text FROM gl WHERE value <> '' GROUP BY doc_id")
def q_leaf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.leaf_text(_longs(spark, sf_dir)[0], ["doc_id"])


@query(f"""WITH {_PARSED}, {_LONG} SELECT doc_id, concat('| Field | Value |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', path, ' | ', replace(value, '|', concat(chr(92), '|')), ' |'), chr(10) ORDER BY path)) AS report FROM gl GROUP BY doc_id""")
def q_field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.field_report(_longs(spark, sf_dir)[0], ["doc_id"])


@query(f"""WITH {_PARSED}, {_LONG} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' ELSE 'extra' END AS side, count(*) AS n
    FROM (SELECT DISTINCT doc_id, path FROM gl) a FULL JOIN (SELECT DISTINCT doc_id, path FROM ql) b USING (doc_id, path) WHERE a.path IS NULL OR b.path IS NULL GROUP BY ALL""")
def q_key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred, _ = _longs(spark, sf_dir)
    return align.missing_and_extra(gt, pred, ["doc_id", "path"]).groupBy("path", "side").agg(F.count(F.lit(1)).alias("n"))


# -- records of any depth ---------------------------------------------------------------------------------------------

_STAIR = f"r AS (SELECT doc_id, gt::JSON AS g, {_OBJ.format(x='pred')} AS q FROM {duck('stairs')})"


def _tree(j: str, where: str = "instr(t.fullkey, '[') = 0 AND t.type <> 'OBJECT'") -> str:
    return f"""SELECT r.doc_id, t.id, replace(substr(t.fullkey, 3), '"', '') AS path, t.type, t.value AS j, CASE WHEN t.type = 'NULL' THEN '' ELSE coalesce(t.atom ->> '$', CAST(json(t.value) AS VARCHAR)) END AS value
        FROM r, json_tree(r.{j}) AS t WHERE r.{j} IS NOT NULL AND {where}"""


@query(f"WITH {_STAIR}, l AS ({_tree('q')}) SELECT doc_id, path, value FROM l")
def q_paths_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.flatten(_spread(fixture(spark, sf_dir, "stairs"), "doc_id"), ["doc_id"], "pred")


@query(f"""WITH {_STAIR}, l AS ({_tree('q', "t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')")}) SELECT doc_id, string_agg(trim(value), ' ' ORDER BY id) AS text FROM l WHERE trim(value) <> '' GROUP BY doc_id""")
def q_leaf_text_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.leaf_text(shape.leaves(_spread(fixture(spark, sf_dir, "stairs"), "doc_id"), ["doc_id"], "pred", open_lists=True), ["doc_id"])


@query(f"WITH {_STAIR} SELECT doc_id, CAST(json(q) AS VARCHAR) AS record FROM r")
def q_canonical_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "stairs").select("doc_id", J.ordered_string(F.col("pred")).alias("record"))


@query(f"""WITH {_PARSED} SELECT doc_id, concat('{{"Brand":"', coalesce(q->>'Brand', ''), '","Dims":{{"Size":"', q->'Dims'->>'Size', '","Weight":"","Type":"', q->'Dims'->>'Type', '"}},"Note":"', q->>'Note', '","No. 2":""}}') AS record FROM p WHERE q IS NOT NULL""")
def q_template_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("Brand", "Dims.Size", "Dims.Weight", "Dims.Type", "Note", "No. 2")
    return shape.nested_string(shape.conform(_longs(spark, sf_dir)[1], ["doc_id"], fields), ["doc_id"], fields, ("Dims",))


def _rows(*cells: str) -> str:
    """SQL of markdown lines: values of the record in ``g``, or quoted text."""
    return ", ".join(x if x.startswith("g") else "'" + x.replace("/", "' || chr(10) || '") + "'" for x in cells)


@query(f"""WITH {_STAIR} SELECT doc_id, concat({_rows('| Field | Value |/| --- | --- |/| Zone | ', "g->>'Zone'", ' |/| Free |  |//#### Runs//| Field | Value |/| --- | --- |/| Up | ', "g->'Runs'->'Up'->>0", ', ', "g->'Runs'->'Up'->>1",
    ' |/| Down | ', "g->'Runs'->'Down'", ' |//#### Area//|  | w | note |/| --- | --- | --- |/| north | ', "g->'Area'->'north'->>'w'", ' | ', "g->'Area'->'north'->>'note'", ' |/| south | ', "g->'Area'->'south'->>'w'",
    ' | a\\|b |//#### Marks//| Value |/| --- |/| ', "g->'Marks'->>0", ' |/| ✓ |//#### Also//')}) AS report FROM r""")
def q_nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.nested_report(_spread(fixture(spark, sf_dir, "stairs"), "doc_id"), ["doc_id"], "gt")


def _sim(a: str, b: str) -> str:
    near = f"1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {near} >= 0.5 THEN {near} ELSE 0.0 END"


@query(f"""WITH {_STAIR}, gl AS ({_tree('g')}), ql AS ({_tree('q')}),
    j AS (SELECT coalesce(gl.doc_id, ql.doc_id) AS doc_id, coalesce(gl.path, ql.path) AS path, gl.type AS gt_type, ql.type AS pred_type, gl.value AS gt, ql.value AS pred,
        CASE WHEN gl.type = 'ARRAY' THEN CAST(gl.j AS VARCHAR[]) END AS a, CASE WHEN ql.type = 'ARRAY' THEN CAST(ql.j AS VARCHAR[]) END AS b FROM gl FULL JOIN ql ON gl.doc_id = ql.doc_id AND gl.path = ql.path),
    s AS (SELECT doc_id, path, greatest(coalesce(len(a), 1), coalesce(len(b), 1), 1) AS weight, CASE WHEN gt IS NULL OR pred IS NULL OR (a IS NULL) <> (b IS NULL) THEN 0.0
        WHEN a IS NULL THEN {_sim('gt', 'pred')}
        ELSE greatest({_sim('a[1]', 'b[1]')} + {_sim('a[2]', 'b[2]')}, {_sim('a[1]', 'b[2]')} + {_sim('a[2]', 'b[1]')}) / greatest(len(a), len(b)) END AS score FROM j),
    n AS (SELECT doc_id, array_to_string(parts[1:k], '.') AS path, score, weight FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS k FROM (SELECT *, string_split(path, '.') AS parts FROM s))),
    d AS (SELECT doc_id, path, sum(score * weight) / sum(weight) AS score FROM n GROUP BY ALL) SELECT path, count(*) AS records, round(avg(score), 6) AS anls FROM d GROUP BY path""")
def q_anls_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    stairs = _spread(fixture(spark, sf_dir, "stairs"), "doc_id")
    side = lambda c: shape.leaves(stairs, ["doc_id"], c)
    nodes = metrics.anls_paths(metrics.anls_leaves(side("gt"), side("pred"), "doc_id"), "doc_id")
    return rounded(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("records"), F.avg("score").alias("anls")))


__all__ = ["ORACLE", "QUERIES", "ascii_fold", "thresholds"]
