"""The registered queries of the text operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fingerprints, jaccard, line_dedup, negatives, packing, phrases, quality, sharding, spelling, tokenstore, warc
from . import decontaminate as decontam
from .common import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), shared_dir(spark))
    rows = warc.read_archives(spark, archives)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *decontam.RESULTS)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document is as long as its words and an end mark
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")) + 1
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", n.alias("n_tokens")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", *quality.RESULTS[:-1], F.col("accepted").alias("keep"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"), n=3, similarity=(90, 100))


def op7_token_ids(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    # this vocabulary drops white space, so pieces between spaces don't depend on each other
    files = tokenstore.write_tokens(table(spark, sf_dir, "documents"), shared_dir(spark), vocabulary, end_id=1, by_space=True)
    return tokenstore.read_tokens(spark, files)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, counts=False)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stage

    maps = shared_dir(spark)
    slotted = stage(sharding.with_slot(table(spark, sf_dir, "documents")))
    by_slot = stage(sharding.slot_bytes(slotted))
    # version 1 is stored, edited to version 2 by the bytes, and the newest is used
    sharding.save_map(sharding.new_map(by_slot), maps)
    sharding.save_map(sharding.rebalance_map(sharding.load_map(spark, maps), by_slot, sharding.SHARDS), maps)
    slot_map = sharding.load_map(spark, maps)
    out = sharding.assign(slotted, slot_map)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    out = negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality": op5_quality,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_token_ids": op7_token_ids,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fingerprints": op12_fingerprints,
    "op13_spelling_variants": op13_spelling_variants,
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS k FROM lines),
        hot AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        judged AS (SELECT doc_id, pos, line, hot.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN hot USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM m""",
    "op3_decontaminate": f"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
        items AS (SELECT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0),
        win AS (SELECT item_id, k, array_to_string(list_slice(w, j, j + k - 1), ' ') AS s
                FROM items, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS j)),
        ks AS (SELECT DISTINCT k FROM win),
        dwin AS (SELECT doc_id, k, j, array_to_string(list_slice(w, j, j + k - 1), ' ') AS s
                 FROM dw, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS j)),
        m AS (SELECT DISTINCT doc_id, j, win.k, item_id FROM dwin JOIN win ON dwin.s = win.s AND dwin.k = win.k),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM m) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op6_ngram_jaccard": f"""
        WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
                                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM dw),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT x AS a, y AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
        c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
        SELECT dw.doc_id, coalesce(n, 0) AS n_shingles, least(dw.doc_id, coalesce(b, dw.doc_id)) AS component_id FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = dw.doc_id""",
    "op8_substring_dedup": """
        WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, j, array_to_string(list_slice(w, j, j + 19), ' ') AS s
                FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS j)),
        ranked AS (SELECT doc_id, j, row_number() OVER (PARTITION BY s ORDER BY doc_id, j) AS r FROM win),
        gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + 20)) AS p FROM ranked WHERE r > 1),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM dw LEFT JOIN kept USING (doc_id)""",
    "op11_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
              FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        pos AS (SELECT anchor_id, other AS positive_id, s AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5),
        neg AS (SELECT anchor_id, positive_id, other AS negative_id, positive_score, s AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other) AS rank
                FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10""",
}
