"""Document fingerprints by I-Match with randomised lexicons (DataFrame functions only).

Terms are the lower-cased words of op3's alphabet, told apart by 64-bit hashes. The lexicon holds the terms whose inverse
document frequency lies in a band: found in at least two documents and in no more than a share of ``MOST`` of all. Each of
``SUBSETS`` randomised lexicons is a nest of subsets, each half as large as the one around it; a document uses the smallest
that still holds one of its terms, so that short and long texts alike keep a few terms of each, and hashes those. A
fingerprint is the row of these hashes, and the likeness of two fingerprints is the share of hashes that are equal.

All terms of a text are judged. Document frequencies count every term of every document; with its count a term brings the
document that it was seen in, so those of one document only go back to it. Those of too many documents are few whatever
the corpus (``1 / MOST`` times the distinct terms of a mean document at most) and are broadcast. What a text holds besides
is the lexicon's. Only the words that an edit cuts or joins may be of neither text: these are looked up by a shuffle of
their own and added to what is known of the edited text: the hash of a subset is the exclusive or of its terms. Texts move once
and only to meet the piece of the next document; no step gathers the rows of a term.

Cases: a null text is empty; a text without words has the empty fingerprint, which is like itself only; a document none
of whose terms lies in the band uses all its terms; rows that repeat id and text are one document with a row each; rows
that repeat an id with different texts are documents of their own, ordered by a hash of the text; rows without an id come
before all others; a single document is its own next; an empty table stays empty; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import stage
from .decontaminate import words

#: The band ends where a term is found in more than this share of all documents; it begins with two documents.
MOST = 0.05
SUBSETS = 24
#: A letter of a word, before it is lower-cased.
_LETTER = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
_NO_TERMS = "CAST(array() AS ARRAY<LONG>)"


def hashes(words_) -> Column:
    """Words as 64-bit hashes."""
    return F.transform(words_, lambda w: F.xxhash64(w))


def term_hashes(text) -> Column:
    """The distinct terms of a text as 64-bit hashes."""
    return F.array_distinct(hashes(words(text)))


def lexicon(keyed: DataFrame, most: float = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term) of the lexicon, (k1, k2, single) of the terms that one document alone holds, and (common), one row with the
    terms that too many hold; from (k1, k2, text)."""
    high = max(2, int(keyed.count() * most))
    held = keyed.select("k1", "k2", F.explode(term_hashes(F.col("text"))).alias("term"))
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("k1"), F.min("k2").alias("k2"))
    alone = F.col("n") == 1
    judged = stage(counts.select("term", (F.col("n") > high).alias("frequent"), F.when(alone, F.col("k1")).alias("k1"), F.when(alone, F.col("k2")).alias("k2")))
    single = judged.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.collect_list("term").alias("single"))
    # more than ``high`` documents hold each, so they are at most 1 / most times the distinct terms of a mean document
    common = judged.where("frequent").agg(F.collect_list("term").alias("common"))
    return judged.where("NOT frequent AND k1 IS NULL").select("term"), single, F.broadcast(common)


def nests(terms: str, subsets: int = SUBSETS) -> str:
    """(low, hash) of each nest over a column of distinct terms; no terms give none.

    A term's level in nest k is the size of its own hash in bits; the smallest subset that holds a term of the document is
    the one of its lowest level, and the hash is made of the terms of that level.
    """
    values = f"transform({terms}, t -> shiftrightunsigned(xxhash64(t, k), 12))"
    used = "aggregate(filter(v, x -> x < top), 0, (a, x) -> a ^ hash(x))"
    one = f"named_struct('low', CAST(length(bin(top)) AS TINYINT), 'hash', {used})"
    bound = f"transform(array({values}), v -> transform(array(shiftleft(1L, length(bin(array_min(v))))), top -> {one})[0])[0]"
    return f"transform(IF(size({terms}) = 0, CAST(array() AS ARRAY<INT>), sequence(0, {subsets - 1})), k -> {bound})"


def signature(terms: str, subsets: int = SUBSETS) -> Column:
    """A hash for each randomised lexicon over a column of distinct terms; no terms give no hashes."""
    return F.expr(f"transform({nests(terms, subsets)}, s -> s.hash)")


def as_text(hashes: str) -> Column:
    """Eight hexadecimal digits for each hash."""
    return F.expr(f"array_join(transform({hashes}, x -> lpad(lower(hex(CAST(x AS LONG) & 4294967295L)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """The share of equal hashes; two empty fingerprints are equal, one is like no other."""
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x <=> y), z -> z))"
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D ELSE CAST({same} AS DOUBLE) / size({a}) END")


def _keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, text) of every row; ``docs`` has (id, text). The lowest bit of the second key tells rows without an id."""
    text = F.coalesce("text", F.lit(""))
    mark = F.xxhash64(text)
    return docs.select(F.coalesce("id", F.lit(0)).alias("k1"), F.when(F.col("id").isNull(), mark.bitwiseAND(F.lit(-2))).otherwise(mark.bitwiseOR(F.lit(1))).alias("k2"), text.alias("text"))


def _row_id() -> Column:
    return F.when(F.col("k2").bitwiseAND(F.lit(1)) == 1, F.col("k1"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", subsets: int = SUBSETS) -> DataFrame:
    """(id, fingerprint) of every row."""
    # a term of one document only needs no more than the document's text to find it
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))
    _, single, common = lexicon(keyed)
    rows = keyed.join(single.hint("merge"), ["k1", "k2"], "left").crossJoin(common)
    rows = rows.select("id", term_hashes(F.col("text")).alias("all"), F.concat(F.coalesce("single", F.expr(_NO_TERMS)), "common").alias("outside"))
    rows = rows.select("id", "all", F.array_except("all", "outside").alias("band")).select("id", F.expr("IF(size(band) > 0, band, all)").alias("terms"))
    return rows.select("id", signature("terms", subsets).alias("own")).select(F.col("id").alias(id_col), as_text("own").alias("fingerprint"))


def _with_next(keyed: DataFrame, single: DataFrame) -> DataFrame:
    """(no, total, id, copies, text, piece, single) of every different (id, text); ``keyed`` has (k1, k2, text).

    The piece is the beginning of the next document's text, a quarter as long as the document itself or all of it. The single
    terms are those of both documents.
    """
    light = keyed.groupBy("k1", "k2").agg(F.first(F.length("text")).alias("n"), F.count(F.lit(1)).alias("copies"))
    order = (F.col("k2").bitwiseAND(F.lit(1)), F.col("k1"), F.col("k2"))
    placed = stage(numbered(light, *order, name="no"))
    total = placed.count()
    if not total:
        return keyed.sparkSession.createDataFrame([], "no long, total long, id long, copies long, text string, piece string, single array<long>")
    target = placed.select("no", F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.floor(F.col("n") / 4).cast("int").alias("m"), "copies")
    # a document's beginning goes to the one before it
    sends = placed.select("k1", "k2", F.pmod(F.col("no") + total - 1, F.lit(total)).alias("no")).join(target, "no")
    # empty texts have nothing to send and don't travel
    texts = keyed.where("text <> ''")
    if not placed.where("copies > 1 AND n > 0").isEmpty():
        texts = texts.dropDuplicates(["k1", "k2"])
    pieces = (
        sends.join(texts.hint("merge"), ["k1", "k2"], "left")
        .join(single.hint("merge"), ["k1", "k2"], "left")
        .select(F.col("to1").alias("k1"), F.col("to2").alias("k2"), "no", "copies", F.expr("left(coalesce(text, ''), m)").alias("piece"), F.coalesce("single", F.expr(_NO_TERMS)).alias("theirs"))
    )
    whole = pieces.join(texts.hint("merge"), ["k1", "k2"], "left").join(single.hint("merge"), ["k1", "k2"], "left")
    return whole.select(
        "no", F.lit(total).cast("long").alias("total"), _row_id().alias("id"), "copies", F.coalesce("text", F.lit("")).alias("text"), "piece",
        F.concat(F.coalesce("single", F.expr(_NO_TERMS)), "theirs").alias("single"),
    )


def _continued(rest: str) -> Column:
    """The hashes of the words of a text that ``kept`` begins and ``rest`` ends; a word may lie in both."""
    joined = F.xxhash64(F.concat(F.try_element_at("kept_words", F.lit(-1)), F.get(f"{rest}_words", F.lit(0))))
    within = F.right("kept", F.lit(1)).rlike(_LETTER) & F.left(F.col(rest), F.lit(1)).rlike(_LETTER)
    left, right = hashes("kept_words"), hashes(f"{rest}_words")
    whole = F.concat(F.slice(left, 1, F.size("kept_words") - 1), F.array(joined), F.slice(right, 2, F.size(f"{rest}_words")))
    return F.when(within, whole).otherwise(F.concat(left, right))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", subsets: int = SUBSETS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many of the next document in
    ascending order of ids (after the last comes the first).
    """
    keyed = _keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    band, single, common = lexicon(keyed)
    n = F.length("text")
    stay = n - F.floor(n / 4).cast("int")
    head = F.struct("id", "copies", "total", n.cast("long").alias("n_chars"))
    rows = _with_next(keyed, single).select("no", head.alias("head"), F.left("text", stay).alias("kept"), F.substring("text", stay + 1, n).alias("tail"), "piece", "single")
    rows = rows.select("*", F.sha2(F.concat("kept", "piece"), 256).alias("edited_sha256"), *(words(F.col(c)).alias(f"{c}_words") for c in ("kept", "tail", "piece")))
    rows = rows.select("no", "head", "edited_sha256", _continued("tail").alias("own"), _continued("piece").alias("edited"), F.size("kept_words").alias("at"), "single")
    # the word at the edit and the last one may be of neither text
    rows = rows.crossJoin(common).select(
        "no", "head", "edited_sha256", "own", "edited",
        F.expr("filter(edited, (x, i) -> i <> at - 1 AND i <> size(edited) - 1)").alias("known"),
        F.expr("array_compact(array(get(edited, at - 1), get(edited, size(edited) - 1)))").alias("asked"),
        F.array_except(F.concat("own", "edited"), F.concat("single", "common")).alias("inside"),
    )
    rows = rows.select("no", "head", "edited_sha256", "own", "edited", F.array_intersect("own", "inside").alias("own_band"), F.array_intersect("known", "inside").alias("band"), F.array_except(F.array_intersect("asked", "inside"), "known").alias("asked"))
    used = rows.select("no", "head", "edited_sha256", F.expr("IF(size(own_band) > 0, own_band, array_distinct(own))").alias("own"), F.expr("IF(size(band) > 0, band, array_distinct(edited))").alias("edited"), (F.size("band") > 0).alias("sure"), "asked")
    nested = used.select("no", "head", "edited_sha256", signature("own", subsets).alias("own"), F.expr(nests("edited", subsets)).alias("edited"), "sure", "asked")
    # without a term that is known to be in the band there is no level to compare with
    made = stage(nested.select("no", "head", "edited_sha256", "own", F.expr("transform(edited, s -> s.hash)").alias("edited"), F.expr("IF(sure, transform(edited, s -> s.low), CAST(array() AS ARRAY<TINYINT>))").alias("low"), "asked"))
    asked = made.select("no", F.explode("asked").alias("term"))
    found = asked.join(band.hint("merge"), "term", "left_semi").groupBy("no").agg(F.collect_list("term").alias("found"))
    ahead = made.select(F.pmod(F.col("no") - 1 + F.col("head.total"), F.col("head.total")).alias("no"), F.col("own").alias("next"))
    out = made.drop("asked").join(ahead, "no").join(found.hint("merge"), "no", "left")
    lower = "CASE WHEN get(low, i) IS NULL OR get(low, i) > s.low THEN s.hash WHEN get(low, i) < s.low THEN edited[i] ELSE edited[i] ^ s.hash END"
    out = out.withColumn("edited", F.expr(f"IF(found IS NULL, edited, transform({nests('found', subsets)}, (s, i) -> {lower}))"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("head.copies"))))
    return out.select(
        F.col("head.id").alias(id_col), "head.n_chars", "edited_sha256", as_text("own").alias("fingerprint"),
        as_text("edited").alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
