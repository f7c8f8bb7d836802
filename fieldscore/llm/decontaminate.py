"""Benchmark decontamination: a prefix-filtered set join (DataFrame functions only).

The shingles of benchmark items (word pairs; the word of a one-word item) are counted over the whole corpus and
ordered by rarity. Every different window of the items keeps only its rarest shingle: containment is exact, so one
token is the necessary prefix. Documents join on these tokens, a match fixes where the window would lie, length and
position bounds discard what cannot fit, and the rest is compared word by word. A text of repeated words has few
different windows, so it gets no more candidate places than it has words for each of them.

Cases: a null or empty text has no words and no hits; items without an id, a text or words take no part; an id
that several items share is one item with all their windows; rows of documents that repeat an id are judged each
on its own text; an item shorter than the window is one window; empty tables give no hits; columns of the
input with the names of the results are replaced. A word of the document is hit once, however many windows cover it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stage

WINDOW = 13
#: Benchmark shingles up to this number are sent to every task (16 bytes each); beyond it Spark picks the join.
BROADCAST_ROWS = 1_000_000
#: Likewise different windows with their words (about 200 bytes each).
BROADCAST_WINDOWS = 100_000
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(col):
    """Lower-cased (A-Z) words of ASCII letters, digits and all code points above 0x7F."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _shingles(table: DataFrame, *keep: str, pairs: bool, singles: bool) -> DataFrame:
    """(keep..., pos, shingle) of a table with column ``words``."""
    rows = table.select(*keep, "words", F.posexplode("words").alias("pos", "word"))
    pair = F.xxhash64("word", F.get("words", F.col("pos") + 1))
    if pairs and singles:
        both = F.array(F.when(F.col("pos") + 1 < F.size("words"), pair), F.xxhash64("word"))
        return rows.select(*keep, "pos", F.explode(both).alias("shingle")).where("shingle IS NOT NULL")
    if pairs:
        return rows.where(F.col("pos") + 1 < F.size("words")).select(*keep, "pos", pair.alias("shingle"))
    return rows.select(*keep, "pos", F.xxhash64("word").alias("shingle"))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("words")).where("item IS NOT NULL AND size(words) > 0")
    return items.distinct().withColumn("key", F.xxhash64("item", "words"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """The table, sent to every task if it has no more than ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: tuple[int, int] = (1, 20),
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` (hits of at least ``share``)."""
    items = stage(_items(benchmark, item_col, item_text_col))
    kinds = {r[0] for r in items.select(F.size("words") > 1).distinct().collect()}  # two values at most
    kind = {"pairs": True in kinds, "singles": False in kinds}
    own = stage(
        _shingles(items.where("size(words) > 1"), "key", pairs=True, singles=False)
        .unionByName(_shingles(items.where("size(words) = 1"), "key", pairs=False, singles=True))
    )
    wanted = stage(own.select("shingle").distinct())
    # the row travels as one column, so no name of the input meets a name used here
    kept = [c for c in docs.columns if c not in RESULTS]
    text = F.col(text_col)
    rows = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    source = rows.select("id", "mark", words(F.col("text")).alias("words"))
    found = stage(_shingles(source, "id", "mark", **kind).join(_small(wanted, BROADCAST_ROWS), "shingle", "left_semi"))

    # the rarest shingle of each window of each item
    counts = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = own.join(counts, "shingle").select("key", "pos", "shingle", "n")
    by_key = own.select("key", "pos").join(ranked, ["key", "pos"], "left")
    ahead = Window.partitionBy("key").orderBy("pos").rowsBetween(0, max(0, window - 2))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "shingle")).over(ahead)
    length = F.size("words")
    windows = stage(
        by_key.withColumn("rarest", rarest).join(items, "key")
        .where((F.col("pos") <= F.greatest(length - window, F.lit(0))) & (F.col("rarest.n") > 0))
        .select("item", F.slice("words", F.col("pos") + 1, F.least(length, F.lit(window))).alias("words"), (F.col("rarest.pos") - F.col("pos")).alias("ahead"), F.col("rarest.shingle").alias("shingle"))
        .groupBy("words").agg(F.first("ahead").alias("ahead"), F.first("shingle").alias("shingle"), F.collect_set(F.col("item").cast("string")).alias("items"))
        .withColumn("window", F.monotonically_increasing_id())
    )
    # where a window would lie; it may not begin before the document does
    placed = (
        found.join(_small(windows.select("window", "ahead", "shingle"), BROADCAST_ROWS), "shingle")
        .select("id", "mark", "window", (F.col("pos") - F.col("ahead")).alias("at")).where("at >= 0")
        .groupBy("id", "mark", "window").agg(F.collect_set("at").alias("starts"))
    )
    places = (
        placed.join(_small(windows.select("window", "words", "items"), BROADCAST_WINDOWS), "window")
        .groupBy(F.col("id").alias("id2"), F.col("mark").alias("mark2")).agg(F.collect_list(F.struct("words", "items", "starts")).alias("places"))
    )
    joined = rows.join(places, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left").select("row", "text", "places")
    fits = "filter(p.starts, s -> s + size(p.words) <= size(w) AND slice(w, s + 1, size(p.words)) = p.words)"
    verified = f"filter(transform(places, p -> named_struct('items', p.items, 'k', size(p.words), 'at', {fits})), x -> size(x.at) > 0)"
    # the one-element array makes each document's words once
    judged = joined.withColumn("w", F.array(words(F.col("text")))).withColumn("r", F.expr(f"transform(w, w -> named_struct('n', size(w), 'found', {verified}))[0]"))
    # the union of the windows' places, in one pass over them in order
    hit = F.expr("""aggregate(array_sort(flatten(transform(r.found, f -> transform(f.at, s -> named_struct('s', s, 'e', s + f.k))))),
        named_struct('e', 0, 'n', 0L), (a, x) -> named_struct('e', greatest(a.e, x.e), 'n', a.n + greatest(0, x.e - greatest(a.e, x.s))), a -> a.n)""")
    ids = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.col("r.found.items")))), F.expr("CAST(array() AS ARRAY<STRING>)"))
    out = judged.select("row", F.col("r.n").cast("long").alias("n_words"), F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), ids.alias("ids"))
    dirty = (F.col("n_hit") > 0) & (share[1] * F.col("n_hit") >= share[0] * F.col("n_words"))
    return out.select("row.*", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), dirty.alias("contaminated"))
