"""Error rates, overlap scores and validity rates, per field, document and dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import edit_ops, edits, edits_of_any_length, edits_within, list_anls, string_anls
from ..registry import BANDS, THRESHOLDS, thresholds
from .align import align_paths


def pair_scores(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", whole: bool = False) -> DataFrame:
    """Pairs with ``edits``, ``ref_len`` and ``cer``; the distance is made once. With ``whole`` texts may be of any length."""
    distance = edits_of_any_length if whole else edits
    out = pairs.withColumn("edits", distance(F.col(hyp), F.col(ref)).cast("long")).withColumn("ref_len", F.length(ref).cast("long"))
    return out.withColumn("cer", F.col("edits") / F.greatest(F.lit(1), F.col("ref_len")))


def macro_cer(scored: DataFrame, by: Sequence[str] = (), empty: str = "skip", if_none: float = 1.0) -> DataFrame:
    """Mean of row rates. ``empty='skip'`` leaves out empty references; ``'rate'`` counts them as 0 against an empty text, else 1."""
    return scored.groupBy(*by).agg(macro_rate(empty, if_none).alias("macro_cer"))


def macro_rate(empty: str = "skip", if_none: float = 1.0) -> Column:
    """The same as an aggregate, to be taken with others in one pass."""
    kept = F.when(F.col("ref_len") > 0, F.col("cer"))
    if empty == "rate":
        kept = kept.when(F.col("edits") == 0, 0.0).otherwise(1.0)
    return F.coalesce(F.avg(kept), F.lit(if_none))


def error_rates(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(macro_cer, macro_rated, micro_cer, edits, ref_chars): both means of rows and the rate of all characters, in one pass."""
    return scored.groupBy(*by).agg(
        macro_rate().alias("macro_cer"), macro_rate("rate").alias("macro_rated"), (F.sum("edits") / F.sum("ref_len")).alias("micro_cer"),
        F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_chars"),
    )


def error_split(pairs: DataFrame, *by: str, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(substitutions, deletions, insertions, ref_chars, micro, macro) in one pass over the pairs.

    Pairs whose reference is null or empty are left out, and a group that has no others gives no row; a null hypothesis counts as an empty text.
    """
    kinds = ("substitutions", "deletions", "insertions")
    rows = pairs.where(F.length(ref) > 0).select(*by, F.length(ref).cast("long").alias("n"), edit_ops(F.col(ref), F.col(hyp)).alias("ops"))
    total = F.col("ops.substitutions") + F.col("ops.deletions") + F.col("ops.insertions")
    return rows.groupBy(*by).agg(
        *[F.sum(f"ops.{k}").alias(k) for k in kinds], F.sum("n").alias("ref_chars"), (F.sum(total) / F.sum("n")).alias("micro"), F.avg(total / F.col("n")).alias("macro"),
    )


def micro_cer(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All edits over all reference characters."""
    return scored.groupBy(*by).agg((F.sum("edits") / F.sum("ref_len")).alias("micro_cer"), F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_chars"))


def weighted_cer(scored: DataFrame, by: Sequence[str] = (), rounding: str = "floor") -> DataFrame:
    """Row rates times lengths, cut or rounded half-even to whole characters, over all characters."""
    return scored.groupBy(*by).agg(weighted_rate(rounding).alias("weighted_cer"))


def weighted_rate(rounding: str = "floor") -> Column:
    """The same as an aggregate."""
    whole = F.floor(F.col("cer") * F.col("ref_len")) if rounding == "floor" else F.bround(F.col("cer") * F.col("ref_len"), 0)
    return F.sum(whole) / F.sum("ref_len")


def cer_statistics(scored: DataFrame, by: Sequence[str] = (), good_below: float = 0.1) -> DataFrame:
    """Count, mean, median, extremes, population deviation, and how many are perfect or good."""
    c = F.col("cer")
    return scored.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.stddev_pop(c).alias("std"), F.count_if(c == 0).alias("perfect"), F.count_if(c < good_below).alias("good"),
    )


def cer_band(c: Column) -> Column:
    """The error band of a rate: the first bound is met exactly, the others from below."""
    out = F.when(c == BANDS[0][0], BANDS[0][1])
    for bound, label in BANDS[1:-1]:
        out = out.when(c < bound, label)
    return out.otherwise(BANDS[-1][1])


def rollup_cer(scored: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Means by dataset and, under 'all', over every row: datasets weigh by their rows."""
    out = scored.rollup(dataset).agg(F.count(F.lit(1)).alias("n"), F.avg("cer").alias("macro_cer"), (F.sum("edits") / F.sum("ref_len")).alias("micro_cer"), F.grouping(dataset).alias("g"))
    return out.withColumn(dataset, F.when(F.col("g") == 1, "all").otherwise(F.col(dataset))).drop("g")


def field_cer(gt: DataFrame, pred: DataFrame, id_col: str, falsy_as_empty: bool = False) -> DataFrame:
    """(id, path, edits, ref_len, cer) of the fields of the ground truth; fields that only predictions have are ignored."""
    pairs = align_paths(gt, pred, [id_col], "left").withColumn("pred", F.coalesce("pred", F.lit("")))
    if falsy_as_empty:
        blank = lambda c: F.when(F.col(c).isin("false", "0"), "").otherwise(F.col(c))
        pairs = pairs.withColumn("gt", blank("gt")).withColumn("pred", blank("pred"))
    return pair_scores(pairs, "pred", "gt").drop("gt", "pred")


def field_summary(fields: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents, totals): macro and micro rates of a document's fields, then over documents."""
    docs = fields.groupBy(id_col).agg(F.avg("cer").alias("macro"), (F.sum("edits") / F.greatest(F.sum("ref_len"), F.lit(1))).alias("micro"), F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_len"))
    totals = docs.agg(F.count(F.lit(1)).alias("documents"), F.avg("macro").alias("macro"), F.avg("micro").alias("mean_micro"), (F.sum("edits") / F.sum("ref_len")).alias("micro"))
    return docs, totals


def overlap_counts(gt: DataFrame, pred: DataFrame, documents: DataFrame, id_col: str, levels: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(path, threshold, tp, fp, fn) of fields, matched where 1 - CER reaches the threshold.

    A wrong field counts as fp and fn; fields empty on both sides count nowhere; the fields of a document whose
    prediction isn't valid (``documents.valid``) are all fn. The distance is made once for all thresholds, and its
    table never exceeds the band that the lowest of them allows.
    """
    pairs = align_paths(gt.where("value <> ''"), pred.where("value <> ''"), [id_col], "full").join(documents.select(id_col, "valid"), id_col)
    gt_, pred_ = F.coalesce("gt", F.lit("")), F.coalesce("pred", F.lit(""))
    # one more than the lowest threshold allows, so that rounding decides nothing here
    near = edits_within(pred_, gt_, (F.ceil((1 - min(levels)) * F.length(gt_)) + 1).cast("int"))
    pairs = pairs.where("valid OR gt IS NOT NULL").withColumn("edits", F.when(F.col("valid") & (gt_ != "") & (pred_ != ""), near))
    share = F.when(F.col("edits") >= 0, 1 - F.col("edits") / F.length("gt"))
    crossed = pairs.withColumn("share", share).crossJoin(F.broadcast(thresholds(gt.sparkSession, tuple(levels))))  # a row for each threshold
    hit = F.coalesce(F.col("share") >= F.col("threshold"), F.lit(False))
    return crossed.groupBy("path", "threshold").agg(
        F.count_if(hit).alias("tp"),
        F.count_if(~hit & F.col("valid") & F.col("pred").isNotNull()).alias("fp"),
        F.count_if(~hit & F.col("gt").isNotNull()).alias("fn"),
    )


def overlap_scores(counts: DataFrame) -> DataFrame:
    """(threshold, precision, recall, f1): means over fields; f1 is made of these means."""
    rate = lambda c: F.when(F.col("tp") + F.col(c) > 0, F.col("tp") / (F.col("tp") + F.col(c))).otherwise(0.0)
    means = counts.groupBy("threshold").agg(F.avg(rate("fp")).alias("precision"), F.avg(rate("fn")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return means.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def anls_leaves(gt: DataFrame, pred: DataFrame, id_col: str, threshold: float = 0.5) -> DataFrame:
    """(id, path, score, weight): leaf scores over the paths of both sides; a path of one side only scores 0.

    Where the sides have ``items`` (see ``shape.leaves``), two lists score by their best one-to-one matching and weigh
    as many leaves as the longer one has; a list and something else score 0.
    """
    if "items" not in gt.columns:
        pairs = align_paths(gt, pred, [id_col], "full")
        both = F.col("gt").isNotNull() & F.col("pred").isNotNull()
        return pairs.select(id_col, "path", F.when(both, string_anls(F.col("pred"), F.col("gt"), threshold)).otherwise(0.0).alias("score"), F.lit(1).alias("weight"))
    side = lambda d, name: d.select(id_col, "path", F.struct("value", "items").alias(name))
    pairs = side(gt, "gt").join(side(pred, "pred"), [id_col, "path"], "full")
    g, p = F.col("gt.items"), F.col("pred.items")
    lists, texts = g.isNotNull() & p.isNotNull(), g.isNull() & p.isNull()
    matched = list_anls(F.when(lists, p), F.when(lists, g), threshold)
    score = F.when(F.col("gt").isNull() | F.col("pred").isNull(), 0.0).when(lists, matched).when(texts, string_anls(F.col("pred.value"), F.col("gt.value"), threshold)).otherwise(0.0)
    size = lambda x: F.coalesce(F.size(x), F.lit(1))
    return pairs.select(id_col, "path", score.alias("score"), F.greatest(size(g), size(p), F.lit(1)).alias("weight"))


def anls_paths(leaves: DataFrame, id_col: str) -> DataFrame:
    """(id, path, score): every node, inner ones as the mean of the leaves below by their weights, the whole record under ''."""
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    nodes = leaves.select(id_col, F.explode(prefixes).alias("path"), "score", "weight").groupBy(id_col, "path")
    return nodes.agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"))


def validity(rows: DataFrame, valid: Column, by: Sequence[str] = ()) -> DataFrame:
    """(valid, total, rate, text): share of valid predictions, also as ``n/m (p%)``."""
    out = rows.groupBy(*by).agg(F.count_if(valid).alias("valid"), F.count(F.lit(1)).alias("total"))
    out = out.withColumn("rate", F.col("valid") / F.col("total"))
    return out.withColumn("text", F.concat(F.col("valid").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" ("), F.format_string("%.1f", 100 * F.col("rate")), F.lit("%)")))


def structured_cer(pairs: DataFrame, hyp: str, ref: str) -> DataFrame:
    """Rates of the compact strings where both sides are objects, else of the raw texts."""
    from ..functions.jsontext import sorted_string, strict_object

    form = lambda c: F.coalesce(sorted_string(strict_object(F.col(c))), F.col(c))
    return pair_scores(pairs.withColumn(hyp, form(hyp)).withColumn(ref, form(ref)), hyp, ref)


def latency_summary(requests: DataFrame, model: str, latency: str, hit: str) -> DataFrame:
    """(model, requests, mean, median, p95, hit_rate)."""
    x = F.col(latency)
    return requests.groupBy(model).agg(
        F.count(F.lit(1)).alias("requests"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.percentile(x, F.lit(0.95)).alias("p95"),
        F.avg(F.col(hit).cast("double")).alias("hit_rate"),
    )


def made_once(rows: DataFrame, *columns) -> DataFrame:
    """The columns as values: a plain projection is copied to all places that use it, before and behind a Python function."""
    return rows.select(F.explode(F.array(F.struct(*columns))).alias("__made")).select("__made.*")


def two_forms(pairs: DataFrame, hyp: str, ref: str, fold=None) -> DataFrame:
    """Rates of the schema form and the content form side by side, micro over all rows."""
    from ..functions.text import content_only, schema_form

    forms = made_once(pairs, schema_form(F.col(hyp), fold).alias("schema_hyp"), schema_form(F.col(ref), fold).alias("schema_ref"))
    forms = made_once(forms, *forms.columns, *[content_only(F.col(f"schema_{side}")).alias(f"content_{side}") for side in ("hyp", "ref")])
    out = forms.select(*[x for n in ("schema", "content") for x in (edits(F.col(f"{n}_hyp"), F.col(f"{n}_ref")).cast("long").alias(f"{n}_edits"), F.length(f"{n}_ref").cast("long").alias(f"{n}_len"))])
    rate = lambda n: F.col(f"{n}_edits") / F.greatest(F.lit(1), F.col(f"{n}_len"))
    return out.agg(*[x for n in ("schema", "content") for x in ((F.sum(f"{n}_edits") / F.sum(f"{n}_len")).alias(f"{n}_micro"), F.avg(rate(n)).alias(f"{n}_macro"))])
