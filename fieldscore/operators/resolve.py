"""From raw prediction lines to resolved objects and strings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import extract_object, is_object, member, parsed, sorted_string, strict_object
from ..functions.text import strip
from ..registry import GT_DICT_KEYS, GT_STRING_KEYS, PRED_DICT_KEYS, PRED_STRING_KEYS


def resolve_dict(row: Column, dict_keys: Sequence[str], string_keys: Sequence[str]) -> Column:
    """The first non-empty object under ``dict_keys``, else the first string under ``string_keys`` that holds one.

    A string may hold an empty object, a member may not.
    """
    direct = [F.when(is_object(member(row, k), allow_empty=False), member(row, k)) for k in dict_keys]
    held = [F.when(F.schema_of_variant(member(row, k)) == "STRING", strict_object(member(row, k, "string"))) for k in string_keys]
    return F.coalesce(*direct, *held)


def resolve_string(row: Column, keys: Sequence[str]) -> Column:
    """The first string that isn't blank, trimmed."""
    text = lambda k: strip(F.when(F.schema_of_variant(member(row, k)) == "STRING", member(row, k, "string")))
    return F.coalesce(*[F.when(text(k) != "", text(k)) for k in keys])


def resolve_rows(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines with ``pred_json``, ``pred_str``, ``gt_json`` and ``gt_str``, whatever key names they use."""
    row = F.col("__row")
    return lines.withColumn("__row", parsed(F.col(raw))).select(
        *lines.columns,
        sorted_string(resolve_dict(row, PRED_DICT_KEYS, PRED_STRING_KEYS)).alias("pred_json"),
        resolve_string(row, PRED_STRING_KEYS).alias("pred_str"),
        sorted_string(resolve_dict(row, GT_DICT_KEYS, GT_STRING_KEYS)).alias("gt_json"),
        resolve_string(row, GT_STRING_KEYS).alias("gt_str"),
    )


def path_taken(pred_json: Column, gt_json: Column, pred_str: Column, gt_str: Column) -> Column:
    """How a row is scored: object against object, text against text, failed, or not at all."""
    return (
        F.when(gt_json.isNotNull() & pred_json.isNotNull(), "json")
        .when(gt_json.isNotNull() & pred_json.isNull(), F.when(pred_str.isNotNull(), "string").otherwise("failed"))
        .when(gt_str.isNotNull() & pred_str.isNotNull(), "string")
        .otherwise("skipped")
    )


def with_errors(rows: DataFrame, text: str, id_col: str, mode: str = "outer_span") -> DataFrame:
    """(id, record, error, raw): the object found in the text, or an error row that keeps the text."""
    found = extract_object(F.col(text), mode, on_fail="empty")
    ok = reduce(lambda a, b: a & b, [F.col(text).isNotNull(), found != "{}"])
    return rows.select(
        F.col(id_col), F.when(ok, found).alias("record"), F.when(~ok, "no object").alias("error"), F.when(~ok, F.col(text)).alias("raw")
    )
