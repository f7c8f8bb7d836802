"""Datasets, templates, label aliases and thresholds, as small tables and plain values.

Dimension tables are built from literals here, so their size is fixed by this file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Key names of prediction rows, in the order in which they are tried.
PRED_DICT_KEYS = ("predicted_json", "prediction_json")
PRED_STRING_KEYS = (
    "prediction_string", "predicted_text", "prediction_text", "raw_response",
    "raw_output", "prediction_stripped", "prediction_raw", "prediction",
)
GT_DICT_KEYS = ("target_json", "ground_truth", "gt_json", "ground_truth_fields", "ground_truth_json", "original_data")
GT_STRING_KEYS = ("target_text", "ground_truth_text", "ground_truth", "ground_truth_json_string", "gt_string", "ground_truth_str")

# The fields of a jewellery card, in order.
CARD_FIELDS = (
    "Gegenstand", "Inv.Nr", "Herkunft", "Foto Notes", "Standort", "Material", "Datierung", "Maße", "Gewicht",
    "erworben von", "am", "Preis", "Vers.-Wert", "Beschreibung", "Literatur", "Ausstellungen",
)
# Other spellings of the labels.
CARD_ALIASES = (
    ("inv. nr", "Inv.Nr"), ("inv nr", "Inv.Nr"), ("inv-nr", "Inv.Nr"), ("invnr", "Inv.Nr"),
    ("foto nr", "Foto Notes"), ("foto nr.", "Foto Notes"), ("foto", "Foto Notes"), ("masse", "Maße"),
    ("vers wert", "Vers.-Wert"), ("vers. wert", "Vers.-Wert"), ("vers.wert", "Vers.-Wert"), ("vers-wert", "Vers.-Wert"),
)
# The fields of an inventory sheet.
SHEET_FIELDS = ("Überschrift", "Inventarnummer", "Maße.L", "Maße.B", "Maße.D", "Objektbezeichnung", "Fundort", "Fundzeit", "Beschreibungstext")

THRESHOLDS = (0.8, 0.7, 0.5, 0.3)
#: Upper bounds of error bands, with their labels; the last has none.
BANDS = ((0.0, "perfect"), (0.1, "good"), (0.3, "fair"), (None, "poor"))


@dataclass(frozen=True)
class Dataset:
    """A labelled collection: how its rows are named, what isn't scored, and which fields a record has."""

    name: str
    id_key: str
    excluded: tuple[str, ...]
    fields: tuple[str, ...]


DATASETS = (
    Dataset("inventory", "image_name", ("image_name",), SHEET_FIELDS),
    Dataset("schmuck", "file_name", ("file_name",), CARD_FIELDS),
    Dataset("staircase", "image_name", ("image_name",), ()),
)


def card_aliases(spark: SparkSession) -> DataFrame:
    """(alias, key): every field under its own folded name and its other spellings."""
    rows = [(f.lower(), f) for f in CARD_FIELDS] + list(CARD_ALIASES)
    return spark.createDataFrame(rows, "alias string, key string")


def schema_fields(spark: SparkSession, fields: tuple[str, ...]) -> DataFrame:
    """(position, path) of a template."""
    return spark.createDataFrame(list(enumerate(fields)), "position int, path string")


def thresholds(spark: SparkSession, values: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    return spark.createDataFrame([(float(x),) for x in values], "threshold double")
