"""Text scalars: normal forms, line classes, label clean-up. Columns in, columns out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the scripts at hand, beside A-Z and a-z.
LETTERS = "A-Za-zÄÖÜäöüß"


def unicode_norm(text: Column, form: str = "NFC", casefold: bool = False) -> Column:
    """A Unicode normal form, optionally case-folded; Spark has no built-in for either."""

    @F.pandas_udf("string")
    def norm(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None or x.isascii() and not casefold:
                return x
            x = unicodedata.normalize(form, x)
            return x.casefold() if casefold else x

        return s.map(one, na_action="ignore")

    return norm(text)


def strip(text: Column) -> Column:
    """Without white space of any kind, Unicode's too, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    """Runs of white space of any kind to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """NFC, runs of white space to one space, trimmed."""
    return collapse_space(unicode_norm(text, "NFC"))


def schema_form(text: Column, fold=None) -> Column:
    """For scores that count punctuation: folded, hyphenated line breaks joined, no white space."""
    folded = unicode_norm(text, "NFKC", casefold=True) if fold is None else fold(text)
    return F.regexp_replace(F.regexp_replace(folded, r"(?U)-\s*\n\s*", ""), r"(?U)\s+", "")


def content_form(text: Column, fold=None) -> Column:
    """For scores that don't: also without what is no digit, letter or hyphen."""
    return content_only(schema_form(text, fold))


def content_only(form: Column) -> Column:
    """The digits, letters and hyphens of a schema form."""
    return F.regexp_replace(form, r"[^0-9a-zäöüß\-]+", "")


def decimal_comma(text: Column) -> Column:
    """A point between digits becomes a comma."""
    return F.regexp_replace(text, r"(?<=\d)\.(?=\d)", ",")


def file_key(name: Column) -> Column:
    """File names compare without accents, case and kind of slash."""
    bare = F.regexp_replace(unicode_norm(name, "NFKD"), r"\p{M}+", "")
    return F.lower(F.replace(bare, F.lit("\\"), F.lit("/")))


def alnum_count(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"[^\p{L}\p{N}]", ""))


def symbol_share(line: Column) -> Column:
    return F.length(F.regexp_replace(line, rf"[{LETTERS}0-9\s]", "")) / F.greatest(F.lit(1), F.length(line))


def is_noise(line: Column) -> Column:
    """No letters or digits in up to three characters, a single character, or nearly all symbols."""
    alnum, n = alnum_count(line), F.length(F.trim(line))
    return ((alnum == 0) & (n <= 3)) | (n <= 1) | ((symbol_share(line) > 0.85) & (alnum == 0))


def word_count(line: Column) -> Column:
    return F.size(F.array_remove(F.split(F.trim(line), r"\s+"), ""))


def is_paragraph(line: Column) -> Column:
    """Long, or middling with many words or a sentence mark."""
    n = F.length(line)
    return (n >= 75) | ((word_count(line) >= 12) & (n >= 55)) | (line.rlike(r"[.!?]") & (n >= 60))


def is_measurement(line: Column) -> Column:
    """A labelled number (L, B, D, T), three numbers with crosses, centimetres, or two decimal numbers."""
    size = r"\d+(?:,\d+)?"
    return (
        line.rlike(r"[£L]\s*\d") | line.rlike(r"\bB\s*\d") | line.rlike(r"\b(D|T)\s*\d")
        | line.rlike(rf"{size}\s*[xX×]\s*{size}\s*[xX×]\s*{size}")
        | (F.lower(line).contains("cm") & line.rlike(r"\d"))
        | (F.regexp_count(line, F.lit(r"\d+,\d+")) >= 2)
    )


def clean_labels(text: Column) -> Column:
    """One dash, one line end, one spelling of the labels that OCR varies, single spaces."""
    for pattern, to in (
        (r"\r\n?", "\n"), ("[—–]", "-"),
        (r"(?i)\bInv\.\s*Nr\b\.?", "Inv.Nr"), (r"(?i)\bFoto\s*Nr\b\.?", "Foto Nr"),
        (r"(?i)\bVers\.\s*-\s*Wert\b", "Vers.-Wert"), (r"(?i)\bVers\.\s*Wert\b", "Vers.-Wert"),
        (r"[ \t]+", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def label_key(label: Column) -> Column:
    """How labels are looked up: folded, single spaces, no colon."""
    return F.trim(F.replace(collapse_space(F.lower(label)), F.lit(":"), F.lit("")))


def ascii_fold(text: Column) -> Column:
    """Lower-case letters, digits and spaces of ASCII only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")
