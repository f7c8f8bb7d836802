"""JSON held in text: strict objects, objects inside free text, canonical strings. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import strip

FENCE = "```"
#: A JSON string; possessive, so that long ones need no stack.
_STRING = r'(?s)"(?:[^"\\]++|\\.)*+"'


def is_object(variant: Column, allow_empty: bool = True) -> Column:
    """Whether a variant is an object (not a list, scalar, JSON null or missing)."""
    kind = F.schema_of_variant(variant)
    found = kind.startswith("OBJECT<")
    return F.coalesce(found if allow_empty else found & (kind != "OBJECT<>"), F.lit(False))


def strict_object(text: Column) -> Column:
    """The text as a variant if it is one JSON object and nothing else, otherwise null; of a repeated key the last value counts.

    The parser takes trailing text, so the text is read as the only element of a list; that the text's own brackets don't
    end this list is seen by their depth.
    """
    first = F.try_variant_get(parsed(F.concat(F.lit("["), text, F.lit("]"))), "$[0]", "variant")
    return F.when(is_object(first) & closes_at_end(text), first)


def parsed(text: Column) -> Column:
    """JSON as a variant, null if it is none; of a repeated key the last value counts.

    Spark has a setting for repeated keys and no argument: it is read when the column is made, so it is set here.
    """
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json(text)


def closes_at_end(text: Column) -> Column:
    """Whether the depth of the brackets outside of strings is zero after the last of them and not before."""
    brackets = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]+", "")
    fold = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends")),
        lambda a, c: F.struct(
            (a["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("depth"),
            (a["ends"] + F.when(c.isin("}", "]") & (a["depth"] <= 1), 1).otherwise(0)).alias("ends"),
        ),
        lambda a: (a["depth"] == 0) & (a["ends"] == 1),
    )
    return F.when(brackets == "{}", True).otherwise(fold)


def sorted_string(variant: Column) -> Column:
    """Compact JSON with sorted keys; text that isn't ASCII stays as it is."""
    return F.to_json(variant)


def members(text: Column) -> Column:
    """(key, text, v) of the members of an object in the order of the text: ``text`` keeps the order within, ``v`` tells the kind."""
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    texts, values = F.map_entries(F.from_json(text, "map<string,string>")), F.map_entries(F.from_json(text, "map<string,variant>"))
    every = F.zip_with(texts, values, lambda a, b: F.struct(a["key"].alias("key"), a["value"].alias("text"), b["value"].alias("v")))
    return last_of_each(every, "key")


def last_of_each(entries: Column, name: str) -> Column:
    """Of the structs with one value of a field the last, where the first of them stands."""
    one = lambda es: F.transform(F.array_distinct(F.transform(es, lambda e: e[name])), lambda k: F.element_at(F.filter(es, lambda e: e[name] == k), -1))
    alone = lambda es: F.size(F.array_distinct(F.transform(es, lambda e: e[name]))) == F.size(es)
    # the one-element array makes the entries once
    return F.transform(F.array(entries), lambda es: F.when(alone(es), es).otherwise(one(es)))[0]


def items(text: Column) -> Column:
    """(text, v) of the items of a list."""
    return F.zip_with(F.from_json(text, "array<string>"), F.from_json(text, "array<variant>"), lambda a, b: F.struct(a.alias("text"), b.alias("v")))


def once(value: Column, then) -> Column:
    """``then`` of a column that is made once, as the element of an array."""
    return F.transform(F.array(value), then)[0]


def is_list(variant: Column) -> Column:
    """Whether a variant is a list."""
    return F.coalesce(F.schema_of_variant(variant).startswith("ARRAY<"), F.lit(False))


def leaf_string(v: Column) -> Column:
    """A leaf as text: strings as they are, null as '', everything else as compact JSON."""
    return F.when(F.schema_of_variant(v).isin("VOID"), "").otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), F.lit("")))


def number_text(text: Column) -> Column:
    """A JSON number as Python shows it: whole ones as they are, others by the shortest digits (``1.0``, ``1e-05``)."""
    shown = text.try_cast("double").cast("string")
    part = lambda i: F.regexp_extract(shown, r"^(-?)(\d)\.(\d+)E(-?\d+)$", i)
    power = part(4).try_cast("int")
    digits = F.concat(part(2), F.when(part(3) == "0", "").otherwise(part(3)))
    wide = F.rpad(digits, power + 1, "0")
    behind = F.substring(digits, power + 2, F.length(digits))
    plain = F.concat(part(1), F.when(F.length(digits) > power + 1, F.substring(digits, F.lit(1), power + 1)).otherwise(wide), F.lit("."), F.when(behind == "", "0").otherwise(behind))
    small = F.concat(part(1), F.lit("0.000"), digits)
    far = F.concat(part(1), part(2), F.when(part(3) == "0", "").otherwise(F.concat(F.lit("."), part(3))), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    return (
        F.when(text.rlike(r"^-?\d+$"), F.when(text == "-0", "0").otherwise(text))
        .when(power.isNull(), F.replace(F.lower(shown), F.lit("infinity"), F.lit("inf")))
        .when(power.between(7, 15), plain).when(power == -4, small).otherwise(far)
    )


def is_number(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def shown_leaf(v: Column, text: Column) -> Column:
    """A leaf as text with numbers as Python shows them; ``text`` is the number in the JSON."""
    return F.when(is_number(v), number_text(text)).otherwise(leaf_string(v))


def ordered_string(text: Column, indent: bool = False) -> Column:
    """JSON with the keys of all levels in the order of the text, compact or a top-level key on each line; null if it is no object."""
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    space, before, after = (" ", "\n  ", "\n") if indent else ("", "", "")
    inner = lambda e: F.when(is_object(e["v"]) | is_list(e["v"]), e["text"]).otherwise(F.coalesce(F.to_json(e["v"]), F.lit("null")))
    pairs = F.transform(members(text), lambda e: F.concat(F.lit(before), quoted(e["key"]), F.lit(":" + space), inner(e)))
    whole = F.concat(F.lit("{"), F.array_join(pairs, ","), F.when(F.size(pairs) > 0, after).otherwise(""), F.lit("}"))
    return F.when(strict_object(text).isNotNull(), whole)


def member(variant: Column, key: str, kind: str = "variant") -> Column:
    """A direct member; keys may hold dots, spaces and hyphens."""
    return F.try_variant_get(variant, f'$["{key}"]', kind)


def candidates(text: Column, mode: str, min_keys: int = 0) -> Column:
    """Spans of a text that may be its JSON object, best first, as an array of strings.

    ``fence_strip`` takes the body of a fenced block that opens the text, ``outer_span`` and ``greedy`` go from the
    first brace to the last, ``first_balanced`` ends where the first brace is closed (braces inside strings count),
    ``longest_prefix`` tries every closing brace from the right, ``nested_regex`` takes groups of two brace levels,
    longest first.
    """
    text = strip(text)
    empty = F.array().cast("array<string>")
    first = F.instr(text, "{")
    if mode == "fence_strip":
        body = F.split(text, FENCE)[1]
        body = strip(F.regexp_replace(body, r"^(json)?\s*", ""))
        return F.when(text.startswith(FENCE), F.array(body)).otherwise(F.array(text))
    if mode in ("outer_span", "greedy"):
        return F.when(first > 0, F.array(F.regexp_extract(text, r"(?s)(\{.*\})", 1))).otherwise(empty)
    if mode == "first_balanced":
        # depth after each brace; the span ends at the first brace that brings it back to zero
        braces = F.regexp_replace(F.substring(text, first, F.length(text)), r"[^{}]", "")
        depth = F.aggregate(
            F.split(braces, ""),
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end")),
            lambda a, c: F.struct(
                (a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
                (a["seen"] + F.when(c == "}", 1).otherwise(0)).alias("seen"),
                F.when((a["end"] == 0) & (c == "}") & (a["depth"] == 1), a["seen"] + 1).otherwise(a["end"]).alias("end"),
            ),
        )["end"]
        rest = F.substring(text, first, F.length(text))
        cut = F.concat(F.array_join(F.slice(F.split(rest, r"\}", -1), 1, depth), "}"), F.lit("}"))
        return F.when((first > 0) & (depth > 0), F.array(cut)).otherwise(empty)
    if mode == "longest_prefix":
        rest = F.substring(text, first, F.length(text))
        parts = F.split(rest, r"\}", -1)
        ends = F.when(F.size(parts) > 1, F.reverse(F.sequence(F.lit(1), F.size(parts) - 1))).otherwise(F.array().cast("array<int>"))
        return F.when(first > 0, F.transform(ends, lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "}"), F.lit("}")))).otherwise(empty)
    if mode == "nested_regex":
        found = F.regexp_extract_all(text, F.lit(r"\{(?:[^{}]|\{[^{}]*\})*\}"), F.lit(0))
        return F.array_sort(found, lambda a, b: F.when(F.length(a) == F.length(b), 0).when(F.length(a) > F.length(b), -1).otherwise(1))
    raise ValueError(f"unknown mode {mode!r}")


def extract_object(text: Column, mode: str, on_fail: str = "empty", template: str = "{}", min_keys: int = 0) -> Column:
    """The first candidate span that is a JSON object, or what ``on_fail`` says: '{}', the template, or the raw text."""
    spans = F.filter(candidates(text, mode), lambda s: strict_object(s).isNotNull() & (F.size(F.array_distinct(F.json_object_keys(s))) > min_keys - 1 if min_keys else F.lit(True)))
    failed = {"empty": F.lit("{}"), "template": F.lit(template), "raw": text}[on_fail]
    return F.coalesce(F.get(spans, 0), failed)


def strip_chat_prefix(text: Column) -> Column:
    """What follows the last ``assistant:``, without an ``OCR:`` in front."""
    text = strip(F.regexp_replace(strip(text), r"(?is)^.*assistant:\s*", ""))
    return strip(F.regexp_replace(text, r"(?i)^ocr:\s*", ""))


def unescape_once(text: Column) -> Column:
    """Undo one level of string escapes where at least four escaped quotes (or two twice escaped) show it."""
    quotes = (F.length(text) - F.length(F.replace(text, F.lit('\\"'), F.lit("")))) / 2
    twice = (F.length(text) - F.length(F.replace(text, F.lit('\\\\"'), F.lit("")))) / 3
    plain = F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), "array<string>")[0]
    return F.when((quotes >= 4) | (twice >= 2), F.coalesce(plain, text)).otherwise(text)
