"""From OCR boxes to lines, and from lines to fields. State across lines is expressed with windows over (doc, line)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import LETTERS, clean_labels, collapse_space, decimal_comma, is_measurement, is_noise, is_paragraph, label_key, strip
from ..registry import CARD_ALIASES, CARD_FIELDS
from .order import numbered

START, END = "\u0001", "\u0002"


def _join(pieces, sep: str = " "):
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x["text"]), sep)


# -- boxes -----------------------------------------------------------------------------------------------------------


def detections(raw: DataFrame, id_col: str) -> DataFrame:
    """(id, det_id, bbox, text, conf) from the parallel arrays rec_texts, rec_scores and rec_polys.

    A box is four points or more (the first four count) or eight numbers in a row; rows without one are dropped. Where
    ``rec_polys`` is empty, ``dt_polys`` stands in if there is such a column. The arrays may differ in length: a missing text
    is empty, a missing confidence null.
    """
    arrays = {c: F.coalesce(F.col(c), F.expr(f"CAST(array() AS {raw.schema[c].dataType.simpleString()})")) for c in ("rec_texts", "rec_scores", "rec_polys")}
    if "dt_polys" in raw.columns:
        arrays["rec_polys"] = F.when(F.size(arrays["rec_polys"]) > 0, arrays["rec_polys"]).otherwise(F.coalesce("dt_polys", arrays["rec_polys"]))
    rows = raw.select(id_col, *[x.alias(c) for c, x in arrays.items()]).select(id_col, F.posexplode(F.arrays_zip(*arrays)).alias("det_id", "d"))
    poly = F.col("d.rec_polys")
    if isinstance(raw.schema["rec_polys"].dataType.elementType.elementType, ArrayType):
        box = F.when(F.size(poly) >= 4, F.transform(F.slice(poly, 1, 4), lambda p: F.array(p[0], p[1])))
    else:
        box = F.when(F.size(poly) == 8, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(poly[i * 2], poly[i * 2 + 1])))
    out = rows.withColumn("bbox", box).where("bbox IS NOT NULL")
    return out.select(id_col, "det_id", "bbox", F.coalesce("d.rec_texts", F.lit("")).alias("text"), F.col("d.rec_scores").alias("conf"))


def confident(dets: DataFrame, least: float, conf: str = "conf") -> DataFrame:
    """Detections of at least this confidence; one without any passes."""
    return dets.where(F.col(conf).isNull() | (F.col(conf) >= least))


def box_edges(dets: DataFrame) -> DataFrame:
    """Boxes as left edge ``x``, top edge ``y`` and height ``h``."""
    xs, ys = F.transform("bbox", lambda p: p[0]), F.transform("bbox", lambda p: p[1])
    return dets.withColumns({"x": F.array_min(xs), "y": F.array_min(ys), "h": F.array_max(ys) - F.array_min(ys)})


def reading_order(boxes: DataFrame, id_col: str, tolerance: float = 0.7, tie: str = "det_id") -> DataFrame:
    """(id, line_no, line): boxes in order of (y, x); a line ends where y leaves the box before by more than
    ``tolerance`` times the larger height; inside a line boxes go by x."""
    w = Window.partitionBy(id_col).orderBy("y", "x", tie)
    gap = F.abs(F.col("y") - F.lag("y").over(w)) > F.greatest("h", F.lag("h").over(w)) * tolerance
    rows = boxes.withColumn("new", F.when(gap, 1).otherwise(0))
    rows = rows.withColumn("line_no", F.sum("new").over(w))
    return rows.groupBy(id_col, "line_no").agg(_join(F.collect_list(F.struct("x", "y", F.col(tie), "text"))).alias("line"))


def page_text(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, text): the lines of a page joined by line ends."""
    return lines.groupBy(id_col).agg(_join(F.collect_list(F.struct("line_no", F.col("line").alias("text"))), "\n").alias("text"))


# -- lines -----------------------------------------------------------------------------------------------------------


def text_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): lines that aren't blank, with single spaces, numbered from 0."""
    rows = docs.select(id_col, F.posexplode(F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", collapse_space(F.col("line"))).where("line <> ''")
    w = Window.partitionBy(id_col).orderBy("pos")
    return rows.withColumn("line_no", F.row_number().over(w) - 1).select(id_col, "line_no", "line")


def _renumber(lines: DataFrame, id_col: str) -> DataFrame:
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(id_col).orderBy("line_no")) - 1)


def dehyphenate(lines: DataFrame, id_col: str) -> DataFrame:
    """A line that ends with '-' takes the next one if that starts with a small letter; a line taken starts no join.

    In a run of such line breaks every second one joins, which is what taking lines in pairs comes to.
    """
    w = Window.partitionBy(id_col).orderBy("line_no")
    able = F.col("line").endswith("-") & F.coalesce(F.lead("line").over(w).rlike("^[a-zäöüß]"), F.lit(False))
    rows = lines.withColumn("able", able.cast("int"))
    rows = rows.withColumn("start", F.when((F.col("able") == 1) & (F.coalesce(F.lag("able").over(w), F.lit(0)) == 0), F.col("line_no")))
    since = F.col("line_no") - F.last("start", ignorenulls=True).over(w)
    rows = rows.withColumn("joins", (F.col("able") == 1) & (since % 2 == 0))
    rows = rows.withColumn("taken", F.coalesce(F.lag("joins").over(w), F.lit(False)))
    rows = rows.withColumn("piece", F.when(F.col("joins"), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line")))
    rows = rows.withColumn("head", F.sum(F.when(F.col("taken"), 0).otherwise(1)).over(w))
    out = rows.groupBy(id_col, "head").agg(F.min("line_no").alias("line_no"), _join(F.collect_list(F.struct("line_no", F.col("piece").alias("text"))), "").alias("line"))
    return _renumber(out.select(id_col, "line_no", "line"), id_col)


def clean_sheet_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of an inventory sheet: joined at hyphens, decimal commas, noise dropped, numbered anew."""
    lines = dehyphenate(text_lines(docs, id_col, text_col), id_col).withColumn("line", decimal_comma(F.col("line")))
    return _renumber(lines.where(~is_noise(F.col("line"))), id_col)


def line_classes(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.withColumns({"noise": is_noise(line), "paragraph": is_paragraph(line), "measurement": is_measurement(line)})


def natural_order(rows: DataFrame, name: str, place: str = "place") -> DataFrame:
    """The rows with their place from 1 by the first number in the name, then by name; names without a number come first.

    Places come from ranges and their counts, so no task sees all rows.
    """
    numbered_rows = numbered(rows, F.regexp_extract(name, r"(\d+)", 1).try_cast("long").asc_nulls_first(), F.col(name), name=place)
    return numbered_rows.withColumn(place, (F.col(place) + 1).cast("int"))


# -- cards: labels and values ----------------------------------------------------------------------------------------


def _labels() -> list[tuple[str, str]]:
    rows = [(f.lower(), f) for f in CARD_FIELDS] + list(CARD_ALIASES)
    return sorted(rows, key=lambda r: (-len(r[0]), r[0]))


def _quoted(label: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in label)


def canonical(label):
    """The field that a label names, null for none."""
    pairs = [F.lit(x) for row in _labels() for x in row]
    return F.try_element_at(F.create_map(*pairs), label_key(label))


def _fields(pieces: DataFrame, id_col: str) -> DataFrame:
    """(id, key, value): the pieces (line_no, pos, key, text) of each field, joined by spaces."""
    rows = pieces.withColumn("text", strip(F.col("text"))).where("key IS NOT NULL AND text <> ''")
    joined = rows.groupBy(id_col, "key").agg(_join(F.collect_list(F.struct("line_no", "pos", "text"))).alias("value"))
    return joined.withColumn("value", collapse_space(F.col("value")))


def fields_by_span(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A value is the text between a known label and the next one, anywhere in the text; repeats are appended.

    An insurance value that stays empty takes the first amount of money, if the text speaks of one.
    """
    text = clean_labels(F.col(text_col))
    marked = F.regexp_replace(text, rf"(?i)\b({'|'.join(_quoted(x) for x, _ in _labels())})\b\s*:?", f"{START}$1{END}")
    spans = docs.select(id_col, text.alias("whole"), F.posexplode(F.slice(F.split(marked, START), 2, 1_000_000)).alias("pos", "span"))
    value = strip(F.regexp_replace(F.regexp_replace(F.substring_index(F.col("span"), END, -1), r"^[\s\-:]+", ""), r"\s*\n\s*", " "))
    pieces = spans.select(id_col, F.lit(0).alias("line_no"), "pos", canonical(F.substring_index(F.col("span"), END, 1)).alias("key"), value.alias("text"))
    found = _fields(pieces, id_col)
    found = found.withColumn("value", F.when(F.col("key") == "Material", collapse_space(F.regexp_replace("value", r"\s*,\s*", ", "))).otherwise(F.col("value")))
    money = F.regexp_extract(text, r"(?i)\b(\d+[.,]?\d*)\s*(DM|€|EUR)\b", 0)
    worth = docs.select(id_col, F.lit("Vers.-Wert").alias("key"), F.regexp_replace(money, r"(?i)\s*(DM|€|EUR)$", " $1").alias("value")).where(
        (money != "") & F.lower(text).rlike("vers|wert") & F.lower(text).rlike("|".join(_quoted(x) for x, _ in _labels()))
    )
    return found.unionByName(worth.join(found, [id_col, "key"], "left_anti"))


def fields_by_line(lines: DataFrame, id_col: str) -> DataFrame:
    """Several ``label: value`` pairs in a line; a line without one continues the last field of the line before
    with pairs; without such a field, lines with a measure go to the measures."""
    pair = rf"([{LETTERS}.\-\s]{{2,}}?)\s*:\s*([^:]+)"
    keys, values = (F.regexp_extract_all("line", F.lit(pair), F.lit(i)) for i in (1, 2))
    rows = lines.select(id_col, "line_no", "line", F.arrays_zip(keys.alias("k"), values.alias("v")).alias("pairs"))
    rows = rows.withColumn("pairs", F.transform("pairs", lambda p: F.struct(canonical(p["k"]).alias("key"), strip(p["v"]).alias("text"))))
    valid = F.filter("pairs", lambda p: p["key"].isNotNull())
    state = F.when(F.size("pairs") > 0, F.coalesce(F.try_element_at(F.transform(valid, lambda p: p["key"]), F.lit(-1)), F.lit("")))
    w = Window.partitionBy(id_col).orderBy("line_no")
    rows = rows.withColumn("state", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit("")))
    paired = rows.where("size(pairs) > 0").select(id_col, "line_no", F.posexplode("pairs").alias("pos", "p")).select(id_col, "line_no", "pos", "p.key", "p.text")
    follow = F.when(F.col("state") != "", F.col("state")).when(F.col("line").rlike(r"(?i)\b[LBHD]\s*\d"), "Maße")
    more = rows.where("size(pairs) = 0").select(id_col, "line_no", F.lit(0).alias("pos"), follow.alias("key"), F.col("line").alias("text"))
    return _fields(paired.unionByName(more), id_col)


def fields_by_header(lines: DataFrame, id_col: str) -> DataFrame:
    """A label at the start of a line opens a field; lines up to the next header continue it, except those that hold a
    label further in; a fragment that the field already contains is left out."""
    labels = [(x, f) for x, f in _labels() if x not in ("inv-nr", "foto", "vers wert")]
    low = F.lower("line")
    header = F.coalesce(*[F.when(low.rlike(rf"^\s*{_quoted(x)}\s*[:\-]?"), F.struct(F.lit(f).alias("key"), F.lit(_quoted(x)).alias("label"))) for x, f in labels])
    rows = lines.withColumn("h", header)
    w = Window.partitionBy(id_col).orderBy("line_no")
    rows = rows.withColumn("key", F.last("h.key", ignorenulls=True).over(w))
    after = F.trim(F.expr("substr(line, instr(line, ':') + 1)"))
    bare = F.trim(F.expr(r"regexp_replace(lower(line), concat('^\\s*', h.label, '\\s*[:\\-]?\\s*'), '')"))
    own = F.when(F.col("line").contains(":") & (after != ""), after).otherwise(bare)
    inline = low.rlike("|".join(_quoted(x) for x, _ in labels))
    text = collapse_space(F.when(F.col("h").isNotNull(), own).when(~inline, F.col("line")))
    pieces = rows.where("key IS NOT NULL").select(id_col, "key", "line_no", text.alias("text")).where("text <> ''")
    ordered = pieces.groupBy(id_col, "key").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("e"))
    value = F.aggregate("e", F.lit(""), lambda a, x: F.when(a == "", x["text"]).when(F.contains(F.lower(a), F.lower(x["text"])), a).otherwise(F.concat(a, F.lit(" "), x["text"])))
    return ordered.select(id_col, "key", value.alias("value"))


# -- inventory sheets ------------------------------------------------------------------------------------------------


# fixed values: patterns of measures and of inventory numbers, points of tokens and lines, and what they must reach
_SIZE = r"(\d+(?:,\d+)?)"
_CROSS = rf"{_SIZE}\s*[xX×]\s*{_SIZE}\s*[xX×]\s*{_SIZE}"
_LENGTH = rf"[£L]\s*[:=]?\s*{_SIZE}"
_BREADTH = rf"(?i)\bB\s*[:=]?\s*{_SIZE}(\s*cm)?"
_DEPTH = rf"(?i)\b(?:D|T)\s*[:=]?\s*{_SIZE}"
_NUMBER = rf"[{LETTERS}]{{1,3}}=?[{LETTERS}]{{0,4}}\.?[{LETTERS}]{{0,3}}\d{{1,4}}"
_LOOSE_NUMBER = rf"[{LETTERS}0-9=/.\-]{{4,25}}"
TOKEN_LEAST, LINE_LEAST = 10, 8


def _breadth(line):
    value = F.regexp_extract(line, _BREADTH, 1)
    return F.when(F.regexp_extract(line, _BREADTH, 2) != "", F.concat(value, F.lit("cm"))).otherwise(value)


_MEASURES = {"L": lambda line: F.regexp_extract(line, _LENGTH, 1), "B": _breadth, "D": lambda line: F.regexp_extract(line, _DEPTH, 1)}


def measures(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, L, B, D, used): labelled numbers, the first of each, then ``a x b x c`` for those still empty."""
    line, able = F.col("line"), is_measurement(F.col("line"))
    found, cross = {k: v(line) for k, v in _MEASURES.items()}, _CROSS
    first = lambda value, ok: F.min(F.when(ok & (value != ""), F.struct(F.col("line_no"), value.alias("v"))))
    aggs = [first(v, able).alias(f"own_{k}") for k, v in found.items()]
    aggs += [F.min(F.when(line.rlike(cross), F.struct("line_no", *[F.regexp_extract(line, cross, i + 1).alias(k) for i, k in enumerate(found)]))).alias("cross")]
    out = lines.groupBy(id_col).agg(*aggs)
    lacking = F.col("own_L").isNull() | F.col("own_B").isNull() | F.col("own_D").isNull()
    used = F.array_compact(F.array(*[F.col(f"own_{k}.line_no") for k in found], F.when(lacking, F.col("cross.line_no"))))
    return out.select(id_col, *[F.coalesce(f"own_{k}.v", f"cross.{k}", F.lit("")).alias(k) for k in found], F.array_sort(F.array_distinct(used)).alias("used"))


def token_score(token):
    """How much a token looks like an inventory number."""
    n = F.length(token)
    has = lambda c, points: F.when(token.contains(c), points).otherwise(0)
    size = F.when(n.between(6, 14), 10).when(n.between(4, 20), 5).otherwise(-3)
    odd = F.length(F.regexp_replace(token, rf"[{LETTERS}0-9=/.\-]", ""))
    score = has("=", 15) + has(".", 6) + has("/", 4) + size - 5 * odd
    return F.when(token.rlike(f"[{LETTERS}]") & token.rlike(r"\d"), score).otherwise(-999)


def line_score(line):
    """How much a whole line does."""
    line = F.trim(line)
    has = lambda p, points: F.when(line.rlike(p), points).otherwise(0)
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    symbols = F.length(F.regexp_replace(line, rf"[{LETTERS}0-9\s=/.\-]", "")) / F.greatest(F.lit(1), F.length(line))
    score = has(r"\d", 10) + has(f"[{LETTERS}]", 5) + has("=", 20) + has(r"\.", 6) + has("/", 6) - 2 * spaces
    score = score - F.when(F.size(F.split(line, r"\s+")) >= 10, 10).otherwise(0) - has("(?i)fundort|fundzeit", 10) - F.when(symbols > 0.6, 10).otherwise(0)
    return F.when(F.length(line).between(3, 35), score).otherwise(-999)


def _number_tokens(line):
    """Different tokens of a line that may be its number, in order."""
    packed = F.replace(F.trim(line), F.lit(" "), F.lit(""))
    hits = F.regexp_extract_all(packed, F.lit(_NUMBER), F.lit(0))
    loose = F.filter(F.regexp_extract_all(packed, F.lit(_LOOSE_NUMBER), F.lit(0)), lambda t: t.rlike(f"[{LETTERS}]") & t.rlike(r"\d"))
    return F.array_distinct(F.when(F.size(hits) > 0, hits).otherwise(loose))


def inventory_number(lines: DataFrame, id_col: str, upto: int = 10) -> DataFrame:
    """(id, number, line_no): the best token of the first lines, else the best of the last ten lines."""
    sized = lines.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(id_col)))
    tokens = _number_tokens(F.col("line"))
    early = sized.where(F.col("line_no") < F.least("n", F.lit(upto))).select(id_col, "line_no", "n", F.posexplode(tokens).alias("pos", "token"))
    early = early.withColumn("score", token_score(F.col("token")) + F.least("n", F.lit(upto)) - F.col("line_no"))
    best = early.groupBy(id_col).agg(F.min(F.struct(-F.col("score"), "line_no", "pos", F.trim("token").alias("number"))).alias("a"))
    late = sized.where(F.col("line_no") >= F.col("n") - 10).withColumn("score", line_score(F.col("line")) + F.col("line_no"))
    last = late.groupBy(id_col).agg(F.min(F.struct(-F.col("score"), "line_no", F.trim("line").alias("number"))).alias("b"))
    joined = last.join(best, id_col, "left")
    pick = F.when(-F.col("a.col1") >= TOKEN_LEAST, F.struct("a.number", "a.line_no")).when(-F.col("b.col1") >= LINE_LEAST, F.struct("b.number", "b.line_no"))
    return joined.select(id_col, pick.alias("p")).select(id_col, F.coalesce("p.number", F.lit("")).alias("number"), "p.line_no")


def _after_marker(line, marker: str, stops: Sequence[str]):
    rest = F.substring(line, F.instr(F.lower(line), marker.lower()) + len(marker), F.length(line))
    for stop in stops:
        cut = F.instr(F.lower(rest), stop.lower())
        rest = F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)
    return collapse_space(F.regexp_replace(rest, r"^[\s:;\-–—]+", ""))


def marker_value(lines: DataFrame, id_col: str, marker: str, stops: Sequence[str]) -> DataFrame:
    """(id, value, line_no): what follows a marker in the first line that has it, up to the next stop marker."""
    at, value = F.instr(F.lower("line"), marker.lower()), _after_marker(F.col("line"), marker, stops)
    first = lines.where(at > 0).groupBy(id_col).agg(F.min(F.struct("line_no", value.alias("value"))).alias("m"))
    return first.select(id_col, "m.value", "m.line_no")


def _once(value, then):
    """``then`` of a column that is made once, as an element of an array."""
    return F.transform(F.array(value), then)[0]


def sheet_lines(text):
    """The lines of an inventory sheet as one array: joined at hyphens, decimal commas, noise dropped.

    A state goes over the lines: a line that ends with '-' waits for the next one, which it takes if that starts with a small
    letter.
    """
    raw = F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), collapse_space), lambda x: x != "")
    none = F.lit(None).cast("string")
    add = lambda lines, *more: F.concat(lines, F.array(*more))

    def step(a, x):
        waiting, takes = a["open"].isNotNull(), x.rlike("^[a-zäöüß]")
        joined = F.substring(a["open"], F.lit(1), F.length(a["open"]) - 1)
        ends = x.endswith("-")
        return (
            F.when(waiting & takes, F.struct(add(a["lines"], F.concat(joined, x)).alias("lines"), none.alias("open")))
            .when(waiting & ends, F.struct(add(a["lines"], a["open"]).alias("lines"), x.alias("open")))
            .when(waiting, F.struct(add(a["lines"], a["open"], x).alias("lines"), none.alias("open")))
            .when(ends, F.struct(a["lines"].alias("lines"), x.alias("open")))
            .otherwise(F.struct(add(a["lines"], x).alias("lines"), none.alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("lines"), none.alias("open"))
    joined = F.aggregate(raw, start, step, lambda a: F.when(a["open"].isNull(), a["lines"]).otherwise(add(a["lines"], a["open"])))
    return F.filter(F.transform(joined, decimal_comma), lambda x: ~is_noise(x))


def _number_in(lines, upto: int = 10):
    """(number, at) of the best token of the first lines, else of the best of the last ten lines; nulls if neither is good."""
    n = F.size(lines)
    until = F.least(n, F.lit(upto))
    early = F.flatten(F.transform(F.slice(lines, 1, upto), lambda x, i: F.transform(_number_tokens(x), lambda t, p: F.struct((-(token_score(t) + until - i)).alias("less"), i.alias("at"), p.alias("pos"), F.trim(t).alias("number")))))
    first = F.greatest(n - 10, F.lit(0))
    late = F.transform(F.slice(lines, first + 1, F.lit(10)), lambda x, i: F.struct((-(line_score(x) + i + first)).alias("less"), (i + first).alias("at"), F.trim(x).alias("number")))
    void = F.struct(F.lit(None).cast("string").alias("number"), F.lit(None).cast("int").alias("at"))
    pick = lambda b: F.struct(b["number"].alias("number"), b["at"].alias("at"))
    return _once(
        F.struct(F.array_min(early).alias("early"), F.array_min(late).alias("late")),
        lambda b: F.when(-b["early"]["less"] >= TOKEN_LEAST, pick(b["early"])).when(-b["late"]["less"] >= LINE_LEAST, pick(b["late"])).otherwise(void),
    )


def _first(lines, value, able=None):
    """(v, at) of the first line that gives a value which isn't empty."""
    found = F.transform(lines, lambda x, i: F.struct(i.alias("at"), (value(x) if able is None else F.when(able(x), value(x))).alias("v")))
    return F.get(F.filter(found, lambda e: e["v"] != ""), F.lit(0))


def _marked(lines, marker: str, stop: str):
    """(v, at) of what follows a marker in the first line that has it."""
    has = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda e: F.instr(F.lower(e["line"]), marker.lower()) > 0)
    return F.get(F.transform(F.slice(has, 1, 1), lambda e: F.struct(e["at"].alias("at"), _after_marker(e["line"], marker, [stop]).alias("v"))), F.lit(0))


def sheet_records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fields of the sheet): heading, number, measures and markers first; the object's name are up to two of the six
    lines after the last marker that are still free, before any paragraph; the description is what is left.

    Each sheet is one array of lines, over which everything is folded: no exchange, whatever the sheet's length. A sheet
    without lines gives no row.
    """
    sheets = docs.select(id_col, sheet_lines(F.col(text_col)).alias("lines")).where(F.size("lines") > 0)
    lines = F.col("lines")
    own = {k: _first(lines, v, is_measurement) for k, v in _MEASURES.items()}
    cross = F.get(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), *[F.regexp_extract(x, _CROSS, j + 1).alias(k) for j, k in enumerate(own)])), lambda e: e["L"] != ""), F.lit(0))
    found = sheets.select(id_col, "lines", _number_in(lines).alias("number"), *[x.alias(f"own_{k}") for k, x in own.items()], cross.alias("cross"), _marked(lines, "Fundort", "Fundzeit").alias("place"), _marked(lines, "Fundzeit", "Fundort").alias("time"))
    lacking = F.col("own_L").isNull() | F.col("own_B").isNull() | F.col("own_D").isNull()
    taken = F.array_compact(F.array(F.lit(0), "number.at", "place.at", "time.at", *[F.col(f"own_{k}.at") for k in own], F.when(lacking, F.col("cross.at"))))
    known = found.withColumns({"taken": taken, "from": F.coalesce(F.col("time.at") + 1, F.col("place.at") + 1, F.lit(1))})

    def step(a, e):
        """Free lines in order: a name until two are found, a paragraph ends that, or the window does; else description."""
        inside = e["at"].between(F.col("from"), F.col("from") + 5)
        ends = inside & is_paragraph(e["line"])
        name = inside & ~a["over"] & ~ends & (F.size(a["name"]) < 2)
        return F.struct(
            F.when(name, F.concat(a["name"], F.array(e["line"]))).otherwise(a["name"]).alias("name"),
            F.when(name, a["rest"]).otherwise(F.concat(a["rest"], F.array(e["line"]))).alias("rest"),
            (a["over"] | ends).alias("over"),
        )

    free = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda e: ~F.array_contains("taken", e["at"]))
    none = F.array().cast("array<string>")
    out = known.withColumn("folded", F.aggregate(free, F.struct(none.alias("name"), none.alias("rest"), F.lit(False).alias("over")), step))
    blank = lambda c: F.coalesce(c, F.lit(""))
    size = lambda k: blank(F.coalesce(F.col(f"own_{k}.v"), F.col(f"cross.{k}")))
    return out.select(
        id_col, lines[0].alias("heading"), blank(F.col("number.number")).alias("number"), size("L").alias("size_l"), size("B").alias("size_b"), size("D").alias("size_d"),
        collapse_space(F.array_join("folded.name", " ")).alias("object_name"), blank(F.col("place.v")).alias("place"), blank(F.col("time.v")).alias("time"),
        collapse_space(F.array_join("folded.rest", " ")).alias("description"),
    )
