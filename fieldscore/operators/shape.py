"""Records as long tables of dot paths, and back to strings of a fixed shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import is_list, is_number, is_object, items, last_of_each, leaf_string, members, number_text, once, shown_leaf, strict_object
from ..functions.text import strip
from ..registry import schema_fields
from .align import packed


def leaves(rows: DataFrame, id_cols: Sequence[str], json_col: str, open_lists: bool = False) -> DataFrame:
    """(ids, position, path, value, items): one row for each leaf of an object of any depth, numbered in the order of the text.

    An empty object has no leaf. A list is a leaf with its ``items`` as texts; with ``open_lists`` its items are leaves
    under their number instead. Text that isn't one JSON object gives no rows. Where a key with dots makes the path of another
    leaf, the later one counts. Numbers are shown as Python shows them. All levels are opened within the row, as
    often as it has brackets or until nothing is left to open, so the table is read once.
    """
    text, root = F.col(json_col), strict_object(F.col(json_col))
    kinds = ("OBJECT", "ARRAY<") if open_lists else ("OBJECT",)
    # whether there is something to open is seen once, when a node is made
    closed = lambda v: F.coalesce(F.substring(F.schema_of_variant(v), 1, 6).isin(*kinds), F.lit(False))
    node = lambda path, text, v: F.struct(path.alias("path"), text.alias("text"), v.alias("v"), closed(v).alias("closed"))
    below = lambda n, key: F.when(n["path"] == "", key).otherwise(F.concat(n["path"], F.lit("."), key))

    def opened(n: Column) -> Column:
        out = F.when(~n["closed"], F.array(n)).when(is_object(n["v"]), F.transform(members(n["text"]), lambda e: node(below(n, e["key"]), e["text"], e["v"])))
        if open_lists:
            out = out.otherwise(F.transform(items(n["text"]), lambda e, i: node(below(n, i.cast("string")), e["text"], e["v"])))
        return out

    brackets = F.length(text) - F.length(F.translate(text, "{[", ""))
    start = F.struct(F.array(node(F.lit(""), text, root)).alias("nodes"), F.lit(True).alias("more"))

    def level(a: Column, _: Column) -> Column:
        more = F.exists(a["nodes"], lambda n: n["closed"])
        return F.when(a["more"] & more, F.struct(F.flatten(F.transform(a["nodes"], opened)).alias("nodes"), F.lit(True).alias("more"))).otherwise(
            F.struct(a["nodes"].alias("nodes"), F.lit(False).alias("more"))
        )

    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), brackets)), start, level)["nodes"]
    made = rows.where(root.isNotNull()).select(*id_cols, F.posexplode(last_of_each(done, "path")).alias("position", "n"))
    of_list = F.when(is_list(F.col("n.v")), F.transform(items(F.col("n.text")), lambda e: leaf_string(e["v"])))
    return made.select(*id_cols, "position", F.col("n.path").alias("path"), shown_leaf(F.col("n.v"), F.col("n.text")).alias("value"), of_list.alias("items"))


def flatten(rows: DataFrame, id_cols: Sequence[str], json_col: str) -> DataFrame:
    """(ids, path, value): one row for each leaf of an object; lists are leaves, an empty object has none."""
    return leaves(rows, id_cols, json_col).select(*id_cols, "path", "value")


def flatten_typed(rows: DataFrame, id_cols: Sequence[str], json_col: str, paths: Sequence[str]) -> DataFrame:
    """The same for a known template: its paths are read in one pass, without opening levels; absent paths give no row.

    A path with dots is looked up level by level, then as one key of the top level.
    """
    v = strict_object(F.col(json_col))
    at = lambda p, mark: "$" + "".join(f"[{mark}{x}{mark}]" for x in p.split("."))

    def leaf(p: str) -> Column:
        both = lambda mark: dict.fromkeys([at(p, mark), f"$[{mark}{p}{mark}]"])
        found = [F.try_variant_get("v", x, "variant") for x in both('"')]
        texts = [F.get_json_object("text", x) for x in both("'")]
        own = F.coalesce(*found)
        fraction = is_number(own) & (F.schema_of_variant(own) != "BIGINT")
        return F.struct(F.lit(p).alias("path"), own.alias("leaf"), F.when(fraction, F.coalesce(*texts)).alias("number"))

    made = rows.select(*id_cols, v.alias("v"), F.col(json_col).alias("text")).where("v IS NOT NULL")
    out = made.select(*id_cols, F.explode(F.array(*map(leaf, paths))).alias("x")).where("x.leaf IS NOT NULL")
    return out.select(*id_cols, F.col("x.path").alias("path"), F.when(F.col("x.number").isNotNull(), number_text(F.col("x.number"))).otherwise(leaf_string(F.col("x.leaf"))).alias("value"))


def conform(long: DataFrame, id_cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(ids, position, path, value): exactly the fields of the template; what is missing is ''."""
    ids = list(id_cols)
    wanted = F.broadcast(schema_fields(long.sparkSession, tuple(fields)))  # a row for each field of the template
    every = long.select(*ids).distinct().crossJoin(wanted)
    return every.join(long, [*ids, "path"], "left").select(*ids, "position", "path", F.coalesce("value", F.lit("")).alias("value"))


def extras(long: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of paths that the template doesn't have."""
    return long.join(F.broadcast(schema_fields(long.sparkSession, tuple(fields))), "path", "left_anti")


def template_string(conformed: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """(ids, record): a JSON string with the template's keys in the template's order, nested ones as dot paths."""
    entries = F.array_sort(F.collect_list(F.struct("position", "path", "value")))
    pair = lambda x: F.concat(F.to_json(F.array(x["path"])), F.lit(":"), F.to_json(F.array(x["value"])))
    bare = lambda s: F.regexp_replace(s, r'(?<=^|:)\[|\](?=:|$)', "")
    body = F.array_join(F.transform(F.col("e"), lambda x: bare(pair(x))), ",")
    return conformed.groupBy(*id_cols).agg(entries.alias("e")).select(*id_cols, F.concat(F.lit("{"), body, F.lit("}")).alias("record"))


def nested_string(conformed: DataFrame, id_cols: Sequence[str], fields: Sequence[str], inner: Sequence[str]) -> DataFrame:
    """(ids, record): as ``template_string``, with the fields below each name of ``inner`` as an object of its own.

    The object stands where the first of its fields does; dots in other names are part of the name.
    """
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    groups: dict[str, list[str]] = {}
    for f in fields:
        groups.setdefault(next((x for x in inner if f.startswith(x + ".")), f), []).append(f)
    member = lambda key, path: F.concat(quoted(F.lit(key)), F.lit(":"), quoted(F.coalesce(F.try_element_at("by_path", F.lit(path)), F.lit(""))))
    parts = []
    for name, below in groups.items():
        if name in inner:
            own = F.concat_ws(",", *[member(f[len(name) + 1 :], f) for f in below])
            parts.append(F.concat(quoted(F.lit(name)), F.lit(":{"), own, F.lit("}")))
        else:
            parts.append(member(name, name))
    by_path = F.map_from_entries(F.collect_list(F.struct("path", "value")))
    return conformed.groupBy(*id_cols).agg(by_path.alias("by_path")).select(*id_cols, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("record"))


def rename_keys(long: DataFrame, key_map: DataFrame) -> DataFrame:
    """Rename path segments by a table (old, new), at every level."""
    pairs = F.broadcast(packed(key_map, F.map_from_entries(F.collect_list(F.struct("old", "new"))), "names"))  # one row
    renamed = F.array_join(F.transform(F.split("path", r"\."), lambda s: F.coalesce(F.try_element_at("names", s), s)), ".")
    return long.crossJoin(pairs).withColumn("path", renamed).drop("names")


def drop_keys(long: DataFrame, excluded: DataFrame) -> DataFrame:
    """Leave out the top-level keys that ``excluded`` (dataset, key) names for a dataset."""
    top = F.substring_index(F.col("path"), ".", 1)
    return long.withColumn("key", top).join(excluded, ["dataset", "key"], "left_anti").drop("key")


def merge_into_template(long: DataFrame, id_col: str, fields: Sequence[str], id_field: str) -> DataFrame:
    """The template filled from a record, with its id field forced."""
    merged = conform(long, [id_col], fields)
    return merged.withColumn("value", F.when(F.col("path") == id_field, F.col(id_col).cast("string")).otherwise(F.col("value")))


def leaf_text(long: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """(ids, text): all values that aren't blank, stripped, joined by a space; by ``position`` where there is one, else by path."""
    order = "position" if "position" in long.columns else "path"
    rows = long.withColumn("value", strip(F.col("value"))).where("value <> ''").groupBy(*id_cols)
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]), " ").alias("text"))


def field_report(long: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """(ids, report): a markdown table of fields, pipes escaped, true as a tick and false blank."""
    shown = F.when(F.col("value") == "true", "✓").when(F.col("value") == "false", "").otherwise(F.replace("value", F.lit("|"), F.lit("\\|")))
    line = F.concat(F.lit("| "), "path", F.lit(" | "), shown, F.lit(" |"))
    rows = long.withColumn("line", line).groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("e"))
    body = F.array_join(F.transform("e", lambda x: x["line"]), "\n")
    return rows.select(*id_cols, F.concat(F.lit("| Field | Value |\n| --- | --- |\n"), body).alias("report"))


def nested_report(rows: DataFrame, id_cols: Sequence[str], json_col: str) -> DataFrame:
    """(ids, report): markdown of a record of any shape, in the order of the text.

    Single values first, as a table of fields. Then a section for each member that is an object or a list: objects whose
    members are objects with the same keys, and lists of such objects, as a grid (rows of a list are ``#1``, ``#2``);
    other objects as a table of fields; lists of single values as one column; the rest as JSON. Lists within a cell are
    joined by a comma, objects within a cell are JSON.
    """
    escaped = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    inside = lambda v: is_object(v) | is_list(v)

    def shown(v: Column, text: Column) -> Column:
        kind = F.schema_of_variant(v)
        single = F.when(kind == "BOOLEAN", F.when(leaf_string(v) == "true", "✓").otherwise("")).otherwise(leaf_string(v))
        return F.when(is_object(v), text).otherwise(single)

    def cell(e: Column) -> Column:
        parts = items(e["text"])
        flat = is_list(e["v"]) & ~F.exists(parts, lambda x: inside(x["v"]))
        listed = F.array_join(F.transform(parts, lambda x: shown(x["v"], x["text"])), ", ")
        return escaped(F.when(flat, listed).when(is_list(e["v"]), e["text"]).otherwise(shown(e["v"], e["text"])))

    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    table = lambda es: F.concat(F.lit("| Field | Value |\n| --- | --- |\n"), F.array_join(F.transform(es, lambda e: row(F.array(escaped(e["key"]), cell(e)))), ""), F.lit("\n"))

    def grid(named: Column) -> Column:
        """Rows (key, members) with the same keys: the first gives the order."""
        keys = F.transform(named[0]["own"], lambda e: e["key"])
        line = lambda r: row(F.concat(F.array(escaped(r["key"])), F.transform(keys, lambda k: F.transform(F.filter(r["own"], lambda e: e["key"] == k), cell)[0])))
        rule = F.concat(F.lit("| --- | "), F.array_join(F.transform(keys, lambda k: F.lit("---")), " | "), F.lit(" |\n"))
        return F.concat(F.lit("|  | "), F.array_join(F.transform(keys, escaped), " | "), F.lit(" |\n"), rule, F.array_join(F.transform(named, line), ""), F.lit("\n"))

    def alike(named: Column) -> Column:
        keys = lambda r: F.array_sort(F.transform(r["own"], lambda e: e["key"]))
        return (F.size(named) > 0) & (F.size(named[0]["own"]) > 0) & once(keys(named[0]), lambda first: F.forall(named, lambda r: keys(r) == first))

    named = lambda key, text: F.struct(key.alias("key"), members(text).alias("own"))

    def section(e: Column) -> Column:
        objects = lambda es: F.forall(es, lambda x: is_object(x["v"]))
        no_grid = F.lit(None).cast("string")
        grid_of = lambda able, es, name: F.when(able, once(F.transform(es, name), lambda rows: F.when(alike(rows), grid(rows)))).otherwise(no_grid)

        def of_object(own: Column) -> Column:
            fields = F.when(F.size(own) > 0, table(own)).otherwise("")
            return F.coalesce(grid_of(objects(own), own, lambda x: named(x["key"], x["text"])), fields)

        def of_list(parts: Column) -> Column:
            column = F.concat(F.lit("| Value |\n| --- |\n"), F.array_join(F.transform(parts, lambda x: row(F.array(escaped(shown(x["v"], x["text"]))))), ""), F.lit("\n"))
            numbered = lambda x, i: named(F.concat(F.lit("#"), (i + 1).cast("string")), x["text"])
            rest = F.concat(F.lit("```json\n"), e["text"], F.lit("\n```\n\n"))
            return F.when(~F.exists(parts, lambda x: inside(x["v"])), column).otherwise(F.coalesce(grid_of(objects(parts), parts, numbered), rest))

        # members, items and rows of a grid are made once
        body = F.when(is_object(e["v"]), once(members(e["text"]), of_object)).otherwise(once(items(e["text"]), of_list))
        return F.concat(F.lit("#### "), e["key"], F.lit("\n\n"), body)

    made = rows.where(strict_object(F.col(json_col)).isNotNull()).select(*id_cols, members(F.col(json_col)).alias("all"))
    single, other = F.filter("all", lambda e: ~inside(e["v"])), F.filter("all", lambda e: inside(e["v"]))
    head = F.when(F.size(single) > 0, table(single)).otherwise("")
    return made.select(*id_cols, F.concat(head, F.array_join(F.transform(other, section), "")).alias("report"))
