"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

1. Columns (n-grams) are dealt to blocks by hash. The size bound says in how many columns a linked pair can differ: with
   twice that many blocks and one, a linked pair has more than half of them equal. A set enters the product with the
   digests of its better half of blocks first; pairs that share none are discarded unseen. A block is better the rarer
   its rarest column is, by a table of ``2 ** ORDER_BITS`` counters over all documents. Any order gives whole results;
   rarity keeps passages that many documents share out of the first half.
2. A set is linked to the smallest set with an equal block. Sets joined by such links are a group; only the rows of a
   group can link.
3. Within a group the product of incidence rows is taken in tiles of bounded rows and bytes. A tile accumulates overlap
   counts column block by column block and discards pairs below ``overlap * (den + num) >= num * (size a + size b)``.
   Tiles of a large group meet only where their sizes allow a link, and first a few leaders of the group: the rows
   that leaders join need no product among themselves.

No step emits the pairs of a group: equal sets are one node, a block gives one link for each other set with it, and a
tile returns only links that join trees it has not yet joined. Sets, columns and words are told apart by 64-bit hashes:
for N different sets the chance that two are taken for one is below N * N / 2**65.

Cases: a text with fewer words than ``n`` is one shingle; a null text or one without words has none, is linked with
nothing and is its own component; a row without an id takes no part: no shingles, no component; rows that repeat an
id or a text keep a row each; an empty table stays empty; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, mix, runs_of, signed, stage, text_blocks, words_of
from .links import components

N = 3
SIMILARITY = (90, 100)
#: Counters of the order of columns: its size is fixed, whatever the input (one byte each is sent to the tasks).
ORDER_BITS = 22
ORDER_CHUNK = 1 << 16
#: Rows and bytes of a tile, and digests that a task looks at together.
TILE_ROWS = 1024
TILE_BYTES = 16 << 20
MATCH_ROWS = 2_000_000
#: Leaders of a group that needs several tiles.
LEADERS = 64
#: Tables with a row for each large group, or a few for each of its sizes, are sent to every task up to this many rows, so
#: that the rows of a group needn't meet to learn them; beyond it Spark joins them and splits what is skewed.
BROADCAST_ROWS = 500_000


def _grams(code: np.ndarray, doc: np.ndarray, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the shingles of a block, repeated ones too."""
    first, gram = runs_of(code, doc, n)
    owner = doc[first]
    count = np.bincount(doc, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short.tolist()):  # the whole text is one shingle
        own = code[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
        total = np.full(1, len(own), np.uint64)
        for x in own:
            total = mix(total + x)
        whole[i] = total[0]
    return np.append(owner, short), np.append(gram, whole)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, document index, hash, rows) of the distinct shingles of runs of texts, sorted by document."""
    for at, raw, offsets in text_blocks(column):
        _, _, code, doc = words_of(raw, offsets, lower=True)
        rows = len(offsets) - 1
        owner, gram = _grams(code, doc, n, rows)
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        keep = np.ones(len(gram), bool)
        keep[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
        yield at, owner[keep], gram[keep], rows


def size_classes(similarity: tuple[int, int], top: int) -> np.ndarray:
    """Smallest size of each class, two beyond ``top``; sizes of a linked pair are in one class or in neighbours."""
    num, den = similarity
    bounds = [1]
    while len(bounds) < 3 or bounds[-3] <= top:
        bounds.append(bounds[-1] * den // num + 1)
    return np.array(bounds, np.int64)


def block_digests(owner: np.ndarray, gram: np.ndarray, level: np.ndarray, rows: int, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, digest) of the column blocks that have to be matched, for pairs whose smaller set is in the
    document's size class or in the one below.

    A pair whose smaller set has ``n`` columns differs in at most ``apart = n * (den - num) // num`` of them. Of
    ``2 * apart + 1`` blocks at least ``apart + 1`` are equal, and the best of these is among the ``apart + 1`` best of
    both sets, as the order depends on a block's columns only.
    """
    num, den = similarity
    size = np.bincount(owner, minlength=rows)
    bounds = size_classes(similarity, int(size.max(initial=0)))
    own_class = np.searchsorted(bounds, size, "right") - 1
    common = level[_counter(gram)]
    high = (mix(gram ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.int64)
    out_doc, out_digest = [], []
    for down in (0, 1):
        k = own_class - down
        apart = (bounds[np.maximum(k, 0) + 1] - 1) * (den - num) // num
        blocks = np.where((k >= 0) & (size > 0), 2 * apart + 1, 0)
        base = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        if not total:
            continue
        here = blocks[owner] > 0
        cell = (base[owner] + (high * blocks[owner] >> 32))[here]
        held = np.bincount(cell, minlength=total)
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, cell, gram[here])
        rarest = np.full(total, 255, np.uint8)
        np.minimum.at(rarest, cell, common[here])
        cell_doc = np.repeat(np.arange(rows), blocks)
        part = np.arange(total) - base[cell_doc]
        digest = mix(mix(sums + held.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) + mix((k[cell_doc] << 32 | part).astype(np.uint64)))
        # 8 levels are a factor of two in rarity; a second and a third column count for some of these; empty blocks are last
        score = np.where(held > 0, 64 + np.maximum(0, 128 - rarest.astype(np.int64)) + 32 * np.minimum(held - 1, 2), 0)
        order = np.lexsort((digest, -score, cell_doc))
        best = order[part < (apart + 1)[cell_doc]]  # ``part`` counts within a document, before and after sorting
        out_doc.append(cell_doc[best])
        out_digest.append(digest[best])
    return (np.concatenate(out_doc), np.concatenate(out_digest)) if out_doc else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def set_codes(owner: np.ndarray, gram: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit code) of each document's set; equal sets are one node of the join."""
    size = np.bincount(owner, minlength=rows)
    sums = np.zeros(rows, np.uint64)
    np.add.at(sums, owner, mix(gram))
    return size, mix(sums + size.astype(np.uint64))


def _counter(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def column_order(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(a level for each counter, n-grams in all): levels grow with the logarithm of what falls on a counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n_held = None, [], 0
        for batch in batches:
            for _, raw, offsets in text_blocks(batch.column(0)):
                _, _, code, doc = words_of(raw, offsets, lower=True)
                held.append(_counter(_grams(code, doc, n, len(offsets) - 1)[1]))
                n_held += len(held[-1])
                if n_held >= MATCH_ROWS:
                    own = np.bincount(np.concatenate(held), minlength=1 << ORDER_BITS)
                    total, held, n_held = own if total is None else total + own, [], 0
        if n_held:
            own = np.bincount(np.concatenate(held), minlength=1 << ORDER_BITS)
            total = own if total is None else total + own
        if total is not None:
            # a task's counts stop at 65,535, which can change the order but no result
            parts = np.minimum(total, 65535).astype(np.uint16).reshape(-1, ORDER_CHUNK)
            yield arrow_rows(chunk=np.arange(len(parts), dtype=np.int32), counts=pa.array([x.tobytes() for x in parts], pa.binary()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most 2 ** ORDER_BITS counters
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, np.uint16).astype(np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        if sums:
            levels = [np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in sums.values()]
            yield arrow_rows(chunk=np.array(list(sums), np.int32), level=pa.array(levels, pa.binary()), n=np.array([x.sum() for x in sums.values()], np.int64))

    made = docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk")
    found = made.mapInArrow(add, "chunk int, level binary, n long").collect()  # a row for each of the fixed chunks
    level = np.zeros(1 << ORDER_BITS, np.uint8)
    for r in found:
        level[r["chunk"] * ORDER_CHUNK : (r["chunk"] + 1) * ORDER_CHUNK] = np.frombuffer(r["level"], np.uint8)
    return level, sum(r["n"] for r in found)


def _heads(gram: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests, the smallest node of each, links of the other nodes to it)."""
    order = np.lexsort((node, gram))
    gram, node = gram[order], node[order]
    lead = np.ones(len(gram), bool)
    lead[1:] = gram[1:] != gram[:-1]
    head = node[lead][np.cumsum(lead) - 1]
    other = head != node
    return gram[lead], node[lead], np.unique(np.stack([head[other], node[other]], 1), axis=0)


_CANDIDATES = "part int, kind int, x long, y long, id long, text_hash long, grams binary, nodes binary"


def _candidates(docs: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """By ``kind``: 0 a row (id, its text's hash, x = set, y = size), 2 a link between sets (x, y) with an equal block."""
    num, den = similarity
    level, total = column_order(docs, n)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(level)  # fixed size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total * (den - num) // num // MATCH_ROWS))
    parts = 8 * tasks

    def rows_of(kind: int, part: np.ndarray, **columns) -> pa.RecordBatch:
        void = {"x": pa.int64(), "y": pa.int64(), "id": pa.int64(), "text_hash": pa.int64(), "grams": pa.binary(), "nodes": pa.binary()}
        given = {c: columns.get(c, pa.nulls(len(part), t)) for c, t in void.items()}
        return arrow_rows(part=part.astype(np.int32), kind=np.full(len(part), kind, np.int32), **given)

    def links_of(links: np.ndarray) -> pa.RecordBatch:
        return rows_of(2, mix(links[:, 0] + mix(links[:, 1])) % np.uint64(parts), x=signed(links[:, 0]), y=signed(links[:, 1]))

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        gram, node, links = _heads(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield links_of(links)
        part = (mix(gram) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        which, count = np.unique(part, return_counts=True)
        cut = pa.py_buffer(np.append(0, np.cumsum(count) * 8).astype(np.int32).tobytes())
        packed = lambda x: pa.Array.from_buffers(pa.binary(), len(which), [None, cut, pa.py_buffer(x[order].tobytes())])
        yield rows_of(1, which, grams=packed(gram), nodes=packed(node))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n_held, n_rows = np.zeros(0, np.uint64), [], 0, 0
        for batch in batches:
            for at, owner, gram, rows in shingle_sets(batch.column(1), n):
                size, node = set_codes(owner, gram, rows)
                # rows are dealt by their place, so that equal texts don't meet
                dealt = mix(np.arange(n_rows, n_rows + rows).astype(np.uint64)) % np.uint64(parts)
                n_rows += rows
                yield rows_of(0, dealt, x=signed(node), y=size, id=batch.column(0).slice(at, rows), text_hash=batch.column(2).slice(at, rows))
                # a set that this task has had brings nothing new
                first = np.zeros(rows, bool)
                first[np.unique(node, return_index=True)[1]] = True
                at_seen = np.searchsorted(seen, node)
                first &= (seen[np.minimum(at_seen, len(seen) - 1)] != node if len(seen) else True) & (size > 0)
                new = np.sort(node[first])
                seen = np.insert(seen, np.searchsorted(seen, new), new) if len(seen) < MATCH_ROWS else new
                mine = first[owner]
                doc, digest = block_digests(owner[mine], gram[mine], shared.value, rows, similarity)
                held.append((digest, node[doc]))
                n_held += len(doc)
                if n_held >= MATCH_ROWS:
                    yield from settle(held)
                    held, n_held = [], 0
        if n_held:
            yield from settle(held)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # digests are spread evenly, and each task before sent one row for each of its own
        held = []
        for batch in batches:
            packed = batch.column(1).to_numpy() == 1
            if not packed.all():
                yield batch.filter(pa.array(~packed))
            if packed.any():
                own = batch.filter(pa.array(packed))
                held += [tuple(np.frombuffer(b"".join(own.column(i).to_pylist()), np.uint64) for i in (6, 7))]
        if held:
            yield links_of(_heads(*(np.concatenate(x) for x in zip(*held, strict=True)))[2])

    text = F.coalesce("text", F.lit(""))
    source = docs.select("id", F.when(F.col("id").isNotNull(), text).otherwise("").alias("text"), F.xxhash64(text).alias("text_hash"))
    made = source.mapInArrow(digests, _CANDIDATES).repartition(tasks, "part").mapInArrow(match, _CANDIDATES)
    return made.select("kind", "x", "y", "id", "text_hash")


def tile_links(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: tuple[int, int]) -> np.ndarray:
    """Index pairs of linked rows in a tile (rows of ``left`` with those of ``right``, or among themselves)."""
    num, den = similarity
    sets = left + (right or [])
    sizes = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    gram = np.concatenate(sets)
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # other columns add to no overlap
    row, column = row[shared], column[shared]
    ids = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    m = len(left)
    overlap = np.zeros((m, len(sets) if right is None else len(right)), np.float32)
    width = max(64, (16 << 20) // (4 * len(sets)))
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):  # block after block of columns
        lo, hi = np.searchsorted(ids, at), np.searchsorted(ids, at + width)
        some = np.zeros((len(sets), min(width, int(ids[hi - 1]) - at + 1)), np.float32)
        some[row[lo:hi], ids[lo:hi] - at] = 1
        overlap += some[:m] @ (some if right is None else some[m:]).T
    other = sizes if right is None else sizes[m:]
    linked = overlap.astype(np.int64) * (den + num) >= num * (sizes[:m, None] + other[None, :])
    if right is None:
        linked = np.triu(linked, 1)
    return np.argwhere(linked)


def _spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """Links enough to join what the given ones join."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            keep.append(i)
    return pairs[keep]


def _small(table: DataFrame) -> DataFrame:
    """The staged table, sent to every task if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _cells_by_size(members: DataFrame, groups: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(x, cell, right) of the rows of groups with several tiles.

    Sizes of a linked pair are in one class or in neighbours, as a class is a little wider than the bound on their
    ratio; tiles are cut within a class. Rows that leaders have joined (``main``) need no tile among themselves.
    """
    num, den = similarity
    k = F.floor(F.log("y") / float(np.log(1.02 * den / num))).cast("int")
    rows = members.join(groups, "grp").withColumn("k", k)
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("y") * 8 / TILE_BYTES)).cast("int")
    parts = stage(rows.groupBy("grp", "k", "main").agg(tiles.alias("tiles")))
    mine = rows.join(_small(parts), ["grp", "k", "main"]).withColumn("tile", F.pmod(F.xxhash64("x"), F.col("tiles")).cast("int")).drop("tiles")
    other = _small(parts).select("grp", F.col("k").alias("k2"), F.col("main").alias("main2"), "tiles")
    met = (
        mine.withColumn("k2", F.explode(F.array(*[F.col("k") + d for d in (-1, 0, 1)]))).join(other, ["grp", "k2"]).where("NOT (main AND main2)")
        .withColumn("tile2", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    )
    a, b = F.struct("k", "main", "tile"), F.struct(F.col("k2").alias("k"), F.col("main2").alias("main"), F.col("tile2").alias("tile"))
    return met.select("x", "id", "text_hash", F.xxhash64("grp", F.least(a, b), F.greatest(a, b)).alias("cell"), (a > b).alias("right"))


def _multiply(docs: DataFrame, placed: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) found in the cells of ``placed`` (id, text_hash, cell, right), enough to join all that are linked."""
    # this side grows with the input, so it is never broadcast
    cells = placed.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list(F.struct("cell", "right")).alias("cells")).hint("merge")
    # texts move once; rows that repeat both id and text are one row of the tile
    hashed = docs.where("id IS NOT NULL AND text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    texts = hashed.join(cells, (F.col("id") == F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("text", "cells")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, owner, gram, rows in shingle_sets(batch.column(0), n):
                size, node = set_codes(owner, gram, rows)
                ends = np.cumsum(size)
                grams = pa.array([gram[e - k : e].tobytes() for e, k in zip(ends, size, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(signed(node)), grams, batch.column(1).slice(at, rows)], names=["x", "grams", "cells"])

    rows = texts.mapInArrow(shingled, "x long, grams binary, cells array<struct<cell: long, right: boolean>>")
    rows = rows.withColumn("c", F.explode("cells")).select(F.col("c.cell").alias("cell"), F.col("c.right").alias("right"), "x", "grams")

    def links_in(cell: list) -> list[tuple[int, int]]:
        sides: tuple[dict, dict] = {}, {}
        for right, x, grams in cell:
            sides[right][x] = np.frombuffer(grams, np.uint64)
        left, right = sides
        if not left or len(left) + len(right) < 2:
            return []
        pairs = tile_links(list(left.values()), list(right.values()) or None, similarity)
        names = [*left, *right]
        if right:
            pairs = pairs + np.array([[0, len(left)]])
        return [(names[p], names[q]) for p, q in _spanning(pairs, len(names))]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, []  # rows come cell by cell; one cell is held
        for batch in batches:
            found = []
            for key, right, x, grams in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != now:
                    found += links_in(cell)
                    now, cell = key, []
                cell.append((right, x, grams))
            yield pairs_of(found)
        yield pairs_of(links_in(cell))

    def pairs_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(found, np.int64).reshape(-1, 2)
        return arrow_rows(a=both[:, 0].copy(), b=both[:, 1].copy())

    return stage(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(multiply, "a long, b long"))


def _product(docs: DataFrame, groups: DataFrame, sets: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) between sets of one group, enough to join all that are linked."""
    # one document stands for each set
    chosen = sets.where("y > 0").groupBy("x").agg(F.min(F.struct("id", "text_hash")).alias("s"), F.first("y").alias("y")).select("x", "y", "s.id", "s.text_hash")
    members = stage(chosen.join(groups.select(F.col("node").alias("x"), F.col("label").alias("grp")), "x"))
    large = F.when((F.count(F.lit(1)) > TILE_ROWS) | (F.sum("y") * 8 > TILE_BYTES), F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("y") * 8 / TILE_BYTES)))
    sized = stage(members.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), large.cast("int").alias("tiles")))
    one_tile = members.join(sized.where("tiles IS NULL").select("grp"), "grp").select("x", "id", "text_hash", F.col("grp").alias("cell"), F.lit(False).alias("right"))
    several = stage(sized.where("tiles IS NOT NULL"))
    if several.isEmpty():
        return _multiply(docs, one_tile, n, similarity)

    # every tile of a large group meets the group's leaders
    rows = members.join(_small(several), "grp")
    leads = F.pmod(F.xxhash64("x", F.lit("lead")), F.ceil(F.col("rows") / LEADERS)) == 0
    tiled = rows.withColumn("leads", leads).withColumn("tile", F.when(F.col("leads"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.pmod(F.xxhash64("x"), F.col("tiles")).cast("int"))))
    met = tiled.withColumn("tile", F.explode("tile")).select("x", "id", "text_hash", F.xxhash64("grp", "tile", F.lit("lead")).alias("cell"), (~F.col("leads")).alias("right"))
    first = _multiply(docs, met.unionByName(one_tile), n, similarity)
    joined = components(first).select(F.col("node").alias("x"), "label")
    # the label that most rows of a group have
    in_large = members.join(_small(several.select("grp")), "grp")
    counts = in_large.join(joined, "x").groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    most = stage(counts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("most")))
    marked = stage(
        in_large.join(joined, "x", "left").join(_small(most), "grp", "left")
        .select("x", "y", "id", "text_hash", "grp", F.coalesce(F.col("label") == F.col("most"), F.lit(False)).alias("main"))
    )
    second = _multiply(docs, _cells_by_size(marked, _small(several.select("grp")), similarity), n, similarity)
    return first.unionByName(second)


def link_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: tuple[int, int] = SIMILARITY, keys: bool = False
) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the smallest id that links reach.

    With ``keys`` also ``text_hash`` (xxhash64 of the text, null as empty) and ``component_key``, which tells components
    apart even where rows of different texts share an id; it is null for rows without shingles.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = stage(_candidates(source, n, similarity))
    sets = made.where("kind = 0")
    groups = components(made.where("kind = 2").select(F.col("x").alias("a"), F.col("y").alias("b")))
    merged = components(_product(source, groups, sets, n, similarity))
    smallest = sets.where("y > 0 AND id IS NOT NULL").groupBy("x").agg(F.min("id").alias("id"))
    named = smallest.join(merged.withColumnRenamed("node", "x"), "x", "left").select("x", F.coalesce("label", "x").alias("label"), "id")
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    final = named.join(least, "label").select(F.col("x").alias("__x"), "component_id", F.col("label").alias("component_key"))
    # rows without shingles have one set and nothing to learn, so they take no part in the join
    void = sets.where("y = 0").withColumns({"component_id": F.lit(None).cast("long"), "component_key": F.lit(None).cast("long")})
    linked = sets.where("y > 0").withColumnRenamed("x", "__x").join(final, "__x", "left").withColumnRenamed("__x", "x")
    out = linked.select(*void.columns).unionByName(void)
    return out.select(
        F.col("id").alias(id_col), F.col("y").alias("n_shingles"),
        F.when(F.col("y") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        *(["text_hash", "component_key"] if keys else []),
    )
