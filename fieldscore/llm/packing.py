"""Best-fit packing into sequences of several permitted lengths.

Items go, longest first, into the open bin that they fill best; where none has room, a bin of the size with the
least cost is opened; at the end each bin shrinks to the smallest permitted length that holds its contents. Each
block of items is packed under every opening rule and the cheapest result stays, so the lengths are chosen jointly.

A task packs its own rows in blocks of ``block`` items: nothing is shuffled and a block is all that is held.

Cases: a document longer than the largest length is cut into pieces, all of them packed; a null or
non-positive length gives one row without a bin; repeated rows and ties are items like any other (ties keep the
order of the input); an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 32
BLOCK = 16384
RESULT = "piece int, n_tokens long, bin_id long, bin_offset long, bin_length long"


def costs_of(lengths: tuple[int, ...], overhead: int) -> dict[int, int]:
    """What a sequence of each length costs: its positions and a fixed part for each sequence."""
    return {n: n + overhead for n in sorted(lengths)}


def pack(sizes: list[int], costs: dict[int, int], widest: int | None) -> tuple[int, list[int], list[int], list[int]]:
    """(cost, bin of each item, offset of each item, length of each bin).

    A new bin has the least cost for each position it offers, among the lengths up to ``widest`` that hold the
    item; an item longer than ``widest`` takes the cheapest length that holds it.
    """
    lengths = list(costs)
    opening = {}
    for low, n in zip([0, *lengths], lengths, strict=False):
        able = [x for x in lengths if x >= n and x <= max(n, widest or n)]
        opening[n] = min(able, key=lambda x: (costs[x] / x, x))
    bins: list[int] = []  # filled so far
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    home, offset = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            b, left = len(bins), opening[lengths[bisect_left(lengths, n)]]
            bins.append(0)
        home[i], offset[i] = b, bins[b]
        bins[b] += n
        if left > n:
            insort(room, (left - n, b))
    final = [lengths[bisect_left(lengths, x)] for x in bins]
    return sum(costs[x] for x in final), home, offset, final


def pack_documents(
    lengths_of: DataFrame, id_col: str = "doc_id", n_col: str = "n_tokens",
    lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, block: int = BLOCK,
) -> DataFrame:
    """A row for each piece: its document, its length, its bin, where it starts there, and the bin's length."""
    costs = costs_of(lengths, overhead)
    top = max(costs)

    def packed(ids: pa.Array, sizes: np.ndarray, first_bin: int) -> tuple[pa.RecordBatch, int]:
        pieces = np.maximum(1, -(-sizes // top))
        row = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.where(piece < pieces[row] - 1, top, sizes[row] - piece * top)
        real = np.flatnonzero(length > 0)
        todo = length[real].tolist()
        _, home, offset, final = min((pack(todo, costs, w) for w in costs), key=lambda x: (x[0], len(x[3])))
        bins, at, size = (np.zeros(len(row), np.int64) for _ in range(3))
        bins[real], at[real] = home, offset
        size[real] = np.array(final, np.int64)[bins[real]]
        void = length <= 0
        arrays = [ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(np.maximum(length, 0))]
        arrays += [pa.array(x, mask=void) for x in (bins + first_bin, at, size)]
        return pa.RecordBatch.from_arrays(arrays, names=["id", *(x.split()[0] for x in RESULT.split(", "))]), len(final)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n = TaskContext.get().partitionId() << 40, [], 0
        for batch in (x.slice(i, block) for x in batches for i in range(0, x.num_rows, block)):
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                out, used = packed(*columns(held), first)
                yield out
                first, held, n = first + used, [], 0
        if n:
            yield packed(*columns(held), first)[0]

    def columns(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return pa.concat_arrays(table.column(0).chunks), table.column(1).fill_null(0).to_numpy().astype(np.int64)

    source = lengths_of.select(F.col(id_col).alias("id"), F.col(n_col).cast("long").alias("n"))
    return source.mapInArrow(run, f"id {source.dtypes[0][1]}, {RESULT}").withColumnRenamed("id", id_col)
