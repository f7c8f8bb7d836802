"""What the operators share: staged tables, files in the shared folder, and word hashing over whole batches.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``; it is shared by the
driver and all executors, so a lost executor loses nothing that was staged.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Bytes looked at together by the word kernel; it bounds the temporary arrays of a task.
BLOCK_BYTES = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster it is an error, as executors and the
    driver share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A random value for each byte at each of the first places of a word; values further on are made when they are needed.
_PLACES = 64
_VALUES = mix(mix(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _far_values(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(mix((place.astype(np.uint64) << np.uint64(8) | byte) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1342543DE82EF95))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes; null texts are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string()) if column.nbytes < 2**31 - 1 else column
    wide = pa.types.is_large_string(column.type)
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, document index) of every word in a block; a word never crosses documents.

    The hash adds up a pseudo-random 64-bit value for each byte and its place, however long the word.
    """
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros(0, np.uint64), none
    space = space[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = ~space
    begin[1:] &= space[:-1] | first[1:n]
    start = np.flatnonzero(begin)
    if not len(start):
        return none, none, np.zeros(0, np.uint64), none
    stop = np.empty(n, bool)
    stop[:-1] = space[1:] | first[1:n]
    stop[-1] = True
    end = np.flatnonzero(stop & ~space) + 1
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    body, void = raw[start[0] :], space[start[0] :]
    place = np.arange(start[0], n, dtype=np.int64) - np.repeat(start, np.diff(np.append(start, n)))
    value = _VALUES[np.minimum(place, _PLACES - 1) << 8 | body]
    far = np.flatnonzero((place >= _PLACES) & ~void)
    if len(far):
        value[far] = _far_values(place[far], body[far])
    value[void] = 0
    code = np.add.reduceat(value, start - start[0])
    return start, end, mix(code + (end - start).astype(np.uint64)), np.searchsorted(offsets, start, "right") - 1


def runs_of(code: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k consecutive words of one document."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9FB21C651E98DF25) + code[i : i + n]
    whole = doc[:n] == doc[k - 1 :]
    return np.flatnonzero(whole), mix(total[whole])


def arrow_rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
