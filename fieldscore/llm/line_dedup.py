"""Line dedup: lines that many documents hold stay in one of them.

Lines are exploded with their position and the hash of their normalised form, distinct documents are counted by hash,
and the positions of hashes over the threshold are left out when each document is put together again.

Cases: a null or empty text is one empty line; a line that repeats inside a document counts once and is
dropped at each place; rows with the same id are one document for counting and each keep their own row; rows
without an id take no part: they count for nothing and keep all lines; an empty table stays empty. Columns
of the input with the names of the operator's results are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, stage

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys up to this number are sent to every task (about 40 bytes each).
BROADCAST_ROWS = 1_000_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the normalised line; None for one shorter than ``min_chars`` code points."""
    key = line.strip(SPACE_BYTES)
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())  # bytes.lower changes A-Z only


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, mark, key, at) from (id, mark, text): each document's distinct keys and the positions of their lines."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys, at = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if text:
                    own: dict[bytes, list[int]] = {}
                    for place, line in enumerate(text.encode().split(b"\n")):
                        if k := line_key(line, min_chars):
                            own.setdefault(k, []).append(place)
                    keys += own
                    at += own.values()
                    row += [i] * len(own)
            which = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(which), batch.column(1).take(which), pa.array(keys, pa.binary()), pa.array(at, pa.list_(pa.int32()))], names=["id", "mark", "key", "at"]
            )

    source = docs.where("id IS NOT NULL").select("id", "mark", "text")
    return source.mapInArrow(explode, f"id {dict(source.dtypes)['id']}, mark long, key binary, at array<int>")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """The documents with their text after dedup, and ``n_lines`` (before) and ``n_dropped``."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    other = [c for c in kept if c != text_col]
    # the other columns travel as one, so no name of the input meets a name used here
    rows = docs.select(F.struct(*other).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    keys = stage(line_keys(rows, min_chars))
    hot = stage(keys.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs))
    # keys of so many documents go to every task, so none of them meets in one; there are at most BROADCAST_ROWS of them
    often = max(min_docs, -(-keys.count() // BROADCAST_ROWS)) if hot.count() > BROADCAST_ROWS else min_docs
    marked = keys.join(F.broadcast(hot.where(F.col("n") >= often)), "key")
    if often > min_docs:
        marked = marked.unionByName(keys.join(hot.where(F.col("n") < often), "key"))
    drops = marked.where("id <> last").groupBy(F.col("id").alias("id2"), F.col("mark").alias("mark2")).agg(F.flatten(F.collect_set("at")).alias("drop"))
    joined = rows.join(drops, (F.col("id") == F.col("id2")) & (F.col("mark") == F.col("mark2")), "left").select("row", "text", "drop")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or ""
                if drop:
                    gone = set(drop)
                    every = text.split("\n")
                    text = "\n".join(x for place, x in enumerate(every) if place not in gone)
                    lines.append(len(every))
                    dropped.append(len(gone))
                else:
                    lines.append(text.count("\n") + 1)
                    dropped.append(0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.column(1).type), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])

    out = joined.mapInArrow(assemble, joined.select("row", "text").schema.add("n_lines", "long").add("n_dropped", "long"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept], "n_lines", "n_dropped")
