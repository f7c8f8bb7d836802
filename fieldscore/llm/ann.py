"""Approximate nearest neighbours by collision counting over query-centred windows.

Each block of vectors keeps, for every random projection, one sorted array of projected values. These arrays are built
once and stored: the index. For a radius R a query opens a window of ``half * R`` around its own value in each array,
and a vector that falls into enough windows is verified with its exact cosine: one within R does so with a chance of
about 84 %. A query is done when as many vectors as wanted lie within R; for the others the windows grow (virtual
rehashing: R times ``growth``) until they cover everything. A block sends only what lies within R, at most ``k`` rows a
query.

Every block sees all queries, which are streamed from the shared folder in batches; a task holds one block and one
batch. The first radius is the one that should hold three times the wanted neighbours, by the distances among a bounded
sample of rows (``fit_rows``); every row is indexed.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no
part; rows that repeat an id are vectors of their own, each found by and asked for as itself; vectors of different
lengths are never neighbours; ties go to the smaller id; with fewer candidates than wanted all are returned; an empty
table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, shared_dir, stage

PROJECTIONS = 128
#: Width of a window by radius: a vector at the radius falls into 75 % of the windows.
HALF_WIDTH = 1.15
GROWTH = 1.2
#: Standard deviations below the expected number of collisions at which a vector is still verified.
LENIENCE = 1.0
BLOCK_ROWS = 4096
QUERY_BATCH = 1024
FIT_ROWS = 2000
#: The score of rows that only count; below every cosine.
BEHIND = -3.0
SEED = 20240


def clean_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, vec as doubles) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    bad = "exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    rows = table.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    rows = rows.where(f"id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND NOT {bad} AND exists(vec, x -> x <> 0)")
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "vec")


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision, the same for equal vectors wherever they stand."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    q = query / np.abs(query).max()
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * math.sqrt((q * q).sum()))


def axes_of(size: int, projections: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, projections))


class Index:
    """The sorted projections of one block."""

    FIELDS = "row binary, id binary, vectors binary, sorted binary, places binary"

    def __init__(self, row: np.ndarray, ids: np.ndarray, vectors: np.ndarray, values: np.ndarray, places: np.ndarray):
        self.row, self.ids, self.vectors, self.values, self.places = row, ids, vectors, values, places
        self.axes = axes_of(vectors.shape[1], len(values))

    @classmethod
    def build(cls, row: np.ndarray, ids: np.ndarray, vectors: np.ndarray, projections: int) -> Index:
        values = (_units(vectors) @ axes_of(vectors.shape[1], projections)).T
        places = np.argsort(values, axis=1, kind="stable")
        return cls(row, ids, vectors, np.take_along_axis(values, places, 1), places)

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in (self.row, self.ids, self.vectors, self.values, self.places.astype(np.int32))]

    @classmethod
    def unpack(cls, row: bytes, ids: bytes, vectors: bytes, values: bytes, places: bytes) -> Index:
        n = len(row) // 8
        return cls(
            np.frombuffer(row, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(n, -1),
            np.frombuffer(values).reshape(-1, n), np.frombuffer(places, np.int32).reshape(-1, n).astype(np.int64),
        )

    def search(self, row: np.ndarray, queries: np.ndarray, k: int, radius: float, half: float, lenience: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query (places in the block, cosines, vectors verified) of the ``k`` nearest that collide often enough
        and lie within the radius; nothing else ends a query."""
        m, n = self.values.shape
        at = _units(queries) @ self.axes
        hit = math.erf(half / math.sqrt(2))
        need = m * hit - lenience * math.sqrt(m * hit * (1 - hit))
        low = np.stack([np.searchsorted(self.values[p], at[:, p] - half * radius, "left") for p in range(m)])
        high = np.stack([np.searchsorted(self.values[p], at[:, p] + half * radius, "right") for p in range(m)])
        for i, query in enumerate(queries):
            if radius < 2:
                windows = [self.places[p, a:b] for p, a, b in zip(range(m), low[:, i].tolist(), high[:, i].tolist(), strict=True)]
                found = np.flatnonzero(np.bincount(np.concatenate(windows), minlength=n) >= need)
            else:  # no two directions are further apart
                found = np.arange(n)
            found = found[self.row[found] != row[i]]
            score, verified = cosines(self.vectors[found], query), len(found)
            if radius < 2:
                found, score = found[score >= least_cosine(radius)], score[score >= least_cosine(radius)]
            best = np.lexsort((self.row[found], self.ids[found], -score))[:k]
            yield found[best], score[best], verified


def least_cosine(radius: float) -> float:
    """The cosine of two unit vectors at a distance of ``radius``."""
    return 1 - radius * radius / 2


def first_radius(sample: np.ndarray, wanted: float) -> float:
    """The radius within which a share of ``wanted`` of all pairs of a bounded sample lie."""
    if len(sample) < 2:
        return 2.0
    u = _units(sample)
    c = (u @ u.T)[np.triu_indices(len(u), 1)]
    return max(0.05, float(np.sqrt(max(0.0, 2 - 2 * np.quantile(c, 1 - min(1.0, wanted))))))


def nearest(
    table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", projections: int = PROJECTIONS,
    half: float = HALF_WIDTH, growth: float = GROWTH, lenience: float = LENIENCE, block_rows: int = BLOCK_ROWS, fit_rows: int = FIT_ROWS,
    counts: bool = True,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for the rows that satisfy ``is_query`` (on column ``id``).

    With ``counts`` also ``verified``, the number of vectors that the query was compared with, over all radii; it takes
    one more row from each block for each query and radius.
    """
    spark = table.sparkSession
    rows = stage(clean_vectors(table, id_col, vec_col))
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    sample = rows.orderBy(F.xxhash64("row")).limit(fit_rows).toPandas()["vec"]
    widest = sample.map(len).mode()
    radius = first_radius(np.stack([x for x in sample if len(x) == widest[0]]), 3 * k / max(1, n)) if len(sample) else 2.0

    def build(own: pd.DataFrame) -> pd.DataFrame:
        index = Index.build(own["row"].to_numpy(), own["id"].to_numpy(), np.stack(own["vec"]), projections)
        return pd.DataFrame([[own["size"].iloc[0], *index.pack()]], columns=["size", *(x.split()[0] for x in Index.FIELDS.split(", "))])

    spread = F.pmod(F.xxhash64("row"), F.lit(blocks))
    index = stage(rows.withColumn("size", F.size("vec")).groupBy("size", spread).applyInPandas(build, f"size int, {Index.FIELDS}"))

    def search_with(path: str, now: float):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, folder = fs.FileSystem.from_uri(path)
            files = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
            for batch in batches:
                for i in range(batch.num_rows):
                    size, *packed = (c[i].as_py() for c in batch.columns)
                    block = Index.unpack(*packed)
                    for name in files:
                        with store.open_input_file(name) as f:
                            for asked in pq.ParquetFile(f).iter_batches(QUERY_BATCH):
                                yield answer(block, size, asked, now)

        return search

    def answer(block: Index, size: int, asked: pa.RecordBatch, now: float) -> pa.RecordBatch:
        asked = asked.filter(pa.array(asked.column(2).value_lengths().to_numpy(zero_copy_only=False) == size))
        row, ids = asked.column(0).to_numpy(), asked.column(1).to_numpy()
        found = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.int64, float, np.int64)]
        if len(row):
            queries = asked.column(2).flatten().to_numpy().reshape(-1, size)
            for i, (places, score, verified) in enumerate(block.search(row, queries, k, now, half, lenience)):
                made = block.row[places], block.ids[places], score, np.zeros(len(places), np.int64)
                if counts:  # a row of its own, behind all others
                    made = tuple(np.append(x, y) for x, y in zip(made, (-1, 0, BEHIND, verified), strict=True))
                for out, x in zip(found, (np.full(len(made[0]), row[i]), np.full(len(made[0]), ids[i]), *made), strict=True):
                    out.append(x)
        return arrow_rows(**dict(zip(("query", "query_id", "row", "vec_id", "score", "verified"), map(np.concatenate, found), strict=True)))

    left, done = rows.where(is_query), None
    before = None
    while True:
        path = shared_dir(spark)
        left.select("row", "id", "vec").write.parquet(path)
        left = spark.read.schema(rows.schema).parquet(path)
        found = index.repartition(blocks).mapInArrow(search_with(path, radius), "query long, query_id long, row long, vec_id long, score double, verified long")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")))
        if counts:
            ranked = ranked.withColumn("verified", F.sum("verified").over(Window.partitionBy("query")))
        ranked = ranked.where((F.col("rank") <= k) | (F.col("row") < 0) if counts else F.col("rank") <= k)
        if before is not None:
            ranked = ranked.join(before, "query", "left").withColumn("verified", F.col("verified") + F.coalesce("before", F.lit(0))).drop("before")
        ranked = stage(ranked)
        near = ranked.groupBy("query").agg(F.count_if(F.col("row") >= 0).alias("near"), F.first("verified").alias("before"))
        over = near.where(F.col("near") >= k) if radius < 2 else near
        part = ranked.where("row >= 0").join(over.select("query"), "query")
        done = part if done is None else done.unionByName(part)
        if radius >= 2:
            break
        if counts:
            before = stage(near.where(F.col("near") < k).select("query", "before"))
        left = left.join(over.select(F.col("query").alias("row")), "row", "left_anti")
        if left.isEmpty():
            break
        radius = min(2.0, radius * growth)
    return done.select("query_id", F.col("rank").cast("int"), "vec_id", "score", *(["verified"] if counts else []))
