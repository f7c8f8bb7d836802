"""Hard-negative mining with cover trees over norm-augmented candidates.

A candidate x of norm n gets one component more, sqrt(top * top - n * n), so that all lie on a sphere of radius ``top``; an
anchor gets a zero there. Inner products don't change, and a candidate within ``r`` of a node's centre c has an inner
product within ``|anchor| * r`` of the centre's. Trees are built on the augmented vectors, level after level: each
level's nodes cover the ones below them with their radius.

1. Rows are cleaned and made integers. Of equal vectors of one label only the smallest ids can be among the first of any
   anchor, so no more of them are kept (``first`` + 1, as an anchor is no partner of its own); equal anchors are asked once.
2. Candidates are dealt to the nearest of a bounded sample of centres (``PIVOTS``, the tree's root level) and by hash to
   blocks of about ``BLOCK_ROWS`` below it; each block is one tree, stored.
3. Anchors are streamed in batches against every block. The descent is best first, for a batch of anchors at once: bounds
   of all levels are carried down, the leaves with the highest bounds are opened first, and what can't hold a row better
   than the last of those that a window has stays closed, like nodes outside of all windows. Opened leaves are verified
   with exact integer products.
4. A first search finds each anchor's rows of its own label, which set the windows; the second finds the rows of other
   labels in these windows. A task keeps what is best over its ``TASK_BLOCKS`` blocks, so a window gets as many rows of
   each task as are wanted at most.

Cases: rows without an id, with a null label, a null vector or a null or non-finite component take no part, nor do empty
vectors; vectors of different lengths have no product and never meet; rows that repeat an id are rows of their own (only the anchor's
row itself is no partner); equal scores go by id; with fewer rows than wanted all are returned;
anchors without positives or with no row in the window give no rows; a component beyond ``LARGEST`` in size counts as
that, so that scores fit a long; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, shared_dir, stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
BLOCK_ROWS = 4096
TASK_BLOCKS = 2
QUERY_BATCH = 256
PIVOTS = 256
LEAF_ROWS = 64
FAN = 16
#: Leaves that are open for an anchor after each wave.
WAVES = (1, 8, 1 << 40)
LARGEST = 1 << 26
UNSEEN = np.iinfo(np.int64).min


def integer_rows(table: DataFrame, label, id_col: str, vec_col: str) -> DataFrame:
    """(id, label, vec) of the rows that take part; ``vec`` are longs."""
    x = F.col(vec_col).cast("array<double>")
    bad = "exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("vec"))
    rows = rows.where(f"id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND NOT {bad}")
    held = f"transform(vec, x -> CAST(floor(greatest(least({SCALE} * x, double({LARGEST})), double(-{LARGEST}))) AS LONG))"
    return rows.select("id", "label", F.expr(held).alias("vec"))


class CoverTree:
    """The candidates of a block below levels of covering centres, a root for each label.

    A node is a centre (a candidate), a radius that covers all candidates below, and the run of its children or, at the
    lowest level, of its rows. Nodes lie level by level, so that a node's children are a run as well.
    """

    FIELDS = "ids binary, vectors binary, label binary, centre binary, radius binary, begin binary, end binary, leaf binary"
    TYPES = (np.int64, np.int64, np.int64, np.int64, float, np.int64, np.int64, bool)

    def __init__(self, ids, vectors, label, centre, radius, begin, end, leaf):
        self.ids, self.vectors, self.label, self.centre, self.radius, self.begin, self.end, self.leaf = ids, vectors, label, centre, radius, begin, end, leaf
        self.floats = vectors.astype(float)
        self.most = float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        self.leaves = np.flatnonzero(leaf)

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> CoverTree:
        norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        top = norms.max()
        lifted = np.column_stack([vectors.astype(float), np.sqrt(np.maximum(0.0, top * top - norms * norms))])
        # from the top: the rows of a node and the place of its centre there; a node splits among centres far from each other
        queue = [(np.flatnonzero(labels == x), 0) for x in np.unique(labels)]
        nodes, rows_out, placed, at = [], [], 0, 0
        while at < len(queue):
            rows, c = queue[at]
            at += 1
            away = np.sqrt(((lifted[rows] - lifted[rows[c]]) ** 2).sum(axis=1))
            if len(rows) <= LEAF_ROWS or away.max() == 0:
                nodes.append((labels[rows[0]], rows[c], away.max(), placed, placed + len(rows), True))
                placed += len(rows)
                rows_out.append(rows)
                continue
            picks, near, own = [c], away, np.zeros(len(rows), np.int64)
            cover = away.max() / 2  # the next level's radius, as far as ``FAN`` centres bring it
            while near.max() > cover and len(picks) < FAN:
                far = int(near.argmax())
                d = np.sqrt(((lifted[rows] - lifted[rows[far]]) ** 2).sum(axis=1))
                own[d < near] = len(picks)
                near = np.minimum(near, d)
                picks.append(far)
            nodes.append((labels[rows[0]], rows[c], away.max(), len(queue), len(queue) + len(picks), False))
            for i, p in enumerate(picks):
                mine = np.flatnonzero(own == i)
                queue.append((rows[mine], int(np.searchsorted(mine, p))))
        order = np.concatenate(rows_out)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        label, centre, radius, begin, end, leaf = (np.array(x, t) for x, t in zip(zip(*nodes, strict=True), cls.TYPES[2:], strict=True))
        return cls(ids[order], vectors[order], label, place[centre], radius, begin, end, leaf)

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in (self.ids, self.vectors, self.label, self.centre, self.radius, self.begin, self.end, self.leaf)]

    @classmethod
    def unpack(cls, *packed: bytes) -> CoverTree:
        ids, vectors, *rest = (np.frombuffer(x, t) for x, t in zip(packed, cls.TYPES, strict=True))
        return cls(ids, vectors.reshape(len(ids), -1), *rest)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) product that rows of each leaf can have with each anchor, by all nodes above it."""
        middle = anchors.astype(float) @ self.floats[self.centre].T
        # a hair wider than the radii, for what doubles lose
        reach = np.sqrt((anchors.astype(float) ** 2).sum(axis=1))[:, None] * self.radius[None, :] * (1 + 1e-9) + 1e-3 + np.abs(middle) * 1e-9
        low, high = middle - reach, middle + reach
        for node in np.flatnonzero(~self.leaf).tolist():
            below = slice(self.begin[node], self.end[node])
            low[:, below] = np.maximum(low[:, below], low[:, node, None])
            high[:, below] = np.minimum(high[:, below], high[:, node, None])
        return low[:, self.leaves], high[:, self.leaves]

    def search(self, anchors: np.ndarray, label: np.ndarray, fewest: np.ndarray, most: np.ndarray, keep: int, same: bool) -> np.ndarray:
        """The products of each anchor with the rows here, ``UNSEEN`` where none was made.

        ``fewest`` and ``most`` are the windows of each anchor. The leaves of the right labels are opened in waves, those
        with the highest bounds first; after each wave those that can't reach the last of a window's first ``keep`` rows
        stay closed, like those outside of all windows.
        """
        doubles = self.most * float(np.abs(anchors).max(initial=0)) < 2**53  # whole numbers that doubles hold exactly
        mine, rows = (anchors.astype(float), self.floats) if doubles else (anchors, self.vectors)
        low, high = self.bounds(anchors)
        score = np.full((len(anchors), len(self.ids)), UNSEEN)
        own = label[:, None] == self.label[self.leaves][None, :]
        closed = own if same else ~own
        order = np.argsort(np.where(closed, -high, np.inf), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        least = fewest
        for wave in WAVES:
            fits = np.zeros_like(closed)
            for j in range(fewest.shape[1]):
                fits |= (high >= least[:, j, None]) & (low <= most[:, j, None])
            opened = closed & fits & (rank < wave)
            closed &= ~opened
            for k in np.flatnonzero(opened.any(axis=0)).tolist():
                some, node = np.flatnonzero(opened[:, k]), self.leaves[k]
                part = slice(self.begin[node], self.end[node])
                score[some, part] = (mine[some] @ rows[part].T).astype(np.int64)
            if wave != WAVES[-1]:
                least = self._least(score, fewest, most, keep)
        return score

    @staticmethod
    def _least(score: np.ndarray, fewest: np.ndarray, most: np.ndarray, keep: int) -> np.ndarray:
        """What a row must reach to be among the first ``keep`` of each window."""
        up = np.sort(score, axis=1)
        out = fewest.copy()
        for i in range(len(score)):
            at = np.searchsorted(up[i], most[i], "right") - keep
            some = at >= 0
            out[i, some] = np.maximum(fewest[i, some], up[i, at[some]])
        return out


_FOUND = "asked long, window long, id long, score long, verified long"


def _search(trees: DataFrame, asked: DataFrame, keep: int, same: bool, tasks: int) -> DataFrame:
    """(asked, window, id, score, verified): for each window of the rows of ``asked`` (asked, label, vec, windows) the
    first ``keep`` rows that each task's trees hold, of the same label or of others."""
    spark = asked.sparkSession
    path = shared_dir(spark)
    asked.select("asked", "label", "vec", "windows").write.parquet(path)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        files = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
        # the packed trees of this task, a few blocks
        own = [[c[i].as_py() for c in batch.columns] for batch in batches for i in range(batch.num_rows)]
        own = [(size, CoverTree.unpack(*packed)) for size, *packed in own]
        for name in files if own else []:
            with store.open_input_file(name) as f:
                for batch in pq.ParquetFile(f).iter_batches(QUERY_BATCH):
                    yield answer(own, batch)

    def answer(own: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[np.zeros(0, np.int64)] for _ in range(5)]
        length = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for size in sorted({s for s, _ in own} & set(length.tolist())):
            part = batch.filter(pa.array(length == size))
            keys, label = part.column(0).to_numpy(), part.column(1).to_numpy()
            vec = part.column(2).flatten().to_numpy().reshape(-1, size)
            windows = part.column(3).to_pylist()
            wide = max(map(len, windows))
            fewest, most = np.full((len(vec), wide), UNSEEN + 1), np.full((len(vec), wide), np.iinfo(np.int64).max)
            for i, ws in enumerate(windows):
                for j in range(wide):
                    if j >= len(ws):  # no such window
                        fewest[i, j], most[i, j] = np.iinfo(np.int64).max, UNSEEN
                    elif ws[j]["fewest"] is not None:
                        fewest[i, j], most[i, j] = ws[j]["fewest"], ws[j]["most"]
            least = fewest.copy()
            held = [[[] for _ in ws] for ws in windows]
            count = np.zeros(len(vec), np.int64)
            for tree in (t for s, t in own if s == size):
                score = tree.search(vec, label, least, most, keep, same)
                count += (score != UNSEEN).sum(axis=1)
                last = tree._least(score, least, most, keep)
                for i, ws in enumerate(held):
                    for j, w in enumerate(ws):
                        found = np.flatnonzero((score[i] >= last[i, j]) & (score[i] <= most[i, j]))
                        w.append((score[i, found], tree.ids[found]))
                least = np.maximum(least, last)
            for i, ws in enumerate(held):
                for j, w in enumerate(ws):
                    score, ids = (np.concatenate(x) for x in zip(*w, strict=True))
                    first = np.lexsort((ids, -score))[:keep]
                    verified = np.zeros(len(first), np.int64)
                    verified[:1] = count[i] if j == 0 else 0
                    for o, x in zip(out, (np.full(len(first), keys[i]), np.full(len(first), j), ids[first], score[first], verified), strict=True):
                        o.append(x)
        return arrow_rows(**{c: np.concatenate(x) for c, x in zip(("asked", "window", "id", "score", "verified"), out, strict=True)})

    return trees.repartition(tasks, "block").drop("block").mapInArrow(search, _FOUND)


def plant_trees(rows: DataFrame, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, size, packed tree) over all ``rows`` (id, label, vec), staged."""
    spark = rows.sparkSession
    sample = rows.select("vec").orderBy(F.xxhash64("id", "label")).limit(pivots).toPandas()["vec"]
    by_size: dict[int, np.ndarray] = {}
    for size in {len(x) for x in sample}:
        by_size[size] = np.stack([x for x in sample if len(x) == size]).astype(float)
    shared = spark.sparkContext.broadcast(by_size)  # ``pivots`` rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            cell = np.zeros(batch.num_rows, np.int64)
            for size, centres in shared.value.items():
                mine = np.flatnonzero(length == size)
                if len(mine):
                    x = batch.column(2).take(pa.array(mine)).flatten().to_numpy().reshape(-1, size).astype(float)
                    cell[mine] = ((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length.astype(np.int32)), pa.array(cell)], names=["id", "label", "vec", "size", "cell"])

    dealt = stage(rows.select("id", "label", "vec").mapInArrow(deal, "id long, label long, vec array<long>, size int, cell long"))
    # near cells share a block, a large one is spread over several; a row for each cell at most
    counts = dealt.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = F.floor(F.coalesce(F.sum("n").over(ahead), F.lit(0)) / block_rows)
    cells = counts.select("size", "cell", first.alias("first"), F.ceil(F.col("n") / block_rows).alias("spread"))
    placed = dealt.join(cells, ["size", "cell"]).withColumn("block", F.xxhash64("size", F.col("first") + F.pmod(F.xxhash64("id", "label", "vec"), F.col("spread"))))

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["id", "label"])
        tree = CoverTree.build(own["id"].to_numpy(), own["label"].to_numpy(), np.stack(own["vec"]))
        return pd.DataFrame([[own["block"].iloc[0], own["size"].iloc[0], *tree.pack()]], columns=["block", "size", *(x.split()[0] for x in CoverTree.FIELDS.split(", "))])

    return stage(placed.groupBy("block", "size").applyInPandas(build, f"block long, size int, {CoverTree.FIELDS}"))


def mine_negatives(
    table: DataFrame, is_anchor, label, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = (LOW, HIGH),
    id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, verified) for the rows that satisfy
    ``is_anchor`` (on column ``id``); ``verified`` counts the rows that the second search compared with the anchor's vector."""
    rows = stage(integer_rows(table, label, id_col, vec_col))
    first = max(positives, negatives) + 1
    # equal vectors of a label stand together; their smallest ids come first for every anchor
    alike = Window.partitionBy("label", F.xxhash64("vec"), "vec").orderBy("id")
    candidates = stage(rows.withColumn("__n", F.row_number().over(alike)).where(F.col("__n") <= first).drop("__n"))
    trees = plant_trees(candidates, pivots, block_rows)
    tasks = max(1, -(-trees.count() // TASK_BLOCKS))
    # equal anchors are asked once
    vectors = rows.where(is_anchor).withColumn("asked", F.xxhash64("label", "vec"))
    asked = stage(vectors.groupBy("asked").agg(F.first("label").alias("label"), F.first("vec").alias("vec")))
    norm = "aggregate(vec, 0L, (a, x) -> a + x * x)"
    window = "array(named_struct('fewest', CAST(NULL AS LONG), 'most', CAST(NULL AS LONG)))"
    found = _search(trees, asked.withColumn("windows", F.expr(window)), positives + 1, True, tasks)
    order = (F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(*order))).where(F.col("rank") <= positives + 1)
    near = stage(ranked.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near")))
    anchors = vectors.select(F.col("id").alias("anchor_id"), "asked", F.expr(norm).alias("norm"))
    # an anchor's own row is no positive of it
    itself = "array_position(transform(near, x -> x.id = anchor_id AND x.score = norm), true)"
    others = f"transform(array({itself}), p -> slice(filter(near, (x, i) -> i + 1 <> p), 1, {positives}))[0]"
    own = anchors.join(near, "asked").select("anchor_id", "asked", F.expr(others).alias("near"))
    pairs = stage(own.select("anchor_id", "asked", F.explode("near").alias("p")).select("anchor_id", "asked", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")))
    # a window for each different score of a vector's positives: from ceil(low * score / 100) to floor(high * score / 100)
    low, high = share
    spans = pairs.where("positive_score >= 0").groupBy("asked").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    windows = F.expr(f"transform(scores, s -> named_struct('fewest', ({low} * s + 99) div 100, 'most', ({high} * s) div 100))")
    again = stage(asked.join(spans, "asked").withColumn("windows", windows))
    below = _search(trees, again, negatives, False, tasks)
    per = Window.partitionBy("asked", "window")
    ranked = below.withColumns({"rank": F.row_number().over(per.orderBy(*order)), "verified": F.sum("verified").over(Window.partitionBy("asked"))}).where(F.col("rank") <= negatives)
    named = ranked.join(again.select("asked", "scores"), "asked").withColumn("positive_score", F.expr("scores[CAST(window AS INT)]"))
    listed = named.groupBy("asked", "positive_score").agg(F.first("verified").alias("verified"), F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("n"))
    out = pairs.join(listed, ["asked", "positive_score"]).withColumn("n", F.explode("n"))
    return out.select(
        "anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        "positive_score", F.col("n.score").alias("negative_score"), "verified",
    )
