"""Quality classifier by co-training: the text and the metadata of a document each train a classifier.

Both views are sparse logistic models over tokens (the distinct words and the shape of a text; the values of the
metadata and their pairs), fitted on a bounded sample of labelled rows. Over some rounds each view labels all unlabelled
documents that it is sure of for the other: the other counts its tokens over them, with one pass over all documents, and
takes the tokens' log-odds of "good" (their mean and least value in a document) into its next fit. Both views are
calibrated on labelled rows kept aside, combined by a logistic model on yet other rows, and applied to every document.

``labelled_rows`` bounds the labelled sample (those with the smallest hash of their id). Every token counts, in fitting and
in scoring: a view's weights are a table of 2 ** SLOT_BITS places that tokens are hashed to, so its size doesn't follow the
data; tokens that share a place share a weight. Of each kind of label three of five rows fit, one calibrates, one combines;
a step without rows of both kinds keeps its default (log-odds as they are, their sum).

Cases: a label row with a null takes no part; a document with several labels is bad if one says so; repeated
document rows are each scored, and each may pass on its label; a row without an id is unlabelled; a null or empty text has only its shape as content, null metadata is a value of
its own; without labels of both kinds every document gets the share of good labels (1 without labels) and is
accepted if that is at least the threshold; an empty table stays empty; columns of the input with the names of
the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, mix, signed, stage, text_blocks, words_of

LABELLED_ROWS = 10_000
ROUNDS = 2
SURE = 0.97
THRESHOLD = 0.5
#: Places of the tokens' weights, as a power of two; 16 fit into two bytes.
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
PENALTY = 0.002
#: How strongly the weights of told log-odds are held at what they start with.
PULL = 0.01
FOLDS = 5  # of the labelled sample: one for calibration, one for combination, the others for fitting
VIEWS = ("content", "metadata")
RESULTS = ("content_score", "metadata_score", "quality_score", "accepted")

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_GAPS = ~_LETTERS
_KINDS = np.zeros((5, 256), bool)
_KINDS[0, list(b"*%#$&!|<>={}~^_+@")] = True  # marks
_KINDS[1, 65:91] = True  # capitals
_KINDS[2, 48:58] = True  # digits
_KINDS[3, 10] = True  # line ends
_KINDS[4] = True  # code points: bytes that continue none
_KINDS[4, 128:192] = False


# -- tokens ----------------------------------------------------------------------------------------------------------


def _named(name: int, value: np.ndarray) -> np.ndarray:
    return mix(mix(np.floor(value).astype(np.int64).view(np.uint64) + np.uint64(name << 40)))


def content_tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, token) of runs of texts: words of ASCII letters (any case), digits and code points above
    0x7F, and tokens for the shape of the text. A token may come several times."""
    for at, raw, offsets in text_blocks(texts):
        rows = len(offsets) - 1
        _, _, word, doc = words_of(raw, offsets, lower=True, space=_GAPS)
        sums = [np.append(0, np.cumsum(kind[raw]))[offsets] for kind in _KINDS]
        marks, capitals, digits, ends, chars = (x[1:] - x[:-1] for x in sums)
        n_words = np.bincount(doc, minlength=rows)
        distinct = np.bincount(doc[_first_of_pair(doc, word)], minlength=rows)
        chars = np.maximum(chars, 1)
        shape = [
            _named(1, marks / chars / 0.03), _named(2, capitals / chars / 0.1), _named(3, digits / chars / 0.05),
            _named(4, distinct / np.maximum(n_words, 1) / 0.1), _named(5, np.log2(n_words + 1)), _named(6, np.log2(n_words / (ends + 1) + 1)),
        ]
        yield at, rows, np.concatenate([doc, *[np.arange(rows)] * len(shape)]), np.concatenate([word, *shape])


def _first_of_pair(row: np.ndarray, token: np.ndarray) -> np.ndarray:
    """One place for each different pair of row and token."""
    return np.unique(mix(token + mix(row.astype(np.uint64))), return_index=True)[1]


def metadata_tokens(columns: list[pa.Array], size: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the columns other than the text: each value, each pair of values, the size class."""
    rows = len(columns[0]) if columns else len(size)
    values = []
    for i, column in enumerate(columns):
        coded = column.dictionary_encode(null_encoding="encode")
        names = [xxhash.xxh64_intdigest(f"{i}={x}" if x is not None else f"{i}?") for x in coded.dictionary.to_pylist()]
        values.append(np.array(names, np.uint64)[coded.indices.to_numpy()])
    tokens = values + [mix(a + mix(b)) for i, a in enumerate(values) for b in values[:i]]
    if size is not None:
        n = np.maximum(size.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False), 0)
        tokens.append(_named(7, np.log2(n + 1) / 0.5))
    return np.tile(np.arange(rows), len(tokens)), np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)


class Lists:
    """The tokens of some rows: their sorted places in the table of weights, row after row."""

    def __init__(self, row: np.ndarray, token: np.ndarray, rows: int):
        key = np.unique(row << SLOT_BITS | (token >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
        row, self.index = key >> SLOT_BITS, key & (SLOTS - 1)
        self.ends = np.cumsum(np.bincount(row, minlength=rows))
        self.rows = rows

    @classmethod
    def of(cls, column: pa.Array) -> Lists:
        """From a column of lists."""
        self = cls.__new__(cls)
        self.index, self.rows = column.flatten().to_numpy().view(np.uint16).astype(np.int64), len(column)
        self.ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        return self

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(np.append(0, self.ends)))

    def arrow(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, self.ends).astype(np.int32)), pa.array(self.index.astype(np.uint16).view(np.int16)))

    def numbers(self, odds: np.ndarray) -> np.ndarray:
        """The mean and the least log-odds of the tokens of each row; 0 for a row without known tokens."""
        value, count = odds[self.index], np.diff(np.append(0, self.ends))
        out = np.zeros((self.rows, 2))
        some = count > 0
        if some.any():
            starts = (self.ends - count)[some]
            out[some, 0] = np.add.reduceat(value, starts) / count[some]
            out[some, 1] = np.minimum.reduceat(value, starts)
        return out


# -- models ----------------------------------------------------------------------------------------------------------


class Model:
    """Weights of a view's tokens, the log-odds it was told, weights of their mean and least value, an intercept."""

    def __init__(self, size: int):
        self.weight, self.odds, self.more, self.base, self.line = np.zeros(size), np.zeros(size), np.zeros(2), 0.0, [1.0, 0.0]

    def margin(self, lists: Lists) -> np.ndarray:
        total = np.bincount(lists.row, weights=self.weight[lists.index], minlength=lists.rows)
        return total + lists.numbers(self.odds) @ self.more + self.base

    def log_odds(self, lists: Lists) -> np.ndarray:
        """Calibrated."""
        return self.line[0] * np.clip(self.margin(lists), -40, 40) + self.line[1]


def chance(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))


def fit(model: Model, lists: Lists, good: np.ndarray, penalty: float = PENALTY) -> None:
    """A logistic model with an absolute penalty by coordinate descent.

    Most tokens get no weight, so long texts don't add up noise. A token enters when its gradient exceeds the penalty.
    The mean of told log-odds counts once unless the labels say otherwise: told words may stand in no labelled row.
    """
    prior = np.array([1.0, 0.0]) * model.odds.any()
    model.weight[:], model.base, model.more = 0.0, 0.0, prior.copy()
    n, row = lists.rows, lists.row
    order = np.argsort(lists.index, kind="stable")
    by_token, bounds = row[order], np.searchsorted(lists.index[order], np.arange(len(model.weight) + 1))
    numbers = lists.numbers(model.odds)
    for _ in range(30):
        p = chance(model.margin(lists))
        slope = np.maximum(p * (1 - p), 1e-4)
        rest = (good - p) / slope
        pull = np.bincount(lists.index, weights=(good - p)[row], minlength=len(model.weight)) / n
        moved = 0.0
        active = np.flatnonzero((model.weight != 0) | (np.abs(pull) > penalty))
        for _ in range(8):
            largest = abs(step := float((slope * rest).sum() / slope.sum()))
            model.base += step
            rest -= step
            for k in range(2):
                x = numbers[:, k]
                h = float((slope * x * x).mean()) + PULL
                step = (float((slope * x * rest).mean()) - PULL * (model.more[k] - prior[k])) / h
                model.more[k] += step
                rest -= step * x
                largest = max(largest, abs(step))
            for j in active.tolist():
                own = by_token[bounds[j] : bounds[j + 1]]
                h = float(slope[own].sum()) / n
                if not h:
                    continue
                old = model.weight[j]
                u = float((slope[own] * rest[own]).sum()) / n + h * old
                new = math.copysign(max(0.0, abs(u) - penalty), u) / (h + 1e-6)
                if step := new - old:
                    model.weight[j] = new
                    rest[own] -= step
                    largest = max(largest, abs(step))
            moved = max(moved, largest)
            if largest < 1e-2:
                break
        if moved < 2e-2:
            break


def line(x: np.ndarray, good: np.ndarray) -> list[float]:
    """Weights and intercept of a logistic model on a few numbers, by Newton's method; for one kind of label the plain sum."""
    y = good.astype(float)
    if len(np.unique(y)) < 2:
        return [1.0] * x.shape[1] + [0.0]
    x = np.column_stack([np.clip(x, -40, 40), np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([*[1e-3 * len(x)] * (x.shape[1] - 1), 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _told(free: DataFrame, models: list[Model], sure: float) -> list[np.ndarray]:
    """Each view's log-odds of "good" for its tokens, counted over all unlabelled documents that the other view is sure of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a number for each place of the tables, and the documents at the end
        sums = [np.zeros((2, len(m.weight) + 1), np.int64) for m in models]
        for batch in batches:
            lists = [Lists.of(batch.column(i)) for i in range(2)]
            for i, mine in enumerate(lists):
                p = chance(models[1 - i].log_odds(lists[1 - i]))
                for k, told in enumerate((p <= 1 - sure, p >= sure)):
                    sums[i][k, :-1] += np.bincount(mine.index[told[mine.row]], minlength=len(models[i].weight))
                    sums[i][k, -1] += told.sum()
        for i, x in enumerate(sums):
            some = np.flatnonzero(x.any(axis=0))
            yield arrow_rows(view=np.full(len(some), i, np.int32), token=some, bad=x[0, some], good=x[1, some])

    made = free.select(*VIEWS).mapInArrow(count, "view int, token long, bad long, good long")
    sums = made.groupBy("view", "token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()  # a row for each place at most
    out = []
    for i, model in enumerate(models):
        own = sums[sums["view"] == i]
        bad, good = np.zeros(len(model.weight) + 1), np.zeros(len(model.weight) + 1)
        bad[own["token"]], good[own["token"]] = own["bad"], own["good"]
        odds = np.log((good[:-1] + 1) / (good[-1] + 2)) - np.log((bad[:-1] + 1) / (bad[-1] + 2))
        # told of one kind only, a view learns nothing
        out.append(np.clip(odds, -4, 4) if bad[-1] and good[-1] else np.zeros(len(model.weight)))
    return out


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source"),
    size_col: str | None = "n_chars", labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS,
    sure: float = SURE, threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents with both calibrated scores, the combined one, and ``accepted``.

    ``labels`` holds (id, quality, toxic); a document is good if it has quality and is not toxic.
    """
    kept = [c for c in docs.columns if c not in RESULTS]
    used = [F.col(text_col), *[F.col(c).cast("string") for c in meta_cols], *([F.col(size_col).cast("double")] if size_col else [])]
    base = docs.select(F.col(id_col).alias("id"), *[c.alias(f"c{i}") for i, c in enumerate(used)])
    n_meta = len(meta_cols)

    def views_of(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
        """(first row, rows, (row, token) of each view) of runs of rows."""
        for at, rows, row, token in content_tokens(columns[0]):
            part = [c.slice(at, rows) for c in columns[1:]]
            yield at, rows, [(row, token), metadata_tokens(part[:n_meta], part[n_meta] if size_col else None)]

    def flat(value: float) -> DataFrame:
        same = F.lit(float(value))
        return docs.select(*kept, *[same.alias(c) for c in RESULTS[:3]], (same >= threshold).alias("accepted"))

    known = stage(
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col(id_col).alias("known_id")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    )

    def lists_of(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[Lists]]]:
        for at, rows, views in views_of(columns):
            yield at, rows, [Lists(row, token, rows) for row, token in views]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, lists in lists_of(batch.columns[1:]):
                yield arrow_rows(id=batch.column(0).slice(at, rows), content=lists[0].arrow(), metadata=lists[1].arrow())

    kind = dict(base.dtypes)["id"]
    seen = base.mapInArrow(index, f"id {kind}, content array<smallint>, metadata array<smallint>")
    # both sides grow with the input, so they are joined in one way at every size
    seen = stage(seen.join(known.hint("merge"), seen["id"] == known["known_id"], "left").select("id", *VIEWS, "good"))
    # several rows of one labelled document: one of them is enough for fitting
    sample = seen.where("good IS NOT NULL").dropDuplicates(["id"]).orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(labelled_rows)
    sample = sample.select("good", *VIEWS).toArrow().combine_chunks()  # in the order of the hash
    good = sample.column("good").to_numpy().astype(float)
    if len(np.unique(good)) < 2:
        return flat(good.mean() if len(good) else 1.0)
    # dealt in turn, each kind of label on its own
    fold = np.zeros(len(good), np.int64)
    for kind_of in (0, 1):
        own = np.flatnonzero(good == kind_of)
        fold[own] = np.arange(len(own)) % FOLDS

    def part(mask: np.ndarray) -> tuple[list[Lists], np.ndarray]:
        rows = sample.filter(pa.array(mask))
        return [Lists.of(rows.column(v).combine_chunks()) for v in VIEWS], good[mask]

    (train, y_train), (aside, y_aside), (last, y_last) = part((fold != 1) & (fold != 2)), part(fold == 1), part(fold == 2)
    models = [Model(SLOTS) for _ in VIEWS]
    for k in range(rounds + 1):
        if k:
            for model, odds in zip(models, _told(seen.where("good IS NULL"), models, sure), strict=True):
                model.odds = odds
        for model, lists, apart in zip(models, train, aside, strict=True):
            fit(model, lists, y_train)
            model.line = line(model.margin(apart)[:, None], y_aside)
    both = line(np.column_stack([m.log_odds(x) for m, x in zip(models, last, strict=True)]), y_last)

    @F.arrow_udf("struct<content_score: double, metadata_score: double, quality_score: double>")
    def score(*columns: pa.Array) -> pa.Array:
        found = [[m.log_odds(x) for m, x in zip(models, lists, strict=True)] for _, _, lists in lists_of(list(columns))]
        odds = [np.concatenate(x) if found else np.zeros(0) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 2
        total = reduce(lambda a, b: a + b, (w * x for w, x in zip(both, odds, strict=False)), both[-1])
        return pa.StructArray.from_arrays([pa.array(chance(x)) for x in (*odds, np.asarray(total))], names=list(RESULTS[:3]))

    # the row travels as one column, so no name of the input meets a name used here
    out = docs.select(F.struct(*kept).alias("__row"), score(*used).alias("__score"))
    return out.select("__row.*", "__score.*", (F.col("__score.quality_score") >= threshold).alias("accepted"))


def log_loss(p: float, good: bool) -> float:
    """Loss of one score, for held-out checks."""
    return -math.log(max(1e-12, p if good else 1 - p))
