"""Substring dedup by repeated-phrase automata: words inside a window that also occurs earlier are removed.

1. Every window of ``window`` words has one phrase of PHRASE words, the one with the smallest hash, so equal windows have
   equal phrases. A word is 16 bits of its hash, so a phrase is two numbers. Phrases that occur once in the corpus are
   dropped; the others are confirmed to recur, and dealt to the shards of documents that hold them.
2. Each shard compiles an Aho-Corasick automaton of its phrases and streams all its documents through it; this alone
   says where recurring phrases stand. Only windows around these places can recur.
3. Of equal windows (equal phrase and equal 64-bit code of all words) the earliest stays; each other one removes its
   words.

A task settles what recurs within it and passes on one row for each phrase or window, so that a passage in a third of
all documents gives a task no more rows than there are tasks. A shard has about SHARD_BYTES of text, or less; phrases
and windows meet in as many tasks as there are shards, so that a task's rows don't grow with the data.

Cases: a null or empty text has no words; a text shorter than a window loses nothing; rows with the same id and
text are one document and get the same result; rows that share an id with different texts come in the order of
their text's hash; rows without an id take no part and lose nothing; an empty table stays empty; columns of the
input with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, mix, runs_of, shared_dir, signed, text_blocks, words_of

WINDOW = 20
PHRASE = 8
#: Rows that a task sorts together.
CHUNK_ROWS = 2_000_000
SHARD_BYTES = 16 << 20
LAST = np.uint64(2**64 - 1)


def window_phrases(code: np.ndarray, doc: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, place of its phrase)."""
    at, gram = runs_of(code, doc, length)
    hashes = np.full(len(code), LAST, np.uint64)
    hashes[at] = gram
    starts = np.flatnonzero(doc[: max(0, len(doc) - window + 1)] == doc[window - 1 :]) if len(doc) >= window else np.zeros(0, np.int64)
    place, best = starts.copy(), hashes[starts]
    for j in range(1, window - length + 1):
        other = hashes[starts + j]
        less = other < best
        best[less] = other[less]
        place[less] = starts[less] + j
    return starts, place


def letters_of(code: np.ndarray) -> np.ndarray:
    """16 bits for each word; words that share them only bring more windows to be judged."""
    return (code & np.uint64(0xFFFF)).astype(np.uint16)


def text_of(letter: np.ndarray) -> str:
    """Two characters for each word, from two alphabets of 256: no node of an automaton has many branches, and no phrase
    begins inside a word."""
    both = np.stack([1 + (letter >> 8), 257 + (letter & 0xFF)], -1)
    return both.astype("<u4").tobytes().decode("utf-32-le")


def pack(letter: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Phrases of up to eight words as pairs of numbers."""
    out = np.zeros((2, len(place)), np.uint64)
    for j in range(length):
        out[j // 4] = out[j // 4] << np.uint64(16) | letter[place + j].astype(np.uint64)
    return out.view(np.int64)


def unpack(first: np.ndarray, second: np.ndarray, length: int) -> list[str]:
    """The phrases as strings."""
    sizes = min(4, length), max(0, length - 4)
    columns = [x.view(np.uint64) >> np.uint64(16 * (n - 1 - j)) & np.uint64(0xFFFF) for x, n in zip((first, second), sizes, strict=True) for j in range(n)]
    text = text_of(np.stack(columns, 1).astype(np.uint16))
    return [text[i : i + 2 * length] for i in range(0, len(text), 2 * length)]


def _runs(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, rows) of runs of consecutive starts in one document, with equal values of ``more``."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (start[1:] != start[:-1] + 1)
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(ids))).astype(np.int32)


def _known(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place for each key, the first in ``order``; all other places)."""
    key = key[order]
    lead = np.ones(len(key), bool)
    lead[1:] = key[1:] != key[:-1]
    return order[lead], order[~lead]


def _recurring(docs: DataFrame, window: int, length: int, parts: int) -> DataFrame:
    """(first, second, shard): the recurring phrases that a shard's documents hold; they meet in ``parts`` tasks."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            shard = batch.column(1).to_numpy()
            for at, raw, offsets in text_blocks(batch.column(2)):
                _, _, code, doc = words_of(raw, offsets, lower=False)
                place = np.unique(window_phrases(code, doc, window, length)[1])
                kept.append((*pack(letters_of(code), place, length), shard[at + doc[place]]))
                n += len(place)
                if n >= CHUNK_ROWS:
                    yield from settle(kept)
                    kept, n = [], 0
        if n:
            yield from settle(kept)

    def group(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the rows by phrase, marks of the first row of each phrase, rows whose phrase has several)."""
        order = np.lexsort((second, first))
        lead = np.ones(len(order), bool)
        lead[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        number = np.cumsum(lead) - 1
        return order, lead, np.bincount(number)[number] > 1

    def settle(kept: list) -> Iterator[pa.RecordBatch]:
        first, second, shard = (np.concatenate(x) for x in zip(*kept, strict=True))
        order, lead, again = group(first, second)
        one, more = np.sort(order[lead]), order[again]  # neighbours compress well
        yield rows(first[one], second[one], shard[one], False)
        if len(more):
            each = np.unique(np.stack([first[more], second[more], shard[more]], 1), axis=0)
            yield rows(each[:, 0].copy(), each[:, 1].copy(), each[:, 2].astype(np.int32), True)

    def rows(first: np.ndarray, second: np.ndarray, shard: np.ndarray, known: bool) -> pa.RecordBatch:
        return arrow_rows(first=first, second=second, shard=shard, known=np.full(len(shard), known))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = []
        for batch in batches:
            known = batch.column(3)
            yield batch.filter(known).select(["first", "second", "shard"])
            part = batch.filter(pc.invert(known))
            probes.append(tuple(part.column(i).to_numpy() for i in range(3)))
        if probes:
            first, second, shard = (np.concatenate(x) for x in zip(*probes, strict=True))
            del probes
            order, _, again = group(first, second)
            order = order[again]
            yield arrow_rows(first=first[order], second=second[order], shard=shard[order])

    made = docs.select("id", "shard", "text").mapInArrow(held, "first long, second long, shard int, known boolean")
    spread = F.when(F.col("known"), F.xxhash64("first", "second", "shard")).otherwise(F.xxhash64("first", "second"))
    return made.repartition(parts, spread).mapInArrow(meet, "first long, second long, shard int")


def automaton_of(phrases: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for x in phrases:
        automaton.add_word(x)
    automaton.make_automaton()
    return automaton


def locate(automaton: ahocorasick.Automaton, letter: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """At which words a phrase of the automaton begins."""
    here = np.zeros(len(letter), bool)
    if not len(automaton) or not len(letter):
        return here
    ends = np.array([end for end, _ in automaton.iter(text_of(letter))], np.int64)
    at = (ends + 1) // 2 - length
    here[at[doc[at] == doc[at + length - 1]]] = True  # a phrase never crosses documents
    return here


def _repeats(docs: DataFrame, path: str, window: int, length: int, parts: int) -> DataFrame:
    """(id, mark, start, n): runs of windows of a document that occur earlier; ``path`` has the phrases of each shard.

    Windows meet in ``parts`` tasks.
    """

    def load(shard: int) -> ahocorasick.Automaton:
        store, folder = fs.FileSystem.from_uri(f"{path}/shard={shard}")
        found = []
        for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.path.endswith(".parquet"):
                with store.open_input_file(f.path) as source:
                    part = pq.ParquetFile(source).read(["first", "second"])
                found += unpack(part.column(0).to_numpy(), part.column(1).to_numpy(), length)
        return automaton_of(found)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, groups, now, automaton = [], 0, 0, None, None
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for shard in np.unique(batch.column(2).to_numpy()).tolist():  # a partition is a shard
                if shard != now:
                    now, automaton = shard, load(shard)
                own = batch.filter(pc.equal(batch.column(2), shard))
                ids, marks = own.column(0).to_numpy(), own.column(1).to_numpy()
                for at, raw, offsets in text_blocks(own.column(3)):
                    _, _, code, doc = words_of(raw, offsets, lower=False)
                    letter = letters_of(code)
                    starts, place = window_phrases(code, doc, window, length)
                    here = locate(automaton, letter, doc, length)[place]
                    starts, place = starts[here], place[here]
                    at_run, window_code = runs_of(code, doc, window)
                    window_code = window_code[np.searchsorted(at_run, starts)]
                    first_word = np.searchsorted(doc, doc[starts])
                    row = at + doc[starts]
                    first, second = pack(letter, place, length).view(np.uint64)
                    phrase = mix(mix(first) + second)
                    kept.append((window_code, ids[row], marks[row], (starts - first_word).astype(np.int32), phrase, place + groups))
                    n, groups = n + len(starts), groups + len(code)
                    if n >= CHUNK_ROWS:
                        yield from settle(kept)
                        kept, n, groups = [], 0, 0
        if n:
            yield from settle(kept)

    def earliest(phrase: np.ndarray, code: np.ndarray, ids: np.ndarray, marks: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the earliest place of each window, all later ones), each in the order of documents; the same place twice counts once."""
        order = np.lexsort((start, marks, ids, code, phrase))
        p, c, i, m, s = (x[order] for x in (phrase, code, ids, marks, start))
        new = np.ones(len(order), bool)
        new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
        same = np.zeros(len(order), bool)
        same[1:] = ~new[1:] & (i[1:] == i[:-1]) & (m[1:] == m[:-1]) & (s[1:] == s[:-1])
        in_order = lambda x: x[np.lexsort((start[x], marks[x], ids[x]))]
        return in_order(order[new]), in_order(order[~new & ~same])

    def gone(ids: np.ndarray, marks: np.ndarray, start: np.ndarray) -> dict:
        first, n = _runs(ids, marks, start)
        return {"id": ids[first], "mark": marks[first], "start": start[first], "n": n}

    def settle(kept: list) -> Iterator[pa.RecordBatch]:
        code, ids, marks, start, phrase, place = (np.concatenate(x) for x in zip(*kept, strict=True))
        one, more = earliest(phrase, code, ids, marks, start)
        code, i, m, s = code[one], ids[one], marks[one], start[one]
        first, n = _runs(i, m, s, place[one])
        cut = np.append(np.append(0, np.cumsum(n)[:-1]), len(code)) * 8
        codes = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(code.tobytes())])
        yield arrow_rows(phrase=signed(phrase[one][first]), id=i[first], mark=m[first], start=s[first], n=n, codes=codes)
        if len(more):
            out = gone(ids[more], marks[more], start[more])
            yield arrow_rows(phrase=signed(mix(out["id"].astype(np.uint64))), **out, codes=pa.nulls(len(out["n"]), pa.binary()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = []
        for batch in batches:
            yield batch.filter(batch.column(5).is_null()).select(["id", "mark", "start", "n"])
            part = batch.filter(batch.column(5).is_valid())
            if part.num_rows:
                n = part.column(4).to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                code = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint64)
                start = part.column(3).to_numpy()[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                probes.append((part.column(0).to_numpy()[row], code, part.column(1).to_numpy()[row], part.column(2).to_numpy()[row], start))
        if probes:
            phrase, code, ids, marks, start = (np.concatenate(x) for x in zip(*probes, strict=True))
            del probes
            _, more = earliest(phrase, code, ids, marks, start)
            yield arrow_rows(**gone(ids[more], marks[more], start[more]))

    # equal windows have equal phrases, so a phrase's windows travel as one row
    made = docs.select("id", "mark", "shard", "text").mapInArrow(windows, "phrase long, id long, mark int, start int, n int, codes binary")
    return made.repartition(parts, "phrase").mapInArrow(judge, "id long, mark int, start int, n int")


def dedup_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the kept words (joined by one space) as their text, ``n_words`` and ``n_removed``."""
    docs = docs.drop(*[c for c in ("n_words", "n_removed") if c in docs.columns])
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    other = [F.col(c).alias(f"c{i}") for i, c in enumerate(names) if c not in (id_col, text_col)]
    source = docs.select(*other, F.col(id_col).cast("long").alias("id"), F.hash(text).alias("mark"), text.alias("text"))
    spark, length = docs.sparkSession, max(1, min(PHRASE, window // 2))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # the shard of a row is its partition below
    sharded = source.withColumn("doc_key", F.xxhash64("id", "mark")).withColumn("shard", F.pmod(F.hash("doc_key"), F.lit(shards)).cast("int"))
    path = shared_dir(spark)
    _recurring(sharded, window, length, shards).distinct().repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    placed = sharded.repartition(shards, "doc_key")
    repeats = _repeats(placed, path, window, length, shards)
    lists = repeats.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct("start", "n")).alias("found"))
    lists = lists.withColumn("__key", F.xxhash64("__id", "__mark"))
    # on the key that the texts are placed by: Spark moves them once for both
    same = (F.col("doc_key") == F.col("__key")) & (F.col("id") == F.col("__id")) & (F.col("mark") == F.col("__mark"))
    joined = placed.join(lists, same, "left").drop("__id", "__mark", "__key", "mark", "doc_key", "shard")
    place = joined.columns.index("text")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words, removed = [], [], []
            found = batch.column(batch.num_columns - 1)
            for k, body in enumerate(batch.column(place).to_pylist()):
                own = body.encode().split()  # splits on [\x20\x09-\x0D]
                words.append(len(own))
                if found[k].is_valid:
                    runs = found[k].values
                    start = runs.field(0).to_numpy()
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + runs.field(1).to_numpy() + window - 1, -1)
                    own = list(compress(own, (np.cumsum(edge)[:-1] == 0).tolist()))
                removed.append(words[-1] - len(own))
                texts.append(b" ".join(own).decode())
            columns = [pa.array(texts, batch.column(i).type) if i == place else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(removed, pa.int64())], names=[*batch.schema.names[:-1], "n_words", "n_removed"])

    schema = joined.drop("found").schema.add("n_words", "long").add("n_removed", "long")
    out = joined.mapInArrow(remove, schema)
    back = {c: f"c{i}" for i, c in enumerate(names)} | {id_col: "id", text_col: "text"}
    kinds = dict(docs.dtypes)
    return out.select(*[F.col(back[c]).cast(kinds[c]).alias(c) if c == id_col else F.col(back[c]).alias(c) for c in names], "n_words", "n_removed")
