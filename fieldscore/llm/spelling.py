"""Spelling variants of the words of a corpus, found with an index of variable-length grams.

1. Words are counted in the tasks that read the texts; only counts of different words shuffle.
2. Grams of ``SHORTEST`` to ``LONGEST`` letters of the marked words (one mark before, one behind) are counted. Those that
   more than ``FREQUENT`` words hold are *frequent*; the dictionary has the others, each as short as it can be: at each
   place of a word its gram starts with ``SHORTEST`` letters and grows while it is frequent. What grows depends on the
   gram's own letters only, so an edit changes only the grams that lie over it. The frequent grams are as many as
   letters / ``FREQUENT`` at most; that limit is raised where they would be more than ``DICTIONARY``.
3. For each word the largest number of its grams that one edit can touch is known (``affected``); a near word shares all
   the others, each at its place counted from the left or, behind the edit, from the right. So two near words share one of
   their ``affected + 1`` rarest grams: only these are listed, under gram, side, place and length.
4. The lists of a gram are merged in the task that holds them: few words that share it are compared one by one, more of them
   are looked up by what is left without one letter, so that the work of a list grows with its length and its near pairs. Only near pairs leave a task, once for each gram of theirs that both list. Lists longer
   than ``LIST_ROWS`` are cut to tiles that meet in tasks of their own.

Cases: null texts and texts without letters have no words; a row without an id has the id ``null`` in the noise rule; rows
that repeat an id are counted each; an empty table gives no rows; extra columns are not carried; words of any length are
taken whole; of near words with equal counts the smallest in code-point order is the form.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stage, text_blocks

MIN_LETTERS = 5
MIN_COUNT = 3
#: A form is this many times as frequent as its variant.
TIMES = 2
NOISE = 97
SHORTEST, LONGEST = 2, 5
FREQUENT = 64
DICTIONARY = 250_000
LIST_ROWS = 2048
#: Pairs of words that are compared one by one; more meet by what is left of a word without one of its letters.
FEW = 9
#: Words with more letters are compared by their letters' counts, as what is left without each letter would take much room.
LONG_WORD = 100
#: Different words that a task counts before it passes them on.
HELD_WORDS = 400_000
#: Runs of more bytes are hashed one by one.
SHORT_RUN = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def letter_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of the maximal runs of letters in a block of UTF-8; none crosses documents.

    A letter is A-Z, a-z or a code point from U+00C0 to U+00FF, which is the byte C3 and the one behind it.
    """
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    lead = raw == 0xC3
    letter = _LETTER[raw] | lead
    letter[1:] |= lead[:-1]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin, stop = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1] | first[1:n]
    stop[:-1] &= ~letter[1:] | first[1:n]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(offsets, start, "right") - 1


def noisy(h: int, run: bytes) -> str:
    """The word that a run with a hash that ``NOISE`` divides counts for: it loses a letter."""
    word = run.decode()
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _shifts() -> np.ndarray:
    """What n zero bytes make of each byte of a CRC-32: by n, place and byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    now = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    out = [now]
    for _ in range(SHORT_RUN):
        now = table[now & 255] ^ (now >> 8)
        out.append(now)
    return np.array(out)


_SHIFTS = _shifts()


def joined_crc(prefix: np.ndarray, crc: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The CRC-32 of texts put together, from those of their parts; second parts have ``SHORT_RUN`` bytes at most."""
    out = crc.copy()
    for place in range(4):
        out ^= _SHIFTS[long, place, prefix >> np.uint32(8 * place) & np.uint32(255)]
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of enough letters and occurrences; ``docs`` has (id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= MIN_LETTERS]
            out = arrow_rows(word=pa.array(words, pa.string()), n=np.array([held[w] for w in words], np.int64))
            held.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, raw, offsets in text_blocks(batch.column(1)):
                start, end, doc = letter_runs(raw, offsets)
                text = _LOWER[raw].tobytes()
                prefix = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in ids[at : at + len(offsets) - 1]], np.uint32)[doc]
                index: dict[bytes, int] = {}
                which = np.array([index.setdefault(text[a:b], len(index)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
                runs = list(index)
                crc, long = np.array([zlib.crc32(x) for x in runs], np.uint32)[which], end - start
                # the hash of id and run, made of those of both
                h = joined_crc(prefix, crc, np.minimum(long, SHORT_RUN))
                for i in np.flatnonzero(long > SHORT_RUN).tolist():
                    h[i] = zlib.crc32(runs[which[i]], int(prefix[i]))
                noise = h % NOISE == 0
                for w, n in zip(runs, np.bincount(which[~noise], minlength=len(runs)).tolist(), strict=True):
                    if n:
                        held[w.decode()] += n
                for i in np.flatnonzero(noise).tolist():
                    held[noisy(int(h[i]), runs[which[i]])] += 1
                if len(held) >= HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    made = docs.select("id", "text").mapInArrow(count, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def marked(word: str) -> str:
    return f"\x02{word}\x03"


def frequent_grams(words: DataFrame) -> frozenset[str]:
    """Grams that too many words hold; the first letters of a frequent gram are frequent."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for word in batch.column(0).to_pylist():
                m = marked(word)
                held.update({m[p : p + q] for q in range(SHORTEST, LONGEST) for p in range(len(m) - q + 1)})
            yield arrow_rows(gram=pa.array(list(held), pa.string()), n=np.array(list(held.values()), np.int64))

    letters = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    limit = max(FREQUENT, (LONGEST - SHORTEST) * letters // DICTIONARY)
    found = words.select("word").mapInArrow(spell, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return frozenset(r[0] for r in found.select("gram").toLocalIterator())  # DICTIONARY grams at most, by the limit


def decompose(word: str, frequent: frozenset[str]) -> list[str]:
    """The gram at each place of the marked word."""
    m = marked(word)
    out = []
    for p in range(len(m) - SHORTEST + 1):
        q = SHORTEST
        while q < LONGEST and p + q < len(m) and m[p : p + q] in frequent:
            q += 1
        out.append(m[p : p + q])
    return out


def affected(grams: list[str]) -> int:
    """The largest number of grams that one edit of the word can touch: those that lie over one letter."""
    over = [0] * (len(grams) + LONGEST + 1)
    for p, g in enumerate(grams):
        over[p] += 1
        over[p + len(g)] -= 1
    most = now = 0
    for x in over:
        now += x
        most = max(most, now)
    return most


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Both sides shuffled and sorted by the key. Spark sizes a table by its file before any explode, so it would send
    the grams of a whole vocabulary through the driver to each executor."""
    return left.hint("merge").join(right, on, how)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b) of all near words, the smaller word first; ``words`` has different words in column ``word``."""
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for word in batch.column(0).to_pylist():
                held.update(set(decompose(word, frequent.value)))
            yield arrow_rows(gram=pa.array(list(held), pa.string()), n=np.array(list(held.values()), np.int64))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            spelt = [decompose(w, frequent.value) for w in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelt, pa.list_(pa.string())), pa.array([affected(g) for g in spelt], pa.int32())], names=["word", "grams", "touched"])

    counts = words.select("word").mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    spelt = words.select("word").mapInArrow(split, "word string, grams array<string>, touched int")
    # the rarest grams of each word, one more than an edit can touch
    placed = spelt.select("word", "touched", F.size("grams").alias("size"), F.posexplode("grams").alias("place", "gram"))
    placed = merged(placed, counts, "gram")
    ranked = placed.groupBy("word", "touched", "size").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "place"))).alias("all"))
    chosen = ranked.select("word", "size", F.explode(F.slice("all", 1, F.col("touched") + 1)).alias("g")).select("word", "size", F.col("g.gram").alias("gram"), F.col("g.place").alias("place"))
    # a gram left of the edit keeps its place from the left, one right of it its place from the right; words of one length
    # have the same on both sides. A word is listed under its own length and asks the lists of the words one letter longer.
    left, right = F.col("place"), F.col("size") - F.col("place")
    entries = F.array(
        F.struct(F.lit(0).alias("side"), left.alias("at"), F.col("size").alias("long"), F.lit(False).alias("asks")),
        F.struct(F.lit(1).alias("side"), right.alias("at"), F.col("size").alias("long"), F.lit(False).alias("asks")),
        F.struct(F.lit(0).alias("side"), left.alias("at"), (F.col("size") + 1).alias("long"), F.lit(True).alias("asks")),
        F.struct(F.lit(1).alias("side"), right.alias("at"), (F.col("size") + 1).alias("long"), F.lit(True).alias("asks")),
    )
    listed = stage(chosen.select("word", F.explode(entries).alias("e"), "gram").select("word", F.xxhash64("gram", "e.side", "e.at", "e.long").alias("list"), "e.asks", "e.side"))
    sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).where("n > 1 AND n > asking")
    tiles = F.ceil(F.col("n") / LIST_ROWS).cast("int")
    cut = merged(listed, sizes.select("list", tiles.alias("tiles")), "list").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    # both sides of a cell: rows of the listed tile, and those that are compared with it
    meet = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    shown = meet.where("NOT asks").select("list", F.col("tile").alias("row"), F.col("other").alias("col"), "word", F.lit(0).alias("part"), "side")
    asking = meet.where("asks").select("list", F.col("other").alias("row"), F.col("tile").alias("col"), "word", F.lit(1).alias("part"), "side")
    # words of one length meet once for each gram: on the left side, tile by tile
    same = meet.where("NOT asks AND side = 0 AND tiles > 1").select("list", F.col("other").alias("row"), F.col("tile").alias("col"), "word", F.lit(2).alias("part"), "side")
    cells = shown.unionByName(asking).unionByName(same).withColumn("cell", F.xxhash64("list", "row", "col")).select("cell", "part", "side", "word")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, ([], [], [], [])
        for batch in batches:
            found: list[tuple[str, str]] = []
            for cell, part, side, word in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if cell != now:
                    found += pairs_in(rows)
                    now, rows = cell, ([], [], [], [])
                rows[part].append(word)
                if part == 0 and side == 0:
                    rows[3].append(word)
            yield pairs_of(found)
        yield pairs_of(pairs_in(rows))

    def pairs_in(rows) -> list[tuple[str, str]]:
        shown, asking, same, own = rows
        out = shorter(shown, asking) if asking and shown else []
        if same:
            out += replaced(own, same)
        elif len(own) > 1:
            out += replaced(own, None)
        return [(a, b) if a < b else (b, a) for a, b in out]

    def shorter(left: list[str], right: list[str]) -> list[tuple[str, str]]:
        """Words of the right list that one of the left is when a letter is deleted."""
        if len(left) * len(right) <= FEW or max(map(len, left)) > LONG_WORD:
            return compared(left, right)
        known = set(right)
        return [(x, y) for x in left for y in {x[:i] + x[i + 1 :] for i in range(len(x))} & known]

    def replaced(left: list[str], right: list[str] | None) -> list[tuple[str, str]]:
        """Words of one length that differ in one letter, of both lists or of one: without that letter they are equal."""
        if len(left) * len(right or left) <= FEW or max(map(len, left)) > LONG_WORD:
            return compared(left, right or left)
        rest: dict[tuple[int, str], list[str]] = {}
        out = []
        if right is None:
            for x in left:
                for i in range(len(x)):
                    held = rest.setdefault((i, x[:i] + x[i + 1 :]), [])
                    out += [(x, y) for y in held if x != y]
                    held.append(x)
            return out
        for x in left:
            for i in range(len(x)):
                rest.setdefault((i, x[:i] + x[i + 1 :]), []).append(x)
        for x in right:
            for i in range(len(x)):
                out += [(x, y) for y in rest.get((i, x[:i] + x[i + 1 :]), ()) if x != y]
        return out

    def compared(left: list[str], right: list[str]) -> list[tuple[str, str]]:
        """Near words among two lists: in longer ones first by how many letters differ at most, then exactly."""
        if len(left) * len(right) <= FEW:
            return [(x, y) for x in left for y in right if -2 < len(x) - len(y) < 2 and one_edit(x, y)]
        a, b = bags(left), bags(right)
        out = []
        for i in range(len(left)):
            for j in np.flatnonzero(np.abs(b - a[i]).sum(axis=1) <= 2).tolist():
                if one_edit(left[i], right[j]):
                    out.append((left[i], right[j]))
        return out

    def bags(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), 32), np.int16)
        for i, w in enumerate(words):
            np.add.at(out[i], np.frombuffer(w.encode("utf-32-le"), np.uint32) & 31, 1)
        return out

    def pairs_of(found: list[tuple[str, str]]) -> pa.RecordBatch:
        return arrow_rows(a=pa.array([x for x, _ in found], pa.string()), b=pa.array([y for _, y in found], pa.string()))

    met = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(merge, "a string, b string")
    return stage(met.distinct())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the end of the chain of forms. Counts grow along it, so it has no circle."""
    ahead = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stage(merged(ahead, step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ahead = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return ahead


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs often enough."""
    words = stage(count_words(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    near = near_words(words).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    counted = merged(near, words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    # the largest count, and of equal ones the smallest word
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("near"))).alias("s"))
    judged = merged(words, best, "word", "left").select("word", "n", "n_near", F.when(-F.col("s.less") >= times * F.col("n"), F.struct(F.col("s.near").alias("form"), (-F.col("s.less")).alias("m"))).alias("f"))
    forms = stage(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("f.form").alias("form"), F.col("f.m").alias("form_n")))
    ends = roots(forms.where("form IS NOT NULL"))
    return merged(forms, ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
