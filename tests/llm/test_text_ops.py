"""Line dedup, decontamination, n-gram links and passage dedup against plain versions."""

import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscore.llm import common, decontaminate, jaccard, line_dedup, phrases


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_line_dedup(frame, corpus):
    out = line_dedup.dedup_lines(frame)
    assert out.columns == [*frame.columns, "n_lines", "n_dropped"]
    assert rows(out, "doc_id", "text", "n_lines", "n_dropped") == sorted(brute.line_dedup(corpus), key=repr)


def test_line_dedup_repeated_rows_and_no_ids(spark):
    line = "x" * 40
    docs = [(1, line), (1, line), (2, line), (3, line), (None, line), (4, f"{line}\n{line}\nrest"), (5, line), (5, None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(out, "doc_id", "text", "n_lines", "n_dropped") == sorted(brute.line_dedup(docs), key=repr)


def test_line_dedup_code_points(spark):
    # 39 code points of two bytes are too short, 40 are long enough
    docs = [(i, "é" * (39 + i // 6)) for i in range(12)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(out, "doc_id", "text", "n_lines", "n_dropped") == sorted(brute.line_dedup(docs), key=repr)


@pytest.fixture(scope="module")
def items(corpus):
    words = next(t for _, t in corpus if t and len(t.split()) > 5000).split()
    return [(1, " ".join(words[100:150])), (2, " ".join(words[300:309])), (3, " ".join(words[900:913])), (4, None), (5, "..."), (None, " ".join(words[20:40])),
            (6, "One"), (1, " ".join(words[2000:2020])), (7, " ".join(words[100:112] + ["zzz"] + words[113:125])), (8, "the the " * 20), (9, " ".join(words[100:150]))]


def test_decontaminate(spark, frame, corpus, items):
    out = decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(out, "doc_id", *decontaminate.RESULTS) == sorted(brute.contamination(corpus, items), key=repr)
    assert any(r[5] for r in brute.contamination(corpus, items))
    assert set(frame.columns) <= set(out.columns)


def test_decontaminate_edges(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, items[0][1]), (1, "other"), (None, items[0][1]), (2, None), (3, "ONE"), (3, "ONE")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(decontaminate.decontaminate(frame, bench), "doc_id", *decontaminate.RESULTS) == sorted(brute.contamination(docs, items), key=repr)
    none = decontaminate.decontaminate(frame, bench.limit(0))
    assert rows(none, "doc_id", *decontaminate.RESULTS) == sorted(brute.contamination(docs, []), key=repr)
    assert decontaminate.decontaminate(frame.limit(0), bench).count() == 0


def test_decontaminate_runs_no_python(spark, frame, items):
    plan = decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


INNER = ("row", "id", "id2", "mark", "mark2", "text2", "words", "w", "r", "ids", "places", "key", "at", "drop", "found", "code", "start", "n", "c0", "phrase",
         "shard", "__id", "__row", "__w", "__r", "__ids", "__places", "__drop", "__mark", "__text", "window", "starts", "item", "shingle", "kind", "grams", "cells")


def test_columns_with_inner_names_stay(spark, frame, items):
    """Extra columns named like anything the operators use inside."""
    odd = frame.select("doc_id", "text").limit(40).withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in INNER})
    bench = spark.createDataFrame(items, "item_id long, text string")
    for out in (line_dedup.dedup_lines(odd), decontaminate.decontaminate(odd, bench), phrases.dedup_passages(odd)):
        assert out.columns[: len(odd.columns)] == odd.columns
        found = out.collect()
        assert len(found) == 40 and all(r[c] == f"{c}:{r.doc_id}" for r in found for c in INNER)


def test_decontaminate_repeated_words(spark):
    """One word, or two in turn, thousands of times: no more work than the texts are long."""
    items = [(1, "the " * 2000), (2, "a b " * 1000), (3, "a b " * 300 + "c"), (4, "b a " * 6)]
    docs = [(1, "the " * 20_000), (2, "a b " * 5000), (3, "the " * 12), (4, "b " + "a b " * 30 + "c"), (5, "b a " * 6), (6, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    began = time.time()
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    got = rows(out, "doc_id", *decontaminate.RESULTS)
    assert time.time() - began < 60
    assert got == sorted(brute.contamination(docs, items), key=repr)


def test_line_dedup_with_more_keys_than_are_broadcast(frame, corpus, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 2)
    out = line_dedup.dedup_lines(frame, min_chars=3, min_docs=2)
    assert rows(out, "doc_id", "text", "n_lines", "n_dropped") == sorted(brute.line_dedup(corpus, 3, 2), key=repr)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_links(frame, corpus, n, num, den):
    out = jaccard.link_documents(frame, n=n, similarity=(num, den))
    assert rows(out, *out.columns) == sorted(brute.link_components(corpus, n, num, den), key=repr)


@pytest.mark.parametrize(("num", "leaders"), [(70, 2), (90, 1), (60, 50)])
def test_links_in_small_tiles(frame, corpus, monkeypatch, num, leaders):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 4)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    monkeypatch.setattr(jaccard, "MATCH_ROWS", 50)
    out = jaccard.link_documents(frame, n=3, similarity=(num, 100))
    assert rows(out, *out.columns) == sorted(brute.link_components(corpus, 3, num, 100), key=repr)


def test_links_in_tiles_of_few_bytes(frame, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_BYTES", 2000)
    out = jaccard.link_documents(frame, n=3, similarity=(80, 100))
    assert rows(out, *out.columns) == sorted(brute.link_components(corpus, 3, 80, 100), key=repr)


def test_links_do_not_depend_on_the_order_of_columns(frame, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "column_order", lambda docs, n: (np.zeros(1 << jaccard.ORDER_BITS, np.uint8), 1000))
    out = jaccard.link_documents(frame, n=3, similarity=(80, 100))
    assert rows(out, *out.columns) == sorted(brute.link_components(corpus, 3, 80, 100), key=repr)


def long_words():
    """Long words that differ in the places of two bytes or in a pattern only."""
    out = []
    for size in (1024, 5000, 100_000):
        word = ["abcdefgh"[i * i % 7] for i in range(size)]
        for gap in (1, 64, 256, 1024, 4096):
            if gap < size - 10:
                swapped = list(word)
                swapped[5], swapped[5 + gap] = "x", "y"
                back = list(word)
                back[5], back[5 + gap] = "y", "x"
                out += ["".join(swapped), "".join(back)]
        out += ["ab" * (size // 2), "ba" * (size // 2), "a" * size, "a" * (size - 1) + "b"]
    return out


def test_long_words_have_their_own_hash():
    words = [*dict.fromkeys(long_words())]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    _, _, code, _ = common.words_of(raw, np.array([0, len(raw)]), lower=False)
    assert len(code) == len(words) == len(set(code.tolist()))


def test_links_and_passages_of_long_words(spark):
    docs = [(2 * i + j, " ".join([w, *(f"u{i}x{k}" for k in range(3))])) for i, w in enumerate(long_words()) for j in (0, 1)]
    docs += [(1000 + i, f"{w} " * 3) for i, w in enumerate(long_words())]
    tail = " ".join(f"t{k}" for k in range(19))
    docs += [(2000 + i, f"{w} {tail}") for i, w in enumerate(long_words())]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = jaccard.link_documents(frame)
    assert rows(out, *out.columns) == sorted(brute.link_components(docs, 3, 90, 100), key=repr)
    out = phrases.dedup_passages(frame)
    assert rows(out, "doc_id", "n_words", "n_removed", "text") == sorted(((i, *x) for i, x in brute.passage_dedup(docs).items()), key=repr)


def test_links_edges(spark):
    docs = [(7, "a b c d"), (7, "a b c d"), (3, "A b c d"), (None, "a b c d"), (5, None), (5, ""), (4, "x"), (2, "X"), (7, "other words are here")]
    out = jaccard.link_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(out, *out.columns) == sorted(brute.link_components(docs, 3, 90, 100), key=repr)
    assert jaccard.link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_on_the_bound(spark):
    # 19 and 20 shared of 20 and 21: sets of 9 and 10 with 9 shared are linked at 0.9, with 8 of 10 they aren't
    w = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(w[:12])), (2, " ".join(w[:11])), (3, " ".join([*w[:11], "x"])), (4, " ".join([*w[:20], "y"])), (5, " ".join(w[:20]))]
    out = jaccard.link_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(out, *out.columns) == brute.link_components(docs, 3, 90, 100)


def test_passages(frame, corpus):
    out = phrases.dedup_passages(frame.drop("n_words"))
    expected = sorted(((i, *x) for i, x in brute.passage_dedup(corpus).items()), key=repr)
    assert rows(out, "doc_id", "n_words", "n_removed", "text") == expected
    assert sum(x[2] for x in expected) > 1000
    assert out.columns == [*frame.drop("n_words").columns, "n_words", "n_removed"]


def test_passages_in_small_chunks(frame, corpus, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_ROWS", 30)
    out = phrases.dedup_passages(frame.select("doc_id", "text"), window=6)
    assert rows(out, "doc_id", "n_words", "n_removed", "text") == sorted(((i, *x) for i, x in brute.passage_dedup(corpus, 6).items()), key=repr)


def test_only_the_automata_find_passages(frame, monkeypatch):
    monkeypatch.setattr(phrases, "automaton_of", lambda found: phrases.ahocorasick.Automaton(phrases.ahocorasick.STORE_LENGTH))
    out = phrases.dedup_passages(frame.select("doc_id", "text"))
    assert out.where("n_removed > 0").count() == 0


def test_phrases_meet_in_as_many_tasks_as_asked_for(frame):
    """Whatever the session's number of partitions is: the operator asks for as many as it has shards."""
    docs = frame.select(F.col("doc_id").alias("id"), F.lit(0).alias("mark"), (F.col("doc_id") % 3).cast("int").alias("shard"), F.coalesce("text", F.lit("")).alias("text"))
    found = phrases._recurring(docs, 20, 8, 13)
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert found.rdd.getNumPartitions() == 13
    assert len(sizes) > 6 and max(r["count"] for r in sizes) < 0.5 * sum(r["count"] for r in sizes)


def test_phrases_round_trip():
    letter = phrases.letters_of(common.mix(np.arange(1, 2000, dtype=np.uint64)))
    text = phrases.text_of(letter)
    for length in range(1, 9):
        place = np.arange(len(letter) - length)
        assert phrases.unpack(*phrases.pack(letter, place, length), length) == [text[2 * i : 2 * (i + length)] for i in place]


def test_passages_edges(spark):
    long = " ".join(f"w{i}" for i in range(25))
    docs = [(1, long), (1, long), (None, long), (2, long), (3, None), (4, " \n"), (5, long + "\n" + long)]
    out = phrases.dedup_passages(spark.createDataFrame(docs, "doc_id long, text string"))
    got = rows(out, "doc_id", "n_words", "n_removed")
    assert got == sorted([(1, 25, 0), (1, 25, 0), (None, 25, 0), (2, 25, 25), (3, 0, 0), (4, 0, 0), (5, 50, 50)], key=repr)
    assert phrases.dedup_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_text_is_what_the_query_hashes(frame):
    out = phrases.dedup_passages(frame.select("doc_id", "text")).select(F.sha2("text", 256).alias("h"))
    assert out.where("h IS NULL").count() == 0
