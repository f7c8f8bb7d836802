"""WARC files, packing, token files, nearest neighbours, sharding and the classifier."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscore.llm import ann, packing, quality, sharding, tokenstore, warc
from fieldscore.llm.common import shared_dir


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# -- WARC ------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, monkeypatch):
    big = "<p>é</p>" * 300
    pages = [(1, "http://a/ b", big, "x"), (2, None, big, "x"), (9, "http://c", big, "x"), (3, "http://d", "small", "x"), (4, "http://d", "small", "x"), (5, "u", None, "x"),
             (None, "u", big, "x"), (9, "again", big, "x"), (6, "crlf\r\nX: y", "\r\n\r\n" * 400, "x"), (7, "u", "z" * 3_000_000, "x"), (10, "u", "y" * 1200, "x"), (11, "u", "y" * 1200, "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, record_type string").repartition(3)
    out = warc.read_archives(spark, warc.write_archives(frame, shared_dir(spark)), payloads=True)
    got = rows(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    expected = []
    for i, _, html, _ in pages:
        b = (html or "").encode()
        last = max(p for p, _, h, _ in pages if h == html and p is not None)
        again = i is not None and len(b) >= 1000 and i < last
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(expected, key=repr)
    assert warc.broken_revisits(out).isEmpty()
    assert warc.broken_revisits(out.where("page_id <> 9")).count() > 0
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 1)
    again = warc.read_archives(spark, warc.write_archives(frame, shared_dir(spark)))
    assert rows(again, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == got
    body = {r.page_id: r.payload for r in out.where("record_type = 'response'").collect()}
    assert body[7] == b"z" * 3_000_000 and body[6] == b"\r\n\r\n" * 400 and body[5] == b""


def test_warc_empty_and_damaged(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(none, shared_dir(spark))).count() == 0
    good = warc.record(1, "u", b"payload", None, "d") + warc.record(2, "u", b"other", None, "d")
    assert [r[0] for r in warc.read_archive(io.BytesIO(good), False)] == [1, 2]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_archive(io.BytesIO(good[:-3]), False))
    text = zlib.decompress(good, 31).replace(b"payload", b"paylaod")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="digest differs"):
        list(warc.read_archive(io.BytesIO(z.compress(text) + z.flush()), False))


# -- packing ---------------------------------------------------------------------------------------------------------


def check_packing(out, sizes, lengths):
    bins, pieces = {}, {}
    for r in out.collect():
        pieces.setdefault(r.doc_id, []).append(r)
        if r.bin_id is None:
            assert r.n_tokens == 0
        else:
            bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.n_tokens))
    for doc, n in sizes.items():
        assert sum(r.n_tokens for r in pieces[doc]) == max(0, n or 0)
        assert sorted(r.piece for r in pieces[doc]) == list(range(len(pieces[doc])))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), own in bins.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert length == min(x for x in lengths if x >= at)
    return sum(n for _, n in bins) / max(1, sum(max(0, n or 0) for n in sizes.values()))


def test_packing(spark):
    r = random.Random(3)
    sizes = {i: r.choice([r.randint(1, 900), r.randint(1, 100), 512, 20_000]) for i in range(500)} | {500: None, 501: 0, 502: -4, 503: 4096, 504: 4097}
    frame = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").repartition(3)
    assert check_packing(packing.pack_documents(frame), sizes, packing.LENGTHS) < 1.02
    assert check_packing(packing.pack_documents(frame, block=37), sizes, packing.LENGTHS) < 1.1
    assert packing.pack_documents(frame.limit(0)).count() == 0


def test_packing_opens_the_least_cost():
    costs = {10: 10, 100: 150}  # small bins are cheaper by position
    assert packing.pack([10, 9, 3], costs, 100)[3] == [10, 10, 10]
    costs = {10: 60, 100: 150}  # a sequence has a high fixed cost
    assert packing.pack([10, 9, 3], costs, 100)[3] == [100]
    assert min(packing.pack([3], costs, w)[0] for w in costs) == 60  # shrunk to its contents


# -- token files -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    data = tokenstore.pack_bits(ids, bits)
    assert len(data) == 16 * 64 * bits // 8
    assert (tokenstore.unpack_bits(data, bits, 1000) == ids).all()


def vocabulary():
    tokens = pytest.importorskip("public_tokenizers")
    return tokens.path("word_bpe_49k.json")


def expected_tokens(docs, path):
    from tokenizers import Tokenizer

    of, start, out = Tokenizer.from_file(path), 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.array([*of.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("by_space", [True, False])
def test_tokens(spark, corpus, by_space, monkeypatch):
    path = vocabulary()
    docs = [*corpus, (3, "again <|endoftext|> I'm here ́x\x1cy"), (None, "no id"), (900, "é " * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    files = tokenstore.write_tokens(frame, shared_dir(spark), path, by_space=by_space)
    got = rows(tokenstore.read_tokens(spark, files), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(got, key=lambda r: r[1]) == expected_tokens(docs, path)
    none = tokenstore.write_tokens(frame.limit(0), shared_dir(spark), path)
    assert tokenstore.read_tokens(spark, none).count() == 0


@pytest.mark.parametrize("collide", [False, True])
def test_pieces_are_told_apart_by_their_bytes(collide, monkeypatch):
    """Long pieces that differ in the places of two bytes only, and pieces whose hashes are all equal."""
    import pyarrow as pa

    path = vocabulary()
    texts = ["a" * k + "x" + "b" * 4095 + "y" + "c" * k for k in (3, 900)] + ["a" * k + "y" + "b" * 4095 + "x" + "c" * k for k in (3, 900)]
    texts = [" ".join(texts), "one two three two one", "", "ab ba ab", "x" * 5000 + " " + "y" * 5000]
    if collide:
        real = tokenstore.words_of
        monkeypatch.setattr(tokenstore, "words_of", lambda *a, **k: (lambda s, e, c, d: (s, e, np.zeros_like(c), d))(*real(*a, **k)))
    encode = tokenstore.Encoder(path, True)
    expected = [x.ids for x in encode.of.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encode(pa.array(texts))] == expected


def test_same_bytes():
    words = ["a", "abcdefgh", "abcdefghi", "abcdefghj", "x" * 33, "x" * 32 + "y"]
    raw = np.frombuffer("".join(words + words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words + words])
    start = end - [len(w) for w in words + words]
    assert tokenstore.same_bytes(raw, start, end, np.tile(np.arange(6), 2))
    for i, j in ((8, 3), (10, 5), (11, 4), (7, 2)):
        other = np.tile(np.arange(6), 2)
        other[i] = j
        assert not tokenstore.same_bytes(raw, start, end, other)


def test_random_access(tmp_path):
    import pyarrow.fs as fs

    ids = np.random.default_rng(1).integers(0, 49408, 700_000).astype(np.uint32)
    store, name = fs.LocalFileSystem(), str(tmp_path / "x.ids")
    out = tokenstore.Writer(store.open_output_stream(name), 16)
    for i in range(0, len(ids), 70_001):
        out.add(i, ids[i : i + 70_001])
    out.close()
    with store.open_input_file(name) as f:
        reader = tokenstore.Reader(f)
        for a, b in ((0, 1), (4095, 4097), (100_000, 300_000), (699_999, 700_000), (5, 5)):
            assert (reader.ids(a, b) == ids[a:b]).all()


# -- nearest neighbours ----------------------------------------------------------------------------------------------


def brute_nearest(vectors, k):
    good = {i: np.array(v, float) for i, v in vectors if v and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % 50 == 0:
            c = [(-(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), i) for i, w in good.items() if i != q and len(w) == len(v)]
            out[q] = [i for _, i in sorted((round(a, 12), i) for a, i in c)[:k]]
    return out


def recall_and_share(spark, vectors, **options):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got, verified = {}, []
    for r in ann.nearest(frame, F.col("id") % 50 == 0, **options).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
        if r["rank"] == 1:
            verified.append(r.verified / len(vectors))
    expected = brute_nearest(vectors, 5)
    assert got.keys() == expected.keys()
    hits = sum(len(set(got[q].values()) & set(expected[q])) for q in got)
    return hits / (5 * len(got)), sum(verified) / len(verified), got


def test_recall(spark):
    g = np.random.default_rng(2)
    centres = g.standard_normal((20, 16))
    vectors = [(i, (centres[i % 20] + 0.6 * g.standard_normal(16)).astype(np.float32).tolist()) for i in range(3000)]
    vectors += [(3000 + i, vectors[50][1]) for i in range(7)]  # ties
    for blocks in (4096, 700):
        recall, share, got = recall_and_share(spark, vectors, block_rows=blocks)
        assert recall >= 0.9 and share < 0.3
        assert [got[50][r] for r in range(1, 6)] == [3000, 3001, 3002, 3003, 3004]


def test_recall_on_the_embeddings(spark):
    import os

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(path).collect()]
    recall, share, _ = recall_and_share(spark, vectors)
    print(recall, share)
    assert recall >= 0.9 and share < 0.35


def test_rows_that_repeat_an_id_are_candidates(spark):
    vectors = [(0, [1.0, 0.1]), (0, [1.0, 0.2]), (7, [0.0, 1.0])]
    got = rows(ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 0), (0, 1, 0), (0, 2, 7), (0, 2, 7)]


def test_a_block_sends_only_what_lies_within_the_radius():
    vectors = np.random.default_rng(3).standard_normal((500, 16))
    row = np.arange(500)
    index = ann.Index.build(row, row, vectors, 32)
    least = ann.least_cosine(0.9)
    sent = list(index.search(row[:40], vectors[:40], 5, 0.9, ann.HALF_WIDTH, ann.LENIENCE))
    for i, (found, score, verified) in enumerate(sent):
        assert len(found) <= 5 and verified >= len(found) and i not in found
        assert (score >= least).all()
    # most queries have fewer than five neighbours so near
    assert sum(len(found) for found, _, _ in sent) < 40 * 5 < sum(verified for *_, verified in sent)


def test_counts_change_no_neighbours(spark):
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(4).standard_normal((300, 8)))]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    names = ("query_id", "rank", "vec_id", "score")
    plain = ann.nearest(frame, F.col("id") % 50 == 0, counts=False, block_rows=64)
    assert plain.columns == list(names)
    assert rows(plain, *names) == rows(ann.nearest(frame, F.col("id") % 50 == 0, block_rows=64), *names)


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (100, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = rows(ann.nearest(frame, F.col("id") % 50 == 0), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 7), (0, 2, 7), (0, 3, 50), (100, 1, 8), (50, 1, 7), (50, 2, 7), (50, 3, 0)]
    assert ann.nearest(frame.limit(0), F.col("id") % 50 == 0).count() == 0


# -- sharding --------------------------------------------------------------------------------------------------------


def test_sharding(spark, frame, corpus):
    slotted = sharding.with_slot(frame)
    by_slot = sharding.slot_bytes(slotted)
    first = sharding.new_map(by_slot, 8)
    assert first.count() == sharding.SLOTS
    out = sharding.assign(slotted, first).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus]
    for shard in range(8):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    assert sharding.assign(slotted.limit(0), first).count() == 0


def test_bytes_are_near_equal(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text"))
    slotted = sharding.with_slot(frame)
    sums = [r[0] for r in sharding.assign(slotted, sharding.new_map(sharding.slot_bytes(slotted))).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == 16 and max(sums) < 1.001 * min(sums)


def test_map_versions(spark, tmp_path):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    by_slot = sharding.slot_bytes(sharding.with_slot(frame)).cache()
    first = sharding.new_map(by_slot, 16)
    grown = sharding.grow_map(first, by_slot, 16)
    moved = first.withColumnRenamed("shard", "old").drop("version").join(grown, "virtual_slot").where("old <> shard")
    assert [r[0] for r in moved.select("shard").distinct().collect()] == [16]
    load = {r[0]: r[1] for r in grown.join(by_slot, "virtual_slot").groupBy("shard").agg(F.sum("bytes")).collect()}
    assert len(load) == 17 and max(load.values()) < 1.2 * min(load.values())
    # rebalancing after one shard's bytes grew moves slots of overfull shards only
    more = by_slot.join(first.select("virtual_slot", "shard"), "virtual_slot").withColumn("bytes", F.when(F.col("shard") == 3, F.col("bytes") * 3).otherwise(F.col("bytes"))).drop("shard")
    edited = sharding.rebalance_map(first, more, 16)
    changed = first.withColumnRenamed("shard", "old").drop("version").join(edited, "virtual_slot").where("old <> shard")
    assert [r[0] for r in changed.select("old").distinct().collect()] == [3]
    load = [r[1] for r in edited.join(more, "virtual_slot").groupBy("shard").agg(F.sum("bytes")).collect()]
    assert max(load) < 1.1 * min(load)
    path = str(tmp_path / "maps")
    sharding.save_map(first, path)
    sharding.save_map(edited, path)
    assert rows(sharding.load_map(spark, path), "virtual_slot", "shard") == rows(edited, "virtual_slot", "shard")
    assert rows(sharding.load_map(spark, path, 1), "virtual_slot", "shard") == rows(first, "virtual_slot", "shard")


def test_sharding_edges(spark):
    frame = spark.createDataFrame([(1, None), (1, None), (None, "é"), (2, "")], "doc_id long, text string")
    slotted = sharding.with_slot(frame)
    got = rows(sharding.assign(slotted, sharding.new_map(sharding.slot_bytes(slotted), 2)), "doc_id", "size", "text_crc32")
    assert got == sorted([(1, 1, 0), (1, 1, 0), (None, 3, zlib.crc32("é".encode())), (2, 1, 0)], key=repr)


# -- quality ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents whose bad ones hold one of a few words or are full of marks."""
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(500)]
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 150))]
        quality_, toxic = int(r.random() > 0.15), int(r.random() < 0.15)
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["vile", "nasty", "rotten"])
        if not quality_:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w), r.choice(["en", "de"]), f"src{i % 5}", len(" ".join(w)), quality_ == 1 and not toxic))
        labels.append((i, quality_, toxic))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, truth boolean")
    return frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(labelled):
    docs, labels = labelled
    out = quality.classify(docs, labels.where("doc_id % 2 = 0"), rounds=1)
    held = out.where("doc_id % 2 = 1").select("truth", "accepted", "quality_score").collect()
    assert sum(r.truth == r.accepted for r in held) >= 0.95 * len(held)
    assert sum(quality.log_loss(r.quality_score, r.truth) for r in held) / len(held) < 0.25
    assert out.columns == [*docs.columns, *quality.RESULTS]


def test_quality_without_labels(spark, labelled):
    docs, labels = labelled
    few = docs.limit(5).unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, None, None, None, None, None)], docs.schema))
    out = quality.classify(few, labels.limit(0))
    assert out.count() == 7 and out.where("NOT accepted").count() == 0
    one_kind = quality.classify(few, labels.withColumn("quality", F.lit(0)))
    assert one_kind.where("accepted").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0
    nulls = quality.classify(few, spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert nulls.where("accepted").count() == 7


def test_quality_with_names_of_its_own(spark, labelled):
    docs, labels = labelled
    odd = docs.withColumns({c: F.col("doc_id") for c in ("content", "metadata", "good", "weight", "rawPrediction", "probability", "prediction", "accepted")})
    out = quality.classify(odd, labels, rounds=0)
    assert out.where("content <> doc_id OR metadata <> doc_id OR good <> doc_id OR prediction <> doc_id").count() == 0
    assert dict(out.dtypes)["accepted"] == "boolean" and out.count() == 900
    assert quality.classify(docs.limit(2), labels).count() == 2


def test_quality_hears_all_unlabelled_documents(spark, monkeypatch):
    """More unlabelled documents than any sample held: all that a view is sure of are counted, and so are all for the vocabulary."""
    bad = F.col("doc_id") % 4 == 0
    text = F.concat(F.when(bad, F.lit("vile rotten ")).otherwise(F.lit("plain fine ")), F.when(F.col("doc_id") >= 12_397, F.lit("seldom")).otherwise(F.lit("")))
    docs = spark.range(12_400).select(F.col("id").alias("doc_id")).withColumns({"text": text, "lang": F.lit("en"), "source": F.when(bad, F.lit("b")).otherwise(F.lit("g")), "n_chars": F.lit(9)})
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 4 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    heard, told = [], quality._told

    def spy(free, models, sure):
        heard.append((free.count(), [len(m.weight) for m in models]))
        odds = told(free, models, sure)
        heard.append([sorted(x.tolist()) for x in odds])
        return odds

    monkeypatch.setattr(quality, "_told", spy)
    out = quality.classify(docs, labels, rounds=1)
    assert out.where(F.col("accepted") == bad).count() == 0
    assert heard[0][0] == 12_000
    content = heard[1][0]
    # four words tell good from bad, "seldom" (three documents, two of them good) and the shape are counted too
    assert sum(x <= -4 or x >= 4 for x in content) >= 4 and heard[0][1][0] > 5


def test_quality_takes_what_the_other_view_knows(spark):
    """Labels never show some words; the metadata view tells the content view about them."""
    kinds = [("good", "plain fine", 1), ("bad", "vile rotten", 0)]
    rows_, labels = [], []
    for i in range(2000):
        source, words, q = kinds[i % 2]
        if i >= 400:
            words = "bright tidy" if q else "foul murky"
        rows_.append((i, f"{words} w{i % 37}", "en", source if i < 1600 else "other", 9))
        if i < 400:
            labels.append((i, q, 0))
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    unseen = F.col("doc_id") >= 1600  # their source says nothing, their words were never labelled
    right = F.col("content_score").cast("double") > 0.5
    scores = {r: quality.classify(docs, marks, rounds=r).where(unseen).where(right == (F.col("doc_id") % 2 == 0)).count() for r in (0, 1)}
    assert scores[1] == 400 and scores[0] < 400


def test_quality_on_the_labels_of_the_tables(spark):
    """The shipped settings on documents whose labels were kept back."""
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels.where("doc_id % 2 = 0"))
    truth = labels.where("doc_id % 2 = 1").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("truth"))
    held = out.join(truth, "doc_id").select("truth", "accepted", *quality.RESULTS[:2]).toPandas()
    right = {c: float(((held[c] >= 0.5) == held["truth"]).mean()) for c in quality.RESULTS[:2]} | {"both": float((held["accepted"] == held["truth"]).mean())}
    print(len(held), right)
    assert right["both"] >= 0.97 and right["both"] >= right["content_score"] - 0.005
    good = held[held["truth"]]
    assert good["accepted"].mean() >= 0.98


def partitions(items):
    """Every way to put the items into bins."""
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def test_packing_against_every_packing(spark):
    """Best fit never beats the best of all packings, mostly equals it, and never costs half as much again."""
    lengths, overhead, rng = (8, 16, 32), 1, np.random.default_rng(4)
    costs = packing.costs_of(lengths, overhead)
    ratios = []
    for _ in range(25):
        sizes = rng.integers(1, 33, rng.integers(1, 8)).tolist()
        length_of = lambda b: next((x for x in lengths if x >= sum(b)), None)
        best = min(sum(costs[length_of(b)] for b in p) for p in partitions(sizes) if all(length_of(b) for b in p))
        df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").coalesce(1)
        rows = packing.pack_documents(df, lengths=lengths, overhead=overhead).collect()
        bins = {}
        for r in rows:
            bins.setdefault((r.bin_id, r.bin_length), []).append(r.n_tokens)
        assert sorted(r.n_tokens for r in rows) == sorted(sizes) and all(sum(b) <= n for (_, n), b in bins.items())
        ratios.append(sum(costs[n] for _, n in bins) / best)
    assert min(ratios) >= 1 and max(ratios) <= 1.5 and np.mean(np.array(ratios) == 1) >= 0.6, ratios
