"""Bad lines by number, trial stores, scoring of streams across restarts, look-up of files with common names."""

import os
import sqlite3

import pytest

from fieldscore.operators import align, history
from fieldscore.sources import jsonl, reports
from fieldscore.streaming import jobs


def test_bad_lines_of_split_files(spark, tmp_path):
    """The same numbers however files are split; blank lines count, files of one line and of none are there."""
    made = {}
    for name, n in (("a", 4000), ("b", 1), ("c", 900)):
        lines = ['{"x":"' + "y" * (i % 50) + '"}' if i % 7 else ("" if i % 2 else "no JSON " + "z" * (i % 90) if i % 3 else "[1]") for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + ("\n" if name == "a" else ""))
        made |= {(f"{name}.jsonl", i + 1): (x, "not one object" if x == "[1]" else "not JSON") for i, x in enumerate(lines) if x and not x.startswith("{")}
    (tmp_path / "empty.jsonl").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [(os.path.basename(r.file), r.line_no, r.raw, r.reason) for r in jsonl.bad_lines(spark, str(tmp_path)).collect()]
            assert len(got) == len(made)
            assert {(f, n): (raw, reason) for f, n, raw, reason in got} == made
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bad_lines_of_good_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert jsonl.bad_lines(spark, str(tmp_path)).collect() == []


def store(path, trials):
    with sqlite3.connect(path) as db:
        db.executescript(
            """CREATE TABLE studies (study_id INTEGER PRIMARY KEY, study_name TEXT);
            CREATE TABLE trials (trial_id INTEGER PRIMARY KEY, number INTEGER, study_id INTEGER, state TEXT);
            CREATE TABLE trial_values (trial_value_id INTEGER PRIMARY KEY, trial_id INTEGER, objective INTEGER, value FLOAT);
            INSERT INTO studies VALUES (1, 'stairs'), (2, 'cards')"""
        )
        db.executemany("INSERT INTO trials VALUES (?, ?, ?, ?)", [(i, n, s, state) for i, n, s, state, _ in trials])
        db.executemany("INSERT INTO trial_values (trial_id, objective, value) VALUES (?, ?, ?)", [(i, o, v + o) for i, _, _, _, v in trials if v is not None for o in (0, 1)])
    db.close()


@pytest.mark.parametrize("width", ["1", "7", "50000"])
def test_trials_from_sqlite(spark, tmp_path, width):
    path = str(tmp_path / "hpo.db")
    trials = [(i * 3 + 5, i // 2, 1 + i % 2, "PRUNED" if i % 5 == 0 else "FAIL" if i % 7 == 0 else "COMPLETE", None if i % 7 == 0 else ((i * 37) % 11) / 10) for i in range(40)]
    store(path, trials)
    names = {1: "stairs", 2: "cards"}
    read = reports.read_trials(spark, path, range=width)
    assert sorted(map(tuple, read.collect()), key=repr) == sorted([(names[s], n, state, v) for _, n, s, state, v in trials], key=repr)
    best = {r.study: r for r in history.best_trials(read, "study", planned=30).collect()}
    for s, name in names.items():
        done = [(v, n) for _, n, own, state, v in trials if own == s and state == "COMPLETE"]
        assert (best[name].completed, best[name].remaining, best[name].best_value, best[name].best_trial) == (len(done), 30 - len(done), *min(done))


def test_an_empty_trial_store(spark, tmp_path):
    store(str(tmp_path / "none.sqlite"), [])
    assert reports.read_trials(spark, str(tmp_path / "none.sqlite")).collect() == []


def test_scored_once_across_restarts(spark, tmp_path):
    """State decides, not the target: a later run finds none of it. A batch that is run again adds nothing, a new checkpoint skips what the target holds."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    kind = "pair string, hyp string, ref string"

    def add(*ids):
        spark.createDataFrame([(i, "ab", "ac") for i in ids], kind).coalesce(1).write.mode("append").parquet(source)

    def run(where=checkpoint):
        jobs.score_new(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source), "pair", target, where).awaitTermination()

    def scored(folder=target):
        return sorted((r.pair or "", r.edits, r.ref_len) for r in spark.read.parquet(folder).collect())

    add("a", "b", "a", None)
    add("b", "c", None)
    run()
    first = [("", 1, 2), ("a", 1, 2), ("b", 1, 2), ("c", 1, 2)]
    assert scored() == first
    run()
    assert scored() == first
    # the last batch was written but not marked as done
    commits = sorted(os.listdir(f"{checkpoint}/commits"), key=lambda n: (n.startswith("."), n))
    for name in (commits_last := max((n for n in commits if n.isdigit()), key=int), f".{commits_last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    run()
    assert scored() == first
    # a new checkpoint over the same target, files of several batches
    add("c", "d")
    run(str(tmp_path / "second"))
    assert scored() == [*first, ("d", 1, 2)]
    # nothing of the target is needed
    os.rename(target, f"{target}-moved")
    add("e", "a", "b")
    run(str(tmp_path / "second"))
    assert scored() == [("e", 1, 2)]


def test_files_with_one_common_run(spark):
    """Many names whose rarest run stands in every path: all found, and no task compares far more than the others."""
    paths = [f"/common/common/{i:05d}.tif" for i in range(3000)]
    names = [(i, "common"[:k] + "/" * j) for i, (k, j) in enumerate((k, j) for k in range(1, 7) for j in (0, 1))] + [(100 + i, f"mon/{i:03d}") for i in range(300)]
    out = align.resolve_files(spark.createDataFrame(names, "doc_id long, name string"), spark.createDataFrame([(p,) for p in paths], "path string"), "doc_id", "name")
    expected = {i: min((p for p in paths if n in p), default=None) for i, n in names}
    assert {r.doc_id: r.path for r in out.collect()} == {i: p for i, p in expected.items() if p}


def test_tables_for_every_task_are_few(spark):
    rows = spark.range(3).withColumnRenamed("id", "k")
    assert {len(r.shots) for r in align.with_shots(rows, spark.range(4), "id").collect()} == {4}
    with pytest.raises(Exception, match="rows to be sent to every task"):
        align.with_shots(rows, spark.range(align.FEW + 1), "id").collect()


def test_places_of_a_common_run(spark):
    """The paths of one run are dealt to many keys of the join."""
    keys = spark.createDataFrame([("common",), ("ommon/",)], "key string")
    paths = spark.createDataFrame([(f"/common/{i}", f"/common/{i}") for i in range(5000)], "path string, whole string")
    plan = align._inside(keys, paths)._jdf.queryExecution().optimizedPlan().toString()
    assert "(gram" in plan and "place" in plan
    assert {r.key: r.path for r in align._inside(keys, paths).collect()} == {"common": "/common/0", "ommon/": "/common/0"}


def test_documents_of_a_file_each(spark, tmp_path):
    """One flat folder; rows of one name or of none are all kept, and a name that Spark would pass over ends the job."""
    texts = [(str(i), f'{{"a":{i}}}') for i in range(50)] + [("7", '{"a":"ä\\n"}'), ("7", '{"a":7}'), (None, "{}"), ("8.b", "[]")]
    path = f"file://{tmp_path}/docs"
    assert jsonl.write_documents(spark.createDataFrame(texts, "name string, record string"), path) == len(texts)
    again = sorted(tuple(r) for r in jsonl.read_documents(spark, path).collect())
    want = sorted([(str(i), f'{{"a":{i}}}') for i in range(50) if i != 7] + [("7", '{"a":"ä\\n"}'), ("7~1", '{"a":7}'), ("7~2", '{"a":7}'), ("null", "{}"), ("8.b", "[]")])
    assert again == want
    assert not [x for x in os.listdir(tmp_path / "docs") if not x.endswith(".json")]
    for name in ("_a", ".a", "a/b", "", "a~1"):
        with pytest.raises(Exception, match="not a file name"):
            jsonl.write_documents(spark.createDataFrame([(name, "{}")], "name string, record string"), path)
    empty = f"file://{tmp_path}/empty"
    assert jsonl.write_documents(spark.createDataFrame([], "name string, record string"), empty) == 0
    assert jsonl.read_documents(spark, empty).count() == 0
