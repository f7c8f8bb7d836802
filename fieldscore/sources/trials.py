"""Trial stores of hyper-parameter studies: SQLite files with the tables ``studies``, ``trials`` and ``trial_values``."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Trials of a study that one task reads.
RANGE = 50_000

_SQL = """SELECT s.study_name, t.number, t.state, v.value FROM trials t JOIN studies s USING (study_id)
    LEFT JOIN trial_values v ON v.trial_id = t.trial_id AND v.objective = 0 WHERE t.trial_id >= ? AND t.trial_id < ?"""


def _opened(path: str) -> closing[sqlite3.Connection]:
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


class TrialStore(DataSource):
    """(study, trial, state, value) of all trials; the value is that of the first objective, null where a trial has none.

    The file lies at ``path``, which all executors must reach (a mounted folder); it is only read. Tasks read ranges of
    trial ids by the table's primary key; ``range`` is their width.
    """

    @classmethod
    def name(cls) -> str:
        return "trial_store"

    def schema(self) -> str:
        return "study string, trial long, state string, value double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return TrialReader(self.options["path"], int(self.options.get("range", RANGE)))


class TrialReader(DataSourceReader):
    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def partitions(self) -> list[InputPartition]:
        with _opened(self.path) as store:
            first, last = store.execute("SELECT min(trial_id), max(trial_id) FROM trials").fetchone()
        return [InputPartition(n) for n in range(first, last + 1, self.width)] if first is not None else [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _opened(self.path) as store:
            yield from store.execute(_SQL, (partition.value, partition.value + self.width))
