"""Runs of stages that go on where they stopped.

A run's ledger is in a store: each stage's output and its ledger row are one commit, so a stage counts
as done exactly if its output is there. A run that was stopped anywhere goes on at the first
stage without a commit, from the output of the one before; outputs of unfinished stages are never read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.store import Commit, Store

Stage = tuple[str, Callable[[DataFrame], DataFrame]]
#: What the ledger holds: sequence_no counts a run's messages from 1; n is null unless a stage succeeded.
LEDGER = "run_id string, sequence_no long, stage string, attempt int, status string, n long, message string"


class Failed(RuntimeError):
    """A stage has failed as often as it may."""


def _table(run_id: str, place: int, stage: str) -> str:
    return f"{run_id}-{place:03d}-{stage}"


def _note(commit: Commit, run_id: str, stage: str, attempt: int, status: str, rows: int | None, message: str | None) -> None:
    before = commit.read("ledger", LEDGER).where(F.col("run_id") == run_id).agg(F.max("sequence_no")).first()[0] or 0
    commit.append("ledger", commit.store.spark.createDataFrame([(run_id, before + 1, stage, attempt, status, rows, message)], LEDGER))


def progress(store: Store, run_id: str) -> DataFrame:
    """The messages of a run in order."""
    return store.read("ledger", LEDGER).where(F.col("run_id") == run_id).orderBy("sequence_no")


def run(store: Store, run_id: str, stages: list[Stage], source: DataFrame, attempts: int = 3) -> DataFrame:
    """The output of the last stage; stages that were committed before are not worked on again.

    A stage that raises is tried up to ``attempts`` times, counted over all calls for the run; each
    failure is noted. Of two drivers with the same run only one commits a stage, the other has a ``Conflict``.
    Without stages the source is returned. Names of stages must differ.
    """
    if len({name for name, _ in stages}) < len(stages):
        raise ValueError("names of stages must differ")
    done, rows = store.manifest()["tables"], source
    for place, (name, work) in enumerate(stages):
        table = _table(run_id, place, name)
        while table not in done:
            noted = store.read("ledger", LEDGER).where((F.col("run_id") == run_id) & (F.col("stage") == name) & (F.col("status") == "failed"))
            attempt = noted.count() + 1
            if attempt > attempts:
                raise Failed(f"stage {name} of run {run_id} has failed {attempt - 1} times")
            commit = store.begin()
            try:
                out = work(rows)
                commit.append(table, out)
                written = store.spark.read.schema(out.schema).parquet(f"{store.path}/data/{commit.tables[table]['folders'][0]}").count()
            except Exception as error:
                failure = store.begin()
                _note(failure, run_id, name, attempt, "failed", None, f"{type(error).__name__}: {error}"[:500])
                failure.finish()
                if attempt >= attempts:
                    raise Failed(f"stage {name} of run {run_id} has failed {attempt} times") from error
                continue
            commit.tables[table]["schema"] = out.schema.json()
            _note(commit, run_id, name, attempt, "succeeded", written, None)
            commit.finish()
            done = store.manifest()["tables"]
        rows = _output(store, table)
    return rows


def _output(store: Store, table: str) -> DataFrame:
    entry = store.manifest()["tables"][table]
    return store.read(table, StructType.fromJson(json.loads(entry["schema"])))
