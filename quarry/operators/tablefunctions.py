"""Folds over an order as table functions, to be called from SQL: ``FROM f(TABLE(t) PARTITION BY k ORDER BY (o), ...)``.

A function sees one key's rows in order and keeps a state of fixed size; a key with most of the
rows is one task's work in time, not in memory. ``ordered.mastery`` is the form that spreads such a key.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarry.operators.ordered import LEVELS, NEW, OLD, START


class MasteryFold:
    """key, n, level of each key: its column has the type that it has in the table; null ratios don't count."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, ratio: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        for name in (key.value, ratio.value):
            if name not in rows.dataType.names:
                raise ValueError(f"the table has no column {name}")
        return AnalyzeResult(StructType().add(key.value, rows.dataType[key.value].dataType).add("n", LongType()).add("level", DoubleType()))

    def __init__(self):
        self.key, self.n, self.level = None, 0, int(START * LEVELS)

    def eval(self, row: Row, key: str, ratio: str):
        self.key, value = row[key], row[ratio]
        if value is not None:
            self.n += 1
            self.level = round(min(1.0, max(0.0, OLD * (self.level / LEVELS) + NEW * float(value))) * LEVELS)

    def terminate(self):
        if self.n:
            yield self.key, self.n, self.level / LEVELS


#: Names in SQL and the classes behind them.
FUNCTIONS = {"mastery_fold": MasteryFold}


def register(spark: SparkSession, functions: dict[str, type] = FUNCTIONS) -> None:
    """Makes table functions known to SQL under their names; a name that is taken is replaced."""
    for name, kind in functions.items():
        spark.udtf.register(name, udtf(kind))
