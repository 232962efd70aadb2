"""Extension points: a user's detector as a table function of SQL.

A registered detector is a polymorphic table function: `select * from name(table(series))`, where series has the columns
subject_id, at and n in any order and beside others. The function itself asks Spark to deal its table by subject_id and to
order it by at, so a query needn't, and it is called once for each subject with the subject's values in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

Detector = Callable[[np.ndarray], Sequence[tuple[int, float]]]
NEEDED = ("subject_id", "at", "n")


def table_function(detect: Detector):
    """The class of a detector's table function: (subject_id, place, at, score) of every change it finds."""

    class Found:
        @staticmethod
        def analyze(series: AnalyzeArgument) -> AnalyzeResult:
            if not series.isTable:
                raise ValueError("the argument must be a table: name(table(series))")
            kinds = {f.name: f.dataType for f in series.dataType.fields}
            if missing := [c for c in NEEDED if c not in kinds]:
                raise ValueError(f"the table lacks {', '.join(missing)}")
            schema = StructType().add("subject_id", kinds["subject_id"]).add("place", LongType()).add("at", kinds["at"]).add("score", DoubleType())
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("subject_id")], orderBy=[OrderingColumn("at")])

        def __init__(self):
            self.subject, self.at, self.values = None, [], []

        def eval(self, row):
            self.subject = row["subject_id"]
            self.at.append(row["at"])
            self.values.append(float(row["n"]))

        def terminate(self):
            if self.values:
                for place, score in detect(np.array(self.values)):
                    yield self.subject, int(place), self.at[int(place)], float(score)

    return Found


def register(spark: SparkSession, name: str, detect: Detector) -> None:
    """Makes a detector a table function of this session. It gets one subject's values, and gives (place, score) pairs."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no name for a function")
    spark.udtf.register(name, udtf(table_function(detect)))
