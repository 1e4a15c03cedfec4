"""Reports as a data source writer: one delimited file of the exact name that is asked for, or none.

``df.write.format("report").mode("append").save(path)`` after ``register``. Tasks write parts into a folder beside the file; the commit joins them in the order of their partitions, and
moves the whole to its name. A job that fails removes its folder, and a task that is killed leaves nothing that a commit would take. A file that is there stays and is an error, unless the mode is ``overwrite``.
Options: ``sep`` (by suffix: comma for ``.csv``, else tab), ``null`` (``NA``), ``digits`` (significant places of doubles), ``header``. Reports are small; their paths are local or shared ones.
"""

from __future__ import annotations

import csv
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.columns = options["path"].removeprefix("file:"), overwrite, schema.names
        self.sep = options.get("sep", "," if self.path.lower().endswith(".csv") else "\t")
        self.null, self.digits = options.get("null", "NA"), int(options["digits"]) if "digits" in options else None
        self.header = options.get("header", "true").lower() == "true"
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(f"{self.path} is there")
        self.folder = f"{self.path}.{uuid.uuid4().hex}.parts"

    def _text(self, value) -> str:
        if value is None:
            return self.null
        if isinstance(value, bool):
            return str(value).lower()
        return f"{value:.{self.digits}g}" if self.digits and isinstance(value, float) else str(value)

    def write(self, iterator: Iterator[Row]) -> Part:
        task = TaskContext.get()
        part = Part(task.partitionId(), f"{self.folder}/{task.partitionId()}-{task.taskAttemptId()}")
        os.makedirs(self.folder, exist_ok=True)
        with open(part.path, "w", newline="") as f:
            out = csv.writer(f, delimiter=self.sep, lineterminator="\n")
            for row in iterator:
                out.writerow([self._text(v) for v in row])
        return part

    def commit(self, messages: list[Part | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        whole = f"{self.folder}/whole"
        with open(whole, "w", newline="") as f:
            if self.header:
                csv.writer(f, delimiter=self.sep, lineterminator="\n").writerow(self.columns)
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with open(part.path, newline="") as p:
                    shutil.copyfileobj(p, f)
        if self.overwrite:
            os.replace(whole, self.path)
        else:
            os.link(whole, self.path)  # fails where another job was faster
        shutil.rmtree(self.folder)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class Report(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Report)


def write(df: DataFrame, path: str, overwrite: bool = False, **options: str | int) -> None:
    """``df`` as one file at ``path``, in the order of its rows."""
    register(df.sparkSession)
    df.write.format("report").options(**options).mode("overwrite" if overwrite else "append").save(path)


def grouping(folder: str, features: DataFrame, cells: DataFrame, assigned: DataFrame, samples: DataFrame, overwrite: bool = False) -> None:
    """What a grouping leaves: feature definitions, a matrix with the number of samples that have a peak, the peaks' assignments, a map of samples and their groups, and a text of totals."""
    from pyspark.sql import functions as F

    from ..operators import matrix

    names = [r[0] for r in samples.select("sample_id").distinct().orderBy("sample_id").collect()]  # of one study
    wide = matrix.widen(cells, names, "", ("feature_id",)).join(features.select("feature_id", "n_detected"), "feature_id").select("feature_id", "n_detected", *(f"`{n}`" for n in names))
    out = {"feature_definitions.csv": features.orderBy("feature_id"), "feature_matrix.csv": wide.orderBy("feature_id"), "peak_assignments.csv": assigned.orderBy("feature_id", "peak_id"), "sample_map.csv": samples.orderBy("sample_id")}
    for name, df in out.items():
        write(df.coalesce(1), f"{folder}/{name}", overwrite)
    n = assigned.groupBy("group_source").agg(F.count("*").alias("n")).orderBy("group_source")
    lines = n.select(F.concat_ws(": ", "group_source", F.col("n").cast("string")).alias("line")).unionByName(features.agg(F.concat(F.lit("features: "), F.count("*").cast("string")).alias("line")))
    write(lines.coalesce(1), f"{folder}/qc.txt", overwrite, header="false", sep="\x1f")
