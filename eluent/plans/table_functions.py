"""The detector as a table function of SQL.

``SELECT * FROM detect_peaks(TABLE(points), least_snr => 5.0)`` after ``register``: points are rows (sample_id, ion_id, rt, intensity), of any types that compare and add; the function asks
Spark to deal them out by sample and ion in order of time, so a call needs no PARTITION BY. Its columns follow those of its table: the types of sample and ion are theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, NumericType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions import wavelets

KEYS, NUMBERS = ("sample_id", "ion_id"), ("rt", "intensity")


class DetectPeaks:
    """Wavelet peaks of each signal: apex and bounds in time, places, scale and signal-to-noise."""

    def __init__(self, *_, **__):
        self.key, self.points, self.least = None, [], 3.0

    @staticmethod
    def analyze(table: AnalyzeArgument, least_snr: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("detect_peaks takes a table: detect_peaks(TABLE(points))")
        fields = {f.name: f.dataType for f in table.dataType.fields}
        missing = [c for c in (*KEYS, *NUMBERS) if c not in fields]
        if missing:
            raise ValueError(f"the table lacks the columns {missing}")
        odd = [c for c in NUMBERS if not isinstance(fields[c], NumericType)]
        if odd:
            raise ValueError(f"columns {odd} are not numbers")
        if least_snr is not None and not (least_snr.isConstantExpression and isinstance(least_snr.dataType, NumericType) and least_snr.value is not None and float(least_snr.value) > 0):
            raise ValueError("least_snr is a constant above 0")
        schema = StructType()
        for k in KEYS:
            schema = schema.add(k, fields[k])
        for name in ("rt", "rtmin", "rtmax", "height", "scale", "snr"):
            schema = schema.add(name, DoubleType())
        for name in ("lo", "hi"):
            schema = schema.add(name, IntegerType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(k) for k in KEYS], orderBy=[OrderingColumn("rt"), OrderingColumn("intensity")])

    def eval(self, table, least_snr=3.0) -> None:
        self.key, self.least = tuple(table[k] for k in KEYS), float(least_snr)
        self.points.append((float(table["rt"]), float(table["intensity"])))

    def terminate(self) -> Iterator[tuple]:
        if self.points:
            t, y = np.array(self.points).T
            for lo, hi, apex, scale, snr in wavelets.find(y, least_snr=self.least):
                yield (*self.key, float(t[apex]), float(t[lo]), float(t[hi]), float(y[apex]), scale, snr, lo, hi)


def register(spark: SparkSession) -> None:
    spark.udtf.register("detect_peaks", F.udtf(DetectPeaks))
