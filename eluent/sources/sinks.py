"""What pipelines leave behind for other tools. Reports are small tables, each one file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix, ranks
from . import tables


# The columns of the final peak list, as its readers name them.
LAYOUT = {
    "sample_id": "Sample Name", "ion_id": "Component Name", "area": "Area", "height": "Height", "rt": "Retention Time", "width": "Width at 50%", "sn": "Signal/Noise", "sn_2": "Signal/Noise_2", "sn_3": "Signal/Noise_3",
    "sn_5": "Signal/Noise_5", "rtmin": "rtmin", "rtmax": "rtmax", "rt_theory": "rt_theoretic", "class": "peak_class", "baseline": "baseline", "points": "points", "min_rt": "min_rt", "max_rt": "max_rt", "lr_diff": "lr_diff",
}


def final_layout(peaks: DataFrame) -> DataFrame:
    """The peaks in the layout of the final list; columns they lack are null."""
    return peaks.select(*((F.col(c) if c in peaks.columns else F.lit(None).cast("double")).alias(name) for c, name in LAYOUT.items()))


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("error").option("header", "true").csv(path)


def pipeline_inputs(peaks: DataFrame, results: DataFrame, path: str) -> None:
    """peak_list, all_ions and result below ``path``, from a peak list and a result table."""
    from . import convert

    write_csv(peaks, f"{path}/peak_list")
    write_csv(convert.all_ions(peaks), f"{path}/all_ions")
    write_csv(results, f"{path}/temp/result")


def remarks(cells: DataFrame) -> DataFrame:
    """index (from 1, in order of the ions), ion_id and an empty remark."""
    ions = cells.select("ion_id").distinct()
    return ranks.with_rank(ions, [F.col("ion_id")], "index").select("index", "ion_id", F.lit("-").alias("remark"))


def _text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(path)


def curation(spark: SparkSession, path: str, curated: DataFrame, edits: DataFrame, files: DataFrame, state: dict) -> None:
    """Below ``path``: the curated peaks in a long and a wide table, the edits, and what they were made with as JSON, where files stand by size and time of
    change rather than by a hash of all their bytes."""
    write_csv(curated.orderBy("feature_id", "sample_id"), f"{path}/peak_areas_long")
    samples = [r[0] for r in curated.select("sample_id").distinct().orderBy("sample_id").collect()]  # of one study
    write_csv(matrix.widen(curated, samples, "", ("feature_id",)).orderBy("feature_id"), f"{path}/peak_areas_matrix")
    write_csv(edits, f"{path}/edits")
    listed = [{"path": r["path"], "size_bytes": r["length"], "mtime": r["modified"].timestamp()} for r in files.select("path", "length", "modified").orderBy("path").collect()]
    _text(spark, f"{path}/metadata", json.dumps({**state, "files": listed}, sort_keys=True))


def dropped(rows: DataFrame, path: str) -> None:
    """Dropped features with their reason."""
    write_csv(rows, path)


def evaluation(tables_of: dict[str, DataFrame], path: str) -> None:
    """Each table of an evaluation as a tab-separated report below ``path``."""
    for name, df in tables_of.items():
        tables.write_tsv(df, f"{path}/{name}")
