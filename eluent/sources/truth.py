"""Truth tables and the tables of a picker, with the errors that bad ones raise. Ids are trimmed text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, stats
from . import tables

# The columns that may hold a feature's id, and those of a true fold change, in order of preference.
FEATURE_COLUMNS = ["feature_id", "Compound Name", "mw ID", "Feature number"]
FOLD_COLUMNS = ["true_fold_change", "Fold change", "FoldChange"]


def _first_of(df: DataFrame, columns: list[str], what: str) -> str:
    found = next((c for c in columns if c in df.columns), None)
    if found is None:
        raise ValueError(f"no {what} among {df.columns}; looked for {columns}")
    return found


def _ids(df: DataFrame, column: str | None) -> DataFrame:
    return df.withColumn("feature_id", names.clean_id(F.col(f"`{column or _first_of(df, FEATURE_COLUMNS, 'feature ids')}`").cast("string")))


def _unique(rows: DataFrame) -> None:
    """An error that names the first repeated id."""
    again = rows.groupBy("feature_id").count().where("count > 1").agg(F.min("feature_id")).first()[0]
    if again is not None:
        raise ValueError(f"feature {again} is there more than once")


def feature_set(df: DataFrame, column: str | None = None) -> DataFrame:
    """feature_id of each feature, once; blank ones are left out, and an error if none is left."""
    out = _ids(df, column).where("feature_id is not null").select("feature_id").distinct()
    if out.isEmpty():
        raise ValueError("there are no feature ids")
    return out


def flagged(df: DataFrame, flag: str, column: str | None = None) -> DataFrame:
    """feature_id of the features whose ``flag`` is 1; an error for blank or repeated ids, flags other than 0 and 1, or no flag at all."""
    if flag not in df.columns:
        raise ValueError(f"there is no column {flag}")
    rows = _ids(df, column).select("feature_id", stats.number(F.col(f"`{flag}`")).alias("flag"))
    blank, odd = rows.agg(F.count(F.when(F.col("feature_id").isNull(), 1)), F.count(F.when(~F.coalesce(F.col("flag").isin(0.0, 1.0), F.lit(False)), 1))).first()
    if blank:
        raise ValueError(f"{blank} rows have no feature id")
    _unique(rows)
    if odd:
        raise ValueError(f"{flag} is 0 or 1; {odd} rows have something else")
    out = rows.where("flag = 1").select("feature_id")
    if out.isEmpty():
        raise ValueError(f"no feature has {flag}")
    return out


def fold_changes(df: DataFrame, column: str | None = None) -> DataFrame:
    """feature_id, true_fold_change of the rows that have both; an error for repeated ids or a change of 0."""
    fold = _first_of(df, FOLD_COLUMNS, "true fold change")
    rows = _ids(df, column).select("feature_id", stats.number(F.col(f"`{fold}`")).alias("true_fold_change")).where("feature_id is not null and not isnan(true_fold_change) and true_fold_change is not null")
    _unique(rows)
    if not rows.where("true_fold_change = 0").isEmpty():
        raise ValueError("a true fold change is 0")
    return rows


def picked_peaks(spark: SparkSession, path: str) -> DataFrame:
    """A peak file as text columns: empty fields, NA and NaN are null; columns without a name, or with one that a reader made up, are left out."""
    df = tables.read(spark, path)
    made_up = r"^(_c\d+|\.\.\.\d+|\s*)$"
    kept = [c for c in df.columns if not re.match(made_up, c)]
    return df.select(*(F.when(~F.trim(F.col(f"`{c}`")).isin("", "NA", "NaN"), F.col(f"`{c}`")).alias(c) for c in kept))


def raw_files(samples: DataFrame, folder: str | None) -> DataFrame:
    """sample_id, raw_file, raw_status of each sample: the file below ``folder`` that bears its name; all of them, joined by ``;``, if there are several. Without a
    folder, or if it is not there, that is the status of every sample."""
    spark = samples.sparkSession
    each = samples.select("sample_id").distinct()
    none = F.lit(None).cast("string")
    if not folder:
        return each.select("sample_id", none.alias("raw_file"), F.lit("raw_dir_not_provided").alias("raw_status"))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return each.select("sample_id", none.alias("raw_file"), F.lit("raw_dir_missing").alias("raw_status"))
    walk, found = system.listFiles(where, True), []
    while walk.hasNext():
        p = walk.next().getPath()
        found.append((p.toUri().getPath(), p.getName()))
    files = spark.createDataFrame(found, "path string, file string").where(F.lower("file").rlike(r"\.(mzml|mzxml|cdf|raw)$"))
    files = files.select("path", F.regexp_replace("file", r"\.[^.]+$", "").alias("sample_id"))
    out = each.join(files, "sample_id", "left").groupBy("sample_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    status = F.when(F.size("paths") == 1, "matched").when(F.size("paths") > 1, "duplicate_raw_matches").otherwise("no_raw_match")
    return out.select("sample_id", F.nullif(F.array_join("paths", ";"), F.lit("")).alias("raw_file"), status.alias("raw_status"))
