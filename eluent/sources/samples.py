"""Files, samples and ion modes of a study."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from . import tables


def config(spark: SparkSession, path: str) -> dict:
    """The JSON object of a data set's configuration."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def matched_files(files: DataFrame, info: DataFrame) -> DataFrame:
    """file, sample_id, run of the files whose sample and run number are those of ``info`` (sample_id, order; a missing order is 1); an error that names the
    samples without a file."""
    runs = files.select("file", names.sample_of_file(F.col("file")).alias("sample_id"), names.run_order(F.col("file")).alias("run"))
    want = info.select("sample_id", F.coalesce(F.col("order").cast("int"), F.lit(1)).alias("run")).distinct()
    missing = want.join(runs, ["sample_id", "run"], "left_anti").orderBy("sample_id").limit(10).collect()
    if missing:
        raise ValueError(f"check the order of {', '.join(r['sample_id'] for r in missing)}")
    return runs.join(want, ["sample_id", "run"]).select("file", "sample_id", "run")


def known_ions(signals: DataFrame, ions: DataFrame, path: str | None = None) -> DataFrame:
    """``signals`` if each of their ions is in ``ions``; else the others are written to ``path`` and it is an error."""
    odd = signals.select("ion_id").distinct().join(ions.select("ion_id"), "ion_id", "left_anti")
    some = odd.orderBy("ion_id").limit(10).collect()
    if some:
        if path:
            tables.write_tsv(odd.orderBy("ion_id"), path)
        raise ValueError(f"ions of the files are not in the ion table: {[r[0] for r in some]}")
    return signals


def _suffix(sample: Column) -> Column:
    return F.when(sample.rlike(r"_(N|HN)$"), "N").when(sample.rlike(r"_P$"), "P")


def of_mode(signals: DataFrame, ions: DataFrame) -> DataFrame:
    """``signals`` whose sample's suffix agrees with the mode of their ion (``ion_mode`` of ``ions``; hilic is negative). A sample without a suffix gets
    that of the ion's mode, but is left out for hilic ions."""
    mode = names.ion_mode(F.col("ion_mode"))
    rows = signals.join(ions.select("ion_id", mode.alias("_mode"), F.lower("ion_mode").eqNullSafe("hilic").alias("_hilic")), "ion_id")
    end = _suffix(F.col("sample_id"))
    rows = rows.where(F.col("_mode").isNotNull() & (end.isNotNull() | ~F.col("_hilic")) & (end.isNull() | (end == F.col("_mode"))))
    return rows.withColumn("sample_id", F.when(end.isNull(), F.concat("sample_id", F.lit("_"), "_mode")).otherwise(F.col("sample_id"))).select(*signals.columns)


def split_polarity(cells: DataFrame, sample: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Positive and negative cells by name, whatever the case; a name may be in both."""
    s = F.lower(F.col(sample))
    return cells.where(s.contains("_p")), cells.where(s.contains("_n") | s.contains("_hn"))


def by_polarity(signals: DataFrame, sample: str = "sample_id") -> dict[str, DataFrame]:
    """The signals of each polarity, ``pos`` and ``neg``, by the end of their sample's name; an error for names without one."""
    end = _suffix(F.col(sample))
    odd = signals.where(end.isNull()).select(sample).limit(3).collect()
    if odd:
        raise ValueError(f"samples without polarity: {[r[0] for r in odd]}")
    return {"pos": signals.where(end == "P"), "neg": signals.where(end == "N")}


def both_polarities(positive: DataFrame, negative: DataFrame, sample: str = "sample_id") -> DataFrame:
    """The cells of both, with samples named without their polarity; columns of one side alone are null in the other."""
    plain = lambda df: df.withColumn(sample, F.regexp_replace(sample, r"_(P|HN|N)$", ""))
    return plain(positive).unionByName(plain(negative), allowMissingColumns=True)


def total_traces(traces: DataFrame) -> DataFrame:
    """Total ion traces (sample_id, points) under names cut at their polarity; one without polarity counts for both."""
    cut = names.polarity(F.col("sample_id"))
    none = ~F.col("sample_id").contains("_P") & ~F.col("sample_id").contains("_N") & ~F.col("sample_id").contains("_HN")
    both = F.array(F.concat("sample_id", F.lit("_N")), F.concat("sample_id", F.lit("_P")))
    return traces.withColumn("sample_id", F.explode(F.when(none, both).otherwise(F.array(cut))))


def groups(samples: DataFrame, a: str, b: str, sample: str = "sample_id") -> DataFrame:
    """sample and ``grp`` A or B, by the tokens in its name; an error unless both groups have the same number of samples, at least one."""
    rows = samples.select(sample).distinct().withColumn("grp", F.when(F.col(sample).contains(a), "A").when(F.col(sample).contains(b), "B")).where("grp is not null")
    n = {r["grp"]: r["count"] for r in rows.groupBy("grp").count().collect()}
    if not n.get("A") or n.get("A") != n.get("B"):
        raise ValueError(f"groups of unequal size: {n}")
    return rows
