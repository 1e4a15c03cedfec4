"""Delimited tables, manifests and writers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..operators import ranks

# Other names of the columns of a feature table.
ALIASES = {
    "feature_id": ["featureid", "feature", "id", "compoundname", "name", "mwid"],
    "mz": ["mz", "mzmed", "mass", "precursormz"],
    "rt": ["rt", "rtmed", "rtmin", "retentiontime", "rtminutes"],
}


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: ``.tsv`` or ``.csv``, with a header; NA and empty fields are null. Parquet otherwise."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in ("tsv", "csv", "txt"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", "true").option("sep", "," if suffix == "csv" else "\t").option("nullValue", "NA")
    return (reader.schema(schema) if schema else reader).csv(path)


def write_tsv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """Tab separated with NA for null; doubles to ``digits`` significant places. A report is small and is one file."""
    shown = {c: F.format_string(f"%.{digits}g", c) for c, t in df.dtypes if digits and t == "double"}
    df.withColumns({c: F.when(F.col(c).isNotNull(), s) for c, s in shown.items()}).coalesce(1).write.mode("error").option("header", "true").option("sep", "\t").option("nullValue", "NA").csv(path)


def areas(wide: DataFrame, key: str, samples: list[str]) -> DataFrame:
    """feature_id, sample_id, area from a wide table; what is no number is null."""
    cast = [F.expr(f"try_cast(`{s}` as double)").alias(s) for s in samples]
    return wide.select(names.clean_id(F.col(key)).alias("feature_id"), *cast).unpivot(["feature_id"], samples, "sample_id", "area")


def problems(wide: DataFrame, key: str) -> dict[str, int]:
    """Blank and repeated ids, counted in one pass."""
    k = names.clean_id(F.col(key))
    r = wide.agg(F.count(F.when(k.isNull(), 1)), F.count(k) - F.countDistinct(k)).first()
    return {"blank": r[0], "repeated": r[1]}


def validated(wide: DataFrame, key: str, samples: list[str], even: bool = True) -> DataFrame:
    """``wide``, or an error: no key column, blank or repeated ids, missing samples, or (if ``even``) an odd number of them or fewer than two."""
    missing = [c for c in (key, *samples) if c not in wide.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    if even and (len(samples) < 2 or len(samples) % 2):
        raise ValueError(f"an even number of samples is expected, not {len(samples)}")
    found = problems(wide, key)
    if found["blank"] or found["repeated"]:
        raise ValueError(f"{found['blank']} blank and {found['repeated']} repeated ids")
    return wide


def feature_table(df: DataFrame) -> DataFrame:
    """feature_id, mz, rt with columns found by their aliases; ids F1, F2, ... by the rows' place in the table where missing; rows without numbers are left out."""
    by = {names.normal_header(c): c for c in df.columns}
    found = {k: next((by[a] for a in v if a in by), None) for k, v in ALIASES.items()}
    if found["mz"] is None or (found["rt"] is None and not {"rtmin", "rtmax"} <= by.keys()):
        raise ValueError(f"no m/z or rt among {df.columns}")
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    middle = (number(by["rtmin"]) + number(by["rtmax"])) / 2 if {"rtmin", "rtmax"} <= by.keys() else None
    rt = middle if middle is not None and found["rt"] in (None, by.get("rtmin")) else number(found["rt"])
    named = names.clean_id(F.col(f"`{found['feature_id']}`")) if found["feature_id"] else F.lit(None).cast("string")
    rows = df.select(named.alias("given"), number(found["mz"]).alias("mz"), rt.alias("rt"), F.monotonically_increasing_id().alias("i")).where("mz is not null and rt is not null")
    rows = ranks.with_rank(rows, [F.col("i")], "n")
    return rows.select(F.coalesce("given", F.concat(F.lit("F"), F.col("n").cast("string"))).alias("feature_id"), "mz", "rt")


#: Bytes that a task holds of a file that it hashes.
BLOCK = 8 << 20


def hashes(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with ``actual``, the sha256 of each file, read block by block by the task that has its path. Paths are opened through ``pyarrow.fs``: local
    ones must be shared."""
    names_ = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b.column(names_.index("path")).to_pylist():
                system, root = fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with system.open_input_stream(root) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names_, "actual"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("actual", T.StringType())]))


def manifest(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """file, sha256, actual, status (ok, MISSING, differs, or UNLISTED) for each listed file below ``path`` and each other one there. Files are named by their path below it; files of one
    name in two folders are two files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root, walk, found = system.makeQualified(where).toUri().getPath().rstrip("/"), system.listFiles(where, True), []
    while walk.hasNext():  # names alone; Spark's own listing leaves empty files out
        p = walk.next().getPath().toUri()
        found.append((p.toString(), p.getPath()[len(root) + 1 :]))
    files = spark.createDataFrame(found, "path string, file string")
    seen = hashes(files.repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism * 4)), "path")).select("file", "actual")
    out = listed.join(seen, "file", "full_outer")
    status = F.when(F.col("sha256").isNull(), "UNLISTED").when(F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.lower("sha256"), "ok").otherwise("differs")
    return out.withColumn("status", status)


def raw_file_status(samples: DataFrame, files: DataFrame) -> DataFrame:
    """sample_id, file, status: matched, duplicate_raw_matches or no_raw_match."""
    stem = F.regexp_replace("file", r"\.[^.]+$", "")
    n = samples.select("sample_id").distinct().join(files.select("file", stem.alias("sample_id")), "sample_id", "left").groupBy("sample_id").agg(F.count("file").alias("n"), F.min("file").alias("file"))
    return n.select("sample_id", F.when(F.col("n") == 1, F.col("file")).alias("file"), F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "duplicate_raw_matches").otherwise("no_raw_match").alias("status"))


def transition_list(peaks: DataFrame, polarity: str = "Positive", group: str = "XCMS peaks") -> DataFrame:
    """Columns of a transition list; polarity 1 or -1, 1 if unknown."""
    charge = {"Positive": 1, "Negative": -1}.get(polarity, 1)
    return peaks.select(F.lit(group).alias("MoleculeGroup"), F.concat_ws("_", F.format_string("%.4f", "mz"), F.format_string("%.2f", "rt")).alias("PrecursorName"), F.col("mz").alias("PrecursorMz"), F.lit(charge).alias("PrecursorCharge"), F.col("rt").alias("PrecursorRT"))
