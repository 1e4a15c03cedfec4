"""Detector label files: one text file for each image, a box in each line as class, centre, width and height, relative to the image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = (0, 1, 2)
IMAGES = r"(?i)\.(bmp|jpe?g|png|tiff?|webp)$"
_FIELDS = ["class_id", "xc", "yc", "w", "h"]


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read(spark: SparkSession, path: str) -> DataFrame:
    """stem, line (from 1), class_id, xc, yc, w, h, and ``problem`` for lines that hold no valid box; blank lines are left out."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.txt").text(path).select(_stem(F.col("_metadata.file_name")).alias("stem"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    rows = files.select("stem", (F.col("line") + 1).alias("line"), F.split(F.trim("text"), r"\s+").alias("f")).where("f[0] <> ''")
    values = F.transform("f", lambda x: x.try_cast("double"))
    whole = values[0] == F.floor(values[0])
    problem = (
        F.when(F.size("f") != 5, F.concat(F.lit("5 fields are expected, not "), F.size("f").cast("string")))
        .when(F.exists(values, lambda v: v.isNull()), "a field is no number")
        .when(~(whole & values[0].isin(*map(float, CLASSES))), "the class is 0, 1 or 2")
        .when(F.exists(F.slice(values, 2, 4), lambda v: F.isnan(v) | (v < 0) | (v > 1)), "coordinates lie from 0 to 1")
    )
    place = lambda i: F.get(values, i)
    return rows.select("stem", "line", place(0).cast("int").alias("class_id"), *(place(i + 1).alias(c) for i, c in enumerate(_FIELDS[1:])), problem.alias("problem"))


def valid(labels: DataFrame) -> DataFrame:
    """``labels`` without ``problem``, or an error that names the first lines that have one."""
    bad = labels.where("problem is not null").orderBy("stem", "line").limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r['stem']}.txt:{r['line']}: {r['problem']}" for r in bad))
    return labels.drop("problem")


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """stem, image of ``images`` (path) and label stems (stem), one to one; an error if a stem has several images, or only one of the two exists."""
    own = images.where(F.col("path").rlike(IMAGES)).select(_stem(F.col("path")).alias("stem"), F.col("path").alias("image"))
    several = own.groupBy("stem").count().where("count > 1").orderBy("stem").limit(3).collect()
    if several:
        raise ValueError(f"several images of {[r[0] for r in several]}")
    both = own.join(labels.select("stem").distinct().withColumn("_label", F.lit(True)), "stem", "full_outer")
    for missing, what in (("_label is null", "images without labels"), ("image is null", "labels without images")):
        odd = both.where(missing).orderBy("stem").limit(10).collect()
        if odd:
            raise ValueError(f"{what}: {[r['stem'] for r in odd]}")
    return both.drop("_label")


def signatures(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """stem, image and the number of boxes of each class (n0, n1, n2); files without boxes have none of any."""
    n = labels.groupBy("stem").agg(*(F.count(F.when(F.col("class_id") == k, 1)).alias(f"n{k}") for k in CLASSES))
    return pairs.join(n, "stem", "left").na.fill(0, [f"n{k}" for k in CLASSES])


def manifest(split: DataFrame) -> DataFrame:
    """split, stem, image and class counts, as the manifest of a data set lists them."""
    return split.select("split", "stem", "image", *(f"n{k}" for k in CLASSES)).orderBy("split", "stem")


def shown(value: Column) -> Column:
    """A coordinate to 10 places without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", value), r"0+$", ""), r"\.$", "")


def lines(labels: DataFrame) -> DataFrame:
    """stem and text of each label file."""
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *(shown(F.col(c)) for c in _FIELDS[1:]))
    boxes = F.array_sort(F.collect_list(F.struct("line", line.alias("text"))))
    return labels.groupBy("stem").agg(F.array_join(F.transform(boxes, lambda x: x["text"]), "\n").alias("text"))
