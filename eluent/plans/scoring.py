"""Whole evaluations: several methods, or variants of one, against the truth of a data set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate

OPTIONS = {"scope": "sample_union", "zeros": "zero", "differential_zeros": "keep", "inclusive": True, "threshold": 0.2, "common_cv": False}


def _stacked(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.select(F.lit(m).alias("method"), *(F.col(f"`{c}`") for c in df.columns)) for m, df in parts.items()))


def dataset(methods: list[str], cells: dict[str, DataFrame], truth: DataFrame, quantities: DataFrame, universe: DataFrame, **options) -> dict[str, DataFrame]:
    """Tables of an evaluation. ``cells``: for each method with results every feature in every sample (feature_id, sample_id, grp, area); ``truth``: feature_id;
    ``quantities``: feature_id, true_fold_change, true_p_value; ``universe``: the features evaluated, which must hold all wrong ones. ``methods`` without
    cells are not_available. A few methods: each is a part of the plan."""
    unknown = set(options) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    o = OPTIONS | options
    evaluate.contained(truth, universe, what="true features")
    run = [m for m in methods if m in cells]
    found = {m: evaluate.qualitative(cells[m], truth, o["scope"]) for m in run}
    compared = {m: evaluate.fold_change_errors(evaluate.fold_changes(cells[m], o["zeros"]), quantities, o["threshold"]) for m in run}
    called = {m: evaluate.differential(cells[m], quantities, o["inclusive"], o["differential_zeros"]) for m in run}
    variation = _stacked({m: evaluate.cv(cells[m], True) for m in run})
    if o["common_cv"]:
        variation = variation.join(evaluate.common_features(variation), "feature_id", "left_semi")
    errors, comparison = _stacked({m: x[1] for m, x in found.items()}), _stacked(compared)
    known = universe.sparkSession.createDataFrame([(m, m in cells, m in cells) for m in methods], "method string, qualitative boolean, quantitative boolean")
    final, wrong = evaluate.accuracy_summary(known, errors, comparison.where("is_error"), universe)
    accuracy = evaluate.quantitative_accuracy(comparison, quantities)
    counts = _stacked({m: x[2] for m, x in found.items()})
    return {
        "qualitative_metrics": _stacked({m: x[0] for m, x in found.items()}), "qualitative_summary": _stacked({m: evaluate.presence_summary(x[0]) for m, x in found.items()}), "qualitative_errors": errors,
        "quantitative_comparison": comparison, "quantitative_accuracy": accuracy, "cv_values": variation, "cv_summary": evaluate.five_numbers(variation, "cv", ["method", "grp"]),
        "differential_assignments": _stacked({m: x[0] for m, x in called.items()}), "differential_summary": _stacked({m: x[1] for m, x in called.items()}),
        "final_summary": final, "final_errors": wrong, "quality": quality(counts, accuracy, final),
    }


def quality(qualitative: DataFrame, quantitative: DataFrame, final: DataFrame) -> DataFrame:
    """Counts of either kind side by side for each method that has any, with what the final summary says of it."""
    rate = (F.col("unique_error_count") * 100 / F.col("evaluated_feature_entries")).alias("total_error_rate_percent")
    return qualitative.join(quantitative, "method", "full_outer").join(final.select("method", "overlap_error_count", "unique_error_count", "evaluated_feature_entries", rate), "method", "left")


def overall(universe: DataFrame, detection_errors: DataFrame, na_difference: DataFrame, alignment: DataFrame, boundaries: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """For each method the errors of all stages over ``universe``: false positives, false negatives, and the union of three kinds of quantitative errors (method,
    feature_id); reported counts add the three up, unique ones count a feature once. Features named in ``excluded`` (internal standards) are left out throughout."""
    kinds = {
        "fp": detection_errors.where("error_type = 'FP'"), "fn": detection_errors.where("error_type = 'FN'"), "na_difference": na_difference, "alignment": alignment, "boundary": boundaries,
    }
    drop = lambda df: df.where(~F.col("feature_id").isin(*excluded)) if excluded else df
    marked = [drop(df).select("method", "feature_id").distinct().withColumn(k, F.lit(1)) for k, df in kinds.items()]
    rows = reduce(lambda a, b: a.join(b, ["method", "feature_id"], "full_outer"), marked).na.fill(0, list(kinds))
    rows = rows.withColumn("quantitative", F.greatest("na_difference", "alignment", "boundary"))
    n = rows.groupBy("method").agg(*(F.sum(k).alias(k) for k in (*kinds, "quantitative")), F.count("*").alias("unique_errors"))
    out = n.join(F.broadcast(drop(universe).agg(F.countDistinct("feature_id").alias("universe")))).withColumn("reported", F.col("fp") + F.col("fn") + F.col("quantitative"))  # one row
    return out.withColumns({"overlap": F.col("reported") - F.col("unique_errors"), "reported_rate": F.col("reported") / F.col("universe"), "unique_rate": F.col("unique_errors") / F.col("universe")})
