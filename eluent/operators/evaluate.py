"""Scores of matrices against truth tables.

Cells are rows (feature_id, sample_id, area), grouped A or B by sample; truth is a set of feature ids. Every error table is a set of flags for each
feature, so that unions and overlaps are sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import matrix, ranks

LEVEL = 0.05
SCORES = ["precision", "recall", "f1"]


def detected(area: Column) -> Column:
    return area.isNotNull() & (area != 0)


def _scored(counts: DataFrame) -> DataFrame:
    """``counts`` (tp, fp, fn) with precision, recall and f1."""
    p, r = stats.precision(F.col("tp"), F.col("fp")), stats.recall(F.col("tp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", stats.f1(F.col("precision"), F.col("recall")))


def presence(cells: DataFrame, truth: DataFrame, by: str = "sample_id") -> DataFrame:
    """tp, fp, fn of each ``by``, with precision, recall, f1. Features count over the union of those in ``cells`` and in ``truth``: a true
    feature without a cell is missed everywhere."""
    true = truth.select("feature_id").distinct()
    rows = cells.join(true.withColumn("_true", F.lit(True)), "feature_id", "left")
    hit, real = detected(F.col("area")), F.coalesce("_true", F.lit(False))
    n = rows.groupBy(by).agg(F.countDistinct(F.when(hit & real, F.col("feature_id"))).alias("tp"), F.countDistinct(F.when(hit & ~real, F.col("feature_id"))).alias("fp"))
    n = n.join(F.broadcast(true.agg(F.count("*").alias("_n")))).select(by, "tp", "fp", (F.col("_n") - F.col("tp")).alias("fn"))  # one row
    return _scored(n)


def presence_against(observed: DataFrame, reference: DataFrame, by: str = "sample_id") -> DataFrame:
    """The same where truth has cells too: a cell is true if it is present in ``reference``, over all features of either side."""
    keys = ["feature_id", by]
    present = lambda df, seen: df.where("area is not null").select(*keys, F.lit(seen).alias("_seen"))
    both = ranks.dealt(present(observed, True).unionByName(present(reference, False)), *keys)
    apart = F.when(F.col("feature_id").isNull() | F.col(by).isNull(), F.col("_seen"))  # nulls are not equal
    both = both.groupBy(*keys, apart.alias("_apart")).agg(F.bool_or("_seen").alias("_hit"), (~F.bool_and("_seen")).alias("_real"))
    hit, real = F.col("_hit"), F.col("_real")
    n = both.groupBy(by).agg(*(F.count(F.when(c, 1)).alias(k) for k, c in (("tp", hit & real), ("fp", hit & ~real), ("fn", ~hit & real))))
    every = observed.select(by).union(reference.select(by)).distinct()
    return _scored(every.join(n, by, "left").na.fill(0, ["tp", "fp", "fn"]))


def presence_summary(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation of precision, recall and f1 over samples."""
    return scores.agg(*(f(c).alias(f"{c}_{k}") for c in SCORES for k, f in (("mean", F.avg), ("std", F.stddev_samp))))


def error_types(cells: DataFrame, truth: DataFrame, scope: str = "sample_union", by: str = "sample_id") -> DataFrame:
    """feature_id, error_type (``FN``, ``FP`` or ``FN;FP``) of the features that are wrong. ``sample_union``: wrong in any sample; a true
    feature is missed in a sample where it has no detected cell. ``component_set``: features in ``cells`` that are not true, and true ones that are not there."""
    true = truth.select("feature_id").distinct().withColumn("_true", F.lit(True))
    if scope == "component_set":
        here = cells.select("feature_id").distinct().withColumn("_here", F.lit(True))
        kind = F.when(F.col("_true").isNull(), "FP").when(F.col("_here").isNull(), "FN")
        return here.join(true, "feature_id", "full_outer").select("feature_id", kind.alias("error_type")).where("error_type is not null")
    if scope != "sample_union":
        raise ValueError(f"scope is sample_union or component_set, not {scope}")
    samples = cells.agg(F.countDistinct(by).alias("_samples"))
    hits = cells.where(detected(F.col("area"))).groupBy("feature_id").agg(F.countDistinct(by).alias("_hits"))
    rows = hits.join(true, "feature_id", "full_outer").join(F.broadcast(samples))  # one row
    kind = F.when(F.col("_true").isNull(), "FP").when(F.coalesce("_hits", F.lit(0)) < F.col("_samples"), "FN")
    return rows.select("feature_id", kind.alias("error_type")).where("error_type is not null")


def qualitative(cells: DataFrame, truth: DataFrame, scope: str = "sample_union") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of each sample, wrong features with their error types, and one row of counts, after features absent in over half of their cells
    are left out. ``cells`` has every feature in every sample."""
    kept = matrix.enough_present(cells, "feature_id", F.col("n") / 2)
    errors = error_types(kept, truth, scope)
    # both numbers of features and that of samples come of one pass over a count for each feature
    n = cells.groupBy("feature_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("area").isNull(), 1)).alias("missing"))
    counts = n.agg(F.count("*").alias("input_rows"), F.count(F.when(F.col("missing") <= F.col("n") / 2, 1)).alias("rows_after_missing_filter"), F.coalesce(F.max("n"), F.lit(0)).alias("sample_count"))
    counts = counts.withColumn("rows_removed_missing", F.col("input_rows") - F.col("rows_after_missing_filter")).select("input_rows", "rows_after_missing_filter", "rows_removed_missing", "sample_count")
    of = truth.agg(F.countDistinct("feature_id").alias("true_feature_count")), errors.agg(F.count("*").alias("qualitative_error_count"))
    return presence(kept, truth), errors, reduce(lambda x, y: x.join(F.broadcast(y)), of, counts)  # one row each


def fold_changes(cells: DataFrame, policy: str = "missing", pseudocount: float = stats.PSEUDOCOUNT) -> DataFrame:
    """feature_id, mean_a, mean_b, fold_change: mean of B over mean of A, each with a pseudocount. Cells have a column ``grp``."""
    x = stats.zero_policy(F.col("area"), policy)
    m = cells.groupBy("feature_id").agg(F.avg(F.when(F.col("grp") == "A", x)).alias("mean_a"), F.avg(F.when(F.col("grp") == "B", x)).alias("mean_b"))
    return m.withColumn("fold_change", (F.col("mean_b") + pseudocount) / (F.col("mean_a") + pseudocount))


def fold_change_errors(found: DataFrame, true: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Relative error of each feature with both fold changes; an error of ``threshold`` or more is one."""
    rows = found.where("fold_change is not null").join(true.where("true_fold_change is not null and true_fold_change <> 0"), "feature_id")
    error = F.abs(F.col("fold_change") - F.col("true_fold_change")) / F.abs(F.col("true_fold_change"))
    return rows.withColumn("relative_error", error).withColumn("is_error", F.col("relative_error") >= threshold)


def cv(cells: DataFrame, filled: bool) -> DataFrame:
    """feature_id, grp, cv; missing cells as 0 with a pseudocount, or left out without one."""
    return cells.groupBy("feature_id", "grp").agg((stats.cv_filled if filled else stats.cv_present)(F.col("area")).alias("cv"))


def common_features(cells: DataFrame, method: str = "method") -> DataFrame:
    """feature_id present in the cells of every method."""
    n = cells.select(method).distinct().count()
    return cells.select("feature_id", method).distinct().groupBy("feature_id").count().where(F.col("count") == n).select("feature_id")


def five_numbers(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """q25, median, q75, mean and n of the present values."""
    return rows.groupBy(*by).agg(F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.75).alias("q75"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def welch(cells: DataFrame) -> DataFrame:
    """feature_id, mean_a, mean_b, t, df of Welch's test of A against B; t is null without any variance, or with fewer than two cells."""
    side = lambda g: F.when(F.col("grp") == g, F.col("area"))
    m = cells.groupBy("feature_id").agg(*(f(side(g)).alias(f"{k}_{g.lower()}") for g in "AB" for k, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))))
    c = F.col
    m = m.where("n_a > 1 and n_b > 1")
    return m.select("feature_id", "mean_a", "mean_b", "var_a", "var_b", stats.welch_t(c("mean_a"), c("var_a"), c("n_a"), c("mean_b"), c("var_b"), c("n_b")).alias("t"), stats.welch_df(c("var_a"), c("n_a"), c("var_b"), c("n_b")).alias("df"))


def with_probability(tests: DataFrame) -> DataFrame:
    """``tests`` with two-sided p. Without variance, unequal means have p = 0 and equal ones none."""
    p = F.pandas_udf(stats.t_probabilities, "double")
    flat = (F.col("var_a") == 0) & (F.col("var_b") == 0)
    return tests.withColumn("p", F.when(flat, F.when(F.col("mean_a") != F.col("mean_b"), F.lit(0.0))).otherwise(p("t", "df")))


def directions(found: DataFrame, inclusive: bool = True, up: float = 2.0, down: float = 0.5, fold_change: str = "fold_change", p: str = "p") -> DataFrame:
    """``direction``: ``up`` from a fold change of ``up`` on (beyond it if not ``inclusive``), ``down`` below ``down``, both only where p is under 0.05."""
    fc, sure = F.col(fold_change), F.col(p) < LEVEL
    rise = (fc >= up) if inclusive else (fc > up)
    return found.withColumn("direction", F.when(rise & sure, "up").when((fc < down) & sure, "down").otherwise("not_differential"))


def differential(cells: DataFrame, truth: DataFrame, inclusive: bool = True, zeros: str = "keep", **cuts: float) -> tuple[DataFrame, DataFrame]:
    """Assignments (feature_id, fold_change, p, predicted, true) of the features in ``cells``, and one row of counts, from ``truth`` (feature_id,
    true_fold_change, true_p_value). Missing cells are left out, zeros too if ``zeros`` is ``missing``. True features without cells are missed."""
    rows = cells.withColumn("area", stats.zero_policy(F.col("area"), zeros))
    tests = with_probability(welch(rows)).select("feature_id", "p")
    found = directions(fold_changes(rows, "keep").select("feature_id", "fold_change").join(tests, "feature_id", "left"), inclusive, **cuts)
    real = directions(truth, inclusive, fold_change="true_fold_change", p="true_p_value", **cuts).select("feature_id", F.col("direction").alias("true"))
    both = found.withColumnRenamed("direction", "predicted").withColumn("_here", F.lit(True)).join(real, "feature_id", "full_outer").na.fill("not_differential", ["predicted", "true"])
    assigned = both.where("_here").drop("_here")
    d, e, none = F.col("predicted"), F.col("true"), F.lit("not_differential")
    n = lambda c: F.count(F.when(c, 1))
    return assigned, both.agg(
        n(F.col("_here")).alias("features"), n(e != none).alias("true_differential"), n(d != none).alias("predicted_differential"), n((d != none) & (d == e)).alias("identified"),
        n((d != none) & (e == none)).alias("false_positive"), n((d == none) & (e != none)).alias("missed"), n((d != none) & (e != none) & (d != e)).alias("mismatched"),
    )


def regression(pairs: DataFrame) -> DataFrame:
    """slope and r2 of observed on reference for each feature; null for fewer than two points; r2 null where the observed do not vary."""
    enough = F.count(F.when(F.col("reference").isNotNull() & F.col("observed").isNotNull(), 1)) > 1
    y = F.when(F.col("reference").isNotNull(), F.col("observed"))
    return pairs.groupBy("feature_id").agg(F.when(enough, F.regr_slope("observed", "reference")).alias("slope"), F.when(enough & (F.var_pop(y) > 0), F.regr_r2("observed", "reference")).alias("r2"))


def relative_errors(pairs: DataFrame) -> DataFrame:
    """n, mean and the number above 1 of |observed - reference| / reference; those above 1 do not enter the mean. A reference of 0 counts as
    above 1 unless the observed is 0 too, which is no error at all."""
    d, r = F.abs(F.col("observed") - F.col("reference")), F.abs(F.col("reference"))
    rows = pairs.select("grp", F.when((r == 0) & (d > 0), F.lit(float("inf"))).otherwise(F.try_divide(d, r)).alias("e")).where("e is not null")
    return rows.groupBy("grp").agg(F.count(F.when(F.col("e") <= 1, 1)).alias("n"), F.avg(F.when(F.col("e") <= 1, F.col("e"))).alias("mean_error"), F.count(F.when(F.col("e") > 1, 1)).alias("n_above"))


def flags(universe: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """feature_id and a boolean for each set of ids; ids outside of ``universe`` are an error of the caller, see ``outside``."""
    return marked(universe, [(s, {k: F.lit(True)}) for k, s in sets.items()])


def marked(universe: DataFrame, sources: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """feature_id of ``universe`` and a boolean for each flag: whether its condition holds in any row that its source has of the feature. The rows of
    all meet in one aggregation; rows of a feature without id mark none, and those of a feature outside of ``universe`` are left out."""
    every = [k for _, conditions in sources for k in conditions]
    row = lambda df, here, own: df.select("feature_id", here.alias("_here"), *(F.coalesce(own.get(k, F.lit(False)), F.lit(False)).alias(k) for k in every))
    rows = [row(universe, F.lit(True), {}), *(row(df.where("feature_id is not null"), F.lit(False), own) for df, own in sources)]
    found = ranks.dealt(reduce(DataFrame.unionByName, rows), "feature_id").groupBy("feature_id").agg(*(F.bool_or(k).alias(k) for k in ["_here", *every]))
    return found.where("_here").drop("_here")


def outside(ids: DataFrame, universe: DataFrame) -> DataFrame:
    return ids.select("feature_id").distinct().join(universe, "feature_id", "left_anti")


def contained(ids: DataFrame, universe: DataFrame, keys: list[str] | None = None, what: str = "ids") -> DataFrame:
    """``ids``, or an error that names some of those outside of ``universe``."""
    keys = keys or ["feature_id"]
    odd = ids.select(*keys).distinct().join(universe.select(*keys).distinct(), keys, "left_anti").orderBy(*keys).limit(3).collect()
    if odd:
        raise ValueError(f"{what} outside of the universe: {[tuple(r) for r in odd]}")
    return ids


def accuracy_summary(methods: DataFrame, qualitative_errors: DataFrame, quantitative_errors: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each of ``methods``: errors of either kind (method, feature_id), their overlap and union, and the accuracy over ``universe``; and the
    wrong features with flags. A method without both kinds of errors calculated (columns qualitative and quantitative of ``methods``) is not_available."""
    kinds = {"qualitative_error": qualitative_errors, "quantitative_error": quantitative_errors}
    marked = [contained(e, universe, what=k).select("method", "feature_id").distinct().withColumn(k, F.lit(1)) for k, e in kinds.items()]
    wrong = marked[0].join(marked[1], ["method", "feature_id"], "full_outer").na.fill(0, list(kinds))
    wrong = wrong.join(F.broadcast(methods.where("qualitative and quantitative").select("method")), "method", "left_semi")  # a few
    one = [F.sum(k).alias(f"{k}_count") for k in kinds]
    n = wrong.groupBy("method").agg(*one, F.sum(F.col("qualitative_error") * F.col("quantitative_error")).alias("overlap_error_count"), F.count("*").alias("unique_error_count"))
    counts = ["qualitative_error_count", "quantitative_error_count", "overlap_error_count", "unique_error_count"]
    known = F.col("qualitative") & F.col("quantitative")
    out = methods.join(n, "method", "left").join(F.broadcast(universe.agg(F.countDistinct("feature_id").alias("evaluated_feature_entries"))))  # one row
    out = out.withColumns({c: F.when(known, F.coalesce(c, F.lit(0))) for c in counts})
    accuracy = F.when(known, 1 - F.col("unique_error_count") / F.col("evaluated_feature_entries"))
    return out.select("method", *counts, "evaluated_feature_entries", accuracy.alias("overall_accuracy"), F.when(known, "calculated").otherwise("not_available").alias("status")), wrong


def quantitative_accuracy(errors: DataFrame, truth: DataFrame) -> DataFrame:
    """method, compared, errors, truth_features, accuracy, from errors (method, is_error) over the features compared and the size of the truth."""
    n = errors.groupBy("method").agg(F.count("*").alias("compared"), F.count(F.when(F.col("is_error"), 1)).alias("errors"))
    out = n.join(F.broadcast(truth.agg(F.countDistinct("feature_id").alias("truth_features"))))  # one row
    return out.withColumn("accuracy", 1 - F.col("errors") / F.col("truth_features"))


def overall_errors(flagged: DataFrame, counted: list[str], joined: list[str]) -> DataFrame:
    """reported: the counts of ``counted`` added to those in any of ``joined``, overlaps counted; unique: those in any at all."""
    one = lambda c: F.sum(F.col(c).cast("long"))
    any_of = lambda cs: reduce(lambda a, b: a | b, map(F.col, cs))
    n = lambda c: F.count(F.when(c, 1))
    reported = reduce(lambda a, b: a + b, map(one, counted)) + n(any_of(joined))
    out = flagged.agg(reported.alias("reported"), n(any_of([*counted, *joined])).alias("unique_errors"), F.count("*").alias("universe"))
    return out.withColumns({"overlap": F.col("reported") - F.col("unique_errors"), "accuracy": 1 - F.col("unique_errors") / F.col("universe")})


def error_sources(flagged: DataFrame, one: str = "qualitative", two: str = "quantitative") -> DataFrame:
    """``error_source`` both, one, two or null."""
    a, b = F.col(one), F.col(two)
    return flagged.withColumn("error_source", F.when(a & b, "both").when(a, one).when(b, two))


def alignment(peaks: DataFrame, most_sd: float = 0.05, most_range: float = 0.1, key: str = "ion_id") -> DataFrame:
    """rt_sd, rt_range and flags for each ion."""
    a = peaks.groupBy(key).agg(F.stddev_samp("rt").alias("rt_sd"), (F.max("rt") - F.min("rt")).alias("rt_range"))
    return a.withColumns({"sd_flag": F.coalesce(F.col("rt_sd") > most_sd, F.lit(False)), "range_flag": F.col("rt_range") > most_range}).withColumn("any_flag", F.col("sd_flag") | F.col("range_flag"))


def checked_counts(flagged: DataFrame, stated: DataFrame, flags: list[str], by: str = "software", key: str = "ion_id") -> DataFrame:
    """Distinct keys with each flag for each ``by``, or an error where they differ from ``stated`` (by, flags)."""
    n = flagged.groupBy(by).agg(*(F.countDistinct(F.when(F.col(f), F.col(key))).alias(f) for f in flags))
    odd = n.join(stated.select(by, *(F.col(f).alias(f"_{f}") for f in flags)), by).where(reduce(lambda a, b: a | b, (F.col(f) != F.col(f"_{f}") for f in flags))).select(by).limit(3).collect()
    if odd:
        raise ValueError(f"flag counts differ from the summary for {[r[0] for r in odd]}")
    return n


def boundary_rates(widths: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """For each software: n, failed, pass_rate, bad components, and of the width differences mean, quartiles and the number above 0.5. ``bad`` holds
    the keys that fail; it is an error if they repeat or are not among those of ``widths``."""
    if bad.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("rows of failed boundaries repeat")
    contained(bad, widths, keys, "failed boundaries")
    rows = widths.join(bad.select(*keys).withColumn("_bad", F.lit(True)), keys, "left")
    wrong, d = F.col("_bad").isNotNull(), F.col("width_difference")
    out = rows.groupBy("software").agg(
        F.count("*").alias("n"), F.count(F.when(wrong, 1)).alias("failed"), F.countDistinct(F.when(wrong, F.col("ion_id"))).alias("bad_components"), F.avg(d).alias("mean_difference"),
        *(F.percentile(d, q).alias(k) for k, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))), F.count(F.when(d > 0.5, 1)).alias("above_half"),
    )
    return out.withColumn("pass_rate", 1 - F.col("failed") / F.col("n"))


def wide_detection(scores: DataFrame, methods: list[str], by: str = "sample_id") -> DataFrame:
    """A row for each sample with columns <method>_<count or metric>, and two of their mean and sample deviation, where counts are null."""
    counts = ["tp", "fp", "fn"]
    of = lambda m, x: F.when(F.col("method") == m, F.col(x))
    rows = scores.groupBy(F.col(by).cast("string").alias(by)).agg(*(F.first(of(m, x), ignorenulls=True).alias(f"{m}_{x}") for m in methods for x in [*counts, *SCORES]))
    none = F.lit(None).cast("long")
    for label, f in (("Mean", F.avg), ("STD", F.stddev_samp)):
        rows = rows.unionByName(scores.agg(F.lit(label).alias(by), *(f(of(m, x)).alias(f"{m}_{x}") for m in methods for x in SCORES), *(F.first(none).alias(f"{m}_{x}") for m in methods for x in counts)))
    return rows


def detection(reference: DataFrame, observed: DataFrame, absent: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores (method, sample_id, counts, metrics) of ``observed`` (method, feature_id, sample_id, area) against the cells of ``reference``, where
    those of the features ``absent`` count as empty; and the features on one side alone (method, feature_id, error_type), whatever their cells."""
    real = reference if absent is None else reference.join(absent.select("feature_id").distinct(), "feature_id", "left_anti")
    listed = [r["method"] for r in observed.select("method").distinct().collect()]  # a few
    everywhere = reference.select("sample_id").distinct().select(F.lit(None).cast(reference.schema["feature_id"].dataType).alias("feature_id"), "sample_id", F.lit(None).cast("double").alias("area"))
    own = lambda m: observed.where(F.col("method") == m).select("feature_id", "sample_id", "area")
    scores = [presence_against(own(m), real.select("feature_id", "sample_id", "area").unionByName(everywhere)).withColumn("method", F.lit(m)) for m in listed]
    wrong = [error_types(own(m), reference, "component_set").withColumn("method", F.lit(m)) for m in listed]
    return reduce(DataFrame.unionByName, scores), reduce(DataFrame.unionByName, wrong)


def integration(reference: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of cells (method, feature_id, sample_id, area) against ``reference``: five numbers of the variation over the features that all have (the reference as
    method ``reference``), of relative errors over those a method shares with it, and of slope and r2 by feature over those that all have."""
    own = reference.select(F.lit("reference").alias("method"), "feature_id", "sample_id", "area").unionByName(observed.select("method", "feature_id", "sample_id", "area"))
    shared = own.join(common_features(own), "feature_id", "left_semi")
    variation = five_numbers(shared.groupBy("method", "feature_id").agg(stats.cv_present(F.col("area")).alias("cv")), "cv", ["method"])
    pairs = observed.select("method", "feature_id", "sample_id", F.col("area").alias("observed")).join(reference.select("feature_id", "sample_id", F.col("area").alias("reference")), ["feature_id", "sample_id"])
    d, r = F.abs(F.col("observed") - F.col("reference")), F.abs(F.col("reference"))
    e = pairs.withColumn("e", F.when((r == 0) & (d > 0), F.lit(float("inf"))).otherwise(F.try_divide(d, r)))
    errors = five_numbers(e.withColumn("e", F.when(F.col("e") <= 1, F.col("e"))), "e", ["method"])
    errors = errors.join(e.groupBy("method").agg(F.countDistinct("feature_id").alias("feature_count"), F.count(F.when(F.col("e") > 1, 1)).alias("excluded_above_1")), "method")
    fits = pairs.join(common_features(own), "feature_id", "left_semi").withColumn("feature_id", F.struct("method", "feature_id"))
    fits = regression(fits).select(F.col("feature_id.method").alias("method"), "slope", "r2").unpivot(["method"], ["slope", "r2"], "metric", "value")
    return variation, errors, five_numbers(fits, "value", ["method", "metric"])


def missing_in_all(cells: DataFrame) -> Column:
    return F.count("area").over(Window.partitionBy("feature_id")) == 0
