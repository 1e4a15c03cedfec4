"""Whole evaluations against plain counts."""

import pytest

from eluent.plans import scoring
from eluent.sources import tables

SAMPLES = [("a1", "A"), ("a2", "A"), ("a3", "A"), ("b1", "B"), ("b2", "B"), ("b3", "B")]


def cells(spark, rows):
    flat = [(f, s, g, v) for f, values in rows.items() for (s, g), v in zip(SAMPLES, values, strict=True)]
    return spark.createDataFrame(flat, "feature_id string, sample_id string, grp string, area double")


def test_dataset(spark):
    one = cells(spark, {"t1": [1.0, 1.1, 0.9, 4.0, 4.1, 3.9], "t2": [4.0, 4.0, 4.1, 1.0, None, 1.1], "d1": [2.0, 2.0, 2.0, 2.0, 2.0, 2.0], "d2": [None, None, None, None, 1.0, 1.0]})
    two = cells(spark, {"t1": [1.0, 1.1, 0.9, 1.0, 1.1, 0.9], "t3": [1.0] * 6})
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "feature_id string")
    real = spark.createDataFrame([("t1", 4.0, 0.001), ("t2", 0.25, 0.001), ("t3", 3.0, 0.001), ("gone", 0.1, 0.001)], "feature_id string, true_fold_change double, true_p_value double")
    out = scoring.dataset(["one", "two", "three"], {"one": one, "two": two}, ids("t1", "t2", "t3"), real, ids("t1", "t2", "t3", "d1", "d2", "gone"))
    errors = {(r["method"], r["feature_id"]): r["error_type"] for r in out["qualitative_errors"].collect()}
    assert errors == {("one", "t2"): "FN", ("one", "t3"): "FN", ("one", "d1"): "FP", ("two", "t2"): "FN"}
    assert {(r["method"], r["feature_id"]) for r in out["quantitative_comparison"].where("is_error").collect()} == {("one", "t2"), ("two", "t1"), ("two", "t3")}
    final = {r["method"]: r for r in out["final_summary"].collect()}
    assert (final["one"]["unique_error_count"], final["one"]["overlap_error_count"], final["one"]["overall_accuracy"]) == (3, 1, 0.5)
    assert (final["two"]["unique_error_count"], final["three"]["status"], final["three"]["unique_error_count"]) == (3, "not_available", None)
    calls = {r["method"]: r for r in out["differential_summary"].collect()}
    assert (calls["one"]["identified"], calls["one"]["missed"], calls["one"]["true_differential"]) == (2, 2, 4)
    assert (calls["two"]["identified"], calls["two"]["missed"], calls["two"]["false_positive"]) == (0, 4, 0)
    q = {r["method"]: r for r in out["quality"].collect()}
    assert (q["one"]["rows_removed_missing"], q["one"]["compared"], q["one"]["total_error_rate_percent"]) == (1, 2, 50.0)
    assert out["cv_summary"].count() == 4 and out["cv_values"].count() == 12
    common = scoring.dataset(["one", "two"], {"one": one, "two": two}, ids("t1"), real, ids("t1", "t2", "t3", "d1", "d2"), common_cv=True)
    assert common["cv_values"].count() == 4
    with pytest.raises(ValueError, match="true features"):
        scoring.dataset(["one"], {"one": one}, ids("t9"), real, ids("t1"))
    with pytest.raises(ValueError, match="options"):
        scoring.dataset(["one"], {"one": one}, ids("t1"), real, ids("t1"), other=1)


def test_overall(spark):
    errors = spark.createDataFrame([("m", "a", "FP"), ("m", "b", "FN"), ("m", "IS001", "FN")], "method string, feature_id string, error_type string")
    of = lambda *names: spark.createDataFrame([("m", n) for n in names], "method string, feature_id string")
    universe = spark.createDataFrame([(n,) for n in ("a", "b", "c", "d", "e", "IS001")], "feature_id string")
    r = scoring.overall(universe, errors, of("c"), of("a", "c"), of("c", "d"), ("IS001",)).first()
    assert (r["fp"], r["fn"], r["quantitative"], r["reported"], r["unique_errors"], r["overlap"], r["universe"], r["reported_rate"]) == (1, 1, 3, 5, 4, 1, 5, 1.0)


def test_validated_tables(spark):
    wide = spark.createDataFrame([("a", "1", "2"), ("b", "x", None)], "feature_id string, s1 string, s2 string")
    assert tables.validated(wide, "feature_id", ["s1", "s2"]).count() == 2
    for bad, samples, what in ((wide, ["s1"], "even"), (wide, ["s1", "s3"], "missing"), (wide.union(wide), ["s1", "s2"], "repeated"), (wide.replace("a", " "), ["s1", "s2"], "1 blank")):
        with pytest.raises(ValueError, match=what):
            tables.validated(bad, "feature_id", samples)
