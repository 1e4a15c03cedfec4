import base64
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eluent.functions import kernels, names, signal, stats
from eluent.operators import cluster, curate, evaluate, joins, matrix, refine, sampling, traces
from eluent.plans import bindings
from eluent.sources import mzml, tables
from eluent.sources.stages import Stages


def signal_df(spark, *ys, step=1.0):
    return spark.createDataFrame([(i, [(k * step, float(y)) for k, y in enumerate(v)]) for i, v in enumerate(ys)], "id int, points array<struct<rt:double,intensity:double>>")


def test_areas(spark):
    df = signal_df(spark, [5], [1, 3, 1], [], step=0.5)
    got = [r[0] for r in df.orderBy("id").select(signal.peak_area(F.col("points"))).collect()]
    assert got == [0.0, pytest.approx(60.0), 0.0]


@pytest.mark.parametrize(("mode", "area", "height"), [("linear", 3.0, 2.0), ("edge_min", 4.5, 2.5), ("none", 7.5, 3.5)])
def test_integration(spark, mode, area, height):
    df = signal_df(spark, [9, 1, 3.5, 3, 2, 9])
    x = df.select(signal.integrate(F.col("points"), F.lit(4.0), F.lit(1.0), mode).alias("x")).first()["x"]
    y = np.array([1, 3.5, 3, 2.0])
    y = np.maximum(y - {"linear": np.interp(range(4), [0, 3], [1, 2]), "edge_min": 1, "none": 0}[mode], 0)
    assert (x["area"], x["height"], x["points"]) == (pytest.approx(np.trapezoid(y)), pytest.approx(y.max()), 4)
    assert df.select(signal.integrate(F.col("points"), F.lit(50.0), F.lit(60.0)).alias("x")).first()["x"].asDict() == {"area": 0.0, "height": 0.0, "apex_rt": None, "points": 0}


def test_smoothing(spark):
    y = [((k * 37) % 11) + k / 7 for k in range(60)]
    m = signal_df(spark, y).select(signal.savgol(signal.intensities(F.col("points")), 5, 2).alias("m")).first()["m"]
    for at, fit in [(0, slice(0, 5)), (1, slice(0, 5)), (30, slice(28, 33)), (58, slice(55, 60)), (59, slice(55, 60))]:
        x = np.arange(60)[fit]
        assert m[at] == pytest.approx(np.polyval(np.polyfit(x, np.array(y)[fit], 2), at))
    short = kernels.smooth3(np.array(y[:10]))
    again = signal_df(spark, y[:10]).select(signal.savgol(signal.intensities(F.col("points")), 3, 1).alias("m")).first()["m"]
    assert short.tolist() == pytest.approx(again)


def plain_snr(y, t, lo, hi):
    """The family in plain numpy."""
    y, n = np.array(y, float), len(y)
    w, o = (5, 2) if n >= 50 else (3, 1)
    h = w // 2
    m = [np.polyval(np.polyfit(range(w), y[(a := min(max(k - h, 0), n - w)) : a + w], o), k - a) for k in range(n)]
    q = np.array([(v - s) / math.sqrt(abs(v)) if v else 0.0 for v, s in zip(y, m, strict=True)])
    sd = q.std()
    sd = q[np.abs(q) <= 2 * sd].std()
    base, p, out = max(sorted(m)[int(n * 0.3)], 1), y[lo : hi + 1], np.concatenate([y[:lo], y[hi:]])
    k = int(n * 0.1)
    sd2 = (out[k:-k] if len(out) > 2 * k else out).std()
    e = 3 if n <= 35 else 5
    a, b = y[max(lo - e, 0) : lo], y[hi : hi + e]
    sn = (p.max() - p.min()) / (sd * math.sqrt(base))
    add1, add2 = (y[:lo].max() if lo > 3 else p.min()), (y[hi:].max() if hi < n - 3 else p.min())
    add = add2 if t[lo] - t[0] <= 0.2 else add1 if t[-1] - t[hi] <= 0.2 else min(add1, add2)
    over = lambda x: p.max() / (max(x) + 1 if len(x) else 1)
    return [sn, base, (p.max() - out.mean()) / sd2, over(np.concatenate([a, b])), over(a), over(b), p.max() / (add + 1), p.max() / out.max()]


@pytest.mark.parametrize(("n", "lo", "hi"), [(20, 8, 12), (64, 30, 36), (40, 1, 6), (64, 55, 62)])
def test_snr(spark, n, lo, hi):
    r = np.random.default_rng(n)
    y = (50 + r.random(n) * 20 + 400 * np.exp(-0.5 * ((np.arange(n) - (lo + hi) / 2) / 2) ** 2)).tolist()
    df = signal.with_snr(signal_df(spark, y, step=0.05).withColumns({"lo": F.lit(lo), "hi": F.lit(hi)}))
    assert list(df.first()["snr"]) == pytest.approx(plain_snr(y, [k * 0.05 for k in range(n)], lo, hi))


def test_snr_is_linear_in_points(spark):
    import time

    def took(n):
        y = [[float((k * 37 + j) % 101) + (500.0 if k == n // 2 else 0.0) for k in range(n)] for j in range(10)]
        df = signal_df(spark, *y, step=0.01).withColumns({"lo": F.lit(n // 2 - 3), "hi": F.lit(n // 2 + 3)}).repartition(1).cache()
        df.count()
        began = time.time()
        signal.with_snr(df).select("snr").collect()
        return time.time() - began

    took(400)
    small, large = min(took(3_200) for _ in range(3)), min(took(6_400) for _ in range(3))
    assert large < 2.3 * small + 0.3


def test_to_baseline_against_steps(spark):
    def steps(y, base, lo, hi):
        """The higher edge moves a point at a time: first until near the baseline, then while the signal does not rise."""
        edge = {1: hi, -1: lo}
        for way, end in ((1, len(y) - 1), (-1, 0)):
            if y[edge[way]] > y[edge[-way]]:
                far = lambda: abs(y[edge[way]] - base) < max(y[edge[-1] : edge[1]], default=-math.inf) / 3  # noqa: B023, E731
                while edge[way] != end and not far():
                    edge[way] += way
                while edge[way] != end and y[edge[way] + way] <= y[edge[way]]:
                    edge[way] += way
        return edge[-1], edge[1]

    r = np.random.default_rng(0)
    for _ in range(3_000):
        n = int(r.integers(2, 30))
        y, (lo, hi), base = r.integers(0, 12, n).astype(float), np.sort(r.integers(0, n, 2)).tolist(), float(r.integers(0, 6))
        assert kernels.to_baseline(y, base, lo, hi) == steps(y.tolist(), base, lo, hi)


def test_spline_against_a_dense_system():
    r = np.random.default_rng(5)
    for m in (4, 5, 9, 40):
        t, y = np.cumsum(r.uniform(0.1, 2, m)), r.normal(0, 10, m)
        h, a, b = np.diff(t), np.zeros((m, m)), np.zeros(m)
        for i in range(1, m - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        a[0, :3], a[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
        c = np.linalg.solve(a, b)
        x, got = kernels.cubic(t, y, 97)
        k = np.clip(np.searchsorted(t, x, "right") - 1, 0, m - 2)
        d, e = x - t[k], t[k + 1] - x
        want = c[k] * e**3 / (6 * h[k]) + c[k + 1] * d**3 / (6 * h[k]) + (y[k] / h[k] - c[k] * h[k] / 6) * e + (y[k + 1] / h[k] - c[k + 1] * h[k] / 6) * d
        assert np.allclose(got, want, atol=1e-6)
    t = np.linspace(0, 3, 7)
    assert np.allclose(kernels.cubic(t, t**3 - t, 31)[1], np.linspace(0, 3, 31) ** 3 - np.linspace(0, 3, 31))  # a cubic is its own spline


def test_boxes_and_shapes(spark):
    df = signal_df(spark, [0, 1, 4, 9, 4, 1, 0])
    p = F.col("points")
    r = df.select(signal.box_bounds(p, F.lit(112.0), F.lit(68.0)).alias("b"), signal.fwhm(p).alias("w"), signal.local_minima(signal.intensities(p)).alias("m"), signal.islands(F.array(*map(F.lit, [1, 2, 3, 7, 9, 10]))).alias("i")).first()
    assert tuple(r["b"]) == (2, 4) and r["w"] == 2.0 and r["m"] == [] and [tuple(x) for x in r["i"]] == [(1, 3), (7, 7), (9, 10)]


def test_kernels():
    y = np.array([50, 100, 50, 60, 40.0])
    assert kernels.trimmed_first(y, 0, 3) == (0, 0)  # the right minimum is met on the left first
    assert kernels.trimmed_relative(np.array([8, 3, 5, 9, 5, 2, 6, 1.0]), 0, 6, "C", 0.5) == (1, 6)
    assert kernels.trimmed_relative(y, 0, 3, "A", 0.1) == kernels.trimmed_relative(y, 0, 3, "B", 0.95) == (0, 3)
    assert kernels.split_bimodal(np.array([0, 5, 10, 5, 0, 0, 5, 10, 5, 0.0])) == [(0, 4), (4, 9)] or len(kernels.split_bimodal(np.array([0, 5, 10, 5, 0, 0, 5, 10, 5, 0.0]))) == 2
    assert kernels.split_bimodal(np.array([0, 5, 10, 5, 0.0])) == [(0, 4)]
    assert kernels.steep_part(np.arange(5.0), np.array([0, 0, 10, 0, 0.0])) == (2, 3)
    assert kernels.to_baseline(np.array([1, 5, 9, 6, 3, 1, 2.0]), 1.0, 0, 3) == (0, 5)
    t = np.array([0, 1, 2.5, 3, 5])
    assert kernels.cubic(t, t**3 - t, 11)[1] == pytest.approx(np.linspace(0, 5, 11) ** 3 - np.linspace(0, 5, 11))
    assert kernels.resampled(np.array([0, 2, 4.0]), 5).tolist() == [0, 0.25, 0.5, 0.75, 1]


def test_clusters(spark):
    assert cluster.merged_labels([0, 1, 2], [1.0, 1.03, 1.06], 0.04) == [(0, 0, 1.0), (1, 0, 1.0), (2, 1, 1.03)]
    rows = [("a", "i", 1.0), ("b", "i", 1.1), ("a", "i", 9.0), ("c", "i", 1.1), ("a", "k", 2.0), ("b", "k", 2.0)]
    got = cluster.rt_gap_clusters(spark.createDataFrame(rows, "sample_id string, ion_id string, rt double"), 0.4)
    assert sorted((r["ion_id"], r["rt"], r["label"]) for r in got.collect()) == [("i", 1.0, 0), ("i", 1.1, 0), ("i", 1.1, 0), ("i", 9.0, 1), ("k", 2.0, 0), ("k", 2.0, 0)]
    best = cluster.select_best(cluster.summaries(got), F.lit(1.0)).collect()
    assert {(r["ion_id"], r["label"]) for r in best} == {("i", 0), ("k", 0)}


def test_matrix_and_refining(spark):
    cells = spark.createDataFrame([("i", "a", 1.0), ("i", "b", None)], "ion_id string, sample_id string, area double")
    new = spark.createDataFrame([("i", "b", 5.0), ("k", "a", 7.0)], "ion_id string, sample_id string, area double")
    assert sorted(map(tuple, matrix.upsert(cells, new, ["ion_id", "sample_id"], ["area"]).collect())) == [("i", "a", 1.0), ("i", "b", 5.0), ("k", "a", 7.0)]
    assert matrix.grid(cells, cells).count() == 4
    ys = [[(float(k), 50.0 + (1000.0 if k == 9 else k)) for k in range(20)], [(0.0, 900.0)] * 5]
    s = spark.createDataFrame([("a", "i", ys[0]), ("b", "i", ys[1])], "sample_id string, ion_id string, points array<struct<rt:double,intensity:double>>")
    p = refine.refound(s).collect()
    assert [(r["sample_id"], r["rt"], r["rtmin"], r["rtmax"], r["points"], r["class"]) for r in p] == [("a", 9.0, 4.0, 14.0, 11, "D")]
    assert p[0]["area"] == sum(50.0 + (1000.0 if k == 9 else k) for k in range(4, 15)) and p[0]["baseline"] == 50.0


def test_welch(spark):
    p = stats.t_probabilities(pd.Series([12.7062, 2.228139, 0.0, None, 1.96, -3.0, 1e9, 0.001, 2.0]), pd.Series([1, 10, 5, 3, 1e6, 4.5, 2, 80, None]))
    assert p[:3].tolist() == pytest.approx([0.05, 0.05, 1.0], abs=1e-6) and p.isna().tolist() == [False] * 3 + [True] + [False] * 4 + [True]
    for t, v, found in ((1.96, 1e6, p[4]), (-3.0, 4.5, p[5]), (0.001, 80, p[7])):
        x = np.linspace(0, abs(t), 200_001)
        density = np.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
        assert found == pytest.approx(1 - 2 * np.trapezoid(density, x), rel=1e-6)
    assert p[6] == pytest.approx(1e-18, rel=1e-3)
    assert stats.t_probabilities(pd.Series([], dtype=float), pd.Series([], dtype=float)).empty
    rows = [("f", g, v) for g, vs in (("A", [1.0, 2.0, 3.0]), ("B", [4.0, 6.0, 8.0])) for v in vs] + [("z", g, v) for g, v in (("A", 1.0), ("A", 1.0), ("B", 2.0), ("B", 2.0))]
    got = {r["feature_id"]: r for r in evaluate.with_probability(evaluate.welch(spark.createDataFrame(rows, "feature_id string, grp string, area double"))).collect()}
    assert got["z"]["p"] == 0.0 and got["z"]["t"] is None
    assert got["f"]["t"] == pytest.approx(-4 / math.sqrt(1 / 3 + 4 / 3)) and 0 < got["f"]["p"] < 0.1


def test_numeric_joins(spark):
    t = spark.createDataFrame([(1, 100.0), (2, 200.0)], "k int, target double")
    rows = spark.createDataFrame([(10, 99.0), (11, 101.0), (12, 199.0), (13, 203.0)], "r int, mz double")
    got = joins.nearest(t, rows, "k", "target", "mz", F.lit(1.5), 5.0, ["r"])
    assert sorted((r["k"], r["r"]) for r in got.collect()) == [(1, 10), (2, 12)]  # the lower of two equally near
    assert joins.nearest(t, rows, "k", "target", "mz", F.lit(1.0), 5.0, ["r"]).count() == 0  # strictly within
    spectrum = spark.createDataFrame([(101.0,), (100.999,), (102.0,), (103.0,)], "mz double").withColumn("r", F.lit(1))
    assert sorted(r["mz"] for r in joins.away_from(spectrum, t.where("k = 1"), "r", "mz", "target", 1.0).collect()) == [101.0, 102.0, 103.0]


def test_samples(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(103)], "id int, c int")
    a = sorted(map(tuple, sampling.fixed_size(df.repartition(7), "id", 10).collect()))
    assert a == sorted(map(tuple, sampling.fixed_size(df.coalesce(1), "id", 10).collect())) and len(a) == 10
    with pytest.raises(ValueError, match="there are 103"):
        sampling.fixed_size(df, "id", 104)
    split = sampling.stratified_split(df, "id", ["c"], ["train", "val", "test"], [0.8, 0.1, 0.1])
    n = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert n == dict(zip(["train", "val", "test"], sampling.largest_remainder(103, [0.8, 0.1, 0.1]), strict=True)) and sum(n.values()) == 103
    with pytest.raises(ValueError, match="add up"):
        sampling.validate_ratios([0.5, 0.4])
    labels = spark.createDataFrame([("a", 0, 1, 0.2, 0.5, 0.1, 0.1)], "stem string, line int, class_id int, xc double, yc double, w double, h double")
    twice = sampling.flip(sampling.flip(labels).where("stem = 'a'"))
    assert sorted((r["stem"], r["xc"]) for r in twice.collect()) == [("a", 0.2), ("flip_a", 0.8)]


def test_names(spark):
    df = spark.createDataFrame([("x_P_1 (3)", "x-mix07_P(2).mzML"), ("x_HN2", "mix08.mzML"), ("plain", "a-b-c (1).mzML")], "s string, f string")
    got = df.select(names.polarity(F.col("s")), names.run_order(F.col("s")), names.sample_of_file(F.col("f")), names.with_polarity(F.col("s"), F.lit("N"))).collect()
    assert [tuple(r) for r in got] == [("x_P", 3, "mix07_P", "x_P_1 (3)_N"), ("x_HN", 1, "mix08", "x_HN2_N"), ("plain", 1, "c", "plain_N")]
    keys = spark.createDataFrame([("Ion10",), ("ion2",), ("Ion1a",)], "s string").orderBy(names.natural_key(F.col("s"))).collect()
    assert [k[0] for k in keys] == ["Ion1a", "ion2", "Ion10"]


def encoded(values, kind):
    return base64.b64encode(np.array(values, kind).tobytes()).decode()


def test_mzml(spark, tmp_path):
    array = lambda values, bits: f'<binaryDataArray><cvParam name="{bits}-bit float"/><binary>{encoded(values, f"<f{bits // 8}")}</binary></binaryDataArray>'
    chrom = lambda i, t, y, bits: f'<chromatogram id="{i}"><binaryDataArrayList>{array(t, 64)}{array(y, bits)}</binaryDataArrayList></chromatogram>'
    scan = lambda k, level, t, unit, m, y: f'<spectrum index="{k}"><cvParam name="ms level" value="{level}"/><scanList><scan><cvParam name="scan start time" value="{t}" unitName="{unit}"/></scan></scanList><binaryDataArrayList>{array(m, 64)}{array(y, 32)}</binaryDataArrayList></spectrum>'
    body = chrom("TIC", [1, 2], [5, 6], 32) + chrom("SRM SIC Q1=100.5 Q3=50 name=ionA start=0.5 end=x", [1, 2], [5, 6.5], 64)
    body += scan(0, 1, 60, "second", [100.0, 100.0005, 200.0], [1, 2, 3]) + scan(1, 2, 1.5, "minute", [100.0], [9]) + scan(2, 1, 2, "minute", [300.0], [4])
    (tmp_path / "run-mix07_P.mzML").write_text(f"<indexedmzML><mzML><run>{body}</run></mzML></indexedmzML>")
    c = {r["kind"]: r for r in mzml.chromatograms(spark, str(tmp_path)).collect()}
    assert (c["SRM"]["sample_id"], c["SRM"]["ion_id"], c["SRM"]["q1"], c["SRM"]["win_start"], c["SRM"]["win_end"]) == ("mix07_P", "ionA", 100.5, 0.5, None)
    assert [tuple(p) for p in c["SRM"]["points"]] == [(1.0, 55.0), (2.0, 56.5)] and [tuple(p) for p in c["TIC"]["points"]] == [(1.0, 55.0), (2.0, 56.0)]
    s = mzml.spectra(spark, str(tmp_path))
    assert sorted((r["scan"], r["rt"]) for r in s.collect()) == [(0, 1.0), (2, 2.0)]
    features = spark.createDataFrame([("f", 100.0003, 1.4)], "ion_id string, mz double, rt double")
    traces = mzml.ion_traces(s, features).collect()
    assert [tuple(p) for p in traces[0]["points"]] == [(1.0, 52.0), (2.0, 50.0)]
    assert tuple(mzml.rt_ranges(s).first())[1:] == (1.0, 2.0, 2)


def test_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("id\ts1\ts2\n a \t1.5\tNA\n\t2\tx\na\t1\t1\n")
    df = tables.read(spark, str(tmp_path / "m.tsv"))
    assert tables.problems(df, "id") == {"blank": 1, "repeated": 1}
    assert sorted((r["feature_id"] or "", r["sample_id"], r["area"] or -1) for r in tables.areas(df, "id", ["s1", "s2"]).collect())[:2] == [("", "s1", 2.0), ("", "s2", -1)]
    listed = spark.createDataFrame([("m.tsv", "0" * 64), ("gone.tsv", "x")], "file string, sha256 string")
    assert {r["file"]: r["status"] for r in tables.manifest(spark, str(tmp_path), listed).collect()} == {"m.tsv": "differs", "gone.tsv": "MISSING"}
    files = spark.createDataFrame([("a.mzML",), ("b.mzML",), ("b.cdf",)], "file string")
    got = tables.raw_file_status(spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string"), files)
    assert {r["sample_id"]: r["status"] for r in got.collect()} == {"a": "matched", "b": "duplicate_raw_matches", "c": "no_raw_match"}
    f = tables.feature_table(spark.createDataFrame([("x", "100.5", "2"), (None, "200", "3"), ("y", "bad", "1")], "`Compound Name` string, MZ string, `RT (minutes)` string"))
    assert sorted((r["mz"], r["rt"]) for r in f.collect()) == [(100.5, 2.0), (200.0, 3.0)]
    tables.write_tsv(spark.createDataFrame([(1, 1 / 3, None)], "a int, b double, c string"), str(tmp_path / "out"), 10)
    text = next((tmp_path / "out").glob("part*")).read_text()
    assert text == "a\tb\tc\n1\t0.3333333333\tNA\n"


def test_curation(spark):
    s = spark.createDataFrame([("f", k, [(float(i), 1.0) for i in range(5)]) for k in "ab"], "feature_id string, sample_id string, points array<struct<rt:double,intensity:double>>")
    f = spark.createDataFrame([("f", 2.0, None, None)], "feature_id string, rt double, rtmin double, rtmax double")
    e = spark.createDataFrame([("f", "a", 1, 3.0, 1.0), ("f", None, 0, 0.0, 4.0), ("f", "b", -2, 1.0, 1.0)], "feature_id string, sample_id string, seq long, rt_left double, rt_right double")
    got = {r["sample_id"]: r for r in curate.curated(s, f, e, "none").collect()}
    assert (got["a"]["rt_left"], got["a"]["rt_right"], got["a"]["area"]) == (1.0, 3.0, 2.0) and (got["b"]["area"], got["b"]["edited"]) == (4.0, True)
    plain = curate.curated(s, f, e.limit(0), "none").first()
    assert (plain["rt_left"], plain["edited"]) == (2.0 - 0.12, False)


def test_stages(spark, tmp_path):
    stages = lambda **p: Stages(spark, str(tmp_path / "s"), p)
    written = lambda name: next((tmp_path / "s" / name).glob("part*")).name
    assert stages().keep("a", spark.range(3)).count() == 3
    first = written("a")
    assert stages().keep("a", spark.range(3)).count() == 3 and written("a") == first  # what is there is not made again
    assert stages().keep("a", spark.range(9)).count() == 9 and written("a") != first  # another plan is
    spark.range(4).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.read.parquet(str(tmp_path / "in"))

    def both(**p):
        s = stages(**p)
        s.keep("b", read().where("id > 0"))
        return s.keep("c", s.keep("b", read().where("id > 0")).selectExpr("id * 2 as id")).count(), written("b"), written("c")

    n, b, c = both(ppm=5)
    assert n == 3 and both(ppm=5) == (3, b, c)
    again = both(ppm=6)
    assert again[0] == 3 and again[1] != b and again[2] != c  # another parameter
    spark.range(6).write.mode("overwrite").parquet(str(tmp_path / "in"))
    later = both(ppm=6)
    assert later[0] == 5 and later[1] != again[1] and later[2] != again[2]  # other files, and the stage after
    (tmp_path / "s" / "c" / "_fingerprint").unlink()  # a stage that broke off
    assert both(ppm=6)[0] == 5 and written("c") != later[2]


def test_targeted_peak_rules(spark):
    bell, weak = [50] * 10 + [1000, 9000, 30000, 9000, 1000] + [50] * 10, [50] * 10 + [50, 2000, 4000, 2000, 50] + [50] * 10
    cases = [  # sample, class, signal, lo, hi, sn_5, kept
        ("mix1_P", "A", bell, 10, 14, 9.0, True), ("mix1_P", "A", [9000, 4000, 50, 50] + bell, 0, 2, 9.0, False), ("s1_P", "A", [9000, 4000, 50, 50] + bell, 0, 2, 9.0, True),
        ("mix1_P", "A", bell + [50, 4000, 9000], 25, 27, 9.0, False), ("mix1_P", "A", [50, 2000, 50] + bell, 0, 2, 9.0, False), ("mix1_P", "C", weak, 10, 14, 1.5, False), ("mix1_P", "A", weak, 10, 14, 1.6, True),
        ("s1_P", "A", weak, 10, 14, 1.9, False), ("s1_P", "B", weak, 10, 14, 2.0, True), ("s1_P", "C", weak, 10, 14, 1.9, True),
    ]
    rows = [(i, s, c, [(k * 0.03, float(v)) for k, v in enumerate(y)], lo, hi, sn) for i, (s, c, y, lo, hi, sn, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, s string, c string, points array<struct<rt:double,intensity:double>>, lo int, hi int, sn double")
    got = df.select("i", refine.peak_rules(*map(F.col, ("points", "lo", "hi", "sn", "s", "c"))).alias("ok")).orderBy("i").collect()
    assert [g["ok"] for g in got] == [c[-1] for c in cases]


def test_nearest_and_windows_make_no_pairs_of_copies(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(v) / 4) for i, v in enumerate(r.integers(-400, 400, 900))] + [(900, None), (901, float("nan")), (902, float("inf"))]
    targets = [(k, float(v) / 4) for k, v in enumerate(r.integers(-420, 420, 500))] + [(500, None), (501, float("nan")), (502, 1e6)]
    df, t = spark.createDataFrame(rows, "r int, mz double"), spark.createDataFrame(targets, "k int, target double")
    plain = [(i, v) for i, v in rows if v is not None and abs(v) < float("inf")]
    found = joins.nearest(t, df, "k", "target", "mz", F.lit(0.6), 0.6, ["r"])
    want = {k: min(((abs(v - x), v, i) for i, v in plain if abs(v - x) < 0.6), default=None) for k, x in targets if x is not None and x == x}
    assert {x["k"]: (x["distance"], x["mz"], x["r"]) for x in found.collect()} == {k: v for k, v in want.items() if v}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert joins.nearest(t, df, "k", "target", "mz", F.lit(0.6), 0.6, []).count() == sum(v is not None for v in want.values())
    for mode, f in (("sum", sum), ("max", max)):
        got = joins.window_reduce(t.where("k <> 501"), df, "k", "target", "mz", F.col("target") - 0.5, F.col("target") + 0.5, 0.5, "r", mode)
        inside = {k: [i for i, v in plain if x is not None and abs(v - x) <= 0.5] for k, x in targets if k != 501}
        assert {x["k"]: (x["r"], x["n"]) for x in got.collect()} == {k: (f(v) if v else 0, len(v)) for k, v in inside.items()}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate") >= 3  # equal windows and equal values are one before they meet


def test_merging_takes_keys_in_batches(spark):
    r = np.random.default_rng(6)
    rows = [(k, label, int(seq), float(r.integers(0, 40)) / 4) for k in range(40) for label, seq in enumerate(r.permutation(int(r.integers(1, 7))))]
    df = spark.createDataFrame(rows, "ion_id int, label long, first_seq int, mean_rt double").repartition(3)
    for order, at in (("label", 1), ("first_seq", 2)):
        merged = cluster.merge_close(df, 1.0, order=order)
        own = {k: sorted((x for x in rows if x[0] == k), key=lambda x: x[at]) for k in range(40)}
        want = [(k, *m) for k, xs in own.items() for m in cluster.merged_labels([x[1] for x in xs], [x[3] for x in xs], 1.0)]
        assert sorted(map(tuple, merged.collect())) == sorted(want) and any(w[1] != w[2] for w in want)
        assert "FlatMapGroupsInPandas" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert cluster.merge_close(df.limit(0)).count() == 0


def shape(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_joined_as_ions(spark):
    d = "/root/testdata/sf0.001"
    plan = shape(bindings.cells(spark, d))
    assert plan.index("Generate") < plan.index("Join")  # rows of samples are made after the join
    plain = {(r["ion_id"], r["sample_id"]): r["a"] for r in bindings.peaks(spark, d).where("class = 'R'").groupBy("ion_id", "sample_id").agg(F.max("area").alias("a")).collect()}
    ions = [r[0] for r in bindings.table(spark, d, "part").select("p_partkey").collect()]
    assert sorted((r["ion_id"], r["sample_id"], r["area"] or 0.0) for r in bindings.cells(spark, d).collect()) == sorted((i, s, plain.get((i, s), 0.0)) for i in ions for s in bindings.SAMPLES)


def test_filling_deals_cells_over_all_partitions(spark):
    cells = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (2, 0, None), (None, 0, None)], "ion_id int, sample_id int, area double")
    info = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (None, 0, 7.0)], "ion_id int, sample_id int, area double")
    got = matrix.fill(cells, info, ["ion_id", "sample_id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, 0, 5.0), (1, 1, 2.0), (2, 0, None), (None, 0, None)], cells.schema).collect()))
    assert "RepartitionByExpression" in shape(got)


def test_row_filters_make_no_join(spark):
    rows = [(k, f"{'mix' if s > 1 else 's'}{s}", 1.0 if (k >> s) & 1 else None) for k in range(16) for s in range(4)] + [(None, "mix3", 1.0)]
    cells = spark.createDataFrame(rows, "ion_id int, sample_id string, area double").repartition(3)
    mixed, enough = matrix.mix_rows(cells), matrix.enough_present(cells, "ion_id", F.col("n") / 2)
    assert "Join" not in shape(mixed) + shape(enough) and mixed.columns == enough.columns == cells.columns
    assert sorted(mixed.collect()) == sorted(r for r in rows if r[0] is not None and r[0] >> 2 > 0)
    assert sorted((r["ion_id"], r["sample_id"]) for r in enough.collect()) == sorted(r[:2] for r in rows if r[0] is not None and bin(r[0]).count("1") >= 2)
    plain = matrix.mix_rows(cells.where("sample_id like 's%'"))
    assert plain.count() == 32  # no mix samples, all stay


def test_presence_against_cells_makes_no_join(spark):
    seen = spark.createDataFrame([("f", "a", 1.0), ("f", "a", 2.0), ("g", "a", 1.0), ("g", "b", None), (None, "a", 1.0)], "feature_id string, sample_id string, area double")
    real = spark.createDataFrame([("f", "a", 1.0), ("h", "a", 1.0), ("h", "b", 1.0), (None, "a", 1.0), ("f", "c", None)], "feature_id string, sample_id string, area double")
    got = evaluate.presence_against(seen, real)
    assert sorted((r["sample_id"], r["tp"], r["fp"], r["fn"]) for r in got.collect()) == [("a", 1, 2, 2), ("b", 0, 0, 1), ("c", 0, 0, 0)]
    assert "FullOuter" not in shape(got)


def test_methods_are_not_dealt_by_name(spark):
    methods = spark.createDataFrame([("one", True, True), ("two", True, False)], "method string, qualitative boolean, quantitative boolean")
    ids = spark.createDataFrame([(k,) for k in range(9)], "feature_id int")
    bad = lambda *ks: ids.where(F.col("feature_id").isin(*ks)).withColumn("method", F.lit("one"))
    counts, wrong = evaluate.accuracy_summary(methods, bad(1, 2, 3), bad(3, 4), ids)
    assert "rightHint=(strategy=broadcast)" in shape(wrong) and sorted(r["feature_id"] for r in wrong.collect()) == [1, 2, 3, 4]
    assert [(r["unique_error_count"], r["overlap_error_count"]) for r in counts.orderBy("method").collect()] == [(4, 1), (None, None)]


def test_traces_are_dealt_by_bucket_and_island(spark):
    df = spark.createDataFrame([("s", k, k * 0.01, 100.0 + k % 3, 500.0) for k in range(60)], "sample_id string, scan long, rt double, mz double, intensity double")
    found = traces.mass_traces(df, 50.0, gap=3)
    assert sorted((r["mz_min"], r["scans"]) for r in found.collect()) == [(100.0, 20), (101.0, 20), (102.0, 20)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" in plan and plan.count("REPARTITION_BY_NUM") >= 2 and "island" not in "".join(x.split("]")[0] for x in plan.split("hashpartitioning(")[1:] if "ENSURE_REQUIREMENTS" in x.split("\n")[0])


def test_flags_meet_in_one_aggregation(spark):
    ids = lambda *ks: spark.createDataFrame([(k,) for k in ks], "feature_id int")
    got = evaluate.flags(ids(1, 2, 2, 3, None), {"a": ids(1, 2, 2, 9, None), "b": ids(2)})
    assert sorted(map(tuple, got.collect()), key=str) == [(1, True, False), (2, True, True), (3, False, False), (None, False, False)]
    assert "Join" not in shape(got) and "RepartitionByExpression" in shape(got)
    rows = spark.createDataFrame([(1, 5), (1, None), (2, None), (3, 1), (3, 9)], "feature_id int, x int")
    more = evaluate.marked(ids(1, 2, 3), [(rows, {"low": F.col("x") < 6, "high": F.col("x") > 6}), (ids(2), {"b": F.lit(True)})])
    assert sorted(map(tuple, more.collect())) == [(1, True, False, False), (2, False, False, True), (3, True, True, False)]
