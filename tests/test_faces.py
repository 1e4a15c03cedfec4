"""Sources, sinks and functions that Spark calls: the indexed reader, reports, the detector in SQL, hashes of large files, and tables for figures."""

import hashlib
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eluent.functions import names, stats, wavelets
from eluent.operators import cluster, curate, evaluate, plots, sampling
from eluent.plans import table_functions
from eluent.sources import indexed, mzml, report, tables, truth
from test_sources import scan


def indexed_file(path, spectra):
    text, at = "<indexedmzML><mzML><run><spectrumList>", []
    for s in spectra:
        at.append(len(text.encode()))
        text += s
    text += "</spectrumList></run></mzML>"
    start = len(text.encode())
    text += '<indexList count="1"><index name="spectrum">' + "".join(f'<offset idRef="s{i}">{a}</offset>' for i, a in enumerate(at)) + f"</index></indexList><indexListOffset>{start}</indexListOffset></indexedmzML>"
    path.write_text(text)


@pytest.fixture
def runs(tmp_path):
    r = np.random.default_rng(6)
    for name in ("a", "b"):
        spectra = [scan(k, 0.05 * k if name == "a" else 3.0 * k, "minute" if name == "a" else "second", sorted(r.uniform(100, 200, 5)), r.uniform(1, 9, 5), 2 if k % 4 == 3 else 1, bool(k % 2)) for k in range(50)]
        spectra += [scan(50, None, "", [1.0], [1.0]), scan(51, 2.6 if name == "a" else 156, "minute" if name == "a" else "second", None, None)]
        indexed_file(tmp_path / f"{name}.mzML", spectra)
    return str(tmp_path)


def rows_of(df):
    return sorted((r["sample_id"], r["scan"], r["rt"], [tuple(p) for p in r["peaks"]]) for r in df.collect())


def test_indexed_reader_equals_the_other(spark, runs, tmp_path):
    for level in (1, 2):
        got = indexed.spectra(spark, runs, level, 7)
        assert rows_of(got) == rows_of(mzml.spectra(spark, runs, level)) and got.rdd.getNumPartitions() == 16
    every = spark.read.format("mzml_index").option("spectra", "7").load(runs)
    part = every.where("level = 1 and rt between 1.0 and 1.5")
    want = [x for x in rows_of(mzml.spectra(spark, runs, 1)) if 1.0 <= x[2] <= 1.5]
    assert rows_of(part) == want and want and part.rdd.getNumPartitions() <= 6  # parts outside of the times are not read
    assert every.where("rt > 100").count() == 0 and every.where("level = 3").count() == 0
    (tmp_path / "plain.mzML").write_text("<mzML/>")
    with pytest.raises(Exception, match="no index"):
        indexed.spectra(spark, str(tmp_path / "plain.mzML")).count()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(k, f"n{k}" if k % 3 else None, k / 7, bool(k % 2)) for k in range(20)], "k int, name string, x double, odd boolean").repartitionByRange(4, "k").sortWithinPartitions("k")
    path = tmp_path / "out.tsv"
    report.write(df, str(path), digits=4)
    lines = path.read_text().splitlines()
    assert lines[0] == "k\tname\tx\todd" and lines[1:3] == ["0\tNA\t0\tfalse", "1\tn1\t0.1429\ttrue"] and [x.split("\t")[0] for x in lines[1:]] == [str(k) for k in range(20)]
    with pytest.raises(Exception, match="is there"):
        report.write(df.limit(1), str(path))
    assert path.read_text().splitlines() == lines
    report.write(df.limit(0), str(path), overwrite=True)
    assert path.read_text() == "k\tname\tx\todd\n"
    boom = df.withColumn("x", F.when(F.col("k") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken"):
        report.write(boom, str(tmp_path / "never.csv"))
    assert sorted(os.listdir(tmp_path)) == ["out.tsv"]  # neither a file nor a folder of parts
    report.write(spark.createDataFrame([('a,"b', 1)], "t string, n int"), str(tmp_path / "q.csv"))
    assert (tmp_path / "q.csv").read_text() == 't,n\n"a,""b",1\n'


def test_reports_of_a_grouping(spark, tmp_path):
    features = spark.createDataFrame([("f1", 2), ("f2", 1)], "feature_id string, n_detected long")
    cells = spark.createDataFrame([("f1", "a", 1.0), ("f1", "b", 2.0), ("f2", "a", 3.0)], "feature_id string, sample_id string, area double")
    assigned = spark.createDataFrame([("p1", "f1", "density_group"), ("p2", "f1", "density_group"), ("p3", "f2", "manual_singleton")], "peak_id string, feature_id string, group_source string")
    report.grouping(str(tmp_path), features, cells, assigned, spark.createDataFrame([("a", "A"), ("b", "A")], "sample_id string, grp string"))
    assert (tmp_path / "feature_matrix.csv").read_text() == "feature_id,n_detected,a,b\nf1,2,1.0,2.0\nf2,1,3.0,NA\n"
    assert (tmp_path / "qc.txt").read_text() == "density_group: 2\nmanual_singleton: 1\nfeatures: 2\n" and (tmp_path / "sample_map.csv").read_text() == "sample_id,grp\na,A\nb,A\n"


def test_detector_in_sql(spark):
    t = np.arange(120)
    y = {k: 100 + 900 * np.exp(-0.5 * ((t - m) / 4) ** 2) + np.random.default_rng(k).normal(0, 2, 120) for k, m in ((1, 40), (2, 80))}
    rows = [(k, "i", 0.1 * float(j), float(v)) for k, s in y.items() for j, v in enumerate(s)]
    spark.createDataFrame(rows, "sample_id int, ion_id string, rt double, intensity double").repartition(5).createOrReplaceTempView("face_points")
    table_functions.register(spark)
    got = spark.sql("SELECT * FROM detect_peaks(TABLE(face_points), least_snr => 5.0)")
    assert [f"{n}:{k}" for n, k in got.dtypes] == ["sample_id:int", "ion_id:string", "rt:double", "rtmin:double", "rtmax:double", "height:double", "scale:double", "snr:double", "lo:int", "hi:int"]
    want = sorted((k, p[0], p[1], round(p[4], 6)) for k, s in y.items() for p in wavelets.find(s, least_snr=5.0))
    assert sorted((r["sample_id"], r["lo"], r["hi"], round(r["snr"], 6)) for r in got.collect()) == want and want
    for call, what in (("TABLE(SELECT 1 AS x)", "lacks"), ("TABLE(SELECT 1 AS sample_id, 2 AS ion_id, 'a' AS rt, 1 AS intensity)", "not numbers"), ("TABLE(face_points), least_snr => -1", "above 0"), ("3", "takes a table")):
        with pytest.raises(Exception, match=what):
            spark.sql(f"SELECT * FROM detect_peaks({call})").collect()


def test_hashes_of_large_files_and_paths(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "one.bin").write_bytes(b"1")
    (tmp_path / "x" / "y" / "one.bin").write_bytes(b"2")
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(3 << 30)  # sparse, and more than a row can hold
    zero = hashlib.sha256()
    for _ in range(3 << 7):
        zero.update(bytes(8 << 20))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = spark.createDataFrame([("x/one.bin", sha(b"1").upper()), ("x/y/one.bin", sha(b"1")), ("gone", sha(b"")), ("large.bin", zero.hexdigest())], "file string, sha256 string")
    (tmp_path / "more").write_bytes(b"")
    assert {r["file"]: r["status"] for r in tables.manifest(spark, str(tmp_path), listed).collect()} == {"x/one.bin": "ok", "x/y/one.bin": "differs", "gone": "MISSING", "large.bin": "ok", "more": "UNLISTED"}


def test_chi_square(spark):
    # fixed values of the distribution
    for x, df, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0), (61.7, 100, 0.9991), (1000.0, 5, 0.0), (2.706, 1, 0.1)):
        assert stats.chi_square_probabilities(pd.Series([x]), pd.Series([df])).iloc[0] == pytest.approx(p, abs=2e-4)
    a, x = np.array([0.5, 1.5, 4.5, 30.0]), np.array([0.3, 2.0, 9.0, 25.0])
    grid = np.linspace(0, 1, 400_001)[1:] ** 2
    for k, z in zip(a, x, strict=True):  # by numeric integration
        y = grid * z
        f = np.exp((k - 1) * np.log(y) - y - __import__("math").lgamma(k))
        low = float(((f[1:] + f[:-1]) / 2 * np.diff(y)).sum())
        assert stats.chi_square_probabilities(pd.Series([2 * z]), pd.Series([2 * k])).iloc[0] == pytest.approx(1 - low, abs=1e-3)
    assert stats.chi_square_probabilities(pd.Series([1.0, float("nan")]), pd.Series([0.0, 1.0])).isna().all()
    rows = spark.createDataFrame([("t", "a")] * 8 + [("t", "b")] * 2 + [("v", "a")] * 5, "split string, cls string")
    r = sampling.chi_square(rows, "split", "cls", ["a", "b"]).first()
    e = {("t", "a"): 26 / 3, ("t", "b"): 4 / 3, ("v", "a"): 13 / 3, ("v", "b"): 2 / 3}
    o = {("t", "a"): 8, ("t", "b"): 2, ("v", "a"): 5, ("v", "b"): 0}
    assert r["statistic"] == pytest.approx(sum((o[k] - e[k]) ** 2 / e[k] for k in e)) and r["degrees"] == 1
    with pytest.raises(ValueError, match="without rows"):
        sampling.chi_square(rows, "split", "cls", ["a", "c"])


def test_tables_for_figures(spark):
    r = np.random.default_rng(8)
    rows = [(k % 2, float(v)) for k, v in enumerate(r.integers(0, 9, 60))] + [(0, None)]
    got = {(x["g"], x["v"]): x["share"] for x in plots.distribution(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    for g in (0, 1):
        own = [v for k, v in rows if k == g and v is not None]
        assert {k: s for k, s in got.items() if k[0] == g} == {(g, v): pytest.approx(sum(x <= v for x in own) / len(own)) for v in set(own)}
    y = r.integers(0, 50, 500).astype(float)
    s = spark.createDataFrame([("a", "i", [(0.1 * k, float(v)) for k, v in enumerate(y)]), ("b", "i", [(1.0, 5.0)]), ("c", "i", [])], "sample_id string, ion_id string, points array<struct<rt:double,intensity:double>>")
    thin = plots.thinned(s, 20)
    kept = {(x["sample_id"], x["place"]) for x in thin.collect()}
    want, t = {("b", 0)}, np.minimum(np.floor(np.arange(500) * 0.1 / 49.9 * 20), 19)
    for p in range(20):
        at = np.flatnonzero(t == p)
        want |= {("a", int(i)) for i in (at[0], at[-1], at[np.argmin(y[at])], at[np.argmax(y[at])])}
    assert kept == want and plots.thinned(s, 3, 1.0, 2.0).where("rt < 1 or rt > 2").count() == 0
    fill = plots.fills(s.where("sample_id <> 'c'"), spark.createDataFrame([("a", "i", 1.02, 3.96)], "sample_id string, ion_id string, rtmin double, rtmax double")).orderBy("sample_id").collect()
    assert [(x["fill_lo_idx"], x["fill_hi_idx"]) for x in fill] == [(10, 40), (None, None)]


def test_helpers_on_their_own(spark):
    p = spark.createDataFrame([(1, "f", "a"), (2, "f", "a"), (3, "f", "b")], "peak int, feature_id string, sample_id string")
    got = {x["peak"]: (x["used_in_matrix"], x["duplicate_within_feature_sample"]) for x in cluster.used_flags(p, p.where("peak <> 2").select("peak"), ["peak"], ["feature_id", "sample_id"]).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False)}
    f = tables.feature_table(spark.createDataFrame([(str(k), "1") for k in range(100, 140)], "mz string, rt string").repartition(8))
    assert {x["feature_id"] for x in f.collect()} == {f"F{k}" for k in range(1, 41)}
    cells = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("b", None)], "feature_id string, area double")
    assert {r[0] for r in cells.withColumn("none", evaluate.missing_in_all(cells)).where("none").collect()} == {"b"}
    named = spark.createDataFrame([(" run 7 (2).x", "s12"), ("plain", "s")], "file string, sample string").select(names.without_run(F.col("file")), names.trailing_number(F.col("sample"))).collect()
    assert [tuple(r) for r in named] == [("run 7", 12), ("plain", None)]
    b = curate.display_bounds(spark.createDataFrame([(1.0, 2.0), (0.2, 0.1)], "rt_left double, rt_right double")).collect()
    assert [(r["view_left"], r["view_right"]) for r in b] == [(0.5, 2.5), (0.0, pytest.approx(0.35))]


def test_truth_tables(spark, tmp_path):
    df = spark.createDataFrame([(" a ", "1", "2.0"), ("b", "0", "x"), ("c", "1.0", "0.5")], "`mw ID` string, in_mix string, `Fold change` string")
    ids = lambda d: sorted(r["feature_id"] for r in d.collect())
    assert ids(truth.feature_set(df)) == ["a", "b", "c"] and ids(truth.flagged(df, "in_mix")) == ["a", "c"]
    assert sorted(map(tuple, truth.fold_changes(df).collect())) == [("a", 2.0), ("c", 0.5)]
    twice, blank = df.unionByName(df.limit(1)), df.withColumn("mw ID", F.lit("  "))
    for call, what in (
        (lambda: truth.feature_set(blank), "no feature ids"), (lambda: truth.feature_set(df.select("in_mix")), "looked for"), (lambda: truth.flagged(df, "gone"), "no column gone"), (lambda: truth.flagged(blank, "in_mix"), "no feature id"),
        (lambda: truth.flagged(twice, "in_mix"), "feature a is there more than once"), (lambda: truth.flagged(df.withColumn("in_mix", F.lit("2")), "in_mix"), "0 or 1"), (lambda: truth.flagged(df.withColumn("in_mix", F.lit("0")), "in_mix"), "no feature has"),
        (lambda: truth.fold_changes(twice), "more than once"), (lambda: truth.fold_changes(df.withColumn("Fold change", F.lit("0"))), "is 0"),
    ):
        with pytest.raises(ValueError, match=what):
            call()
    (tmp_path / "p.csv").write_text(",mz,...2,rt\n1,NaN,9,5\n2,100.5,9,NA\n3,,9,7\n")
    p = truth.picked_peaks(spark, str(tmp_path / "p.csv"))
    assert p.columns == ["mz", "rt"] and sorted(map(str, (tuple(r) for r in p.collect()))) == ["('100.5', None)", "(None, '5')", "(None, '7')"]
    samples = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample_id string")
    assert {r["raw_status"] for r in truth.raw_files(samples, None).collect()} == {"raw_dir_not_provided"}
    assert {r["raw_status"] for r in truth.raw_files(samples, str(tmp_path / "gone")).collect()} == {"raw_dir_missing"}
    (tmp_path / "raw" / "x").mkdir(parents=True)
    for f in ("s1.mzML", "s2.MZXML", "x/s2.raw", "s3.txt"):
        (tmp_path / "raw" / f).write_text("")
    got = {r["sample_id"]: (r["raw_status"], r["raw_file"] and r["raw_file"].count(";")) for r in truth.raw_files(samples, str(tmp_path / "raw")).collect()}
    assert got == {"s1": ("matched", 0), "s2": ("duplicate_raw_matches", 1), "s3": ("no_raw_match", None)}
