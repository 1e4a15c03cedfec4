"""Readers, converters, decoys, label files, sinks and the command line."""

import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eluent import __main__ as cli
from eluent.functions import kernels, signal
from eluent.operators import evaluate, matrix, ranks
from eluent.plans import decoys
from eluent.sources import convert, labels, mzml, samples, sinks


def array(values, bits, kind, packed):
    raw = np.array(values, f"<f{bits // 8}").tobytes()
    text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
    return f'<binaryDataArray><cvParam name="{bits}-bit float"/><cvParam name="{"zlib compression" if packed else "no compression"}"/><cvParam name="{kind}"/><binary>{text}</binary></binaryDataArray>'


def scan(k, t, unit, m, y, level=1, packed=True):
    time = f'<scanList><scan><cvParam name="scan start time" value="{t}" unitName="{unit}"/></scan></scanList>' if t is not None else ""
    arrays = f'<binaryDataArrayList>{array(y, 32, "intensity array", packed)}{array(m, 64, "m/z array", packed)}</binaryDataArrayList>' if m is not None else ""
    return f'<spectrum index="{k}"><cvParam name="ms level" value="{level}"/>{time}{arrays}</spectrum>'


def chromatogram(name, t, y, packed):
    return f'<chromatogram id="{name}"><binaryDataArrayList>{array(y, 32, "intensity array", packed)}{array(t, 64, "time array", packed)}</binaryDataArrayList></chromatogram>'


def file_of(path, body):
    path.write_text(f"<indexedmzML><mzML><run>{body}</run></mzML></indexedmzML>")


def test_compressed_spectra_and_chromatograms(spark, tmp_path):
    body = chromatogram("BPC and TIC", [1, 2], [5, 6], True) + chromatogram("TIC SRM SIC name=both", [1], [7], False) + chromatogram("SRM SIC name=none", [], [], True)
    body += scan(0, 30, "second", [100.0, 200.0], [5, 9]) + scan(1, 1, "minute", [100.0], [3], packed=False) + scan(2, None, "", [1.0], [1]) + scan(3, 2, "minute", None, None) + scan(4, 3, "minute", [5.0], [5], level=2)
    file_of(tmp_path / "x-s1.MZML", body)
    got = sorted((r["kind"], r["ion_id"] or "", [tuple(p) for p in r["points"]]) for r in mzml.chromatograms(spark, str(tmp_path)).collect())
    assert got == [("SRM", "both", [(1.0, 57.0)]), ("TIC", "", [(1.0, 55.0), (2.0, 56.0)]), ("TIC", "both", [(1.0, 57.0)])]
    s = mzml.spectra(spark, str(tmp_path))
    assert sorted((r["scan"], r["rt"], [tuple(p) for p in r["peaks"]]) for r in s.collect()) == [(0, 0.5, [(100.0, 5.0), (200.0, 9.0)]), (1, 1.0, [(100.0, 3.0)]), (3, 2.0, [])]
    assert tuple(mzml.first_signal(s).first()) == (200.0, 0.5)
    assert mzml.listing(spark, str(tmp_path)).first()["file"] == "x-s1.MZML"
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        mzml.listing(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="gone"):
        mzml.rt_ranges(s, spark.createDataFrame([("gone",)], "sample_id string"))


def peaks_df(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, scan long, rt double, peaks array<struct<mz:double,intensity:double>>")


def test_traces_against_plain_search(spark):
    r = np.random.default_rng(3)
    rows = [("s", k, k * 0.05, sorted((float(m), float(i)) for m, i in zip(100 + r.random(40) * 0.02, r.random(40) * 100))) for k in range(60)]
    features = [(f"f{j}", 100 + 0.003 * j, 0.4 * j) for j in range(1, 7)]
    s, f = peaks_df(spark, rows), spark.createDataFrame(features, "ion_id string, mz double, rt double")
    got = {x["ion_id"]: [tuple(p) for p in x["points"]] for x in mzml.ion_traces(s, f, 10.0, 1.2).collect()}
    for name, mz, at in features:
        want = []
        for _, _, t, peaks in rows:
            if max(at - 0.6, 0) <= t <= min(at + 0.6, rows[-1][2]):
                d, m, y = min((abs(m - mz), m, y) for m, y in peaks)
                want.append((t, (y if d < mz * 10e-6 else 0.0) + 50.0))
        assert got[name] == want
    bad = mzml.rejected(s, spark.createDataFrame([("g", 100.0, 9.0)], "ion_id string, mz double, rt double")).collect()
    assert [x["sample_id"] for x in bad] == ["s"] and mzml.rejected(s, f.where("rt > 0")).count() == 0
    w = spark.createDataFrame([("w", 100.0, 100.01, 0.1, 0.3)], "ion_id string, mz_low double, mz_high double, rt_low double, rt_high double")
    for mode, of in (("sum", sum), ("max", max)):
        points = [tuple(p) for p in mzml.window_traces(s, w, mode=mode).first()["points"]]
        want = [(t, of([y for m, y in p if m <= 100.01] or [0.0])) for _, _, t, p in rows if 0.1 <= t <= 0.3]
        assert [t for t, _ in points] == [t for t, _ in want] and [y for _, y in points] == pytest.approx([y for _, y in want])


def test_common_range(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 3.0, None)], "rt double")
    kept, gone = mzml.common_range(rows, spark.createDataFrame([(1.0, 4.0), (0.0, 3.0)], "rt_min double, rt_max double"))
    assert [r[0] for r in kept.collect()] == [1.5] and gone.count() == 4 and gone.first()["common_rt_max"] == 3.0
    with pytest.raises(ValueError, match="common"):
        mzml.common_range(rows, spark.createDataFrame([(5.0, 6.0), (0.0, 3.0)], "rt_min double, rt_max double"))


def test_decoys(spark):
    inf = float("inf")
    spectra = peaks_df(spark, [("a", 0, 1.0, [(101.0, 10.0), (100.999, 1.0), (102.0, 100_000.0), (102.5, 100_000.1), (300.0, 5.0), (-1.0, 5.0), (400.0, -1.0), (inf, 1.0), (500.0, float("nan"))]), ("a", 1, 9.0, [])])
    true = spark.createDataFrame([("x", 100.0, 2.0)], "`Compound Name` string, mz double, RT double")
    found = mzml.candidates(spectra, true)
    assert sorted(r["mz"] for r in found.collect()) == [101.0, 102.0, 300.0]  # at the distance itself, and the largest intensity itself
    table, counts = decoys.dataset(true, spectra, 2)
    rows = [tuple(r) for r in table.collect()]
    assert rows[0] == ("x", 100.0, 2.0, None) and [r[0] for r in rows[1:]] == ["FP_1", "FP_2"] and all(r[3] is not None for r in rows[1:])
    assert rows == [tuple(r) for r in decoys.dataset(true, spectra.repartition(3), 2)[0].collect()]  # reproducible
    assert tuple(counts.first()) == (1.0, 9.0, 2, 3)
    with pytest.raises(ValueError, match="there are 3"):
        decoys.false_positives(found, 4)
    for bad in ((0, 1.0, 1.0), (1, 0.0, 1.0), (1, inf, 1.0), (1, 1.0, -1.0)):
        with pytest.raises(ValueError):
            decoys.checked_parameters(*bad)
    text = lambda *rows: spark.createDataFrame(list(rows), "mz string, RT string")
    assert [tuple(r) for r in decoys.true_positives(text(("1", "2"), ("3", "0"))).collect()] == [("TP_1", 1.0, 2.0), ("TP_2", 3.0, 0.0)]
    for rows, what in (([("x", "1")], "finite"), ([("0", "1")], "above 0"), ([("1", "-1")], "below 0")):
        with pytest.raises(ValueError, match=what):
            decoys.true_positives(text(*rows))
    with pytest.raises(ValueError, match="no rows"):
        decoys.true_positives(text(("1", "1")).limit(0))
    with pytest.raises(ValueError, match="lack the columns"):
        decoys.true_positives(text(("1", "1")).drop("RT"))
    with pytest.raises(ValueError, match="lack names"):
        decoys.true_positives(spark.createDataFrame([(None, 1.0, 1.0)], "`Compound Name` string, mz double, RT double"))
    with pytest.raises(ValueError, match="no true"):
        mzml.candidates(spectra, true.limit(0))


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n\n2.0 0.1234567890 0.5 0 1\n")
    (tmp_path / "b.txt").write_text("")
    good = labels.valid(labels.read(spark, str(tmp_path)))
    pairs = labels.paired(spark.createDataFrame([("x/a.png",), ("x/b.JPG",), ("x/note.md",)], "path string"), spark.createDataFrame([("a",), ("b",)], "stem string"))
    assert sorted(tuple(r) for r in labels.signatures(pairs, good).collect()) == [("a", "x/a.png", 1, 0, 1), ("b", "x/b.JPG", 0, 0, 0)]
    assert labels.lines(good).first()["text"] == "0 0.5 0.5 0.1 0.1\n2 0.123456789 0.5 0 1"
    assert [r["split"] for r in labels.manifest(labels.signatures(pairs, good).withColumn("split", F.lit("train"))).collect()] == ["train"] * 2
    (tmp_path / "c.txt").write_text("0 1 1 1\n3 0 0 0 0\n0.5 0 0 0 0\nx 0 0 0 0\n0 1.5 0 0 0\n")
    assert [r["problem"] is not None for r in labels.read(spark, str(tmp_path)).where("stem = 'c'").collect()] == [True] * 5
    with pytest.raises(ValueError, match=r"c.txt:1"):
        labels.valid(labels.read(spark, str(tmp_path)))
    for images, stems, what in ((["a.png", "a.jpg"], ["a"], "several"), (["a.png"], ["a", "b"], "without images"), (["a.png", "b.png"], ["a"], "without labels")):
        with pytest.raises(ValueError, match=what):
            labels.paired(spark.createDataFrame([(i,) for i in images], "path string"), spark.createDataFrame([(s,) for s in stems], "stem string"))


def test_conversion(spark):
    features = spark.createDataFrame([("F1", 100.0, 60.0, 54.0, 66.0)], "feature_id string, mzmed double, rtmed double, rtmin double, rtmax double")
    peaks = spark.createDataFrame([(1, "s", 100.1, 60.0, 57.0, 63.0, 10.0, None, 3.0), (2, "s", 99.9, 61.0, 58.0, 64.0, 10.0, 7.0, 9.0), (3, "s", 99.0, 60.0, 63.0, 57.0, 99.0, 1.0, 1.0), (4, "t", 99.0, float("inf"), 1.0, 2.0, 99.0, 1.0, 1.0)], "peak_index int, sampleID string, mz double, rt double, rtmin double, rtmax double, into double, maxo double, sn double")
    given = spark.createDataFrame([("F1", 1), ("F1", 2), ("F1", 3), ("F1", 4), ("F1", 9), ("F2", 1)], "feature_id string, peak_index int")
    rows = {(r["mw ID"], r["sampleID"]): r for r in convert.result_table(features, peaks, given).collect()}
    assert rows.keys() == {("F1", "s"), ("F2", "s")}
    best = rows["F1", "s"]
    assert (best["sn"], best["int"], best["rt"], best["min_rt"], best["class"]) == (9.0, 7.0, pytest.approx(61 / 60), 0.9, "A")
    assert rows["F2", "s"]["int"] == 10.0 and rows["F2", "s"]["rt_theoretic"] == 0.0
    assert tuple(convert.peak_list(features).first()) == ("F1", 100.0, 1.0) and convert.checked(features).count() == 1
    with pytest.raises(ValueError, match="domain"):
        convert.checked(features.withColumn("mzmed", F.lit(-1.0)))
    f = convert.feature_rows(given.where("peak_index < 3").join(peaks, "peak_index"), 4).where("feature_id = 'F1'").first()
    assert (f["npeaks"], f["n_detected"], f["missing_rate"], f["peak_ids"], f["mzmed"]) == (2, 1, 0.75, "1;2", 100.0)
    wide = spark.createDataFrame([(1.0, 60.0, 30.0, 90.0, None, 4.0)], "mzmed double, rtmed double, rtmin double, rtmax double, `a.mzML` double, other double")
    assert tuple(convert.intensities(wide).first()) == (1.0, 1.0, 0.5, 1.5, 0.0)


def test_samples(spark, tmp_path):
    files = spark.createDataFrame([("x-mix1 (2).mzML",), ("x-mix1.mzML",), ("x-mix2.mzML",)], "file string")
    info = spark.createDataFrame([("mix1", 2.0), ("mix2", None)], "sample_id string, order double")
    assert sorted(r["file"] for r in samples.matched_files(files, info).collect()) == ["x-mix1 (2).mzML", "x-mix2.mzML"]
    with pytest.raises(ValueError, match="mix3"):
        samples.matched_files(files, spark.createDataFrame([("mix3", 1.0)], "sample_id string, order double"))
    ions = spark.createDataFrame([("p", "Positive"), ("n", "negative"), ("h", "Hilic"), ("o", "odd")], "ion_id string, ion_mode string")
    signals = spark.createDataFrame([(s, i) for s in ("a_P", "a_N", "a_HN", "a") for i in "pnho"], "sample_id string, ion_id string")
    assert sorted(map(tuple, samples.of_mode(signals, ions).collect())) == sorted([("a_P", "p"), ("a_N", "n"), ("a_HN", "n"), ("a_N", "h"), ("a_HN", "h"), ("a_P", "p"), ("a_N", "n")])
    with pytest.raises(ValueError, match="ion table"):
        samples.known_ions(signals, ions.where("ion_id <> 'o'"), str(tmp_path / "error"))
    assert (tmp_path / "error").is_dir()
    traces = samples.total_traces(spark.createDataFrame([("m_P_2",), ("m_HN1",), ("m",)], "sample_id string"))
    assert sorted(r[0] for r in traces.collect()) == ["m_HN", "m_N", "m_P", "m_P"]
    pos, neg = samples.split_polarity(spark.createDataFrame([("A_p", 1), ("A_N", 2), ("B_HN", 3)], "sample_id string, area int"))
    assert sorted(map(tuple, samples.both_polarities(pos, neg).collect())) == [("A", 2), ("A_p", 1), ("B", 3)]
    assert samples.groups(spark.createDataFrame([("SA1",), ("SB1",)], "sample_id string"), "SA", "SB").count() == 2
    with pytest.raises(ValueError, match="unequal"):
        samples.groups(spark.createDataFrame([("SA1",), ("SA2",), ("SB1",)], "sample_id string"), "SA", "SB")
    (tmp_path / "c.json").write_text('{"a": [1]}')
    assert samples.config(spark, str(tmp_path / "c.json")) == {"a": [1]}


def test_ranks(spark):
    df = spark.createDataFrame([(k % 3 if k % 3 else None, k * 7 % 50) for k in range(50)], "g int, x int")
    assert sorted((r["x"], r["rank"]) for r in ranks.with_rank(df, [F.col("x")]).collect()) == [(k, k + 1) for k in range(50)]
    got = ranks.with_group_rank(df, ["g"], [F.col("x")]).collect()
    for g in (None, 1, 2):
        xs = sorted((r["x"], r["rank"]) for r in got if r["g"] == g)
        assert [k for _, k in xs] == list(range(1, len(xs) + 1))


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("i2", "a", 1.0), ("i1", "a", 2.0), ("i1", "b", 3.0)], "ion_id string, sample_id string, area double")
    assert sorted(map(tuple, sinks.remarks(cells).collect())) == [(1, "i1", "-"), (2, "i2", "-")]
    (tmp_path / "x.mzML").write_text("<mzML/>")
    sinks.curation(spark, str(tmp_path / "out"), cells.withColumnRenamed("ion_id", "feature_id"), cells.limit(1), mzml.listing(spark, str(tmp_path)), {"version": 1})
    text = lambda name: next((tmp_path / "out" / name).glob("part*")).read_text()
    assert text("peak_areas_matrix") == "feature_id,a,b\ni1,2.0,3.0\ni2,1.0,\n" and text("peak_areas_long").startswith("feature_id,sample_id,area\ni1,a")
    assert json.loads(text("metadata"))["files"][0]["size_bytes"] == 7


def test_kernel_columns(spark):
    df = spark.createDataFrame([([0.0, 5.0, 10.0, 5.0, 0.0, 0.0, 5.0, 10.0, 5.0, 0.0],), ([0.0, 5.0, 10.0, 5.0, 0.0],)], "y array<double>").withColumn("t", F.transform("y", lambda v, i: i * 1.0))
    two, one = df.select(kernels.division(F.col("y")), kernels.steep(F.col("t"), F.col("y")), kernels.widened(F.col("y"), F.lit(0.0), F.lit(1), F.lit(2)), kernels.on_grid(F.col("t"), F.col("y"), 5), kernels.on_index(F.col("y"), 3)).collect()
    assert kernels.split_bimodal(np.array([0.0, 5, 10, 5, 0, 0, 5, 10, 5, 0])) == [(0, two[0]), (two[0], 9)] and two[0] in (4, 5)
    assert one[0] is None and tuple(one[1]) == kernels.steep_part(np.arange(5.0), np.array([0.0, 5, 10, 5, 0])) and len(one[3]) == 5 and one[4] == [0.0, 1.0, 0.0]
    assert tuple(one[2]) == kernels.to_baseline(np.array([0.0, 5, 10, 5, 0]), 0.0, 1, 2)


def test_integration_is_linear(spark):
    import time

    def took(n):
        df = spark.createDataFrame([([(float(k), float((k * 37) % 101)) for k in range(n)],)], "points array<struct<rt:double,intensity:double>>").repartition(1)
        df = df.select(signal.integrate(F.col("points"), F.lit(1.0), F.lit(float(n)), "linear").alias("x"), signal.fwhm(F.col("points")), signal.local_minima(signal.intensities(F.col("points"))), signal.smoothed(signal.intensities(F.col("points"))))
        began = time.time()
        assert df.first()["x"]["points"] == n - 1
        return time.time() - began

    took(50)
    assert took(20_000) < 10


def test_scoring_counts_features_that_are_nowhere(spark):
    cells = spark.createDataFrame([("a", "s1", 1.0), ("a", "s2", None), ("x", "s1", 2.0), ("x", "s2", 0.0)], "feature_id string, sample_id string, area double")
    truth = spark.createDataFrame([("a",), ("gone",)], "feature_id string")
    got = {r["sample_id"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.presence(cells, truth).collect()}
    assert got == {"s1": (1, 1, 1), "s2": (0, 0, 2)}
    assert dict(map(tuple, evaluate.error_types(cells, truth).collect())) == {"a": "FN", "x": "FP", "gone": "FN"}
    assert dict(map(tuple, evaluate.error_types(cells, truth, "component_set").collect())) == {"x": "FP", "gone": "FN"}
    fc = spark.createDataFrame([(2.0, 0.01), (0.5, 0.01), (0.4, 0.01), (0.4, 0.2), (3.0, None)], "fold_change double, p double")
    assert [r["direction"] for r in evaluate.directions(fc).collect()] == ["up", "not_differential", "down", "not_differential", "not_differential"]
    assert evaluate.directions(fc, inclusive=False).first()["direction"] == "not_differential"
    with pytest.raises(ValueError, match="gone"):
        evaluate.contained(truth, cells)
    with pytest.raises(ValueError, match="repeat"):
        evaluate.boundary_rates(cells.selectExpr("'m' as software", "feature_id as ion_id", "sample_id", "area as width_difference"), spark.createDataFrame([("m", "a", "s1")] * 2, "software string, ion_id string, sample_id string"), ["software", "ion_id", "sample_id"])
    flagged = spark.createDataFrame([("m", "a", True), ("m", "b", False)], "software string, ion_id string, f boolean")
    assert evaluate.checked_counts(flagged, spark.createDataFrame([("m", 1)], "software string, f int"), ["f"]).first()["f"] == 1
    with pytest.raises(ValueError, match="differ"):
        evaluate.checked_counts(flagged, spark.createDataFrame([("m", 2)], "software string, f int"), ["f"])


def test_command_line(spark, tmp_path):
    r = np.random.default_rng(1)
    times = [0.05 * k for k in range(60)]
    bell = lambda t: 5e4 * np.exp(-0.5 * ((t - 1.5) / 0.1) ** 2)
    (tmp_path / "in").mkdir()
    for s in ("a", "b"):
        file_of(tmp_path / "in" / f"{s}.mzML", "".join(scan(k, t, "minute", [100.0, 150.0], [bell(t) + 20 * r.random(), 5.0]) for k, t in enumerate(times)))
    (tmp_path / "in" / "peak_list.csv").write_text("Compound Name,mz,RT\nf1,100.0,1.5\n")
    cli.main(["untargeted", "--indir", str(tmp_path / "in"), "--outdir", str(tmp_path / "out")])
    matrix = next((tmp_path / "out" / "matrix").glob("part*")).read_text().splitlines()
    assert matrix[0] == "ion_id\ta\tb" and matrix[1].startswith("f1\t")
    body = lambda s: chromatogram("SRM SIC Q1=1 Q3=2 name=i1 start=0 end=3", times, [bell(t) + 20 * r.random() for t in times], True)
    (tmp_path / "t").mkdir()
    for s in ("x-mix1_P", "x-s2_P"):
        file_of(tmp_path / "t" / f"{s}.mzML", body(s))
    (tmp_path / "t" / "all_ions.tsv").write_text("mw ID\tRT (min)\tion_mode\ni1\t1.5\tPositive\n")
    cli.main(["targeted", "--indir", str(tmp_path / "t"), "--outdir", str(tmp_path / "out2")])
    assert next((tmp_path / "out2" / "matrix").glob("part*")).read_text().splitlines()[0].startswith("ion_id")
    (tmp_path / "in" / "peak_list.csv").unlink()
    cli.main(["untargeted", "--indir", str(tmp_path / "in"), "--outdir", str(tmp_path / "out3"), "--ppm", "20", "--noise", "50", "--maxWidth", "120", "--threads", "2", "--all_ions", "cal"])
    matrix = next((tmp_path / "out3" / "matrix").glob("part*")).read_text().splitlines()
    assert matrix[0] == "ion_id\ta\tb" and len(matrix) == 2 and matrix[1].startswith("M100.0000__G001\t") and "NA" not in matrix[1]
    with pytest.raises(SystemExit):
        cli.arguments(["sideways"])


def test_targeted_run_of_both_polarities(spark, tmp_path):
    r = np.random.default_rng(3)
    times = [0.05 * k for k in range(60)]
    bell = lambda t, at, h: h * np.exp(-0.5 * ((t - at) / 0.1) ** 2)
    trace = lambda ion, at, h: chromatogram(f"SRM SIC Q1=1 Q3=2 name={ion} start=0 end=3", times, [bell(t, at, h) + 20 * r.random() for t in times], True)
    heights = {"mix1": 4e4, "mix2": 5e4, "s1": 6e4}
    for s, h in heights.items():
        for end in ("P", "N"):
            # i1 is missing in mix2_P, and half of the mix samples of its own mode are enough; the hilic ion is negative
            ions = [("i1", 1.5, 0 if s == "mix2" else h)] if end == "P" else [("i2", 1.0, 2 * h), ("i3", 2.0, 3 * h)]
            file_of(tmp_path / f"run-{s}_{end}.mzML", "".join(trace(*i) for i in ions))
    (tmp_path / "all_ions.tsv").write_text("mw ID\tRT (min)\tion_mode\ni1\t1.5\tPositive\ni2\t1.0\tNegative\ni3\t2.0\tHilic\n")
    cli.main(["targeted", "--indir", str(tmp_path), "--outdir", str(tmp_path / "out")])
    read = lambda name: [line.split("\t") for line in next((tmp_path / "out" / name).glob("part*")).read_text().splitlines()]
    head, *rows = read("matrix")
    assert head == ["ion_id", "mix1", "mix2", "s1"] and [x[0] for x in rows] == ["i1", "i2", "i3"]
    width = 0.1 * np.sqrt(2 * np.pi) * 60  # of a bell in seconds; corrected peaks are plain sums over eleven points
    for (_, *areas), share in zip(rows, (1, 2, 3), strict=True):
        for s, area in zip(head[1:], areas, strict=True):
            if (share, s) == (1, "mix2"):
                assert area == "NA"
            else:
                h = share * heights[s]
                window = sum(bell(0.05 * k, 0, h) for k in range(-5, 6))
                assert any(abs(float(area) / full - 1) < 0.05 for full in (h * width, window))
    head, *rows = read("peaks")
    assert head == list(sinks.LAYOUT.values()) and len(rows) == 8 and all("NA" not in x and "" not in x for x in rows)
    flat = {x[head.index("Component Name")]: float(x[head.index("rt_theoretic")]) for x in rows}
    assert flat == {"i1": 1.5, "i2": 1.0, "i3": 2.0}
    assert all(50 <= float(x[head.index("baseline")]) <= 70 and float(x[head.index("max_rt")]) == pytest.approx(2.95) for x in rows)


def test_two_values_of_one_cell_are_an_error(spark):
    cells = spark.createDataFrame([("i", "a", 1.0), ("i", "a", None), ("i", "b", None)], "ion_id string, sample_id string, area double")
    assert tuple(matrix.widen(cells, ["a", "b"], "").first()) == ("i", 1.0, None)
    with pytest.raises(Exception, match="several values"):
        matrix.widen(cells.unionByName(cells), ["a", "b"], "").collect()
    with pytest.raises(ValueError, match="polarity"):
        samples.by_polarity(cells)


def test_picker_files_are_read_as_they_are_written(spark, tmp_path):
    (tmp_path / "f.csv").write_text("feature_id,mzmed,rtmed,rtmin,rtmax\nF1,100,60,54,66\n")
    (tmp_path / "p.csv").write_text("peak_index,sampleID,mz,rt,rtmin,rtmax,into,sn\n1,s,100.1,60,57,63,10,3\n")
    (tmp_path / "a.csv").write_text("feature_id,peak_index\nF1,1\n")
    paths = {"features": str(tmp_path / "f.csv"), "peaks": str(tmp_path / "p.csv"), "assignments": str(tmp_path / "a.csv")}
    got = convert.read(spark, paths)
    r = convert.result_table(got["features"], got["peaks"], got["assignments"]).first()
    assert (r["sampleID"], r["mw ID"], r["area"], r["rt_theoretic"]) == ("s", "F1", 10.0, 1.0)
    with pytest.raises(ValueError, match="no assigned peak"):
        convert.result_table(got["features"], got["peaks"].withColumn("rtmax", F.lit(1.0)), got["assignments"])
    (tmp_path / "p.csv").write_text("peak_index,mz,rt,rtmin,rtmax,into\n1,100.1,60,57,63,10\n")
    with pytest.raises(ValueError, match="sampleID"):
        convert.read(spark, paths)
