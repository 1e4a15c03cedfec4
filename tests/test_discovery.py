"""Mass traces, wavelet peaks, density grouping, alignment, rectangles, and the chain of them, against plain versions and planted features."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eluent.functions import wavelets
from eluent.operators import alignment, groups, joins, traces
from eluent.plans import detect, discovery
from eluent.sources.stages import Stages


def plain_traces(rows, ppm, gap, rounds):
    """Splits (sample, scan, mz) at gaps, mass and scans in turn."""

    def split(parts, value, far):
        out = []
        for part in parts:
            part = sorted(part, key=value)
            cuts = [i for i in range(1, len(part)) if far(value(part[i - 1]), value(part[i]))]
            out += [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    parts = list(by.values())
    for _ in range(rounds):
        parts = split(parts, lambda r: r[3], lambda a, b: b - a > a * (ppm * 1e-6))
        parts = split(parts, lambda r: r[1], lambda a, b: b - a > gap)
    return parts


@pytest.mark.parametrize("ppm", [30.0, 900.0])
def test_mass_traces(spark, ppm):
    r = np.random.default_rng(1)
    rows = [(f"s{r.integers(0, 3)}", int(k), float(k) * 0.01, float(m), float(r.integers(1, 300))) for k, m in zip(r.integers(0, 80, 3000), np.exp(r.uniform(4.6, 4.9, 3000)), strict=True)]
    rows += [("s0", k, k * 0.01, 500.0 * (1 + 4e-6 * (-1) ** k), 1000.0) for k in range(20)] + [("s0", 5, 0.05, None, 1.0), ("s0", 5, 0.05, float("nan"), 1.0), ("s1", 5, 0.05, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "sample_id string, scan long, rt double, mz double, intensity double").repartition(3)
    for rounds in (1, 2, 3):
        got = sorted((t["sample_id"], t["mz_min"], t["mz_max"], t["scan_min"], t["scan_max"], t["n"], t["scans"], round(t["intensity"])) for t in traces.mass_traces(df, ppm, gap=3, least=2, strong=150.0, rounds=rounds).collect())
        want = []
        for part in plain_traces([x for x in rows if x[3] and x[3] == x[3]], ppm, 3, rounds):
            m, s = [x[3] for x in part], [x[1] for x in part]
            if len(set(s)) >= 2 and sum(x[4] >= 150 for x in part) >= 2:
                want.append((part[0][0], min(m), max(m), min(s), max(s), len(part), len(set(s)), round(sum(x[4] for x in part))))
        assert got == sorted(want) and got
    one = traces.mass_traces(df, ppm).where("mz_min > 400").first()
    assert [p["intensity"] for p in one["points"]] == [1000.0] * 20 and one["mz"] == pytest.approx(500.0)
    assert traces.mass_traces(df.limit(0), ppm).count() == 0


def plain_coefficients(y, scales):
    out = []
    for s in scales:
        reach = int(5 * s)
        w = [(1 - (k / s) ** 2) * math.exp(-((k / s) ** 2) / 2) * 2 / (math.sqrt(3 * s) * math.pi**0.25) for k in range(-reach, reach + 1)]
        mean = sum(w) / len(w)
        out.append([sum((w[k + reach] - mean) * y[min(max(i + k, 0), len(y) - 1)] for k in range(-reach, reach + 1)) for i in range(len(y))])
    return np.array(out)


def bells(n, *parts, noise=2.0, seed=0):
    t = np.arange(n)
    return 100 + sum(h * np.exp(-0.5 * ((t - m) / s) ** 2) for m, s, h in parts) + np.random.default_rng(seed).normal(0, noise, n)


def test_wavelets_against_plain_version():
    y = bells(150, (50, 4, 900), (90, 7, 500))
    c = wavelets.coefficients(y)
    assert np.allclose(c, plain_coefficients(y.tolist(), wavelets.SCALES))
    for ridge in wavelets.ridges(c):
        assert [k for k, _ in ridge] == list(range(ridge[0][0], ridge[-1][0] - 1, -1))
        for (k, p), (_, q) in zip(ridge, ridge[1:], strict=False):
            assert abs(p - q) <= wavelets.SCALES[k - 1]
            assert c[k, p] > c[k, p - 1] and c[k, p] >= c[k, p + 1]
    assert sum(map(len, wavelets.ridges(c))) == sum(int(((r[1:-1] > r[:-2]) & (r[1:-1] >= r[2:]) & (r[1:-1] > 0)).sum()) for r in c)  # each maximum is in one ridge


@pytest.mark.parametrize(
    ("y", "apexes"),
    [
        (bells(120, (60, 4, 1000)), [60]), (bells(120, (45, 4, 1000), (62, 4, 700)), [45, 62]), (bells(200, (50, 3, 1000), (150, 10, 400)), [50, 150]),
        (bells(120, (50, 4, 1000), (64, 4, 350)), [50, 64]),  # a shoulder
        (100 + 900 * np.clip((15 - np.abs(np.arange(120) - 60)) / 6, 0, 1) + np.random.default_rng(1).normal(0, 2, 120), [60]),  # a flat top
    ],
)
def test_wavelets_find_planted_peaks(y, apexes):
    found = [p for p in wavelets.find(y, least_snr=8.0)]
    assert len(found) == len(apexes)
    for (lo, hi, apex, _, snr), want in zip(found, apexes, strict=True):
        assert abs(apex - want) <= 9 and lo < apex < hi and snr >= 8


def test_wavelets_of_noise_and_odd_signals(spark):
    assert wavelets.find([]) == [] and wavelets.find([1.0, 2.0]) == [] and wavelets.find(np.full(50, 7.0)) == []
    assert sum(len(wavelets.find(np.random.default_rng(k).normal(100, 5, 100), least_snr=8.0)) for k in range(20)) <= 2
    s = spark.createDataFrame([("a", "i", [(0.01 * k, float(v)) for k, v in enumerate(bells(120, (40, 4, 1000), (80, 4, 500)))]), ("b", "i", [(0.0, 1.0)] * 8), ("c", "i", [])], "sample_id string, ion_id string, points array<struct<rt:double,intensity:double>>")
    rows = detect.wavelet(s, least_snr=8.0).collect()
    assert [r["sample_id"] for r in rows] == ["a", "a"] and {r["box"]["class"] for r in rows} <= {0, 1, 2} and all(0 < r["box"]["conf"] < 1 for r in rows)


def plain_groups(peaks, bandwidth, sizes, grp, fraction):
    """feature: its peaks, from the density at every cell of each ion."""
    out = {}
    for ion in {p[1] for p in peaks}:
        own = [p for p in peaks if p[1] == ion]
        cell = {p[0]: math.floor(p[3] / (bandwidth / 4)) for p in own}
        density = defaultdict(int)
        for c in cell.values():
            for k in range(-16, 17):
                density[c + k] += round(1e6 * math.exp(-0.5 * (k / 4) ** 2))
        region, n, down = {}, 0, False
        for c in sorted(density):
            before = density.get(c - 1)
            if region and (before is None or (density[c] > before and down)):
                n += 1
                down = False
            if before is not None and density[c] != before:
                down = density[c] < before
            region[c] = n
        parts = defaultdict(list)
        for p in own:
            parts[region[cell[p[0]]]].append(p)
        features, single = [], []
        for r, ps in parts.items():
            enough = len(own) > 1 and any(len({p[2] for p in ps if grp[p[2]] == g}) >= max(1, fraction * size) for g, size in sizes.items())
            if enough:
                features.append((np.median([p[3] for p in ps]), r, ps))
            else:
                single += [(p[3], r, [p]) for p in ps]
        for i, (_, _, ps) in enumerate(sorted(features, key=lambda f: f[:2]) + sorted(single, key=lambda f: (f[0], f[1], f[2][0][0]))):
            out[f"{ion}__G{i + 1:03d}"] = sorted(p[0] for p in ps)
    return out


def test_density_groups(spark):
    r = np.random.default_rng(2)
    grp = {f"s{k}": "A" if k < 4 else "B" for k in range(7)}
    peaks = [(f"p{i:03d}", f"m{r.integers(0, 6)}", f"s{r.integers(0, 7)}", float(r.choice([100, 160, 300]) + r.normal(0, 12))) for i in range(160)] + [("q", "alone", "s1", 5.0)]
    df = spark.createDataFrame(peaks, "peak_id string, ion_id string, sample_id string, rt double").withColumn("mz", F.lit(1.0))
    samples = spark.createDataFrame(list(grp.items()), "sample_id string, grp string")
    rows = groups.density_groups(df, 10.0, samples, 0.7)
    got = defaultdict(list)
    for x in rows.collect():
        got[x["feature_id"]].append(x["peak_id"])
    want = plain_groups(peaks, 10.0, {"A": 4, "B": 3}, grp, 0.7)
    assert {k: sorted(v) for k, v in got.items()} == want and any(len(v) > 4 for v in want.values())
    assert rows.where("ion_id = 'alone'").first()["group_source"] == "manual_singleton"
    f = groups.features(rows, 7).where("ion_id = 'alone'").first()
    assert (f["npeaks"], f["n_detected"], f["peak_ids"], f["sample_ids"], f["rtmed_min"], f["missing_rate"]) == (1, 1, "q", "s1", 5 / 60, pytest.approx(6 / 7))
    assert groups.density_groups(df.limit(0), 10.0, samples).count() == 0


def test_regions_are_a_row_for_each_ion(spark):
    r = np.random.default_rng(4)
    cells = {k: sorted({int(c) for c in r.choice([0, 9, 20, 53, 54, 120, -300], 6) + r.integers(0, 5, 6)}) for k in range(60)}
    rows = [(k, c * 2.5 + 1.0) for k, cs in cells.items() for c in cs for _ in range(r.integers(1, 4))]
    got = groups.regions(spark.createDataFrame(rows, "ion_id long, rt double"), 10.0).collect()
    assert len(got) == 60 and sum(x["peaks"] for x in got) == len(rows)
    for x in got:
        density = defaultdict(int)
        for k, rt in rows:
            if k == x["ion_id"]:
                for i, w in enumerate(groups.WEIGHTS):
                    density[math.floor(rt / 2.5) + i - groups.REACH] += w
        want, down, before = [], False, None
        for c in sorted(density):
            if before is not None and (c - before > 1 or (down and density[c] > density[before])):
                want.append(c)
                down = False
            if before is not None and c - before == 1 and density[c] != density[before]:
                down = density[c] < density[before]
            before = c
        assert x["cuts"] == want
    assert groups.valleys(*[np.zeros(0, dtype=np.int64)] * 3).shape == (0, 2)


def test_numbers_and_medians_of_groups(spark):
    rows = [("p", "m", f"s{k % 4}", 100.0 + k) for k in range(8)] + [(f"q{k:04d}", "m", "s9", 1000.0 + 200 * k) for k in range(1001)] + [("twice", "m", "s9", t) for t in (400.0, 401.0)]
    df = spark.createDataFrame(rows, "peak_id string, ion_id string, sample_id string, rt double").withColumn("mz", F.when(F.col("peak_id") != "twice", 5.0))
    samples = spark.createDataFrame([(f"s{k}", "A") for k in range(4)], "sample_id string, grp string")
    f = {x["feature_id"]: x for x in groups.features(groups.density_groups(df, 10.0, samples), 5).collect()}
    assert len(f) == 1003 and (f["m__G001"]["rtmed"], f["m__G001"]["npeaks"], f["m__G001"]["n_detected"], f["m__G001"]["sample_ids"]) == (103.5, 8, 4, "s0;s1;s2;s3")
    assert (f["m__G002"]["rtmed"], f["m__G002"]["peak_ids"], f["m__G002"]["npeaks"], f["m__G002"]["mzmed"], f["m__G002"]["group_source"]) == (400.5, "twice", 2, None, "unassigned_singleton")
    assert f["m__G1003"]["rtmax"] == 201000.0


def test_rectangles_against_all_pairs(spark):
    r = np.random.default_rng(3)
    points = [(i, f"s{r.integers(0, 2)}", float(np.exp(r.uniform(4, 6))), float(r.uniform(0, 20))) for i in range(800)]
    boxes = []
    for k in range(40):
        m, t = float(np.exp(r.uniform(4, 6))), float(r.uniform(0, 20))
        boxes.append((k, f"s{r.integers(0, 2)}", m, m * (1 + (2.0 if k == 0 else float(r.uniform(0, 0.02)))), t, t + (20.0 if k == 0 else float(r.uniform(0, 3)))))
    boxes += [(90, "s0", 5.0, 4.0, 0.0, 1.0), (91, "s0", 100.0, 100.0, 3.0, 3.0)]
    p = spark.createDataFrame(points, "i int, sample_id string, mz double, rt double")
    b = spark.createDataFrame(boxes, "k int, sample_id string, mz_low double, mz_high double, rt_low double, rt_high double")
    got = sorted((x["i"], x["k"]) for x in joins.in_rectangles(p, b, by=["sample_id"]).collect())
    assert got == sorted((i, k) for i, s, m, t in points for k, s2, a, z, u, v in boxes if s == s2 and a <= m <= z and u <= t <= v)
    assert joins.in_rectangles(p, b.limit(0), by=["sample_id"]).count() == 0
    plan = joins.in_rectangles(p, b.hint("shuffle_hash"), by=["sample_id"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_planted_shifts_are_recovered(spark):
    r = np.random.default_rng(4)
    mass, time = r.uniform(100, 900, 60), np.sort(r.uniform(1, 19, 60))
    shift = {"c": lambda t: 0 * t, "a": lambda t: 0.3 * np.sin(t / 6), "b": lambda t: np.full_like(t, -0.4)}
    rows = [(s, float(t + f(np.array(t)) + 0.05 * k), float(m), float(1e5 * math.exp(-0.5 * k * k))) for s, f in shift.items() for m, t in zip(mass, time, strict=True) for k in range(-3, 4)]
    df = spark.createDataFrame(rows, "sample_id string, rt double, mz double, intensity double")
    warps = alignment.warps(df, "c")
    apex = df.where("intensity > 9e4")
    moved = alignment.aligned(apex, warps)
    true = dict(zip(mass.tolist(), time.tolist(), strict=True))
    off = lambda rows, s: np.median([abs(x["rt"] - true[x["mz"]]) for x in rows.where(F.col("sample_id") == s).collect()])
    for s in "ab":
        assert off(apex, s) > 0.1 and off(moved, s) < 0.05
    assert off(moved, "c") < 1e-9 and moved.columns == apex.columns
    steps = warps.withColumn("at", (F.col("cell") + 0.5) * alignment.CELL + F.col("shift")).orderBy("sample_id", "cell").toPandas().groupby("sample_id")["at"]
    assert all((np.diff(x) >= -1e-9).all() for _, x in steps)
    with pytest.raises(ValueError, match="centre"):
        alignment.warps(df, "nobody")
    assert alignment.centre_of(df) == "a"


def test_discovery_from_spectra(spark, tmp_path):
    r = np.random.default_rng(5)
    planted = [(200.01, 2.0, 4e4), (200.01, 5.0, 6e4), (350.2, 3.0, 9e4), (610.7, 6.5, 3e4)]
    rows, seconds = [], np.arange(0, 8, 0.02)
    for s, shift in {"a": 0.0, "b": 0.12, "c": -0.1}.items():
        for scan, t in enumerate(seconds):
            peaks = [(m * (1 + r.normal(0, 1e-6)), h * math.exp(-0.5 * ((t - at - shift) / 0.08) ** 2)) for k, (m, at, h) in enumerate(planted) if not (s == "c" and k == 3)]
            peaks = [(m, y + abs(r.normal(0, 20))) for m, y in peaks if y > 30]
            peaks += [(float(r.uniform(100, 900)), float(abs(r.normal(0, 60)))) for _ in range(3)]
            if s == "c" and 6.2 < t < 6.6:
                peaks.append((610.7, 500.0 + 20 * (scan % 3)))  # no peak, but something to fill in
            rows.append((s, scan, float(t), sorted(peaks)))
    spectra = spark.createDataFrame(rows, "sample_id string, scan long, rt double, peaks array<struct<mz:double,intensity:double>>").repartition(4)
    features, cells = discovery.discover(spectra, Stages(spark, str(tmp_path / "d")), ppm=20.0, fraction=0.5, bandwidth=10.0)
    found = sorted((round(f["mzmed"], 1), f["rtmed_min"], f["n_detected"]) for f in features.collect())
    assert [x[0] for x in found] == [200.0, 200.0, 350.2, 610.7] and [x[2] for x in found] == [3, 3, 3, 2]
    assert all(abs(t - at) < 0.15 for (_, t, _), (_, at, _) in zip(found, planted, strict=True))
    assert sorted((c["sample_id"], c["filled"]) for c in cells.collect()) == sorted([(s, False) for s in "abc"] * 3 + [("a", False), ("b", False), ("c", True)])
    assert cells.where("area is null or area <= 0").count() == 0 and discovery.peak_list(features).columns == ["Compound Name", "mz", "RT"]
