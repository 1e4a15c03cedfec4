"""Signal expressions over ``points``, an array of (rt, intensity) in order of rt. All are native columns.

Retention times are minutes. Areas of detected peaks are in intensity-seconds, those of curated peaks in intensity-minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bind import let

INTENSITY_OFFSET = 50.0
#: Where the plot area of a detector image begins and ends, in pixels of 224.
BOX_LEFT, BOX_RIGHT = 10.18181818, 213.81818182


def build(rt: Column, intensity: Column) -> Column:
    """Aggregate: the ordered signal of a group (one chromatogram)."""
    return F.array_sort(F.collect_list(F.struct(rt.cast("double").alias("rt"), intensity.cast("double").alias("intensity"))))


def intensities(points: Column) -> Column:
    return F.transform(points, lambda p: p["intensity"])


def times(points: Column) -> Column:
    return F.transform(points, lambda p: p["rt"])


def first_index(values: Column, value: Column) -> Column:
    """1-based place of the first element equal to ``value``."""
    return F.array_position(values, value)


def apex_index(points: Column) -> Column:
    """1-based; the first of equal maxima."""
    y = intensities(points)
    return first_index(y, F.array_max(y))


def nearest_index(values: Column, target: Column) -> Column:
    """0-based place of the element nearest to ``target``; the first of equal distances."""
    return let(target, lambda x: F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"))))["i"])


def trapezoids(points: Column, factor: float = 1.0) -> Column:
    """Sum of the trapezoids between neighbours; 0 for fewer than two points."""
    pairs = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: (a["intensity"] + b["intensity"]) * F.abs(b["rt"] - a["rt"]) * (factor / 2))
    return F.when(F.size(points) > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def peak_area(points: Column) -> Column:
    """Area above the lowest point, in intensity-seconds."""
    floor = F.array_min(intensities(points)) * F.abs(points[0]["rt"] - F.element_at(points, -1)["rt"]) * 60.0
    return F.when(F.size(points) > 1, trapezoids(points, 60.0) - floor).otherwise(F.lit(0.0))


def around_apex(points: Column, reach: int = 5) -> Column:
    """The points from ``reach`` before the apex to ``reach`` after it."""
    k = apex_index(points)
    low = F.greatest(k - reach, F.lit(1).cast("long"))
    return F.slice(points, low.cast("int"), (F.least(k + reach, F.size(points).cast("long")) - low + 1).cast("int"))


def between(points: Column, low: Column, high: Column) -> Column:
    ends = F.struct(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))
    return let(ends, lambda e: F.filter(points, lambda p: (p["rt"] >= e["low"]) & (p["rt"] <= e["high"])))


def corrected(points: Column, baseline: str) -> Column:
    """``points`` above a baseline, not below 0: ``linear`` between the ends, ``edge_min`` the lower end, ``none``. A single point stays as it is."""
    if baseline not in ("linear", "edge_min", "none"):
        raise ValueError(f"baseline is linear, edge_min or none, not {baseline}")

    def above(points: Column, ends: Column) -> Column:
        a, b = ends["a"], ends["b"]
        rise = lambda p: F.coalesce(F.try_divide(p["rt"] - a["rt"], b["rt"] - a["rt"]), F.lit(0.0))
        base = {"none": lambda p: F.lit(0.0), "edge_min": lambda p: F.least(a["intensity"], b["intensity"]), "linear": lambda p: a["intensity"] + (b["intensity"] - a["intensity"]) * rise(p)}[baseline]
        return F.transform(points, lambda p: F.struct(p["rt"].alias("rt"), F.greatest(p["intensity"] - base(p), F.lit(0.0)).alias("intensity")))

    ends = lambda w: F.struct(F.get(w, 0).alias("a"), F.try_element_at(w, F.lit(-1)).alias("b"))
    return let(points, lambda w: F.when(F.size(w) > 1, let(ends(w), lambda e: above(w, e))).otherwise(w))


def integrate(points: Column, low: Column, high: Column, baseline: str = "linear") -> Column:
    """struct(area, height, apex_rt, points) of a curated peak; reversed bounds are swapped; no points give 0, 0, null, 0."""

    def measured(y: Column) -> Column:
        inside = F.size(y)
        return F.struct(
            trapezoids(y).alias("area"), F.coalesce(F.array_max(intensities(y)), F.lit(0.0)).alias("height"),
            F.when(inside > 0, F.get(y, (apex_index(y) - 1).cast("int"))["rt"]).alias("apex_rt"), inside.cast("long").alias("points"),
        )

    return let(corrected(between(points, low, high), baseline), measured)


def fwhm(points: Column) -> Column:
    """Width between the first points at or below half of the maximum to either side of the apex, or the ends."""

    def width(s: Column) -> Column:
        at = F.transform(s["points"], lambda p, i: F.struct((i + 1).alias("i"), p["rt"].alias("rt"), p["intensity"].alias("y")))
        left = F.element_at(F.filter(at, lambda p: ((p["y"] <= s["half"]) | (p["i"] == 1)) & (p["i"] <= s["k"])), -1)["rt"]
        right = F.element_at(F.filter(at, lambda p: ((p["y"] <= s["half"]) | (p["i"] == s["n"])) & (p["i"] >= s["k"])), 1)["rt"]
        return right - left

    return let(F.struct(points.alias("points"), (F.array_max(intensities(points)) / 2).alias("half"), apex_index(points).alias("k"), F.size(points).alias("n")), width)


def order_statistic(values: Column, share: float) -> Column:
    """Element ``int(share * n)`` of the sorted values."""
    return F.array_sort(values)[F.floor(F.size(values) * F.lit(share)).cast("int")]


def lr_diff(points: Column, relative: bool) -> Column:
    """Last minus first intensity; relative: its size over the peak's height."""
    y = intensities(points)
    d = F.element_at(y, -1) - y[0]
    return F.abs(d) / (F.array_max(y) - F.array_min(y) + 1e-8) if relative else d


def local_minima(values: Column) -> Column:
    """0-based places where the sign of the first difference rises."""

    def places(y: Column) -> Column:
        step = lambda i: F.signum(y[i + 1] - y[i])
        return F.when(F.size(y) > 2, F.filter(F.sequence(F.lit(1), F.size(y) - 2), lambda i: step(i) > step(i - 1))).otherwise(F.array().cast("array<int>"))

    return let(values, places)


def least_step(values: Column) -> Column:
    """The smallest difference between neighbours; null for fewer than two values."""
    return let(values, lambda y: F.array_min(F.zip_with(F.slice(y, F.lit(2), F.greatest(F.size(y) - 1, F.lit(0))), F.slice(y, F.lit(1), F.greatest(F.size(y) - 1, F.lit(0))), lambda b, a: b - a)))


def islands(indexes: Column) -> Column:
    """Runs of consecutive integers of a sorted array, as (first, last)."""

    def runs(x: Column) -> Column:
        starts = F.filter(x, lambda v, i: (i == 0) | (v != F.get(x, i - 1) + 1))
        ends = F.filter(x, lambda v, i: (i == F.size(x) - 1) | (v != F.get(x, i + 1) - 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    return let(indexes, runs)


# Savitzky-Golay weights for (window, order), inside and for the leading edge points.
SAVGOL = {
    (5, 2): ([-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35], [[31 / 35, 9 / 35, -3 / 35, -5 / 35, 3 / 35], [9 / 35, 13 / 35, 12 / 35, 6 / 35, -5 / 35]]),
    (3, 1): ([1 / 3, 1 / 3, 1 / 3], [[5 / 6, 2 / 6, -1 / 6]]),
}


def savgol(values: Column, window: int, order: int) -> Column:
    """Smoothed values; the ends follow the polynomial of the first and last window."""
    inside, edge = SAVGOL[window, order]
    h = window // 2

    def run(y: Column) -> Column:
        n = F.size(y)
        weigh = lambda at, ws: sum((y[at + j] * w for j, w in enumerate(ws)), F.lit(0.0))
        middle = F.transform(F.sequence(F.lit(0), n - window), lambda i: weigh(i, inside))
        head = F.array(*(weigh(F.lit(0), ws) for ws in edge[:h]))
        tail = F.array(*(weigh(n - window, ws[::-1]) for ws in edge[:h][::-1]))
        return F.when(n >= window, F.concat(head, middle, tail)).otherwise(y)

    return let(values, run)


def smoothed(values: Column) -> Column:
    """Window 5, order 2 from 50 points on, else window 3, order 1."""
    return let(values, lambda y: F.when(F.size(y) >= 50, savgol(y, 5, 2)).otherwise(savgol(y, 3, 1)))


def box_bounds(points: Column, center: Column, width: Column) -> Column:
    """struct(lo, hi): 0-based indexes of the points nearest to the edges of a detector box given in pixels."""
    first, last = points[0]["rt"], F.element_at(points, -1)["rt"]
    share = lambda x: F.least(F.greatest((x - BOX_LEFT) / (BOX_RIGHT - BOX_LEFT), F.lit(0.0)), F.lit(1.0))
    at = lambda x: nearest_index(times(points), first + (last - first) * share(x))
    return F.struct(at(center - width / 2).alias("lo"), at(center + width / 2).alias("hi"))


def padded(points: Column, low: Column, high: Column, step: Column, value: float = INTENSITY_OFFSET) -> Column:
    """``points`` with baseline points every ``step`` from ``low`` to the first and from the last to ``high``."""
    none = F.array().cast("array<struct<rt:double,intensity:double>>")

    def grid(a: Column, b: Column) -> Column:
        of = F.struct(a.alias("a"), b.alias("b"), step.alias("step"))
        point = lambda i, g: F.struct((g["a"] + i * g["step"]).alias("rt"), F.lit(value).alias("intensity"))
        return let(of, lambda g: F.when(g["b"] >= g["a"], F.transform(F.sequence(F.lit(0).cast("long"), F.floor((g["b"] - g["a"]) / g["step"])), lambda i: point(i, g))).otherwise(none))

    return let(points, lambda p: F.concat(grid(low, p[0]["rt"] - step), p, grid(F.element_at(p, -1)["rt"] + step, high)))


def every_second(points: Column, odd: bool) -> Column:
    return F.filter(points, lambda p, i: i % 2 == (1 if odd else 0))


def peak_properties(points: Column, lo: Column, hi: Column) -> Column:
    """struct(rtmin, rtmax, area, rt, width, height) of the points from ``lo`` to ``hi`` (0-based, inclusive)."""
    p = F.slice(points, (lo + 1).cast("int"), (hi - lo + 1).cast("int"))
    a, b, y = p[0]["rt"], F.element_at(p, -1)["rt"], intensities(p)
    return F.struct(a.alias("rtmin"), b.alias("rtmax"), peak_area(p).alias("area"), F.get(p, (apex_index(p) - 1).cast("int"))["rt"].alias("rt"), (b - a).alias("width"), (F.array_max(y) - F.array_min(y)).alias("height"))


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _deviation(values: Column) -> Column:
    """Of the population; null for no values."""
    return let(values, lambda v: let(_mean(v), lambda m: F.sqrt(_mean(F.transform(v, lambda x: (x - m) * (x - m))))))


def _trimmed_deviation(values: Column) -> Column:
    """The deviation of the values within two deviations of 0, or of all where none are."""
    return let(values, lambda v: let(_deviation(v), lambda s: F.coalesce(_deviation(F.filter(v, lambda x: F.abs(x) <= 2 * s)), s)))


def with_snr(rows: DataFrame, points: str = "points", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``rows`` with ``snr``, a struct of sn, baseline, sn_2, sn_3, sn_31, sn_32, sn_4 and sn_5 of the peak from ``lo`` to ``hi`` (0-based, inclusive).

    What lies outside the peak ends before ``lo`` and begins at ``hi``, the peak's last point included. The baseline is the 30 %
    order statistic of the smoothed signal, 1 at least.
    """
    c, kept = F.col, rows.columns
    out = rows.withColumns({"_y": intensities(c(points)), "_t": times(c(points)), "_n": F.size(points)})
    out = out.withColumns({"_m": smoothed(c("_y")), "_p": F.slice("_y", (c(lo) + 1).cast("int"), (c(hi) - c(lo) + 1).cast("int")), "_left": F.slice("_y", F.lit(1), c(lo).cast("int")), "_right": F.slice("_y", (c(hi) + 1).cast("int"), (c("_n") - c(hi)).cast("int"))})
    q = F.zip_with("_y", "_m", lambda y, m: F.when(y == 0, F.lit(0.0)).otherwise((y - m) / F.nullif(F.sqrt(F.abs(y)), F.lit(0.0))))
    out = out.withColumns({"_q": q, "_out": F.concat("_left", "_right"), "_top": F.array_max("_p"), "_low": F.array_min("_p")})
    out = out.withColumn("_sd", _trimmed_deviation(c("_q")))
    out = out.withColumn("_base", F.greatest(order_statistic(c("_m"), 0.3), F.lit(1.0)))
    noise = c("_sd") * F.sqrt("_base")
    k = F.floor(c("_n") * 0.1).cast("int")
    trimmed = F.when(F.size("_out") > 2 * k, F.slice("_out", k + 1, F.when(k > 0, F.size("_out") - 2 * k).otherwise(F.lit(0)))).otherwise(c("_out"))
    out = out.withColumns({"_sn": F.coalesce(F.try_divide(c("_top") - c("_low"), noise), F.lit(50.0)), "_sd2": F.coalesce(_deviation(trimmed), F.lit(float("nan")))})
    near = F.when(c("_n") <= 35, 3).otherwise(5)
    before = F.slice("_y", (F.greatest(c(lo) - near, F.lit(0)) + 1).cast("int"), F.least(near, c(lo)).cast("int"))
    after = F.slice("_y", (c(hi) + 1).cast("int"), F.least(near, c("_n") - c(hi)).cast("int"))
    over = lambda xs: c("_top") / F.coalesce(F.array_max(xs) + 1, F.lit(1.0))
    add1 = F.when(c(lo) > 3, F.array_max("_left")).otherwise(c("_low"))
    add2 = F.when(c(hi) < c("_n") - 3, F.array_max("_right")).otherwise(c("_low"))
    at = lambda i: F.get("_t", F.lit(i) if isinstance(i, int) else i.cast("int"))
    add = F.when(at(c(lo)) - at(0) <= 0.2, add2).when(F.element_at("_t", -1) - at(c(hi)) <= 0.2, add1).otherwise(F.least(add1, add2))
    snr = F.struct(
        c("_sn").alias("sn"), c("_base").alias("baseline"), F.when(c("_sd2") == 0, c("_sn")).otherwise((c("_top") - _mean(c("_out"))) / F.nullif(c("_sd2"), F.lit(0.0))).alias("sn_2"),
        over(F.concat(before, after)).alias("sn_3"), over(before).alias("sn_31"), over(after).alias("sn_32"), (c("_top") / (add + 1)).alias("sn_4"),
        F.coalesce(F.try_divide(c("_top"), F.array_max("_out")), c("_top")).alias("sn_5"),
    )
    return out.withColumn("snr", snr).select(*kept, "snr")
