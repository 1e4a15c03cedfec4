"""The query catalogue over the given tables: name, query, and SQL where it can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, names, signal, wavelets
from ..operators import alignment, cluster, evaluate, groups, joins, matrix, plots, ranks, refine, sampling, traces
from ..sources import mzml, samples
from . import bindings as b
from . import detect, table_functions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EPS, NEAR_DAYS, GAP_CUT = 0.4, 15.0, 400.0
#: A theoretical retention time for each ion of the peaks binding, in days; Spark reads it as it stands.
THEORY_SQL = "8100 + (ion_id * 37) % 2200"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _r(column: str, digits: int = 4):
    return F.round(column, digits).alias(column)


# ---- signals ------------------------------------------------------------------------------------------------------


@query(f"""WITH {b.POINTS_SQL} SELECT sample_id, ion_id, count(*) AS n_points, round(min(rt), 4) AS rt_min, round(max(rt), 4) AS rt_max, max(intensity) AS max_intensity
FROM pts GROUP BY ALL HAVING max(intensity) >= 50""")
def signal_build(spark, d):
    s = b.signals(spark, d).withColumn("max_intensity", F.array_max(signal.intensities(F.col("points")))).where("max_intensity >= 50")
    return s.select("sample_id", "ion_id", F.size("points").cast("long").alias("n_points"), F.round(F.col("points")[0]["rt"], 4).alias("rt_min"), F.round(F.element_at("points", -1)["rt"], 4).alias("rt_max"), "max_intensity")


@query(f"""WITH {b.POINTS_SQL} SELECT sample_id, ion_id, round(coalesce(sum((intensity + y0) * abs(rt - t0) * 60 / 2), 0) - CASE WHEN count(*) > 1 THEN min(intensity) * (max(rt) - min(rt)) * 60 ELSE 0 END, 1) AS area
FROM pts GROUP BY ALL""")
def peak_area_trapezoid(spark, d):
    return b.signals(spark, d).select("sample_id", "ion_id", F.round(signal.peak_area(F.col("points")), 1).alias("area"))


@query(f"""WITH {b.APEX_SQL}, g AS (SELECT sample_id, ion_id, min(intensity) AS baseline FROM pts GROUP BY ALL HAVING count(*) >= 10 AND max(intensity) >= 100)
SELECT p.sample_id, p.ion_id, round(max(CASE WHEN p.i = a.k THEN rt END), 4) AS rt, round(min(rt), 4) AS rtmin, round(max(rt), 4) AS rtmax, round(sum(intensity), 3) AS area,
  round(max(intensity) - min(intensity), 4) AS height, any_value(g.baseline) AS baseline, count(*) AS points, 10.0::DOUBLE AS sn, 'D' AS class
FROM pts p JOIN apex a ON p.sample_id = a.sample_id AND p.ion_id = a.ion_id AND p.i BETWEEN a.k - 5 AND a.k + 5
JOIN g ON g.sample_id = p.sample_id AND g.ion_id = p.ion_id GROUP BY p.sample_id, p.ion_id""")
def peak_apex_window(spark, d):
    f = refine.refound(b.signals(spark, d), refine.LEAST_UNTARGETED)
    return f.select("sample_id", "ion_id", _r("rt"), _r("rtmin"), _r("rtmax"), _r("area", 3), _r("height"), "baseline", "points", "sn", "class")


def _integration(mode: str):
    def run(spark, d):
        s = b.signals(spark, d)
        first, last = F.col("points")[0]["rt"], F.element_at("points", -1)["rt"]
        got = signal.integrate(F.col("points"), first + (last - first) * 0.25, last - (last - first) * 0.25, mode)
        return s.select("sample_id", "ion_id", got.alias("x")).select("sample_id", "ion_id", F.round("x.area", 2).alias("area"), F.round("x.height", 4).alias("height"), F.col("x.points").alias("points"))

    run.__name__ = f"eic_integrate_{mode}"
    base = {"linear": "ya + (yb - ya) * (rt - ta) / nullif(tb - ta, 0)", "edge_min": "least(ya, yb)", "none": "0"}[mode]
    sql = f"""WITH {b.POINTS_SQL}, e AS (SELECT *, min(rt) OVER s AS t1, max(rt) OVER s AS t2 FROM pts WINDOW s AS (PARTITION BY sample_id, ion_id)),
k AS (SELECT sample_id, ion_id, rt, intensity, i FROM e WHERE rt >= t1 + (t2 - t1) * 0.25 AND rt <= t2 - (t2 - t1) * 0.25),
m AS (SELECT *, count(*) OVER s AS c, first_value(intensity) OVER o AS ya, first_value(rt) OVER o AS ta, last_value(intensity) OVER o AS yb, last_value(rt) OVER o AS tb FROM k
  WINDOW s AS (PARTITION BY sample_id, ion_id), o AS (PARTITION BY sample_id, ion_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
y AS (SELECT sample_id, ion_id, i, rt, CASE WHEN c > 1 THEN greatest(intensity - ({base}), 0) ELSE intensity END AS y FROM m),
z AS (SELECT *, (y + lag(y) OVER o) / 2 * (rt - lag(rt) OVER o) AS part FROM y WINDOW o AS (PARTITION BY sample_id, ion_id ORDER BY i))
SELECT g.sample_id, g.ion_id, round(coalesce(sum(part), 0), 2) AS area, round(coalesce(max(y), 0), 4) AS height, count(y) AS points
FROM (SELECT DISTINCT sample_id, ion_id FROM pts) g LEFT JOIN z ON z.sample_id = g.sample_id AND z.ion_id = g.ion_id GROUP BY g.sample_id, g.ion_id"""
    query(sql)(run)


for _mode in ("linear", "edge_min", "none"):
    _integration(_mode)


@query(f"""WITH {b.APEX_SQL}, t AS (SELECT p.*, a.k, max(intensity) OVER (PARTITION BY p.sample_id, p.ion_id) / 2 AS half FROM pts p JOIN apex a ON p.sample_id = a.sample_id AND p.ion_id = a.ion_id),
e AS (SELECT sample_id, ion_id, max(CASE WHEN i <= k AND (intensity <= half OR i = 1) THEN i END) AS l, min(CASE WHEN i >= k AND (intensity <= half OR i = n) THEN i END) AS r FROM t GROUP BY ALL)
SELECT t.sample_id, t.ion_id, round(max(CASE WHEN i = r THEN rt END) - max(CASE WHEN i = l THEN rt END), 4) AS fwhm FROM t JOIN e ON t.sample_id = e.sample_id AND t.ion_id = e.ion_id GROUP BY t.sample_id, t.ion_id""")
def fwhm(spark, d):
    return b.signals(spark, d).select("sample_id", "ion_id", F.round(signal.fwhm(F.col("points")), 4).alias("fwhm"))


@query(f"""WITH {b.POINTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, ion_id ORDER BY intensity) - 1 AS k FROM pts)
SELECT sample_id, ion_id, max(CASE WHEN k = CAST(floor(n * 0.3) AS BIGINT) THEN intensity END) AS baseline_30, max(CASE WHEN k = CAST(floor(n * 0.4) AS BIGINT) THEN intensity END) AS baseline_40 FROM o GROUP BY ALL""")
def order_stat_baseline(spark, d):
    y = signal.intensities(F.col("points"))
    return b.signals(spark, d).select("sample_id", "ion_id", signal.order_statistic(y, 0.3).alias("baseline_30"), signal.order_statistic(y, 0.4).alias("baseline_40"))


@query(f"""WITH {b.POINTS_SQL} SELECT sample_id, ion_id, round(last(intensity ORDER BY i) - first(intensity ORDER BY i), 4) AS lr_diff,
  round(abs(last(intensity ORDER BY i) - first(intensity ORDER BY i)) / (max(intensity) - min(intensity) + 1e-8), 4) AS lr_ratio FROM pts WHERE n > 1 GROUP BY ALL""")
def lr_diff(spark, d):
    s = b.signals(spark, d).where(F.size("points") > 1)
    return s.select("sample_id", "ion_id", F.round(signal.lr_diff(F.col("points"), False), 4).alias("lr_diff"), F.round(signal.lr_diff(F.col("points"), True), 4).alias("lr_ratio"))


@query(f"""WITH {b.POINTS_SQL}, s AS (SELECT *, sign(intensity - y0) AS s1, sign(lead(intensity) OVER (PARTITION BY sample_id, ion_id ORDER BY i) - intensity) AS s2 FROM pts)
SELECT sample_id, ion_id, count(*) AS n_minima, min(i - 1) AS first_minimum, max(i - 1) AS last_minimum FROM s WHERE s2 > s1 GROUP BY ALL""")
def local_minima(spark, d):
    m = signal.local_minima(signal.intensities(F.col("points")))
    rows = b.signals(spark, d).select("sample_id", "ion_id", m.alias("m")).where(F.size("m") > 0)
    return rows.select("sample_id", "ion_id", F.size("m").cast("long").alias("n_minima"), F.array_min("m").cast("long").alias("first_minimum"), F.array_max("m").cast("long").alias("last_minimum"))


@query(f"""WITH {b.POINTS_SQL}, s AS (SELECT sample_id, ion_id, i, i - row_number() OVER (PARTITION BY sample_id, ion_id ORDER BY i) AS island FROM pts WHERE intensity >= 50)
SELECT sample_id, ion_id, min(i) AS first, max(i) AS last FROM s GROUP BY sample_id, ion_id, island""")
def index_islands(spark, d):
    strong = F.transform(F.filter(F.transform("points", lambda p, i: F.struct((i + 1).cast("long").alias("i"), p["intensity"].alias("y"))), lambda p: p["y"] >= 50), lambda p: p["i"])
    rows = b.signals(spark, d).select("sample_id", "ion_id", F.explode(signal.islands(strong)).alias("x"))
    return rows.select("sample_id", "ion_id", F.col("x.first").alias("first"), F.col("x.last").alias("last"))


@query(f"""WITH {b.POINTS_SQL} SELECT sample_id, ion_id, count(*) FILTER (i % 2 = 0) AS n_odd, round(coalesce(sum(intensity) FILTER (i % 2 = 0), 0), 3) AS odd, count(*) FILTER (i % 2 = 1) AS n_even, round(sum(intensity) FILTER (i % 2 = 1), 3) AS even FROM pts GROUP BY ALL""")
def tic_parity(spark, d):
    add = lambda odd: F.round(F.aggregate(signal.intensities(signal.every_second(F.col("points"), odd)), F.lit(0.0), lambda a, x: a + x), 3)
    n = lambda odd: F.size(signal.every_second(F.col("points"), odd)).cast("long")
    return b.signals(spark, d).select("sample_id", "ion_id", n(True).alias("n_odd"), add(True).alias("odd"), n(False).alias("n_even"), add(False).alias("even"))


@query(f"""WITH {b.POINTS_SQL}, g AS (SELECT sample_id, ion_id, min(rt) AS a, max(rt) AS z, count(*) AS n, sum(intensity) AS total FROM pts GROUP BY ALL), w AS (SELECT *, min(a) OVER (PARTITION BY ion_id) AS lo, max(z) OVER (PARTITION BY ion_id) AS hi FROM g)
SELECT sample_id, ion_id, CAST(n + CASE WHEN a - 1440 >= lo THEN floor((a - 1440 - lo) / 1440) + 1 ELSE 0 END + CASE WHEN hi >= z + 1440 THEN floor((hi - z - 1440) / 1440) + 1 ELSE 0 END AS BIGINT) AS n_points,
round(CASE WHEN a - 1440 >= lo THEN lo ELSE a END, 4) AS first_rt, round(CASE WHEN hi >= z + 1440 THEN z + 1440 + 1440 * floor((hi - z - 1440) / 1440) ELSE z END, 4) AS last_rt,
round(total + 50 * (CASE WHEN a - 1440 >= lo THEN floor((a - 1440 - lo) / 1440) + 1 ELSE 0 END + CASE WHEN hi >= z + 1440 THEN floor((hi - z - 1440) / 1440) + 1 ELSE 0 END), 3) AS total FROM w""")
def xic_padding(spark, d):
    by = Window.partitionBy("ion_id")
    s = b.signals(spark, d).withColumns({"a": F.col("points")[0]["rt"], "z": F.element_at("points", -1)["rt"]})
    s = s.withColumns({"lo": F.min("a").over(by), "hi": F.max("z").over(by)})
    s = s.select("sample_id", "ion_id", signal.padded(F.col("points"), F.col("lo"), F.col("hi"), F.lit(1440.0)).alias("p"))
    total = F.aggregate(signal.intensities(F.col("p")), F.lit(0.0), lambda a, x: a + x)
    return s.select("sample_id", "ion_id", F.size("p").cast("long").alias("n_points"), F.round(F.col("p")[0]["rt"], 4).alias("first_rt"), F.round(F.element_at("p", -1)["rt"], 4).alias("last_rt"), F.round(total, 3).alias("total"))


@query(f"""WITH {b.POINTS_SQL}, g AS (SELECT sample_id, min(rt) AS a, max(rt) AS z FROM pts GROUP BY ALL), c AS (SELECT max(a) + 1e-6 AS lo, min(z) - 1e-6 AS hi FROM g)
SELECT sample_id, ion_id, count(*) AS n, round(sum(intensity), 3) AS total FROM pts, c WHERE rt > lo AND rt < hi GROUP BY ALL""")
def common_rt_filter(spark, d):
    p = b.points(spark, d)
    inside, _ = mzml.common_range(p, mzml.rt_ranges(p))
    return inside.groupBy("sample_id", "ion_id").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 3).alias("total"))


@query(f"""WITH {b.POINTS_SQL}, g AS (SELECT DISTINCT sample_id, ion_id FROM pts), r AS (SELECT *, row_number() OVER (PARTITION BY ion_id ORDER BY sample_id % 10 <> 0, sample_id) - 1 AS k FROM g)
SELECT sample_id, ion_id, k // 24 AS page, k % 24 AS position FROM r""")
def plot_pages(spark, d):
    g = b.points(spark, d).select("sample_id", "ion_id").distinct()
    return sampling.pages(g, ["ion_id"], [F.col("sample_id") % 10 != 0, F.col("sample_id")])


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) AS i, len(embedding) AS n FROM embeddings),
w AS (SELECT vec_id, i, n, y, lag(y, 2) OVER o AS a, lag(y) OVER o AS b, lead(y) OVER o AS c, lead(y, 2) OVER o AS d FROM e WINDOW o AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, round(sum(abs((-3 * a + 12 * b + 17 * y + 12 * c - 3 * d) / 35)), 5) AS roughness, round(max((-3 * a + 12 * b + 17 * y + 12 * c - 3 * d) / 35), 6) AS top FROM w WHERE i BETWEEN 3 AND n - 2 GROUP BY ALL""")
def savgol_smooth(spark, d):
    e = b.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("y"))
    e = e.select("vec_id", signal.smoothed(F.col("y")).alias("s")).select("vec_id", F.slice("s", F.lit(3), F.size("s") - 4).alias("s"))
    return e.select("vec_id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("roughness"), F.round(F.array_max("s"), 6).alias("top"))


def _plain(spark, d):
    """Signals with times, values and apex as columns of their own, of three points at least and of times that rise."""
    s = b.signals(spark, d).where(F.size("points") >= 3).withColumns({"t": signal.times(F.col("points")), "y": signal.intensities(F.col("points"))})
    return s.where(signal.least_step(F.col("t")) > 0)


@query()
def bimodal_parts(spark, d):
    return _plain(spark, d).select("sample_id", "ion_id", kernels.division(F.col("y")).alias("divided_at"))


@query()
def baseline_bounds(spark, d):
    p = _plain(spark, d).withColumn("k", signal.apex_index(F.col("points")).cast("int") - 1)
    w = kernels.widened(F.col("y"), signal.order_statistic(F.col("y"), 0.3), F.greatest(F.col("k") - 1, F.lit(0)), F.least(F.col("k") + 1, F.size("y") - 1))
    return p.select("sample_id", "ion_id", w.alias("w")).select("sample_id", "ion_id", "w.lo", "w.hi")


@query(f"""WITH {b.POINTS_SQL}, usable AS (SELECT sample_id, ion_id FROM pts GROUP BY ALL HAVING count(*) >= 3 AND min(rt - t0) > 0),
s AS (SELECT p.*, abs((intensity - y0) / (rt - t0)) AS slope, max(abs((intensity - y0) / (rt - t0))) OVER (PARTITION BY sample_id, ion_id) AS steepest, max(intensity) OVER (PARTITION BY sample_id, ion_id) AS top FROM pts p SEMI JOIN usable USING (sample_id, ion_id)),
k AS (SELECT sample_id, ion_id, min(i) - 1 AS k FROM s WHERE intensity = top GROUP BY ALL)
SELECT sample_id, ion_id, coalesce(max(i - 1) FILTER (slope > 0.1 * steepest AND i - 2 < k), 0)::INTEGER AS first, coalesce(min(i - 1) FILTER (slope > 0.1 * steepest AND i - 2 >= k), any_value(n))::INTEGER AS end
FROM s JOIN k USING (sample_id, ion_id) GROUP BY sample_id, ion_id""")
def slope_bounds(spark, d):
    return _plain(spark, d).select("sample_id", "ion_id", kernels.steep(F.col("t"), F.col("y")).alias("w")).select("sample_id", "ion_id", "w.first", "w.end")


@query()
def cubic_grid(spark, d):
    g = _plain(spark, d).select("sample_id", "ion_id", kernels.on_grid(F.col("t"), F.col("y"), 64).alias("g"))
    return g.select("sample_id", "ion_id", F.size("g").alias("n"), F.round(F.col("g")[0], 4).alias("first"), F.round(F.element_at("g", -1), 4).alias("last"))


@query(f"""WITH {b.POINTS_SQL}, top AS (SELECT sample_id, ion_id, n, max(intensity) AS m, list(intensity ORDER BY i) AS y FROM pts GROUP BY ALL HAVING n >= 3 AND min(rt - t0) > 0),
g AS (SELECT sample_id, ion_id, n, m, y, k * (n - 1) / 255.0::DOUBLE AS x FROM top CROSS JOIN (SELECT unnest(range(256)) AS k)),
v AS (SELECT sample_id, ion_id, (y[CAST(floor(x) AS BIGINT) + 1] + (x - floor(x)) * (y[least(CAST(floor(x) AS BIGINT) + 2, n)] - y[CAST(floor(x) AS BIGINT) + 1])) AS v FROM g)
SELECT sample_id, ion_id, round(avg(v) / max(v), 5) AS mean, 1.0::DOUBLE AS top FROM v GROUP BY ALL""")
def resample_256(spark, d):
    g = _plain(spark, d).select("sample_id", "ion_id", kernels.on_index(F.col("y")).alias("g"))
    return g.select("sample_id", "ion_id", F.round(F.aggregate("g", F.lit(0.0), lambda a, x: a + x) / 256, 5).alias("mean"), F.round(F.array_max("g"), 5).alias("top"))


@query(f"WITH {b.POINTS_SQL} SELECT sample_id, ion_id, round(min(rt - t0), 5) AS least_step FROM pts WHERE n > 1 GROUP BY ALL")
def least_step(spark, d):
    s = b.signals(spark, d).where(F.size("points") > 1)
    return s.select("sample_id", "ion_id", F.round(signal.least_step(signal.times(F.col("points"))), 5).alias("least_step"))


# ---- clusters and cells -------------------------------------------------------------------------------------------

_LABELS = f"""{b.PEAKS_SQL}, gaps AS (SELECT *, rt - lag(rt) OVER (PARTITION BY ion_id ORDER BY rt) AS gap, stddev_pop(rt) OVER (PARTITION BY ion_id) AS sd FROM peaks),
labels AS (SELECT *, CAST(coalesce(sum(CASE WHEN gap > {EPS} * CASE WHEN sd = 0 THEN 1 ELSE sd END THEN 1 ELSE 0 END) OVER (PARTITION BY ion_id ORDER BY rt RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS label FROM gaps),
clusters AS (SELECT ion_id, label, count(*) AS n_peaks, count(DISTINCT sample_id) AS n_samples, avg(rt) AS mean_rt, min(rt) AS rt_min, max(rt) AS rt_max FROM labels GROUP BY ALL)"""


def _labelled(spark, d):
    return cluster.rt_gap_clusters(b.peaks(spark, d), EPS)


@query(f"WITH {_LABELS} SELECT ion_id, label, n_peaks, n_samples, round(mean_rt, 4) AS mean_rt, rt_min, rt_max FROM clusters")
def rt_gap_clusters(spark, d):
    return cluster.summaries(_labelled(spark, d)).select("ion_id", "label", "n_peaks", "n_samples", _r("mean_rt"), "rt_min", "rt_max")


_BEST = f"""{_LABELS}, errors AS (SELECT *, abs(mean_rt - ({THEORY_SQL})) AS rt_error FROM clusters),
scores AS (SELECT *, 0.3 * n_samples / max(n_samples) OVER w + 0.7 * (1 - rt_error / (max(rt_error) OVER w + 1e-6)) AS score FROM errors WHERE rt_error <= {GAP_CUT} WINDOW w AS (PARTITION BY ion_id)),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY ion_id ORDER BY score DESC, label) = 1)"""


@query(f"WITH {_BEST} SELECT ion_id, label, n_samples, round(mean_rt, 4) AS mean_rt, round(score, 6) AS score FROM best")
def cluster_score_select(spark, d):
    best = cluster.select_best(cluster.summaries(_labelled(spark, d)), F.expr(THEORY_SQL), most_error=GAP_CUT)
    return best.select("ion_id", "label", "n_samples", _r("mean_rt"), _r("score", 6))


@query()
def close_cluster_merge(spark, d):
    rows = cluster.rt_gap_clusters(cluster.in_sequence(b.peaks(spark, d), ["sample_id", *b.ORDER]), EPS)
    return cluster.merge_close(cluster.summaries(rows, seq="seq"), NEAR_DAYS, order="first_seq")


_FIRST = f"""{_BEST}, firsts AS (SELECT l.* FROM labels l JOIN best USING (ion_id, label) QUALIFY row_number() OVER (PARTITION BY ion_id, sample_id ORDER BY {', '.join('l.' + c for c in b.ORDER)}) = 1)"""


def _first(spark, d):
    rows = _labelled(spark, d)
    best = cluster.select_best(cluster.summaries(rows), F.expr(THEORY_SQL), most_error=GAP_CUT).select("ion_id", "label")
    return cluster.keep_first(rows.join(best, ["ion_id", "label"], "left_semi"), ["ion_id", "sample_id"], b.ORDER)


@query(f"WITH {_FIRST} SELECT ion_id, sample_id, rt, area, width FROM firsts")
def keep_first_per_sample(spark, d):
    return _first(spark, d).select("ion_id", "sample_id", "rt", "area", "width")


@query(f"WITH {_FIRST} SELECT ion_id, {', '.join(f'max(CASE WHEN sample_id = {s} THEN area END) AS s{s}' for s in b.SAMPLES)} FROM firsts GROUP BY ion_id")
def peak_matrix_pivot(spark, d):
    return matrix.widen(_first(spark, d), b.SAMPLES)


@query(f"WITH {_FIRST}, ions AS (SELECT DISTINCT ion_id FROM firsts) SELECT i.ion_id, 's' || s.sample_id AS sample_id, f.area FROM ions i CROSS JOIN (SELECT unnest(range(8)) AS sample_id) s LEFT JOIN firsts f ON f.ion_id = i.ion_id AND f.sample_id = s.sample_id")
def matrix_melt(spark, d):
    return matrix.melt(matrix.widen(_first(spark, d), b.SAMPLES), ["ion_id"], [f"s{s}" for s in b.SAMPLES])


@query(f"""WITH {b.PEAKS_SQL}, a AS (SELECT * FROM peaks WHERE class = 'A' QUALIFY row_number() OVER (PARTITION BY rt ORDER BY width, ion_id, sample_id, {', '.join(b.ORDER)}) = 1)
SELECT class, ion_id, sample_id, rt, width, area, l_orderkey, l_linenumber FROM (SELECT * FROM a UNION ALL SELECT * FROM peaks WHERE class <> 'A')""")
def class_a_dedup(spark, d):
    kept = cluster.class_a_dedup(b.peaks(spark, d), ["ion_id", "sample_id", *b.ORDER])
    return kept.select("class", "ion_id", "sample_id", "rt", "width", "area", "l_orderkey", "l_linenumber")


@query(f"""WITH {b.PEAKS_SQL}, p AS (SELECT *, abs(rt - ({THEORY_SQL})) AS rt_distance FROM peaks)
SELECT ion_id, sample_id, area, class, conf, rt FROM p QUALIFY row_number() OVER (PARTITION BY ion_id, sample_id
ORDER BY area DESC, CASE class WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END, conf DESC, rt_distance, {', '.join(b.ORDER)}) = 1""")
def best_peak_pick(spark, d):
    p = b.peaks(spark, d).withColumn("rt_distance", F.abs(F.col("rt") - F.expr(THEORY_SQL)))
    return cluster.best_peak(p, ["ion_id", "sample_id"], b.ORDER).select("ion_id", "sample_id", "area", "class", "conf", "rt")


@query(f"""WITH {b.cells_sql()}, {b.cells_sql(False, 'every')} SELECT c.feature_id AS ion_id, c.sample_id, coalesce(c.area, e.area) AS area FROM cells c JOIN every e ON c.feature_id = e.feature_id AND c.sample_id = e.sample_id""")
def matrix_fill(spark, d):
    return matrix.fill(b.cells(spark, d).select("ion_id", "sample_id", "area"), b.cells(spark, d, False).where("area is not null"), ["ion_id", "sample_id"])


@query(f"""WITH {b.PEAKS_SQL}, old AS (SELECT ion_id, sample_id, max(area) AS area FROM peaks WHERE class = 'R' GROUP BY ALL), new AS (SELECT ion_id, sample_id, max(area) AS area FROM peaks WHERE class = 'A' GROUP BY ALL)
SELECT coalesce(n.ion_id, o.ion_id) AS ion_id, coalesce(n.sample_id, o.sample_id) AS sample_id, coalesce(n.area, o.area) AS area FROM old o FULL JOIN new n ON n.ion_id = o.ion_id AND n.sample_id = o.sample_id""")
def upsert(spark, d):
    side = lambda c: b.peaks(spark, d).where(F.col("class") == c).groupBy("ion_id", "sample_id").agg(F.max("area").alias("area"))
    return matrix.upsert(side("R"), side("A"), ["ion_id", "sample_id"], ["area"])


_WIDE = f"{b.PEAKS_SQL}, w AS (SELECT *, rt - width AS rtmin, rt + width AS rtmax FROM peaks)"


def _bounds(spark, d):
    return b.peaks(spark, d).withColumns({"rtmin": F.col("rt") - F.col("width"), "rtmax": F.col("rt") + F.col("width")})


@query(f"""WITH {_WIDE}, m AS (SELECT *, abs(rtmin - median(rtmin) OVER i) > 500 OR abs(rtmax - median(rtmax) OVER i) > 500 AS anomaly FROM w WINDOW i AS (PARTITION BY ion_id))
SELECT ion_id, count(*) AS n, count(*) FILTER (anomaly) AS n_anomalies FROM m GROUP BY ALL""")
def anomaly_flags_median(spark, d):
    m = refine.anomalies(_bounds(spark, d), 500.0)
    return m.groupBy("ion_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("anomaly"), 1)).alias("n_anomalies"))


@query(f"""WITH {_WIDE}, q AS (SELECT ion_id, quantile_cont(rtmin, 0.3) AS a, quantile_cont(rtmax, 0.7) AS b FROM w GROUP BY ALL)
SELECT ion_id, count(*) AS n, count(*) FILTER (rtmin < a - 300 OR rtmin > a + 300 OR rtmax < b - 300 OR rtmax > b + 300) AS n_anomalies FROM w JOIN q USING (ion_id) GROUP BY ALL""")
def anomaly_flags_quantile(spark, d):
    m = refine.anomalies(_bounds(spark, d), 300.0, by_median=False)
    return m.groupBy("ion_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("anomaly"), 1)).alias("n_anomalies"))


@query(f"""WITH {b.PEAKS_SQL}, r AS (SELECT *, width AS sn, width / 5 AS sn_5, (60 - width) / 10 + conf * 0 AS sn_2 FROM peaks) SELECT ion_id, count(*) AS n, round(sum(area), 2) AS area FROM r WHERE sn >= 5 AND (sn >= 6 OR sn_5 >= 1.5) AND sn_2 >= 2 GROUP BY ALL""")
def acceptance_filter(spark, d):
    p = b.peaks(spark, d).withColumns({"sn": F.col("width"), "sn_5": F.col("width") / 5, "sn_2": (60 - F.col("width")) / 10})
    return refine.acceptable(p).groupBy("ion_id").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"))


@query(f"""WITH {b.cells_sql()}, n AS (SELECT feature_id, count(*) FILTER (area IS NOT NULL AND sample_id >= 4) AS present, count(area) AS filled FROM cells GROUP BY ALL)
SELECT feature_id AS ion_id, filled FROM n WHERE present * 2 >= 4""")
def mix_row_filter(spark, d):
    c = b.cells(spark, d).withColumn("sample_id", F.concat(F.when(F.col("sample_id") >= 4, "mix").otherwise("s"), F.col("sample_id")))
    return matrix.mix_rows(c.select("ion_id", "sample_id", "area")).groupBy("ion_id").agg(F.count("area").alias("filled"))


@query(f"""WITH {b.cells_sql()}, n AS (SELECT feature_id, count(*) FILTER (area IS NOT NULL AND sample_id >= 4) AS present FROM cells GROUP BY ALL)
SELECT feature_id AS ion_id, {", ".join(f"max(area) FILTER (sample_id = {s}) AS s{s}" for s in b.SAMPLES)} FROM cells JOIN n USING (feature_id) WHERE present * 2 >= 4 GROUP BY ALL""")
def two_polarity_matrix(spark, d):
    """Parts of even number are ions of positive mode; samples of each mode have their own matrix, mix rule and names, and meet in one matrix."""
    c = b.cells(spark, d).withColumn("mode", F.when(F.col("ion_id") % 2 == 0, "P").otherwise("N"))
    c = c.select("ion_id", "area", F.concat(F.when(F.col("sample_id") >= 4, "mix").otherwise("s"), "sample_id", F.lit("_"), "mode").alias("sample_id"))
    parts = {name: matrix.mix_rows(part) for name, part in samples.by_polarity(c).items()}
    both = samples.both_polarities(parts["pos"], parts["neg"]).withColumn("sample_id", F.regexp_replace("sample_id", "^(mix|s)", ""))
    return matrix.widen(both, [str(s) for s in b.SAMPLES])


@query(f"""WITH {b.cells_sql()} SELECT feature_id AS ion_id, count(area) AS filled FROM cells GROUP BY ALL HAVING count(*) - count(area) <= 4""")
def missing_row_filter(spark, d):
    return matrix.enough_present(b.cells(spark, d).select("ion_id", "sample_id", "area"), "ion_id", F.col("n") / 2).groupBy("ion_id").agg(F.count("area").alias("filled"))


@query(f"""WITH {b.APEX_SQL}, g AS (SELECT sample_id, ion_id FROM pts GROUP BY ALL HAVING count(*) >= 10 AND max(intensity) >= 100),
f AS (SELECT p.sample_id, p.ion_id, sum(intensity) AS area FROM pts p JOIN apex a ON p.sample_id = a.sample_id AND p.ion_id = a.ion_id AND p.i BETWEEN a.k - 5 AND a.k + 5 JOIN g ON g.sample_id = p.sample_id AND g.ion_id = p.ion_id GROUP BY ALL)
SELECT c.sample_id, c.ion_id, round(CASE WHEN c.sample_id % 3 = 0 THEN 7.0 ELSE f.area END, 3) AS area FROM (SELECT DISTINCT sample_id, ion_id FROM pts) c LEFT JOIN f ON f.sample_id = c.sample_id AND f.ion_id = c.ion_id""")
def refind_missing(spark, d):
    s = b.signals(spark, d)
    cells, _ = refine.refind_missing(s.select("sample_id", "ion_id", F.when(F.col("sample_id") % 3 == 0, F.lit(7.0)).alias("area")), s)
    return cells.select("sample_id", "ion_id", _r("area", 3))


def _corrected_sql(name: str, of: str) -> str:
    """Peaks with those replaced whose bounds are off the medians of their ion."""
    return f"""{name}m AS (SELECT *, median(rtmin) OVER (PARTITION BY ion_id) AS ma, median(rtmax) OVER (PARTITION BY ion_id) AS mb FROM {of}),
{name} AS (SELECT m.sample_id, m.ion_id, CASE WHEN bad THEN f.rt ELSE m.rt END AS rt, CASE WHEN bad THEN f.rtmin ELSE m.rtmin END AS rtmin, CASE WHEN bad THEN f.rtmax ELSE m.rtmax END AS rtmax, CASE WHEN bad THEN f.area ELSE m.area END AS area
  FROM (SELECT *, abs(rtmin - ma) > 0.05 OR abs(rtmax - mb) > 0.05 AS off FROM {name}m) m LEFT JOIN found f ON f.sample_id = m.sample_id AND f.ion_id = m.ion_id, LATERAL (SELECT m.off AND f.rt IS NOT NULL AS bad))"""


@query(f"""WITH {b.APEX_SQL}, strong AS (SELECT sample_id, ion_id FROM pts GROUP BY ALL HAVING count(*) >= 10 AND max(intensity) >= 100),
found AS (SELECT sample_id, ion_id, max(rt) FILTER (i = k) AS rt, min(rt) AS rtmin, max(rt) AS rtmax, sum(intensity) AS area FROM pts JOIN apex USING (sample_id, ion_id) SEMI JOIN strong USING (sample_id, ion_id) WHERE i BETWEEN k - 5 AND k + 5 GROUP BY ALL),
whole AS (SELECT sample_id, ion_id, max(rt) FILTER (i = k) AS rt, min(rt) AS rtmin, max(rt) AS rtmax,
  coalesce(sum((intensity + y0) * abs(rt - t0) * 60 / 2), 0) - CASE WHEN count(*) > 1 THEN min(intensity) * (max(rt) - min(rt)) * 60 ELSE 0 END AS area FROM pts JOIN apex USING (sample_id, ion_id) GROUP BY ALL),
{_corrected_sql("once", "whole")}, {_corrected_sql("twice", "once")}
SELECT sample_id, ion_id, round(rt, 4) AS rt, round(rtmin, 4) AS rtmin, round(rtmax, 4) AS rtmax, round(area, 2) AS area, 'A' AS class FROM twice""")
def correct_twice(spark, d):
    s = b.signals(spark, d)
    p = s.select("sample_id", "ion_id", signal.peak_properties(F.col("points"), F.lit(0), F.size("points") - 1).alias("x"), F.lit("A").alias("class")).select("sample_id", "ion_id", "x.*", "class")
    fixed = refine.correct_twice(p, s, True)
    return fixed.select("sample_id", "ion_id", _r("rt"), _r("rtmin"), _r("rtmax"), _r("area", 2), "class")


@query(f"""WITH {b.PEAKS_SQL}, a AS (SELECT ion_id, stddev_samp(rt) AS sd, max(rt) - min(rt) AS r FROM peaks GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (sd > 700) AS sd_flagged, count(*) FILTER (r > 2300) AS range_flagged, count(*) FILTER (sd > 700 OR r > 2300) AS any_flagged, round(avg(sd), 4) AS mean_sd FROM a""")
def alignment_flags(spark, d):
    a = evaluate.alignment(b.peaks(spark, d), 700.0, 2300.0)
    n = lambda c: F.count(F.when(F.col(c), 1))
    return a.agg(F.count("*").alias("n"), n("sd_flag").alias("sd_flagged"), n("range_flag").alias("range_flagged"), n("any_flag").alias("any_flagged"), F.round(F.avg("rt_sd"), 4).alias("mean_sd"))


@query(f"""WITH {b.PEAKS_SQL}, c AS (SELECT class AS software, ion_id, sample_id, max(abs(width - 25) / 25) AS d, max(conf) AS conf FROM peaks GROUP BY ALL)
SELECT software, count(*) AS n, count(*) FILTER (conf >= 0.08) AS failed, count(DISTINCT CASE WHEN conf >= 0.08 THEN ion_id END) AS bad_components, round(avg(d), 5) AS mean_difference, round(quantile_cont(d, 0.25), 5) AS q25, round(median(d), 5) AS median, round(quantile_cont(d, 0.75), 5) AS q75, count(*) FILTER (d > 0.5) AS above_half, round(1 - count(*) FILTER (conf >= 0.08) / count(*), 6) AS pass_rate FROM c GROUP BY ALL""")
def boundary_iou_rates(spark, d):
    keys = ["software", "ion_id", "sample_id"]
    c = b.peaks(spark, d).withColumnRenamed("class", "software").groupBy(*keys).agg(F.max(F.abs(F.col("width") - 25) / 25).alias("width_difference"), F.max("conf").alias("conf"))
    out = evaluate.boundary_rates(c, c.where("conf >= 0.08").select(*keys), keys)
    return out.select("software", "n", "failed", "bad_components", *(_r(c, 5) for c in ("mean_difference", "q25", "median", "q75")), "above_half", _r("pass_rate", 6))


# ---- evaluation ---------------------------------------------------------------------------------------------------

# observed cells lack every seventh part, so that some true features are in no row; rows absent in over half of the samples are filtered
_OBS = f"""{b.cells_sql()}, observed AS (SELECT * FROM cells WHERE feature_id % 7 <> 0), kept AS (SELECT o.* FROM observed o JOIN (SELECT feature_id FROM observed GROUP BY ALL HAVING count(*) - count(area) <= count(*) / 2) USING (feature_id)),
tru AS (SELECT p_partkey AS feature_id FROM part WHERE p_size <= 25), samples AS (SELECT DISTINCT sample_id FROM kept)"""


def _prf(observed: str, name: str) -> str:
    return f"""{name}_hits AS (SELECT DISTINCT feature_id, sample_id FROM {observed} WHERE area IS NOT NULL AND area <> 0),
{name}_n AS (SELECT s.sample_id, count(t.feature_id) FILTER (h.feature_id IS NOT NULL) AS tp, count(h.feature_id) FILTER (t.feature_id IS NULL) AS fp, (SELECT count(*) FROM tru) - count(t.feature_id) FILTER (h.feature_id IS NOT NULL) AS fn
  FROM samples s LEFT JOIN {name}_hits h ON h.sample_id = s.sample_id LEFT JOIN tru t ON t.feature_id = h.feature_id GROUP BY ALL),
{name}_pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM {name}_n), {name} AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM {name}_pr)"""


_PRF = f"{_OBS}, {_prf('kept', 'prf')}"


def _observed(spark, d):
    return b.cells(spark, d).where("feature_id % 7 <> 0")


def _qualitative(spark, d, scope: str = "sample_union"):
    return evaluate.qualitative(_observed(spark, d), b.truth(spark, d), scope)


def _scores(spark, d):
    return _qualitative(spark, d)[0]


@query(f"WITH {_PRF} SELECT sample_id, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM prf")
def presence_prf_per_sample(spark, d):
    return _scores(spark, d).select("sample_id", "tp", "fp", "fn", _r("precision", 6), _r("recall", 6), _r("f1", 6))


@query(f"WITH {_PRF} SELECT {', '.join(f'round({f}({c}), 6) AS {n}_{k}' for c, n in (('p', 'precision'), ('r', 'recall'), ('f', 'f1')) for f, k in (('avg', 'mean'), ('stddev_samp', 'std')))} FROM prf")
def prf_summary(spark, d):
    s = evaluate.presence_summary(_scores(spark, d))
    return s.select(*(_r(c, 6) for c in s.columns))


@query(f"""WITH {_OBS}, all_ids AS (SELECT DISTINCT feature_id FROM observed) SELECT (SELECT count(*) FROM all_ids) AS input_rows, (SELECT count(DISTINCT feature_id) FROM kept) AS rows_after_missing_filter,
(SELECT count(*) FROM all_ids) - (SELECT count(DISTINCT feature_id) FROM kept) AS rows_removed_missing, (SELECT count(*) FROM tru) AS true_feature_count, (SELECT count(DISTINCT sample_id) FROM observed) AS sample_count,
(SELECT count(*) FROM (SELECT feature_id FROM kept EXCEPT SELECT feature_id FROM tru)) + (SELECT count(*) FROM (SELECT feature_id FROM tru EXCEPT SELECT feature_id FROM kept)) AS qualitative_error_count""")
def qualitative_counts(spark, d):
    return _qualitative(spark, d, "component_set")[2]


_TYPES = """types AS (SELECT feature_id, 'FP' AS error_type FROM kept WHERE area IS NOT NULL AND area <> 0 AND feature_id NOT IN (SELECT feature_id FROM tru) GROUP BY ALL
UNION ALL SELECT t.feature_id, 'FN' FROM tru t LEFT JOIN kept k ON k.feature_id = t.feature_id AND k.area IS NOT NULL AND k.area <> 0 GROUP BY ALL HAVING count(DISTINCT k.sample_id) < (SELECT count(*) FROM samples))"""


@query(f"WITH {_OBS}, {_TYPES} SELECT * FROM types")
def error_type_concat(spark, d):
    return _qualitative(spark, d)[1]


@query(f"WITH {_OBS} SELECT coalesce(k.feature_id, t.feature_id) AS feature_id, CASE WHEN t.feature_id IS NULL THEN 'FP' ELSE 'FN' END AS error_type FROM (SELECT DISTINCT feature_id FROM kept) k FULL JOIN tru t ON t.feature_id = k.feature_id WHERE t.feature_id IS NULL OR k.feature_id IS NULL")
def component_set_errors(spark, d):
    return _qualitative(spark, d, "component_set")[1]


def _fc_sql(name: str, cells: str, policy: str) -> str:
    x = {"zero": "coalesce(area, 0)", "missing": "nullif(area, 0)", "keep": "area"}[policy]
    return f"{name} AS (SELECT feature_id, (avg({x}) FILTER (grp = 'B') + 1e-6) / (avg({x}) FILTER (grp = 'A') + 1e-6) AS fc FROM {cells} GROUP BY ALL)"


_FC = f"{b.cells_sql()}, {b.cells_sql(False, 'every')}, {_fc_sql('f', 'cells', 'missing')}, {_fc_sql('t', 'every', 'missing')}"


@query(f"WITH {_FC}, e AS (SELECT f.feature_id, f.fc, abs(f.fc - t.fc) / abs(t.fc) AS err FROM f JOIN t USING (feature_id) WHERE f.fc IS NOT NULL AND t.fc <> 0) SELECT feature_id, round(fc, 5) AS fold_change, round(err, 5) AS relative_error FROM e")
def fold_change_error(spark, d):
    true = evaluate.fold_changes(b.cells(spark, d, False)).select("feature_id", F.col("fold_change").alias("true_fold_change"))
    return evaluate.fold_change_errors(evaluate.fold_changes(b.cells(spark, d)), true).select("feature_id", _r("fold_change", 5), _r("relative_error", 5))


@query(f"WITH {b.cells_sql()}, {_fc_sql('f', 'cells', 'zero')} SELECT feature_id, round(fc, 5) AS fold_change FROM f WHERE fc BETWEEN 1e-3 AND 1e3")
def zero_policy_fold_change(spark, d):
    return evaluate.fold_changes(b.cells(spark, d), "zero").where("fold_change between 1e-3 and 1e3").select("feature_id", _r("fold_change", 5))


@query(f"WITH {b.cells_sql()} SELECT feature_id, grp, round(stddev_pop(coalesce(area, 0)) * 100 / (avg(coalesce(area, 0)) + 1e-6), 4) AS cv FROM cells GROUP BY ALL")
def cv_zero_fill(spark, d):
    return evaluate.cv(b.cells(spark, d), True).select("feature_id", "grp", _r("cv"))


_CV = f"{b.cells_sql()}, cv AS (SELECT feature_id, grp, CASE WHEN count(area) > 1 AND avg(area) <> 0 THEN stddev_pop(area) * 100 / avg(area) ELSE 0 END AS cv FROM cells GROUP BY ALL)"


@query(f"WITH {_CV} SELECT feature_id, grp, round(cv, 4) AS cv FROM cv")
def cv_drop_null(spark, d):
    return evaluate.cv(b.cells(spark, d), False).select("feature_id", "grp", _r("cv"))


@query(f"WITH {_CV} SELECT grp, round(quantile_cont(cv, 0.25), 4) AS q25, round(median(cv), 4) AS median, round(quantile_cont(cv, 0.75), 4) AS q75, round(avg(cv), 4) AS mean, count(cv) AS n FROM cv GROUP BY ALL")
def five_number(spark, d):
    f = evaluate.five_numbers(evaluate.cv(b.cells(spark, d), False), "cv", ["grp"])
    return f.select("grp", _r("q25"), _r("median"), _r("q75"), _r("mean"), "n")


@query("""WITH c AS (SELECT l_returnflag AS method, l_partkey AS feature_id FROM lineitem WHERE l_quantity > 20) SELECT feature_id FROM c GROUP BY ALL HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM c)""")
def cv_common_scope(spark, d):
    return evaluate.common_features(b.peaks(spark, d).where("width > 20").select(F.col("class").alias("method"), F.col("ion_id").alias("feature_id")))


_WELCH = f"""{b.cells_sql()}, m AS (SELECT feature_id, {', '.join(f"{f}(area) FILTER (grp = '{g}') AS {k}{g.lower()}" for g in 'AB' for k, f in (('m', 'avg'), ('v', 'var_samp'), ('n', 'count')))} FROM cells GROUP BY ALL),
welch AS (SELECT feature_id, (ma - mb) / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df FROM m WHERE na > 1 AND nb > 1 AND va + vb > 0)"""


@query(f"WITH {_WELCH} SELECT feature_id, round(t, 5) AS t, round(df, 5) AS df FROM welch")
def welch_t_df(spark, d):
    return evaluate.welch(b.cells(spark, d)).where("var_a + var_b > 0").select("feature_id", _r("t", 5), _r("df", 5))


# Student's t by Simpson's rule on the angle whose tangent is t over the root of df
_P = """angles AS (SELECT feature_id, df, atan(abs(t) / sqrt(df)) AS top FROM welch WHERE df > 0), steps AS (SELECT unnest(range(801)) AS i),
p AS (SELECT feature_id, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * sum(CASE WHEN i IN (0, 800) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(top * i / 800), df - 1)) * any_value(top) / 2400 AS p FROM angles CROSS JOIN steps GROUP BY feature_id, df)"""


@query(f"WITH {_WELCH}, {_P} SELECT feature_id, round(p, 4) AS p FROM p")
def welch_p(spark, d):
    tests = evaluate.with_probability(evaluate.welch(b.cells(spark, d))).where("var_a + var_b > 0")
    return tests.select("feature_id", _r("p", 4))


#: Cuts of the differential queries, milder than the usual ones: these tables hold few large fold changes.
UP, DOWN = 1.1, 0.9
_WAY = lambda fc, p: f"CASE WHEN {fc} >= {UP} AND {p} < 0.05 THEN 'up' WHEN {fc} < {DOWN} AND {p} < 0.05 THEN 'down' ELSE 'not_differential' END"
_DIFFERENTIAL = f"""{_WELCH.replace('WHERE na > 1 AND nb > 1 AND va + vb > 0', 'WHERE na > 1 AND nb > 1 AND va + vb > 0 AND feature_id % 7 <> 0')}, {_P}, {_fc_sql('f', 'cells', 'keep')},
assigned AS (SELECT f.feature_id, f.fc, p.p, {_WAY('f.fc', 'p.p')} AS predicted FROM f LEFT JOIN p USING (feature_id) WHERE f.feature_id % 7 <> 0),
real AS (SELECT p_partkey AS feature_id, {_WAY('p_size / 20.0', '(p_retailprice % 10) / 50')} AS true_direction FROM part),
duo AS (SELECT coalesce(a.feature_id, r.feature_id) AS feature_id, a.feature_id IS NOT NULL AS here, coalesce(predicted, 'not_differential') AS d, coalesce(true_direction, 'not_differential') AS e FROM assigned a FULL JOIN real r ON r.feature_id = a.feature_id)"""


def _differential(spark, d):
    """Truth is made up of the parts' sizes and prices, and holds parts that no cell has."""
    true = b.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), (F.col("p_size") / 20.0).alias("true_fold_change"), (F.col("p_retailprice") % 10 / 50).alias("true_p_value"))
    return evaluate.differential(_observed(spark, d), true, up=UP, down=DOWN)


@query(f"""WITH {_DIFFERENTIAL} SELECT count(*) FILTER (here) AS features, count(*) FILTER (e <> 'not_differential') AS true_differential, count(*) FILTER (d <> 'not_differential') AS predicted_differential,
count(*) FILTER (d <> 'not_differential' AND d = e) AS identified, count(*) FILTER (d <> 'not_differential' AND e = 'not_differential') AS false_positive, count(*) FILTER (d = 'not_differential' AND e <> 'not_differential') AS missed,
count(*) FILTER (d <> 'not_differential' AND e <> 'not_differential' AND d <> e) AS mismatched FROM duo""")
def differential_direction(spark, d):
    return _differential(spark, d)[1]


@query(f"WITH {_DIFFERENTIAL} SELECT a.feature_id, round(a.fc, 5) AS fold_change, a.predicted, duo.e AS true FROM assigned a JOIN duo USING (feature_id)")
def differential_assignments(spark, d):
    return _differential(spark, d)[0].select("feature_id", _r("fold_change", 5), "predicted", "true")


def _pairs(spark, d):
    seen = b.cells(spark, d).select("feature_id", "sample_id", "grp", F.col("area").alias("observed"))
    return seen.join(b.cells(spark, d, False).select("feature_id", "sample_id", F.col("area").alias("reference")), ["feature_id", "sample_id"])


_PAIRS = f"{b.cells_sql()}, {b.cells_sql(False, 'every')}, pairs AS (SELECT c.feature_id, c.grp, c.area AS observed, e.area AS reference FROM cells c JOIN every e ON c.feature_id = e.feature_id AND c.sample_id = e.sample_id)"


@query(f"""WITH {_PAIRS} SELECT feature_id, round(CASE WHEN n > 1 AND vx > 0 THEN slope END, 4) AS slope, round(CASE WHEN n > 1 AND vx > 0 AND vy > 0 THEN r2 END, 4) AS r2
FROM (SELECT feature_id, regr_count(observed, reference) AS n, regr_slope(observed, reference) AS slope, regr_r2(observed, reference) AS r2, var_pop(reference) FILTER (observed IS NOT NULL) AS vx, var_pop(observed) FILTER (reference IS NOT NULL) AS vy FROM pairs GROUP BY ALL)""")
def regression_slope_r2(spark, d):
    return evaluate.regression(_pairs(spark, d)).select("feature_id", _r("slope"), _r("r2"))


@query(f"""WITH {_PAIRS}, e AS (SELECT grp, abs(observed - reference) / nullif(abs(reference), 0) AS e FROM pairs) SELECT grp, count(*) FILTER (e <= 1) AS n, round(avg(e) FILTER (e <= 1), 6) AS mean_error, count(*) FILTER (e > 1) AS n_above FROM e WHERE e IS NOT NULL GROUP BY ALL""")
def relative_error_summary(spark, d):
    return evaluate.relative_errors(_pairs(spark, d)).select("grp", "n", _r("mean_error", 6), "n_above")


_FLAGS = f"""{_OBS}, {_TYPES},
al AS (SELECT l_partkey AS feature_id, max(l_discount) >= 0.1 AS wide, max(l_tax) >= 0.08 AS taxed FROM lineitem GROUP BY ALL),
fl AS (SELECT p.p_partkey AS feature_id, coalesce(error_type = 'FP', false) AS fp, coalesce(error_type = 'FN', false) AS fn, coalesce(wide, false) AS aligned, coalesce(taxed, false) AS bounded FROM part p LEFT JOIN types ON types.feature_id = p.p_partkey LEFT JOIN al ON al.feature_id = p.p_partkey)"""


def _flags(spark, d):
    wrong = evaluate.contained(_qualitative(spark, d)[1], b.universe(spark, d))
    top = b.peaks(spark, d).groupBy(F.col("ion_id").alias("feature_id")).agg(F.max("conf").alias("conf"), F.max("l_tax").alias("tax"))
    kind = F.col("error_type")
    return evaluate.marked(b.universe(spark, d), [(wrong, {"fp": kind.like("%FP%"), "fn": kind.like("%FN%")}), (top, {"aligned": F.col("conf") >= 0.1, "bounded": F.col("tax") >= 0.08})])


@query(f"""WITH {_FLAGS}, s AS (SELECT count(*) FILTER (fp) + count(*) FILTER (fn) + count(*) FILTER (aligned OR bounded) AS reported, count(*) FILTER (fp OR fn OR aligned OR bounded) AS unique_errors, count(*) AS universe FROM fl)
SELECT reported, unique_errors, universe, reported - unique_errors AS overlap, round(1 - unique_errors / universe, 6) AS accuracy FROM s""")
def overall_error_union(spark, d):
    o = evaluate.overall_errors(_flags(spark, d), ["fp", "fn"], ["aligned", "bounded"])
    return o.select("reported", "unique_errors", "universe", "overlap", _r("accuracy", 6))


@query(f"""WITH {_FLAGS} SELECT coalesce(CASE WHEN (fp OR fn) AND aligned THEN 'both' WHEN fp OR fn THEN 'qualitative' WHEN aligned THEN 'quantitative' END, 'none') AS error_source, count(*) AS n FROM fl GROUP BY ALL""")
def error_source_counts(spark, d):
    f = _flags(spark, d).select("feature_id", (F.col("fp") | F.col("fn")).alias("qualitative"), F.col("aligned").alias("quantitative"))
    return evaluate.error_sources(f).groupBy(F.coalesce("error_source", F.lit("none")).alias("error_source")).agg(F.count("*").alias("n"))


_METRICS = (("precision", "p"), ("recall", "r"), ("f1", "f"))
_TWO = f"{_OBS}, {_prf('kept', 'one')}, {_prf('(SELECT * FROM observed WHERE area > 60000)', 'two')}"


def _two_methods(spark, d):
    strong = _observed(spark, d).withColumn("area", F.when(F.col("area") > 60000, F.col("area")))
    return _scores(spark, d).withColumn("method", F.lit("one")).unionByName(evaluate.presence(strong, b.truth(spark, d)).withColumn("method", F.lit("two")))


@query(f"""WITH {_TWO} SELECT CAST(o.sample_id AS VARCHAR) AS sample_id, {', '.join(f'{t[0]}.{c} AS {t}_{c}' for t in ('one', 'two') for c in ('tp', 'fp', 'fn'))}, {', '.join(f'round({t[0]}.{k}, 6) AS {t}_{n}' for t in ('one', 'two') for n, k in _METRICS)} FROM one o JOIN two t ON t.sample_id = o.sample_id
{''.join(f"UNION ALL SELECT '{label}', {', '.join(['NULL'] * 6)}, {', '.join(f'(SELECT round({f}({k}), 6) FROM {t})' for t in ('one', 'two') for _, k in _METRICS)} " for label, f in (('Mean', 'avg'), ('STD', 'stddev_samp')))}""")
def wide_detection_table(spark, d):
    w = evaluate.wide_detection(_two_methods(spark, d), ["one", "two"])
    counts, metrics = ([f"{t}_{c}" for t in ("one", "two") for c in cs] for cs in (("tp", "fp", "fn"), evaluate.SCORES))
    return w.select("sample_id", *counts, *(_r(c, 6) for c in metrics))


_SIDES = f"""{b.cells_sql()}, ref AS (SELECT feature_id, sample_id, area FROM cells WHERE feature_id % 5 <> 0), obs AS (SELECT feature_id, sample_id, l.area FROM (SELECT l_partkey AS feature_id, l_suppkey % 8 AS sample_id, max(l_extendedprice) AS area FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) l WHERE feature_id % 7 <> 0),
grid AS (SELECT feature_id, sample_id, area FROM (SELECT DISTINCT feature_id FROM obs) CROSS JOIN (SELECT unnest(range(8)) AS sample_id) LEFT JOIN obs USING (feature_id, sample_id))"""


def _sides(spark, d):
    """Reference cells, and those of a method that has other features and more peaks."""
    reference = b.cells(spark, d).where("feature_id % 5 <> 0").select("feature_id", "sample_id", "area")
    found = b.areas(b.peaks(spark, d).where("class <> 'N' and ion_id % 7 <> 0").withColumnRenamed("ion_id", "feature_id"), "feature_id")
    return reference, found.select(F.lit("m").alias("method"), "feature_id", b.spread())


@query(f"""WITH {_SIDES}, r AS (SELECT feature_id, CAST(sample_id AS BIGINT) AS sample_id FROM ref WHERE area IS NOT NULL AND feature_id % 11 <> 0), o AS (SELECT feature_id, CAST(sample_id AS BIGINT) AS sample_id FROM obs)
SELECT coalesce(o.sample_id, r.sample_id) AS sample_id, count(*) FILTER (o.feature_id IS NOT NULL AND r.feature_id IS NOT NULL) AS tp, count(*) FILTER (r.feature_id IS NULL) AS fp, count(*) FILTER (o.feature_id IS NULL) AS fn
FROM o FULL JOIN r ON r.feature_id = o.feature_id AND r.sample_id = o.sample_id GROUP BY ALL""")
def detection_against_reference(spark, d):
    reference, observed = _sides(spark, d)
    absent = reference.where("feature_id % 11 = 0").select("feature_id")
    return evaluate.detection(reference, observed, absent)[0].select("sample_id", "tp", "fp", "fn")


@query(f"WITH {_SIDES} SELECT coalesce(g.feature_id, r.feature_id) AS feature_id, CASE WHEN r.feature_id IS NULL THEN 'FP' ELSE 'FN' END AS error_type FROM (SELECT DISTINCT feature_id FROM grid) g FULL JOIN (SELECT DISTINCT feature_id FROM ref) r ON r.feature_id = g.feature_id WHERE g.feature_id IS NULL OR r.feature_id IS NULL")
def detection_feature_errors(spark, d):
    reference, observed = _sides(spark, d)
    return evaluate.detection(reference, observed)[1].select("feature_id", "error_type")


_FIVE = lambda x: ", ".join(f"round({f}, 5) AS {n}" for n, f in (("q25", f"quantile_cont({x}, 0.25)"), ("median", f"median({x})"), ("q75", f"quantile_cont({x}, 0.75)"), ("mean", f"avg({x})")))


@query(f"""WITH {_SIDES}, e AS (SELECT g.feature_id, CASE WHEN r.area = 0 AND g.area <> 0 THEN 'inf'::DOUBLE ELSE abs(g.area - r.area) / nullif(abs(r.area), 0) END AS e FROM grid g JOIN ref r ON r.feature_id = g.feature_id AND r.sample_id = g.sample_id)
SELECT {_FIVE('CASE WHEN e <= 1 THEN e END')}, count(*) FILTER (e <= 1) AS n, count(DISTINCT feature_id) AS feature_count, count(*) FILTER (e > 1) AS excluded_above_1 FROM e""")
def integration_errors(spark, d):
    x = evaluate.integration(*_sides(spark, d))[1]
    return x.select(*(_r(c, 5) for c in ("q25", "median", "q75", "mean")), "n", "feature_count", "excluded_above_1")


@query(f"""WITH {_SIDES}, own AS (SELECT 'm' AS method, * FROM grid UNION ALL SELECT 'reference', * FROM ref), both_have AS (SELECT feature_id FROM own GROUP BY ALL HAVING count(DISTINCT method) = 2),
v AS (SELECT method, feature_id, CASE WHEN count(area) > 1 AND avg(area) <> 0 THEN stddev_pop(area) * 100 / avg(area) ELSE 0 END AS cv FROM own JOIN both_have USING (feature_id) GROUP BY ALL) SELECT method, {_FIVE('cv')}, count(cv) AS n FROM v GROUP BY ALL""")
def integration_variation(spark, d):
    x = evaluate.integration(*_sides(spark, d))[0]
    return x.select("method", *(_r(c, 5) for c in ("q25", "median", "q75", "mean")), "n")


@query(f"""WITH {_SIDES}, pairs AS (SELECT g.feature_id, g.area AS observed, r.area AS reference FROM grid g JOIN ref r ON r.feature_id = g.feature_id AND r.sample_id = g.sample_id),
f AS (SELECT feature_id, regr_count(observed, reference) AS n, regr_slope(observed, reference) AS slope, regr_r2(observed, reference) AS r2, var_pop(reference) FILTER (observed IS NOT NULL) AS vx, var_pop(observed) FILTER (reference IS NOT NULL) AS vy FROM pairs GROUP BY ALL),
v AS (SELECT 'slope' AS metric, CASE WHEN n > 1 AND vx > 0 THEN slope END AS x FROM f UNION ALL SELECT 'r2', CASE WHEN n > 1 AND vx > 0 AND vy > 0 THEN r2 END FROM f) SELECT metric, {_FIVE('x')}, count(x) AS n FROM v GROUP BY ALL""")
def integration_regression(spark, d):
    x = evaluate.integration(*_sides(spark, d))[2]
    return x.select("metric", *(_r(c, 5) for c in ("q25", "median", "q75", "mean")), "n")


_FINAL = f"""{_OBS}, {_TYPES}, {_fc_sql('f', 'cells', 'missing')}, quant AS (SELECT feature_id FROM f JOIN part ON p_partkey = feature_id WHERE fc IS NOT NULL AND feature_id % 7 <> 0 AND abs(fc - p_size / 20.0) / (p_size / 20.0) >= 0.2)"""


@query(f"""WITH {_FINAL}, w AS (SELECT coalesce(t.feature_id, q.feature_id) AS feature_id, t.feature_id IS NOT NULL AS a, q.feature_id IS NOT NULL AS b FROM types t FULL JOIN quant q ON q.feature_id = t.feature_id)
SELECT 'one' AS method, count(*) FILTER (a) AS qualitative_error_count, count(*) FILTER (b) AS quantitative_error_count, count(*) FILTER (a AND b) AS overlap_error_count, count(*) AS unique_error_count, (SELECT count(*) FROM part) AS evaluated_feature_entries,
round(1 - count(*) / (SELECT count(*) FROM part), 6) AS overall_accuracy, 'calculated' AS status FROM w UNION ALL SELECT 'two', NULL, NULL, NULL, NULL, (SELECT count(*) FROM part), NULL, 'not_available'""")
def final_accuracy(spark, d):
    """One method with both kinds of errors, and one whose quantitative errors are not there."""
    kinds = _qualitative(spark, d)[1].withColumn("method", F.lit("one"))
    out = evaluate.accuracy_summary(_methods(spark), kinds, _quantitative(spark, d).where("is_error"), b.universe(spark, d))[0]
    return out.withColumn("overall_accuracy", F.round("overall_accuracy", 6))


def _methods(spark):
    return spark.createDataFrame([("one", True, True), ("two", True, False)], "method string, qualitative boolean, quantitative boolean")


def _quantitative(spark, d):
    true = b.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), (F.col("p_size") / 20.0).alias("true_fold_change"))
    return evaluate.fold_change_errors(evaluate.fold_changes(_observed(spark, d)), true).withColumn("method", F.lit("one"))


@query(f"""WITH {_FINAL}, c AS (SELECT count(*) AS n FROM f JOIN part ON p_partkey = feature_id WHERE fc IS NOT NULL AND feature_id % 7 <> 0)
SELECT 'one' AS method, (SELECT n FROM c) AS compared, count(*) AS errors, (SELECT count(*) FROM part) AS truth_features, round(1 - count(*) / (SELECT count(*) FROM part), 6) AS accuracy FROM quant""")
def quantitative_accuracy(spark, d):
    x = evaluate.quantitative_accuracy(_quantitative(spark, d), b.universe(spark, d))
    return x.withColumn("accuracy", F.round("accuracy", 6))


# ---- numeric joins ------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT s_suppkey AS target_id, s_acctbal AS target_mz FROM supplier WHERE s_acctbal > 0), c AS (SELECT c_custkey AS centroid_id, c_acctbal AS mz FROM customer WHERE c_acctbal > 0)
SELECT target_id, centroid_id, mz, round(abs(mz - target_mz), 4) AS distance FROM t JOIN c ON abs(mz - target_mz) < target_mz * 2000e-6 QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY abs(mz - target_mz), mz, centroid_id) = 1""")
def nearest_mz_ppm(spark, d):
    n = joins.nearest(b.targets(spark, d), b.centroids(spark, d), "target_id", "target_mz", "mz", F.col("target_mz") * 2000e-6, 20.0, ["centroid_id"])
    return n.select("target_id", "centroid_id", "mz", _r("distance"))


def _range(mode: str):
    def run(spark, d):
        t = F.col("target_mz")
        return joins.window_reduce(b.targets(spark, d), b.centroids(spark, d), "target_id", "target_mz", "mz", t * (1 - 2000e-6), t * (1 + 2000e-6), 25.0, "intensity", mode).select("target_id", "intensity", "n")

    run.__name__ = f"eic_range_{mode}"
    query(f"""WITH t AS (SELECT s_suppkey AS target_id, s_acctbal AS m FROM supplier WHERE s_acctbal > 0) SELECT target_id, coalesce({mode}(c_nationkey), 0)::DOUBLE AS intensity, count(c_custkey) AS n
FROM t LEFT JOIN customer ON c_acctbal > 0 AND c_acctbal >= m * (1 - 2000e-6) AND c_acctbal <= m * (1 + 2000e-6) GROUP BY ALL""")(run)


for _mode in ("sum", "max"):
    _range(_mode)


@query("""SELECT c_custkey AS centroid_id, c_acctbal AS mz FROM customer c WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s_acctbal > 0 AND abs(c.c_acctbal - s.s_acctbal) < 1)""")
def decoy_anti_range(spark, d):
    return joins.away_from(b.centroids(spark, d), b.targets(spark, d), "centroid_id", "mz", "target_mz", 1.0).select("centroid_id", "mz")


# ---- samples and names --------------------------------------------------------------------------------------------


@query()
def hash_sample_fixed_n(spark, d):
    return sampling.fixed_size(b.centroids(spark, d), "centroid_id", 20)


@query("""WITH n AS (SELECT count(*) AS n FROM labels), r AS (SELECT * FROM (VALUES ('train', 0.8, 1), ('val', 0.1, 2), ('test', 0.1, 3)) v(split, ratio, i)),
e AS (SELECT split, i, n, n * ratio::DOUBLE AS exact, CAST(floor(n * ratio::DOUBLE + 1e-9) AS BIGINT) AS whole FROM r CROSS JOIN n)
SELECT split, whole + CASE WHEN row_number() OVER (ORDER BY whole - exact, i) <= n - sum(whole) OVER () THEN 1 ELSE 0 END AS n FROM e""")
def stratified_split(spark, d):
    """Rows of each part: the largest remainders of the ratios. Strata are checked by ``stratified_split_counts``."""
    s = sampling.stratified_split(b.table(spark, d, "labels"), "doc_id", ["quality", "toxic"], ["train", "val", "test"], [0.8, 0.1, 0.1])
    return s.groupBy("split").agg(F.count("*").alias("n"))


@query()
def stratified_split_counts(spark, d):
    s = sampling.stratified_split(b.table(spark, d, "labels"), "doc_id", ["quality", "toxic"], ["train", "val", "test"], [0.8, 0.1, 0.1])
    return s.groupBy("split", "quality", "toxic").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT 'img' || l_orderkey || '_' || l_linenumber AS stem, l_discount AS xc, l_tax AS yc FROM lineitem) SELECT stem, xc, yc FROM l UNION ALL SELECT 'flip_' || stem, 1 - xc, yc FROM l""")
def flip_augment(spark, d):
    li = b.peaks(spark, d)
    stem = F.concat(F.lit("img"), "l_orderkey", F.lit("_"), "l_linenumber")
    rows = li.select(stem.alias("stem"), F.lit(1).alias("line"), F.lit(0).alias("class_id"), F.col("conf").alias("xc"), F.col("l_tax").alias("yc"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))
    again = rows.unionByName(rows.limit(0).withColumn("stem", F.concat(F.lit("flip_"), "stem")))
    return sampling.flip(again).select("stem", "xc", "yc")


@query("""WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS observed FROM lineitem GROUP BY ALL), m AS (SELECT *, sum(observed) OVER (PARTITION BY l_returnflag) AS a, sum(observed) OVER (PARTITION BY l_linestatus) AS b, sum(observed) OVER () AS total FROM n)
SELECT l_returnflag, l_linestatus, observed, round(a * b / total, 4) AS expected, round((observed - a * b / total) ** 2 / (a * b / total), 4) AS part FROM m""")
def chi_square_table(spark, d):
    c = sampling.contingency(b.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return c.select("l_returnflag", "l_linestatus", "observed", _r("expected"), _r("part"))


@query(r"""WITH s AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'mix' || c_custkey || '_P_run(' || c_custkey || ')' WHEN 1 THEN 'mix' || c_custkey || '_HN_x' WHEN 2 THEN 'mix' || c_custkey || '_N2' ELSE 'mix' || c_custkey END AS s FROM customer)
SELECT c_custkey, CASE WHEN contains(s, '_P') THEN regexp_extract(s, '^(.*?_P)', 1) WHEN contains(s, '_HN') THEN regexp_extract(s, '^(.*?_HN)', 1) WHEN contains(s, '_N') THEN regexp_extract(s, '^(.*?_N)', 1) ELSE s END AS sample,
  coalesce(CAST(nullif(regexp_extract(s, '\((\d+)\)', 1), '') AS BIGINT), 1) AS run FROM s""")
def name_canonicalise(spark, d):
    k = F.col("c_custkey")
    named = F.when(F.col("c_nationkey") % 4 == 0, F.concat(F.lit("mix"), k, F.lit("_P_run("), k, F.lit(")"))).when(F.col("c_nationkey") % 4 == 1, F.concat(F.lit("mix"), k, F.lit("_HN_x"))).when(F.col("c_nationkey") % 4 == 2, F.concat(F.lit("mix"), k, F.lit("_N2"))).otherwise(F.concat(F.lit("mix"), k))
    return b.table(spark, d, "customer").withColumn("s", named).select("c_custkey", names.polarity(F.col("s")).alias("sample"), names.run_order(F.col("s")).cast("long").alias("run"))


@query("""SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'P' WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'N' END AS mode, count(*) AS n FROM customer GROUP BY ALL""")
def ion_mode_recode(spark, d):
    mode = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Positive").when(F.col("c_mktsegment").isin("AUTOMOBILE", "FURNITURE"), "Hilic").otherwise("other")
    return b.table(spark, d, "customer").groupBy(names.ion_mode(mode).alias("mode")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS position FROM supplier""")
def natural_sort_ids(spark, d):
    s = b.table(spark, d, "supplier").select("s_suppkey", names.natural_key(F.concat(F.lit("Ion"), "s_suppkey")).alias("key"))
    return ranks.with_rank(s, [F.col("key"), F.col("s_suppkey")], "position").select("s_suppkey", "position")


@query("""WITH n AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS o FROM lineitem GROUP BY ALL), every AS (SELECT x.a, y.b, coalesce(n.o, 0) AS o FROM (SELECT DISTINCT a FROM n) x CROSS JOIN (SELECT DISTINCT b FROM n) y LEFT JOIN n ON n.a = x.a AND n.b = y.b),
e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM every), s AS (SELECT sum((o - e) ** 2 / e) AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS degrees FROM e)
SELECT round(x, 4) AS statistic, degrees, round(exp(-x / 2) * list_sum(list_transform(range((degrees // 2)::BIGINT), lambda k: (x / 2) ** k / factorial(k::INTEGER))), 6) AS p FROM s""")
def chi_square_test(spark, d):
    """An even number of degrees of freedom, for which p is a finite sum."""
    return sampling.chi_square(b.table(spark, d, "lineitem"), "l_returnflag", "l_linenumber").select(_r("statistic"), "degrees", _r("p", 6))


# ---- figures ------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT o_orderpriority, o_totalprice, round(cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 8) AS share FROM orders""")
def distribution_curve(spark, d):
    return plots.distribution(b.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", "o_totalprice", _r("share", 8))


@query(f"""WITH {b.POINTS_SQL}, p AS (SELECT *, i - 1 AS place, least(floor(coalesce((rt - min(rt) OVER w) / nullif(max(rt) OVER w - min(rt) OVER w, 0), 0) * 6), 5)::INTEGER AS pixel FROM pts WINDOW w AS (PARTITION BY sample_id, ion_id)),
r AS (SELECT *, row_number() OVER (q ORDER BY place) AS a, row_number() OVER (q ORDER BY place DESC) AS b, row_number() OVER (q ORDER BY intensity, place) AS c, row_number() OVER (q ORDER BY intensity DESC, place) AS d FROM p WINDOW q AS (PARTITION BY sample_id, ion_id, pixel))
SELECT sample_id, ion_id, pixel, place::INTEGER AS place, round(rt, 4) AS rt, intensity FROM r WHERE 1 IN (a, b, c, d)""")
def thinned_traces(spark, d):
    return plots.thinned(b.signals(spark, d), 6).select("sample_id", "ion_id", "pixel", "place", _r("rt"), "intensity")


@query(f"""WITH {b.POINTS_SQL}, s AS (SELECT *, min(rt) OVER w AS ta, max(rt) OVER w AS tb FROM pts WINDOW w AS (PARTITION BY sample_id, ion_id)),
off AS (SELECT *, abs(rt - (ta + 0.25 * (tb - ta))) AS a, abs(rt - (ta + 0.75 * (tb - ta))) AS b FROM s),
least AS (SELECT *, min(a) OVER w AS least_a, min(b) OVER w AS least_b FROM off WINDOW w AS (PARTITION BY sample_id, ion_id)),
near AS (SELECT sample_id, ion_id, min(i - 1) FILTER (a = least_a) AS lo, min(i - 1) FILTER (b = least_b) AS hi FROM least GROUP BY sample_id, ion_id)
SELECT sample_id, ion_id, CASE WHEN sample_id % 3 <> 0 THEN lo END::INTEGER AS fill_lo_idx, CASE WHEN sample_id % 3 <> 0 THEN hi END::INTEGER AS fill_hi_idx FROM near""")
def trace_fills(spark, d):
    """Peaks over the middle half of each trace, but for every third sample."""
    s = b.signals(spark, d)
    first, last = F.col("points")[0]["rt"], F.element_at("points", -1)["rt"]
    p = s.where("sample_id % 3 <> 0").select("sample_id", "ion_id", (first + 0.25 * (last - first)).alias("rtmin"), (first + 0.75 * (last - first)).alias("rtmax"))
    return plots.fills(s, p).drop("points")


# ---- discovery ----------------------------------------------------------------------------------------------------


def _islands_sql(name: str, of: str, keys: str, order: str, far: str) -> str:
    by = f"PARTITION BY {keys} ORDER BY {order}"
    return f"{name} AS (SELECT * EXCLUDE (cut), coalesce(sum(cut) OVER ({by} RANGE UNBOUNDED PRECEDING), 0) AS {name} FROM (SELECT *, ({order} - lag({order}) OVER ({by}) > {far.replace('BEFORE', f'lag({order}) OVER ({by})')})::INT AS cut FROM {of}))"


@query(f"""WITH c AS (SELECT l_suppkey AS sample_id, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS scan, l_extendedprice AS mz, l_quantity AS intensity FROM lineitem),
{_islands_sql("m0", "c", "sample_id", "mz", "BEFORE * 0.005")}, {_islands_sql("r0", "m0", "sample_id, m0", "scan", "60")},
{_islands_sql("m1", "r0", "sample_id, m0, r0", "mz", "BEFORE * 0.005")}, {_islands_sql("r1", "m1", "sample_id, m0, r0, m1", "scan", "60")}
SELECT sample_id, round(sum(mz * intensity), 2) AS moment, min(mz) AS mz_min, max(mz) AS mz_max, min(scan)::BIGINT AS scan_min, max(scan)::BIGINT AS scan_max, count(*) AS n, count(DISTINCT scan) AS scans, sum(intensity) AS intensity
FROM r1 GROUP BY sample_id, m0, r0, m1, r1 HAVING count(DISTINCT scan) >= 2 AND count(*) FILTER (intensity >= 20) >= 2""")
def mass_traces(spark, d):
    """Suppliers as samples, days of shipping as scans, prices as masses."""
    c = b.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("scan"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))
    t = traces.mass_traces(c.withColumn("rt", F.col("scan") / 60), 5000.0, gap=60, least=2, strong=20.0)
    # a weighted mean of prices may lie halfway between two rounded ones; its product with the weight does not
    return t.select("sample_id", F.round(F.col("mz") * F.col("intensity"), 2).alias("moment"), "mz_min", "mz_max", "scan_min", "scan_max", "n", "scans", "intensity")


@query()
def wavelet_peaks(spark, d):
    p = b.signals(spark, d).select("sample_id", "ion_id", F.explode(wavelets.peaks(signal.intensities(F.col("points")))).alias("p"))
    return p.select("sample_id", "ion_id", "p.lo", "p.hi", "p.apex", "p.scale", F.round("p.snr", 4).alias("snr"))


@query()
def detector_calls(spark, d):
    """The detector called from SQL, over the rows of the signals."""
    table_functions.register(spark)
    b.points(spark, d).createOrReplaceTempView("eluent_points")
    return spark.sql("SELECT sample_id, ion_id, lo, hi, round(rt, 4) AS rt, scale, round(snr, 4) AS snr FROM detect_peaks(TABLE(eluent_points), least_snr => 4.0)")


@query(f"""WITH {b.PEAKS_SQL}, named AS (SELECT *, l_orderkey || '-' || l_linenumber AS peak_id, floor(rt / 10.0)::BIGINT AS cell, CASE WHEN sample_id < 4 THEN 'A' ELSE 'B' END AS grp FROM peaks),
w AS (SELECT unnest(range(-{groups.REACH}, {groups.REACH + 1})) AS k, unnest({groups.WEIGHTS}) AS w),
density AS (SELECT ion_id, cell + k AS cell, sum(w)::BIGINT AS density FROM named, w GROUP BY ALL),
steps AS (SELECT *, sign(density - lag(density) OVER o) AS step, cell - lag(cell) OVER o > 1 AS gap FROM density WINDOW o AS (PARTITION BY ion_id ORDER BY cell)),
was AS (SELECT *, last_value(nullif(step, 0) IGNORE NULLS) OVER (PARTITION BY ion_id ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM steps),
regions AS (SELECT ion_id, cell, coalesce(sum((gap OR (step > 0 AND coalesce(was, 0) < 0))::INT) OVER (PARTITION BY ion_id ORDER BY cell), 0) AS region FROM was),
placed AS (SELECT n.*, r.region, count(*) OVER (PARTITION BY n.ion_id) AS alone FROM named n JOIN regions r USING (ion_id, cell)),
enough AS (SELECT DISTINCT ion_id, region FROM placed GROUP BY ion_id, region, grp HAVING count(DISTINCT sample_id) >= 2),
marked AS (SELECT p.*, e.region IS NOT NULL AND alone > 1 AS grouped FROM placed p LEFT JOIN enough e USING (ion_id, region)),
features AS (SELECT ion_id, region, grouped, CASE WHEN NOT grouped THEN peak_id END AS own, count(*) AS npeaks, count(DISTINCT sample_id) AS n_detected, median(rt) AS rtmed, any_value(alone) AS alone FROM marked GROUP BY ALL)
SELECT ion_id, ion_id || '__G' || lpad(row_number() OVER (PARTITION BY ion_id ORDER BY grouped DESC, rtmed, region, own)::VARCHAR, 3, '0') AS feature_id,
  CASE WHEN grouped THEN 'density_group' WHEN alone = 1 THEN 'manual_singleton' ELSE 'unassigned_singleton' END AS group_source, npeaks, n_detected, round(rtmed, 4) AS rtmed FROM features""")
def density_groups(spark, d):
    p = b.peaks(spark, d).withColumn("peak_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    s = spark.createDataFrame([(s, "A" if s < 4 else "B") for s in b.SAMPLES], "sample_id long, grp string")
    g = groups.density_groups(p.select("peak_id", "ion_id", "sample_id", "rt"), 40.0, s)
    return groups.features(g.withColumn("mz", F.lit(0.0)), len(b.SAMPLES)).select("ion_id", "feature_id", "group_source", "npeaks", "n_detected", _r("rtmed"))


@query()
def warped_runs(spark, d):
    """Eight runs by supplier, parts as masses, aligned to the first."""
    p = b.peaks(spark, d).select("sample_id", (F.col("rt") / 20).alias("rt"), F.col("ion_id").cast("double").alias("mz"), F.col("width").alias("intensity"))
    return alignment.warps(p, 0, 0.5).select("sample_id", "cell", _r("shift"))


@query("""WITH boxes AS (SELECT s_suppkey AS box, 1000.0 + (s_suppkey * 37 % 900) * 100 AS lo, 8100 + s_suppkey * 53 % 2200 AS first FROM supplier),
points AS (SELECT l_extendedprice AS mz, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS rt, l_quantity AS intensity FROM lineitem)
SELECT box, count(*) AS n, sum(intensity) AS intensity FROM boxes JOIN points ON mz BETWEEN lo AND lo * 1.02 AND rt BETWEEN first AND first + 100 GROUP BY box""")
def rectangle_sums(spark, d):
    """Prices and days of shipping as masses and times, a rectangle for each supplier."""
    key = F.col("s_suppkey")
    low, first = 1000.0 + (key * 37 % 900) * 100, (8100 + key * 53 % 2200).cast("double")
    boxes = b.table(spark, d, "supplier").select(key.alias("box"), low.alias("mz_low"), (low * 1.02).alias("mz_high"), first.alias("rt_low"), (first + 100).alias("rt_high"))
    points = b.peaks(spark, d).select(F.col("area").alias("mz"), "rt", F.col("width").alias("intensity"))
    return joins.in_rectangles(points, boxes).groupBy("box").agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity"))


# ---- whole chains -------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 1000 + 500) AS y, len(embedding) AS n FROM embeddings),
a AS (SELECT *, list_position(y, list_max(y)) - 1 AS k FROM e), c AS (SELECT *, greatest(k - 3, 0) AS lo, least(k + 3, n - 1) AS hi,
  list_transform(range(n), lambda i: CASE WHEN i = 0 THEN 31 * y[1] + 9 * y[2] - 3 * y[3] - 5 * y[4] + 3 * y[5] WHEN i = 1 THEN 9 * y[1] + 13 * y[2] + 12 * y[3] + 6 * y[4] - 5 * y[5]
    WHEN i = n - 1 THEN 31 * y[n] + 9 * y[n - 1] - 3 * y[n - 2] - 5 * y[n - 3] + 3 * y[n - 4] WHEN i = n - 2 THEN 9 * y[n] + 13 * y[n - 1] + 12 * y[n - 2] + 6 * y[n - 3] - 5 * y[n - 4]
    ELSE -3 * y[i - 1] + 12 * y[i] + 17 * y[i + 1] + 12 * y[i + 2] - 3 * y[i + 3] END / 35) AS m FROM a),
q AS (SELECT *, list_transform(range(n), lambda i: CASE WHEN y[i + 1] = 0 THEN 0 ELSE (y[i + 1] - m[i + 1]) / sqrt(abs(y[i + 1])) END) AS q, list_max(y[lo + 1:hi + 1]) AS top, list_min(y[lo + 1:hi + 1]) AS low, list_concat(y[1:lo], y[hi + 1:n]) AS rest,
  greatest(list_sort(m)[floor(n * 0.3)::INT + 1], 1) AS base, y[greatest(lo - 5, 0) + 1:lo] AS before, y[hi + 1:hi + 5] AS after FROM c),
s AS (SELECT *, list_aggregate(q, 'stddev_pop') AS sd FROM q),
t AS (SELECT *, list_aggregate(list_filter(q, lambda x: abs(x) <= 2 * sd), 'stddev_pop') AS noise, list_aggregate(rest[floor(n * 0.1)::INT + 1:len(rest) - floor(n * 0.1)::INT], 'stddev_pop') AS sd2,
  CASE WHEN lo > 3 THEN list_max(y[1:lo]) ELSE low END AS add1, CASE WHEN hi < n - 3 THEN list_max(y[hi + 1:n]) ELSE low END AS add2 FROM s)
SELECT vec_id, round((top - low) / (noise * sqrt(base)), 4) AS sn, round(base, 4) AS baseline, round((top - list_avg(rest)) / sd2, 4) AS sn_2, round(top / coalesce(list_max(list_concat(before, after)) + 1, 1), 4) AS sn_3, round(top / coalesce(list_max(before) + 1, 1), 4) AS sn_31,
  round(top / coalesce(list_max(after) + 1, 1), 4) AS sn_32, round(top / (CASE WHEN lo = 0 THEN add2 WHEN hi = n - 1 THEN add1 ELSE least(add1, add2) END + 1), 4) AS sn_4, round(top / list_max(rest), 4) AS sn_5 FROM t""")
def snr_family(spark, d):
    """Vectors of 64 components as signals."""
    e = b.table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda y, i: F.struct(i.cast("double").alias("rt"), (y * 1000 + 500).alias("intensity"))).alias("points"))
    k = signal.apex_index(F.col("points")).cast("int") - 1
    rows = signal.with_snr(e.withColumns({"lo": F.greatest(k - 3, F.lit(0)), "hi": F.least(k + 3, F.size("points") - 1)}))
    return rows.select("vec_id", *(F.round(f"snr.{c}", 4).alias(c) for c in ("sn", "baseline", "sn_2", "sn_3", "sn_31", "sn_32", "sn_4", "sn_5")))


def _matrix(spark, d, detector):
    from . import pipelines

    s = b.signals(spark, d)
    ions = b.points(spark, d).groupBy("ion_id").agg(F.median("rt").alias("rt_theory"))
    cells, _ = pipelines.run(s, ions, detector=detector, most_error=1e9)  # event times have no theory to hold them to
    return cells.select("ion_id", "sample_id", _r("area", 3))


@query()
def untargeted_matrix(spark, d):
    return _matrix(spark, d, detect.local_maxima)


@query()
def untargeted_matrix_wavelet(spark, d):
    return _matrix(spark, d, detect.wavelet)
