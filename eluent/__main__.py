"""Command line: ``python -m eluent targeted`` or ``untargeted``, over the mzML files and tables of a folder."""

from __future__ import annotations

import argparse

from pyspark import SparkConf
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import matrix
from .plans import discovery, pipelines
from .sources import mzml, samples, sinks, tables
from .sources.stages import Stages


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="eluent")
    ways = top.add_subparsers(dest="workflow", required=True)
    targeted, untargeted = ways.add_parser("targeted"), ways.add_parser("untargeted")
    for p in (targeted, untargeted):
        p.add_argument("--indir", required=True, help="folder with mzML, and all_ions.tsv or peak_list.csv (untargeted: or neither)")
        p.add_argument("--outdir", required=True)
        p.add_argument("--threads", type=int, help="tasks at a time where no master is set; a cluster has settings of its own")
    targeted.add_argument("--type", default="rp", help="chromatography; the cut by theoretical time is for rp alone")
    untargeted.add_argument("--ppm", type=float, default=10.0)
    untargeted.add_argument("--polarity", choices=["positive", "negative"], default="positive")
    for flag, value in (("minWidth", discovery.LEAST_WIDTH), ("maxWidth", discovery.MOST_WIDTH), ("s2n", discovery.SNR), ("noise", discovery.NOISE), ("mzDiff", discovery.MZ_DIFF)):
        untargeted.add_argument(f"--{flag}", type=float, default=value, help="for the discovery of features, without peak_list.csv")
    untargeted.add_argument("--prefilter", type=float, default=discovery.PREFILTER)
    untargeted.add_argument("--all_ions", choices=["cal", "self"], default="self", help="self: peak_list.csv if it is there; cal: discover features even so")
    return top.parse_args(argv)


def targeted(spark: SparkSession, args: argparse.Namespace) -> None:
    """Ions: all_ions.tsv with mw ID, RT (min) and ion_mode. The samples of each polarity are a run of their own."""
    listed = tables.read(spark, f"{args.indir}/all_ions.tsv")
    ions = listed.select(F.col("mw ID").alias("ion_id"), F.col("RT (min)").cast("double").alias("rt_theory"), F.col("ion_mode"))
    traces = mzml.chromatograms(spark, args.indir).where("kind = 'SRM'").select("sample_id", "ion_id", "points")
    signals = samples.of_mode(samples.known_ions(traces, ions, f"{args.outdir}/error"), ions)
    cells, peaks = pipelines.run_polarities(signals, ions.select("ion_id", "rt_theory"), Stages(spark, f"{args.outdir}/stages", vars(args)), chromatography=args.type)
    _write(spark, cells, peaks, args.outdir)


def untargeted(spark: SparkSession, args: argparse.Namespace) -> None:
    """Features: peak_list.csv with Compound Name, mz and RT in minutes; where there is none, features are discovered."""
    stages = Stages(spark, f"{args.outdir}/stages", vars(args))
    spectra = stages.keep("spectra", mzml.spectra(spark, args.indir))
    if args.all_ions == "self" and stages.exists(f"{args.indir}/peak_list.csv"):
        listed = tables.read(spark, f"{args.indir}/peak_list.csv")
    else:
        options = {"least_width": args.minWidth, "most_width": args.maxWidth, "snr": args.s2n, "noise": args.noise, "mz_diff": args.mzDiff, "prefilter": int(args.prefilter)}
        found, _ = discovery.discover(spectra, stages.below("discovery"), ppm=args.ppm, **options)
        listed = discovery.peak_list(found)
    features = listed.select(F.col("Compound Name").alias("ion_id"), F.col("mz").cast("double").alias("mz"), F.col("RT").cast("double").alias("rt"))
    bad = stages.keep("rejected", mzml.rejected(spectra, features))
    signals = mzml.ion_traces(spectra.join(bad.select("sample_id"), "sample_id", "left_anti"), features, args.ppm)
    cells, peaks = pipelines.run(signals, features.select("ion_id", F.col("rt").alias("rt_theory")), stages=stages)
    sinks.dropped(bad, f"{args.outdir}/rejected_files")
    tables.write_tsv(tables.transition_list(features, args.polarity.capitalize()), f"{args.outdir}/transitions")
    _write(spark, cells, peaks, args.outdir)


def _write(spark: SparkSession, cells, peaks, path: str) -> None:
    names = [r[0] for r in cells.select("sample_id").distinct().orderBy("sample_id").collect()]  # of one study
    tables.write_tsv(matrix.widen(cells, names, "").orderBy("ion_id"), f"{path}/matrix", 10)
    tables.write_tsv(sinks.final_layout(peaks), f"{path}/peaks", 10)
    tables.write_tsv(sinks.remarks(cells), f"{path}/remark")


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    builder = SparkSession.builder.appName("eluent")
    if args.threads and SparkSession.getActiveSession() is None and not SparkConf().contains("spark.master"):
        builder = builder.master(f"local[{args.threads}]")
    {"targeted": targeted, "untargeted": untargeted}[args.workflow](builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
