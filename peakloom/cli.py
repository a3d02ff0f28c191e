"""``python -m peakloom.cli -i a.bam b.bam -o regions``: consensus regions of samples."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from peakloom.functions.columns import normalised_name
from peakloom.plans.consensus import GENOMES, Settings, call, call_narrow, input_paths, quantile_texts, scores
from peakloom.session import ship
from peakloom.sources import text

VERSION = "0.3"
#: Other names of settings, by which they are known elsewhere (fixed values).
NAMES = {
    "null_draws": ["--budget_null_draws"], "scale_budgets": ["--scale_chrom_budgets"], "posterior_quantile": ["--budget_posterior_quantile"], "penalty": ["--selection_penalty"],
    "lower_bound_z": ["--score_lower_bound_z"], "prior_df": ["--score_prior_df"], "min_effect": ["--score_min_effect"], "precision_floor": ["--score_precision_floor_ratio"],
    "min_mapq": ["--min_mapping_score"], "extend": ["--extend_reads"], "min_length": ["--min_length_bp"], "null_regions": ["--ecdf_samples"], "null_seed": ["--ecdf_seed"],
    "step": ["-w"], "chrom_sizes_file": ["-s"],
}
_APART = {"genome_size", "genome"}
#: Draws of a run that is told to be small, unless a number is asked for.
FEW_DRAWS = 16


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="peakloom", description=__doc__)
    p.add_argument("-i", "--input_files", nargs="+")
    p.add_argument("-o", "--output", "--outfile", default="regions.bed")
    p.add_argument("-g", "--genome", help=f"one of {', '.join(sorted(GENOMES))}; gives contig sizes and the effective genome size")
    p.add_argument("--effective_genome_size", type=float)
    p.add_argument("--narrowPeak", action="store_true", help="also score the regions and write them, with summits, to OUTPUT.narrowPeak")
    p.add_argument("--config", help="JSON file; its settings, under any of their names, replace those of the command line")
    p.add_argument("--threads", type=int, default=-1, help="cores of a local session; above 0 alone it says anything")
    p.add_argument("--ecdf_proc", type=int, help="accepted for scripts that give it: Spark spreads the random regions over its tasks")
    p.add_argument("--low_memory", action="store_true", help=f"at most {FEW_DRAWS} null draws, unless their number is given")
    p.add_argument("-v", "--verbose", action="store_true", help="also print the score quantiles of each contig")
    p.add_argument("--version", action="version", version=f"peakloom {VERSION}")
    known = Settings()
    for f in fields(Settings):
        if f.name in _APART:
            continue
        value, flags = getattr(known, f.name), [*(x for x in NAMES.get(f.name, []) if x[1] != "-"), f"--{f.name}", *(x for x in NAMES.get(f.name, []) if x[1] == "-")]
        if isinstance(value, bool):
            p.add_argument(*flags, dest=f.name, action="store_true")
        elif isinstance(value, list):
            p.add_argument(*flags, dest=f.name, nargs="*", default=value)
        else:
            kind = type(value) if value is not None else {"min_length": int, "chrom_sizes_file": str}.get(f.name, float)
            p.add_argument(*flags, dest=f.name, type=kind, default=None if f.name == "null_draws" else value)
    return p


def settings(args: argparse.Namespace) -> Settings:
    given = {f.name: getattr(args, f.name) for f in fields(Settings) if f.name not in _APART}
    given |= {"genome": args.genome, "effective_genome_size": args.effective_genome_size}
    if args.config:
        own = {alias.lstrip("-"): name for name, aliases in NAMES.items() for alias in aliases}
        given = text.with_defaults(given, {own.get(k, k): v for k, v in text.read_config(args.config).items()})
    if given["genome"] is not None:
        given["genome"] = normalised_name(given["genome"])
        if given["genome"] not in GENOMES:
            raise ValueError(f"unknown genome {given['genome']}; known are {', '.join(sorted(GENOMES))}")
    size = given.pop("effective_genome_size")
    given["genome_size"] = size or GENOMES[given["genome"] or "hg38"]
    given["norm_method"] = normalised_name(given["norm_method"]).upper()
    given["null_draws"] = given["null_draws"] or (FEW_DRAWS if args.low_memory else Settings().null_draws)
    given["ignore_for_norm"] = given["ignore_for_norm"] or Settings().ignore_for_norm
    return Settings(**given)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    p = parser()
    if not argv:
        p.print_help()
        return 0
    args = p.parse_args(argv)
    if not args.input_files:
        p.error("no input files")
    from pyspark.sql import SparkSession

    paths, s = input_paths(args.input_files), settings(args)
    builder = SparkSession.builder.appName("peakloom")
    spark = ship((builder.master(f"local[{args.threads}]") if args.threads > 0 else builder).getOrCreate())
    if args.verbose:
        for chrom, said in quantile_texts(scores(spark, paths, s)[0]).items():
            print(f"{chrom}: {said}", file=sys.stderr)
    if not args.narrowPeak:
        text.write_regions(call(spark, paths, s), args.output)
        return 0
    regions, scored = call_narrow(spark, paths, s)
    text.write_regions(regions, args.output)
    text.write_narrow_peaks(scored, f"{args.output}.narrowPeak")
    return 0


if __name__ == "__main__":
    sys.exit(main())
