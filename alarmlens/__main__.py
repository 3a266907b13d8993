"""Command line: python -m alarmlens STAGE [--samples CSV --segments CSV | --synthetic | --tables DIR] --out DIR.

layer1 profiles channels and estimates noise, layer2 detects and calibrates, layer3 and models run the registered queries of
their part over a folder of tables. Exit code 1 where an input is missing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import alarmlens.plans.detection  # noqa: F401  registers its queries
import alarmlens.plans.ensembles  # noqa: F401
import alarmlens.plans.evidence  # noqa: F401
import alarmlens.plans.models  # noqa: F401
import alarmlens.plans.onsets  # noqa: F401
import alarmlens.plans.resampling  # noqa: F401
import alarmlens.plans.studies  # noqa: F401
from alarmlens.operators import bocpd, evidence, profile
from alarmlens.operators.catalogue import QUERIES
from alarmlens.sources import files
from alarmlens.sources.telemetry import from_events

STAGES = {
    "layer3": ("mc_correction", "mc_channel_summary", "canonical_onset", "onset_placebo_pool", "placebo_mannwhitney", "precedence_wilcoxon", "triple_verification", "dl_meta_by_feature", "dl_meta_fraction", "loo_sensitivity", "influence_flags"),
    "models": ("onset_tabular_dataset", "model_leaderboard", "model_importance", "model_agreement", "importance_pivot", "family_summary", "agreement_summary", "stability_bootstrap"),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="alarmlens")
    out.add_argument("stage", choices=["layer1", "layer2", *STAGES])
    out.add_argument("--samples", help="CSV of samples")
    out.add_argument("--segments", help="CSV of segment labels, where samples have none")
    out.add_argument("--tables", help="folder of tables, instead of CSV")
    out.add_argument("--synthetic", action="store_true", help="a generated table")
    out.add_argument("--estimator", choices=["simple", "mixture"], default="mixture")
    out.add_argument("--no-shrinkage", action="store_true")
    out.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    out.add_argument("--out", required=True)
    return out


def load(spark: SparkSession, args: argparse.Namespace):
    if args.synthetic:
        return files.synthetic(spark)
    if args.tables:
        return files.existing(lambda p: from_events(spark, p), args.tables)
    if not args.samples:
        raise files.MissingInput("name --samples, --tables or --synthetic")
    return files.read_samples(spark, args.samples, args.segments)


def layer1(samples, args) -> dict:
    noise = profile.estimated(samples, args.estimator)
    if not args.no_shrinkage:
        r = profile.shrink(noise.select("channel", "r", "n_diff"), "r", "n_diff").select("channel", F.col("shrunk").alias("r_shrunk"), F.col("weight").alias("r_weight"))
        q = profile.shrink(noise.select("channel", "q", "n_diff"), "q", "n_diff").select("channel", F.col("shrunk").alias("q_shrunk"))
        noise = noise.join(r, "channel").join(q, "channel")
    kinds = profile.channel_profile(samples)
    return {"noise_estimates": noise.withColumn("estimator", F.lit(args.estimator)).join(kinds.select("channel", "channel_type"), "channel"), "channel_classification": kinds}


def layer2(samples, args) -> dict:
    found = bocpd.detect(samples, bocpd.fitted(samples, args.estimator == "mixture"))
    labels = samples.groupBy("channel", "segment").agg(F.max("anomaly").alias("anomaly"))
    calibration = bocpd.calibration(found, labels)
    scope = evidence.scope(calibration.select("channel", *[F.col(a).alias(b) for a, b in (("tp", "a"), ("fn", "b"), ("fp", "c"), ("tn", "d"))]))
    return {"onset_results": found.drop("runs", "candidates", "resets"), "onset_posteriors": bocpd.posteriors(found), "calibration": calibration, "channel_scope": scope, "scope_summary": files.summary_json(scope)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("alarmlens").getOrCreate()
    try:
        if args.stage in STAGES:
            if not args.tables:
                raise files.MissingInput("name --tables")
            made = {name: QUERIES[name](spark, args.tables) for name in STAGES[args.stage]}
        else:
            made = {"layer1": layer1, "layer2": layer2}[args.stage](load(spark, args), args)
        for name, df in made.items():
            files.save(df, args.out, name, args.format)
    except files.MissingInput as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
