"""Command line: analyze, fit, transform, fit-transform, print-config, wizard."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tessera.plans.auto import AutoFeatureEngineer
from tessera.plans.config import Settings, config_to_dict, load_config, save_config
from tessera.plans.explain import ReportBuilder
from tessera.sources.readers import read_frame, write_parquet


def wizard(ask=input) -> Settings:
    """A few questions, with defaults for empty answers."""
    s = Settings()
    choices = [
        ("estimator_family", "Estimator family (tree, linear, svm, knn, nn)"),
        ("row_id", "Column that tells rows apart"),
        ("categorical_impute_strategy", "Missing categories (most_frequent, constant)"),
        ("hashing_n_features", "Hash buckets for columns of many values"),
        ("smote_enabled", "Resample a small class (true, false)"),
        ("reducer_kind", "Reduction (none, pca, svd)"),
    ]
    from tessera.plans.config import infer_type

    for k, q in choices:
        if answer := ask(f"{q} [{getattr(s, k)}]: ").strip():
            setattr(s, k, infer_type(answer))
    return s


def config_to_flags(s: Settings) -> list[str]:
    base = config_to_dict(Settings())
    return [f"--set={k}={json.dumps(v) if not isinstance(v, str) else v}" for k, v in config_to_dict(s).items() if v != base[k]]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "fit", "fit-transform"):
        c = sub.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--target", required=True)
        c.add_argument("--out", required=True)
        c.add_argument("--config")
        c.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    c = sub.add_parser("transform")
    for a in ("--pipeline", "--input", "--out"):
        c.add_argument(a, required=True)
    c = sub.add_parser("print-config")
    c.add_argument("--config")
    c.add_argument("--set", action="append", default=[])
    c = sub.add_parser("wizard")
    c.add_argument("--out")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "wizard":
        s = wizard()
        if a.out:
            save_config(s, a.out)
        print(" ".join(config_to_flags(s)))
        return 0
    if a.command == "print-config":
        print(json.dumps(config_to_dict(load_config(a.config, a.set)), indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    df = read_frame(spark, a.input)
    if a.command == "transform":
        write_parquet(AutoFeatureEngineer.load(spark, a.pipeline).transform(df), a.out)
        return 0
    eng = AutoFeatureEngineer(load_config(a.config, a.set))
    if a.command == "analyze":
        insights = eng.analyze(df, a.target)
        for i in insights.issues:
            print(i.severity, i.code, i.column or "", i.message)
        ReportBuilder().build(insights, a.out)
        return 0
    made = eng.fit_transform(df, a.target)
    eng.export(a.out if a.command == "fit" else f"{a.out}/pipeline")
    if a.command == "fit-transform":
        write_parquet(made, f"{a.out}/features.parquet")
    return 0


if __name__ == "__main__":
    sys.exit(main())
