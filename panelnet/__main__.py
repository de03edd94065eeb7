"""python -m panelnet STEP DATA OUT [--config FILE]: runs a step over the tables in DATA and writes Parquet to OUT."""

from __future__ import annotations

import argparse

from panelnet.config import Config, load
from panelnet.plans import pipeline

STEPS = {
    "features": pipeline.features, "k": pipeline.choose_k, "rules": pipeline.compare_rules,
    "methods": pipeline.compare_methods, "final": pipeline.final_labels, "robustness": pipeline.sensitivity,
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="panelnet", description=__doc__)
    p.add_argument("step", choices=STEPS)
    p.add_argument("data")
    p.add_argument("out")
    p.add_argument("--config")
    args = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("panelnet").getOrCreate()
    STEPS[args.step](spark, args.data, load(args.config) if args.config else Config()).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
