"""Run the experiment report as a Spark application.

    spark-submit --py-files splitscope.zip splitscope/__main__.py \\
        --sessions s3://bucket/sessions/ --format parquet --out s3://bucket/report/

    python -m splitscope --sessions sessions.csv --format csv --out /tmp/report --master local[8]

Reads the session table, writes the cleaned table once under the session's
``spark.checkpoint.dir`` and every analysis result as Parquet under ``--out``;
prints the small headline tables.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from splitscope.plans.report import analyses, run_report
from splitscope.session import RECOMMENDED_CONF, ensure_checkpoint_dir
from splitscope.sources.sessions import read_sessions, read_sessions_csv

HEADLINES = ("group_summary", "kpi_lift", "ztest_conversion", "randomization_chi2", "findings")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="splitscope", description=__doc__.splitlines()[0])
    ap.add_argument("--sessions", required=True, help="session table (folder or file)")
    ap.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    ap.add_argument("--out", required=True, help="output folder for the report tables")
    ap.add_argument("--only", nargs="*", help=f"analyses to run (default all): {', '.join(analyses())}")
    ap.add_argument("--master", help="Spark master when not launched by spark-submit, e.g. local[8]")
    args = ap.parse_args(argv)

    builder = SparkSession.builder.appName("splitscope-report")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()
    for key, value in RECOMMENDED_CONF.items():  # runtime SQL settings the cluster left unset
        if key.startswith("spark.sql.") and spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)

    reader = read_sessions_csv if args.format == "csv" else read_sessions
    sessions = reader(spark, args.sessions)
    results = run_report(spark, sessions, out_dir=args.out, names=args.only)
    for name in HEADLINES:
        if name in results:
            print(f"== {name}")
            results[name].show(truncate=False)


if __name__ == "__main__":
    main()
