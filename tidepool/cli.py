"""Command line: ``python -m tidepool run --config_file C --seed S`` and
``python -m tidepool fingerprints -i IN -o OUT -s COLUMN``.

The configuration file is JSON with the keys listed in
:mod:`tidepool.plans.pipeline`.  Under ``spark-submit`` the session comes from
the submit options; run directly, a local session is built.
"""

from __future__ import annotations

import argparse
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    from tidepool.session import build_session, ensure_checkpoint_dir, ship_package
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        ship_package(active)
        return active
    return build_session()


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tidepool")
    sub = ap.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run", help="active-learning run from a JSON configuration")
    run.add_argument("--config_file", required=True)
    run.add_argument("--seed", type=int, default=None)
    fpp = sub.add_parser("fingerprints", help="fingerprint a string column; writes OUT and OUT_failed")
    fpp.add_argument("-i", "--input", required=True)
    fpp.add_argument("-o", "--output", required=True)
    fpp.add_argument("-s", "--smiles_column", required=True)
    fpp.add_argument("--size", type=int, default=2048)
    fpp.add_argument("--radius", type=int, default=6)
    args = ap.parse_args(argv)

    from tidepool.plans import pipeline

    spark = _session()
    if args.cmd == "run":
        with open(args.config_file) as fh:
            config = json.load(fh)
        if args.seed is not None:
            config["seed"] = args.seed
        res = pipeline.active_learning_run(spark, config)
        print(json.dumps({"history": res["history"], "metrics": res["metrics"]}))
    else:
        totals = pipeline.fingerprint_job(spark, args.input, args.output, args.smiles_column,
                                          size=args.size, radius=args.radius)
        print(json.dumps(totals))
    return 0


if __name__ == "__main__":
    sys.exit(main())
