"""Jobs for spark-submit: check and normalize exports into a store, or show what it holds.

    spark-submit --py-files restomart.zip restomart/jobs.py --store /shared/silver load --toast ...
"""

from __future__ import annotations

import argparse
import sys

from restomart.operators.validate import InvalidExports, checked_exports
from restomart.plans.normalize import normalize
from restomart.session import build_session
from restomart.sources.config import read_config
from restomart.sources.exports import landed
from restomart.sources.store import LoadRejected, SilverStore, load_stats


def load(spark, args) -> int:
    """Stops with every violation before a version is published."""
    places, names = read_config(spark, args.locations, args.patterns, args.groups)
    exports = landed(checked_exports(spark, args.toast, args.doordash, args.square, args.layout))
    return SilverStore(spark, args.store).load(
        normalize(exports, places, names, compat=args.compat), clean=args.clean, enforce=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="restomart")
    parser.add_argument("--store", required=True)
    jobs = parser.add_subparsers(dest="job", required=True)
    loading = jobs.add_parser("load")
    for name in ("toast", "doordash", "square", "locations", "patterns", "groups"):
        loading.add_argument(f"--{name}", required=True)
    loading.add_argument("--layout", choices=("document", "lines"), default="document")
    loading.add_argument("--compat", action="store_true")
    loading.add_argument("--clean", action="store_true")
    jobs.add_parser("stats")
    args = parser.parse_args(argv)
    spark = build_session()
    if args.job == "stats":
        load_stats(SilverStore(spark, args.store).silver().tables()).show(truncate=False)
        return 0
    try:
        print(f"version {load(spark, args)}")
    except (InvalidExports, LoadRejected) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
