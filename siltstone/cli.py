"""Command line: ``spark-submit --conf spark.siltstone.folder=SHARED siltstone/cli.py SOURCE``."""

from __future__ import annotations

import argparse
import sys

from siltstone.errors import SiltstoneError
from siltstone.plans.analysis import analyze_source
from siltstone.session import build_session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone", description="Analyse source repositories with Spark.")
    parser.add_argument("source", help="repository, or folder of repositories, to analyse")
    parser.add_argument("--folder", help="shared folder, where the session's spark.siltstone.folder is not set")
    options = parser.parse_args(arguments)
    try:
        spark = build_session()
        if options.folder:
            spark.conf.set("spark.siltstone.folder", options.folder)
        for name, frame in analyze_source(spark, options.source).items():
            print(f"{name}: {frame.count()}")
        return 0
    except SiltstoneError as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
