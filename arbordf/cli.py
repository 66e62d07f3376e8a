"""Runs SQL files: python -m arbordf.cli [-o FILE] FILE...; result rows go out joined by commas."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from .session import AnalyticsSession


def lines(df: DataFrame) -> Iterator[str]:
    for row in df.toLocalIterator():
        yield ",".join("" if v is None else str(v) for v in row)


def run(session: AnalyticsSession, script: str, out: TextIO) -> None:
    from .plans.lexer import statements

    for text in statements(script):
        for line in lines(session.sql(text)):
            out.write(line + "\n")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="arbordf", description=__doc__)
    p.add_argument("-o", "--output", help="file for the result rows (default: standard output)")
    p.add_argument("files", nargs="+")
    a = p.parse_args(args)
    session = AnalyticsSession(SparkSession.builder.getOrCreate())
    out = open(a.output, "w") if a.output else sys.stdout  # noqa: SIM115
    try:
        for f in a.files:
            run(session, Path(f).read_text(), out)
    finally:
        if a.output:
            out.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
