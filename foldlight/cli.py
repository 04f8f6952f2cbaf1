"""Command line: `python -m foldlight.cli list|recovery|replay EVENTS [--ops PATH] [--json]`.

Exit status: 0 if all is well, 1 if a replay differs, 2 if the journal cannot be read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from foldlight.engine import JournalEngine, JournalError


def _show(frame: DataFrame, as_json: bool) -> None:
    for row in frame.toJSON().toLocalIterator() if as_json else map(lambda r: "  ".join(str(x) for x in r), frame.toLocalIterator()):
        print(row)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foldlight")
    parser.add_argument("what", choices=("list", "recovery", "replay"))
    parser.add_argument("events")
    parser.add_argument("--ops")
    parser.add_argument("--json", action="store_true")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("foldlight").getOrCreate()
    try:
        engine = JournalEngine.open(spark, given.events, given.ops)
    except JournalError as error:
        print(error, file=sys.stderr)
        return 2
    if given.what == "replay":
        found = engine.replay()
        _show(found, given.json)
        return int(bool(found.where("not matched").limit(1).count()))
    _show((engine.listing() if given.what == "list" else engine.recovery()).orderBy("execution_id"), given.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
