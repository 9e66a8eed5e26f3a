"""Runs a registered query over a folder of tables: ``python -m larkspur NAME --data FOLDER --out FOLDER``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from . import plans
from .sources.session import session


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser("larkspur", description="Run a registered query over a folder of Parquet tables.")
    parser.add_argument("name", nargs="?", choices=sorted(plans.QUERIES), metavar="NAME", help="the query; without one the names are listed")
    parser.add_argument("--data", help="folder of the tables")
    parser.add_argument("--out", help="folder that the rows are written to; without one the first rows are shown")
    parser.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    parser.add_argument("--overwrite", action="store_true", help="replace rows written before; else they are kept and nothing runs")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    parser.add_argument("--master", help="Spark master, if spark-submit doesn't set it")
    parser.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="a Spark setting")
    given = parser.parse_args(arguments)
    if given.name is None:
        print("\n".join(sorted(plans.QUERIES)))
        return
    if given.data is None:
        parser.error("--data is needed")
    spark = session(master=given.master, **dict(c.split("=", 1) for c in given.conf))
    df = plans.QUERIES[given.name](spark, given.data)
    if given.out is None:
        df.show(given.rows, truncate=False)
        return
    writer = df.write.mode("overwrite" if given.overwrite else "ignore").format(given.format)
    (writer.option("header", True) if given.format == "csv" else writer).save(given.out)


if __name__ == "__main__":
    main()
