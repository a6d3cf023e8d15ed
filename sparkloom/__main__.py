"""``python -m sparkloom list``, or ``run NAME DIR [OUT]``: run a query over the tables in DIR, show it or write it to OUT."""

from __future__ import annotations

import importlib
import importlib.util
import sys

from pyspark.sql import SparkSession


def known() -> dict:
    if importlib.util.find_spec("__spark_entry__"):
        return importlib.import_module("__spark_entry__").queries()
    out: dict = {}
    for name in ("general", "engine", "gating", "bundle", "records"):
        out |= importlib.import_module(f"sparkloom.plans.{name}").queries()
    return out


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(known()))
        return 0
    if len(args) in (3, 4) and args[0] == "run" and args[1] in known():
        spark = SparkSession.builder.appName(f"sparkloom {args[1]}").getOrCreate()
        df = known()[args[1]](spark, args[2])
        df.write.parquet(args[3]) if len(args) == 4 else df.show(40, truncate=80)
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
