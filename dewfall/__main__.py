"""spark-submit --py-files ... dewfall/__main__.py STEP --config FILE: a step of a climatology; FILE is the JSON of climate.Config. Exit 0: passed, 2: a check failed."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from dewfall import climate


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="dewfall")
    parser.add_argument("step", choices=("validate", "run", "audit", "merge-audit", "report"))
    parser.add_argument("--config", required=True, help="JSON file of the configuration")
    parser.add_argument("--year", type=int, help="the year to validate; the first one by default")
    given = parser.parse_args(arguments)
    with open(given.config) as file:
        config = climate.Config(**json.load(file))
    spark = SparkSession.builder.appName(f"dewfall {given.step}").getOrCreate()
    if given.step == "run":
        print(json.dumps({"added": climate.run(spark, config)}))
        return 0
    if given.step == "report":
        print(json.dumps(climate.report(spark, config)))
        return 0
    if given.step == "merge-audit":
        rows = [r.asDict() for r in climate.merge_audit(spark, config).orderBy("variable", "level").collect()]
        passed = all(r["off"] == 0 for r in rows)
    else:
        checks = climate.audit(spark, config) if given.step == "audit" else climate.validate(spark, config, given.year or config.first_year)
        rows = [r.asDict() for r in checks.collect()]
        passed = all(r["verdict"] == "PASS" for r in rows)
    print(json.dumps({"status": "PASS" if passed else "FAIL", "rows": rows}))
    return 0 if passed else 2


if __name__ == "__main__":
    sys.exit(main())
