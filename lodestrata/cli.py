"""Entry points with exit codes: python -m lodestrata.cli <gate|erase|maintain> FILE

FILE is JSON: for gate a list of tables (path, suite or suite name, layer, threshold),
for erase a request (subjects, targets, requested_by), for maintain a list of specs.
0: done and passed; 1: a gate blocks, an erasure is incomplete, a table failed; 2: the
file can't be understood.
"""

from __future__ import annotations

import argparse
import json
import sys

from lodestrata.jobs import maintain
from lodestrata.operators import expectations, masking
from lodestrata.plans.table import VersionedTable
from lodestrata.session import session
from lodestrata.sources.specs import maintenance_specs


def main(arguments: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="lodestrata")
    parser.add_argument("command", choices=("gate", "erase", "maintain"))
    parser.add_argument("file")
    parser.add_argument("--suites", default="", help="folder of suites that tables name")
    parser.add_argument("--audit", default=None, help="table that takes the erasure's audit rows")
    given = parser.parse_args(arguments)
    try:
        with open(given.file, encoding="utf-8") as file:
            raw = json.load(file)
        if given.command == "erase":
            request = masking.ErasureRequest.of(raw)
        elif given.command == "maintain":
            specs = maintenance_specs(raw)
        else:
            raw = [x | {"suite": expectations.load_suite(given.suites, x["suite"]) if isinstance(x["suite"], str) else x["suite"]} for x in raw]
    except (OSError, ValueError, KeyError, TypeError) as error:
        print(f"{given.file}: {error}", file=sys.stderr)
        return 2
    spark = spark or session(f"lodestrata-{given.command}")
    if given.command == "gate":
        code, found = expectations.gate(raw, lambda path: VersionedTable(spark, path).read())
    elif given.command == "erase":
        report = masking.erase(spark, request, given.audit)
        code, found = int(not report.complete), report.results
    else:
        found = maintain(spark, specs)
        code = int(any(x["error"] for x in found))
    print(json.dumps(found))
    return code


if __name__ == "__main__":
    sys.exit(main())
