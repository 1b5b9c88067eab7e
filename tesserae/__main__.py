"""python -m tesserae ROOT [CLASSPATH...]: scans Java sources and prints the whole JSON report under the illustrative policy; without a root, exit 2.

With --write FOLDER the report is written there by many tasks, in parts with a manifest that lists them in order.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tesserae.plans import analysis, documents, presets
from tesserae.sources import facts, java


def main(args: list[str]) -> int:
    folder = None
    if "--write" in args:
        at = args.index("--write")
        folder, args = (args[at + 1 : at + 2] or [None])[0], args[:at] + args[at + 2 :]
    if not args:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    found = java.extract(spark, facts.ExtractionRequest((args[0],), tuple(args[1:])))
    a = analysis.analyse(*facts.assemble(found.nodes, found.edges), presets.illustrative())
    report = documents.report(a, "subject", "scan", found.diagnostics)
    if folder:
        report.write(spark, folder)
        return 0
    for text in report.text():
        sys.stdout.write(text)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
