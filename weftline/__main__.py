"""``python -m weftline ALGORITHM FASTA FASTQ OUT``: reads against sequences, as a folder of SAM-style lines."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from weftline.operators.mapping import ALGORITHMS, map_files
    from weftline.plans.ship import ship

    if len(args) != 4 or args[0] not in ALGORITHMS:
        print(f"usage: python -m weftline {'|'.join(ALGORITHMS)} FASTA FASTQ OUT", file=sys.stderr)
        return 1
    map_files(ship(SparkSession.builder.appName("weftline").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()), *args)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
