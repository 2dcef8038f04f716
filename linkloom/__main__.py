"""python -m linkloom CANDIDATES TRUTH: recall, coverage and multiplicity of a file of candidates."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from linkloom.operators import evaluate, pairs
from linkloom.sources import tables


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print("usage: python -m linkloom CANDIDATES TRUTH (tab-separated files)", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    for path in arguments:
        if not tables.exists(spark, path):
            print(f"no such file: {path}", file=sys.stderr)
            return 1
    candidates = tables.read_tsv(spark, arguments[0], tables.PAIR).distinct()
    truth = pairs.truth_pairs(tables.read_tsv(spark, arguments[1], tables.GROUND_TRUTH))
    for report in (evaluate.evaluation(truth, candidates), evaluate.distribution(evaluate.multiplicity(candidates)), evaluate.above(evaluate.multiplicity(candidates))):
        for row in report.collect():  # a few rows of figures
            print("  ".join(f"{k}={v}" for k, v in row.asDict().items()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
